"""The five stages in order, each held against a plain version over its own input."""

import pytest
from test_near_copies import brute_kept
from test_operators import ODD, brute_contamination, check_packing

import corpus_pipeline
from scorespark.llm import language, quality
from scorespark.llm.common import fold_is, table


def test_stages_in_order(spark, sf_dir):
    """Whole tables: what each stage keeps, and run() returns the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "language", "near_dedup", "decontamination", "packing"]

    model = quality.train_on_labels(spark, docs, sf_dir)
    good = {r["doc_id"] for r in docs.collect() if model.tails(r["text"] or "")[0] >= 0.5}
    docs = stages["quality"](spark, docs, sf_dir).cache()
    assert docs.columns == columns and {r["doc_id"] for r in docs.collect()} == good

    model = language.train(docs.where(~fold_is("doc_id", 5, 0)))
    found = {r["doc_id"]: language.infer(model, [r["text"] or ""])[0] for r in docs.collect()}
    docs = stages["language"](spark, docs, sf_dir).cache()
    assert docs.columns == columns and {r["doc_id"] for r in docs.collect()} == {i for i, g in found.items() if g[0] != "und" and g[1] >= 0.5}

    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    docs = stages["near_dedup"](spark, docs, sf_dir).cache()
    assert docs.columns == columns and sorted(r["doc_id"] for r in docs.collect()) == sorted(rows[i][0] for i in brute_kept(rows))

    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
    docs = stages["decontamination"](spark, docs, sf_dir).cache()
    assert docs.columns == columns and {r["doc_id"] for r in docs.collect()} == {r[0] for r in brute_contamination(rows, items) if not r[5]}

    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = corpus_pipeline.run(spark, sf_dir).collect()
    n, bound = check_packing(got, rows)
    assert n <= bound + 1


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_odd_rows_of_each_stage(spark, sf_dir, name):
    """Null and repeated ids, null, empty and long texts, ties, clashing columns: rows come out
    unchanged or not at all, and an empty table stays one."""
    rows = [(*r[:2], "en", r[2], 1) for r in ODD] + [(None, "lost id here as well, but another text", None, "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, _row string, row int")
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, docs, sf_dir)
    assert got.schema == docs.schema
    left = list(rows)
    for r in map(tuple, got.collect()):
        left.remove(r)
    assert stage(spark, docs.limit(0), sf_dir).count() == 0
