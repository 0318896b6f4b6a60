"""Rows without an id, or of one id, stand or fall by their own text."""

from scorespark.llm import decontaminate


def test_each_row_by_its_text(spark):
    leak, clean = "so it sat on the mat and looked at a very old dog", "nothing of the sort"
    rows = [(None, leak), (None, clean), (1, leak), (1, clean), (2, clean), (2, clean)]
    items = spark.createDataFrame([(1, "sat on the mat and looked at a very old dog")], "item_id bigint, text string")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = decontaminate.drop_contaminated(docs, items)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([r for r in rows if r[1] == clean], key=str)
