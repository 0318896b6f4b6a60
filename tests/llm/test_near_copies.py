"""The pipeline's near-copy stage against all pairs."""

import os

import numpy as np
import pytest

import corpus_pipeline
from scorespark.llm import common, near_copies


def brute_set(t):
    w = (t or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_kept(rows):
    """Indices of the rows that stay; of equal ids any one of equal texts may."""
    sets = [brute_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) * 5 >= max(len(a), len(b)) * 4 and 5 * len(a & b) >= 4 * len(a | b):
                label[root(i)] = root(j)
    best = {}
    for i, (k, _) in enumerate(rows):
        r = root(i)
        if r not in best or (k is None, k or 0) < (rows[best[r]][0] is None, rows[best[r]][0] or 0):
            best[r] = i
    return sorted(best.values())


def edited(rng, words, n):
    w = list(words)
    for at in rng.choice(len(w), n, replace=False):
        w[at] = f"x{rng.integers(10**9)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def made():
    rng = np.random.default_rng(8)
    rows = []
    for k in range(12):
        words = [f"w{i}" for i in rng.integers(0, 10**6, 200)]
        rows += [(7 * k + i, edited(rng, words, e)) for i, e in enumerate((0, 1, 2, 3, 4, 6, 12))]
    return rows


def test_near_copies_go(spark, made):
    got = corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame(made, "doc_id bigint, text string").repartition(3), "")
    want = [made[i][0] for i in brute_kept(made)]
    assert sorted(r["doc_id"] for r in got.collect()) == want and len(want) < len(made) * 0.6


def test_all_of_the_table(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = near_copies.keep_one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(rows[i][0] for i in brute_kept(rows))


def test_bits_differ_by_the_angle():
    """Of a pair of similarity 0.8 about 0.15 of the bits differ; half of an unlike pair's."""
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b, c = np.unique(pool[:900]), np.unique(pool[100:1000]), np.unique(pool[2000:2900])
    bits = [np.unpackbits(near_copies.simhash_bits(x).view(np.uint8)) for x in (a, b, c)]
    assert len(bits[0]) == 64 + 16 * near_copies.TABLES and abs((bits[0] != bits[1]).mean() - 0.152) < 0.04 and abs((bits[0] != bits[2]).mean() - 0.5) < 0.06
    assert (near_copies.simhash_bits(a) == near_copies.simhash_bits(a[::-1])).all()


def test_rows_are_told_apart(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve"
    rows = [(None, a), (None, a), (3, b), (3, b), (3, "something else"), (None, None), (None, ""), (None, "left alone"), (1, a)]
    got = near_copies.keep_one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string"))
    kept = sorted(((r["doc_id"], r["text"] or "") for r in got.collect()), key=str)
    assert kept == sorted([(1, a), (3, b), (3, "something else"), (None, ""), (None, "left alone")], key=str)
    assert near_copies.keep_one_of_each(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_crowds_are_joined(spark):
    """More near copies than a bucket compares pair by pair."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in rng.integers(0, 10**6, 300)]
    rows = [(i, edited(rng, words, int(rng.integers(1, 9)))) for i in range(400)]
    got = near_copies.keep_one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == [rows[i][0] for i in brute_kept(rows)]


def near_set(rng, s, n):
    return np.unique(np.concatenate([s[n:], rng.integers(0, 2**63, n, dtype=np.uint64)]))


def sketch(sets):
    bits = np.array([near_copies.simhash_bits(s) for s in sets]).view(np.int64)
    return np.array([len(s) for s in sets], np.int32), bits[:, 0], bits[:, 9]


@pytest.mark.parametrize("many", [300, 1500])
def test_unlike_texts_of_a_prefix_are_not_gathered(many):
    """In large tables dozens share a prefix by chance: only the near copies among them are handed on."""
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**63, 100, dtype=np.uint64)) for _ in range(many)]
    sets += [near_set(rng, sets[i], 3) for i in range(10)]
    n = len(sets)
    u, v = near_copies.bucket_stars(np.zeros(n, np.int32), np.arange(n), *sketch(sets))
    found = {tuple(sorted(x)) for x in zip(u.tolist(), v.tolist())}
    assert found >= {(i, many + i) for i in range(10)} and len(found) <= 12  # by chance one pair of 4 million


@pytest.mark.parametrize("crowd", [near_copies.CROWD, 20])
def test_stars_connect_what_near_pairs_connect(monkeypatch, crowd):
    """Groups of near copies, also chains, in two prefixes, traversed and by pivots."""
    monkeypatch.setattr(near_copies, "CROWD", crowd)
    rng = np.random.default_rng(4)
    sets = []
    for members in (1, 1, 90, 40, 3, 1, 2, 60):
        sets.append(np.unique(rng.integers(0, 2**63, 120, dtype=np.uint64)))
        for _ in range(members - 1):
            sets.append(near_set(rng, sets[-1], int(rng.integers(1, 25))))
    n = len(sets)
    at = rng.permutation(n)
    sets = [sets[i] for i in at]
    key = rng.integers(0, 2, n).astype(np.int32)
    size, fp, more = sketch(sets)
    u, v = near_copies.bucket_stars(key, np.arange(n), size, fp, more)
    i, j = np.triu_indices(n, 1)
    ok = (key[i] == key[j]) & near_copies._near(i, j, size, fp.view(np.uint64), more.view(np.uint64))
    assert ok.sum() > 200 and len(u) < n
    roots = [near_copies.stars(n, [x]) for x in ((i[ok], j[ok]), (u, v))]
    assert (roots[0] == roots[1]).all()


def test_similar_sets_by_index():
    rng = np.random.default_rng(6)
    sets = []
    for members in (30, 1, 9, 2, 1, 5):
        sets.append(np.unique(rng.integers(0, 2**63, 50, dtype=np.uint64)))
        for _ in range(members - 1):
            sets.append(near_set(rng, sets[-1], int(rng.integers(1, 8))))
    n, sets = len(sets), [sets[i] for i in rng.permutation(len(sets))]
    want = [(i, j) for i in range(n) for j in range(i) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))]
    roots = [near_copies.stars(n, [tuple(np.array(x).T)]) for x in (want, near_copies.similar_links(sets))]
    assert (roots[0] == roots[1]).all() and len(want) > 30


def test_rows_by_bitmap_and_nothing_left_behind(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id * 12345678901 % 1000003 + (id % 3 << 33) as _row", "id").distinct()
    chosen = rows.where("id % 7 = 0 or id > 900").select(rows._row.alias("row"))
    assert sorted(r["id"] for r in near_copies.only_rows(rows, chosen).collect()) == [i for i in range(1000) if i % 7 == 0 or i > 900]
    kept = common.stash(rows, "bitmap-test", 100)
    folder = kept.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:")
    assert len(kept.inputFiles()) >= 10 and os.path.isdir(folder)
    common.drop_stash(kept)
    assert not os.path.exists(folder)
