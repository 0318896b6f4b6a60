"""Each operator against a brute-force version, an exact round trip or held-out accuracy."""

import base64
import hashlib
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from scorespark.llm import common, decontaminate, fingerprint, language, packing, quality, registry, simhash, sstable, toxicity, warc, wordpiece
from scorespark.llm.tokens import BYTE_BPE, WORD_BPE, tokenizer_path

ODD = [
    (1, None, "x"), (2, "", None), (3, "Word", "x"), (4, " \n\t ", "x"), (5, "ABC def ghi é Ü ß", "x"),
    (6, "the cat sat on the mat and looked at a very old dog again " * 3, "x"),
    (7, "the cat sat on the mat and looked at a very old dog again " * 3, "x"),
    (7, "the cat sat on the mat and looked at a very old dog again " * 3, "x"),
    (8, "x y\x1cz  don't it's 12,5 　 Σίσυφος ǅ <|endoftext|> 日本語テキスト 👩‍👩‍👧", "x"),
    (9, "long " * 30000 + "tail", "x"), (-5, "...!!! 123", "x"), (None, "lost id here", "x"), (2**60, "big id", "x"),
]
ITEMS = [(1, "sat on the mat and looked at a very old dog"), (2, "DOG again"), (3, None), (4, "!!"), (5, "never seen words here"), (1, "the cat"), (6, "long")]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id bigint, text string, bucket string").repartition(3).cache()


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return [(r["doc_id"], r["text"]) for r in common.table(spark, sf_dir, "documents").collect()]


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, bucket string")


def by_id(df, col="doc_id"):
    return {r[col]: r for r in df.collect()}


def test_empty_tables(spark, empty):
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert fingerprint.edited_likeness(empty).count() == 0
    assert fingerprint.fingerprint_documents(empty).count() == 0
    assert decontaminate.contamination(empty, items).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert packing.pack_documents(empty).count() == 0
    assert wordpiece.count_tokens(empty).count() == 0
    assert language.identify(empty, language.train(empty)).count() == 0
    labels = spark.createDataFrame([], "doc_id bigint, toxic int, grade int")
    assert toxicity.score_documents(empty, toxicity.train(empty, labels)).count() == 0
    assert quality.score_documents(empty, quality.train(empty, labels)).count() == 0
    folder = common.new_folder(spark, "empty")
    assert sstable.read_shards(spark, folder, sstable.write_shards(empty, folder)).count() == 0
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    folder = common.new_folder(spark, "empty")
    assert warc.read_records(warc.normalise(warc.write_monolithic(warc.with_revisits(pages), folder), folder), folder).count() == 0


# --- 1 quality ------------------------------------------------------------------------


def test_ordinal_learns_order():
    rng = np.random.default_rng(0)
    x = rng.random((600, 4))
    s = 6 * x[:, 0] - 3 * x[:, 1] + rng.logistic(size=600) * 0.3
    y = np.digitize(s, [0.5, 2.5])
    m = quality.fit_ordinal([(np.arange(4), r) for r in x], y, np.ones(600), epochs=60)
    assert m.thresholds[0] < m.thresholds[1]
    score = x @ m.weights[:4]
    assert (np.digitize(score, m.thresholds) == y).mean() > 0.85


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.1"
    got = registry.QUERIES["op1_quality_ordinal"](spark, d).where("held_out")
    rows = got.join(common.table(spark, d, "labels"), "doc_id").select("quality", "selected", "expected_grade").collect()
    good = [r["selected"] for r in rows if r["quality"] == 1]
    poor = [r["selected"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.98 and np.mean(poor) < 0.15
    assert all(0 <= r["expected_grade"] <= 2 for r in rows)


def test_quality_odd_rows(spark, odd):
    labels = spark.createDataFrame([(6, 1), (3, 0), (8, 2), (None, 1), (9, None)], "doc_id bigint, grade int")
    m = quality.train(odd, labels)
    got = quality.score_documents(odd, m).collect()
    assert len(got) == len(ODD) and all(0 <= r["p_tail"] <= 1 for r in got)
    assert quality.select_documents(odd, m, -1).columns == odd.columns
    assert quality.select_documents(odd, None).count() == len(ODD)


# --- 2 toxicity -----------------------------------------------------------------------


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    got = registry.QUERIES["op2_toxicity_subword"](spark, d).where("held_out")
    rows = got.join(common.table(spark, d, "labels"), "doc_id").select("toxic", "score", "predicted").collect()
    pos, neg = [r for r in rows if r["toxic"] == 1], [r for r in rows if r["toxic"] == 0]
    auc = np.mean([(a["score"] > b["score"]) + 0.5 * (a["score"] == b["score"]) for a in pos for b in neg[:800]])
    assert auc > 0.95
    assert np.mean([r["predicted"] for r in pos]) > 0.8 and np.mean([r["predicted"] for r in neg]) < 0.02


def test_misspelling_shares_vectors():
    rng = np.random.default_rng(1)
    common_words = ["".join(rng.choice(list("abcdefg"), 5)) for _ in range(200)]
    texts, y = [], []
    for i in range(400):
        t = list(rng.choice(common_words, 60))
        if i % 2:
            t.insert(int(rng.integers(60)), "worthless")
        texts.append(t)
        y.append(i % 2)
    m = toxicity.fit(texts, np.array(y), 0.5)
    score = lambda w: m.score(np.array([m.slope[toxicity.subwords(x)].mean() for x in [*common_words[:40], *w]]))
    assert score(["worthles"]) > 0.5 > score(["hijklmn"])


def test_toxicity_odd_rows(spark, odd):
    labels = spark.createDataFrame([(6, 1), (3, 0), (8, 0), (5, 1), (None, 1)], "doc_id bigint, toxic int")
    got = toxicity.score_documents(odd, toxicity.train(odd, labels)).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in toxicity.score_documents(odd, None).collect()} == {0.0}


# --- 3 fingerprints -------------------------------------------------------------------


def brute_sketch(t):
    """Bottom-128 of the shingles' hashes, one shingle at a time in plain integers."""
    full, found = (1 << 64) - 1, set()
    w = [xxhash.xxh64_intdigest(x.encode("utf-8", "replace")) for x in t.lower().split()]
    for s in range(max(1, len(w) - 4) if w else 0):
        h = 0
        for x in w[s : s + 5]:
            h = (h ^ x) * 0x9E3779B97F4A7C15 & full
            h ^= h >> 29
        h = h * 0xBF58476D1CE4E5B9 & full
        found.add((h ^ h >> 32) & (1 << 48) - 1)
    return sorted(found)[:128]


def brute_encode(s):
    return base64.b64encode(b"".join(x.to_bytes(6, "big") for x in s)).decode()


def brute_resemblance(a, b):
    both = sorted(set(a) | set(b))[:128]
    return sum(x in a and x in b for x in both) / len(both) if a and b else float(a == b)


def brute_likeness(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        k = len(t) // 4
        e = t[: len(t) - k] + u[:k]
        a, b, c = (brute_sketch(x) for x in (t, e, u))
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), brute_encode(a), brute_encode(b), brute_resemblance(a, b), brute_resemblance(a, c)))
    return sorted(out, key=str)


def test_fingerprints_equal_brute_force(spark, odd, docs, sf_dir):
    got = registry.QUERIES["op3_fingerprint_bottomk"](spark, sf_dir)
    assert sorted(map(tuple, got.collect()), key=str) == brute_likeness(docs)
    assert sorted(map(tuple, fingerprint.edited_likeness(odd).collect()), key=str) == brute_likeness([(r[0], r[1]) for r in ODD])


def hot_rows():
    """One id, and none, with many rows each; texts that share a long start."""
    rng = np.random.default_rng(4)
    text = lambda: " ".join(map(str, rng.integers(0, 99, int(rng.integers(0, 40)))))
    return [*((None, text()) for _ in range(150)), *((7, text()) for _ in range(150)), *((i, text()) for i in range(100))]


def test_hot_ids_are_spread(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    keyed, n = common.with_range_bucket(df, "doc_id", 16)
    sizes = {r["bucket"]: r["count"] for r in keyed.groupBy("bucket").count().collect()}
    assert max(sizes) < n and max(sizes.values()) < 60
    ends = keyed.groupBy("bucket").agg({"doc_id": "max"}).orderBy("bucket").collect()
    assert [r[1] or -1 for r in ends] == sorted(r[1] or -1 for r in ends)
    got = sorted(map(tuple, fingerprint.edited_likeness(df).collect()), key=str)
    assert [r[0] for r in got] == sorted((i for i, _ in rows), key=str)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert sorted(r[3] for r in got) == sorted(brute_encode(brute_sketch(t)) for _, t in order)
    folder = common.new_folder(spark, "hot")
    manifest = sstable.write_shards(df, folder)
    back = sstable.read_shards(spark, folder, manifest).orderBy("start").collect()
    assert [r["id"] for r in back] == [i for i, _ in order]
    assert [r["start"] for r in back] == np.cumsum([0, *(r["n_tokens"] for r in back)])[:-1].tolist()
    assert len(sstable.lookup(folder, manifest.collect(), 7)) == 151 and len(sstable.lookup(folder, manifest.collect(), None)) == 150


def test_text_ids(spark):
    rows = [(f"doc-{i:05d}" if i else None, f"word {i} and " * (i % 9)) for i in range(120)] + [("é", "x y"), ("", "z")]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    order = sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode()))
    got = {r["doc_id"]: r["edited_sha256"] for r in fingerprint.edited_likeness(df).collect()}
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        k = len(t) // 4
        assert got[i] == hashlib.sha256((t[: len(t) - k] + u[:k]).encode()).hexdigest(), i
    folder = common.new_folder(spark, "text-ids")
    manifest = sstable.write_shards(df, folder)
    back = sstable.read_shards(spark, folder, manifest, "string").orderBy("start").collect()
    assert [r["id"] for r in back] == [i for i, _ in order]
    assert len(sstable.lookup(folder, manifest.collect(), "doc-00007")) == 1


def test_sketch_estimates():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in rng.integers(0, 10**6, 4000)]
    a, b = " ".join(words[:3000]), " ".join(words[1000:])
    sa, sb = fingerprint.sketch(a), fingerprint.sketch(b)
    assert abs(fingerprint.resemblance(sa, sb) - 0.5) < 0.12
    assert abs(fingerprint.containment(sa, sb) - 0.667) < 0.15
    assert abs(fingerprint.distinct(sa) / 2996 - 1) < 0.25
    assert (fingerprint.merge(sa, sb) == fingerprint.sketch(a + " " + b)).mean() > 0.9
    assert fingerprint.resemblance(fingerprint.sketch(""), fingerprint.sketch("")) == 1
    assert (fingerprint.decode(fingerprint.encode(sa)) == sa).all()


def test_merged_fingerprints(spark, odd):
    got = by_id(fingerprint.merge_fingerprints(fingerprint.fingerprint_documents(odd).withColumn("all", __import__("pyspark").sql.functions.lit("k")), "all"), "all")
    want = np.empty(0, np.uint64)
    for _, t, _ in ODD:
        want = fingerprint.merge(want, fingerprint.sketch(t or ""))
    assert got["k"]["fingerprint"] == fingerprint.encode(want)


# --- 4 decontamination ----------------------------------------------------------------

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_words(t):
    return WORD.findall((t or "").encode().lower())


def brute_contamination(rows, items):
    index = defaultdict(set)
    for i, t in items:
        w = brute_words(t)
        for s in range(max(1, len(w) - 9) if w else 0):
            index[tuple(w[s : s + 10])].add(str(i))
    sizes, out = {len(k) for k in index}, []
    for i, t in rows:
        w, hit, names = brute_words(t), set(), set()
        for s in range(len(w)):
            for n in sizes:
                if tuple(w[s : s + n]) in index and s + n <= len(w):
                    hit |= set(range(s, s + n))
                    names |= index[tuple(w[s : s + n])]
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), len(hit) > 0))
    return sorted(out, key=str)


def test_decontamination_equals_brute_force(spark, odd, docs, sf_dir):
    items = [(r["item_id"], r["text"]) for r in common.table(spark, sf_dir, "benchmark").collect()]
    got = registry.QUERIES["op4_decontaminate_index"](spark, sf_dir)
    assert sorted(map(tuple, got.collect()), key=str) == brute_contamination(docs, items)
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    for most in (200_000, 0):
        got = decontaminate.contamination(odd, bench, most=most)
        assert sorted(map(tuple, got.collect()), key=str) == brute_contamination([(r[0], r[1]) for r in ODD], ITEMS)
    kept = decontaminate.drop_contaminated(odd, bench)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r[0]) for r in brute_contamination([(r[0], r[1]) for r in ODD], ITEMS) if not r[5])


def test_native_plan(spark, sf_dir):
    plan = registry.QUERIES["op4_decontaminate_index"](spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_proximity(spark):
    d = spark.createDataFrame([(1, "a b c x d e f"), (2, "f e d c b a"), (3, "a b c " + "x " * 20 + "d e f")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")
    near = {r["id"] for r in decontaminate.proximity_matches(d, items, span=8).collect()}
    assert near == {1, 2}
    assert decontaminate.phrase_matches(d, items).count() == 0


def test_rows_are_told_apart(spark):
    """Rows without an id, or of one id, have their own hits."""
    leak, clean = "so it sat on the mat and looked at a very old dog", "nothing of the sort"
    rows = [(None, leak), (None, clean), (1, clean), (1, leak), (2, clean), (2, None)]
    bench = [(1, "sat on the mat and looked at a very old dog")]
    got = decontaminate.contamination(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(bench, "item_id bigint, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute_contamination(rows, bench)


def test_lists_are_intersected(spark):
    """All the terms of a window, but not in its order, nor next to each other."""
    bench = [(1, "a b c d e f g h i j k"), (2, "the the cat"), (3, "the cat the")]
    rows = [(1, "a b c d e f g h i k j"), (2, "x a b c d e f g h i j"), (3, "the the cat the the cat the cat"), (4, "j i h g f e d c b a"), (5, "a b c d e x f g h i j k")]
    got = decontaminate.contamination(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(bench, "item_id bigint, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute_contamination(rows, bench)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    want = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(tuple, registry.QUERIES[name](spark, sf_dir).select(columns).collect()), key=str) == sorted(want.fetchall(), key=str)


# --- 5 token shards -------------------------------------------------------------------


def encoded(name, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(name))
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def brute_shards(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out, at = [], 0
    for (i, _), ids in zip(rows, encoded(BYTE_BPE, [t for _, t in rows])):
        ids = ids + [2]
        out.append((i, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    return sorted(out, key=str)


def test_shards_equal_brute_force(spark, odd, docs, sf_dir):
    got = registry.QUERIES["op5_token_sstable"](spark, sf_dir)
    assert sorted(map(tuple, got.collect()), key=str) == brute_shards(docs)
    folder = common.new_folder(spark, "odd")
    manifest = sstable.write_shards(odd, folder)
    assert sorted(map(tuple, sstable.read_shards(spark, folder, manifest).collect()), key=str) == brute_shards([(r[0], r[1]) for r in ODD])
    rows = manifest.collect()
    assert sstable.lookup(folder, rows, 3)[0].tolist() == encoded(BYTE_BPE, ["Word"])[0] + [2]
    assert len(sstable.lookup(folder, rows, 7)) == 2 and len(sstable.lookup(folder, rows, None)) == 1
    assert sstable.lookup(folder, rows, 1000) == []


def test_wide_ids(tmp_path):
    with open(tmp_path / "x.sst", "wb") as f:
        writer = sstable.SSTableWriter(f, 2)
        writer.add(b"a", np.array([65535], np.uint32))
        with pytest.raises(ValueError):
            writer.add(b"b", np.array([65536], np.uint32))


def test_shard_blocks(tmp_path):
    path = tmp_path / "x.sst"
    with open(path, "wb") as f:
        w = sstable.SSTableWriter(f, block_bytes=100)
        for i in range(500):
            w.add(sstable.key_bytes(f"key{i:05d}"), np.arange(i % 7))
        w.close()
    with open(path, "rb") as f:
        r = sstable.SSTableReader(f)
        assert len(r.blocks) > 10 and r.n_entries == 500
        assert [sstable.key_value(k) for k, _ in r] == [f"key{i:05d}" for i in range(500)]
        assert r.get("key00013")[0].tolist() == [0, 1, 2, 3, 4, 5] and r.get("key1") == []
        assert sum(r.may_hold(sstable.key_bytes(f"no{i}")) for i in range(1000)) < 60
    raw = bytearray(path.read_bytes())
    raw[20] ^= 1
    path.write_bytes(bytes(raw))
    with open(path, "rb") as f, pytest.raises((ValueError, zlib.error)):
        list(sstable.SSTableReader(f))


# --- 6 near-duplicates ----------------------------------------------------------------


def brute_simhash(t):
    w = [x for x in re.split(rb"[\x20\x09-\x0D]+", (t or "").encode().lower()) if x]
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    label = {f: f for f in fps}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    keys = sorted(label)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                label[root(b)] = root(a)
    return {f: root(f) for f in keys}


def brute_near(rows):
    fps = [(i, brute_simhash(t)) for i, t in rows]
    root = brute_components([f for _, f in fps])
    least = defaultdict(list)
    for i, f in fps:
        if i is not None:
            least[root[f]].append(i)
    return sorted(((i, f"{f:016x}", min(least[root[f]], default=None)) for i, f in fps), key=str)


def test_near_duplicates_equal_brute_force(spark, odd, docs, sf_dir):
    got = registry.QUERIES["op6_simhash_trie"](spark, sf_dir)
    assert sorted(map(tuple, got.collect()), key=str) == brute_near(docs)
    for hot in (4096, 1):
        got = simhash.near_duplicates(odd, hot=hot)
        assert sorted(map(tuple, got.collect()), key=str) == brute_near([(r[0], r[1]) for r in ODD])


@pytest.mark.parametrize("hot", [4096, 20])
def test_trie_join_equals_brute_force(spark, hot):
    rng = np.random.default_rng(4)
    fps = []
    for _ in range(40):
        f = int(rng.integers(0, 2**63)) * 2 + int(rng.integers(2))
        for _ in range(8):
            fps.append(f)
            f ^= sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 5)), replace=False))
    fps = sorted(set(fps))
    signed = np.array(fps, np.uint64).view(np.int64)
    nodes = spark.createDataFrame([(int(x),) for x in signed], "fp bigint")
    comp = {r["node"]: r["root"] for r in simhash.components(simhash.link_stars(nodes, hot)).collect()}
    want = brute_components(fps)
    groups = lambda of: sorted(sorted(g) for g in of.values())
    a, b = defaultdict(list), defaultdict(list)
    for f, s in zip(fps, signed):
        a[comp.get(int(s), int(s))].append(f)
        b[want[f]].append(f)
    assert groups(a) == groups(b)


def test_trie_pairs_are_all_pairs():
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**62, 3)
    fp = np.unique(np.array([int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 63, (200, 2))], np.uint64))
    got = {(int(i), int(j)) for a, b in simhash.trie_links(np.zeros(len(fp), int), fp, chunk=50) for i, j in zip(a, b)}
    want = {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if int(fp[i] ^ fp[j]).bit_count() <= 2}
    assert got == want


# --- 7 WARC ---------------------------------------------------------------------------


def brute_warc(rows):
    of = defaultdict(list)
    for i, _, h in rows:
        of[h or ""].append(i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        top = max((x for x in of[h or ""] if x is not None), default=None)
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if i == top else "revisit", None if i == top else top))
    return sorted(out, key=str)


def test_warc_equals_brute_force(spark, sf_dir):
    pages = [tuple(r) for r in common.table(spark, sf_dir, "pages").select("page_id", "url", "html").collect()]
    got = registry.QUERIES["op7_warc_normalise"](spark, sf_dir)
    assert sorted(map(tuple, got.collect()), key=str) == brute_warc(pages)
    rows = [(1, "http://a/\r\nX: y", "a"), (2, None, "a"), (3, "u", None), (4, "u", ""), (5, "u", "é\r\n\r\nWARC/1.1\r\n\r\n" * 9000), (None, "u", "a"), (6, "u", "z"), (-1, "u", "z")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "page_id bigint, url string, html string, digest int")
    folder = common.new_folder(spark, "warc")
    written = warc.normalise(warc.write_monolithic(warc.with_revisits(df), folder), folder)
    assert sorted(map(tuple, warc.read_records(written, folder).collect()), key=str) == brute_warc(rows)


def test_normaliser_members(tmp_path):
    import gzip
    import io

    records = [warc.build_record(i, "u", b"x" * (i * 50_000), warc.digest(b"x" * (i * 50_000)), i * 50_000, None) for i in range(5)]
    whole, sink, index = io.BytesIO(gzip.compress(b"".join(records))), io.BytesIO(), io.BytesIO()
    assert warc.normalise_file(whole, sink, index) == 5
    assert gzip.decompress(sink.getvalue()) == b"".join(records)
    index.seek(0)
    for line, want in zip(index.read().decode().splitlines(), records):
        at, n = map(int, line.split()[:2])
        assert gzip.decompress(sink.getvalue()[at : at + n]) == want
    with pytest.raises(ValueError):
        warc.normalise_file(io.BytesIO(gzip.compress(records[1][:-9])), io.BytesIO(), io.BytesIO())


# --- 8 packing ------------------------------------------------------------------------


def check_packing(rows, texts, size=2048):
    want = []
    for (i, _), ids in zip(texts, encoded(WORD_BPE, [t for _, t in texts])):
        ids = ids + [0]
        for p in range(0, len(ids), size):
            part = ids[p : p + size]
            want.append((i, p // size, p, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(want, key=str)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= size
    return len(bins), -(-sum(w[3] for w in want) // size)


def test_packing(spark, odd, docs, sf_dir):
    n, bound = check_packing(registry.QUERIES["op8_pack_genetic"](spark, sf_dir).collect(), docs)
    assert n <= bound + 1
    n, bound = check_packing(packing.pack_documents(odd).collect(), [(r[0], r[1]) for r in ODD])
    assert n <= bound + 1
    n, bound = check_packing(packing.pack_documents(common.table(spark, sf_dir, "documents"), shard=40).collect(), docs)
    assert n <= bound * 1.02 + 2


def triplets(n_bins, size, rng):
    """Pieces of over a quarter and under half of a sequence: at most three fit, and
    an optimal packing has exactly three in every sequence."""
    out = []
    for _ in range(n_bins):
        a = int(rng.integers(size * 38 // 100, size * 46 // 100))
        rest = size - a - size * SLACK // 1000
        b = int(rng.integers(max(size // 4 + 1, rest - size * 49 // 100), rest // 2))
        out += [a, b, rest - b]
    assert all(size / 4 < x < size / 2 for x in out)
    x = np.array(out)
    rng.shuffle(x)
    return x


SLACK = 12


def test_crossover_finds_what_best_fit_decreasing_misses():
    best = {"falling": [], "crossing": [], "mutation only": []}
    for seed in range(6):
        x = triplets(16, 1000, np.random.default_rng(seed))
        best["falling"].append(packing.pack(x, np.argsort(-x, kind="stable"), 1000).max() + 1)
        for name, crossing in (("crossing", True), ("mutation only", False)):
            slots, crossed = packing.evolve(x, seed, 1000, population=24, generations=600, crossing=crossing)
            assert (crossed > 0) == crossing and packing.fills_of(x, slots).max() <= 1000
            best[name].append(slots.max() + 1)
    assert min(best["falling"]) > 16, best
    assert best["crossing"].count(16) >= 3 and best["crossing"].count(16) > best["mutation only"].count(16), best


def test_packing_is_the_work_of_crossover():
    """Mixed lengths: the first packings are over the bound, crossover closes the gap."""
    x = np.minimum(2047, np.random.default_rng(3).gamma(1.2, 600, 1500).astype(int) + 2)
    bound = -(-x.sum() // 2048)
    first = min(packing.pack(x, np.random.default_rng(k).permutation(1500), 2048).max() + 1 for k in range(8))
    crossed, plain = (packing.evolve(x, 1, generations=100, crossing=c)[0].max() + 1 for c in (True, False))
    assert crossed < plain < first and crossed <= bound + 2


def test_crossover_keeps_every_piece():
    rng = np.random.default_rng(2)
    x = rng.integers(300, 1100, 200)
    a, b = (packing.pack(x, rng.permutation(200), 2048) for _ in range(2))
    for child in (packing.crossover(x, a, b, 2048, rng), packing.mutate(x, a, 2048, rng)):
        fills = packing.fills_of(x, child)
        assert len(child) == 200 and fills.sum() == x.sum() and fills.max() <= 2048 and fills.min() > 0


# --- 9 token counts -------------------------------------------------------------------


def brute_count(word, initial, continuing):
    n, at = 0, 0
    while at < len(word):
        entries = continuing if at else initial
        end = next((e for e in range(len(word), at, -1) if word[at:e] in entries), None)
        if end is None:
            return -1
        n, at = n + 1, end
    return n


def test_automaton_equals_greedy():
    rng = np.random.default_rng(6)
    for _ in range(60):
        word = lambda k: bytes(rng.choice(list(b"abc"), k).tolist())
        initial = {word(int(rng.integers(1, 5))) for _ in range(6)}
        continuing = {word(int(rng.integers(1, 5))) for _ in range(6)}
        auto = wordpiece.LongestMatch(initial, continuing)
        for _ in range(60):
            w = word(int(rng.integers(0, 9)))
            assert auto.count(w) == brute_count(w, initial, continuing), (initial, continuing, w)


def test_token_counts(spark, odd, docs, sf_dir):
    vocab = wordpiece.vocabulary(tokenizer_path(BYTE_BPE))
    for got, rows in ((registry.QUERIES["op9_token_counts"](spark, sf_dir), docs), (wordpiece.count_tokens(odd), [(r[0], r[1]) for r in ODD])):
        want = []
        for i, t in rows:
            c = [brute_count(w, *vocab) for w in (t or "").encode().split()]
            want.append((i, len(c), sum(1 if x < 0 else x for x in c), c.count(-1)))
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


# --- 10 language ----------------------------------------------------------------------


def test_language_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = registry.QUERIES["op10_language_mixture"](spark, d).where("held_out")
    rows = got.join(common.table(spark, d, "documents").select("doc_id", "lang"), "doc_id").where("lang is not null").collect()
    assert len(rows) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97


def test_language_mixture(spark, sf_dir):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    model = language.train(docs)
    texts = {r["lang"]: r["text"] for r in docs.where("n_chars between 2000 and 4000 and lang is not null").orderBy("doc_id").collect()}
    en, de = texts["en"][:2000], texts["de"][:1000]
    (name, share, all_shares), (none, zero, _) = language.infer(model, [en + " " + de, "12 !!"])
    assert name == "en" and 0.5 < share < 0.8 and all_shares[model.names.index("de")] > 0.2
    assert (none, zero) == ("und", 0.0)


def made_model(n):
    """n languages, each with an alphabet of its own."""
    rng = np.random.default_rng(0)
    letters = [chr(0x4E00 + 40 * i) for i in range(n)]
    say = lambda i, k: "".join(chr(ord(letters[i]) + int(x)) for x in rng.integers(0, 30, k))
    total = np.zeros((n, 1 << language.BITS))
    for i in range(n):
        total[i] += np.bincount(language.grams(say(i, 20_000)), minlength=1 << language.BITS)
    logp = np.log((total + 1e-3) / (total + 1e-3).sum(1, keepdims=True))
    return language.LanguageModel([f"l{i}" for i in range(n)], np.ascontiguousarray(logp.T)), say


def test_more_than_four_languages_mix():
    model, say = made_model(7)
    (name, share, shares), *rest = language.infer(model, ["".join(say(i, 3000) for i in range(6)), say(5, 400)])
    assert sum(p > 0.1 for p in shares) == 6 and shares[6] < 0.02 and 0.1 < share < 0.25
    assert rest[0][0] == "l5" and rest[0][1] > 0.99


def brute_infer(model, text):
    """One text, run by run, every set size."""
    g = language.grams(text)
    like = np.array([[model.logp[g[a : a + language.RUN], k].sum() / 3 for k in range(len(model.names))] for a in range(0, len(g), language.RUN)])

    def em(langs):
        theta = np.where(np.isin(np.arange(like.shape[1]), langs), 1 / len(langs), 0)
        lik = np.exp(np.maximum(like - like.max(1, keepdims=True), -60))
        for _ in range(12):
            joint = lik * theta
            theta = (joint / joint.sum(1, keepdims=True)).mean(0)
        return theta, (np.log((lik * theta).sum(1)) + like.max(1)).sum()

    full, first = em(np.arange(like.shape[1]))[0], int(like.sum(0).argmax())
    order = [first, *(k for k in np.argsort(-full, kind="stable") if k != first)]
    sets = [(like.sum(0)[first], np.eye(like.shape[1])[first])]
    for k in range(2, like.shape[1] + 1):
        theta, ll = em(order[:k])
        sets.append((ll, theta))
    values = [ll - (k + 1) * language.PENALTY * np.log(len(like) + 1) if k else ll - language.PENALTY * np.log(len(like) + 1) for k, (ll, _) in enumerate(sets)]
    return sets[int(np.argmax(values))][1]


def test_inference_equals_one_text_at_a_time(spark, docs):
    model = language.train(common.table(spark, "/root/testdata/sf0.001", "documents"))
    texts = [t for _, t in docs if t and re.search("[a-z]", t)][:60]
    texts += [a[:600] + " " + b[:300] for a, b in zip(texts, texts[7:])]
    for text, (_, _, shares) in zip(texts, language.infer(model, texts)):
        assert shares == pytest.approx(brute_infer(model, text), abs=1e-6)


def test_language_odd_rows(spark, odd):
    model = language.train(common.table(spark, "/root/testdata/sf0.001", "documents"))
    got = language.identify(odd, model).collect()
    assert len(got) == len(ODD)
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {1, 2, 4, -5}
    assert all(0 <= r["score"] <= 1 for r in got)
    assert language.keep_identified(odd, model, 0).columns == odd.columns
