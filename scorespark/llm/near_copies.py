"""Near copies by SimHash tries over 5-word shingles, confirmed by their Jaccard similarity: the
operator of ``simhash`` for a wider budget, as the pipeline needs it.

Two texts are near copies where the sets of their shingles' XXH64 have a Jaccard similarity
of ``LEAST`` = 4/5 or more. The SimHash bits of such a pair differ with a probability of
0.15 each, about 10 of 64: a trie over one fingerprint can't prune before it has met nearly
all pairs. So a text has ``TABLES`` = 64 prefixes of 16 bits and a fingerprint of 64 bits, of
1088 SimHash bits in all. Texts that agree in one of the prefixes form a binary trie over their
fingerprints, whose node pairs are traversed together (``simhash.trie_links``) and pruned
beyond ``BUDGET`` = 20 differing bits. In a table of millions dozens of unlike texts share each
prefix by chance, and 1 of 500 of such pairs is within that budget; so 64 more bits, of prefixes of other
tables, travel with the fingerprint, and a link has at most ``WIDE`` = 35 of the 128 bits
differing, by chance 1 pair of 4 million. By calculation a pair of similarity 0.8 is missed with
probability 0.008, one of 0.85 with 0.0006; a row only escapes if it is missed with all its
near copies.

A prefix emits a spanning star of each of its components, never all pairs. Prefixes that over ``CROWD``
texts share are not traversed as a whole: a few texts are compared with all, and only those outside
the component that this finds, if it is large, with each other and with it. The components of all stars
are then gathered, each text once, and what is similar in them is found by the whole
shingle sets, so nothing less similar is linked: by an inverted index, where a few
texts are compared with all, then each text outside the largest component is, so no pair of two components is
left out. Only the texts in such components are moved; they and the rows that stay
are told to the tasks by a bitmap, a bit a row.

Equal shingle sets (by 64 bits of their hash) are one node, named by a row of it. Of each component of links
one row stays, the smallest id's (no id: after all others); rows are told apart by a number
written with them, so null and repeated ids don't matter.

Defined cases: null and empty texts have equal (empty) sets; fewer than five words are one
shingle; very long texts are read whole; equal rows are copies; an empty table gives none;
extra columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stash, numbered, partitions, stash, texts_of
from .simhash import components, shingle_hashes, stars, trie_links

SHINGLE = 5
LEAST = (4, 5)
TABLES, PREFIX_BITS, BUDGET, WIDE = 64, 16, 20, 35
CROWD, PIVOTS = 512, 8
#: Texts that are handed to Python at once: one may have megabytes.
TEXTS_AT_ONCE = 256
#: Nodes in a file: a task that reads them holds ``TABLES`` rows of each before they are dealt out.
ROWS_A_FILE = 5000
_SEEDS = np.random.default_rng(11).integers(0, 2**63, (TABLES * PREFIX_BITS // 64 + 1, 2), dtype=np.uint64)


def shingle_set(text: str) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, SHINGLE), dtype=np.uint64))


def simhash_bits(shingles: np.ndarray) -> np.ndarray:
    """The SimHash words of a set: first the fingerprint, then those of the prefixes. A bit is
    that of the majority of the shingles, at a tie a fixed one."""
    n, ones = len(shingles), np.zeros(64 * len(_SEEDS), np.int64)
    for at in range(0, n, 255):  # so many ones fit in a byte
        x = shingles[at : at + 255, None] ^ _SEEDS[:, 0]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # SplitMix64's finaliser
            x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
        x ^= x >> np.uint64(31)
        ones += np.unpackbits(x.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    tie = np.unpackbits(_SEEDS[:, 1].copy().view(np.uint8)).astype(bool)
    return np.packbits((2 * ones > n) | ((2 * ones == n) & tie)).view(np.uint64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def sketches(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, id, node, size, fp, words (those of the prefixes)."""
    flat = rows.select(F.col("_row").alias("row"), F.col("doc")[id_col].alias("id"), F.col("doc")[text_col].alias("text"))

    def run(batches):
        for b in batches:
            node, size, fp, words = [], [], [], []
            for t in texts_of(b):
                s = shingle_set(t)
                bits = simhash_bits(s).view(np.int64)
                node.append(_signed(xxhash.xxh3_64_intdigest(s.tobytes())))
                size.append(len(s))
                fp.append(int(bits[0]))
                words.append(bits[1:])
            cols = [b.column("row"), b.column("id"), pa.array(node, pa.int64()), pa.array(size, pa.int32()), pa.array(fp, pa.int64()), pa.array(words, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["row", "id", "node", "size", "fp", "words"])

    return flat.mapInArrow(run, f"row bigint, id {dict(flat.dtypes)['id']}, node bigint, size int, fp bigint, words array<bigint>")


def _near(i, j, size, fp, more) -> np.ndarray:
    """Which of the pairs are within both budgets and may be similar by their sizes."""
    x, y = size[i].astype(np.int64), size[j].astype(np.int64)
    first = np.bitwise_count(fp[i] ^ fp[j])
    ok = (first <= BUDGET) & (first + np.bitwise_count(more[i] ^ more[j]) <= WIDE)
    return ok & (LEAST[1] * np.minimum(x, y) >= LEAST[0] * np.maximum(x, y))


def _trie(key, size, fp, more):
    """(i, j) arrays of the pairs that are near, within each run of equal keys; sorted by key, fp."""
    held, count = [], 0
    for i, j in trie_links(key, fp, BUDGET, leaf=256):
        ok = _near(i, j, size, fp, more)
        if ok.any():
            held.append((i[ok], j[ok]))
            count += len(held[-1][0])
        if count > 1_000_000:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, count = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _crowd(size, fp, more):
    """(i, j) arrays that connect just what all near pairs of one prefix connect; sorted by fp."""
    m, label, every = len(fp), np.arange(len(fp)), np.arange(len(fp))
    for i in range(min(PIVOTS, m)):
        hit = np.flatnonzero(_near(i, every, size, fp, more))
        yield np.full(len(hit), i), hit
        label[np.isin(label, label[hit])] = label[i]
    core = label == np.bincount(label).argmax()
    if 4 * core.sum() < m:
        core[:] = False
    inner, outer = np.flatnonzero(core), np.flatnonzero(~core)
    for i, j in _trie(np.zeros(len(outer), np.int64), size[outer], fp[outer], more[outer]):
        yield outer[i], outer[j]
    if len(inner):
        for i in outer:  # one link to the core will do
            j = inner[_near(i, inner, size, fp, more)][:1]
            yield np.full(len(j), i), j


def bucket_stars(key: np.ndarray, row: np.ndarray, size: np.ndarray, fp: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """u, v: rows that connect just what the near pairs of each run of equal keys connect."""
    order = np.lexsort((fp.view(np.uint64), key))
    key, row, size, fp, more = key[order], row[order], size[order], fp[order].view(np.uint64), more[order].view(np.uint64)
    n = len(key)
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if n else np.empty(0, np.int64)
    many = np.diff(np.append(start, n))
    few = np.flatnonzero(np.repeat(many <= CROWD, many))
    label = np.arange(n)
    label[few] = few[stars(len(few), _trie(key[few], size[few], fp[few], more[few]))]
    for k in np.flatnonzero(many > CROWD):
        s = slice(start[k], start[k] + many[k])
        found = [x for x in _crowd(size[s], fp[s], more[s]) if len(x[0])]
        label[s] = start[k] + stars(many[k], [tuple(np.concatenate(x) for x in zip(*found))])
    # stars around the least rows, as components() has them, are much the same in all tables
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, label, row)
    least = least[label]
    return least[least != row], row[least != row]


def _runs(batches, columns: list[str], least: int):
    """Whole runs of equal first columns, as arrays, from batches sorted by it."""
    held: list[list[np.ndarray]] = []
    count = 0
    for b in batches:
        if b.num_rows:
            held.append([b.column(c).to_numpy(zero_copy_only=False) for c in columns])
            count += b.num_rows
        if count >= least:
            cols = [np.concatenate(c) for c in zip(*held)]
            other = np.flatnonzero(cols[0] != cols[0][-1])
            last = int(other[-1]) + 1 if len(other) else 0
            if last:
                yield [c[:last] for c in cols]
            held, count = [[c[last:] for c in cols]], 0
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _meet(batches):
    for cols in _runs(batches, ["key", "row", "size", "fp", "more"], 200_000):
        u, v = bucket_stars(*cols)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def met(nodes: DataFrame) -> DataFrame:
    """nodes: row (distinct), size, fp, words. Returns u, v as bucket_stars()."""
    at = nodes.where("size > 0").select("row", "size", "fp", "words", F.explode(F.sequence(F.lit(0), F.lit(TABLES - 1))).alias("t"))
    a_word = 64 // PREFIX_BITS
    prefix = f"shiftrightunsigned(get(words, int(t div {a_word})), cast(t % {a_word} * {PREFIX_BITS} as int)) & {(1 << PREFIX_BITS) - 1}"
    more = f"get(words, int((t div {a_word} + {TABLES // a_word // 2}) % {TABLES // a_word}))"  # bits that its prefix has no part in
    keyed = at.selectExpr(f"cast((t << {PREFIX_BITS}) + ({prefix}) as int) as key", "row", "size", "fp", f"{more} as more")
    dealt = keyed.repartition(partitions(nodes.sparkSession), "key").sortWithinPartitions("key", "row")
    return dealt.mapInArrow(_meet, "u bigint, v bigint")


def similar_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Index pairs of similar sets, none of them empty, that connect just what all such pairs connect."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    edge = np.concatenate([[0], np.cumsum(size)])
    terms = np.concatenate(sets)
    label, out = np.arange(m), []

    def link(i, both):
        hit = np.flatnonzero((LEAST[1] * both >= LEAST[0] * (size + size[i] - both)) & (label != label[i]))
        joined, first = np.unique(label[hit], return_index=True)
        out.extend((i, j) for j in hit[first].tolist())
        label[np.isin(label, joined)] = label[i]

    for i in range(min(PIVOTS, m - 1)):
        s = sets[i]
        if (label == label[0]).all() and i:
            return out
        link(i, np.add.reduceat(s[np.minimum(np.searchsorted(s, terms), len(s) - 1)] == terms, edge[:-1], dtype=np.int64))
    rest = [int(i) for i in np.flatnonzero(label != np.bincount(label).argmax()) if i >= PIVOTS]
    if not rest:
        return out
    # the index has the terms of the rest only
    known = np.unique(np.concatenate([sets[i] for i in rest]))
    term = np.searchsorted(known, terms)
    held = np.flatnonzero(known[np.minimum(term, len(known) - 1)] == terms)
    order = np.argsort(term[held], kind="stable")
    owner = np.repeat(np.arange(m), size)[held][order]
    begin = np.concatenate([[0], np.cumsum(np.bincount(term[held], minlength=len(known)))])
    for i in rest:
        t = term[edge[i] : edge[i + 1]]
        n = begin[t + 1] - begin[t]
        at = np.repeat(begin[t] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        link(i, np.bincount(owner[at], minlength=m))
    return out


def _similar(batches):
    """Rows sorted by (root, row); a component is done when the next begins."""
    at, rows, sets = None, [], []

    def done():
        links = similar_links(sets) if len(sets) > 1 else []
        if not links:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        label = stars(len(sets), [tuple(np.array(links).T)])
        own = np.flatnonzero(label != np.arange(len(sets)))
        held = np.array(rows)
        return held[own], held[label[own]]

    def batch(found):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*found)], names=["node", "root"])

    for b in batches:
        found = []
        for root, row, t in zip(b.column("root").to_pylist(), b.column("row").to_pylist(), texts_of(b)):
            if root != at:
                found.append(done())
                at, rows, sets = root, [], []
            rows.append(row)
            sets.append(shingle_set(t))
        if found:
            yield batch(found)
    yield batch([done()])


def only_rows(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Those of ``rows`` whose _row is one of the column ``row`` of ``chosen``. The numbers are told by a
    bitmap of 64 rows a word, so that a table's rows needn't be moved; it has a bit for each row, by
    calculation some 10 MB with its overhead for the rows of 30 GB (not measured)."""
    bit = F.expr("shiftleft(1L, cast(row & 63 as int))")
    words = chosen.groupBy(F.shiftrightunsigned("row", 6).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    told = rows.join(F.broadcast(words), F.shiftrightunsigned("_row", 6) == F.col("_word"))
    return told.where("shiftrightunsigned(_bits, cast(_row & 63 as int)) & 1 = 1").select(rows.columns)


def links(rows: DataFrame, nodes: DataFrame, text_col: str = "text") -> DataFrame:
    """node, root: of each component of similar texts all rows but the first, and that. nodes: row, size, fp, words."""
    stars_ = stash(met(nodes), "met")
    # a row has a centre in each table at most: it and they are linked to the least of them, mostly the same for a group
    low = stars_.groupBy("v").agg(F.collect_set("u").alias("us")).select("v", "us", F.array_min("us").alias("m"))
    few = low.select("m", F.explode(F.array_append("us", F.col("v"))).alias("u")).where("u <> m").select("u", F.col("m").alias("v"))
    # written, as it is read twice
    comp = stash(components(few).select(F.col("node").alias("row"), "root"), "candidates")
    drop_stash(stars_)
    wanted = comp.unionByName(comp.selectExpr("root as row", "root")).distinct()
    texts = only_rows(rows, wanted.select("row")).select(F.col("_row").alias("row"), F.col("doc")[text_col].alias("text"))
    named = texts.join(wanted.hint("merge"), "row")
    dealt = named.repartition(partitions(rows.sparkSession), "root").sortWithinPartitions("root", "row")
    conf, name = rows.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, str(TEXTS_AT_ONCE))
    try:
        found = stash(dealt.select("root", "row", "text").mapInArrow(_similar, "node bigint, root bigint"), "links")
    finally:
        conf.set(name, before)
    drop_stash(comp)
    return found


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, less all but one of each component."""
    rows = numbered(docs, "rows")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best")
    found = sketches(rows, id_col, text_col).groupBy("node").agg(best, F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("words").alias("words"))
    nodes = stash(found.select("best", "best.row", "size", "fp", "words"), "nodes", ROWS_A_FILE)
    comp = links(rows, nodes, text_col)
    rooted = nodes.join(comp.hint("merge"), nodes.row == comp.node, "left").select(F.coalesce("root", nodes.row).alias("root"), "best")
    kept = stash(rooted.groupBy("root").agg(F.min("best").alias("best")).select("best.row"), "kept")
    drop_stash(nodes)
    drop_stash(comp)
    return only_rows(rows, kept).select("doc.*")
