"""SimHash near-duplicates by a binary-trie self-join.

Fingerprint: of all 3-word shingles (repeats included) of the ASCII-lower-cased text, 64
bits, each set where over half of the shingles' XXH64 (seed 42) have it set.

Join: two fingerprints within ``MAX_BITS`` = 2 of each other agree in two of four 16-bit
blocks, so the distinct fingerprints are dealt to six groupings by a pair of blocks. In
each group the sorted fingerprints are a binary trie (a node is a range). Node pairs are
traversed together from the root pair down, adding up differing bits; a pair beyond the
budget is dropped with all below it; small node pairs are finished by XOR. All groups of
a task are traversed at once, level by level, in numpy. A group emits a spanning star of
each of its components, never all pairs.

The trie of a group of more than ``HOT`` fingerprints is not held by one task. Its first levels
are traversed by the plan: the next ``STEP`` bits name its nodes, and each pair of nodes whose
bits differ within the budget, also of a node with itself, becomes a group of its own, with what
is left of the budget; node pairs beyond it are never made. That is repeated with the bits after
them until every group is small or all bits are used, when it holds two fingerprints at most.

Components: large-star and small-star rounds over the links, checkpointed each.

Defined cases: null and empty texts have fingerprint zero and link like others; fewer
than three words are one shingle; very long texts are read whole; texts of one fingerprint are one
node, however many; a null id takes part but names a component only where
no other id does (then null); repeated rows each get a row; an empty table gives none;
extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, partitions, stash, table, texts_of

MAX_BITS = 2
HOT = 4096
STEP = 8
_PAIRS = list(combinations(range(4), 2))


def shingle_hashes(text: str, n: int = 3, seed: int = 42) -> list[int]:
    """bytes.lower() and bytes.split() touch ASCII only, as wanted."""
    w = text.encode("utf-8", "replace").lower().split()
    if not w:
        return []
    h = xxhash.xxh64_intdigest
    if len(w) < n:
        return [h(b" ".join(w), seed)]
    join = b" ".join
    return [h(join(s), seed) for s in zip(*(w[i:] for i in range(n)))]


def fingerprint(text: str) -> int:
    h = shingle_hashes(text)
    if not h:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = np.array(h[at : at + (1 << 16)], dtype=">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (the 64 bits as a signed long)."""
    flat = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t) for t in texts_of(b)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fp, pa.int64())], names=["id", "fp"])

    return flat.mapInArrow(run, f"id {dict(flat.dtypes)['id']}, fp bigint")


def trie_links(group: np.ndarray, fp: np.ndarray, budget: int = MAX_BITS, leaf: int = 16, chunk: int = 400_000):
    """Yields (i, j) index arrays of all pairs within the budget, within each group.
    group, fp (uint64): sorted by both, no repeats."""
    n = len(fp)
    if n < 2:
        return
    starts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1])
    ends = np.append(starts[1:], n)
    some = ends - starts > 1
    a = starts[some]
    stack = [(63, a, ends[some], a, ends[some], np.zeros(len(a), np.int8))]
    while stack:
        bit, al, ah, bl, bh, err = stack.pop()
        if len(al) > chunk:
            half = len(al) // 2
            stack += [(bit, *(x[s] for x in (al, ah, bl, bh, err))) for s in (slice(half), slice(half, None))]
            continue
        same = (al == bl) & (ah == bh)
        done = ((ah - al) * (bh - bl) <= leaf) | (bit < 0)
        if done.any():
            yield from _finish(fp, *(x[done] for x in (al, ah, bl, bh)), budget)
        go = ~done
        if not go.any():
            continue
        al, ah, bl, bh, err, same = (x[go] for x in (al, ah, bl, bh, err, same))
        ones = np.concatenate([[0], np.cumsum((fp >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)]) if len(al) > n // 64 else None
        am, bm = _split(fp, ones, bit, al, ah), _split(fp, ones, bit, bl, bh)
        out = []
        for xl, xh, yl, yh, e, only in ((al, am, bl, bm, err, None), (am, ah, bm, bh, err, None), (al, am, bm, bh, err + 1, None), (am, ah, bl, bm, err + 1, ~same)):
            ok = (xh > xl) & (yh > yl) & (e <= budget) & ~((xl == yl) & (xh - xl == 1) & (yh - yl == 1))
            if only is not None:
                ok &= only
            out.append(tuple(v[ok] for v in (xl, xh, yl, yh, e)))
        nxt = [np.concatenate(v) for v in zip(*out)]
        if len(nxt[0]):
            stack.append((bit - 1, *nxt))


def _split(fp, ones, bit, lo, hi):
    """Where a node's ones begin: its members share all higher bits and are sorted."""
    if ones is not None:
        return hi - (ones[hi] - ones[lo])
    first = fp[lo]
    mark = ((first >> np.uint64(bit)) | np.uint64(1)) << np.uint64(bit)
    l, h = lo.copy(), hi.copy()
    while True:
        open_ = l < h
        if not open_.any():
            return l
        mid = (l + h) // 2
        less = open_ & (fp[np.minimum(mid, len(fp) - 1)] < mark)
        l = np.where(less, mid + 1, l)
        h = np.where(open_ & ~less, mid, h)


def _finish(fp, al, ah, bl, bh, budget):
    """Pairs of small node pairs, by XOR, in bounded portions."""
    na, nb = ah - al, bh - bl
    total = na * nb
    edges = np.concatenate([[0], np.cumsum(total)])
    at = 0
    while at < len(al):
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + 1_000_000, side="right")) - 1)
        t = total[at:to]
        k = np.arange(t.sum()) - np.repeat(edges[at:to] - edges[at], t)
        i = np.repeat(al[at:to], t) + k // np.repeat(nb[at:to], t)
        j = np.repeat(bl[at:to], t) + k % np.repeat(nb[at:to], t)
        ok = i < j
        ok &= np.bitwise_count(fp[i] ^ fp[j]) <= budget
        if ok.any():
            yield i[ok], j[ok]
        at = to


def stars(n: int, links) -> np.ndarray:
    """Smallest index of each index's component, links being (i, j) array pairs."""
    label = np.arange(n)
    for i, j in links:
        while True:
            lo = np.minimum(label[i], label[j])
            if (label[i] == lo).all() and (label[j] == lo).all():
                break
            np.minimum.at(label, label[i], lo)
            np.minimum.at(label, label[j], lo)
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
    while not (label[label] == label).all():
        label = label[label]
    return label


def _trie_stars(batches):
    """Rows sorted by (grp, fp); groups are finished when the next begins. Groups that share a
    number by chance are one, which costs time and finds nothing wrong."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush(key, fp):
        order = np.lexsort((fp.view(np.uint64), key))  # Spark sorts them as signed
        g, f = key[order], fp.view(np.uint64)[order]
        label = stars(len(f), trie_links(g, f))
        own = np.flatnonzero(label != np.arange(len(f)))
        return pa.RecordBatch.from_arrays([pa.array(f[own].view(np.int64), pa.int64()), pa.array(f[label[own]].view(np.int64), pa.int64())], names=["u", "v"])

    for b in batches:
        if not b.num_rows:
            continue
        held.append(tuple(b.column(c).to_numpy(zero_copy_only=False) for c in ("grp", "fp")))
        size += b.num_rows
        if size >= 100_000:
            key, fp = (np.concatenate(x) for x in zip(*held))
            other = np.flatnonzero(key != key[-1])
            last = int(other[-1]) + 1 if len(other) else 0
            if last:
                yield flush(key[:last], fp[:last])
            held, size = [(key[last:], fp[last:])], len(key) - last
    if size:
        yield flush(*(np.concatenate(x) for x in zip(*held)))


def split_groups(rows: DataFrame, depth: int) -> DataFrame:
    """rows: fp, combo, grp, budget. Each group becomes its node pairs by the depth-th ``STEP``
    bits of the blocks that its fingerprints needn't share."""
    shifts = [[48 - 16 * i + s for i in range(4) if i not in pair for s in (8, 0)][depth] for pair in _PAIRS]
    node = F.expr(f"shiftrightunsigned(fp, get(array({', '.join(map(str, shifts))}), combo))").bitwiseAND(F.lit((1 << STEP) - 1))
    masks = [0, *(1 << i for i in range(STEP)), *(1 << i | 1 << j for i, j in combinations(range(STEP), 2))]
    pairs = F.array(*(F.struct(F.lit(m).cast("long").alias("m"), F.lit(m.bit_count()).alias("bits")) for m in masks))
    met = rows.withColumn("node", node).select("*", F.explode(F.filter(pairs, lambda p: p["bits"] <= F.col("budget"))).alias("p"))
    return met.select("fp", "combo", F.xxhash64("grp", F.least("node", F.col("node").bitwiseXOR(F.col("p.m"))), "p.m").alias("grp"), (F.col("budget") - F.col("p.bits")).alias("budget"))


def link_stars(nodes: DataFrame, hot: int = HOT) -> DataFrame:
    """nodes: fp, distinct. Returns u, v: links that connect just what pairs within two
    bits connect."""
    spark = nodes.sparkSession
    n = partitions(spark)
    part = lambda i: F.shiftrightunsigned("fp", 48 - 16 * i).bitwiseAND(F.lit(0xFFFF))
    keys = F.array(*(F.struct(F.lit(c).alias("combo"), F.xxhash64(F.lit(c), part(i), part(j)).alias("grp")) for c, (i, j) in enumerate(_PAIRS)))
    todo = nodes.select("fp", F.explode(keys).alias("k")).select("fp", "k.combo", "k.grp", F.lit(MAX_BITS).alias("budget"))
    found, depth = None, 0
    while True:
        sizes = cut(todo.groupBy("grp").agg(F.count("*").alias("size")).where("size > 1"))
        last = depth == 32 // STEP
        small = todo.join(sizes if last else sizes.where(F.col("size") <= hot), "grp").select("grp", "fp").distinct()
        # dealt by the group's number, which is a hash: a join before doesn't undo it
        dealt = small.withColumn("task", F.pmod("grp", F.lit(n)).cast("int")).repartitionById(n, "task").drop("task")
        tried = dealt.sortWithinPartitions("grp", "fp").mapInArrow(_trie_stars, "u bigint, v bigint")
        found = tried if found is None else found.unionByName(tried)
        large = sizes.where(F.col("size") > hot).select("grp")
        if last or large.isEmpty():
            return found.distinct()
        todo, depth = stash(split_groups(todo.join(large, "grp", "left_semi"), depth), "trie-node-pairs"), depth + 1


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the smallest node of its component) for every node of a link, by
    alternating large-star and small-star. Degrees don't matter: minima are taken
    with partial aggregation and joined back."""
    edges = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = cut(small)
        now = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if (now["n"], now["x"]) == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = (now["n"], now["x"])
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """id, fingerprint (hex), component_id, one row for each of ``docs``."""
    fps = stash(fingerprints(docs, id_col, text_col), "simhash")
    nodes = stash(fps.groupBy("fp").agg(F.min("id").alias("rep")), "simhash-nodes")
    comp = components(link_stars(nodes.select("fp"), hot))
    rooted = nodes.join(comp, nodes.fp == comp.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
