"""Document fingerprints: bottom-k sketches of word shingle hashes.

A sketch holds the ``k`` smallest distinct 48-bit hashes of a text's shingles of five
words (case folded; fewer words: one shingle of all of them; none: an empty sketch).
Sketches merge exactly: the sketch of a union is the bottom k of the sketches' union.
They estimate resemblance, containment and the number of distinct shingles; with at
most k shingles all three are exact.

Defined cases: null text is empty; two empty sketches resemble each other fully, an
empty and another not at all; equal texts have equal fingerprints; a very long text is
read whole, as one row; ids may be numbers, texts or dates; rows of equal id are
ordered by their texts (by the texts' hashes where one id has several tasks' worth of
rows); null ids come first; the next of the last document is the first, of an only one
itself; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Cache, partitions, table, texts_of, with_range_bucket

K = 128
WORDS = 5
_MASK = np.uint64((1 << 48) - 1)


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))


def sketch(text: str, hashes=None, k: int = K) -> np.ndarray:
    """Sorted bottom-k hashes of the whole text. hashes: a cache of word hashes."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__ if hashes is not None else word_hash, words), np.uint64, len(words))
    n = max(1, len(h) - WORDS + 1)
    acc = np.zeros(n, np.uint64)
    for j in range(min(WORDS, len(h))):
        acc = (acc ^ h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(29)
    acc *= np.uint64(0xBF58476D1CE4E5B9)
    acc ^= acc >> np.uint64(32)
    return np.unique(acc & _MASK)[:k]


def encode(s: np.ndarray) -> str:
    """48-bit hashes in ascending order, six bytes each, in base64."""
    return base64.b64encode(s.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode("ascii")


def decode(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 2:] = raw
    return wide.reshape(-1).view(">u8").astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.unique(np.concatenate([a, b]))[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimate of the Jaccard similarity of the shingle sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = merge(a, b, k)
    return float(np.isin(np.intersect1d(a, b, assume_unique=True), both, assume_unique=True).sum() / len(both))


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimate of the number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / 2.0**48)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimate of the share of a's shingles that b has; 1 for an empty a."""
    if not len(a):
        return 1.0
    n = resemblance(a, b, k) * distinct(merge(a, b, k), k)
    return float(min(1.0, n / max(1.0, distinct(a, k))))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint, n_shingles (estimate), one row for each of ``docs``."""
    flat = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        hashes = Cache(word_hash)
        for b in batches:
            made = []
            for t in texts_of(b):
                made.append(sketch(t, hashes))
                hashes.trim()
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(map(encode, made), pa.string()), pa.array([distinct(s) for s in made], pa.float64())], names=["id", "fingerprint", "n_shingles"])

    kind = dict(flat.dtypes)["id"]
    return flat.mapInArrow(run, f"id {kind}, fingerprint string, n_shingles double").withColumnRenamed("id", id_col)


def merge_fingerprints(prints: DataFrame, key: str, col: str = "fingerprint") -> DataFrame:
    """key, fingerprint of all texts of that key, n_shingles. Each task first merges its
    own rows of a key, so a hot key sends one sketch a task and no more."""
    flat = prints.select(F.col(key).cast("string").alias("key"), F.col(col).alias("fp"))

    def partial(batches):
        held: dict = {}
        for b in batches:
            for k, f in zip(b.column("key").to_pylist(), b.column("fp").to_pylist()):
                s = decode(f or "")
                held[k] = merge(held[k], s) if k in held else s
            if len(held) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array(map(encode, held.values()), pa.string())], names=["key", "fp"])
                held = {}
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array(map(encode, held.values()), pa.string())], names=["key", "fp"])

    def final(t: pa.Table) -> pa.Table:
        s = np.empty(0, np.uint64)
        for f in t.column("fp").to_pylist():
            s = merge(s, decode(f))
        return pa.table({"key": pa.array([t.column("key")[0].as_py()], pa.string()), "fingerprint": [encode(s)], "n_shingles": [distinct(s)]})

    return flat.mapInArrow(partial, "key string, fp string").groupBy("key").applyInArrow(final, "key string, fingerprint string, n_shingles double").withColumnRenamed("key", key)


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, bucket, tail: sorted by id within buckets, and buckets within
    partitions, four to each. The row after a bucket's last one (tail = 1) follows it, so
    that every document meets its successor in one pass and one shuffle."""
    spark = docs.sparkSession
    flat = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed, n_buckets = with_range_bucket(flat, "id", 4 * partitions(spark))
    least = F.min(F.struct(F.col("id").isNotNull().alias("some"), "id", "_order")).alias("least")
    firsts = sorted(keyed.groupBy("bucket").agg(least).collect(), key=lambda r: r["bucket"])
    schema = f"fid {dict(flat.dtypes)['id']}, forder bigint, to int"
    rows = [(r["least"]["id"], r["least"]["_order"], firsts[i - 1]["bucket"]) for i, r in enumerate(firsts)]
    heads = F.broadcast(spark.createDataFrame(rows, schema))  # one row a bucket
    spread = keyed.join(heads, F.col("id").eqNullSafe(F.col("fid")) & (F.col("_order") == F.col("forder")), "left")
    here = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("tail"))
    there = F.struct(F.col("to").alias("bucket"), F.lit(1).alias("tail"))
    placed = spread.withColumn("place", F.explode(F.when(F.col("to").isNull(), F.array(here)).otherwise(F.array(here, there))))
    return (
        placed.select("id", "text", "_order", "place.bucket", "place.tail", F.shiftright("place.bucket", 2).alias("task"))
        .repartitionById(-(-n_buckets // 4), "task")
        .sortWithinPartitions("bucket", "tail", "id", "_order", "text")
    )


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text (the last quarter replaced by the
    start of the next document), and the likeness of the first to the second and to
    the next document's."""
    spread = with_next(docs, id_col, text_col)
    kind = dict(spread.dtypes)["id"]

    def run(batches):
        hashes = Cache(word_hash)
        ids, cols, prev = [], [], None
        for b in batches:
            for i, t, bucket, tail in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), b.column("bucket").to_pylist(), b.column("tail").to_pylist()):
                if prev and prev[3] == bucket and (not prev[4]):
                    pid, pt, ps = prev[:3]
                    s = sketch(t, hashes)
                    n = len(pt)
                    edited = pt[: n - n // 4] + t[: n // 4]
                    es = sketch(edited, hashes)
                    ids.append(pid)
                    cols.append((n, hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), encode(ps), encode(es), resemblance(ps, es), resemblance(ps, s)))
                else:
                    s = sketch(t, hashes)
                prev = (i, t, s, bucket, tail)
                hashes.trim()
            yield _rows(ids, cols, b.schema.field("id").type)
            ids, cols = [], []

    return spread.mapInArrow(run, f"id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumnRenamed("id", id_col)


def _rows(ids: list, cols: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return pa.RecordBatch.from_arrays([pa.array(ids, kind), *(pa.array([c[j] for c in cols], t) for j, t in enumerate(types))], names=names)


def op3_fingerprint_bottomk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(table(spark, sf_dir, "documents"))
