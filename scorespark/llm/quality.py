"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight per hashed feature is shared by all grades; ordered thresholds cut the
score line: P(grade >= k) = sigmoid(w.x - theta_k), theta_1 < theta_2 < ... The model
gives the expected grade and the tail probability that selection uses.

Defined cases: null and empty texts have only the shape features of an empty text;
rows without a rating are not learnt from; with fewer than two grades among the
ratings every document gets tail probability 1 (nothing is rejected); repeated rows
are scored alike, also where ids are null or repeated; very long texts are read whole; scores that tie
with the threshold are selected; an empty table gives no rows; extra columns are kept by ``select_documents`` and ignored by
``score_documents``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_is, hash_share, stash, table, texts_of

BITS = 15
SHAPES = 64  # the last slots, for shape features
SLOTS = (1 << BITS) + SHAPES
#: At most about so many rated rows of each grade are learnt from.
MAX_ROWS_PER_GRADE = 3000


def shape_features(text: str) -> list[int]:
    """Slots for repetition, case, symbols and length, each in eight steps."""
    words = text.split()
    n = len(words)
    step = lambda x: min(7, int(x * 8))
    twice = sum(map(str.__eq__, words, words[1:])) / max(1, n - 1)
    distinct = len(set(words)) / max(1, n)
    dense = min(1.0, distinct * max(1.0, n / 200) ** 0.4)
    upper = sum(map(str.isupper, words)) / max(1, n)
    plain = sum(map(str.isalpha, words)) / max(1, n)
    size = min(7, n.bit_length() // 2)
    base = 1 << BITS
    return [base + 8 * i + s for i, s in enumerate((step(twice), step(distinct), step(dense), step(upper), step(plain), size))]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots and weights: square roots of the shares of hashed byte 1- to 4-grams of
    the whole text, and the shape slots."""
    b = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
    parts, h = [], np.zeros(len(b), np.uint32)
    for n in range(1, 5):
        if len(b) < n:
            break
        h = (h[: len(b) - n + 1] * np.uint32(0x01000193)) ^ (b[n - 1 :] + np.uint32(n << 9))
        parts.append((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS))
    if parts:
        counts = np.bincount(np.concatenate(parts), minlength=1 << BITS)
        slots = np.flatnonzero(counts)
        values = np.sqrt(counts[slots] / counts.sum())
    else:
        slots, values = np.empty(0, np.int64), np.empty(0)
    shape = shape_features(text)
    return np.concatenate([slots, shape]), np.concatenate([values, np.full(len(shape), 0.5)])


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one less than there are grades

    def tails(self, text: str) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        slots, values = features(text)
        return _sigmoid(self.weights[slots] @ values - self.thresholds)


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, weight: np.ndarray, epochs: int = 8, rate: float = 0.3, l2: float = 1e-6) -> OrdinalModel | None:
    """Maximum likelihood of the proportional-odds model by AdaGrad, in mini-batches.
    Order of the thresholds holds by construction: each is the one before plus exp(d)."""
    k = int(grades.max()) + 1 if len(grades) else 0
    if len(set(grades.tolist())) < 2:
        return None
    rng = np.random.default_rng(7)
    w, g2 = np.zeros(SLOTS), np.full(SLOTS, 1e-3)
    raw = np.concatenate([[-1.0], np.zeros(k - 2)])
    raw2 = np.full(k - 1, 1e-3)
    weight = weight / weight.mean()
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 32):
            pick = order[at : at + 32]
            slots = np.concatenate([rows[i][0] for i in pick]).astype(np.int64)
            values = np.concatenate([rows[i][1] for i in pick])
            own = np.repeat(np.arange(len(pick)), [len(rows[i][0]) for i in pick])
            s = np.bincount(own, w[slots] * values, minlength=len(pick))
            theta = np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))
            edges = np.concatenate([[-np.inf], theta, [np.inf]])
            y = grades[pick]
            hi, lo = _sigmoid(edges[y + 1] - s), _sigmoid(edges[y] - s)
            hi, lo = np.where(y == k - 1, 1.0, hi), np.where(y == 0, 0.0, lo)
            mass = np.maximum(hi - lo, 1e-9)
            ds = (hi + lo - 1) * weight[pick] / len(pick)
            d_hi, d_lo = hi * (1 - hi) / mass * weight[pick] / len(pick), -lo * (1 - lo) / mass * weight[pick] / len(pick)
            dtheta = np.bincount(y, d_hi, minlength=k)[: k - 1] + np.bincount(np.maximum(y - 1, 0), np.where(y > 0, d_lo, 0), minlength=k)[: k - 1]
            dtail = np.cumsum(dtheta[::-1])[::-1]
            draw = dtail * np.concatenate([[1.0], np.exp(raw[1:])])
            g = np.bincount(slots, values * ds[own], minlength=SLOTS)
            hit = np.flatnonzero(g)
            step = g[hit] - l2 * w[hit]
            g2[hit] += step**2
            w[hit] += rate * step / np.sqrt(g2[hit])
            raw2 += draw**2
            raw += 0.1 * draw / np.sqrt(raw2)
    return OrdinalModel(w, np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])])))


def train(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", max_rows_per_grade: int = MAX_ROWS_PER_GRADE) -> OrdinalModel | None:
    """Fits on a fixed hash sample of about ``max_rows_per_grade`` rated rows of each
    grade (at most 1.2 times as many), weighted back to the grades' true shares."""
    spark = docs.sparkSession
    rated = ratings.select(F.col(id_col).alias("id"), F.col(grade_col).cast("int").alias("grade")).where("id is not null and grade is not null and grade >= 0")
    counts = {r["grade"]: r["n"] for r in rated.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    pick = F.lit(False)
    for g, n in counts.items():
        pick = pick | ((F.col("grade") == g) & hash_share("id", max_rows_per_grade / n, 11))
    sample = rated.where(pick).limit(int(1.2 * max_rows_per_grade * len(counts)))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def extract(batches):
        for b in batches:
            made = [features(t) for t in texts_of(b)]
            yield pa.RecordBatch.from_arrays(
                [b.column("grade"), pa.array([s.astype("<u2").tobytes() for s, _ in made], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in made], pa.binary())],
                names=["grade", "slots", "vals"],
            )

    made = stash(texts.join(F.broadcast(sample), "id").mapInArrow(extract, "grade int, slots binary, vals binary"), "quality-sample")
    # part by part, so that the driver's JVM never holds the whole sample
    got = sorted(made.toLocalIterator(), key=lambda r: (r["grade"], bytes(r["slots"])))
    rows = [(np.frombuffer(r["slots"], "<u2"), np.frombuffer(r["vals"], "<f4")) for r in got]
    grades = np.array([r["grade"] for r in got], dtype=np.int64)
    seen = np.bincount(grades, minlength=max(counts) + 1) if len(grades) else np.zeros(1)
    weight = np.array([counts[g] / seen[g] for g in grades])
    return fit_ordinal(rows, grades, weight)


def _scores(model, texts: list[str]) -> tuple[list[float], list[float]]:
    """Expected grade and P(grade >= 1) of each text."""
    expected, tail = [], []
    for t in texts:
        p = model.tails(t) if model else np.ones(1)
        expected.append(float(p.sum()))
        tail.append(float(p[0]))
    return expected, tail


def score_documents(docs: DataFrame, model: OrdinalModel | None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, expected_grade, p_tail = P(grade >= 1), selected = p_tail >= threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**15 weights, whatever the input
    flat = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for b in batches:
            expected, tail = _scores(shared.value, texts_of(b))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(expected, pa.float64()), pa.array(tail, pa.float64()), pa.array([x >= threshold for x in tail], pa.bool_())], names=["id", "expected_grade", "p_tail", "selected"])

    kind = dict(flat.dtypes)["id"]
    return flat.mapInArrow(run, f"id {kind}, expected_grade double, p_tail double, selected boolean").withColumnRenamed("id", id_col)


def select_documents(docs: DataFrame, model: OrdinalModel | None, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that the model selects."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([x >= threshold for x in _scores(shared.value, texts_of(b, text_col))[1]], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def grades_of(labels: DataFrame) -> DataFrame:
    """Graded ratings from the two labels: 0 poor, 1 usable but toxic, 2 good."""
    grade: Column = F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade"))


def train_on_labels(spark: SparkSession, docs: DataFrame, sf_dir: str) -> OrdinalModel | None:
    """Learns from rows whose crc32(doc_id as text) mod 5 is not 0; the rest is held out."""
    return train(docs, grades_of(table(spark, sf_dir, "labels")).where(~fold_is("doc_id", 5, 0)))


def op1_quality_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, train_on_labels(spark, docs, sf_dir))
    return scored.withColumn("held_out", fold_is("doc_id", 5, 0))
