"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained in numpy.

A word's vector is the mean of the embeddings of its hashed character 3- to 5-grams
(with word marks) and of the whole word; a passage of ``SPAN`` words is the mean of
its words' vectors; a linear softmax over two classes reads it. Embeddings and softmax
are trained jointly: first on means of whole texts, then on the passage of each text
that the model finds worst (the label says that a text has such a passage, not
where), so long texts do not thin the evidence. A text's score is that of its worst
passage, calibrated to the labels' shares. An unseen misspelling shares most of its
n-gram vectors with the word it comes from. A run of over ``LONG`` characters without white
space counts as overlapping stretches of ``STRETCH``, each a word of its own, so all of it is read.

Defined cases: null and empty texts have no words and get the score of the model's
bias; with one class only (or no labels) the score is 0 for all; repeated and tied rows
are scored alike, a score that ties with the threshold is predicted 1; very long texts are
read whole; an empty table gives no rows; unlabelled rows and null ids are scored, not learnt from; extra
columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Cache, fold_is, hash_share, table, texts_of

BUCKETS = 1 << 16
DIM = 8
SPAN = 2
LONG, STRETCH = 60, 24
#: At most about so many labelled rows of each class are learnt from.
MAX_ROWS_PER_CLASS = 1200
_STRIP = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


def words_of(text: str) -> list[str]:
    """Words between white space, long ones as their stretches."""
    out = []
    for w in text.lower().split():
        if len(w) > LONG:
            out += [w[i : i + STRETCH] for i in range(0, len(w) - STRETCH // 2, STRETCH // 2)]
        else:
            out.append(w)
    return out


def subwords(word: str) -> np.ndarray:
    """Hash buckets of the word's n-grams and of itself."""
    core = word.strip(_STRIP) or word
    marked = f"<{core}>"
    grams = {marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)}
    grams.add(f"={core}")
    return np.array(sorted(zlib.crc32(g.encode("utf-8", "replace")) & (BUCKETS - 1) for g in grams), dtype=np.int32)


def worst_span(values: np.ndarray) -> tuple[float, int]:
    """The largest mean over ``SPAN`` consecutive values (fewer: over all), and its start."""
    if len(values) <= SPAN:
        return (float(values.mean()) if len(values) else 0.0), 0
    c = np.concatenate([[0.0], np.cumsum(values)])
    m = c[SPAN:] - c[:-SPAN]
    i = int(m.argmax())
    return float(m[i]) / SPAN, i


@dataclass
class SubwordModel:
    slope: np.ndarray  # of each bucket: its embedding times the difference of the softmax's rows
    bias: float
    scale: float
    shift: float
    length: float

    def raw(self, values: np.ndarray) -> float:
        return worst_span(values)[0] + self.bias

    def score(self, values: np.ndarray) -> float:
        z = self.scale * self.raw(values) + self.length * np.log1p(len(values)) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def fit(texts: list[list[str]], y: np.ndarray, share: float, mean_epochs: int = 2, span_epochs: int = 20) -> SubwordModel | None:
    """``share``: share of class 1 among all labelled rows, for the calibration."""
    if len(set(y.tolist())) < 2:
        return None
    rng = np.random.default_rng(5)
    index: dict[str, int] = {}
    docs = [np.array([index.setdefault(w, len(index)) for w in t], dtype=np.int64) for t in texts]
    subs = [subwords(w) for w in index]
    size = np.array([len(s) for s in subs], dtype=np.int64)
    flat = np.concatenate(subs) if subs else np.empty(0, np.int32)
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    emb = rng.normal(0, 0.1, (BUCKETS, DIM))
    soft, bias = rng.normal(0, 0.3, (2, DIM)), np.zeros(2)
    emb2, soft2, bias2 = np.full(BUCKETS, 1e-4), np.full((2, DIM), 1e-4), np.full(2, 1e-4)
    hold = rng.random(len(docs)) < 0.2
    each = np.where(y == 1, 1 / max(1, (y == 1).sum()), 1 / max(1, (y == 0).sum()))
    each = each / each.mean()

    def step(bags: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, rate: float) -> None:
        words, back = np.unique(np.concatenate(bags), return_inverse=True)
        own = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
        n = np.maximum(1, np.array([len(b) for b in bags]))
        at = np.repeat(start[words] - np.concatenate([[0], np.cumsum(size[words])[:-1]]), size[words]) + np.arange(size[words].sum())
        ids, of = flat[at], np.repeat(np.arange(len(words)), size[words])
        vec = np.add.reduceat(emb[ids], np.concatenate([[0], np.cumsum(size[words])[:-1]]), axis=0) / size[words][:, None]
        hidden = np.zeros((len(bags), DIM))
        np.add.at(hidden, own, vec[back])
        hidden /= n[:, None]
        logit = hidden @ soft.T + bias
        p = np.exp(logit - logit.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        err = (np.eye(2)[labels] - p) * (weight / len(bags))[:, None]
        d_soft, d_bias, d_hidden = err.T @ hidden, err.sum(0), err @ soft / n[:, None]
        d_vec = np.zeros((len(words), DIM))
        np.add.at(d_vec, back, d_hidden[own])
        d_vec /= size[words][:, None]
        hit, inv = np.unique(ids, return_inverse=True)
        g = np.stack([np.bincount(inv, d_vec[of, k], minlength=len(hit)) for k in range(DIM)], 1)
        emb2[hit] += (g**2).mean(1)
        emb[hit] += rate * g / np.sqrt(emb2[hit])[:, None]
        soft2[:] += d_soft**2
        soft[:] += rate * d_soft / np.sqrt(soft2)
        bias2[:] += d_bias**2
        bias[:] += rate * d_bias / np.sqrt(bias2)

    def values() -> np.ndarray:
        slope = emb @ (soft[1] - soft[0])
        return np.add.reduceat(slope[flat], start) / size if len(size) else np.empty(0)

    known = np.flatnonzero(~hold & np.array([len(d) > 0 for d in docs]))
    for epoch in range(mean_epochs):
        for pick in np.array_split(rng.permutation(known), max(1, len(known) // 32)):
            if len(pick):
                step([np.unique(docs[i]) for i in pick], y[pick], each[pick], 0.2)
    for epoch in range(span_epochs):
        v = values()
        bags, labels, weight = [], [], []
        for i in known:
            d = docs[i]
            at = worst_span(v[d])[1]
            bags.append(d[at : at + SPAN])
            labels.append(y[i])
            weight.append(each[i])
            if y[i] == 0:
                r = int(rng.integers(0, max(1, len(d) - SPAN)))
                bags.append(d[r : r + SPAN])
                labels.append(0)
                weight.append(each[i])
        labels, weight = np.array(labels), np.array(weight)
        for pick in np.array_split(rng.permutation(len(bags)), max(1, len(bags) // 64)):
            if len(pick):
                step([bags[i] for i in pick], labels[pick], weight[pick], 0.1)
    v = values()
    model = SubwordModel((emb @ (soft[1] - soft[0])).astype(np.float64), float(bias[1] - bias[0]), 1.0, 0.0, 0.0)
    # calibration on rows that were not trained on, at the labels' true shares
    cal = np.flatnonzero(hold) if hold.any() and len(set(y[hold].tolist())) == 2 else np.arange(len(docs))
    x = np.stack([np.array([model.raw(v[docs[i]]) for i in cal]), np.array([np.log1p(len(docs[i])) for i in cal]), np.ones(len(cal))], 1)
    yc = y[cal]
    wc = np.where(yc == 1, share / max(1, (yc == 1).sum()), (1 - share) / max(1, (yc == 0).sum()))
    a = np.zeros(3)
    for _ in range(30):  # Newton's steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ a, -35, 35)))
        h = (x * (wc * p * (1 - p))[:, None]).T @ x + np.diag([1e-4, 1e-3, 1e-6])
        a += np.linalg.solve(h, x.T @ (wc * (yc - p)) - np.array([1e-4, 1e-3, 1e-6]) * a)
    model.scale, model.length, model.shift = float(max(a[0], 1e-3)), float(a[1]), float(a[2])
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows_per_class: int = MAX_ROWS_PER_CLASS) -> SubwordModel | None:
    """Fits on a fixed hash sample of about ``max_rows_per_class`` labelled rows of
    each class (at most 1.2 times as many), whole texts."""
    rated = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    counts = {r["y"]: r["n"] for r in rated.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    pick = F.lit(False)
    for c, n in counts.items():
        pick = pick | ((F.col("y") == c) & hash_share("id", max_rows_per_class / n, 13))
    sample = rated.where(pick).limit(int(2.4 * max_rows_per_class))
    got = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").select("y", F.coalesce("text", F.lit("")).alias("text")).collect()
    got = sorted((r["y"], r["text"]) for r in got)
    return fit([words_of(t) for _, t in got], np.array([y for y, _ in got], dtype=np.int64), counts[1] / (counts[0] + counts[1]))


def score_documents(docs: DataFrame, model: SubwordModel | None, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1), predicted (1 if score >= threshold)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number a bucket, whatever the input
    flat = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        m = shared.value
        if m:
            cache = Cache(lambda w: float(m.slope[subwords(w)].mean()), 400_000)
        for b in batches:
            scores = []
            for t in texts_of(b):
                w = words_of(t)
                scores.append(m.score(np.fromiter(map(cache.__getitem__, w), float, len(w))) if m else 0.0)
                if m:
                    cache.trim()
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=["id", "score", "predicted"])

    kind = dict(flat.dtypes)["id"]
    return flat.mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def op2_toxicity_subword(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~fold_is("doc_id", 4, 2))
    scored = score_documents(docs, train(docs, labels))
    return scored.select("doc_id", fold_is("doc_id", 4, 2).alias("held_out"), "score", "predicted")
