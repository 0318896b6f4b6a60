"""Language identification by multilingual mixture inference.

Learnt: for each language the smoothed frequencies of hashed byte n-grams (n = 1..4,
case folded) over a bounded sample. A text is cut into runs of ``RUN`` n-grams; each run
has a likelihood under each language. Expectation-maximisation estimates the
proportions in which the languages mix in the text. Sets of 1, 2, ... up to all languages, taken
in order of those proportions, are compared by penalised likelihood (each language
costs ``PENALTY * log(runs)``; larger sets are left out only where no likelihood could make
up for that), and the proportions within the chosen set are returned; the largest names the text.

Defined cases: a text that is null or has no letter is ``und`` with score 0; so is every
text if nothing was learnt; equal proportions go to the language first in
alphabetical order; repeated rows get equal answers; a very long text is read whole, in portions;
rows without an id, or of one id, are told by their own texts; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_is, hash_share, table, texts_of

BITS = 16
RUN = 64
PENALTY = 1.5
#: Runs whose n-grams are looked up at once, whatever a text's length.
AT_ONCE = 4096
#: At most about so many documents of each language are learnt from.
MAX_ROWS_PER_LANGUAGE = 2000
_LETTER = re.compile(r"[^\W\d_]")


def grams(text: str) -> np.ndarray:
    """Hashed byte 1- to 4-grams of the whole case-folded text, by place in the text."""
    b = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
    n = len(b)
    out = np.empty((n, 3), np.uint32)
    h = b * np.uint32(0x85EBCA6B)
    for k in (1, 2, 3):
        nxt = np.zeros(n, np.uint32)
        nxt[: max(0, n - k)] = b[k:]
        h = (h ^ (nxt + np.uint32(k << 8))) * np.uint32(0x01000193)
        out[:, k - 1] = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    return out.ravel()


@dataclass
class LanguageModel:
    names: list[str]
    logp: np.ndarray  # (2**BITS, languages)


def mixture(like: np.ndarray, starts: np.ndarray, allowed: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """EM for many texts at once. like: log likelihoods (runs, languages); starts: first
    run of each text; allowed: (texts, languages). Returns proportions, log likelihoods."""
    runs = np.diff(np.append(starts, len(like)))
    theta = allowed / allowed.sum(1, keepdims=True)
    top = like.max(1, keepdims=True)
    lik = np.exp(np.maximum(like - top, -60))
    for _ in range(rounds):
        joint = lik * np.repeat(theta, runs, axis=0)
        total = np.maximum(joint.sum(1, keepdims=True), 1e-300)
        theta = np.add.reduceat(joint / total, starts, axis=0) / runs[:, None]
    joint = lik * np.repeat(theta, runs, axis=0)
    ll = np.add.reduceat(np.log(np.maximum(joint.sum(1), 1e-300)) + top[:, 0], starts)
    return theta, ll


def infer(model: LanguageModel, texts: list[str]) -> list[tuple[str, float, list[float]]]:
    """(language, proportion, all proportions) of each text."""
    langs = len(model.names)
    good = [i for i, t in enumerate(texts) if t and langs and _LETTER.search(t)]
    out = [("und", 0.0, [0.0] * langs)] * len(texts)
    at = 0
    while at < len(good):  # groups of texts of bounded total length
        group, size = [], 0
        while at < len(good) and (not group or size + len(texts[good[at]]) < 400_000):
            group.append(good[at])
            size += len(texts[good[at]])
            at += 1
        like, starts, row = [], [], 0
        for i in group:
            g = grams(texts[i])
            starts.append(row)
            for a in range(0, len(g), RUN * AT_ONCE):
                part = model.logp[g[a : a + RUN * AT_ONCE]]
                like.append(np.add.reduceat(part, np.arange(0, len(part), RUN), axis=0) / 3)  # the three orders overlap
                row += len(like[-1])
        like, starts = np.concatenate(like), np.array(starts)
        runs = np.diff(np.append(starts, len(like)))
        full, _ = mixture(like, starts, np.ones((len(group), langs)))
        single = np.add.reduceat(like, starts, axis=0)
        first = single.argmax(1)
        order = _first_then(full, first)
        best = np.zeros((len(group), langs))
        best[np.arange(len(group)), first] = 1
        value = single[np.arange(len(group)), first] - PENALTY * np.log(runs + 1)
        # no set's likelihood is above that of each run's own best language
        most = np.add.reduceat(like.max(1), starts)
        for k in range(2, langs + 1):
            open_ = np.flatnonzero(most - k * PENALTY * np.log(runs + 1) > value)
            if not len(open_):
                break
            allowed = np.zeros((len(open_), langs))
            np.put_along_axis(allowed, order[open_, :k], 1, axis=1)
            own = np.repeat(np.arange(len(group)), runs)
            theta, ll = mixture(like[np.isin(own, open_)], np.cumsum(runs[open_]) - runs[open_], allowed)
            v = ll - k * PENALTY * np.log(runs[open_] + 1)
            better = v > value[open_]
            at_ = open_[better]
            best[at_], value[at_] = theta[better], v[better]
        win = best.argmax(1)
        for j, i in enumerate(group):
            out[i] = (model.names[win[j]], float(min(1.0, best[j, win[j]])), best[j].tolist())
    return out


def _first_then(full: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Languages by falling proportion, the best single language before them."""
    key = -full.copy()
    key[np.arange(len(first)), first] = -2
    return np.argsort(key, axis=1, kind="stable")


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_rows: int = MAX_ROWS_PER_LANGUAGE) -> LanguageModel:
    """Counts n-grams over a fixed hash sample of about ``max_rows`` documents of each
    language (at most 1.2 times as many in all), whole texts."""
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return LanguageModel([], np.zeros((1 << BITS, 0)))
    pick = F.lit(False)
    for lang, n in counts.items():
        pick = pick | ((F.col("lang") == lang) & hash_share("id", max_rows / n, 17))
    names = sorted(counts)
    place = {x: i for i, x in enumerate(names)}

    def count(batches):
        total = np.zeros((len(names), 1 << BITS))
        for b in batches:
            for lang, t in zip(b.column("lang").to_pylist(), texts_of(b)):
                c = np.bincount(grams(t), minlength=1 << BITS)
                total[place[lang]] += c / max(1.0, c.sum() / 6000)  # a long text counts as one of 2,000 letters
        yield pa.RecordBatch.from_arrays([pa.array(range(len(names)), pa.int32()), pa.array([x.astype("<f4").tobytes() for x in total], pa.binary())], names=["k", "blob"])

    # the sample is bounded, so are these eight tables
    rows = known.where(pick).limit(int(1.2 * max_rows * len(names))).select("lang", "text").repartition(8).mapInArrow(count, "k int, blob binary").collect()
    total = np.zeros((len(names), 1 << BITS))
    for r in sorted(rows, key=lambda r: (r["k"], bytes(r["blob"]))):
        total[r["k"]] += np.frombuffer(r["blob"], "<f4")
    back = total.sum(0) + 0.5
    back /= back.sum()
    logp = np.log((total + 2000 * back) / (total.sum(1, keepdims=True) + 2000))
    return LanguageModel(names, np.ascontiguousarray(logp.T))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score (the proportion of that language), languages (map of those
    that were selected)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**16 numbers a language
    flat = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        names = shared.value.names
        for b in batches:
            got = infer(shared.value, texts_of(b))
            maps = [[(n, p) for n, p in zip(names, g[2]) if p > 0] for g in got]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array(maps, pa.map_(pa.string(), pa.float64()))],
                names=["id", "lang_pred", "score", "languages"],
            )

    kind = dict(flat.dtypes)["id"]
    return flat.mapInArrow(run, f"id {kind}, lang_pred string, score double, languages map<string,double>").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: LanguageModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, in which one language has a proportion of
    ``threshold`` at least; texts without a letter go."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([g[0] != "und" and g[1] >= threshold for g in infer(shared.value, texts_of(b, text_col))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op10_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~fold_is("doc_id", 5, 0)))
    return identify(docs, model).select("doc_id", fold_is("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")
