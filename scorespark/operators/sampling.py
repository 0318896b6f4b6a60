"""Correlated draws of note offsets: normal scores of quantile forecasts, recalibration of
their marginals, a one-factor copula over chords, and seeded takes.

Random numbers are a counter-based stream, so any note's number is computed from its place
alone. A file's stream begins at counter file_id * 2**32; file 0 begins at 1.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from . import folds, metrics

# Bounds of scores and draws, probability levels of the recalibration, the grid of
# correlation lengths, least pairs for a correlation and for a bin.
SCORE_LIMIT = 3.5
DRAW_LIMIT = 2.5
LEVELS = [float(u) for u in np.linspace(0.0025, 0.9975, 101)]
LENGTHS = np.geomspace(0.05, 64.0, 400)
LEAST_PAIRS, LEAST_IN_BIN = 30, 200


@dataclass(frozen=True)
class Copula:
    rho: float = 0.5  # of two notes of one chord
    ell: float = 1.0  # decay of the shared part, in beats
    marks: tuple[float, ...] = ()  # the model's scores at LEVELS; none: no recalibration


def _knots(levels: list[float]) -> list[float]:
    if sorted(set(levels)) != list(levels) or levels[0] <= 0 or levels[-1] >= 1:
        raise ValueError("quantile levels must ascend inside (0, 1)")
    return [NormalDist().inv_cdf(a) for a in levels]


def _cell(below: Column, n: int) -> Column:
    """1-based place of the cell's lower knot; the outer cells reach on."""
    return F.greatest(F.lit(1), F.least(below, F.lit(n - 1)))


def _bounded(x: Column, limit: float) -> Column:
    return F.when(x.isNotNull(), scalar.clip(x, -limit, limit))


def _between(x: Column, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    return y0 + (x - x0) / (x1 - x0) * (y1 - y0)


def quantile_value(q: Column, levels: list[float], z: Column) -> Column:
    """The forecast at normal score z. q: array of quantiles, sorted here."""
    knots, s = _knots(levels), F.array_sort(q)
    z = _bounded(z, SCORE_LIMIT)
    marks = F.array(*map(F.lit, knots))
    k = _cell(sum((z > x).cast("int") for x in knots), len(knots))
    return _between(z, F.element_at(marks, k), F.element_at(marks, k + 1), F.element_at(s, k), F.element_at(s, k + 1))


def normal_score(q: Column, levels: list[float], y: Column) -> Column:
    """The inverse: the score at which the forecast is y; the middle of a cell without width."""
    knots, s = _knots(levels), F.array_sort(q)
    marks = F.array(*map(F.lit, knots))
    k = _cell(F.size(F.filter(s, lambda v: v < y)), len(knots))
    lo, hi, a, b = F.element_at(s, k), F.element_at(s, k + 1), F.element_at(marks, k), F.element_at(marks, k + 1)
    score = F.when(y.isNull(), F.lit(None)).when(hi - lo > 1e-9, _between(y, lo, F.when(hi - lo > 1e-9, hi), a, b)).otherwise((a + b) / 2)
    return _bounded(score, SCORE_LIMIT)


def to_model_score(z: Column, copula: Copula) -> Column:
    """Standard normal score to the model's own scale."""
    if not copula.marks:
        return z

    @F.pandas_udf("double")
    def run(u: pd.Series) -> pd.Series:
        return pd.Series(np.interp(u, LEVELS, copula.marks)).where(u.notna().to_numpy())

    return run(scalar.normal_cdf(z))


def calibrated_score(z: Column, copula: Copula) -> Column:
    """The inverse of to_model_score()."""
    if not copula.marks:
        return z

    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        u = np.clip(np.interp(v, copula.marks, LEVELS), 1e-6, 1 - 1e-6)
        inv = NormalDist().inv_cdf
        return pd.Series([inv(x) if ok else None for x, ok in zip(u, v.notna())], dtype=float)

    return run(z)


def fit(scores: DataFrame, seed: int = 0) -> Copula:
    """scores: file_id, group_id, note_idx, beat, z (model scores). The marks are quantiles
    by a mergeable sketch (rank error 1e-5). rho: neighbours in a chord. ell: of each group
    one note, picked by hash; correlation by distance, fitted on 12 rows at most."""
    got = scores.where("z is not null").agg(F.percentile_approx("z", F.array(*map(F.lit, LEVELS)), 100_000).alias("m")).first()["m"]
    if got is None:
        return Copula()
    marks = np.maximum.accumulate(np.array(got) + np.arange(len(got)) * 1e-9)
    base = Copula(marks=tuple(map(float, marks)))
    return fit_copula(scores.withColumn("z", calibrated_score(F.col("z"), base)), seed, base.marks)


def fit_copula(scores: DataFrame, seed: int = 0, marks: tuple[float, ...] = ()) -> Copula:
    chord = Window.partitionBy("file_id", "group_id").orderBy("note_idx")
    pairs = scores.select("z", F.lead("z").over(chord).alias("z2")).where("z2 is not null")
    r = pairs.agg(F.count("*").alias("n"), scalar.safe_corr("z", "z2").alias("r")).first()
    rho = r["r"] if r["n"] >= LEAST_PAIRS and r["r"] is not None and math.isfinite(r["r"]) else 0.5
    rho = min(max(rho, 0.0), 0.99)
    one = scores.groupBy("file_id", "group_id").agg(F.min_by(F.struct("z", "beat"), F.struct(F.xxhash64("note_idx", "group_id", "file_id", F.lit(seed)), "note_idx")).alias("r"))
    bins = metrics.pair_correlation(one.select("file_id", "group_id", "r.z", "r.beat"), "z", "beat").where(f"n >= {LEAST_IN_BIN} and corr is not null").orderBy("bin").collect()
    if len(bins) < 2 or rho <= 0.01:
        return Copula(rho, 1.0, marks)
    n, centre, corr = (np.array([b[k] for b in bins], dtype=float) for k in ("n", "centre", "corr"))
    miss = ((rho * np.exp(-np.outer(1 / LENGTHS, centre)) - corr) ** 2) @ n
    return Copula(rho, float(LENGTHS[miss.argmin()]), marks)


def _normal(start: Column, i: Column, seed: int) -> Column:
    """The i-th (from 0) normal of a stream whose uniforms follow counter ``start``."""
    first = start + F.lit(2) * F.floor(i / 2).cast("long") + 1
    r, t = F.sqrt(F.lit(-2.0) * F.log(scalar.splitmix_uniform(first, seed))), F.lit(2 * math.pi) * scalar.splitmix_uniform(first + 1, seed)
    return r * F.when(i % 2 == 0, F.cos(t)).otherwise(F.sin(t))


def latent(notes: DataFrame, copula: Copula, seed: int) -> DataFrame:
    """Adds latent. notes: file_id, group_id, note_idx, beat. Groups draw first, each at its
    group_id; a file's notes follow, each at its note_idx."""
    origin = F.col("file_id").cast("long") * F.lit(1 << 32)
    g = notes.groupBy("file_id", "group_id").agg(F.max_by("beat", "note_idx").alias("_beat"))
    w = Window.partitionBy("file_id").orderBy("group_id")
    gap = F.greatest(F.coalesce(F.col("_beat") - F.lag("_beat").over(w), F.lit(0.0)), F.lit(0.0))
    whole = Window.partitionBy("file_id")
    g = g.select("file_id", "group_id", _normal(origin, F.col("group_id").cast("long"), seed).alias("_eta"), F.exp(-gap / max(copula.ell, 1e-6)).alias("_phi"), (F.ceil((F.max("group_id").over(whole) + 1) / 2) * 2).cast("long").alias("_used"))
    shared = folds.ar1(g, "_eta", "_phi", "_shared").select("file_id", "group_id", "_shared", "_used")
    rho = min(max(copula.rho, 0.0), 1.0)
    own = _normal(origin + F.col("_used"), F.col("note_idx").cast("long"), seed)
    return notes.join(shared, ["file_id", "group_id"]).withColumn("latent", F.lit(math.sqrt(rho)) * F.col("_shared") + F.lit(math.sqrt(1 - rho)) * own).drop("_shared", "_used")


def sample_offsets(notes: DataFrame, q: str, levels: list[float], copula: Copula, seed: int, temperature: float = 1.0) -> DataFrame:
    """Adds latent and sampled: one draw for each note. q: array column of quantiles."""
    z = _bounded(F.col("latent") * temperature, DRAW_LIMIT)
    drawn = latent(notes, copula, seed).withColumn("_z", to_model_score(z, copula))
    return drawn.withColumn("sampled", quantile_value(F.col(q), levels, F.col("_z"))).drop("_z")
