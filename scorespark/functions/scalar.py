"""Column functions with the engine's rounding, clipping and grid rules."""

from __future__ import annotations

from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: Column) -> Column:
    return F.rint(x)


def clip(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def clip_velocity(v: Column) -> Column:
    """Whole number in 1..127, halves to even; what is not finite becomes 64."""
    v = v.cast("double")
    bad = v.isNull() | F.isnan(v) | v.isin(float("inf"), float("-inf"))
    return clip(F.rint(F.when(bad, F.lit(64.0)).otherwise(v)), 1.0, 127.0).cast("int")


def near_grid(frac: Column, steps: int, tol: float) -> Column:
    x = frac * F.lit(float(steps))
    return F.abs(x - F.rint(x)) / F.lit(float(steps)) <= F.lit(tol)


def metrical_level(beat: Column, bar_pos: Column, bar_len: Column, tol: float = 0.12) -> Column:
    """0 downbeat, 1 half bar, 2 beat, 3 half beat, 4 third or quarter, 5 other. bar_pos and
    bar_len are those of the nearest beat."""
    frac = beat - F.floor(beat)
    on = F.abs(beat - F.rint(beat)) <= F.lit(tol)
    half = on & (bar_len >= 4) & (bar_len % 2 == 0) & (bar_pos * 2 == bar_len)
    return (
        F.when(on & (bar_pos == 0), 0)
        .when(half, 1)
        .when(on, 2)
        .when(near_grid(frac, 2, tol), 3)
        .when(near_grid(frac, 3, tol / 2) | near_grid(frac, 4, tol / 2), 4)
        .otherwise(5)
    )


def shape_dynamics(v: Column, median: Column, scale: float, offset: float) -> Column:
    return median + (v - median) * F.lit(scale) + F.lit(offset)


def mix(model: Column, given: Column, share: float) -> Column:
    if not 0 <= share <= 1:
        raise ValueError("the share must be between 0 and 1")
    return model * F.lit(share) + given * F.lit(1 - share)


def snap_nearest(beat: Column, steps: list[int]) -> Column:
    """Nearest point of several subdivisions; of equally near ones the first's."""
    points = [F.rint(beat * s) / F.lit(float(s)) for s in steps]
    best, err = points[0], F.abs(points[0] - beat)
    for p in points[1:]:
        e = F.abs(p - beat)
        best, err = F.when(e < err, p).otherwise(best), F.least(err, e)
    return best


def safe_corr(x: str, y: str) -> Column:
    """Pearson's r, null for constants and fewer than two rows."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def inverse_normal(p: float) -> float:
    return NormalDist().inv_cdf(p)


def normal_cdf(z: Column) -> Column:
    """Spark has no error function. Built when called: a session must be there."""
    from math import erf, sqrt

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None or v != v else 0.5 * (1 + erf(v / sqrt(2))))

    return run(z)


def splitmix_uniform(index: Column, seed: int = 0) -> Column:
    """The index-th (from 1) uniform of a counter-based SplitMix64 stream, in (0, 1): any
    position without the ones before it. Products wrap, so they are taken in 32-bit
    halves, which never overflow a long."""
    z = _add(F.lit(seed).cast("long"), _mul(index.cast("long"), 0x9E3779B97F4A7C15))
    z = _mul(_fold(z, 30), 0xBF58476D1CE4E5B9)
    z = _mul(_fold(z, 27), 0x94D049BB133111EB)
    z = _fold(z, 31)
    return (F.shiftrightunsigned(z, 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(0xFFFFFFFF))


def _let(x: Column, f) -> Column:
    """Binds x once; without it nested expressions would repeat their operands."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _add(a: Column, b: Column) -> Column:
    """Sum modulo 2**64."""

    def halves(p):
        low = _low(p["a"]) + _low(p["b"])
        high = _low(F.shiftrightunsigned(p["a"], 32) + F.shiftrightunsigned(p["b"], 32) + F.shiftrightunsigned(low, 32))
        return F.shiftleft(high, 32).bitwiseOR(_low(low))

    return _let(F.struct(a.alias("a"), b.alias("b")), halves)


def _times(a: Column, b: int) -> Column:
    """Product of two numbers below 2**32, modulo 2**64, in 16-bit steps."""
    return _let(a, lambda x: _add(x * F.lit(b & 0xFFFF), F.shiftleft(x * F.lit(b >> 16), 16)))


def _mul(a: Column, b: int) -> Column:
    """Product modulo 2**64."""
    bl, bh = b & 0xFFFFFFFF, b >> 32

    def product(x):
        al, ah = _low(x), F.shiftrightunsigned(x, 32)
        return _add(_times(al, bl), F.shiftleft(_add(_times(ah, bl), _times(al, bh)), 32))

    return _let(a, product)


def _fold(z: Column, bits: int) -> Column:
    return _let(z, lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, bits)))


def to_velocity(raw: Column, baseline: Column | None = None) -> Column:
    """A model's output as a velocity: itself, or added to the baseline where it learnt deltas."""
    return raw if baseline is None else baseline + raw


def clamped_offset(ms: Column, scale: float = 1.0, limit_ms: float = 200.0) -> Column:
    """A scaled offset within +-limit_ms."""
    return clip(ms * F.lit(scale), -float(limit_ms), float(limit_ms))


def slug(text: Column, length: int = 60) -> Column:
    """Runs of other characters than letters and digits become one underscore; none at the ends."""
    return F.substring(F.btrim(F.regexp_replace(text, "[^A-Za-z0-9]+", "_"), F.lit("_")), 1, length)
