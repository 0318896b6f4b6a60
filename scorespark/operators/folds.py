"""Recursions over a file's groups, streamed in order in one pass a file."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def _scan(df: DataFrame, order: list, value: str, out: str, step) -> DataFrame:
    """Adds ``out``: step(previous or None, row value) along each file's order. ``value``
    may be a struct. Rows stream; the state is one number. A row without a value gets none and
    leaves the state as it is."""
    if out in df.columns:
        raise ValueError(f"there is a column {out} already")
    ordered = df.repartition("file_id").sortWithinPartitions("file_id", *order)
    schema = StructType([*df.schema.fields, StructField(out, DoubleType())])

    def run(batches):
        file, begun, state = None, False, None
        for b in batches:
            got = []
            for f, v in zip(b.column("file_id").to_pylist(), b.column(value).to_pylist()):
                if not begun or f != file:
                    file, begun, state = f, True, None
                lacking = v is None or isinstance(v, dict) and None in v.values()
                state = state if lacking else step(state, v)
                got.append(None if lacking else state)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.float64())], names=[*b.schema.names, out])

    return ordered.mapInArrow(run, schema)


def ema(df: DataFrame, value: str, alpha: float, out: str = "ema", backward: bool = False, order: str = "group_id") -> DataFrame:
    by = F.desc(order) if backward else F.asc(order)
    return _scan(df, [by], value, out, lambda s, v: float(v) if s is None else alpha * v + (1 - alpha) * s)


def smooth_velocities(c: DataFrame, alpha: float = 0.5, strength: float = 1.0, accent: float = 8.0, v: str = "velocity") -> DataFrame:
    """Group means are drawn to the mean of a forward and a backward moving average, accents
    excepted; each note moves with its group. Adds smoothed."""
    g = c.groupBy("file_id", "group_id").agg((F.sum(v) / F.count("*")).alias("g_mean"))
    both = ema(ema(g, "g_mean", alpha, "fwd"), "g_mean", alpha, "bwd", backward=True)
    trend = (F.col("fwd") + F.col("bwd")) * F.lit(0.5)
    shift = F.when(F.col("g_mean") - trend > accent, F.lit(0.0)).otherwise(F.lit(strength) * (trend - F.col("g_mean")))
    return c.join(both.select("file_id", "group_id", shift.alias("_shift")), ["file_id", "group_id"]).withColumn("smoothed", F.col(v) + F.col("_shift")).drop("_shift")


def ar1(g: DataFrame, eta: str, phi: str, out: str = "latent") -> DataFrame:
    """a = phi a' + sqrt(1 - phi^2) eta; the first is eta."""
    fed = g.withColumn("_in", F.struct(F.col(eta).alias("e"), F.col(phi).alias("p")))
    return _scan(fed, ["group_id"], "_in", out, lambda s, v: v["e"] if s is None else v["p"] * s + math.sqrt(1 - v["p"] ** 2) * v["e"]).drop("_in")
