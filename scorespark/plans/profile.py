"""The flagship plan: chord-level context profile of every file.

Notes are grouped by the anchored fold, windows are taken at group grain, errors of a
prediction are aggregated per file together with the context, sorted by error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import grouping


def context_profile(notes: DataFrame, y: str = "velocity", p: str = "pred") -> DataFrame:
    c = grouping.canonical(notes)
    e = F.col(p) - F.col(y)
    g = c.groupBy("file_id", "group_id").agg(F.min("onset_s").alias("g_time"), F.count("*").alias("n"), F.sum(F.abs(e)).alias("abs_err"), F.sum(e).alias("err"), F.max("pitch").alias("g_top"))
    near = F.expr("sum(n) over (partition by file_id order by g_time range between 3D preceding and 3D following)")
    w = g.withColumn("near", near)
    n = F.sum("n")
    return (
        w.groupBy("file_id")
        .agg(n.alias("n"), F.count("*").alias("n_groups"), (F.sum("abs_err") / n).alias("mae"), (F.sum("err") / n).alias("bias"), (F.sum(F.col("near") * F.col("n")) / (6 * n)).alias("mean_density"), F.max("g_top").alias("top"))
        .orderBy("mae", "file_id")
    )
