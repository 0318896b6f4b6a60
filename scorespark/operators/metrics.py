"""Accuracy, calibration, realism and summary aggregates. Each is one or two aggregate
stages; whole-number inputs are summed as whole numbers and divided once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import safe_corr


def average_ranks(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """Adds rank_<col>: ranks with ties averaged."""
    out = df
    for c in cols:
        w = Window.partitionBy(*by)
        out = out.withColumn(f"rank_{c}", F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / F.lit(2.0))
    return out


def regression_metrics(df: DataFrame, y: str, p: str, by: list[str]) -> DataFrame:
    """n, mae, rmse, r2, bias, pearson, spearman; null where undefined."""
    e, n = F.col(p) - F.col(y), F.count("*")
    ss_res = F.sum(e * e)
    ss_tot = F.sum(F.col(y) * F.col(y)) - F.sum(y) * F.sum(y) / n
    return (
        average_ranks(df, [y, p], by)
        .groupBy(*by)
        .agg(
            n.alias("n"),
            (F.sum(F.abs(e)) / n).alias("mae"),
            F.sqrt(ss_res / n).alias("rmse"),
            F.when(ss_tot > 0, 1 - F.try_divide(ss_res.cast("double"), ss_tot.cast("double"))).alias("r2"),
            (F.sum(e) / n).alias("bias"),
            safe_corr(y, p).alias("pearson"),
            safe_corr(f"rank_{y}", f"rank_{p}").alias("spearman"),
        )
    )


def within_piece_pearson(df: DataFrame, y: str, p: str, least: int = 50) -> DataFrame:
    """Mean r of the files with enough notes and a defined r."""
    per = df.groupBy("file_id").agg(F.count("*").alias("n"), safe_corr(y, p).alias("r"))
    return per.where((F.col("n") >= least) & F.col("r").isNotNull()).agg(F.count("*").alias("n_files"), F.avg("r").alias("within_piece_pearson"))


def value_stats(df: DataFrame, v: str, by: list[str]) -> DataFrame:
    """n, mean, population spread, extremes and interpolated percentiles."""
    q = F.expr(f"percentile({v}, array(0.05D, 0.25D, 0.5D, 0.75D, 0.95D))")
    got = df.groupBy(*by).agg(F.count("*").alias("n"), (F.sum(v) / F.count("*")).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), q.alias("q"))
    return got.select(*by, "n", "mean", "std", "min", *(F.col("q")[i].alias(a) for i, a in enumerate(("p5", "p25", "p50", "p75", "p95"))), "max")


def histogram(df: DataFrame, v: str, by: list[str], low: int | None = None, high: int | None = None) -> DataFrame:
    """Counts in unit bins; values beyond the ends go to the end bins."""
    b: Column = F.rint(F.col(v).cast("double"))
    if low is not None:
        b = F.greatest(F.lit(float(low)), b)
    if high is not None:
        b = F.least(F.lit(float(high)), b)
    return df.groupBy(*by, b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def histogram_percentiles(h: DataFrame, by: list[str], levels: list[float]) -> DataFrame:
    """First bin at which the cumulative share reaches the level (no interpolation)."""
    w = Window.partitionBy(*by)
    c = h.withColumn("cum", F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(w))
    return c.groupBy(*by).agg(F.max("total").alias("n"), *(F.min(F.when(F.col("cum") >= F.col("total") * F.lit(x), F.col("bin"))).alias(f"p{round(100 * x)}") for x in levels))


def pinball(df: DataFrame, y: str, quantiles: dict[float, str]) -> DataFrame:
    """level, loss, coverage (share of y at or below the quantile), one row a level."""
    rows = F.explode(F.array(*(F.struct(F.lit(a).alias("level"), F.col(c).alias("q")) for a, c in quantiles.items())))
    d = F.col("y") - F.col("q")
    return (
        df.select(F.col(y).alias("y"), rows.alias("r")).select("y", "r.level", "r.q").groupBy("level")
        .agg(F.sum(F.when(d > 0, d).otherwise(0)).alias("over"), F.sum(F.when(d < 0, -d).otherwise(0)).alias("under"), F.sum((F.col("y") <= F.col("q")).cast("int")).alias("hit"), F.count("*").alias("n"))
        .select("level", ((F.col("level") * F.col("over") + (1 - F.col("level")) * F.col("under")) / F.col("n")).alias("loss"), (F.col("hit") / F.col("n")).alias("coverage"))
    )


def intervals(df: DataFrame, y: str, quantiles: dict[float, str]) -> DataFrame:
    """Coverage and mean width of each central interval (a, 1 - a) whose ends are given."""
    pairs = [(a, c, quantiles[b]) for a, c in quantiles.items() for b in quantiles if a < 0.5 and abs(a + b - 1) < 1e-9]
    rows = F.explode(F.array(*(F.struct(F.lit(round(1 - 2 * a, 6)).alias("nominal"), F.col(lo).alias("lo"), F.col(hi).alias("hi")) for a, lo, hi in pairs)))
    inside = (F.col("y") >= F.col("r.lo")) & (F.col("y") <= F.col("r.hi"))
    return df.select(F.col(y).alias("y"), rows.alias("r")).groupBy("r.nominal").agg((F.sum(inside.cast("int")) / F.count("*")).alias("coverage"), (F.sum(F.col("r.hi") - F.col("r.lo")) / F.count("*")).alias("mean_width"))


def event_and_asynchrony(df: DataFrame, y: str, p: str) -> DataFrame:
    """Mean absolute error of group means (event), and of the notes around them
    (asynchrony, groups of two and more), with the top notes' mean lead."""
    w = Window.partitionBy("file_id", "group_id")
    t = df.select("file_id", "group_id", F.col(y).alias("y"), F.col(p).alias("p"), (F.row_number().over(w.orderBy(F.desc("note_idx"))) == 1).alias("top"), F.count("*").over(w).alias("n"), F.avg(y).over(w).alias("y_ev"), F.avg(p).over(w).alias("p_ev"))
    multi = F.col("n") > 1
    dy, dp = F.col("y") - F.col("y_ev"), F.col("p") - F.col("p_ev")
    return t.agg(
        F.avg(F.abs(F.col("p") - F.col("y"))).alias("all_mae"),
        F.avg(F.when(F.col("top"), F.abs(F.col("p_ev") - F.col("y_ev")))).alias("event_mae"),
        F.avg(F.when(multi, F.abs(dp - dy))).alias("asynchrony_mae"),
        F.avg(F.when(multi & F.col("top"), dy)).alias("top_lead_true"),
        F.avg(F.when(multi & F.col("top"), dp)).alias("top_lead_pred"),
    )


def realism(df: DataFrame, v: str, least_groups: int = 20) -> DataFrame:
    """Spread of all values (population), of group means (sample), their lag-1 correlation
    within files, and the spread around group means (population)."""
    g = df.groupBy("file_id", "group_id").agg(F.avg(v).alias("ev"), F.count("*").alias("n"))
    w = Window.partitionBy("file_id").orderBy("group_id")
    lagged = g.withColumn("prev", F.lag("ev").over(w)).groupBy("file_id").agg(F.count("*").alias("k"), F.stddev_pop("ev").alias("sd"), F.try_divide(F.covar_pop("ev", "prev"), F.expr("stddev_pop(case when prev is not null then ev end)") * F.stddev_pop("prev")).alias("r"))
    lag1 = lagged.where((F.col("k") > least_groups) & (F.col("sd") > 0)).agg(F.avg("r").alias("event_lag1_r"))
    spread = df.join(g, ["file_id", "group_id"]).agg(F.stddev_pop(v).alias("sd"), F.stddev_pop(F.when(F.col("n") > 1, F.col(v) - F.col("ev"))).alias("asynchrony_sd"))
    return spread.join(F.broadcast(g.agg(F.stddev_samp("ev").alias("event_sd")))).join(F.broadcast(lag1))  # one row each


def error_by(df: DataFrame, key: Column, y: str, p: str, least: int) -> DataFrame:
    """Mean absolute error and bias by a key, for keys with enough rows."""
    e = F.col(p) - F.col(y)
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("n"), (F.sum(F.abs(e)) / F.count("*")).alias("mae"), (F.sum(e) / F.count("*")).alias("bias")).where(F.col("n") >= least)


def voice_asynchrony(df: DataFrame, v: str, least_size: int = 2, max_rank: int = 5) -> DataFrame:
    """Mean deviation from the chord mean by rank from the top."""
    w = Window.partitionBy("file_id", "group_id")
    t = df.select((F.row_number().over(w.orderBy(F.desc("note_idx"))) - 1).alias("voice_rank"), F.count("*").over(w).alias("size"), (F.col(v) - F.avg(v).over(w)).alias("dev"))
    return t.where((F.col("size") >= least_size) & (F.col("voice_rank") <= max_rank)).groupBy("voice_rank").agg(F.count("*").alias("n"), F.avg("dev").alias("mean_dev"))


def pitch_means(df: DataFrame, v: str) -> DataFrame:
    """Mean by pitch for all 128 pitches; the global mean where there are no notes."""
    spark = df.sparkSession
    total = df.agg((F.sum(v) / F.count("*")).alias("all_mean"))
    per = df.groupBy("pitch").agg((F.sum(v) / F.count("*")).alias("m"), F.count("*").alias("n"))
    keys = spark.range(128).select(F.col("id").cast("int").alias("pitch"))
    return keys.join(per, "pitch", "left").join(F.broadcast(total)).select("pitch", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", "all_mean").alias("mean"))  # total: one row


def pair_correlation(df: DataFrame, z: str, pos: str, max_lag: int = 12, edges: tuple[float, ...] = (0.0, 0.125, 0.25, 0.375, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0)) -> DataFrame:
    """Correlation of pairs of groups up to ``max_lag`` apart, by distance bin. One row a
    group comes in; pairs are window leads, never a self-join."""
    w = Window.partitionBy("file_id").orderBy("group_id")
    pairs = F.array(*(F.struct(F.lead(z, k).over(w).alias("b"), (F.lead(pos, k).over(w) - F.col(pos)).alias("d")) for k in range(1, max_lag + 1)))
    t = df.select(F.col(z).alias("a"), pairs.alias("pairs")).select("a", F.explode("pairs").alias("p")).select("a", "p.b", "p.d").where("b is not null and d >= 0")
    t = t.where(F.col("d") < edges[-1])
    bin_ = F.lit(0)
    for i, x in enumerate(edges[1:-1], 1):
        bin_ = F.when(F.col("d") >= x, i).otherwise(bin_)
    n, sa, sb = F.count("*"), F.sum("a"), F.sum("b")
    g = t.groupBy(bin_.alias("bin")).agg(n.alias("n"), sa.alias("sa"), sb.alias("sb"), F.sum(F.col("a") * F.col("b")).alias("sab"), F.sum(F.col("a") * F.col("a") + F.col("b") * F.col("b")).alias("sq"), F.avg("d").alias("centre"))
    ma, mb = F.col("sa") / F.col("n"), F.col("sb") / F.col("n")
    return g.select("bin", "n", "centre", F.try_divide(F.col("sab") / F.col("n") - ma * mb, F.col("sq") / (2 * F.col("n")) - ((ma + mb) / 2) * ((ma + mb) / 2)).alias("corr"))


def split_summary(df: DataFrame, v: str) -> DataFrame:
    return df.groupBy("split").agg(F.countDistinct("file_id").alias("files"), F.count("*").alias("notes"), (F.sum(v) / F.count("*")).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"))


def split_of(file_id: Column) -> Column:
    return F.when(file_id % 10 < 7, "train").when(file_id % 10 < 8, "validation").otherwise("test")


def overlapping_files(df: DataFrame) -> DataFrame:
    """Files in more than one split; must be empty."""
    return df.groupBy("file_id").agg(F.countDistinct("split").alias("n")).where("n > 1")


def file_sample(df: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` files of each split, without replacement, by a seeded hash."""
    files = df.select("split", "file_id").distinct()
    w = Window.partitionBy("split").orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col("file_id").cast("string"))), "file_id")
    return files.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n).select("split", "file_id")
