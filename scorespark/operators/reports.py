"""Report tables: what a model is compared with, summaries by split, position and chord part,
and the check that predictions don't read what they may not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from . import metrics, sampling, trees


def train_stats(df: DataFrame, v: str) -> DataFrame:
    """One row: n, global mean and (interpolated) median."""
    return df.agg(F.count("*").alias("n"), (F.sum(v) / F.count("*")).alias("global_mean"), F.percentile(v, F.lit(0.5)).alias("global_median"))


def with_baselines(df: DataFrame, train: DataFrame, y: str, p: str, local: str | None = None) -> DataFrame:
    """One row for each note and predictor: label, y, p. Constants and pitch means come from
    ``train`` (one row and 128 rows, broadcast); the oracles look at the target and bound what a
    model can know: the file's mean, the local baseline, and the model moved to the file's mean."""
    file = Window.partitionBy("file_id")
    by_pitch = metrics.pitch_means(train, y).select("pitch", F.col("mean").alias("_pitch"))
    x = df.join(F.broadcast(by_pitch), "pitch").join(F.broadcast(train_stats(train, y)))  # 128 rows; one row
    x = x.withColumn("_mean", F.avg(y).over(file)).withColumn("_model", F.avg(p).over(file))
    rows = {
        "model": F.col(p),
        "global mean": F.col("global_mean"),
        "global median": F.col("global_median"),
        "per-pitch mean": F.col("_pitch"),
        "oracle: file mean": F.col("_mean"),
        "oracle: centred model": scalar.clip(F.col(p) - F.col("_model") + F.col("_mean"), 1.0, 127.0),
    }
    if local:
        rows["oracle: local baseline"] = F.col(local)
    made = F.explode(F.array(*(F.struct(F.lit(k).alias("label"), v.cast("double").alias("p")) for k, v in rows.items()))).alias("r")
    return x.select("file_id", F.col(y).cast("double").alias("y"), made).select("file_id", "r.label", "y", "r.p")


def baselines_report(df: DataFrame, train: DataFrame, y: str, p: str, local: str | None = None) -> DataFrame:
    """The regression metrics of each predictor, in one pass over its rows."""
    return metrics.regression_metrics(with_baselines(df, train, y, p, local), "y", "p", ["label"])


def split_table(df: DataFrame, v: str) -> DataFrame:
    """Files, notes, mean, spread, extremes and percentiles of each split."""
    files = df.groupBy("split").agg(F.countDistinct("file_id").alias("files"))
    return files.join(metrics.value_stats(df, v, ["split"]).withColumnRenamed("n", "notes"), "split")


def chord_parts(df: DataFrame, y: str, p: str) -> DataFrame:
    """part, y, p: all notes; one row a chord with its means (event); deviations from those in
    chords of two and more (asynchrony), and of their top notes alone (top_lead)."""
    w = Window.partitionBy("file_id", "group_id")
    t = df.select(
        F.col(y).alias("y"), F.col(p).alias("p"), (F.row_number().over(w.orderBy(F.desc("note_idx"))) == 1).alias("top"),
        (F.count("*").over(w) > 1).alias("multi"), F.avg(y).over(w).alias("my"), F.avg(p).over(w).alias("mp"),
    )
    part = lambda name, ok, a, b: F.when(ok, F.struct(F.lit(name).alias("part"), a.cast("double").alias("y"), b.cast("double").alias("p")))
    c = F.col
    parts = [part("all", F.lit(True), c("y"), c("p")), part("event", c("top"), c("my"), c("mp")), part("asynchrony", c("multi"), c("y") - c("my"), c("p") - c("mp")), part("top_lead", c("multi") & c("top"), c("y") - c("my"), c("p") - c("mp"))]
    return t.select(F.explode(F.array(*parts)).alias("x")).where("x is not null").select("x.*")


def median_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """The regression metrics of each part."""
    return metrics.regression_metrics(chord_parts(df, y, p), "y", "p", ["part"])


def offset_by_beat_position(df: DataFrame, frac: Column, y: str, p: str, least: int = 2000) -> DataFrame:
    """Means by place in the beat, in twelfths; places with fewer notes are left out."""
    place = F.round(F.rint(frac * 12) / 12 % 1, 3)
    return df.groupBy(place.alias("frac")).agg(F.count("*").alias("n"), F.avg(y).alias("y"), F.avg(p).alias("p")).where(F.col("n") >= least)


def unconditional_quantiles(df: DataFrame, y: str, levels: list[float], weight: str | None = None) -> DataFrame:
    """One row: q, the interpolated quantiles of the rows whose weight isn't 0."""
    rows = df.where(F.col(weight) > 0) if weight else df
    return rows.agg(F.percentile(F.col(y).cast("double"), F.array(*map(F.lit, levels))).alias("q"))


def unconditional_draws(df: DataFrame, y: str, levels: list[float], order: list[str], seed: int = 0, weight: str | None = None) -> DataFrame:
    """df and draw: independent draws from the unconditional quantiles. A note's two uniforms have
    the numbers of its place in the order, in its file."""
    q = unconditional_quantiles(df, y, levels, weight)
    k = F.row_number().over(Window.partitionBy("file_id").orderBy(*order))
    u = lambda i: scalar.splitmix_uniform(F.lit(2) * k + (i - 1), seed)
    z = F.sqrt(F.lit(-2.0) * F.log(u(0))) * F.cos(F.lit(2.0) * F.pi() * u(1))
    drawn = df.withColumn("_z", z).join(F.broadcast(q))  # one row
    return drawn.withColumn("draw", sampling.quantile_value(F.col("q"), levels, F.col("_z"))).drop("_z", "q")


def row_sample(df: DataFrame, key: list[str], n: int, seed: int = 0) -> DataFrame:
    """``n`` rows by a seeded hash of their key (a sampling operator: the limit is the feature)."""
    at = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in key)))
    return df.withColumn("_at", at).orderBy("_at", *key).limit(n).drop("_at")


def meter_labels(beats: DataFrame, estimated: bool = False) -> DataFrame:
    """file_id, meter: the most frequent beats a bar over the most frequent unit; of equally frequent
    ones the smallest."""
    unit = F.col("beat_unit") if "beat_unit" in beats.columns else F.lit(4)

    def mode(x: Column, name: str) -> DataFrame:
        n = beats.groupBy("file_id", x.alias("v")).agg(F.count("*").alias("n"))
        return n.groupBy("file_id").agg(F.max_by("v", F.struct("n", -F.col("v"))).alias(name))

    both = mode(F.col("beats_per_bar"), "num").join(mode(unit, "den"), "file_id")
    return both.select("file_id", F.concat(F.col("num").cast("string"), F.lit("/"), F.col("den").cast("string"), F.lit(" (estimated)" if estimated else "")).alias("meter"))


def unequal_rows(a: DataFrame, b: DataFrame, key: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Keys of rows that one side lacks, or whose columns differ: numbers by more than the tolerance,
    others at all. Empty where predictions don't depend on what was changed in between."""
    cols = [c for c in a.columns if c not in key]
    x = a.select(*key, F.struct(*cols).alias("a")).join(b.select(*key, F.struct(*cols).alias("b")), key, "full")
    kinds = dict(a.dtypes)

    def unlike(c: str) -> Column:
        p, q = F.col(f"a.{c}"), F.col(f"b.{c}")
        if kinds[c] in ("double", "float") or kinds[c].startswith("decimal"):
            return ~(p.eqNullSafe(q) | F.coalesce(F.abs(p - q) <= tolerance, F.lit(False)))
        return ~p.eqNullSafe(q)

    differs = F.col("a").isNull() | F.col("b").isNull()
    for c in cols:
        differs = differs | unlike(c)
    return x.where(differs).select(key)


def importance(grown: list[trees.Tree], features: list[str], rows: DataFrame) -> DataFrame:
    """feature, weight (splits), cover (rows that reach its splits), sorted by cover: each tree is
    walked by all rows, and tasks emit one sum a feature."""
    import numpy as np
    import pyarrow as pa

    shared = rows.sparkSession.sparkContext.broadcast(grown)  # a model, whatever the rows
    as_number = [F.coalesce(F.col(f).cast("float").cast("double"), F.lit(float("nan"))).alias(f) for f in features]

    def run(batches):
        total = np.zeros(len(features), np.int64)
        for b in batches:
            x = np.stack([b.column(f).to_numpy(zero_copy_only=False) for f in features], 1)
            for t in shared.value:
                left, right, feature = (np.array(v) for v in (t.left, t.right, t.feature))
                value, default = np.array(t.value, np.float32), np.array(t.default_left)
                at = np.zeros(len(x), np.int64)
                while (live := np.flatnonzero(left[at] >= 0)).size:
                    n = at[live]
                    total += np.bincount(feature[n], minlength=len(features))
                    v = x[live, feature[n]].astype(np.float32)
                    at[live] = np.where(np.where(np.isnan(v), default[n], v < value[n]), left[n], right[n])
        yield pa.RecordBatch.from_arrays([pa.array(features), pa.array(total)], names=["feature", "cover"])

    weight = {f: sum(t.left[i] >= 0 and t.feature[i] == k for t in grown for i in range(len(t.left))) for k, f in enumerate(features)}
    known = rows.sparkSession.createDataFrame(list(weight.items()), "feature string, weight bigint")
    cover = rows.select(*as_number).mapInArrow(run, "feature string, cover bigint").groupBy("feature").agg(F.sum("cover").alias("cover"))
    return known.join(cover, "feature", "left").select("feature", "weight", F.coalesce("cover", F.lit(0)).alias("cover")).orderBy(F.desc("cover"), "feature")


def gain_table(spark, stats: list[tuple[str, float, float]]) -> DataFrame:
    """feature, weight, gain, total_gain, cover (means over its splits but for total_gain), the most
    gaining first. stats: what ``boosting.train`` notes, one entry a split."""
    rows = spark.createDataFrame(stats, "feature string, gain double, cover double")
    return rows.groupBy("feature").agg(F.count("*").alias("weight"), F.avg("gain").alias("gain"), F.sum("gain").alias("total_gain"), F.avg("cover").alias("cover")).orderBy(F.desc("gain"), "feature")
