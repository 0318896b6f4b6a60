"""Windowed context: time and beat ranges, note counts, rests and phrases, baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import grouping


def _range(value: str, order: str, low: str, high: str) -> Column:
    """Frames over doubles can only be written in SQL."""
    return F.expr(f"{value} over (partition by file_id order by {order} range between {low} and {high})")


def group_profile(c: DataFrame) -> DataFrame:
    """Group grain: chord-mates share their frames, so windows are taken here."""
    sums = c.groupBy("file_id", "group_id").agg(
        F.min("onset_s").alias("g_time"), F.count("*").alias("n"), F.sum("pitch").alias("p_sum"), F.min("pitch").alias("p_min"), F.max("pitch").alias("p_max"),
        F.sum(F.rint(F.col("dur_s") * 1_000_000).cast("long")).alias("dur_us"),
    )
    return sums.join(grouping.held_notes(c), ["file_id", "group_id"]).withColumn("poly_sum", (F.col("held") + F.col("n")) * F.col("n"))


def window_stats(profile: DataFrame, width: float, order: str = "g_time", causal: bool = False) -> DataFrame:
    """Densities, mean pitch, pitch range, mean duration and polyphony in a symmetric (or
    causal) range of ``width``. The divisor is the full width, at a piece's ends too."""
    low, high = f"{width}D preceding", "current row" if causal else f"{width}D following"
    over = lambda f: _range(f, order, low, high)
    total = F.lit(width if causal else 2 * width)
    n = over("sum(n)")
    return profile.select(
        "*",
        n.alias("w_notes"),
        (n / total).alias("note_density"),
        (over("count(1)") / total).alias("onset_density"),
        (over("sum(p_sum)") / n).alias("mean_pitch"),
        (over("max(p_max)") - over("min(p_min)")).alias("pitch_range"),
        over("sum(dur_us)").alias("w_dur_us"),
        (over("sum(dur_us)") / n / F.lit(1_000_000.0)).alias("mean_dur"),
        (over("sum(poly_sum)") / n).alias("mean_polyphony"),
    )


def prev_next_beat_counts(profile: DataFrame, order: str = "g_beat") -> DataFrame:
    """Notes in [b - 1, b) and (b, b + 1]."""
    own = _range("sum(n)", order, "current row", "current row")
    return profile.select(
        "*",
        (_range("sum(n)", order, "1D preceding", "current row") - own).alias("notes_in_prev_beat"),
        (_range("sum(n)", order, "current row", "1D following") - own).alias("notes_in_next_beat"),
    )


def onsets_within(c: DataFrame, tolerance_s: float = grouping.TOLERANCE_S) -> DataFrame:
    return c.withColumn("n_onsets_within_tol", _range("count(1)", "onset_s", f"{tolerance_s}D preceding", f"{tolerance_s}D following"))


def nearest_notes(c: DataFrame, n: int, causal: bool = False) -> DataFrame:
    """Median, mean, range, percentile rank of pitch and time per note among the ``n`` notes
    on either side (causal: before). Needs g_time."""
    w = Window.partitionBy("file_id").orderBy("note_idx").rowsBetween(-n, 0 if causal else n)
    pitches = F.collect_list("pitch").over(w)
    valid = F.count("*").over(w)
    tagged = c.select("*", pitches.alias("_win"), valid.alias("_valid"), F.sum("pitch").over(w).alias("_sum"), (F.max("g_time").over(w) - F.min("g_time").over(w)).alias("_span"))
    ordered = F.array_sort("_win")
    k = F.size("_win")
    median = (F.element_at(ordered, F.floor((k + 1) / 2).cast("int")) + F.element_at(ordered, F.floor(k / 2).cast("int") + 1)) / F.lit(2.0)
    below = F.size(F.filter("_win", lambda x: x < F.col("pitch")))
    return tagged.select(
        *c.columns,
        (F.col("pitch") - median).alias("pitch_rel_median"),
        (F.col("pitch") - F.col("_sum") / F.col("_valid")).alias("pitch_rel_mean"),
        (F.array_max("_win") - F.array_min("_win")).alias("pitch_range"),
        (below / F.col("_valid")).alias("pitch_pct"),
        F.when(F.col("_valid") > 1, F.col("_span") / (F.col("_valid") - 1)).alias("time_per_note"),
    )


def residual_baseline(c: DataFrame, window: int = 24, stat: str = "median") -> DataFrame:
    """baseline_velocity: median (or mean) of the notes within ``window`` places, own chord
    left out; where none is left, the piece's median. velocity_delta against it."""
    w = Window.partitionBy("file_id").orderBy("note_idx").rowsBetween(-window, window)
    near = F.collect_list(F.struct("group_id", "velocity")).over(w)
    rest = F.array_sort(F.transform(F.filter("_near", lambda x: x["group_id"] != F.col("group_id")), lambda x: x["velocity"]))
    k = F.size("_rest")
    median = (F.element_at("_rest", F.floor((k + 1) / 2).cast("int")) + F.element_at("_rest", F.floor(k / 2).cast("int") + 1)) / F.lit(2.0)
    mean = F.aggregate("_rest", F.lit(0).cast("long"), lambda s, x: s + x) / k
    piece = F.expr("percentile(velocity, 0.5) over (partition by file_id)")
    base = F.when(k > 0, median if stat == "median" else mean).otherwise(F.col("_piece"))
    return (
        c.select("*", near.alias("_near"), piece.alias("_piece"))
        .withColumn("_rest", rest)
        .select(*c.columns, base.alias("baseline_velocity"))
        .withColumn("velocity_delta", F.col("velocity") - F.col("baseline_velocity"))
    )


def segments(c: DataFrame, beats: bool = False, rest_min_s: float = 0.2, gap_beats: float = 1.5, gap_min_s: float = 0.35) -> DataFrame:
    """Rest segments (and, with g_beat, phrases) per group: gaps and islands over the silence
    after the last sounding note, each with its first and last group's times."""
    w = Window.partitionBy("file_id").orderBy("group_id")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    cols = [F.min("onset_s").alias("g_time"), F.max(F.greatest("offset_s", "onset_s")).alias("g_off"), F.count("*").alias("n")]
    if beats:
        cols.append(F.min("g_beat").alias("g_beat"))
    g = c.groupBy("file_id", "group_id").agg(*cols).withColumn("sound_end", F.max("g_off").over(so_far))
    silence = F.col("g_time") - F.lag("sound_end").over(w)
    first = F.lag("g_time").over(w).isNull()
    g = g.withColumn("rest_start", first | F.coalesce(silence >= rest_min_s, F.lit(False)))
    long_gap = F.lit(False)
    if beats:
        long_gap = ((F.col("g_beat") - F.lag("g_beat").over(w)) >= gap_beats) & ((F.col("g_time") - F.lag("g_time").over(w)) >= gap_min_s)
    g = g.withColumn("phrase_start", F.col("rest_start") | F.coalesce(long_gap, F.lit(False)))
    g = g.withColumn("rest_seg", F.sum(F.col("rest_start").cast("int")).over(so_far)).withColumn("phrase_seg", F.sum(F.col("phrase_start").cast("int")).over(so_far))
    rest = Window.partitionBy("file_id", "rest_seg")
    phrase = Window.partitionBy("file_id", "phrase_seg")
    out = [
        (F.col("g_time") - F.min("g_time").over(rest)).alias("time_since_rest_s"),
        (F.max("sound_end").over(rest) - F.col("g_time")).alias("time_to_rest_s"),
        (F.sum("n").over(phrase.orderBy("group_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("notes_before_in_phrase"),
        F.sum("n").over(phrase).alias("phrase_notes"),
    ]
    if beats:
        since, length = F.col("g_beat") - F.min("g_beat").over(phrase), F.max("g_beat").over(phrase) - F.min("g_beat").over(phrase)
        out += [since.alias("time_since_phrase_start_beats"), length.alias("phrase_length_beats"), F.try_divide(since, length).alias("phrase_pos_norm")]
    return g.select("file_id", "group_id", "rest_seg", "phrase_seg", *out)


def piece_profile(c: DataFrame) -> DataFrame:
    """Per file: length, note rate, pitch mean and spread, mean chord size."""
    length = F.greatest(F.max("offset_s") - F.min("onset_s"), F.lit(1e-3))
    return c.groupBy("file_id").agg(
        length.alias("piece_duration_s"),
        (F.count("*") / length).alias("piece_note_rate"),
        (F.sum("pitch") / F.count("*")).alias("piece_mean_pitch"),
        F.stddev_pop("pitch").alias("piece_pitch_std"),
        (F.count("*") / F.countDistinct("group_id")).alias("piece_mean_chord_size"),
    )
