"""Onset groups (chords), canonical order, and what is read off neighbouring groups."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

TOLERANCE_S = 0.035


def _file(*cols):
    return Window.partitionBy("file_id").orderBy(*cols)


def anchored_groups(notes: DataFrame, tolerance_s: float = TOLERANCE_S) -> DataFrame:
    """Adds group_id: a note opens a group if its onset is more than the tolerance after
    the *first* onset of the group before. That is a fold, so each file's rows stream,
    in order, through one linear pass; memory doesn't grow with the file. A note without an onset
    is in no group (null); notes without a file are a file of their own."""
    if "group_id" in notes.columns:
        raise ValueError("the notes have a column group_id already")
    schema = StructType([*notes.schema.fields, StructField("group_id", IntegerType())])
    ordered = notes.repartition("file_id").sortWithinPartitions("file_id", "onset_s", "pitch", "note_id")

    def fold(batches):
        file, begun, anchor, group = None, False, None, -1
        for b in batches:
            ids = []
            for f, t in zip(b.column("file_id").to_pylist(), b.column("onset_s").to_pylist()):
                if not begun or f != file:
                    file, begun, anchor, group = f, True, None, -1
                if t is not None and (anchor is None or t - anchor > tolerance_s):
                    anchor, group = t, group + 1
                ids.append(None if t is None else group)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.int32())], names=[*b.schema.names, "group_id"])

    return ordered.mapInArrow(fold, schema)


def canonical(notes: DataFrame, tolerance_s: float = TOLERANCE_S) -> DataFrame:
    """Groups, canonical index note_idx (group, pitch, onset, id) and duration."""
    rank = F.row_number().over(_file("group_id", "pitch", "onset_s", "note_id")) - 1
    return anchored_groups(notes, tolerance_s).withColumn("note_idx", rank).withColumn("dur_s", F.greatest("offset_s", "onset_s") - F.col("onset_s"))


def groups(c: DataFrame) -> DataFrame:
    """One row a group: time, lowest, highest, size."""
    return c.groupBy("file_id", "group_id").agg(F.min("onset_s").alias("g_time"), F.min("pitch").alias("g_low"), F.max("pitch").alias("g_top"), F.count("*").alias("g_size"))


def inter_onset(g: DataFrame) -> DataFrame:
    """Times to the groups before and after; null at the ends."""
    w = _file("group_id")
    return g.withColumn("ioi_prev_s", F.col("g_time") - F.lag("g_time").over(w)).withColumn("ioi_next_s", F.lead("g_time").over(w) - F.col("g_time"))


def top_line_trend(g: DataFrame) -> DataFrame:
    """Mean top of the next two groups less that of the two before."""
    w = _file("group_id")
    return g.withColumn("top_line_trend", F.avg("g_top").over(w.rowsBetween(1, 2)) - F.avg("g_top").over(w.rowsBetween(-2, -1)))


def same_pitch_gaps(c: DataFrame) -> DataFrame:
    w = Window.partitionBy("file_id", "pitch").orderBy("onset_s", "note_idx")
    return c.withColumn("same_pitch_prev_dt", F.col("onset_s") - F.lag("onset_s").over(w)).withColumn("same_pitch_next_dt", F.lead("onset_s").over(w) - F.col("onset_s"))


def chord_ranks(c: DataFrame) -> DataFrame:
    w = Window.partitionBy("file_id", "group_id")
    up, down = w.orderBy("note_idx"), w.orderBy(F.desc("note_idx"))
    span = F.max("pitch").over(w) - F.min("pitch").over(w)
    return c.select(
        "*",
        (F.row_number().over(down) - 1).alias("rank_top"),
        (F.row_number().over(up) - 1).alias("rank_bottom"),
        F.count("*").over(w).alias("chord_size"),
        span.alias("chord_span"),
        F.try_divide((F.col("pitch") - F.min("pitch").over(w)).cast("double"), span.cast("double")).alias("chord_pos_norm"),
        (F.max("pitch").over(w) - F.col("pitch")).alias("dist_top"),
    )


def nearest_neighbours(c: DataFrame, step: int) -> DataFrame:
    """file_id, note_idx and pitch, duration of the nearest-pitch note of the group ``step``
    further on: of equally near ones the lower; of equal pitches below the last, else the
    first."""
    a = c.select("file_id", "note_idx", F.col("pitch").alias("own"), (F.col("group_id") + step).alias("group_id"))
    b = c.select("file_id", "group_id", F.col("note_idx").alias("n_idx"), F.col("pitch").alias("n_pitch"), F.col("dur_s").alias("n_dur"))
    key = F.struct(F.abs(F.col("own") - F.col("n_pitch")), F.col("n_pitch"), F.when(F.col("n_pitch") < F.col("own"), -F.col("n_idx")).otherwise(F.col("n_idx")))
    best = a.join(b, ["file_id", "group_id"]).groupBy("file_id", "note_idx").agg(F.min_by(F.struct("n_pitch", "n_dur"), key).alias("n"))
    return best.select("file_id", "note_idx", "n.n_pitch", "n.n_dur")


def melodic_context(c: DataFrame) -> DataFrame:
    """Intervals to the nearest notes before and after, direction, peaks and troughs."""
    before = nearest_neighbours(c, -1).withColumnsRenamed({"n_pitch": "prev_pitch", "n_dur": "prev_dur_s"})
    after = nearest_neighbours(c, 1).withColumnsRenamed({"n_pitch": "next_pitch", "n_dur": "next_dur_s"})
    out = c.join(before, ["file_id", "note_idx"], "left").join(after, ["file_id", "note_idx"], "left")
    prev, nxt = F.col("pitch") - F.col("prev_pitch"), F.col("next_pitch") - F.col("pitch")
    sign = lambda x: F.coalesce(F.signum(x), F.lit(0.0))
    return out.select(
        "*",
        prev.alias("prev_interval"),
        nxt.alias("next_interval"),
        (sign(prev) + sign(nxt)).alias("melodic_direction"),
        F.coalesce((prev > 0) & (nxt < 0), F.lit(False)).alias("is_local_peak"),
        F.coalesce((prev < 0) & (nxt > 0), F.lit(False)).alias("is_local_trough"),
        F.log2((F.col("dur_s") + 0.01) / (F.col("prev_dur_s") + 0.01)).alias("dur_ratio_prev"),
    )


def held_notes(c: DataFrame) -> DataFrame:
    """Per group: notes sounding when it begins, not its own. One running sum over onsets
    (+1), releases (-1) and probes; at equal times releases, then probes, then onsets."""
    on = c.select("file_id", F.col("onset_s").alias("t"), F.lit(2).alias("kind"), F.lit(1).alias("d"), F.lit(None).cast("int").alias("group_id"))
    off = c.select("file_id", F.greatest("offset_s", "onset_s").alias("t"), F.lit(0).alias("kind"), F.lit(-1).alias("d"), F.lit(None).cast("int").alias("group_id"))
    probe = groups(c).select("file_id", F.col("g_time").alias("t"), F.lit(1).alias("kind"), F.lit(0).alias("d"), "group_id")
    w = _file("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return on.unionByName(off).unionByName(probe).withColumn("held", F.greatest(F.sum("d").over(w), F.lit(0))).where("kind = 1").select("file_id", "group_id", "held")


def conditioned_features(c: DataFrame) -> DataFrame:
    """Mean velocities of the groups before and after, and of the chord's other notes."""
    g = c.groupBy("file_id", "group_id").agg(F.sum("velocity").alias("v_sum"), F.count("*").alias("n"))
    w = _file("group_id")
    mean = F.col("v_sum") / F.col("n")
    g = g.withColumn("pc_prev_group_mean_velocity", F.lag(mean).over(w)).withColumn("pc_next_group_mean_velocity", F.lead(mean).over(w))
    mates = F.try_divide((F.col("v_sum") - F.col("velocity")).cast("double"), (F.col("n") - 1).cast("double"))
    return c.join(g, ["file_id", "group_id"]).withColumn("pc_chordmates_mean_velocity", mates).drop("v_sum", "n")
