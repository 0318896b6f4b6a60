"""What a beat tracker reads off note onsets, as set-wise operators: the strength of the
onsets over time, beats moved to near onsets, and how much a beat looks like a bar's first.

Joins by nearness are one ordered pass a file over both sides: no range join, no broadcast.
"""

from __future__ import annotations

from math import exp

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the frames within three of an onset's: a bell of one frame's width.
_BELL = {d: exp(-d * d / 2) for d in range(-3, 4)}


def _file():
    return Window.partitionBy("file_id")


def onset_strength(notes: DataFrame, rate: float = 50.0) -> DataFrame:
    """file_id, n_frames, frame, strength for each frame near an onset (0 elsewhere). A note counts
    1 and its length up to a second; a frame's strength is the logarithm of 1 + its sum, spread
    over its neighbours and divided by the standard deviation over all frames of the file, which
    end two seconds after the last onset."""
    frames = (F.ceil((F.max("onset_s").over(_file()) + 2.0) * rate) + 1).cast("long")
    at = notes.select("file_id", frames.alias("n_frames"), F.rint(F.col("onset_s") * rate).cast("long").alias("frame"), (1 + F.least(F.col("offset_s") - F.col("onset_s"), F.lit(1.0))).alias("w"))
    raw = at.groupBy("file_id", "n_frames", "frame").agg(F.log1p(F.sum("w")).alias("w"))
    whole = sum(_BELL.values())
    taps = F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.lit(v / whole).alias("share")) for d, v in _BELL.items())))
    near = raw.select("*", taps.alias("tap")).select("file_id", "n_frames", (F.col("frame") + F.col("tap.d")).alias("frame"), (F.col("w") * F.col("tap.share")).alias("w"))
    spread = near.where("frame >= 0 and frame < n_frames").groupBy("file_id", "n_frames", "frame").agg(F.sum("w").alias("w"))
    mean = F.sum("w").over(_file()) / F.col("n_frames")
    deviation = F.sqrt(F.greatest(F.sum(F.col("w") * F.col("w")).over(_file()) / F.col("n_frames") - mean * mean, F.lit(0.0)))
    return spread.select("file_id", "n_frames", "frame", (F.col("w") / (deviation + 1e-9)).alias("strength"))


def with_nearest(points: DataFrame, marks: DataFrame, point: str, mark: str, payload: str, out: str) -> DataFrame:
    """points and, as column ``out``, the payload of the mark of the file that is nearest in
    time; of two equally near ones the earlier. Files without marks get null."""
    kind = marks.schema[payload].dataType
    a = points.select("file_id", F.struct(*points.columns).alias("_row"), F.col(point).cast("double").alias("_t"))
    b = marks.select("file_id", F.col(mark).cast("double").alias("_t"), F.struct(F.col(mark).cast("double").alias("t"), F.col(payload).alias("p")).alias("_m")).where("_t is not null")
    both = a.unionByName(b, allowMissingColumns=True)
    here = Window.partitionBy("file_id").orderBy("_t", F.col("_m").isNull())
    before = F.last("_m", ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_m", ignorenulls=True).over(here.rowsBetween(0, Window.unboundedFollowing))
    got = both.select("_row", "_t", before.alias("_a"), after.alias("_b")).where("_row is not null")
    early = F.col("_b").isNull() | (F.col("_t") - F.col("_a.t") <= F.col("_b.t") - F.col("_t"))
    return got.select("_row.*", F.when(early & F.col("_a").isNotNull(), F.col("_a.p")).otherwise(F.col("_b.p")).cast(kind).alias(out))


def beat_lengths(beats: DataFrame) -> DataFrame:
    """Adds ibi: the time to the next beat, at the last one that from the one before."""
    w = Window.partitionBy("file_id").orderBy("beat")
    return beats.withColumn("ibi", F.coalesce(F.lead("time_s").over(w), 2 * F.col("time_s") - F.lag("time_s").over(w)) - F.col("time_s"))


def snap_to_onsets(beats: DataFrame, notes: DataFrame, share: float = 0.15) -> DataFrame:
    """Beats move to the nearest onset where it is within a share of the beat. One that would come
    within a millisecond of the (moved) beat before it stays; a file in which beats would still
    not ascend keeps its own."""
    w = Window.partitionBy("file_id").orderBy("beat")
    onsets = notes.select("file_id", F.col("onset_s").alias("_onset")).distinct()
    near = with_nearest(beat_lengths(beats), onsets, "time_s", "_onset", "_onset", "_near")
    near = near.withColumn("_moved", F.when(F.abs(F.col("_near") - F.col("time_s")) <= share * F.col("ibi"), F.col("_near")).otherwise(F.col("time_s")))
    kept = near.withColumn("_kept", F.when(F.col("_moved") - F.lag("_moved").over(w) <= 1e-3, F.col("time_s")).otherwise(F.col("_moved")))
    kept = kept.withColumn("_step", F.col("_kept") - F.lag("_kept").over(w))
    times = F.when(F.coalesce(F.min("_step").over(_file()) > 0, F.lit(True)), F.col("_kept")).otherwise(F.col("time_s"))
    return kept.withColumn("time_s", times).select(beats.columns)


def notes_of_beats(beats: DataFrame, notes: DataFrame, share: float = 0.15) -> DataFrame:
    """file_id, beat, n_notes, held, low for each beat: the notes whose nearest beat it is and that
    begin within a share of it, their lengths in beats (4 at most each) summed, and the
    lowest pitch."""
    marks = beat_lengths(beats).select("file_id", "time_s", F.struct("beat", "time_s", "ibi").alias("b"))
    own = with_nearest(notes.select("file_id", "onset_s", "offset_s", "pitch"), marks, "onset_s", "time_s", "b", "b")
    near = own.where(F.abs(F.col("onset_s") - F.col("b.time_s")) <= share * F.col("b.ibi"))
    length = F.least((F.col("offset_s") - F.col("onset_s")) / F.col("b.ibi"), F.lit(4.0))
    found = near.groupBy("file_id", F.col("b.beat").alias("beat")).agg(F.count("*").alias("n_notes"), F.sum(length).alias("held"), F.min("pitch").alias("low"))
    return beats.select("file_id", "beat").join(found, ["file_id", "beat"], "left").select("file_id", "beat", F.coalesce("n_notes", F.lit(0)).alias("n_notes"), F.coalesce("held", F.lit(0.0)).alias("held"), "low")


def pitch_class_profile(beats: DataFrame, notes: DataFrame, share: float = 0.15) -> DataFrame:
    """file_id, beat, pc, weight: seconds (2 at most a note) of each pitch class that begin in a
    beat's span, which starts a share of the beat before it. Notes before the first span are its."""
    spans = beat_lengths(beats).select("file_id", "beat", (F.col("time_s") - share * F.col("ibi")).alias("_t"), F.row_number().over(Window.partitionBy("file_id").orderBy("beat")).alias("_k"))
    spans = spans.select("file_id", F.when(F.col("_k") == 1, F.lit(float("-inf"))).otherwise(F.col("_t")).alias("_t"), F.col("beat").alias("_beat"))
    a = notes.select("file_id", F.col("onset_s").alias("_t"), (F.col("pitch") % 12).alias("pc"), F.least(F.col("offset_s") - F.col("onset_s"), F.lit(2.0)).alias("w"))
    so_far = Window.partitionBy("file_id").orderBy("_t", F.col("_beat").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(spans, allowMissingColumns=True).withColumn("beat", F.last("_beat", ignorenulls=True).over(so_far))
    return both.where("pc is not null and beat is not null").groupBy("file_id", "beat", "pc").agg(F.sum("w").alias("weight"))


def harmonic_change(beats: DataFrame, notes: DataFrame, share: float = 0.15) -> DataFrame:
    """file_id, beat, change: 1 - the cosine of a beat's pitch-class profile and that of the beat
    before; 0 where one of them is empty."""
    profile = pitch_class_profile(beats, notes, share).where("weight > 0")
    w = Window.partitionBy("file_id", "pc").orderBy("beat")
    shared = F.when(F.lag("beat").over(w) == F.col("beat") - 1, F.col("weight") * F.lag("weight").over(w))
    size = profile.withColumn("both", shared).groupBy("file_id", "beat").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("size"), F.coalesce(F.sum("both"), F.lit(0.0)).alias("dot"))
    every = beats.select("file_id", "beat").join(size, ["file_id", "beat"], "left")
    before = F.lag("size").over(Window.partitionBy("file_id").orderBy("beat"))
    return every.withColumn("before", before).select("file_id", "beat", F.coalesce(1 - F.col("dot") / (F.col("size") * F.col("before")), F.lit(0.0)).alias("change"))


def z_score(x: str) -> Column:
    """Within the file; 0 where all are equal."""
    deviation = F.stddev_pop(x).over(_file())
    return F.when(deviation > 1e-9, (F.col(x) - F.avg(x).over(_file())) / deviation).otherwise(F.lit(0.0))


def beat_salience(beats: DataFrame, notes: DataFrame, share: float = 0.15) -> DataFrame:
    """file_id, beat, salience: how much each beat looks like a bar's first, by the z-scores of its
    notes, held notes, bass and harmonic change."""
    middle = notes.groupBy("file_id").agg(F.percentile("pitch", F.lit(0.5)).alias("middle"))
    x = notes_of_beats(beats, notes, share).join(harmonic_change(beats, notes, share), ["file_id", "beat"]).join(middle, "file_id", "left")
    bass = F.coalesce(F.least(F.greatest(F.col("middle") - F.col("low"), F.lit(0.0)), F.lit(36.0)) / 12, F.lit(0.0))
    x = x.select("file_id", "beat", F.log1p("n_notes").alias("notes"), F.log1p("held").alias("held"), bass.alias("bass"), "change")
    return x.select("file_id", "beat", (z_score("notes") + z_score("held") + z_score("bass") + z_score("change")).alias("salience"))
