"""Timing: a performance taken apart into a score and its deviations, and put together again.

A performance's tracked beats follow its rubato. Each chord's mean onset is snapped to a
subdivision of its beat, which gives the score position of all its notes; releases are snapped
note by note. Deviations are measured from the beats smoothed over ``reference`` beats on either
side; the score lies on those smoothed over ``score``. Features are taken from the score alone.

Everything is declared on DataFrames and keyed by file_id and note_id: files are independent, and
the only shuffles are by file.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import grid, grouping
from ..sources import smf
from . import features


@dataclass(frozen=True)
class TimingSettings:
    """Fixed values, so that the same scores are found."""

    subdivisions: tuple[int, ...] = (4, 3)
    switch_cost: float = 0.01
    reference: int = 2
    score: int = 8
    tolerance_s: float = grouping.TOLERANCE_S
    quantized_share: float = 0.8


def snap_groups(notes: DataFrame, beats: DataFrame, s: TimingSettings = TimingSettings()) -> DataFrame:
    """file_id, note_id, group_id, onset_beat: the score position of each note, that of its chord's
    mean onset. notes: file_id, note_id, onset_s."""
    pitch = F.lit(0).alias("pitch")  # chords are told by onsets alone
    g = grouping.anchored_groups(notes.select("file_id", "note_id", "onset_s", pitch), s.tolerance_s)
    mean = g.groupBy("file_id", "group_id").agg(F.avg("onset_s").alias("time"))
    snapped = grid.snap_per_beat(grid.time_to_beat(mean, beats), "beat_pos", list(s.subdivisions), s.switch_cost)
    return g.join(snapped.select("file_id", "group_id", F.col("snapped").alias("onset_beat")), ["file_id", "group_id"]).select("file_id", "note_id", "group_id", "onset_beat")


def snap_releases(notes: DataFrame, beats: DataFrame, s: TimingSettings = TimingSettings()) -> DataFrame:
    """file_id, note_id, release_beat: each release by itself."""
    at = grid.time_to_beat(notes.select("file_id", "note_id", F.col("offset_s").alias("time")), beats)
    return grid.snap_per_beat(at, "beat_pos", list(s.subdivisions), s.switch_cost).select("file_id", "note_id", F.col("snapped").alias("release_beat"))


def smoothed(beats: DataFrame, half: int) -> DataFrame:
    """The same beats at smoothed times."""
    return grid.smooth_beats(beats, half).withColumn("time_s", F.col("smooth_s")).drop("smooth_s")


def reconstruct_score(notes: DataFrame, beats: DataFrame, s: TimingSettings = TimingSettings()) -> DataFrame:
    """notes with onset_beat, offset_beat (a step after it at least), score_onset_s, score_offset_s
    and ref_time_s. notes: file_id, note_id, onset_s, offset_s and more; beats: the raw grid."""
    placed = snap_groups(notes, beats, s).join(snap_releases(notes, beats, s), ["file_id", "note_id"])
    placed = placed.withColumn("offset_beat", F.greatest("release_beat", F.col("onset_beat") + F.lit(1.0 / max(s.subdivisions)))).drop("release_beat")
    score = smoothed(beats, s.score)
    timed = grid.beat_to_time(placed, score, "onset_beat", "score_onset_s")
    timed = grid.beat_to_time(timed, score, "offset_beat", "score_offset_s")
    timed = grid.beat_to_time(timed, smoothed(beats, s.reference), "onset_beat", "ref_time_s")
    return notes.join(timed.drop("group_id"), ["file_id", "note_id"])


def timing_targets(score: DataFrame) -> DataFrame:
    """file_id, note_id, score_beat, perf_onset_s, ref_time_s, offset_ms (float) of a reconstructed
    score."""
    offset = ((F.col("onset_s") - F.col("ref_time_s")) * 1000.0).cast("float")
    return score.select("file_id", "note_id", F.col("onset_beat").alias("score_beat"), F.col("onset_s").alias("perf_onset_s"), "ref_time_s", offset.alias("offset_ms"))


def featurize_performance(notes: DataFrame, beats: DataFrame, s: TimingSettings = TimingSettings(), f: features.Settings = features.Settings(), feature_set: str = "D") -> DataFrame:
    """Feature columns of the score, and the targets beside them."""
    score = reconstruct_score(notes, beats, s)
    written = score.select("file_id", "note_id", F.col("score_onset_s").alias("onset_s"), F.col("score_offset_s").alias("offset_s"), "pitch")
    return features.feature_table(written, smoothed(beats, s.score), f, feature_set).join(timing_targets(score), ["file_id", "note_id"])


def snapped_notes(notes: DataFrame, beats: DataFrame, s: TimingSettings = TimingSettings()) -> DataFrame:
    """notes moved to the nearest subdivisions of their own grid, chord by chord."""
    placed = snap_groups(notes, beats, s).join(snap_releases(notes, beats, s), ["file_id", "note_id"])
    placed = placed.withColumn("offset_beat", F.greatest("release_beat", F.col("onset_beat") + F.lit(1.0 / max(s.subdivisions))))
    timed = grid.beat_to_time(grid.beat_to_time(placed, beats, "onset_beat", "_on"), beats, "offset_beat", "_off")
    moved = notes.join(timed.select("file_id", "note_id", "_on", "_off"), ["file_id", "note_id"])
    return moved.withColumn("onset_s", F.col("_on")).withColumn("offset_s", F.col("_off")).select(notes.columns)


def featurize_quantized(notes: DataFrame, beats: DataFrame, snap: bool = False, s: TimingSettings = TimingSettings(), f: features.Settings = features.Settings(), feature_set: str = "D") -> DataFrame:
    """Feature columns of notes that are a score already, on its own grid."""
    return features.feature_table(snapped_notes(notes, beats, s) if snap else notes, beats, f, feature_set)


def featurize_for_humanizing(notes: DataFrame, written: DataFrame, tracked: DataFrame, quantized: DataFrame, snap: bool = False, s: TimingSettings = TimingSettings(), f: features.Settings = features.Settings(), feature_set: str = "D") -> DataFrame:
    """Files that lie on their own grid are scores on it; others are taken apart on the tracked
    beats. quantized: file_id, looks_quantized."""
    own = quantized.where("looks_quantized").select("file_id")
    a = featurize_quantized(notes.join(own, "file_id", "left_semi"), written.join(own, "file_id", "left_semi"), snap, s, f, feature_set)
    b = featurize_performance(notes.join(own, "file_id", "left_anti"), tracked.join(own, "file_id", "left_anti"), s, f, feature_set)
    return a.unionByName(b, allowMissingColumns=True)


def written_grid(messages: DataFrame, notes: DataFrame, ticks_per_beat: int = 480) -> DataFrame:
    """The beats that a file's time signatures and tempos give, extended over all its notes."""
    files = messages.select("file_id").distinct()
    given = messages.where("msg_type = 'time_signature' and num > 0 and den > 0").groupBy("file_id", "tick").agg(F.max_by(F.struct("num", "den"), F.struct("track", "msg_index")).alias("x"))
    given = given.select("file_id", "tick", "x.num", "x.den")
    bare = files.join(given.where("tick = 0").select("file_id"), "file_id", "left_anti").select("file_id", F.lit(0).cast("long").alias("tick"), F.lit(4).alias("num"), F.lit(4).alias("den"))
    ends = messages.groupBy("file_id").agg(F.max("tick").alias("end_tick"))
    raw = grid.beat_grid(given.unionByName(bare), ends, ticks_per_beat).withColumn("beat_tick", F.col("beat_tick").cast("double"))
    timed = grid.to_seconds(raw, grid.tempo_map(messages, ticks_per_beat), "beat_tick", ticks_per_beat).withColumnRenamed("seconds", "time_s")
    return grid.extend_grid(grid.usable_grid(timed.drop("beat_tick", "measure_index"), files), grid.spans_of(notes))


def timed_notes(messages: DataFrame, ticks_per_beat: int = 480) -> DataFrame:
    """file_id, note_id (in file order), onset_s, offset_s, pitch, velocity and the places of the
    messages, from message rows."""
    paired = grid.pair_notes(messages)
    tempos = grid.tempo_map(messages, ticks_per_beat)
    n = grid.to_seconds(paired, tempos, "onset_tick", ticks_per_beat).withColumnRenamed("seconds", "onset_s")
    n = grid.to_seconds(n, tempos, "offset_tick", ticks_per_beat).withColumnRenamed("seconds", "offset_s")
    order = Window.partitionBy("file_id").orderBy("onset_tick", "track", "msg_index")
    return n.withColumn("note_id", (F.row_number().over(order) - 1).cast("long"))


def featurize_midi(files: DataFrame, snap_steps: list[int] | None = None, f: features.Settings = features.Settings(), feature_set: str = "D") -> DataFrame:
    """MIDI files to feature columns in one call; files that can't be read have no rows.
    files: file_id, content. ``snap_steps``: onsets first go to the nearest of these subdivisions
    of a beat, and notes keep their lengths in beats. Files are taken together by their ticks a
    beat, of which there are few."""
    decoded = smf.messages(smf.decode_files(files))
    out = None
    for division in sorted(r[0] for r in decoded.select("division").distinct().collect()):
        messages = decoded.where(F.col("division") == division).drop("division")
        notes = timed_notes(messages, division)
        beats = written_grid(messages, notes, division)
        if snap_steps:
            at = grid.time_to_beat(notes.select("file_id", "note_id", "onset_s", "offset_s", "pitch"), beats, "onset_s", "on_b")
            at = grid.time_to_beat(at, beats, "offset_s", "off_b")
            at = at.withColumn("_new", scalar.snap_nearest(F.col("on_b"), snap_steps)).withColumn("_end", F.col("_new") + F.col("off_b") - F.col("on_b"))
            at = grid.beat_to_time(grid.beat_to_time(at, beats, "_new", "_on"), beats, "_end", "_off")
            notes = at.select("file_id", "note_id", F.col("_on").alias("onset_s"), F.col("_off").alias("offset_s"), "pitch")
        table = features.feature_table(notes, beats, f, feature_set)
        out = table if out is None else out.unionByName(table)
    if out is None:
        raise ValueError("no file could be read")
    return out


def retime(notes: DataFrame, tempos: DataFrame, ticks_per_beat: int = 480) -> DataFrame:
    """New onset and release ticks: each note begins at base_onset_s + offset_ms and keeps its
    performed length; of a key strikes keep their order and a release never cuts the next one
    short. notes: file_id, track, channel, pitch, note_id, onset_s, offset_s, base_onset_s,
    offset_ms and more, among it no tick columns."""
    extra = [c for c in notes.columns if c not in ("onset_tick", "offset_tick")]
    n = notes.select(extra).withColumn("_on", F.col("base_onset_s") + F.col("offset_ms") / 1000.0)
    n = n.withColumn("_off", F.col("_on") + (F.col("offset_s") - F.col("onset_s")))
    n = grid.to_ticks(n, tempos, "_on", ticks_per_beat).withColumnRenamed("tick", "_ont")
    n = grid.to_ticks(n, tempos, "_off", ticks_per_beat).withColumnRenamed("tick", "_offt")
    on = F.greatest(F.rint("_ont"), F.lit(0.0)).cast("long")
    n = n.withColumn("onset_tick", on).withColumn("offset_tick", F.greatest(F.rint("_offt").cast("long"), F.col("onset_tick") + 1))
    return grid.same_key_consistent(n.select(*extra, "onset_tick", "offset_tick"))


def warp_ticks(points: DataFrame, raw: DataFrame, score: DataFrame, tempos: DataFrame, ticks_per_beat: int = 480) -> DataFrame:
    """Adds new_tick: where other events of a performance go when its notes move to the score. Ticks
    to seconds, those to beats of the raw grid, back to seconds of the score's, and to ticks."""
    timed = grid.to_seconds(points, tempos, "tick", ticks_per_beat)
    there = grid.beat_to_time(grid.time_to_beat(timed, raw, "seconds", "_raw_beat"), score, "_raw_beat", "_score_s")
    back = grid.to_ticks(there.withColumnRenamed("tick", "_old"), tempos, "_score_s", ticks_per_beat)
    new = F.greatest(F.rint("tick"), F.lit(0.0)).cast("long").alias("new_tick")
    return back.select(*(F.col("_old").alias("tick") if c == "tick" else F.col(c) for c in points.columns), new)


def moves(messages: DataFrame, retimed: DataFrame, warped: DataFrame | None = None) -> DataFrame:
    """file_id, track, msg_index, new_tick for ``smf.retime``: the notes' starts and releases, and
    the other events where a warp is given."""
    place = ["file_id", "track", "msg_index"]
    starts = retimed.select(*place, F.col("onset_tick").alias("new_tick"))
    ends = retimed.where("off_msg_index >= 0").select("file_id", "track", F.col("off_msg_index").alias("msg_index"), F.col("offset_tick").alias("new_tick"))
    own = starts.unionByName(ends)
    if warped is None:
        return own
    return own.unionByName(warped.select(*place, "new_tick").join(own.select(place), place, "left_anti"))
