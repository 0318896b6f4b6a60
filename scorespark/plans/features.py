"""The feature table: every input column of a note, from times, pitches and a beat grid.

One shuffle by file carries the plan. Notes (an onset and a release row each) and beats
are merged in one ordered pass, which gives beat positions and the count of releases
so far. Chords are then folded into one row with their notes as an array (a chord lasts
35 ms, so the array is bounded by the keys there are); neighbours are read off that row by
``lag`` and ``lead``, windows are taken there, and the notes are exploded again. Nothing is joined.

Velocities are never read. Missing values are null. Files without a grid have null beat
columns; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import context, grid, grouping

#: Cumulative sets of column groups.
SETS = {"A": ["core"], "B": ["core", "note", "melodic", "local"], "C": ["core", "note", "melodic", "local", "poly"], "D": ["core", "note", "melodic", "local", "poly", "structure", "piece"]}


@dataclass(frozen=True)
class Settings:
    causal: bool = False
    tolerance_s: float = grouping.TOLERANCE_S
    seconds: tuple[float, ...] = (0.25, 0.5, 1.0, 3.0)
    beats: tuple[float, ...] = (1.0, 2.0, 4.0)
    nearest: tuple[int, ...] = (8, 32)
    beat_tolerance: float = 0.12
    rest_min_s: float = 0.2
    gap_beats: float = 1.5
    gap_min_s: float = 0.35
    piece: bool = True


def window_tags(s: Settings) -> list[tuple[str, float, str]]:
    """(tag, width, ordering column) of the time and beat windows."""
    name = lambda x: f"{x:g}".replace(".", "p")
    return [(f"win{name(w * 1000)}ms", w, "g_time") for w in s.seconds] + [(f"win{name(w)}b", w, "g_beat") for w in s.beats]


def _with_grid(c: DataFrame, beats: DataFrame) -> DataFrame:
    """c and on_b, off_b, seg (the onset's grid segment), released (releases up to the onset),
    tempo_mid (median tempo of the beats that the piece spans)."""
    w = Window.partitionBy("file_id").orderBy("beat")
    measure = F.sum((F.col("beat_in_bar") == 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    unit = F.col("beat_unit") if "beat_unit" in beats.columns else F.lit(4)
    own = F.struct("beat_in_bar", "beats_per_bar", unit.alias("beat_unit"), "tempo_bpm", measure.alias("measure"))
    b = grid.running_tempo(beats).withColumn("own", own)
    b = b.select("file_id", "beat", "time_s", "tempo_bpm", "own", F.lead("time_s").over(w).alias("next_s"), F.lead("own").over(w).alias("next"), F.lag("beat").over(w).isNull().alias("_first"))
    seg = F.struct(F.col("beat").cast("long").alias("beat"), "time_s", "next_s", "own", "next")
    b = b.select(
        "file_id",
        F.when(F.col("_first"), F.lit(float("-inf"))).otherwise(F.col("time_s")).alias("_t"),
        F.lit(-1).alias("_kind"),
        F.when(F.col("next_s").isNotNull(), seg).alias("_seg"),
        F.struct("time_s", "tempo_bpm").alias("_beat"),
    )
    spots = F.array(F.struct(F.lit(0).alias("_kind"), F.col("offset_s").alias("_t")), F.struct(F.lit(1).alias("_kind"), F.col("onset_s").alias("_t")))
    rows = c.select("*", F.explode(spots).alias("_x")).select(*c.columns, "_x._kind", "_x._t")
    merged = rows.unionByName(b, allowMissingColumns=True)
    so_far = Window.partitionBy("file_id").orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    file = Window.partitionBy("file_id")
    merged = merged.select(
        "*",
        F.last("_seg", ignorenulls=True).over(so_far).alias("seg"),
        F.sum((F.col("_kind") == 0).cast("int")).over(so_far).alias("released"),
        F.min("onset_s").over(file).alias("_begin"),
        F.max("offset_s").over(file).alias("_end"),
    )
    spanned = F.when((F.col("_beat.time_s") >= F.col("_begin")) & (F.col("_beat.time_s") <= F.col("_end")), F.col("_beat.tempo_bpm"))
    mid = lambda x: F.percentile(x, F.lit(0.5)).over(file)
    pos = F.col("seg.beat") + (F.col("_t") - F.col("seg.time_s")) / (F.col("seg.next_s") - F.col("seg.time_s"))
    merged = merged.select("*", F.coalesce(mid(spanned), mid(F.col("_beat.tempo_bpm"))).alias("tempo_mid"), pos.alias("_pos")).where("_kind >= 0")
    note = Window.partitionBy("file_id", "note_idx")
    both = merged.withColumn("off_b", F.max(F.when(F.col("_kind") == 0, F.col("_pos"))).over(note)).where("_kind = 1")
    return both.select(*c.columns, F.col("_pos").alias("on_b"), "off_b", "seg", "released", "tempo_mid")


def _beside(seg: Column, at: Column) -> Column:
    """Attributes of beat ``at``, which is a segment's own beat or the next; clamped."""
    return F.when(at > seg["beat"], seg["next"]).otherwise(seg["own"])


def _chords(n: DataFrame, s: Settings) -> DataFrame:
    """One row a chord, its notes an array in canonical order."""
    extra = [x for x in n.columns if x.startswith(("same_", "n_onsets"))] + [f"n{k}" for k in s.nearest]
    note = F.struct("note_idx", "note_id", "onset_s", "pitch", "dur_s", "on_b", "off_b", *extra)
    # one sort by chord, and the chord's first row stands for it: cheaper than an object aggregate
    w = Window.partitionBy("file_id", "group_id").orderBy("note_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    folded = {
        "g_time": F.min("onset_s"),
        "g_beat": F.min("on_b"),
        "seg": F.min_by("seg", "onset_s"),
        "released": F.min_by("released", "onset_s"),
        "first_idx": F.min("note_idx"),
        "n": F.count("*"),
        "p_sum": F.sum("pitch"),
        "p_sq": F.sum(F.col("pitch") * F.col("pitch")),
        "p_min": F.min("pitch"),
        "p_max": F.max("pitch"),
        "dur_sum": F.sum("dur_s"),
        "g_off": F.max("offset_s"),
        "notes": F.collect_list("_note"),
    }
    g = n.select("file_id", "group_id", "note_idx", "onset_s", "offset_s", "pitch", "dur_s", "on_b", "seg", "released", "tempo_mid", note.alias("_note"))
    g = g.select("file_id", "group_id", "note_idx", "tempo_mid", *(e.over(w).alias(k) for k, e in folded.items()))
    return g.where("note_idx = first_idx").drop("note_idx")


def _nearest(keys: Column, pitch: Column) -> Column:
    """The key of a neighbouring chord that is nearest in pitch; ties as in ``nearest_neighbours``."""
    rank = lambda y: F.struct(F.abs(y["pitch"] - pitch).alias("d"), y["pitch"].alias("p"), F.when(y["pitch"] < pitch, -y["note_idx"]).otherwise(y["note_idx"]).alias("i"), y.alias("key"))
    return F.array_min(F.transform(keys, rank))["key"]


def _chord_context(g: DataFrame, s: Settings) -> DataFrame:
    w = Window.partitionBy("file_id").orderBy("group_id")
    file, so_far = Window.partitionBy("file_id"), w.rowsBetween(Window.unboundedPreceding, 0)
    keys = F.transform("notes", lambda x: F.struct(x["pitch"].alias("pitch"), x["note_idx"].alias("note_idx"), x["dur_s"].alias("dur_s")))
    held = F.greatest(F.col("first_idx") - F.col("released"), F.lit(0))
    g = g.withColumn("_keys", keys).withColumn("held", held).withColumn("poly_sum", (F.col("held") + F.col("n")) * F.col("n"))
    g = g.select(
        "*",
        F.lag("_keys").over(w).alias("prev_keys"),
        (F.lit(None).cast(g.schema["_keys"].dataType) if s.causal else F.lead("_keys").over(w)).alias("next_keys"),
        (F.col("g_time") - F.lag("g_time").over(w)).alias("ioi_prev_s"),
        (F.col("g_beat") - F.lag("g_beat").over(w)).alias("ioi_prev_beats"),
        (F.lead("g_time").over(w) - F.col("g_time")).alias("ioi_next_s"),
        (F.lead("g_beat").over(w) - F.col("g_beat")).alias("ioi_next_beats"),
        F.avg("p_max").over(w.rowsBetween(-2, -1)).alias("_before"),
        F.avg("p_max").over(w.rowsBetween(1, 2)).alias("_after"),
        F.max("g_off").over(so_far).alias("sound_end"),
        F.sum("n").over(file).alias("_n"),
        F.count("*").over(file).alias("_chords"),
        F.sum("p_sum").over(file).alias("_p"),
        F.sum("p_sq").over(file).alias("_pp"),
        F.sum("poly_sum").over(file).alias("_poly"),
        F.min("g_time").over(file).alias("_begin"),
        F.max("g_time").over(file).alias("_last"),
        F.max("g_off").over(file).alias("_end"),
    )
    rest = F.coalesce(F.col("g_time") - F.lag("sound_end").over(w) >= s.rest_min_s, F.lit(True))
    gap = F.coalesce((F.col("ioi_prev_beats") >= s.gap_beats) & (F.col("ioi_prev_s") >= s.gap_min_s), F.lit(False))
    g = g.withColumn("_rest", rest).withColumn("_phrase", F.col("_rest") | gap)
    g = g.withColumn("rest_seg", F.sum(F.col("_rest").cast("int")).over(so_far)).withColumn("phrase_seg", F.sum(F.col("_phrase").cast("int")).over(so_far))
    in_rest, in_phrase = Window.partitionBy("file_id", "rest_seg"), Window.partitionBy("file_id", "phrase_seg")
    g = g.select(
        "*",
        (F.col("g_time") - F.min("g_time").over(in_rest)).alias("time_since_rest_s"),
        (F.max("sound_end").over(in_rest) - F.col("g_time")).alias("time_to_rest_s"),
        (F.col("g_beat") - F.min("g_beat").over(in_phrase)).alias("time_since_phrase_start_beats"),
        (F.max("g_beat").over(in_phrase) - F.col("g_beat")).alias("time_to_phrase_end_beats"),
        F.min("first_idx").over(in_phrase).alias("_ph_first"),
        F.max(F.col("first_idx") + F.col("n")).over(in_phrase).alias("_ph_end"),
    )
    over = []
    for tag, width, order in window_tags(s):
        low, high = f"{width}D preceding", "current row" if s.causal else f"{width}D following"
        f = lambda x, o=order, a=low, z=high: context._range(x, o, a, z)
        total, n = F.lit(width if s.causal else 2 * width), f("sum(n)")
        over += [
            (n / total).alias(f"{tag}_note_density"),
            (f("count(1)") / total).alias(f"{tag}_onset_density"),
            (f("sum(p_sum)") / n).alias(f"{tag}_mean_pitch"),
            (f("max(p_max)") - f("min(p_min)")).alias(f"{tag}_pitch_range"),
            (f("sum(dur_sum)") / n).alias(f"{tag}_mean_dur"),
            (f("sum(poly_sum)") / n).alias(f"{tag}_mean_polyphony"),
        ]
    return context.prev_next_beat_counts(g.select("*", *over))


def feature_columns(s: Settings) -> dict[str, dict[str, Column]]:
    """Column group -> name -> expression over a chord row with one of its notes, x."""
    c, p = F.col, F.col("x.pitch")
    beat, frac = c("g_beat"), c("g_beat") - F.floor("g_beat")
    here, near = _beside(c("seg"), F.floor("g_beat")), _beside(c("seg"), F.rint("g_beat"))
    level = scalar.metrical_level(beat, near["beat_in_bar"], near["beats_per_bar"], s.beat_tolerance)
    level = F.when(beat.isNotNull(), level)
    place, bar = here["beat_in_bar"] + frac, here["beats_per_bar"].cast("double")
    before, after = p - c("_prev.pitch"), c("_next.pitch") - p
    sign = lambda x: F.coalesce(F.signum(x), F.lit(0.0))
    flag = lambda x: F.coalesce(x, F.lit(False))
    span, top, bottom = c("p_max") - c("p_min"), c("first_idx") + c("n") - 1 - c("x.note_idx"), c("x.note_idx") - c("first_idx")
    since, length = c("time_since_phrase_start_beats"), c("time_since_phrase_start_beats") + c("time_to_phrase_end_beats")
    seconds = F.greatest(c("_end") - c("_begin"), F.lit(1e-3))
    mean, n = c("_p") / c("_n"), c("_n")
    out: dict[str, dict[str, Column]] = {
        "core": {
            "pitch": p, "pitch_class": p % 12, "octave": F.floor(p / 12) - 1, "beat_in_measure": place, "beat_in_measure_norm": place / bar, "beat_frac": frac,
            "metrical_level": level, "on_beat": F.abs(beat - F.rint(beat)) <= s.beat_tolerance, "strong_beat": level <= 1, "is_downbeat": level == 0,
        },
        "note": {
            "dur_s": c("x.dur_s"), "dur_beats": F.greatest(c("x.off_b") - c("x.on_b"), F.when(beat.isNotNull(), F.lit(0.0))), "onset_beat": beat, "beat_index": F.floor(beat),
            "local_tempo_bpm": here["tempo_bpm"], "ts_num": bar, "ts_den": here["beat_unit"],
        },
        "melodic": {
            "prev_interval": before, "abs_prev_interval": F.abs(before), "ioi_prev_s": c("ioi_prev_s"), "ioi_prev_beats": c("ioi_prev_beats"), "prev_dur_s": c("_prev.dur_s"),
            "dur_ratio_prev": F.log2((c("x.dur_s") + 0.01) / (c("_prev.dur_s") + 0.01)),
        },
        "poly": {
            "chord_size": c("n"), "n_onsets_within_tol": c("x.n_onsets_within_tol"), "held_notes_at_onset": c("held"), "polyphony_at_onset": c("held") + c("n"),
            "chord_highest": c("p_max"), "chord_lowest": c("p_min"), "chord_span": span, "chord_pos_norm": F.try_divide((p - c("p_min")).cast("double"), span.cast("double")),
            "dist_from_chord_top": c("p_max") - p, "dist_from_chord_bottom": p - c("p_min"), "chord_rank_from_top": top, "chord_rank_from_bottom": bottom,
            "is_chord_top": top == 0, "is_chord_bottom": bottom == 0,
        },
        "local": {},
        "structure": {"measure_number": here["measure"], "time_since_rest_s": c("time_since_rest_s"), "time_since_phrase_start_beats": since, "notes_since_phrase_start": c("x.note_idx") - c("_ph_first")},
        "piece": {},
    }
    melodic, local, poly, structure = out["melodic"], out["local"], out["poly"], out["structure"]
    if s.causal:
        melodic |= {"melodic_direction": sign(before), "top_line_trend": c("p_max") - c("_before")}
    else:
        melodic |= {
            "next_interval": after, "abs_next_interval": F.abs(after), "ioi_next_s": c("ioi_next_s"), "ioi_next_beats": c("ioi_next_beats"), "next_dur_s": c("_next.dur_s"),
            "melodic_direction": sign(before) + sign(after), "is_local_peak": flag((before > 0) & (after < 0)), "is_local_trough": flag((before < 0) & (after > 0)),
            "top_line_trend": c("_after") - c("_before"),
        }
    melodic["same_pitch_prev_dt"] = c("x.same_pitch_prev_dt")
    if not s.causal:
        melodic["same_pitch_next_dt"] = c("x.same_pitch_next_dt")
    for tag, _, _ in window_tags(s):
        local |= {f"{tag}_{k}": c(f"{tag}_{k}") for k in ("note_density", "onset_density", "mean_pitch")}
        local |= {f"{tag}_pitch_rel_mean": p - c(f"{tag}_mean_pitch"), f"{tag}_pitch_range": c(f"{tag}_pitch_range"), f"{tag}_mean_dur": c(f"{tag}_mean_dur")}
        poly[f"{tag}_mean_polyphony"] = c(f"{tag}_mean_polyphony")
    local["notes_in_prev_beat"] = c("notes_in_prev_beat")
    if not s.causal:
        local["notes_in_next_beat"] = c("notes_in_next_beat")
    for k in s.nearest:
        melodic |= {f"n{k}_{x}": c(f"x.n{k}.{x}") for x in ("pitch_rel_median", "pitch_rel_mean")}
        local |= {f"n{k}_{x}": c(f"x.n{k}.{x}") for x in ("pitch_range", "pitch_pct", "time_per_note")}
    if not s.causal:
        structure |= {
            "time_to_rest_s": c("time_to_rest_s"), "phrase_pos_norm": F.try_divide(since, length), "time_to_phrase_end_beats": c("time_to_phrase_end_beats"), "phrase_length_beats": length,
            "notes_to_phrase_end": c("_ph_end") - 1 - c("x.note_idx"), "rel_position": (c("g_time") - c("_begin")) / F.greatest(c("_last") - c("_begin"), F.lit(1e-6)),
        }
        if s.piece:
            out["piece"] = {
                "piece_duration_s": seconds, "piece_note_rate": n / seconds, "piece_mean_pitch": mean, "piece_pitch_std": F.sqrt((n * c("_pp") - c("_p") * c("_p")).cast("double")) / n,
                "piece_mean_polyphony": c("_poly") / n, "piece_mean_chord_size": n / c("_chords"), "piece_median_tempo_bpm": c("tempo_mid"), "pitch_rel_piece_mean": p - mean,
            }
    return out


def feature_names(s: Settings = Settings(), feature_set: str = "D") -> list[str]:
    """Names of a set's columns. Needs a running session, as the expressions do."""
    found = feature_columns(s)
    return [name for g in SETS[feature_set] for name in found[g]]


def feature_table(notes: DataFrame, beats: DataFrame, s: Settings = Settings(), feature_set: str = "D") -> DataFrame:
    """file_id, note_id, note_idx, group_id, onset_s, group_time_s and the set's columns, as floats.
    notes: file_id, note_id, onset_s, offset_s, pitch; beats: file_id, beat, time_s,
    beat_in_bar, beats_per_bar and, if it isn't 4, beat_unit."""
    cols = [F.col(x) for x in ("file_id", "note_id", "onset_s")] + [F.greatest("offset_s", "onset_s").alias("offset_s"), F.col("pitch").cast("int").alias("pitch")]
    c = _with_grid(grouping.canonical(notes.select(*cols), s.tolerance_s), beats)
    n = context.onsets_within(grouping.same_pitch_gaps(c), s.tolerance_s).withColumn("g_time", F.min("onset_s").over(Window.partitionBy("file_id", "group_id")))
    for k in s.nearest:
        stats = ("pitch_rel_median", "pitch_rel_mean", "pitch_range", "pitch_pct", "time_per_note")
        n = context.nearest_notes(n, k, s.causal).withColumn(f"n{k}", F.struct(*stats)).drop(*stats)
    g = _chord_context(_chords(n, s), s)
    x = g.select("*", F.explode("notes").alias("x")).drop("notes", "_keys")
    x = x.withColumn("_prev", _nearest(F.col("prev_keys"), F.col("x.pitch"))).withColumn("_next", _nearest(F.col("next_keys"), F.col("x.pitch")))
    found = feature_columns(s)
    chosen = [e.cast("float").alias(name) for group in SETS[feature_set] for name, e in found[group].items()]
    return x.select("file_id", "x.note_id", "x.note_idx", "group_id", "x.onset_s", F.col("g_time").alias("group_time_s"), *chosen)
