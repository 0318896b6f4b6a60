"""Messages to notes, tempo maps, beat grids and positions on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pair_notes(messages: DataFrame, drums: bool = False) -> DataFrame:
    """Note rows from messages. Any later event of the same key closes a note, so one
    ``lead`` finds its end; a note that nothing closes ends with its track."""
    track = Window.partitionBy("file_id", "track")
    key = Window.partitionBy("file_id", "track", "channel", "pitch").orderBy("msg_index")
    tagged = messages.withColumn("track_end", F.max("tick").over(track)).where("msg_type in ('note_on', 'note_off')")
    if not drums:
        tagged = tagged.where("channel <> 9")
    opens = (F.col("msg_type") == "note_on") & (F.col("velocity") > 0)
    n = tagged.withColumn("opens", opens)
    n = n.withColumn("next_tick", F.lead("tick").over(key)).withColumn("next_opens", F.lead("opens").over(key)).withColumn("next_index", F.lead("msg_index").over(key))
    return n.where("opens").select(
        "file_id", "track", "channel", "pitch", "velocity", "msg_index",
        F.col("tick").alias("onset_tick"),
        F.greatest(F.coalesce("next_tick", "track_end"), F.col("tick")).alias("offset_tick"),
        F.when(F.col("next_opens") == False, F.col("next_index")).otherwise(F.lit(-1)).cast("long").alias("off_msg_index"),  # noqa: E712
    )


def tempo_map(messages: DataFrame, ticks_per_beat: int = 480) -> DataFrame:
    """file_id, tick, tempo_us, next_tick, micro_ticks: exact seconds at ``tick`` are
    micro_ticks / (10**6 * ticks_per_beat). The last tempo at a tick counts; 500000 holds
    from tick 0 if none is given there."""
    given = messages.where("msg_type = 'set_tempo' and tempo_us > 0").groupBy("file_id", "tick").agg(F.max_by("tempo_us", F.struct("track", "msg_index")).alias("tempo_us"))
    default = messages.select("file_id").distinct().select("file_id", F.lit(0).cast("long").alias("tick"), F.lit(500000).alias("tempo_us")).join(given.where("tick = 0").select("file_id"), "file_id", "left_anti")
    w = Window.partitionBy("file_id").orderBy("tick")
    all_ = given.unionByName(default)
    step = (F.col("tick") - F.lag("tick").over(w)) * F.lag("tempo_us").over(w)
    return all_.select("*", F.lead("tick").over(w).alias("next_tick"), F.coalesce(step, F.lit(0)).cast("long").alias("_step")).withColumn(
        "micro_ticks", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("_step")


def to_seconds(points: DataFrame, tempos: DataFrame, tick: str = "tick", ticks_per_beat: int = 480) -> DataFrame:
    """As-of join, backward and inclusive: adds seconds. The sort-based form needs no
    broadcast: points and tempo changes are merged by one ordered window a file."""
    w = Window.partitionBy("file_id").orderBy("_tick", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    cols = points.columns
    a = points.select(F.struct(*cols).alias("_row"), "file_id", F.col(tick).alias("_tick"), F.lit(1).alias("_kind"), F.lit(None).cast("struct<t:bigint,us:int,at:bigint>").alias("_seg"))
    b = tempos.select(F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), "file_id", F.col("tick").alias("_tick"), F.lit(0).alias("_kind"), F.struct(F.col("tick").alias("t"), F.col("tempo_us").alias("us"), F.col("micro_ticks").alias("at")).alias("_seg"))
    seg = F.last("_seg", ignorenulls=True).over(w)
    out = a.unionByName(b).withColumn("_s", seg).where("_kind = 1")
    exact = F.col("_s.at") + (F.col("_tick") - F.col("_s.t")) * F.col("_s.us")
    return out.select("_row.*", (exact / F.lit(1e6 * ticks_per_beat)).alias("seconds"))


def beat_grid(signatures: DataFrame, ends: DataFrame, ticks_per_beat: int = 480) -> DataFrame:
    """signatures: file_id, tick, num, den; ends: file_id, end_tick. Beats of every segment
    up to the next signature; the last runs one bar beyond the end."""
    w = Window.partitionBy("file_id").orderBy("tick")
    step = F.lit(ticks_per_beat * 4) / F.col("den")
    s = signatures.join(ends, "file_id").withColumn("step", step).withColumn("seg_end", F.coalesce(F.lead("tick").over(w).cast("double"), F.col("end_tick") + F.col("step") * F.col("num")))
    s = s.withColumn("n", F.ceil((F.col("seg_end") - F.lit(1e-9) - F.col("tick")) / F.col("step")).cast("int")).where("n > 0")
    k = s.select("file_id", "num", "den", "tick", "step", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    k = k.withColumn("beat_tick", F.col("tick") + F.col("k") * F.col("step"))
    order = Window.partitionBy("file_id").orderBy("beat_tick")
    bib = F.col("k") % F.col("num")
    return k.select("file_id", (F.row_number().over(order) - 1).alias("beat"), "beat_tick", bib.alias("beat_in_bar"), F.col("num").alias("beats_per_bar"), F.col("den").alias("beat_unit"), F.sum((bib == 0).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("measure_index"))


def running_tempo(beats: DataFrame) -> DataFrame:
    """tempo_bpm = 60 / running median of five intervals, the ends repeated."""
    w = Window.partitionBy("file_id").orderBy("beat")
    n = Window.partitionBy("file_id")
    ibi = F.lead("time_s").over(w) - F.col("time_s")
    b = beats.withColumn("_ibi", F.coalesce(ibi, F.col("time_s") - F.lag("time_s").over(w)))
    first, last = F.first("_ibi").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.last("_ibi").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    b = b.select("*", F.collect_list("_ibi").over(w.rowsBetween(-2, 2)).alias("_win"), first.alias("_first"), last.alias("_last"), (F.row_number().over(w) - 1).alias("_i"), F.count("*").over(n).alias("_n"))
    pad = lambda x, k: F.when(k > 0, F.array_repeat(x, k.cast("int"))).otherwise(F.array().cast("array<double>"))
    full = F.concat(pad("_first", F.lit(2) - F.col("_i")), F.col("_win"), pad("_last", F.col("_i") + 3 - F.col("_n")))
    return b.select(*beats.columns, (F.lit(60.0) / F.element_at(F.array_sort(full), 3)).alias("tempo_bpm"))


def _segments(beats: DataFrame) -> DataFrame:
    """Grid segments with their neighbours' times; the outer ones are open."""
    w = Window.partitionBy("file_id").orderBy("beat")
    s = beats.select("file_id", "beat", "time_s", F.lead("time_s").over(w).alias("next_s"), F.lag("beat").over(w).isNull().alias("is_first"))
    s = s.where("next_s is not null").withColumn("is_last", F.lead("beat").over(w).isNull())
    return s


def time_to_beat(points: DataFrame, beats: DataFrame, time: str = "time", out: str = "beat_pos") -> DataFrame:
    """Linear interpolation on the grid, extrapolated at both ends. Points and beats are
    merged in one ordered window a file (no range join, no broadcast)."""
    seg = _segments(beats).select("file_id", F.struct("beat", "time_s", "next_s").alias("s"), F.when(F.col("is_first"), F.lit(float("-inf"))).otherwise(F.col("time_s")).alias("_t"))
    a = points.select("file_id", F.struct(*points.columns).alias("_row"), F.col(time).alias("_t"), F.lit(1).alias("_kind"))
    b = seg.select("file_id", F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), "_t", F.lit(0).alias("_kind"), "s")
    both = a.withColumn("s", F.lit(None).cast(seg.schema["s"].dataType)).unionByName(b)
    w = Window.partitionBy("file_id").orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    got = both.withColumn("_s", F.last("s", ignorenulls=True).over(w)).where("_kind = 1")
    return got.select("_row.*", (F.col("_s.beat") + (F.col("_t") - F.col("_s.time_s")) / (F.col("_s.next_s") - F.col("_s.time_s"))).alias(out))


def beat_to_time(points: DataFrame, beats: DataFrame, beat: str = "beat_pos", out: str = "time") -> DataFrame:
    """The inverse: the segment is floor(beat), clamped, so it is an equi-join."""
    seg = _segments(beats).select("file_id", F.col("beat").alias("_b"), "time_s", "next_s")
    last = beats.groupBy("file_id").agg((F.max("beat") - 1).alias("_max"))
    p = points.join(last, "file_id").withColumn("_b", F.greatest(F.lit(0), F.least(F.floor(F.col(beat)), F.col("_max"))).cast("int"))
    return p.join(seg, ["file_id", "_b"]).select(*points.columns, (F.col("time_s") + (F.col(beat) - F.col("_b")) * (F.col("next_s") - F.col("time_s"))).alias(out))


def smooth_beats(beats: DataFrame, half: int) -> DataFrame:
    """Local straight-line fit over ``half`` beats on either side; the raw grid for a file
    whose fit would not ascend."""
    w = Window.partitionBy("file_id").orderBy("beat")
    f = w.rowsBetween(-half, half)
    n, sx, sy = F.count("*").over(f), F.sum("beat").over(f), F.sum("time_s").over(f)
    sxx, sxy = F.sum(F.col("beat") * F.col("beat")).over(f), F.sum(F.col("beat") * F.col("time_s")).over(f)
    slope = (n * sxy - sx * sy) / (n * sxx - sx * sx)
    fit = beats.withColumn("_fit", slope * F.col("beat") + (sy - slope * sx) / n)
    fit = fit.withColumn("_d", F.col("_fit") - F.lag("_fit").over(w))
    ok = F.coalesce(F.min("_d").over(Window.partitionBy("file_id")) > 0, F.lit(True)) & (F.count("*").over(Window.partitionBy("file_id")) >= 3)
    return fit.select(*beats.columns, F.when(ok, F.col("_fit")).otherwise(F.col("time_s")).alias("smooth_s"))


def snap_per_beat(points: DataFrame, beat: str, steps: list[int], cost: float) -> DataFrame:
    """All points of a beat snap to one subdivision: the first, unless another's squared
    error is lower by more than ``cost``. Ties go to the earlier one."""
    w = Window.partitionBy("file_id", F.floor(beat))
    snaps = [F.rint(F.col(beat) * s) / F.lit(float(s)) for s in steps]
    errs = [F.sum((x - F.col(beat)) * (x - F.col(beat))).over(w) for x in snaps]
    tagged = points.select("*", *(e.alias(f"_e{i}") for i, e in enumerate(errs)), *(x.alias(f"_q{i}") for i, x in enumerate(snaps)))
    best, err = F.col("_q0"), F.col("_e0")
    for i in range(1, len(steps)):
        e = F.col(f"_e{i}") + F.lit(cost)
        best, err = F.when(e < err, F.col(f"_q{i}")).otherwise(best), F.least(err, e)
    return tagged.select(*points.columns, best.alias("snapped"))


def same_key_consistent(notes: DataFrame) -> DataFrame:
    """Onsets of a key ascend strictly; a note ends before the next one begins."""
    key = Window.partitionBy("file_id", "track", "channel", "pitch").orderBy("note_id")
    j = F.row_number().over(key) - 1
    t = notes.withColumn("_j", j)
    t = t.withColumn("_on", F.max(F.col("onset_tick") - F.col("_j")).over(key.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_j"))
    t = t.withColumn("_next", F.lead("_on").over(key))
    off = F.greatest(F.col("offset_tick"), F.col("_on") + 1)
    return t.select(*[c for c in notes.columns if c not in ("onset_tick", "offset_tick")], F.col("_on").alias("onset_tick"), F.when(F.col("_next").isNull(), off).otherwise(F.least(off, F.col("_next"))).alias("offset_tick"))


def looks_quantized(notes: DataFrame, ticks_per_beat: int = 480, share: float = 0.8) -> DataFrame:
    tol = max(1, ticks_per_beat // 240)

    def near(step):
        r = F.col("onset_tick") % step
        return F.least(r, F.lit(step) - r) <= tol

    hit = F.sum((near(ticks_per_beat // 4) | near(ticks_per_beat // 3)).cast("int"))
    return notes.groupBy("file_id").agg(F.count("*").alias("n"), hit.alias("n_on_grid")).withColumn("looks_quantized", (F.col("n") >= 8) & (F.col("n_on_grid") >= F.lit(share) * F.col("n")))


#: A grid has no more beats than this.
MAX_BEATS = 500_000


def to_ticks(points: DataFrame, tempos: DataFrame, seconds: str = "seconds", ticks_per_beat: int = 480) -> DataFrame:
    """The inverse of ``to_seconds``: adds tick, a double; times before 0 extrapolate."""
    per_second = F.lit(1e6 * ticks_per_beat)
    cols = points.columns
    a = points.select("file_id", F.struct(*cols).alias("_row"), F.col(seconds).alias("_t"), F.lit(1).alias("_kind"))
    seg = F.struct(F.col("tick").alias("t"), F.col("tempo_us").alias("us"), (F.col("micro_ticks") / per_second).alias("at"))
    begin = F.when(F.col("tick") == F.min("tick").over(Window.partitionBy("file_id")), F.lit(float("-inf"))).otherwise(F.col("micro_ticks") / per_second)
    b = tempos.select("file_id", begin.alias("_t"), F.lit(0).alias("_kind"), seg.alias("_seg"))
    # of changes at one time the one at the latest tick holds
    w = Window.partitionBy("file_id").orderBy("_t", "_kind", F.col("_seg.t")).rowsBetween(Window.unboundedPreceding, 0)
    got = a.unionByName(b, allowMissingColumns=True).withColumn("_s", F.last("_seg", ignorenulls=True).over(w)).where("_kind = 1")
    return got.select("_row.*", (F.col("_s.t") + (F.col("_t") - F.col("_s.at")) * per_second / F.col("_s.us")).alias("tick"))


def regular_grid(spans: DataFrame, bpm: float, beats_per_bar: int = 4) -> DataFrame:
    """Beats at one tempo from t_start until t_end is reached. spans: file_id, t_start, t_end."""
    # not times bpm/60: that quotient is rounded, and a span of whole beats would get one more
    many = F.ceil((F.col("t_end") - F.col("t_start")) * F.lit(float(bpm)) / F.lit(60.0))
    n = F.least(F.lit(MAX_BEATS), F.greatest(F.lit(2), many + 1)).cast("int")
    beat = spans.select("file_id", "t_start", F.explode(F.sequence(F.lit(0), n - 1)).alias("beat"))
    return beat.select("file_id", "beat", (F.col("t_start") + F.col("beat") * F.lit(60.0 / bpm)).alias("time_s"), (F.col("beat") % beats_per_bar).cast("int").alias("beat_in_bar"), F.lit(beats_per_bar).alias("beats_per_bar"))


def spans_of(notes: DataFrame) -> DataFrame:
    """What a grid has to cover: from 0 or the first onset, if that is before, to a second after
    the last release."""
    return notes.groupBy("file_id").agg(F.least(F.lit(0.0), F.min("onset_s")).alias("t_start"), (F.max("offset_s") + 1.0).alias("t_end"))


def extend_grid(beats: DataFrame, spans: DataFrame) -> DataFrame:
    """Beats are added on both sides at the median length of the outer four (0.05 s at least)
    until the grid covers t_start to t_end; bars go on in the outer meters. Beats are numbered
    anew from 0. beats: file_id, beat, time_s and any of beat_in_bar, beats_per_bar, beat_unit."""
    up, down = Window.partitionBy("file_id").orderBy("beat"), Window.partitionBy("file_id").orderBy(F.col("beat").desc())
    step = F.col("time_s") - F.lag("time_s").over(up)
    b = beats.select("*", step.alias("_step"), F.row_number().over(up).alias("_up"), F.row_number().over(down).alias("_down"))
    at = lambda which, k: F.max(F.when(F.col(which) == 1, F.struct(*beats.columns))).alias(k)
    edge = b.groupBy("file_id").agg(
        at("_up", "first"),
        at("_down", "last"),
        F.greatest(F.percentile(F.when(F.col("_up") <= 5, F.col("_step")), F.lit(0.5)), F.lit(0.05)).alias("ibi0"),
        F.greatest(F.percentile(F.when(F.col("_down") <= 4, F.col("_step")), F.lit(0.5)), F.lit(0.05)).alias("ibi1"),
        F.count("*").alias("n"),
    )
    e = edge.join(spans, "file_id")
    many = lambda gap, ibi: F.greatest(F.lit(0), F.ceil(gap / ibi))
    e = e.withColumn("before", F.least(many(F.col("first.time_s") - F.col("t_start"), F.col("ibi0")), F.lit(MAX_BEATS)))
    e = e.withColumn("after", F.greatest(F.lit(0), F.least(many(F.col("t_end") - F.col("last.time_s"), F.col("ibi1")), MAX_BEATS - F.col("n") - F.col("before"))))

    def added(edge_name: str, count: str, ibi: str, sign: int) -> DataFrame:
        k = e.where(F.col(count) > 0).select("*", F.explode(F.sequence(F.lit(1), F.col(count).cast("int"))).alias("k"))
        value = {c: F.col(f"{edge_name}.{c}") for c in beats.columns}
        value["file_id"], value["beat"] = F.col("file_id"), (F.col(f"{edge_name}.beat") + sign * F.col("k")).cast(beats.schema["beat"].dataType)
        value["time_s"] = F.col(f"{edge_name}.time_s") + sign * F.col("k") * F.col(ibi)
        if "beat_in_bar" in value:
            value["beat_in_bar"] = F.pmod(F.col(f"{edge_name}.beat_in_bar") + sign * F.col("k"), F.col(f"{edge_name}.beats_per_bar")).cast(beats.schema["beat_in_bar"].dataType)
        return k.select(*(x.alias(c) for c, x in value.items()))

    every = beats.unionByName(added("first", "before", "ibi0", -1)).unionByName(added("last", "after", "ibi1", 1))
    return every.withColumn("beat", (F.row_number().over(up) - 1).cast(beats.schema["beat"].dataType)).select(beats.columns)


def usable_grid(beats: DataFrame, files: DataFrame) -> DataFrame:
    """Files whose grid has under two beats get beats at 0 and 1 s in 4/4; no grid has over
    ``MAX_BEATS``. beats: file_id, beat, time_s, beat_in_bar, beats_per_bar and maybe beat_unit."""
    n = beats.groupBy("file_id").agg(F.count("*").alias("n")).where("n >= 2").select("file_id")
    bare = files.select("file_id").distinct().join(n, "file_id", "left_anti")
    at = F.explode(F.array(F.lit(0), F.lit(1))).alias("_k")
    value = {"file_id": F.col("file_id"), "beat": F.col("_k"), "time_s": F.col("_k"), "beat_in_bar": F.col("_k"), "beats_per_bar": F.lit(4), "beat_unit": F.lit(4)}
    plain = bare.select("file_id", at).select(*(value[c].cast(beats.schema[c].dataType).alias(c) for c in beats.columns))
    return beats.where(F.col("beat") < MAX_BEATS).join(n, "file_id", "left_semi").select(beats.columns).unionByName(plain)
