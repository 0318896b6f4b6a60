"""Queries of beats, onsets and timing, with their oracle SQL; registered with those of ``catalog``."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _query, _r
from .operators import grid, onsets, tracking
from .plans import timing
from .sources import adapters
from .sources.adapters import MIDI_EVENTS, NOTES, ORACLE_BEATS, ORACLE_NOTES, cte

_IBI = """ib as (select *, coalesce(lead(time_s) over (partition by file_id order by beat) - time_s, time_s - lag(time_s) over (partition by file_id order by beat)) as ibi from beats)"""
#: The beat nearest to each onset, the earlier of two.
_OWN = """own as (select n.file_id, n.note_id, n.onset_s, n.offset_s, n.pitch, min(row(abs(n.onset_s - b.time_s), b.beat))[2] as beat
 from notes n join beats b on b.file_id = n.file_id group by all)"""


@_query(
    """, f as (select file_id, cast(round_even(onset_s*50, 0) as bigint) as frame, ln(1 + sum(1 + least(offset_s - onset_s, 1))) as w from notes group by all),
k as (select d, exp(-cast(d*d as double)/2) / (1 + 2*(exp(-cast(0.5 as double)) + exp(-cast(2 as double)) + exp(-cast(4.5 as double)))) as share from range(-3, 4) t(d)),
n as (select file_id, cast(ceil((max(onset_s) + 2)*50) as bigint) + 1 as n_frames from notes group by file_id),
s as (select f.file_id, f.frame + k.d as frame, sum(f.w*k.share) as w from f, k group by all),
c as (select s.*, n.n_frames from s join n using (file_id) where frame >= 0 and frame < n_frames),
d as (select file_id, sqrt(sum(w*w)/max(n_frames) - (sum(w)/max(n_frames))*(sum(w)/max(n_frames))) as sd from c group by file_id)
select c.file_id, c.n_frames, c.frame, round(c.w/(d.sd + cast(0.000000001 as double)), 6) as strength from c join d using (file_id)""",
    cte("notes", NOTES),
)
def onset_strength(spark, d):
    s = onsets.onset_strength(adapters.notes(spark, d))
    return s.select("file_id", "n_frames", "frame", _r("strength").alias("strength"))


@_query(
    """, o as (select distinct file_id, onset_s as t from notes),
n as (select i.file_id, i.beat, i.time_s, i.ibi, min(row(abs(o.t - i.time_s), o.t))[2] as near from ib i left join o on o.file_id = i.file_id group by all),
m as (select *, case when abs(near - time_s) <= cast(0.15 as double)*ibi then near else time_s end as moved from n),
k as (select *, case when moved - lag(moved) over (partition by file_id order by beat) <= cast(0.001 as double) then time_s else moved end as kept from m),
z as (select *, kept - lag(kept) over (partition by file_id order by beat) as step from k)
select file_id, beat, round(case when coalesce(min(step) over (partition by file_id), 1) > 0 then kept else time_s end, 6) as time_s from z""",
    cte("notes", NOTES),
    ORACLE_BEATS,
    _IBI,
)
def snap_to_onsets(spark, d):
    return onsets.snap_to_onsets(adapters.beats(spark, d), adapters.notes(spark, d)).select("file_id", "beat", _r("time_s").alias("time_s"))


@_query(
    """, x as (select o.*, i.time_s, i.ibi from own o join ib i on i.file_id = o.file_id and i.beat = o.beat where abs(o.onset_s - i.time_s) <= cast(0.15 as double)*i.ibi),
g as (select file_id, beat, count(*) as n_notes, sum(least((offset_s - onset_s)/ibi, 4)) as held, min(pitch) as low from x group by file_id, beat)
select b.file_id, b.beat, coalesce(g.n_notes, 0) as n_notes, round(coalesce(g.held, 0), 6) as held, g.low from beats b left join g on g.file_id = b.file_id and g.beat = b.beat""",
    cte("notes", NOTES),
    ORACLE_BEATS,
    _IBI,
    _OWN,
)
def nearest_beat_notes(spark, d):
    n = onsets.notes_of_beats(adapters.beats(spark, d), adapters.notes(spark, d))
    return n.select("file_id", "beat", "n_notes", _r("held").alias("held"), "low")


_SPANS = """sp as (select n.file_id, n.note_id, n.pitch % 12 as pc, least(n.offset_s - n.onset_s, 2) as w, coalesce(max(case when i.time_s - cast(0.15 as double)*i.ibi <= n.onset_s then i.beat end), 0) as beat
 from notes n join ib i on i.file_id = n.file_id group by all),
pr as (select file_id, beat, pc, sum(w) as weight from sp group by all)"""


@_query("select file_id, beat, pc, round(weight, 6) as weight from pr", cte("notes", NOTES), ORACLE_BEATS, _IBI, _SPANS)
def pitch_class_profile(spark, d):
    p = onsets.pitch_class_profile(adapters.beats(spark, d), adapters.notes(spark, d))
    return p.select("file_id", "beat", "pc", _r("weight").alias("weight"))


_CHANGE = """sz as (select file_id, beat, sqrt(sum(weight*weight)) as size from pr group by all having sum(weight) > 0),
dt as (select a.file_id, a.beat, sum(a.weight*b.weight) as dot from pr a join pr b on b.file_id = a.file_id and b.pc = a.pc and b.beat = a.beat - 1 group by all),
ch as (select b.file_id, b.beat, case when s.size > 0 and p.size > 0 then 1 - coalesce(dt.dot, 0)/(s.size*p.size) else 0 end as change from beats b left join sz s on s.file_id = b.file_id and s.beat = b.beat
 left join sz p on p.file_id = b.file_id and p.beat = b.beat - 1 left join dt on dt.file_id = b.file_id and dt.beat = b.beat)"""


@_query("select file_id, beat, round(change, 6) as change from ch", cte("notes", NOTES), ORACLE_BEATS, _IBI, _SPANS, _CHANGE)
def harmonic_change(spark, d):
    h = onsets.harmonic_change(adapters.beats(spark, d), adapters.notes(spark, d))
    return h.select("file_id", "beat", _r("change").alias("change"))


@_query(
    """, x as (select o.*, i.time_s, i.ibi from own o join ib i on i.file_id = o.file_id and i.beat = o.beat where abs(o.onset_s - i.time_s) <= cast(0.15 as double)*i.ibi),
g as (select file_id, beat, count(*) as n, sum(least((offset_s - onset_s)/ibi, 4)) as held, min(pitch) as low from x group by file_id, beat),
md as (select file_id, median(pitch) as middle from notes group by file_id),
v as (select ch.file_id, ch.beat, ln(1 + coalesce(g.n, 0)) as a, ln(1 + coalesce(g.held, 0)) as b, coalesce(least(greatest(md.middle - g.low, 0), 36)/12, 0) as c, ch.change as e from ch left join g on g.file_id = ch.file_id and g.beat = ch.beat join md on md.file_id = ch.file_id),
s as (select *, stddev_pop(a) over w as sa, stddev_pop(b) over w as sb, stddev_pop(c) over w as sc, stddev_pop(e) over w as se, avg(a) over w as ma, avg(b) over w as mb, avg(c) over w as mc, avg(e) over w as me from v window w as (partition by file_id))
select file_id, beat, round(case when sa > 1e-9 then (a - ma)/sa else 0 end + case when sb > 1e-9 then (b - mb)/sb else 0 end + case when sc > 1e-9 then (c - mc)/sc else 0 end + case when se > 1e-9 then (e - me)/se else 0 end, 5) as salience from s""",
    cte("notes", NOTES),
    ORACLE_BEATS,
    _IBI,
    _OWN,
    _SPANS,
    _CHANGE,
)
def beat_salience(spark, d):
    s = onsets.beat_salience(adapters.beats(spark, d), adapters.notes(spark, d))
    return s.select("file_id", "beat", _r("salience", 5).alias("salience"))


def _short_grid(spark, d):
    """Beats 4 to 19 of the grid, so that notes lie outside it on both sides."""
    return adapters.beats(spark, d).where("beat between 4 and 19")


_SHORT = """sg as (select * from beats where beat between 4 and 19),
st as (select *, time_s - lag(time_s) over (partition by file_id order by beat) as step from sg),
ed as (select file_id, min(time_s) as t0, max(time_s) as tn, greatest(median(case when beat between 5 and 8 then step end), cast(0.05 as double)) as i0, greatest(median(case when beat >= 16 then step end), cast(0.05 as double)) as i1 from st group by file_id),
xs as (select file_id, least(0, min(onset_s)) as a, max(offset_s) + 1 as z from notes group by file_id),
kk as (select ed.*, cast(greatest(0, ceil((t0 - a)/i0)) as bigint) as before, cast(greatest(0, ceil((z - tn)/i1)) as bigint) as after from ed join xs using (file_id)),
eg as (select file_id, beat, time_s, beat_in_bar, beats_per_bar from sg
 union all select file_id, cast(4 - k as int), t0 - k*i0, cast(((0 - k) % 4 + 4) % 4 as int), 4 from kk, range(1, 200) t(k) where k <= before
 union all select file_id, cast(19 + k as int), tn + k*i1, cast((3 + k) % 4 as int), 4 from kk, range(1, 200) t(k) where k <= after)"""


@_query(
    """select file_id, cast(row_number() over (partition by file_id order by beat) - 1 as int) as beat, round(time_s, 6) as time_s, beat_in_bar, beats_per_bar from eg""",
    cte("notes", NOTES),
    ORACLE_BEATS,
    _SHORT,
)
def grid_extension(spark, d):
    g = grid.extend_grid(_short_grid(spark, d), grid.spans_of(adapters.notes(spark, d)))
    return g.select("file_id", "beat", _r("time_s").alias("time_s"), "beat_in_bar", "beats_per_bar")


@_query(
    """select file_id, cast(k as int) as beat, round(a + k*cast(0.6 as double), 6) as time_s, cast(k % 3 as int) as beat_in_bar, 3 as beats_per_bar
 from (select file_id, min(onset_s) as a, max(offset_s) + 1 as z from notes group by file_id), range(0, 200) t(k) where k < greatest(2, ceil((z - a)*cast(100 as double)/60) + 1)""",
    cte("notes", NOTES),
)
def regular_grid(spark, d):
    spans = adapters.notes(spark, d).groupBy("file_id").agg(F.min("onset_s").alias("t_start"), (F.max("offset_s") + 1).alias("t_end"))
    g = grid.regular_grid(spans, 100.0, 3)
    return g.select("file_id", "beat", _r("time_s").alias("time_s"), "beat_in_bar", "beats_per_bar")


@_query(
    """select file_id, cast(beat as int) as beat, cast(time_s as double) as time_s, cast(beat_in_bar as int) as beat_in_bar, cast(beats_per_bar as int) as beats_per_bar
 from (select file_id, beat, time_s, beat_in_bar, beats_per_bar from beats where file_id % 3 <> 0 union all select distinct file_id, k, k, k, 4 from beats, range(0, 2) t(k) where file_id % 3 = 0)""",
    ORACLE_BEATS,
)
def usable_grid(spark, d):
    b = adapters.beats(spark, d)
    return grid.usable_grid(b.where("file_id % 3 <> 0 or (file_id % 2 = 0 and beat = 0)"), b)


_TEMPO = """tt as (select file_id, tick, tempo_us from m where msg_type = 'set_tempo'),
ta as (select * from tt union all select distinct file_id, cast(0 as bigint), 500000 from m where file_id not in (select file_id from tt where tick = 0)),
ts as (select *, coalesce((tick - lag(tick) over w)*lag(tempo_us) over w, 0) as step from ta window w as (partition by file_id order by tick)),
tm as (select *, cast(sum(step) over (partition by file_id order by tick rows between unbounded preceding and current row) as double)/480000000 as sec, lead(tick) over (partition by file_id order by tick) as nt from ts),
tn as (select *, lead(sec) over (partition by file_id order by tick) as nat from tm)"""


@_query(
    """select m.file_id, m.msg_index, round(tn.tick + (cast(m.msg_index % 5000 as double)/100 - tn.sec)*480000000/tn.tempo_us, 4) as tick
 from m join tn on tn.file_id = m.file_id and cast(m.msg_index % 5000 as double)/100 >= tn.sec and (tn.nat is null or cast(m.msg_index % 5000 as double)/100 < tn.nat)""",
    cte("m", MIDI_EVENTS),
    _TEMPO,
)
def seconds_to_ticks(spark, d):
    m = adapters.midi_events(spark, d)
    points = m.select("file_id", "msg_index", (F.col("msg_index") % 5000 / F.lit(100.0)).alias("seconds"))
    return grid.to_ticks(points, grid.tempo_map(m)).select("file_id", "msg_index", _r("tick", 4).alias("tick"))


#: Score positions by brute force: every chord's mean onset on the grid, each beat's better step.
_SEG = """sg as (select file_id, beat, time_s, lead(time_s) over (partition by file_id order by beat) as nx from beats)"""
_POS = """{out} as (select p.*, s.beat + (p.t - s.time_s)/(s.nx - s.time_s) as b from {src} p join sg s on s.file_id = p.file_id and s.nx is not null and (p.t >= s.time_s or s.beat = 0) and (p.t < s.nx or s.beat = 30))"""
_STEP = """{out}q as (select *, round_even(b*4, 0)/cast(4 as double) as q0, round_even(b*3, 0)/cast(3 as double) as q1, floor(b) as fb from {src}),
{out}e as (select *, sum((q0 - b)*(q0 - b)) over (partition by file_id, fb) as e0, sum((q1 - b)*(q1 - b)) over (partition by file_id, fb) as e1 from {out}q),
{out} as (select *, case when e1 + cast(0.01 as double) < e0 then q1 else q0 end as snapped from {out}e)"""
_SCORE = (
    _SEG,
    "mo as (select file_id, group_id, avg(onset_s) as t from c group by file_id, group_id)",
    _POS.format(out="mp", src="mo"),
    _STEP.format(out="ms", src="mp"),
    "fo as (select file_id, note_id, offset_s as t from c)",
    _POS.format(out="fp", src="fo"),
    _STEP.format(out="fs", src="fp"),
    "pl as (select c.file_id, c.note_id, c.onset_s, c.offset_s, c.pitch, ms.snapped as onset_beat, greatest(fs.snapped, ms.snapped + cast(0.25 as double)) as offset_beat from c join ms on ms.file_id = c.file_id and ms.group_id = c.group_id join fs on fs.file_id = c.file_id and fs.note_id = c.note_id)",
)
_SMOOTH = """{out} as (select file_id, beat, f as time_s, lead(f) over (partition by file_id order by beat) as nx
 from (select file_id, beat, regr_slope(time_s, beat) over w * beat + regr_intercept(time_s, beat) over w as f from beats window w as (partition by file_id order by beat rows between {half} preceding and {half} following)))"""
_AT = "s.time_s + ({b} - s.beat)*(s.nx - s.time_s) as {out}"


@_query("select file_id, note_id, round(onset_beat, 6) as onset_beat from pl", ORACLE_NOTES, ORACLE_BEATS, *_SCORE)
def snap_groups(spark, d):
    s = timing.snap_groups(adapters.notes(spark, d), adapters.beats(spark, d))
    return s.select("file_id", "note_id", _r("onset_beat").alias("onset_beat"))


_TIMED = """, on_ as (select pl.*, s.time_s + (onset_beat - s.beat)*(s.nx - s.time_s) as score_onset_s from pl join sm8 s on s.file_id = pl.file_id and s.beat = greatest(0, least(30, floor(onset_beat)))),
of_ as (select o.*, s.time_s + (offset_beat - s.beat)*(s.nx - s.time_s) as score_offset_s from on_ o join sm8 s on s.file_id = o.file_id and s.beat = greatest(0, least(30, floor(offset_beat)))),
al as (select o.*, s.time_s + (onset_beat - s.beat)*(s.nx - s.time_s) as ref_time_s from of_ o join sm2 s on s.file_id = o.file_id and s.beat = greatest(0, least(30, floor(onset_beat))))
"""


@_query(
    _TIMED + "select file_id, note_id, round(onset_beat, 6) as onset_beat, round(offset_beat, 6) as offset_beat, round(score_onset_s, 5) as score_onset_s, round(score_offset_s, 5) as score_offset_s, round(ref_time_s, 5) as ref_time_s from al",
    ORACLE_NOTES,
    ORACLE_BEATS,
    *_SCORE,
    _SMOOTH.format(out="sm8", half=8),
    _SMOOTH.format(out="sm2", half=2),
)
def reconstruct_score(spark, d):
    s = timing.reconstruct_score(adapters.notes(spark, d), adapters.beats(spark, d))
    return s.select("file_id", "note_id", *(_r(c).alias(c) for c in ("onset_beat", "offset_beat")), *(_r(c, 5).alias(c) for c in ("score_onset_s", "score_offset_s", "ref_time_s")))


@_query(
    _TIMED + "select file_id, note_id, round(onset_beat, 6) as score_beat, onset_s as perf_onset_s, round(ref_time_s, 5) as ref_time_s, round((onset_s - ref_time_s)*1000, 2) as offset_ms from al",
    ORACLE_NOTES,
    ORACLE_BEATS,
    *_SCORE,
    _SMOOTH.format(out="sm8", half=8),
    _SMOOTH.format(out="sm2", half=2),
)
def timing_targets(spark, d):
    t = timing.timing_targets(timing.reconstruct_score(adapters.notes(spark, d), adapters.beats(spark, d)))
    return t.select("file_id", "note_id", _r("score_beat").alias("score_beat"), "perf_onset_s", _r("ref_time_s", 5).alias("ref_time_s"), F.round(F.col("offset_ms").cast("double"), 2).alias("offset_ms"))


@_query()
def performance_features(spark, d):
    """A performance to its score's features and its timing targets."""
    return timing.featurize_performance(adapters.notes(spark, d), adapters.beats(spark, d), feature_set="A")


@_query()
def humanizing_features(spark, d):
    """Files on their own grid as scores, snapped to it, others taken apart."""
    n, b = adapters.notes(spark, d), adapters.beats(spark, d)
    on_grid = n.groupBy("file_id").agg((F.col("file_id") % 2 == 0).alias("looks_quantized"))
    return timing.featurize_for_humanizing(n, b, b, on_grid, snap=True, feature_set="A")


_MOVED = """mv as (select file_id, pitch, note_id, onset_s + cast(note_id % 41 - 20 as double)/1000 as on_s, offset_s - onset_s as dur from notes),
t1 as (select mv.*, cast(greatest(0, round_even(tn.tick + (on_s - tn.sec)*480000000/tn.tempo_us, 0)) as bigint) as on_t from mv join tn on tn.file_id = mv.file_id and (on_s >= tn.sec or tn.tick = 0) and (tn.nat is null or on_s < tn.nat)),
t2 as (select t1.*, greatest(cast(round_even(tn.tick + (on_s + dur - tn.sec)*480000000/tn.tempo_us, 0) as bigint), on_t + 1) as off_t from t1 join tn on tn.file_id = t1.file_id and on_s + dur >= tn.sec and (tn.nat is null or on_s + dur < tn.nat)),
j as (select *, row_number() over (partition by file_id, pitch order by note_id) - 1 as j from t2),
o as (select *, max(on_t - j) over (partition by file_id, pitch order by note_id rows between unbounded preceding and current row) + j as n_on from j),
x as (select *, lead(n_on) over (partition by file_id, pitch order by note_id) as nx from o)"""


@_query(
    "select file_id, note_id, cast(n_on as bigint) as onset_tick, cast(case when nx is null then greatest(off_t, n_on + 1) else least(greatest(off_t, n_on + 1), nx) end as bigint) as offset_tick from x",
    cte("notes", NOTES),
    cte("m", MIDI_EVENTS),
    _TEMPO,
    _MOVED,
)
def retime_notes(spark, d):
    n = adapters.notes(spark, d).withColumn("offset_ms", (F.col("note_id") % 41 - 20).cast("double")).withColumns({"base_onset_s": F.col("onset_s"), "track": F.lit(0), "channel": F.lit(0)})
    return timing.retime(n, grid.tempo_map(adapters.midi_events(spark, d))).select("file_id", "note_id", "onset_tick", "offset_tick")


@_query(
    """, p as (select m.file_id, m.msg_index, m.tick, tn.sec + cast((m.tick - tn.tick)*tn.tempo_us as double)/480000000 as t from m join tn on tn.file_id = m.file_id and m.tick >= tn.tick and (tn.nt is null or m.tick < tn.nt) where m.msg_index % 7 = 0),
b as (select p.*, s.beat + (p.t - s.time_s)/(s.nx - s.time_s) as b from p join sg s on s.file_id = p.file_id and s.nx is not null and (p.t >= s.time_s or s.beat = 0) and (p.t < s.nx or s.beat = 30)),
w as (select b.*, s.time_s + (b.b - s.beat)*(s.nx - s.time_s) as t2 from b join sm8 s on s.file_id = b.file_id and s.beat = greatest(0, least(30, floor(b.b))))
select w.file_id, w.msg_index, w.tick, cast(greatest(0, round_even(tn.tick + (t2 - tn.sec)*480000000/tn.tempo_us, 0)) as bigint) as new_tick from w join tn on tn.file_id = w.file_id and (t2 >= tn.sec or tn.tick = 0) and (tn.nat is null or t2 < tn.nat)""",
    cte("m", MIDI_EVENTS),
    ORACLE_BEATS,
    _TEMPO,
    _SEG,
    _SMOOTH.format(out="sm8", half=8),
)
def retime_warp(spark, d):
    m, b = adapters.midi_events(spark, d), adapters.beats(spark, d)
    points = m.where("msg_index % 7 = 0").select("file_id", "msg_index", "tick")
    return timing.warp_ticks(points, b, timing.smoothed(b, 8), grid.tempo_map(m))


@_query(
    """select file_id, beat, round(time_s, 6) as time_s, beat_in_bar, beats_per_bar, case when file_id % 2 = 0 then 'midi' else 'tracked' end as source from
 (select * from beats where file_id % 2 = 0 union all select file_id, beat, time_s + cast(0.01 as double), beat_in_bar, beats_per_bar from beats where file_id % 2 = 1)""",
    ORACLE_BEATS,
)
def choose_grid(spark, d):
    b = adapters.beats(spark, d)
    quantized = b.select("file_id").distinct().withColumn("quantized", F.col("file_id") % 2 == 0)
    got = tracking.choose_grid(b.withColumn("time_s", F.col("time_s") + 0.01), b, quantized)
    return got.withColumn("time_s", F.round("time_s", 6))


