"""All queries over the driver's tables, and their oracle SQL (same columns, same names).

Doubles are rounded in query and oracle alike; whole-number sums are divided once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar
from .operators import boosting, context, folds, grid, grouping, metrics, sampling, tracking, trees
from .plans import features
from .plans.profile import context_profile
from .sources import adapters, smf, store
from .sources.adapters import LOOSE_NOTES, MIDI_EVENTS, NOTES, ORACLE_BEATS, ORACLE_NOTES, cte
from .streaming import causal

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(oracle: str | None = None, *ctes: str):
    """Registers the function below under its name; ctes go before the oracle's select."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = (f"with recursive {', '.join(ctes)}{'' if oracle.startswith(',') else ' '}" if ctes else "") + oracle
        return f

    return add


def _canonical(spark: SparkSession, d: str) -> DataFrame:
    return grouping.canonical(adapters.notes(spark, d))


def _r(col, digits: int = 6):
    return F.round(F.col(col) if isinstance(col, str) else col, digits)


QUERIES["context_profile"] = lambda spark, d: context_profile(adapters.notes(spark, d)).withColumns({c: F.round(c, 6) for c in ("mae", "bias", "mean_density")})
ORACLES["context_profile"] = f"""with {ORACLE_NOTES},
e as (select file_id, group_id, min(onset_s) as g_time, count(*) as n, sum(abs(pred - velocity)) as abs_err, sum(pred - velocity) as err, max(pitch) as g_top from c group by file_id, group_id),
w as (select *, sum(n) over (partition by file_id order by g_time range between cast(3 as double) preceding and cast(3 as double) following) as near from e)
select file_id, cast(sum(n) as bigint) as n, count(*) as n_groups, round(cast(sum(abs_err) as double)/sum(n), 6) as mae, round(cast(sum(err) as double)/sum(n), 6) as bias,
 round(cast(sum(near*n) as double)/(6*sum(n)), 6) as mean_density, max(g_top) as top from w group by file_id"""


@_query(
    """, r as (select *, row_number() over (partition by file_id order by onset_s, pitch, note_id) as k from loose),
fold(file_id, k, note_id, anchor, group_id) as (
 select file_id, k, note_id, onset_s, 0 from r where k = 1
 union all select r.file_id, r.k, r.note_id, case when r.onset_s - f.anchor > cast(0.035 as double) then r.onset_s else f.anchor end,
  case when r.onset_s - f.anchor > cast(0.035 as double) then f.group_id + 1 else f.group_id end from fold f join r on r.file_id = f.file_id and r.k = f.k + 1)
select file_id, note_id, cast(group_id as int) as group_id from fold""",
    cte("loose", LOOSE_NOTES),
)
def anchored_groups(spark, d):
    return grouping.anchored_groups(adapters.loose_notes(spark, d)).select("file_id", "note_id", "group_id")


@_query("select file_id, cast(group_id as int) as group_id, g_time, g_low, g_top, g_size from g", ORACLE_NOTES)
def group_attributes(spark, d):
    return grouping.groups(_canonical(spark, d))


@_query("select file_id, note_id, cast(group_id as int) as group_id, cast(note_idx as int) as note_idx from c", ORACLE_NOTES)
def canonical_order(spark, d):
    return _canonical(spark, d).select("file_id", "note_id", "group_id", "note_idx")


@_query(
    """select file_id, cast(group_id as int) as group_id, round(g_time - lag(g_time) over w, 6) as ioi_prev_s, round(lead(g_time) over w - g_time, 6) as ioi_next_s
 from g window w as (partition by file_id order by group_id)""",
    ORACLE_NOTES,
)
def ioi_lag_lead(spark, d):
    return grouping.inter_onset(grouping.groups(_canonical(spark, d))).select("file_id", "group_id", _r("ioi_prev_s").alias("ioi_prev_s"), _r("ioi_next_s").alias("ioi_next_s"))


@_query(
    """select file_id, cast(group_id as int) as group_id, avg(g_top) over (w rows between 1 following and 2 following) - avg(g_top) over (w rows between 2 preceding and 1 preceding) as top_line_trend
 from g window w as (partition by file_id order by group_id)""".replace("(w rows", "(partition by file_id order by group_id rows").replace(" window w as (partition by file_id order by group_id)", ""),
    ORACLE_NOTES,
)
def top_line_trend(spark, d):
    return grouping.top_line_trend(grouping.groups(_canonical(spark, d))).select("file_id", "group_id", "top_line_trend")


@_query(
    """select file_id, note_id, round(onset_s - lag(onset_s) over (partition by file_id, pitch order by onset_s, note_idx), 6) as same_pitch_prev_dt,
 round(lead(onset_s) over (partition by file_id, pitch order by onset_s, note_idx) - onset_s, 6) as same_pitch_next_dt from c""",
    ORACLE_NOTES,
)
def same_pitch_gap(spark, d):
    return grouping.same_pitch_gaps(_canonical(spark, d)).select("file_id", "note_id", _r("same_pitch_prev_dt").alias("same_pitch_prev_dt"), _r("same_pitch_next_dt").alias("same_pitch_next_dt"))


@_query(
    """select file_id, note_id, cast(row_number() over (partition by file_id, group_id order by note_idx desc) - 1 as int) as rank_top,
 cast(row_number() over (partition by file_id, group_id order by note_idx) - 1 as int) as rank_bottom, g_size as chord_size, g_top - g_low as chord_span,
 case when g_top > g_low then round(cast(pitch - g_low as double)/(g_top - g_low), 6) end as chord_pos_norm, g_top - pitch as dist_top
 from c join g using (file_id, group_id)""",
    ORACLE_NOTES,
)
def chord_rank(spark, d):
    r = grouping.chord_ranks(_canonical(spark, d))
    return r.select("file_id", "note_id", "rank_top", "rank_bottom", "chord_size", "chord_span", _r("chord_pos_norm").alias("chord_pos_norm"), "dist_top")


_NEAR = """near as (select a.file_id, a.note_idx, b.pitch as n_pitch, {step} as step,
 row_number() over (partition by a.file_id, a.note_idx order by abs(a.pitch - b.pitch), b.pitch, case when b.pitch < a.pitch then -b.note_idx else b.note_idx end) as k
 from c a join c b on b.file_id = a.file_id and b.group_id = a.group_id + {step})"""


@_query(
    """select c.file_id, c.note_id, c.pitch - p.n_pitch as prev_interval, x.n_pitch - c.pitch as next_interval,
 cast(coalesce(sign(c.pitch - p.n_pitch), 0) + coalesce(sign(x.n_pitch - c.pitch), 0) as double) as melodic_direction,
 coalesce(c.pitch > p.n_pitch and x.n_pitch < c.pitch, false) as is_local_peak, coalesce(c.pitch < p.n_pitch and x.n_pitch > c.pitch, false) as is_local_trough
 from c left join (select * from near where k = 1) p on p.file_id = c.file_id and p.note_idx = c.note_idx left join (select * from near2 where k = 1) x on x.file_id = c.file_id and x.note_idx = c.note_idx""",
    ORACLE_NOTES,
    _NEAR.format(step=-1),
    _NEAR.format(step=1).replace("near as", "near2 as"),
)
def nearest_pitch_neighbor(spark, d):
    return grouping.melodic_context(_canonical(spark, d)).select("file_id", "note_id", "prev_interval", "next_interval", "melodic_direction", "is_local_peak", "is_local_trough")


@_query(
    """select g.file_id, cast(g.group_id as int) as group_id, cast(greatest(0, (select count(*) from c x where x.file_id = g.file_id and x.onset_s < g.g_time)
 - (select count(*) from c y where y.file_id = g.file_id and y.offset_s <= g.g_time)) as bigint) as held from g""",
    ORACLE_NOTES,
)
def held_polyphony(spark, d):
    return grouping.held_notes(_canonical(spark, d))


@_query(
    """, m as (select file_id, group_id, sum(velocity) as s, count(*) as n from c group by file_id, group_id),
l as (select *, lag(cast(s as double)/n) over (partition by file_id order by group_id) as p, lead(cast(s as double)/n) over (partition by file_id order by group_id) as x from m)
select file_id, note_id, round(p, 6) as pc_prev_group_mean_velocity, round(x, 6) as pc_next_group_mean_velocity,
 case when n > 1 then round(cast(s - velocity as double)/(n - 1), 6) end as pc_chordmates_mean_velocity from c join l using (file_id, group_id)""",
    ORACLE_NOTES,
)
def pc_features(spark, d):
    names = ["pc_prev_group_mean_velocity", "pc_next_group_mean_velocity", "pc_chordmates_mean_velocity"]
    return grouping.conditioned_features(_canonical(spark, d)).select("file_id", "note_id", *(_r(n).alias(n) for n in names))


_PROFILE = """held as (select g.file_id, g.group_id, greatest(0, (select count(*) from c x where x.file_id = g.file_id and x.onset_s < g.g_time) - (select count(*) from c y where y.file_id = g.file_id and y.offset_s <= g.g_time)) as held from g),
prof as (select c.file_id, c.group_id, min(c.onset_s) as g_time, count(*) as n, sum(pitch) as p_sum, min(pitch) as p_min, max(pitch) as p_max, sum(cast(round_even(dur_s*1000000, 0) as bigint)) as dur_us,
 max(held.held) as held from c join held using (file_id, group_id) group by c.file_id, c.group_id)"""


def _window_oracle(width: float, causal: bool, order: str = "g_time", source: str = "prof") -> str:
    frame = f"(partition by file_id order by {order} range between cast({width} as double) preceding and {'current row' if causal else f'cast({width} as double) following'})"
    total = width if causal else 2 * width
    return f"""select file_id, cast(group_id as int) as group_id, cast(sum(n) over {frame} as bigint) as w_notes, round(cast(sum(n) over {frame} as double)/cast({total} as double), 6) as note_density,
 round(cast(count(*) over {frame} as double)/cast({total} as double), 6) as onset_density, round(cast(sum(p_sum) over {frame} as double)/sum(n) over {frame}, 6) as mean_pitch,
 max(p_max) over {frame} - min(p_min) over {frame} as pitch_range, cast(sum(dur_us) over {frame} as bigint) as w_dur_us,
 round(cast(sum((held + n)*n) over {frame} as double)/sum(n) over {frame}, 6) as mean_polyphony from {source}"""


def _window_query(width: float, causal: bool, beats: bool = False):
    def run(spark, d):
        prof = context.group_profile(_canonical(spark, d))
        if beats:
            prof = prof.join(_positions(spark, d).select("file_id", "group_id", F.col("beat_pos").alias("g_beat")), ["file_id", "group_id"])
        got = context.window_stats(prof, width, "g_beat" if beats else "g_time", causal)
        return got.select("file_id", "group_id", "w_notes", *(_r(c).alias(c) for c in ("note_density", "onset_density", "mean_pitch")), "pitch_range", "w_dur_us", _r("mean_polyphony").alias("mean_polyphony"))

    return run


for _w, _tag in ((0.25, "250ms"), (0.5, "500ms"), (1.0, "1000ms"), (3.0, "3000ms")):
    for _causal in (False, True):
        _name = f"{'causal' if _causal else 'range'}_window_stats_{_tag}"
        QUERIES[_name] = _window_query(_w, _causal)
        ORACLES[_name] = f"with {ORACLE_NOTES}, {_PROFILE} {_window_oracle(_w, _causal)}"


_BEAT_OF = """seg as (select file_id, beat, time_s, lead(time_s) over (partition by file_id order by beat) as next_s from beats),
pos as (select g.*, s.beat + (g.g_time - s.time_s)/(s.next_s - s.time_s) as beat_pos from g join seg s on s.file_id = g.file_id and s.next_s is not null
 and (g.g_time >= s.time_s or s.beat = 0) and (g.g_time < s.next_s or s.beat = 30))"""


def _positions(spark, d) -> DataFrame:
    return grid.time_to_beat(grouping.groups(_canonical(spark, d)), adapters.beats(spark, d), "g_time")


for _w, _tag in ((1.0, "1b"), (2.0, "2b"), (4.0, "4b")):
    for _causal in (False, True):
        _name = f"{'causal' if _causal else 'range'}_window_stats_{_tag}"
        QUERIES[_name] = _window_query(_w, _causal, beats=True)
        ORACLES[_name] = f"with {ORACLE_NOTES}, {_PROFILE}, {ORACLE_BEATS}, {_BEAT_OF} {_window_oracle(_w, _causal, 'beat_pos', '(select p.*, q.beat_pos from prof p join pos q on q.file_id = p.file_id and q.group_id = p.group_id) pb')}"


@_query(
    """select file_id, cast(group_id as int) as group_id, round(beat_pos, 6) as beat_pos, round(g_time, 6) as back_s from pos""",
    ORACLE_NOTES,
    ORACLE_BEATS,
    _BEAT_OF,
)
def beat_interpolation(spark, d):
    back = grid.beat_to_time(_positions(spark, d), adapters.beats(spark, d), "beat_pos", "back_s")
    return back.select("file_id", "group_id", _r("beat_pos").alias("beat_pos"), _r("back_s").alias("back_s"))


@_query(
    """select file_id, cast(group_id as int) as group_id,
 case when abs(beat_pos - round_even(beat_pos, 0)) <= cast(0.12 as double) and rb % 4 = 0 then 0
  when abs(beat_pos - round_even(beat_pos, 0)) <= cast(0.12 as double) and rb % 4 = 2 then 1
  when abs(beat_pos - round_even(beat_pos, 0)) <= cast(0.12 as double) then 2
  when abs(f*2 - round_even(f*2, 0))/cast(2 as double) <= cast(0.12 as double) then 3
  when abs(f*3 - round_even(f*3, 0))/cast(3 as double) <= cast(0.06 as double) or abs(f*4 - round_even(f*4, 0))/cast(4 as double) <= cast(0.06 as double) then 4 else 5 end as level
 from (select *, beat_pos - floor(beat_pos) as f, cast(greatest(0, least(31, round_even(beat_pos, 0))) as int) as rb from pos)""",
    ORACLE_NOTES,
    ORACLE_BEATS,
    _BEAT_OF,
)
def metrical_level(spark, d):
    p = _positions(spark, d).withColumn("beat", F.greatest(F.lit(0), F.least(F.lit(31), F.rint("beat_pos"))).cast("int"))
    j = p.join(adapters.beats(spark, d), ["file_id", "beat"])
    return j.select("file_id", "group_id", scalar.metrical_level(F.col("beat_pos"), F.col("beat_in_bar"), F.col("beats_per_bar")).alias("level"))


@_query(
    """select file_id, cast(group_id as int) as group_id,
 cast(coalesce(sum(g_size) over (partition by file_id order by beat_pos range between cast(1 as double) preceding and current row), 0) - g_size as bigint) as notes_in_prev_beat,
 cast(coalesce(sum(g_size) over (partition by file_id order by beat_pos range between current row and cast(1 as double) following), 0) - g_size as bigint) as notes_in_next_beat from pos""",
    ORACLE_NOTES,
    ORACLE_BEATS,
    _BEAT_OF,
)
def notes_prev_next_beat(spark, d):
    p = _positions(spark, d).withColumnsRenamed({"beat_pos": "g_beat", "g_size": "n"})
    return context.prev_next_beat_counts(p).select("file_id", "group_id", "notes_in_prev_beat", "notes_in_next_beat")


@_query(
    """select file_id, note_id, count(*) over (partition by file_id order by onset_s range between cast(0.035 as double) preceding and cast(0.035 as double) following) as n_onsets_within_tol from c""",
    ORACLE_NOTES,
)
def onsets_within_tol(spark, d):
    return context.onsets_within(_canonical(spark, d)).select("file_id", "note_id", "n_onsets_within_tol")


def _nearest_oracle(n: int) -> str:
    f = f"(partition by file_id order by note_idx rows between {n} preceding and {n} following)"
    return f"""with {ORACLE_NOTES}, x as (select c.*, g.g_time from c join g using (file_id, group_id)),
w as (select *, median(pitch) over {f} as md, sum(pitch) over {f} as s, count(*) over {f} as k, max(pitch) over {f} - min(pitch) over {f} as rg, max(g_time) over {f} - min(g_time) over {f} as span, list(pitch) over {f} as win from x)
select file_id, note_id, pitch - md as pitch_rel_median, round(pitch - cast(s as double)/k, 6) as pitch_rel_mean, rg as pitch_range,
 round(cast(len(list_filter(win, lambda v: v < pitch)) as double)/k, 6) as pitch_pct, case when k > 1 then round(span/(k - 1), 9) end as time_per_note from w"""


def _nearest_query(n: int):
    def run(spark, d):
        c = _canonical(spark, d)
        j = c.join(grouping.groups(c).select("file_id", "group_id", "g_time"), ["file_id", "group_id"])
        got = context.nearest_notes(j, n)
        return got.select("file_id", "note_id", "pitch_rel_median", _r("pitch_rel_mean").alias("pitch_rel_mean"), "pitch_range", _r("pitch_pct").alias("pitch_pct"), _r("time_per_note", 9).alias("time_per_note"))

    return run


for _n in (8, 32):
    QUERIES[f"nearest_{_n}_notes"] = _nearest_query(_n)
    ORACLES[f"nearest_{_n}_notes"] = _nearest_oracle(_n)


@_query(
    """, w as (select *, list(group_id*1000 + velocity) over (partition by file_id order by note_idx rows between 24 preceding and 24 following) as win from c),
f as (select *, list_transform(list_filter(win, lambda x: x // 1000 <> group_id), lambda x: x % 1000) as rest from w),
b as (select *, case when len(rest) > 0 then list_median(rest) end as m from f), p as (select file_id, median(velocity) as pm from c group by file_id)
select file_id, note_id, coalesce(m, pm) as baseline_velocity, velocity - coalesce(m, pm) as velocity_delta from b join p using (file_id)""",
    ORACLE_NOTES,
)
def residual_baseline(spark, d):
    return context.residual_baseline(_canonical(spark, d)).select("file_id", "note_id", "baseline_velocity", "velocity_delta")


@_query(
    """, e as (select file_id, group_id, min(onset_s) as g_time, max(offset_s) as g_off, count(*) as n from c group by file_id, group_id),
s as (select *, max(g_off) over (partition by file_id order by group_id rows between unbounded preceding and current row) as sound_end from e),
f as (select *, case when coalesce(g_time - lag(sound_end) over (partition by file_id order by group_id) >= cast(0.2 as double), true) then 1 else 0 end as st from s),
q as (select *, sum(st) over (partition by file_id order by group_id rows between unbounded preceding and current row) as seg from f)
select file_id, cast(group_id as int) as group_id, cast(seg as bigint) as rest_seg, round(g_time - min(g_time) over (partition by file_id, seg), 6) as time_since_rest_s,
 round(max(sound_end) over (partition by file_id, seg) - g_time, 6) as time_to_rest_s,
 cast(sum(n) over (partition by file_id, seg order by group_id rows between unbounded preceding and current row) - n as bigint) as notes_before_in_phrase, cast(sum(n) over (partition by file_id, seg) as bigint) as phrase_notes from q""",
    ORACLE_NOTES,
)
def rest_segments(spark, d):
    s = context.segments(_canonical(spark, d))
    return s.select("file_id", "group_id", "rest_seg", _r("time_since_rest_s").alias("time_since_rest_s"), _r("time_to_rest_s").alias("time_to_rest_s"), "notes_before_in_phrase", "phrase_notes")


@_query(
    """select file_id, round(greatest(max(offset_s) - min(onset_s), cast(0.001 as double)), 6) as piece_duration_s, round(count(*)/greatest(max(offset_s) - min(onset_s), cast(0.001 as double)), 6) as piece_note_rate,
 round(cast(sum(pitch) as double)/count(*), 6) as piece_mean_pitch, round(stddev_pop(pitch), 6) as piece_pitch_std, round(cast(count(*) as double)/count(distinct group_id), 6) as piece_mean_chord_size from c group by file_id""",
    ORACLE_NOTES,
)
def piece_profile(spark, d):
    p = context.piece_profile(_canonical(spark, d))
    return p.select("file_id", *(_r(c).alias(c) for c in p.columns[1:]))


# --- messages, grids -------------------------------------------------------------------


@_query(
    """, e as (select *, max(tick) over (partition by file_id, track) as track_end from m),
k as (select *, msg_type = 'note_on' and velocity > 0 as opens from e where msg_type <> 'set_tempo' and channel <> 9),
l as (select *, lead(tick) over w as nt, lead(opens) over w as nop, lead(msg_index) over w as ni from k window w as (partition by file_id, track, channel, pitch order by msg_index))
select file_id, track, pitch, velocity, msg_index, tick as onset_tick, coalesce(nt, track_end) as offset_tick, cast(case when nop = false then ni else -1 end as bigint) as off_msg_index from l where opens""",
    cte("m", MIDI_EVENTS),
)
def note_pairing(spark, d):
    return grid.pair_notes(adapters.midi_events(spark, d)).drop("channel")


@_query(
    """, t as (select file_id, tick, tempo_us from m where msg_type = 'set_tempo'),
a as (select * from t union all select distinct file_id, cast(0 as bigint), 500000 from m where file_id not in (select file_id from t where tick = 0)),
s as (select *, coalesce((tick - lag(tick) over w)*lag(tempo_us) over w, 0) as step from a window w as (partition by file_id order by tick)),
mp as (select *, sum(step) over (partition by file_id order by tick rows between unbounded preceding and current row) as at, lead(tick) over (partition by file_id order by tick) as nt from s)
select n.file_id, n.msg_index, round(cast(mp.at + (n.tick - mp.tick)*mp.tempo_us as double)/cast(480000000 as double), 6) as seconds
 from m n join mp on mp.file_id = n.file_id and n.tick >= mp.tick and (n.tick < mp.nt or mp.nt is null) where n.msg_type <> 'set_tempo'""",
    cte("m", MIDI_EVENTS),
)
def tempo_map_seconds(spark, d):
    m = adapters.midi_events(spark, d)
    got = grid.to_seconds(m.where("msg_type <> 'set_tempo'").select("file_id", "msg_index", "tick"), grid.tempo_map(m))
    return got.select("file_id", "msg_index", _r("seconds").alias("seconds"))




@_query(
    """select file_id, cast(row_number() over (partition by file_id order by bt) - 1 as int) as beat, bt as beat_tick, cast(k % num as int) as beat_in_bar, num as beats_per_bar, den as beat_unit,
 cast(sum(case when k % num = 0 then 1 else 0 end) over (partition by file_id order by bt rows between unbounded preceding and current row) as bigint) as measure_index
 from (select file_id, num, den, k, cast(tick + k*1920/den as double) as bt from (select *, cast(case tick when 0 then 20 when 9600 then 16 else 33 end as int) as n from sig) s, range(40) t(k) where k < n)""",
    "f as (select distinct cast(user_id as int) as file_id from events)",
    "sig as (select file_id, 0 as tick, 4 as num, 4 as den from f union all select file_id, 9600, 3, 4 from f union all select file_id, 17280, 6, 8 from f)",
)
def beat_grid_sequence(spark, d):
    files = adapters.notes(spark, d).select("file_id").distinct()
    sig = files.selectExpr("file_id", "explode(array(struct(0 as tick, 4 as num, 4 as den), struct(9600 as tick, 3 as num, 4 as den), struct(17280 as tick, 6 as num, 8 as den))) as s").select("file_id", "s.*")
    return grid.beat_grid(sig, files.selectExpr("file_id", "23760L - 1440L + 1440L as end_tick"))


@_query(
    """, i as (select *, coalesce(lead(time_s) over (partition by file_id order by beat) - time_s, time_s - lag(time_s) over (partition by file_id order by beat)) as ibi from beats),
j as (select a.file_id, a.beat, b.ibi, o from i a, range(-2, 3) t(o) join i b on true where b.file_id = a.file_id and b.beat = greatest(0, least(31, a.beat + o)))
select file_id, beat, round(cast(60 as double)/median(ibi), 6) as tempo_bpm from j group by file_id, beat""",
    ORACLE_BEATS,
)
def running_median_tempo(spark, d):
    return grid.running_tempo(adapters.beats(spark, d)).select("file_id", "beat", _r("tempo_bpm").alias("tempo_bpm"))


@_query(
    """select file_id, beat, round(regr_slope(time_s, beat) over w * beat + regr_intercept(time_s, beat) over w, 6) as smooth_s from beats window w as (partition by file_id order by beat rows between 2 preceding and 2 following)""",
    ORACLE_BEATS,
)
def smooth_beats_ols(spark, d):
    return grid.smooth_beats(adapters.beats(spark, d), 2).select("file_id", "beat", _r("smooth_s").alias("smooth_s"))


@_query(
    """, x as (select file_id, note_id, onset_s*2 as b from notes), q as (select *, round_even(b*4, 0)/cast(4 as double) as q0, round_even(b*3, 0)/cast(3 as double) as q1, floor(b) as fb from x),
s as (select *, sum((q0 - b)*(q0 - b)) over (partition by file_id, fb) as e0, sum((q1 - b)*(q1 - b)) over (partition by file_id, fb) as e1 from q)
select file_id, note_id, round(case when e1 + cast(0.01 as double) < e0 then q1 else q0 end, 6) as snapped from s""",
    cte("notes", NOTES),
)
def snap_per_beat(spark, d):
    p = adapters.notes(spark, d).withColumn("b", F.col("onset_s") * 2)
    return grid.snap_per_beat(p, "b", [4, 3], 0.01).select("file_id", "note_id", _r("snapped").alias("snapped"))


@_query(
    """select file_id, note_id, round(case when abs(round_even(b*3, 0)/cast(3 as double) - b) < abs(round_even(b*4, 0)/cast(4 as double) - b) then round_even(b*3, 0)/cast(3 as double) else round_even(b*4, 0)/cast(4 as double) end, 6) as snapped
 from (select *, onset_s*2 as b from notes)""",
    cte("notes", NOTES),
)
def snap_nearest(spark, d):
    b = F.col("onset_s") * 2
    return adapters.notes(spark, d).select("file_id", "note_id", _r(scalar.snap_nearest(b, [4, 3])).alias("snapped"))


_KEYED = "k as (select file_id, 0 as track, 0 as channel, pitch, note_id, cast(round_even(onset_s*960, 0) as bigint) as onset_tick, cast(round_even(offset_s*960, 0) as bigint) as offset_tick from notes)"


@_query(
    """, j as (select *, row_number() over (partition by file_id, pitch order by note_id) - 1 as j from k),
o as (select *, max(onset_tick - j) over (partition by file_id, pitch order by note_id rows between unbounded preceding and current row) + j as n_on from j),
x as (select *, lead(n_on) over (partition by file_id, pitch order by note_id) as nx from o)
select file_id, note_id, cast(n_on as bigint) as onset_tick, cast(case when nx is null then greatest(offset_tick, n_on + 1) else least(greatest(offset_tick, n_on + 1), nx) end as bigint) as offset_tick from x""",
    cte("notes", NOTES),
    _KEYED,
)
def same_key_retime(spark, d):
    n = adapters.notes(spark, d).select("file_id", F.lit(0).alias("track"), F.lit(0).alias("channel"), "pitch", "note_id", F.rint(F.col("onset_s") * 960).cast("long").alias("onset_tick"), F.rint(F.col("offset_s") * 960).cast("long").alias("offset_tick"))
    return grid.same_key_consistent(n).select("file_id", "note_id", "onset_tick", "offset_tick")


@_query(
    """select file_id, count(*) as n, cast(sum(case when least(onset_tick % 120, 120 - onset_tick % 120) <= 2 or least(onset_tick % 160, 160 - onset_tick % 160) <= 2 then 1 else 0 end) as bigint) as n_on_grid,
 count(*) >= 8 and sum(case when least(onset_tick % 120, 120 - onset_tick % 120) <= 2 or least(onset_tick % 160, 160 - onset_tick % 160) <= 2 then 1 else 0 end) >= cast(0.8 as double)*count(*) as looks_quantized from k group by file_id""",
    cte("notes", NOTES),
    _KEYED,
)
def looks_quantized(spark, d):
    return grid.looks_quantized(adapters.notes(spark, d).withColumn("onset_tick", F.rint(F.col("onset_s") * 960).cast("long")))


# --- metrics ---------------------------------------------------------------------------

_RANKED = """rk as (select *, rank() over (partition by file_id order by velocity) + (count(*) over (partition by file_id, velocity) - 1)/cast(2 as double) as ry,
 rank() over (partition by file_id order by pred) + (count(*) over (partition by file_id, pred) - 1)/cast(2 as double) as rp from notes)"""


@_query(
    """select file_id, count(*) as n, round(cast(sum(abs(pred - velocity)) as double)/count(*), 6) as mae, round(sqrt(cast(sum((pred - velocity)*(pred - velocity)) as double)/count(*)), 6) as rmse,
 round(1 - cast(sum((pred - velocity)*(pred - velocity)) as double)/(sum(velocity*velocity) - cast(sum(velocity)*sum(velocity) as double)/count(*)), 6) as r2, round(cast(sum(pred - velocity) as double)/count(*), 6) as bias,
 round(corr(velocity, pred), 6) as pearson, round(corr(ry, rp), 6) as spearman from rk group by file_id""",
    cte("notes", NOTES),
    _RANKED,
)
def regression_metrics(spark, d):
    m = metrics.regression_metrics(adapters.notes(spark, d), "velocity", "pred", ["file_id"])
    return m.select("file_id", "n", *(_r(c).alias(c) for c in m.columns[2:]))


@_query(
    """select count(*) as n_files, round(avg(r), 6) as within_piece_pearson from (select file_id, count(*) as n, corr(velocity, pred) as r from notes group by file_id) where n >= 50 and not isnan(r)""",
    cte("notes", NOTES),
)
def within_piece_pearson(spark, d):
    return metrics.within_piece_pearson(adapters.notes(spark, d), "velocity", "pred").withColumn("within_piece_pearson", F.round("within_piece_pearson", 6))


@_query(
    """select file_id, count(*) as n, round(cast(sum(velocity) as double)/count(*), 6) as mean, round(stddev_pop(velocity), 6) as std, min(velocity) as min, round(quantile_cont(velocity, 0.05), 6) as p5,
 round(quantile_cont(velocity, 0.25), 6) as p25, round(quantile_cont(velocity, 0.5), 6) as p50, round(quantile_cont(velocity, 0.75), 6) as p75, round(quantile_cont(velocity, 0.95), 6) as p95, max(velocity) as max from notes group by file_id""",
    cte("notes", NOTES),
)
def velocity_stats(spark, d):
    s = metrics.value_stats(adapters.notes(spark, d), "velocity", ["file_id"])
    return s.select("file_id", "n", _r("mean").alias("mean"), _r("std").alias("std"), "min", *(_r(c).alias(c) for c in ("p5", "p25", "p50", "p75", "p95")), "max")


_SPLIT = "sp as (select *, case when file_id % 10 < 7 then 'train' when file_id % 10 < 8 then 'validation' else 'test' end as split from notes)"


def _with_split(spark, d):
    return adapters.notes(spark, d).withColumn("split", metrics.split_of(F.col("file_id")))


@_query(
    """, h as (select split, cast(greatest(-20, least(20, pred - velocity)) as int) as bin, count(*) as n from sp group by all),
k as (select *, sum(n) over (partition by split order by bin) as cum, sum(n) over (partition by split) as total from h)
select split, cast(max(total) as bigint) as n, min(case when cum >= total*cast(0.05 as double) then bin end) as p5, min(case when cum >= total*cast(0.5 as double) then bin end) as p50, min(case when cum >= total*cast(0.95 as double) then bin end) as p95 from k group by split""",
    cte("notes", NOTES),
    _SPLIT,
)
def histogram_percentiles(spark, d):
    h = metrics.histogram(_with_split(spark, d).withColumn("e", F.col("pred") - F.col("velocity")), "e", ["split"], -20, 20)
    return metrics.histogram_percentiles(h, ["split"], [0.05, 0.5, 0.95])


@_query(
    """select split, count(distinct file_id) as files, count(*) as notes, round(cast(sum(velocity) as double)/count(*), 6) as mean, min(velocity) as min, max(velocity) as max from sp group by split""",
    cte("notes", NOTES),
    _SPLIT,
)
def split_summary(spark, d):
    return metrics.split_summary(_with_split(spark, d), "velocity").withColumn("mean", F.round("mean", 6))


@_query("select file_id, count(distinct split) as n from sp group by file_id having count(distinct split) > 1", cte("notes", NOTES), _SPLIT)
def split_overlap(spark, d):
    return metrics.overlapping_files(_with_split(spark, d))


@_query(
    """select split, file_id from (select *, row_number() over (partition by split order by md5('7|' || cast(file_id as varchar)), file_id) as k from (select distinct split, file_id from sp)) where k <= 5""",
    cte("notes", NOTES),
    _SPLIT,
)
def file_subsample(spark, d):
    return metrics.file_sample(_with_split(spark, d), 5, 7)


_Q = {0.05: -30, 0.1: -20, 0.25: -8, 0.5: 0, 0.75: 8, 0.9: 20, 0.95: 30}


def _quantiles(spark, d):
    n = adapters.notes(spark, d)
    return n.select("*", *((F.col("pred") + x).alias(f"q{i}") for i, x in enumerate(_Q.values()))), {a: f"q{i}" for i, a in enumerate(_Q)}


@_query(
    "select cast(level as double) as level, round((level*sum(greatest(velocity - pred - dq, 0)) + (1 - level)*sum(greatest(pred + dq - velocity, 0)))/count(*), 6) as loss, round(cast(sum(case when velocity <= pred + dq then 1 else 0 end) as double)/count(*), 6) as coverage from notes, lv group by level",
    cte("notes", NOTES),
    "lv as (select cast(a as double) as level, b as dq from (values " + ", ".join(f"({a}, {b})" for a, b in _Q.items()) + ") t(a, b))",
)
def pinball_calibration(spark, d):
    n, q = _quantiles(spark, d)
    return metrics.pinball(n, "velocity", q).select("level", _r("loss").alias("loss"), _r("coverage").alias("coverage"))


@_query(
    "select cast(nominal as double) as nominal, round(cast(sum(case when velocity between pred - w and pred + w then 1 else 0 end) as double)/count(*), 6) as coverage, cast(max(2*w) as double) as mean_width from notes, (values (0.9, 30), (0.8, 20), (0.5, 8)) t(nominal, w) group by nominal",
    cte("notes", NOTES),
)
def interval_coverage(spark, d):
    n, q = _quantiles(spark, d)
    return metrics.intervals(n, "velocity", q).withColumn("coverage", F.round("coverage", 6))


_EV = """ev as (select *, avg(velocity) over (partition by file_id, group_id) as ye, avg(pred) over (partition by file_id, group_id) as pe, count(*) over (partition by file_id, group_id) as n,
 row_number() over (partition by file_id, group_id order by note_idx desc) as tk from c)"""


@_query(
    """select round(avg(abs(pred - velocity)), 6) as all_mae, round(avg(case when tk = 1 then abs(pe - ye) end), 6) as event_mae, round(avg(case when n > 1 then abs((pred - pe) - (velocity - ye)) end), 6) as asynchrony_mae,
 round(avg(case when n > 1 and tk = 1 then velocity - ye end), 6) as top_lead_true, round(avg(case when n > 1 and tk = 1 then pred - pe end), 6) as top_lead_pred from ev""",
    ORACLE_NOTES,
    _EV,
)
def event_vs_asynchrony(spark, d):
    e = metrics.event_and_asynchrony(_canonical(spark, d), "velocity", "pred")
    return e.select(*(_r(c).alias(c) for c in e.columns))


@_query(
    """, gm as (select file_id, group_id, avg(velocity) as v, count(*) as n from c group by file_id, group_id), lg as (select *, lag(v) over (partition by file_id order by group_id) as p from gm),
pf as (select file_id, count(*) as k, stddev_pop(v) as sd, corr(v, p) as r from lg group by file_id)
select round((select stddev_pop(velocity) from c), 6) as sd, round((select stddev_pop(velocity - v) from c join gm using (file_id, group_id) where n > 1), 6) as asynchrony_sd,
 round((select stddev_samp(v) from gm), 6) as event_sd, round((select avg(r) from pf where k > 20 and sd > 0), 6) as event_lag1_r""",
    ORACLE_NOTES,
)
def realism_stats(spark, d):
    r = metrics.realism(_canonical(spark, d), "velocity")
    return r.select(*(_r(c).alias(c) for c in r.columns))


@_query("select pitch as key, count(*) as n, round(cast(sum(abs(pred - velocity)) as double)/count(*), 6) as mae, round(cast(sum(pred - velocity) as double)/count(*), 6) as bias from notes group by pitch having count(*) >= 200", cte("notes", NOTES))
def error_by_pitch(spark, d):
    return metrics.error_by(adapters.notes(spark, d), F.col("pitch"), "velocity", "pred", 200).withColumns({"mae": _r("mae"), "bias": _r("bias")})


@_query("select velocity // 4 as key, count(*) as n, round(cast(sum(abs(pred - velocity)) as double)/count(*), 6) as mae, round(cast(sum(pred - velocity) as double)/count(*), 6) as bias from notes group by velocity // 4 having count(*) >= 100", cte("notes", NOTES))
def error_by_bin(spark, d):
    return metrics.error_by(adapters.notes(spark, d), F.floor(F.col("velocity") / 4).cast("int"), "velocity", "pred", 100).withColumns({"mae": _r("mae"), "bias": _r("bias")})


@_query("select cast(tk - 1 as int) as voice_rank, count(*) as n, round(avg(velocity - ye), 6) as mean_dev from ev where n >= 2 and tk <= 6 group by tk", ORACLE_NOTES, _EV)
def asynchrony_by_voice(spark, d):
    return metrics.voice_asynchrony(_canonical(spark, d), "velocity").withColumn("mean_dev", F.round("mean_dev", 6))


@_query(
    """select p as pitch, coalesce(n, 0) as n, round(coalesce(m, (select cast(sum(velocity) as double)/count(*) from notes)), 6) as mean from (select cast(p as int) as p from range(128) t(p)) left join (select pitch, cast(sum(velocity) as double)/count(*) as m, count(*) as n from notes group by pitch) on pitch = p""",
    cte("notes", NOTES),
)
def per_pitch_baseline(spark, d):
    return metrics.pitch_means(adapters.notes(spark, d), "velocity").withColumn("mean", F.round("mean", 6))


@_query(
    """, m as (select file_id, group_id, min(onset_s)*2 as pos, max(velocity) as z from c group by file_id, group_id),
pr as (select a.z as a, b.z as b, b.pos - a.pos as d from m a join m b on b.file_id = a.file_id and b.group_id > a.group_id and b.group_id <= a.group_id + 12 where b.pos - a.pos < 8),
bn as (select *, case when d >= 6 then 11 when d >= 4 then 10 when d >= 3 then 9 when d >= 2 then 8 when d >= cast(1.5 as double) then 7 when d >= 1 then 6 when d >= cast(0.75 as double) then 5 when d >= cast(0.5 as double) then 4
 when d >= cast(0.375 as double) then 3 when d >= cast(0.25 as double) then 2 when d >= cast(0.125 as double) then 1 else 0 end as bin from pr)
select bin, count(*) as n, round(avg(d), 6) as centre, round((cast(sum(a*b) as double)/count(*) - cast(sum(a) as double)/count(*)*(cast(sum(b) as double)/count(*)))/(cast(sum(a*a + b*b) as double)/(2*count(*))
 - (cast(sum(a) as double)/count(*) + cast(sum(b) as double)/count(*))/2*((cast(sum(a) as double)/count(*) + cast(sum(b) as double)/count(*))/2)), 6) as corr from bn group by bin""",
    ORACLE_NOTES,
)
def pair_correlation_bins(spark, d):
    g = _canonical(spark, d).groupBy("file_id", "group_id").agg((F.min("onset_s") * 2).alias("pos"), F.max("velocity").alias("z"))
    return metrics.pair_correlation(g, "z", "pos").withColumns({"centre": _r("centre"), "corr": _r("corr")})


# --- scalar, folds, models -------------------------------------------------------------


@_query(
    """select file_id, note_id, cast(greatest(1, least(127, round_even(pm + (pred - pm)*cast(1.3 as double) + cast(4 as double), 0))) as int) as shaped,
 cast(greatest(1, least(127, round_even(pred*cast(0.75 as double) + velocity*cast(0.25 as double), 0))) as int) as mixed from notes join (select file_id, median(pred) as pm from notes group by file_id) using (file_id)""",
    cte("notes", NOTES),
)
def velocity_postprocess(spark, d):
    n = adapters.notes(spark, d).withColumn("pm", F.expr("percentile(pred, 0.5) over (partition by file_id)"))
    return n.select("file_id", "note_id", scalar.clip_velocity(scalar.shape_dynamics(F.col("pred"), F.col("pm"), 1.3, 4.0)).alias("shaped"), scalar.clip_velocity(scalar.mix(F.col("pred"), F.col("velocity"), 0.75)).alias("mixed"))


@_query(
    """, gm as (select file_id, group_id, cast(sum(velocity) as double)/count(*) as m from c group by file_id, group_id),
mx as (select file_id, max(group_id) as gx from gm group by file_id),
fw(file_id, group_id, e) as (select file_id, group_id, m from gm where group_id = 0 union all select g.file_id, g.group_id, cast(0.5 as double)*g.m + cast(0.5 as double)*f.e from fw f join gm g on g.file_id = f.file_id and g.group_id = f.group_id + 1),
bw(file_id, group_id, e) as (select gm.file_id, group_id, m from gm join mx on mx.file_id = gm.file_id and gx = group_id union all select g.file_id, g.group_id, cast(0.5 as double)*g.m + cast(0.5 as double)*f.e from bw f join gm g on g.file_id = f.file_id and g.group_id = f.group_id - 1)
select c.file_id, c.note_id, round(c.velocity + case when m - (fw.e + bw.e)/2 > 8 then 0 else (fw.e + bw.e)/2 - m end, 6) as smoothed
 from c join gm on gm.file_id = c.file_id and gm.group_id = c.group_id join fw on fw.file_id = c.file_id and fw.group_id = c.group_id join bw on bw.file_id = c.file_id and bw.group_id = c.group_id""",
    ORACLE_NOTES,
)
def ema_smoothing(spark, d):
    return folds.smooth_velocities(_canonical(spark, d)).select("file_id", "note_id", _r("smoothed").alias("smoothed"))


@_query(
    """, gm as (select file_id, group_id, (max(velocity) - 64)/cast(32 as double) as eta from c group by file_id, group_id),
a(file_id, group_id, x) as (select file_id, group_id, eta from gm where group_id = 0 union all select g.file_id, g.group_id, cast(0.6 as double)*f.x + cast(0.8 as double)*g.eta from a f join gm g on g.file_id = f.file_id and g.group_id = f.group_id + 1)
select file_id, cast(group_id as int) as group_id, round(x, 6) as latent from a""",
    ORACLE_NOTES,
)
def ar1_latent(spark, d):
    g = _canonical(spark, d).groupBy("file_id", "group_id").agg(((F.max("velocity") - 64) / 32).alias("eta")).withColumn("phi", F.lit(0.6))
    return folds.ar1(g, "eta", "phi").select("file_id", "group_id", _r("latent").alias("latent"))


@_query(
    """, s0 as (select event_id, (cast(event_id as uhugeint)*11400714819323198485) % 18446744073709551616 as z from events),
s1 as (select event_id, (cast(xor(z, z // 1073741824) as uhugeint)*13787848793156543929) % 18446744073709551616 as z from (select event_id, cast(z as ubigint) as z from s0)),
s2 as (select event_id, (cast(xor(z, z // 134217728) as uhugeint)*10723151780598845931) % 18446744073709551616 as z from (select event_id, cast(z as ubigint) as z from s1)),
s3 as (select event_id, xor(z, z // 2147483648) as z from (select event_id, cast(z as ubigint) as z from s2))
select event_id, (cast(z // 2048 as double) + cast(0.5 as double))/cast(9007199254740992 as double) as u from s3""",
    "one as (select 1)",
)
def splitmix_uniforms(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", scalar.splitmix_uniform(F.col("event_id")).alias("u"))


_TREES = [
    trees.Tree((1, -1, -1), (2, -1, -1), (0, 0, 0), (60.0, -2.0, 3.0), (True, False, False)),
    trees.Tree((1, -1, 3, -1, -1), (2, -1, 4, -1, -1), (1, 0, 0, 0, 0), (64.0, 1.0, 72.0, 0.5, -4.0), (False, False, True, False, False)),
]


@_query(
    """select file_id, note_id, cast(cast(0.5 as double) + case when pitch < 60 then -2 else 3 end + case when v is null then case when pitch < 72 then cast(0.5 as double) else -4 end when v < 64 then 1 when pitch < 72 then cast(0.5 as double) else -4 end as double) as score
 from (select *, case when velocity % 5 = 0 then null else velocity end as v from notes)""",
    cte("notes", NOTES),
)
def tree_score(spark, d):
    n = adapters.notes(spark, d).withColumn("v", F.when(F.col("velocity") % 5 != 0, F.col("velocity")))
    return trees.score(n, _TREES, ["pitch", "v"], base=0.5).select("file_id", "note_id", F.col("score").cast("double").alias("score"))


_MIDI_ORACLE = """select file_id, track, row_number() over (partition by file_id, track order by msg_index) - 1 as msg_index, tick, msg_type,
 case when msg_type <> 'set_tempo' then pitch end as pitch, case when msg_type <> 'set_tempo' then {velocity} end as velocity, case when msg_type = 'set_tempo' then tempo_us end as tempo_us from m"""


def _midi_files(spark, d):
    return smf.encode_files(adapters.midi_events(spark, d).withColumn("raw", smf.raw_of()))


def _midi_rows(rows):
    return rows.where("msg_type <> 'end_of_track'").select("file_id", "track", "msg_index", "tick", "msg_type", "pitch", "velocity", "tempo_us")


@_query(_MIDI_ORACLE.format(velocity="velocity"), cte("m", MIDI_EVENTS))
def smf_roundtrip(spark, d):
    return _midi_rows(smf.messages(smf.decode_files(_midi_files(spark, d))))


@_query(_MIDI_ORACLE.format(velocity="case when msg_type = 'note_on' and velocity > 0 then 64 else velocity end"), cte("m", MIDI_EVENTS))
def flat_copy(spark, d):
    """Decoded, flattened, encoded again and decoded again."""
    flat = smf.flat_copy(smf.messages(smf.decode_files(_midi_files(spark, d))))
    return _midi_rows(smf.messages(smf.decode_files(smf.encode_files(flat))))


@_query(
    """, moved as (select *, tick + case when msg_type = 'note_on' and velocity > 0 then 12 else 0 end as t,
 case when msg_type = 'set_tempo' then 0 when msg_type = 'note_on' and velocity > 0 then 3 else 1 end as k from m)
select file_id, track, row_number() over (partition by file_id, track order by t, k, msg_index) - 1 as msg_index, t as tick, msg_type,
 case when msg_type <> 'set_tempo' then pitch end as pitch, case when msg_type <> 'set_tempo' then velocity end as velocity, case when msg_type = 'set_tempo' then tempo_us end as tempo_us from moved""",
    cte("m", MIDI_EVENTS),
)
def retimed_file(spark, d):
    """Note starts 12 ticks later, written and read again."""
    rows = smf.messages(smf.decode_files(_midi_files(spark, d)))
    moves = rows.where("msg_type = 'note_on' and velocity > 0").select("file_id", "track", "msg_index", (F.col("tick") + 12).alias("new_tick"))
    return _midi_rows(smf.messages(smf.decode_files(smf.encode_files(smf.retime(rows, moves)))))


@_query(
    """select file_id, cast(note_idx as int) as note_idx, pitch, velocity, case when file_id % 10 < 7 then 'train' when file_id % 10 < 8 then 'validation' else 'test' end as split from c""",
    ORACLE_NOTES,
)
def feature_store_roundtrip(spark, d):
    """Built in two steps, the second of which skips the files that are there."""
    f = _canonical(spark, d).withColumn("split", metrics.split_of(F.col("file_id"))).select("file_id", "note_idx", "pitch", "velocity", "split")
    path = store.shared_folder(spark, "features")
    store.build(f.where("split = 'test'"), path, {"version": 1})
    store.build(f, path, {"version": 1})
    return store.read(spark, path, ["file_id", "note_idx", "pitch", "velocity", "split"])


@_query(
    """select a.file_id, a.note_id, cast(count(*) filter (where (b.onset_s, b.pitch, b.note_id) <= (a.onset_s, a.pitch, a.note_id) and b.onset_s >= a.onset_s - cast(3 as double)) as int) as trailing
 from loose a join loose b on a.file_id = b.file_id group by a.file_id, a.note_id""",
    cte("loose", LOOSE_NOTES),
)
def causal_trailing_count(spark, d):
    return causal.batch_counts(adapters.loose_notes(spark, d))


def _learnt(spark, d, quantile):
    n = _with_split(spark, d).select("file_id", "note_id", "split", "pitch", "velocity", "onset_s", "pred")
    grown, base = boosting.train(n.where("split = 'train'"), ["pitch", "pred", "onset_s"], "velocity", rounds=8, depth=4, rate=0.3, quantile=quantile)
    return trees.score(n, grown, ["pitch", "pred", "onset_s"], base).select("file_id", "note_id", F.col("score").cast("double").alias("score"))


@_query()
def gbt_train_predict(spark, d):
    return _learnt(spark, d, None)


@_query()
def quantile_forest(spark, d):
    """The 0.9 quantile."""
    return _learnt(spark, d, 0.9)


@_query()
def beat_tracking(spark, d):
    return tracking.track_beats(adapters.notes(spark, d))


_LEVELS = [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95]


def _forecasts(spark, d):
    """Canonical notes with quantile forecasts of ``velocity`` around ``pred``."""
    c = _canonical(spark, d).withColumn("beat", F.col("group_id") / 2)
    return c.withColumn("q", F.array(*(F.col("pred") + F.lit(x) for x in (-60.0, -45.0, -20.0, 0.0, 20.0, 45.0, 60.0))))


@_query(
    """, k as (select *, cast(velocity - pred as double) as y from c)
select file_id, note_id, round(greatest(cast(-3.5 as double), least(cast(3.5 as double), case
 when y <= -45 then -Z95 + (y + 60)/15*(Z95 - Z90) when y <= -20 then -Z90 + (y + 45)/25*(Z90 - Z75) when y <= 0 then -Z75 + (y + 20)/20*Z75
 when y <= 20 then y/20*Z75 when y <= 45 then Z75 + (y - 20)/25*(Z90 - Z75) else Z90 + (y - 45)/15*(Z95 - Z90) end)), 6) as z from k""".replace("Z95", repr(scalar.inverse_normal(0.95)) + "::double").replace("Z90", repr(scalar.inverse_normal(0.9)) + "::double").replace("Z75", repr(scalar.inverse_normal(0.75)) + "::double"),
    ORACLE_NOTES,
)
def normal_scores(spark, d):
    z = sampling.normal_score(F.col("q"), _LEVELS, F.col("velocity").cast("double"))
    return _forecasts(spark, d).select("file_id", "note_id", F.round(z, 6).alias("z"))


@_query()
def copula_takes(spark, d):
    """The sampler is fitted on all notes and draws one take of them."""
    f = _forecasts(spark, d)
    copula = sampling.fit(f.withColumn("z", sampling.normal_score(F.col("q"), _LEVELS, F.col("velocity").cast("double"))))
    return sampling.sample_offsets(f, "q", _LEVELS, copula, seed=1).select("file_id", "note_id", "latent", "sampled")


@_query(
    """, ends as (select file_id, group_id, max(greatest(offset_s, onset_s)) as g_off from c group by file_id, group_id),
s0 as (select p.file_id, p.group_id, p.g_time, p.beat_pos as b, p.g_size as n, max(e.g_off) over (partition by p.file_id order by p.group_id) as sound_end from pos p join ends e on e.file_id = p.file_id and e.group_id = p.group_id),
s1 as (select *, case when lag(g_time) over w is null or g_time - lag(sound_end) over w >= cast(0.2 as double)
 or (b - lag(b) over w >= cast(1.5 as double) and g_time - lag(g_time) over w >= cast(0.35 as double)) then 1 else 0 end as first from s0 window w as (partition by file_id order by group_id)),
s2 as (select *, sum(first) over (partition by file_id order by group_id) as seg from s1)
select file_id, cast(group_id as int) as group_id, cast(seg as bigint) as phrase_seg, round(b - min(b) over ph, 6) as time_since_phrase_start_beats, round(max(b) over ph - min(b) over ph, 6) as phrase_length_beats,
 round(case when max(b) over ph > min(b) over ph then (b - min(b) over ph)/(max(b) over ph - min(b) over ph) end, 6) as phrase_pos_norm,
 cast(sum(n) over ph as bigint) as phrase_notes from s2 window ph as (partition by file_id, seg)""",
    ORACLE_NOTES,
    ORACLE_BEATS,
    _BEAT_OF,
)
def phrases_in_beats(spark, d):
    c = _canonical(spark, d).join(_positions(spark, d).select("file_id", "group_id", F.col("beat_pos").alias("g_beat")), ["file_id", "group_id"])
    s = context.segments(c, beats=True)
    return s.select("file_id", "group_id", "phrase_seg", *(_r(x).alias(x) for x in ("time_since_phrase_start_beats", "phrase_length_beats", "phrase_pos_norm")), "phrase_notes")


# --- all columns -----------------------------------------------------------------------


def _features_oracle(causal: bool) -> str:
    """Every column from joins and windows over DuckDB's own tables, none shared with the plan."""
    end = "current row" if causal else "cast({0} as double) following"
    by = "(partition by file_id order by group_id)"
    windows, note_side = [], []
    for tag, width, order in features.window_tags(features.Settings(causal=causal)):
        f = f"over (partition by file_id order by {order} range between cast({width} as double) preceding and {end.format(width)})"
        total = f"cast({width if causal else 2 * width} as double)"
        windows += [
            f"sum(n) {f}/{total} as {tag}_note_density", f"count(*) {f}/{total} as {tag}_onset_density", f"cast(sum(p_sum) {f} as double)/sum(n) {f} as {tag}_mean_pitch",
            f"max(p_max) {f} - min(p_min) {f} as {tag}_pitch_range", f"sum(dur_sum) {f}/sum(n) {f} as {tag}_mean_dur", f"cast(sum((held + n)*n) {f} as double)/sum(n) {f} as {tag}_mean_polyphony",
        ]
        note_side.append(f"pitch - {tag}_mean_pitch as {tag}_pitch_rel_mean")
    for k in (8, 32):
        f = f"over (partition by file_id order by note_idx rows between {k} preceding and {'current row' if causal else f'{k} following'})"
        note_side += [
            f"pitch - median(pitch) {f} as n{k}_pitch_rel_median", f"pitch - cast(sum(pitch) {f} as double)/count(*) {f} as n{k}_pitch_rel_mean", f"max(pitch) {f} - min(pitch) {f} as n{k}_pitch_range",
            f"cast(len(list_filter(list(pitch) {f}, lambda v: v < pitch)) as double)/count(*) {f} as n{k}_pitch_pct",
            f"case when count(*) {f} > 1 then (max(g_time) {f} - min(g_time) {f})/(count(*) {f} - 1) end as n{k}_time_per_note",
        ]
    near = _NEAR.replace("b.pitch as n_pitch", "b.pitch as n_pitch, b.dur_s as n_dur")
    tol = "cast(0.12 as double)"
    ctes = f"""{ORACLE_NOTES}, {ORACLE_BEATS}, {_BEAT_OF},
bi as (select beat, coalesce(lead(time_s) over (order by beat) - time_s, time_s - lag(time_s) over (order by beat)) as ibi from (select distinct beat, time_s from beats)),
tp as (select b.beat, cast(60 as double)/median(x.ibi) as tempo from bi b cross join (values (-2), (-1), (0), (1), (2)) k(k) join bi x on x.beat = greatest(0, least(31, b.beat + k.k)) group by b.beat),
nb as (select c.file_id, c.note_idx, s.beat + (c.onset_s - s.time_s)/(s.next_s - s.time_s) as on_b, e.beat + (c.offset_s - e.time_s)/(e.next_s - e.time_s) as off_b from c
 join seg s on s.file_id = c.file_id and s.next_s is not null and (c.onset_s >= s.time_s or s.beat = 0) and (c.onset_s < s.next_s or s.beat = 30)
 join seg e on e.file_id = c.file_id and e.next_s is not null and (c.offset_s >= e.time_s or e.beat = 0) and (c.offset_s < e.next_s or e.beat = 30)),
{_PROFILE.replace("as dur_us,", "as dur_us, sum(dur_s) as dur_sum, sum(pitch*pitch) as p_sq, max(offset_s) as g_off, min(note_idx) as first_idx,")},
pb as (select p.*, q.beat_pos as g_beat, max(g_off) over (partition by p.file_id order by p.group_id rows between unbounded preceding and current row) as sound_end from prof p join pos q on q.file_id = p.file_id and q.group_id = p.group_id),
pg as (select *, g_time - lag(g_time) over {by} as ioi_prev_s, g_beat - lag(g_beat) over {by} as ioi_prev_beats, lead(g_time) over {by} - g_time as ioi_next_s, lead(g_beat) over {by} - g_beat as ioi_next_beats,
 avg(p_max) over (partition by file_id order by group_id rows between 2 preceding and 1 preceding) as before, avg(p_max) over (partition by file_id order by group_id rows between 1 following and 2 following) as after,
 coalesce(g_time - lag(sound_end) over {by} >= cast(0.2 as double), true) as rs from pb),
pf as (select *, rs or (ioi_prev_beats >= cast(1.5 as double) and ioi_prev_s >= cast(0.35 as double)) as ps from pg),
ps as (select *, sum(case when rs then 1 else 0 end) over {by} as rseg, sum(case when ps then 1 else 0 end) over {by} as pseg from pf),
pw as (select *, g_time - min(g_time) over (partition by file_id, rseg) as time_since_rest_s, max(sound_end) over (partition by file_id, rseg) - g_time as time_to_rest_s,
 g_beat - min(g_beat) over (partition by file_id, pseg) as since, max(g_beat) over (partition by file_id, pseg) - g_beat as till, min(first_idx) over (partition by file_id, pseg) as ph_first,
 max(first_idx + n) over (partition by file_id, pseg) as ph_end, min(g_time) over (partition by file_id) as begin_s, max(g_time) over (partition by file_id) as last_s,
 sum(n) over (partition by file_id order by g_beat range between cast(1 as double) preceding and current row) - n as notes_in_prev_beat,
 sum(n) over (partition by file_id order by g_beat range between current row and cast(1 as double) following) - n as notes_in_next_beat,
 cast(greatest(0, least(31, floor(g_beat))) as int) as bi, cast(greatest(0, least(31, round_even(g_beat, 0))) as int) as rb, g_beat - floor(g_beat) as frac,
 {", ".join(windows)} from ps),
pc as (select file_id, min(onset_s) as lo, max(offset_s) as hi, greatest(max(offset_s) - min(onset_s), cast(0.001 as double)) as secs, count(*) as pn, avg(pitch) as pmean, stddev_pop(pitch) as pstd from c group by file_id),
pq as (select pc.*, (select median(tp.tempo) from tp join bi on tp.beat = bi.beat join (select distinct beat, time_s from beats) z on z.beat = tp.beat where z.time_s between pc.lo and pc.hi) as tmid, y.mpoly, y.mchord
 from pc join (select file_id, cast(sum((held + n)*n) as double)/sum(n) as mpoly, cast(sum(n) as double)/count(*) as mchord from pb group by file_id) y on y.file_id = pc.file_id),
{near.format(step=-1)}, {near.format(step=1).replace("near as", "near2 as")},
sp as (select file_id, note_idx, onset_s - lag(onset_s) over (partition by file_id, pitch order by onset_s, note_idx) as spp, lead(onset_s) over (partition by file_id, pitch order by onset_s, note_idx) - onset_s as spn,
 count(*) over (partition by file_id order by onset_s range between cast(0.035 as double) preceding and cast(0.035 as double) following) as tolc from c),
a as (select c.note_id, c.note_idx, c.onset_s, c.pitch, c.dur_s, pw.*, t.tempo, nb.on_b, nb.off_b, pq.* exclude (file_id), p.n_pitch as pp, p.n_dur as pd, x.n_pitch as xp, x.n_dur as xd, sp.spp, sp.spn, sp.tolc,
 (select count(*) from range(0, cast(bi as bigint) + 1) r(b) where b % 4 = 0) as measure,
 case when abs(g_beat - round_even(g_beat, 0)) <= {tol} then case rb % 4 when 0 then 0 when 2 then 1 else 2 end when abs(frac*2 - round_even(frac*2, 0))/cast(2 as double) <= {tol} then 3
  when abs(frac*3 - round_even(frac*3, 0))/cast(3 as double) <= cast(0.06 as double) or abs(frac*4 - round_even(frac*4, 0))/cast(4 as double) <= cast(0.06 as double) then 4 else 5 end as level
 from c join pw on pw.file_id = c.file_id and pw.group_id = c.group_id join tp t on t.beat = pw.bi join nb on nb.file_id = c.file_id and nb.note_idx = c.note_idx join pq on pq.file_id = c.file_id
 join sp on sp.file_id = c.file_id and sp.note_idx = c.note_idx
 left join (select * from near where k = 1) p on p.file_id = c.file_id and p.note_idx = c.note_idx left join (select * from near2 where k = 1) x on x.file_id = c.file_id and x.note_idx = c.note_idx),
z as (select *, {", ".join(note_side)} from a)"""
    own = {
        "pitch": "pitch", "pitch_class": "pitch % 12", "octave": "pitch // 12 - 1", "beat_in_measure": "bi % 4 + frac", "beat_in_measure_norm": "(bi % 4 + frac)/4", "beat_frac": "frac",
        "metrical_level": "level", "on_beat": f"abs(g_beat - round_even(g_beat, 0)) <= {tol}", "strong_beat": "level <= 1", "is_downbeat": "level = 0", "dur_s": "dur_s", "dur_beats": "greatest(off_b - on_b, 0)",
        "onset_beat": "g_beat", "beat_index": "floor(g_beat)", "local_tempo_bpm": "tempo", "ts_num": "4", "ts_den": "4", "prev_interval": "pitch - pp", "abs_prev_interval": "abs(pitch - pp)",
        "ioi_prev_s": "ioi_prev_s", "ioi_prev_beats": "ioi_prev_beats", "prev_dur_s": "pd", "dur_ratio_prev": "log2((dur_s + cast(0.01 as double))/(pd + cast(0.01 as double)))",
        "next_interval": "xp - pitch", "abs_next_interval": "abs(xp - pitch)", "ioi_next_s": "ioi_next_s", "ioi_next_beats": "ioi_next_beats", "next_dur_s": "xd",
        "melodic_direction": "coalesce(sign(pitch - pp), 0)" + ("" if causal else " + coalesce(sign(xp - pitch), 0)"), "is_local_peak": "coalesce(pitch > pp and xp < pitch, false)",
        "is_local_trough": "coalesce(pitch < pp and xp > pitch, false)", "top_line_trend": "p_max - before" if causal else "after - before", "same_pitch_prev_dt": "spp", "same_pitch_next_dt": "spn",
        "chord_size": "n", "n_onsets_within_tol": "tolc", "held_notes_at_onset": "held", "polyphony_at_onset": "held + n", "chord_highest": "p_max", "chord_lowest": "p_min", "chord_span": "p_max - p_min",
        "chord_pos_norm": "case when p_max > p_min then cast(pitch - p_min as double)/(p_max - p_min) end", "dist_from_chord_top": "p_max - pitch", "dist_from_chord_bottom": "pitch - p_min",
        "chord_rank_from_top": "first_idx + n - 1 - note_idx", "chord_rank_from_bottom": "note_idx - first_idx", "is_chord_top": "first_idx + n - 1 = note_idx", "is_chord_bottom": "note_idx = first_idx",
        "measure_number": "measure", "time_since_phrase_start_beats": "since", "notes_since_phrase_start": "note_idx - ph_first", "phrase_pos_norm": "case when since + till > 0 then since/(since + till) end",
        "time_to_phrase_end_beats": "till", "phrase_length_beats": "since + till", "notes_to_phrase_end": "ph_end - 1 - note_idx",
        "rel_position": "(g_time - begin_s)/greatest(last_s - begin_s, cast(0.000001 as double))", "piece_duration_s": "secs", "piece_note_rate": "pn/secs", "piece_mean_pitch": "pmean", "piece_pitch_std": "pstd",
        "piece_mean_polyphony": "mpoly", "piece_mean_chord_size": "mchord", "piece_median_tempo_bpm": "tmid", "pitch_rel_piece_mean": "pitch - pmean",
    }
    ahead = ("next_", "abs_next", "ioi_next", "is_local", "same_pitch_next", "time_to_", "phrase_", "notes_to_", "rel_position", "piece_", "pitch_rel_piece", "notes_in_next")
    same = [x.split(" as ")[-1] for x in windows + note_side] + ["notes_in_prev_beat", "notes_in_next_beat", "time_since_rest_s", "time_to_rest_s"]
    shown = {k: v for k, v in (own | {x: x for x in same}).items() if not (causal and k.startswith(ahead))}
    return f"with {ctes} select file_id, note_id, cast(group_id as int) as group_id, " + ", ".join(f"round(cast(cast({v} as float) as double), 4) as {k}" for k, v in shown.items()) + " from z"


def _features_query(causal: bool):
    def run(spark, d):
        t = features.feature_table(adapters.notes(spark, d), adapters.beats(spark, d), features.Settings(causal=causal))
        return t.select("file_id", "note_id", "group_id", *(F.round(F.col(x).cast("double"), 4).alias(x) for x in t.columns[6:]))

    return run


for _causal in (False, True):
    _name = "feature_table_causal" if _causal else "feature_table"
    QUERIES[_name], ORACLES[_name] = _features_query(_causal), _features_oracle(_causal)


from . import catalog_reports, catalog_timing  # noqa: E402, F401  they register more queries
