"""Queries of reports, sampling and small rules, with their oracle SQL; registered with those of
``catalog``."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _LEVELS, _SPLIT, _canonical, _query, _r, _with_split
from .functions import scalar, sql
from .operators import boosting, metrics, reports, trees
from .sources import adapters, files
from .sources.adapters import NOTES, ORACLE_BEATS, ORACLE_NOTES, cte

_METRICS = """count(*) as n, round(avg(abs(p - y)), 6) as mae, round(sqrt(avg((p - y)*(p - y))), 6) as rmse, round(avg(p - y), 6) as bias"""


@_query(
    f""", tr as (select avg(velocity) as gm, median(velocity) as gd from sp where split = 'train'),
pp as (select pitch, avg(velocity) as m from sp where split = 'train' group by pitch),
t as (select sp.*, avg(velocity) over (partition by file_id) as my, avg(pred) over (partition by file_id) as mp from sp where split = 'test'),
rows_ as (select 'model' as label, velocity as y, cast(pred as double) as p from t union all select 'global mean', velocity, gm from t, tr union all select 'global median', velocity, gd from t, tr
 union all select 'per-pitch mean', velocity, coalesce(pp.m, gm) from t left join pp using (pitch), tr union all select 'oracle: file mean', velocity, my from t
 union all select 'oracle: centred model', velocity, greatest(1, least(127, pred - mp + my)) from t)
select label, {_METRICS} from rows_ group by label""",
    cte("notes", NOTES),
    _SPLIT,
)
def baselines_report(spark, d):
    n = _with_split(spark, d)
    m = reports.baselines_report(n.where("split = 'test'"), n.where("split = 'train'"), "velocity", "pred")
    return m.select("label", "n", *(_r(c).alias(c) for c in ("mae", "rmse", "bias")))


@_query(
    """select count(*) as n, round(avg(velocity), 6) as global_mean, round(median(velocity), 6) as global_median from sp where split = 'train'""",
    cte("notes", NOTES),
    _SPLIT,
)
def train_stats(spark, d):
    s = reports.train_stats(_with_split(spark, d).where("split = 'train'"), "velocity")
    return s.select("n", _r("global_mean").alias("global_mean"), _r("global_median").alias("global_median"))


@_query(
    """select split, count(distinct file_id) as files, count(*) as notes, round(avg(velocity), 6) as mean, round(stddev_pop(velocity), 6) as std, min(velocity) as min,
 round(quantile_cont(velocity, 0.05), 6) as p5, round(quantile_cont(velocity, 0.25), 6) as p25, round(quantile_cont(velocity, 0.5), 6) as p50, round(quantile_cont(velocity, 0.75), 6) as p75, round(quantile_cont(velocity, 0.95), 6) as p95, max(velocity) as max
 from sp group by split""",
    cte("notes", NOTES),
    _SPLIT,
)
def split_table(spark, d):
    s = reports.split_table(_with_split(spark, d), "velocity")
    return s.select("split", "files", "notes", *(_r(c).alias(c) for c in ("mean", "std")), "min", *(_r(c).alias(c) for c in ("p5", "p25", "p50", "p75", "p95")), "max")


@_query(
    f""", t as (select velocity as y, pred as p, row_number() over (partition by file_id, group_id order by note_idx desc) = 1 as top, count(*) over (partition by file_id, group_id) > 1 as multi,
 avg(velocity) over (partition by file_id, group_id) as my, avg(pred) over (partition by file_id, group_id) as mp from c),
u as (select 'all' as part, cast(y as double) as y, cast(p as double) as p from t union all select 'event', my, mp from t where top union all select 'asynchrony', y - my, p - mp from t where multi
 union all select 'top_lead', y - my, p - mp from t where multi and top)
select part, {_METRICS}, round(corr(y, p), 6) as pearson from u group by part""",
    ORACLE_NOTES,
)
def median_metrics(spark, d):
    m = reports.median_metrics(_canonical(spark, d), "velocity", "pred")
    return m.select("part", "n", *(_r(c).alias(c) for c in ("mae", "rmse", "bias", "pearson")))


@_query(
    """select round(round_even((onset_s*2 - floor(onset_s*2))*12, 0)/12 % 1, 3) as frac, count(*) as n, round(avg(velocity), 6) as y, round(avg(pred), 6) as p from notes group by 1 having count(*) >= 20""",
    cte("notes", NOTES),
)
def offset_by_beat_position(spark, d):
    b = F.col("onset_s") * 2
    o = reports.offset_by_beat_position(adapters.notes(spark, d), b - F.floor(b), "velocity", "pred", 20)
    return o.select("frac", "n", _r("y").alias("y"), _r("p").alias("p"))


@_query(
    ", ".join(["select round(quantile_cont(velocity, 0.05), 6) as q0", *(f"round(quantile_cont(velocity, {a}), 6) as q{i}" for i, a in enumerate(_LEVELS) if i)]) + " from notes where pitch % 3 > 0",
    cte("notes", NOTES),
)
def unconditional_quantiles(spark, d):
    q = reports.unconditional_quantiles(adapters.notes(spark, d).withColumn("w", F.col("pitch") % 3), "velocity", _LEVELS, "w")
    return q.select(*(F.round(F.col("q")[i], 6).alias(f"q{i}") for i in range(len(_LEVELS))))


@_query("select file_id, count(distinct case when note_id % 50 = 0 then 'test' else 'train' end) as n from notes where file_id % 2 = 0 group by file_id having n > 1", cte("notes", NOTES))
def split_overlap_found(spark, d):
    """A split by notes, in which files do overlap."""
    n = adapters.notes(spark, d).withColumn("split", F.when((F.col("note_id") % 50 == 0) & (F.col("file_id") % 2 == 0), "test").otherwise("train"))
    return metrics.overlapping_files(n)


@_query()
def unconditional_draws(spark, d):
    n = reports.unconditional_draws(adapters.notes(spark, d), "velocity", _LEVELS, ["note_id"], seed=5)
    return n.select("file_id", "note_id", _r("draw").alias("draw"))


@_query("select file_id, note_id from notes order by md5('3|' || cast(file_id as varchar) || '|' || cast(note_id as varchar)) limit 50", cte("notes", NOTES))
def row_sample(spark, d):
    return reports.row_sample(adapters.notes(spark, d), ["file_id", "note_id"], 50, 3).select("file_id", "note_id")


@_query(
    """, x as (select file_id, case when (file_id + beat) % 3 = 0 then 3 else 4 end as num, case when beat % 2 = 0 then 8 else 4 end as den from beats),
a as (select file_id, num, row_number() over (partition by file_id order by count(*) desc, num) as k from x group by file_id, num),
b as (select file_id, den, row_number() over (partition by file_id order by count(*) desc, den) as k from x group by file_id, den)
select file_id, cast(num as varchar) || '/' || cast(den as varchar) || ' (estimated)' as meter from a join b using (file_id) where a.k = 1 and b.k = 1""",
    ORACLE_BEATS,
)
def meter_labels(spark, d):
    b = adapters.beats(spark, d).withColumn("beats_per_bar", F.expr("case when (file_id + beat) % 3 = 0 then 3 else 4 end")).withColumn("beat_unit", F.expr("case when beat % 2 = 0 then 8 else 4 end"))
    return reports.meter_labels(b, estimated=True)


@_query(
    """select file_id, note_id, round(greatest(cast(-50 as double), least(cast(50 as double), (pred - velocity)*cast(1.5 as double))), 6) as offset_ms, cast(velocity + (pred - 64) as double) as velocity_from_delta,
 substr(trim(regexp_replace('Op. ' || cast(pitch as varchar) || ' / No.' || cast(note_id as varchar) || '!', '[^A-Za-z0-9]+', '_', 'g'), '_'), 1, 12) as slug from notes""",
    cte("notes", NOTES),
)
def small_rules(spark, d):
    n = adapters.notes(spark, d)
    title = F.concat(F.lit("Op. "), F.col("pitch").cast("string"), F.lit(" / No."), F.col("note_id").cast("string"), F.lit("!"))
    return n.select(
        "file_id", "note_id", _r(scalar.clamped_offset(F.col("pred") - F.col("velocity"), 1.5, 50)).alias("offset_ms"),
        scalar.to_velocity((F.col("pred") - 64).cast("double"), F.col("velocity")).alias("velocity_from_delta"), scalar.slug(title, 12).alias("slug"),
    )


@_query(
    """select file_id, note_id, cast(greatest(1, least(127, round_even(cast(pred as double)*cast(1.5 as double), 0))) as int) as clipped,
 round(case when abs(round_even(onset_s*6, 0)/cast(3 as double) - onset_s*2) < abs(round_even(onset_s*8, 0)/cast(4 as double) - onset_s*2) then round_even(onset_s*6, 0)/cast(3 as double) else round_even(onset_s*8, 0)/cast(4 as double) end, 6) as snapped from notes""",
    cte("notes", NOTES),
)
def sql_functions(spark, d):
    """The functions that are registered for SQL, called from SQL."""
    sql.register(spark)
    adapters.notes(spark, d).createOrReplaceTempView("scorespark_notes")
    return spark.sql("select file_id, note_id, clip_velocity(cast(pred as double)*1.5D) as clipped, round(snap_to(onset_s*2, 4, 3), 6) as snapped from scorespark_notes")


@_query("select file_id, note_id from notes where note_id % 97 = 0 or note_id % 89 = 0", cte("notes", NOTES))
def leakage_equality(spark, d):
    """Finds just the rows in which two feature frames differ by more than the tolerance, or that one lacks."""
    n = adapters.notes(spark, d).select("file_id", "note_id", "onset_s", "pitch")
    other = n.where("note_id % 97 <> 0").withColumn("onset_s", F.col("onset_s") + F.when(F.col("note_id") % 89 == 0, 1e-3).otherwise(1e-9))
    return reports.unequal_rows(n, other, ["file_id", "note_id"])


@_query(
    """select n.file_id, note_id, case when n.file_id % 4 > 0 then 'Composer ' || cast(n.file_id % 4 as varchar) end as canonical_composer, case when n.file_id % 4 > 0 then 'Piece ' || cast(n.file_id as varchar) end as canonical_title from notes n""",
    cte("notes", NOTES),
)
def file_titles(spark, d):
    n = adapters.notes(spark, d)
    table = n.select("file_id").distinct().where("file_id % 4 > 0").selectExpr("file_id", "concat('Composer ', file_id % 4) as canonical_composer", "concat('Piece ', file_id) as canonical_title")
    return files.with_metadata(n.select("file_id", "note_id"), table)


def _learnt(spark, d, features, **options):
    n = _with_split(spark, d).select("file_id", "split", "pitch", "velocity", "onset_s", "pred")
    grown, base = boosting.train(n.where("split = 'train'"), features, "velocity", depth=3, rate=0.3, **options)
    return n, grown, base


@_query()
def importance(spark, d):
    n, grown, _ = _learnt(spark, d, ["pitch", "pred", "onset_s"], rounds=5)
    return reports.importance(grown, ["pitch", "pred", "onset_s"], n.where("split = 'train'"))


@_query()
def ablation(spark, d):
    """The error of each larger set of inputs on files that were not learnt from."""
    out = None
    for name, features in (("A", ["pitch"]), ("B", ["pitch", "onset_s"]), ("C", ["pitch", "onset_s", "pred"])):
        n, grown, base = _learnt(spark, d, features, rounds=5)
        held = trees.score(n.where("split = 'test'"), grown, features, base)
        row = held.agg(F.lit(name).alias("feature_set"), F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("score") - F.col("velocity"))), 4).alias("mae"))
        out = row if out is None else out.unionByName(row)
    return out


@_query()
def seven_quantiles(spark, d):
    """All levels, with rows and columns drawn for each tree and early stopping on the validation files."""
    n = _with_split(spark, d).select("file_id", "note_id", "split", "pitch", "velocity", "onset_s", "pred").withColumn("w", (F.abs(F.col("pred") - F.col("velocity")) <= 60).cast("double"))
    features = ["pitch", "pred", "onset_s"]
    grown = boosting.train_quantiles(
        n.where("split = 'train'"), features, "velocity", _LEVELS, rounds=6, depth=3, rate=0.3, weight="w", subsample=0.8, colsample=0.8, validation=n.where("split = 'validation'"), patience=3
    )
    return trees.score_outputs(n.where("split = 'test'"), grown, features, len(_LEVELS), ascending=True, out="q").select("file_id", "note_id", "q")


@_query()
def gain_importance(spark, d):
    stats: list = []
    _learnt(spark, d, ["pitch", "pred", "onset_s"], rounds=5, stats=stats)
    return reports.gain_table(spark, stats)
