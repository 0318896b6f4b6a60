"""Note-shaped views over the driver's ``events`` table. The column expressions are valid
in Spark SQL and DuckDB alike, so queries and oracles start from the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NOTES = [
    "cast(user_id as int) as file_id",
    "event_id as note_id",
    "cast((event_id*7919 % 96)*125 + event_id*104729 % 30 as double)/cast(1000 as double) as onset_s",
    "cast((event_id*7919 % 96)*125 + event_id*104729 % 30 + 40 + event_id*15485863 % 900 as double)/cast(1000 as double) as offset_s",
    "cast(36 + event_id*31 % 48 as int) as pitch",
    "cast(1 + event_id*53 % 127 as int) as velocity",
    "cast(1 + (event_id*53 + 17 + event_id*97 % 40) % 127 as int) as pred",
]
LOOSE_NOTES = [
    "cast(user_id as int) as file_id",
    "event_id as note_id",
    "cast(event_id*7919 % 4000 as double)/cast(1000 as double) as onset_s",
    "cast(36 + event_id*31 % 48 as int) as pitch",
]
MIDI_EVENTS = [
    "cast(user_id as int) as file_id",
    "cast(event_id % 2 as int) as track",
    "event_id as msg_index",
    "cast(event_id*8 as bigint) as tick",
    "case when event_type in ('click','view') then 'note_on' when event_type in ('purchase','error') then 'note_off' else 'set_tempo' end as msg_type",
    "cast(0 as int) as channel",
    "cast(60 + event_id % 5 as int) as pitch",
    "cast(event_id*53 % 127 as int) as velocity",
    "cast(400000 + (event_id*31 % 200)*1000 as int) as tempo_us",
]


def _view(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*columns)


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, NOTES)


def loose_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, LOOSE_NOTES)


def midi_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, MIDI_EVENTS)


def beats(spark: SparkSession, sf_dir: str, n: int = 32) -> DataFrame:
    """A wobbling grid of ``n`` beats for every file, in bars of 4/4."""
    files = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("cast(user_id as int) as file_id").distinct()
    return files.selectExpr("file_id", f"explode(sequence(0, {n - 1})) as beat").selectExpr(
        "file_id", "beat", "cast(beat*500 + beat*beat % 37 as double)/cast(1000 as double) as time_s", "beat % 4 as beat_in_bar", "4 as beats_per_bar"
    )


def cte(name: str, columns: list[str]) -> str:
    return f"{name} as (select {', '.join(columns)} from events)"


#: Oracle side: canonical notes by slot (slots are wider apart than the chord tolerance).
ORACLE_NOTES = (
    cte("notes", NOTES)
    + """,
slotted as (select *, dense_rank() over (partition by file_id order by cast(floor(onset_s*8) as int)) - 1 as group_id from notes),
c as (select *, row_number() over (partition by file_id order by group_id, pitch, onset_s, note_id) - 1 as note_idx,
  offset_s - onset_s as dur_s from slotted),
g as (select file_id, group_id, min(onset_s) as g_time, min(pitch) as g_low, max(pitch) as g_top, count(*) as g_size from c group by file_id, group_id)"""
)
ORACLE_BEATS = """beats as (select file_id, cast(b as int) as beat, cast(b*500 + b*b % 37 as double)/cast(1000 as double) as time_s, cast(b % 4 as int) as beat_in_bar, 4 as beats_per_bar
  from (select distinct cast(user_id as int) as file_id from events), range(32) t(b))"""
