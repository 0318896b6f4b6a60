"""Every query with an oracle against DuckDB, hand-computed cases, and guards."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scorespark import catalog
from scorespark.functions import scalar
from scorespark.operators import context, folds, grid, grouping, trees


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{sf_dir}/events.parquet')")
    return con


def rows(df: pd.DataFrame) -> list:
    df = df.astype(object)
    clean = [tuple(None if pd.isna(v) else v for v in r) for r in df[sorted(df.columns)].itertuples(index=False)]
    return sorted(clean, key=lambda r: [(v is not None, v if v is not None else 0) for v in r])


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_oracle(spark, sf_dir, oracle, name):
    got, want = catalog.QUERIES[name](spark, sf_dir).toPandas(), oracle.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_baseline_skips_the_own_chord(spark):
    """A loud chord doesn't pull its own baseline: of three notes on either side those of other
    chords count."""
    v, g = [30, 34, 90, 96, 99, 38, 42], [0, 1, 2, 2, 2, 3, 4]
    c = spark.createDataFrame([(5, i, g[i], v[i]) for i in range(7)], "file_id int, note_idx int, group_id int, velocity int")
    got = {r["note_idx"]: r["baseline_velocity"] for r in context.residual_baseline(c, 3).collect()}
    assert [got[i] for i in (2, 3, 4)] == [34, 36, 38]


def test_smoothing_moves_chords_whole(spark):
    """Notes of a chord keep their distances; a chord far above the trend is an accent and stays."""
    v, g = [40, 43, 49, 44, 52, 90, 41, 46, 42], [0, 0, 0, 1, 1, 2, 3, 3, 4]
    c = spark.createDataFrame([(2, i, g[i], v[i]) for i in range(9)], "file_id int, note_idx int, group_id int, velocity int")
    got = [r["smoothed"] for r in folds.smooth_velocities(c, 0.3, 0.7, 12.0).orderBy("note_idx").collect()]
    assert got[5] == 90
    for k in set(g):
        moved = {round(got[i] - v[i], 9) for i in range(9) if g[i] == k}
        assert len(moved) == 1 and (k == 2) == (moved == {0.0})


def test_a_beat_snaps_to_one_step(spark):
    """Triplets and quarters of a beat aren't mixed: the beat's better step takes all its notes."""
    b = {0: [5.01, 5.32, 5.68], 1: [7.02, 7.24, 7.76], 2: [8.5]}
    p = spark.createDataFrame([(1, 10 * k + i, x) for k, xs in b.items() for i, x in enumerate(xs)], "file_id int, i int, b double")
    got = {r["i"]: r["snapped"] for r in grid.snap_per_beat(p, "b", [4, 3], 0.001).collect()}
    assert [got[i] for i in (0, 1, 2)] == pytest.approx([5, 16 / 3, 17 / 3])
    assert [got[i] for i in (10, 11, 12)] == [7, 7.25, 7.75] and got[20] == 8.5


@pytest.mark.parametrize("half", [1, 4])
def test_smoothing_keeps_a_steady_tempo(spark, half):
    beats = spark.createDataFrame([(f, i, 3.0 + (0.31 + 0.2 * f) * i) for f in (0, 1) for i in range(23)], "file_id int, beat int, time_s double")
    assert all(r["smooth_s"] == pytest.approx(r["time_s"], abs=1e-9) for r in grid.smooth_beats(beats, half).collect())


def test_strikes_of_a_key_stay_in_order(spark):
    """Three strikes whose new onsets collide, and another key that is left alone."""
    rows = [(1, 0, 0, 64, 0, 100, 190), (1, 0, 0, 64, 1, 100, 400), (1, 0, 0, 64, 2, 90, 95), (1, 0, 0, 65, 3, 50, 60)]
    n = spark.createDataFrame(rows, "file_id int, track int, channel int, pitch int, note_id int, onset_tick long, offset_tick long")
    got = [(r["onset_tick"], r["offset_tick"]) for r in grid.same_key_consistent(n).orderBy("note_id").collect()]
    assert got == [(100, 101), (101, 102), (102, 103), (50, 60)]


def test_splitmix_known_answer(spark):
    u = [r[0] for r in spark.range(1, 3).select(scalar.splitmix_uniform(F.col("id"), 0)).collect()]
    assert u == [((0xE220A8397B1DCDAF >> 11) + 0.5) / 2**53, ((0x6E789E6AA1B965F4 >> 11) + 0.5) / 2**53]


def test_held_notes_ties(spark):
    c = spark.createDataFrame([(1, 0, 0, 60, 0.0, 1.0), (1, 1, 1, 62, 1.0, 2.0), (1, 2, 2, 64, 1.5, 1.6)], "file_id int, note_idx int, group_id int, pitch int, onset_s double, offset_s double")
    assert {r["group_id"]: r["held"] for r in grouping.held_notes(c).collect()} == {0: 0, 1: 0, 2: 1}


@pytest.mark.parametrize("columns", [["dur_s", "velocity_delta"], ["pc_chord_mates_mean_velocity", "pitch"], ["group_id"]])
def test_guard(columns):
    with pytest.raises(ValueError):
        trees.guard_inputs(columns)
    trees.guard_inputs(["pitch", "dur_s"])


def test_guard_of_timing():
    with pytest.raises(ValueError):
        trees.guard_inputs(["pitch", "perf_onset_s"], timing=True)


def test_groups_of_odd_rows(spark):
    """A note without an onset is in no group; notes without a file are one file."""
    rows = [(None, 1, 0.0, 60), (None, 2, 0.02, 61), (None, 3, 0.5, 62), (4, 4, None, 60), (4, 5, 0.1, 60), (4, 6, 0.13, 60), (4, 7, 0.14, 60)]
    n = spark.createDataFrame(rows, "file_id int, note_id int, onset_s double, pitch int").withColumn("odd name", F.lit(1))
    got = {r["note_id"]: r["group_id"] for r in grouping.anchored_groups(n).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: None, 5: 0, 6: 0, 7: 1}
    with pytest.raises(ValueError):
        grouping.anchored_groups(n.withColumn("group_id", F.lit(0)))


def test_averages_of_odd_rows(spark):
    rows = [(None, 0, 8.0), (None, 1, None), (None, 2, 4.0), (1, 0, None), (1, 1, 6.0)]
    g = spark.createDataFrame(rows, "file_id int, group_id int, v double")
    got = {(r["file_id"], r["group_id"]): r["ema"] for r in folds.ema(g, "v", 0.5).collect()}
    assert got == {(None, 0): 8.0, (None, 1): None, (None, 2): 6.0, (1, 0): None, (1, 1): 6.0}
