"""The feature table on small and odd inputs; its values are held against DuckDB in test_engine."""

import pytest

from scorespark.plans import features

NOTES = "file_id int, note_id int, onset_s double, offset_s double, pitch int, velocity int, note_idx int"
BEATS = "file_id int, beat int, time_s double, beat_in_bar int, beats_per_bar int, beat_unit int"


def grid_of(spark, files=(1,), n=8, meter=3, unit=8):
    return spark.createDataFrame([(f, i, 0.5 * i, i % meter, meter, unit) for f in files for i in range(n)], BEATS)


def table(spark, notes, beats, **options):
    df = features.feature_table(spark.createDataFrame(notes, NOTES), beats, features.Settings(**options))
    return {(r["file_id"], r["note_id"]): r.asDict() for r in df.collect()}


@pytest.mark.parametrize("causal, counts", [(False, [10, 7, 21, 21, 50, 10, 8]), (True, [10, 7, 13, 21, 49, 4, 0])])
def test_counts(spark, causal, counts):
    found = features.feature_columns(features.Settings(causal=causal))
    assert [len(found[g]) for g in ("core", "note", "melodic", "poly", "local", "structure", "piece")] == counts
    sizes = [len(features.feature_names(features.Settings(causal=causal), s)) for s in "ABCD"]
    assert sizes == ([10, 88, 109, 127] if not causal else [10, 79, 100, 104])


def test_empty_table(spark):
    assert table(spark, [], grid_of(spark)) == {}


def test_one_note_and_no_grid(spark):
    got = table(spark, [(1, 7, 0.5, 0.25, 60, 3, 99), (2, 8, 0.0, 1.0, 61, 3, 99)], grid_of(spark))
    a, b = got[1, 7], got[2, 8]
    assert a["note_idx"] == 0 and a["dur_s"] == 0 and a["onset_beat"] == 1 and a["ts_den"] == 8 and a["measure_number"] == 1
    assert a["prev_interval"] is None and a["next_interval"] is None and a["melodic_direction"] == 0 and a["held_notes_at_onset"] == 0
    assert a["rel_position"] == 0 and a["chord_pos_norm"] is None and a["n8_time_per_note"] is None and a["piece_pitch_std"] == 0
    assert b["onset_beat"] is None and b["metrical_level"] is None and b["dur_beats"] is None and b["win250ms_note_density"] == 2


def test_chord_and_positions_off_the_grid(spark):
    notes = [(1, 0, -0.25, 0.1, 60, 1, 0), (1, 1, 4.0, 9.0, 64, 1, 0), (1, 2, 4.03, 5.0, 67, 1, 0), (1, 3, 4.034, 5.0, 60, 1, 0), (1, 4, 4.036, 5.0, 60, 1, 0)]
    got = table(spark, notes, grid_of(spark))
    assert got[1, 0]["onset_beat"] == -0.5 and got[1, 0]["beat_index"] == -1 and got[1, 0]["beat_in_measure"] == 0.5
    assert {got[1, i]["group_id"] for i in (1, 2, 3)} == {1} and got[1, 4]["group_id"] == 2
    assert got[1, 3]["onset_beat"] == 8 and got[1, 3]["beat_in_measure"] == 1  # the last beat's place in its bar
    assert [got[1, i]["chord_rank_from_top"] for i in (3, 1, 2)] == [2, 1, 0] and got[1, 4]["held_notes_at_onset"] == 3


def test_causal_columns_ignore_what_follows(spark):
    notes = [(1, i, 0.3 * i, 0.3 * i + 0.2, 60 + i * 7 % 12, 1, 0) for i in range(12)]
    long, short = table(spark, notes, grid_of(spark), causal=True), table(spark, notes[:7], grid_of(spark), causal=True)
    assert all(long[k] == v for k, v in short.items())


def test_velocity_is_never_read(spark):
    notes = [(1, i, 0.3 * i, 0.3 * i + 0.2, 60 + i, 1 + i, 0) for i in range(6)]
    without = [r[:5] for r in notes]
    bare = features.feature_table(spark.createDataFrame(without, NOTES.split(", velocity")[0]), grid_of(spark)).collect()
    assert {(r["file_id"], r["note_id"]): r.asDict() for r in bare} == table(spark, notes, grid_of(spark))
