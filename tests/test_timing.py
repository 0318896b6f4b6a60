"""Timing, grids, reports, settings and files: hand-made cases and round trips."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorespark import config
from scorespark.functions import sql
from scorespark.operators import grid, onsets, reports, trees
from scorespark.plans import timing
from scorespark.sources import files, smf

BEATS = "file_id int, beat int, time_s double, beat_in_bar int, beats_per_bar int"


def steady(spark, n=24, step=0.5, meter=3, start=0.0):
    return spark.createDataFrame([(1, i, start + step * i, i % meter, meter) for i in range(n)], BEATS)


def test_score_of_a_shifted_performance(spark):
    """Chords that were moved by known amounts come back to their places, the amounts as targets."""
    shift = [0.0, 12.0, -9.0, 20.0, -15.0, 6.0, 0.0, 11.0]
    rows, want = [], {}
    for i, ms in enumerate(shift):
        for k, pitch in enumerate((60, 64, 67)):
            at = 1.0 + 0.5 * i + ms / 1000 + 0.002 * k
            rows.append((1, 3 * i + k, at, at + 0.4, pitch))
            want[3 * i + k] = (2.0 + i, ms + 2 * k)
    notes = spark.createDataFrame(rows, "file_id int, note_id int, onset_s double, offset_s double, pitch int")
    got = {r["note_id"]: r for r in timing.timing_targets(timing.reconstruct_score(notes, steady(spark))).collect()}
    assert len(got) == 24
    assert all(r["score_beat"] == want[i][0] and abs(r["offset_ms"] - want[i][1]) < 1e-3 for i, r in got.items())
    table = timing.featurize_performance(notes, steady(spark), feature_set="A")
    assert table.count() == 24 and {"offset_ms", "pitch"} <= set(table.columns)


def test_extended_grid_covers_and_keeps_the_meter(spark):
    g = spark.createDataFrame([(1, i, 5.0 + 0.5 * i, (i + 1) % 3, 3) for i in range(6)], BEATS)
    spans = spark.createDataFrame([(1, 0.0, 9.9)], "file_id int, t_start double, t_end double")
    got = grid.extend_grid(g, spans).orderBy("beat").collect()
    assert got[0]["time_s"] == 0.0 and got[-1]["time_s"] == 10.0 and [r["beat"] for r in got] == list(range(21))
    assert all((b["beat_in_bar"] - a["beat_in_bar"]) % 3 == 1 for a, b in zip(got, got[1:]))


def test_a_span_of_whole_beats_gets_no_beat_more(spark):
    """At 100 a minute 4.2 s are 7 beats, and 13.8 s are 23; 4.201 s need one more."""
    spans = spark.createDataFrame([(1, 0.0, 4.2), (2, 0.0, 13.8), (3, 0.001, 4.201), (4, 0.0, 4.201), (5, 1.0, 1.0)], "file_id int, t_start double, t_end double")
    g = grid.regular_grid(spans, 100.0, 3).groupBy("file_id").agg(F.count("*").alias("n"), F.max("time_s").alias("last"))
    got = {r["file_id"]: (r["n"], round(r["last"], 6)) for r in g.collect()}
    assert got == {1: (8, 4.2), 2: (24, 13.8), 3: (8, 4.201), 4: (9, 4.8), 5: (2, 1.6)}


def test_grids_without_beats(spark):
    g = spark.createDataFrame([(1, 0, 2.0, 0, 3)], BEATS)
    got = grid.usable_grid(g, spark.createDataFrame([(1,), (2,)], "file_id int")).orderBy("file_id", "beat").collect()
    assert [(r["file_id"], r["time_s"], r["beats_per_bar"]) for r in got] == [(1, 0.0, 4), (1, 1.0, 4), (2, 0.0, 4), (2, 1.0, 4)]


def test_ticks_and_seconds_are_inverse(spark):
    m = spark.createDataFrame([(1, 0, 0, 0, "set_tempo", 600_000), (1, 0, 1, 960, "set_tempo", 300_000), (1, 0, 2, 2000, "set_tempo", 450_000)], "file_id int, track int, msg_index int, tick long, msg_type string, tempo_us int")
    tempos = grid.tempo_map(m)
    ticks = spark.createDataFrame([(1, t) for t in (0, 5, 959, 960, 961, 1999, 2000, 9000)], "file_id int, tick long")
    there = grid.to_seconds(ticks, tempos).withColumnRenamed("tick", "old")
    assert all(abs(r["tick"] - r["old"]) < 1e-6 for r in grid.to_ticks(there, tempos).collect())
    early = spark.createDataFrame([(1, -0.6)], "file_id int, seconds double")
    assert grid.to_ticks(early, tempos).first()["tick"] == pytest.approx(-480)


def test_nearest_of_two_is_the_earlier(spark):
    p = spark.createDataFrame([(1, 1.0), (1, 9.0), (2, 1.0)], "file_id int, t double")
    m = spark.createDataFrame([(1, 0.5, "a"), (1, 1.5, "b")], "file_id int, u double, name string")
    got = {(r["file_id"], r["t"]): r["near"] for r in onsets.with_nearest(p, m, "t", "u", "name", "near").collect()}
    assert got == {(1, 1.0): "a", (1, 9.0): "b", (2, 1.0): None}


def midi(notes, tempo=500_000, division=480):
    tracks = [[(0, b"\xff\x51\x03" + tempo.to_bytes(3, "big")), (0, b"\xff\x58\x04\x03\x02\x18\x08")]]
    events = sorted([(on, 1, bytes([0x90, p, 70])) for on, _, p in notes] + [(off, 0, bytes([0x80, p, 0])) for _, off, p in notes])
    tracks.append([(t, raw) for t, _, raw in events])
    return smf.encode(tracks, division)


def test_midi_to_features_in_one_call(spark):
    notes = [(240 * i, 240 * i + 200, 60 + i % 7) for i in range(40)]
    other = [(120 * i, 120 * i + 100, 60 + i % 7) for i in range(40)]
    rows = [(1, midi(notes)), (2, midi(other, division=240)), (3, b"no midi")]
    got = timing.featurize_midi(spark.createDataFrame(rows, "file_id int, content binary"), feature_set="A").collect()
    one, two = ({(r["note_idx"], r["pitch"], r["onset_s"], r["beat_in_measure"]) for r in got if r["file_id"] == k} for k in (1, 2))
    assert len(one) == 40 and one == two
    assert [r["onset_s"] for r in sorted((r for r in got if r["file_id"] == 1), key=lambda r: r["note_idx"])][:3] == [0.0, 0.25, 0.5]
    loose = [(240 * i + (7 if i % 2 else 0), 240 * i + 200, 60 + i % 7) for i in range(40)]
    snapped = timing.featurize_midi(spark.createDataFrame([(1, midi(loose))], "file_id int, content binary"), [4, 3], feature_set="A").collect()
    assert {round(r["onset_s"], 9) for r in snapped} == {0.25 * i for i in range(40)}


def test_retimed_file_round_trip(spark):
    """Offsets come back from the written file, within half a tick."""
    content = midi([(480 * i, 480 * i + 400, 60 + i) for i in range(12)])
    decoded = smf.decode_files(spark.createDataFrame([(1, content)], "file_id int, content binary"))
    messages = smf.messages(decoded)
    notes = timing.timed_notes(messages)
    ms = F.when(F.col("note_id") % 2 == 0, 15.0).otherwise(-10.0)
    n = notes.withColumn("offset_ms", ms).withColumn("base_onset_s", F.col("onset_s"))
    moves = timing.moves(messages, timing.retime(n, grid.tempo_map(messages)))
    back = timing.timed_notes(smf.messages(smf.decode_files(smf.encode_files(smf.retime(messages, moves)))))
    old = {r["note_id"]: r["onset_s"] for r in notes.collect()}
    for r in back.collect():
        want = max(0.0, old[r["note_id"]] + (0.015 if r["note_id"] % 2 == 0 else -0.01))
        assert abs(r["onset_s"] - want) < 0.6 / 960


def test_unequal_rows(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, None, "x"), (3, 1.0, None), (4, 2.0, "x")], "id int, v double, s string")
    b = spark.createDataFrame([(1, 1.0 + 1e-9, "x"), (2, None, "x"), (3, 1.0, "y"), (5, 2.0, "x")], "id int, v double, s string")
    assert sorted(r["id"] for r in reports.unequal_rows(a, b, ["id"]).collect()) == [3, 4, 5]


def test_importance_by_hand(spark):
    t = trees.Tree((1, -1, -1), (2, -1, -1), (1, 0, 0), (0.5, 1.0, 2.0), (True, False, False))
    rows = spark.createDataFrame([(0.0, 0.1), (0.0, 0.9), (0.0, None)], "a double, b double")
    assert [tuple(r) for r in reports.importance([t, t], ["a", "b"], rows).collect()] == [("b", 2, 6), ("a", 0, 0)]


def test_settings():
    c = config.override(config.Config(), "timing.reference=5", "features.seconds=[0.5, 1]", "beat.meters=[3]")
    assert c.timing.reference == 5 and c.features.seconds == (0.5, 1) and c.beat.meters == (3,)
    assert config.merged({"timing": None}) == config.Config()
    for bad in ("nothing.x=1", "timing.nothing=1"):
        with pytest.raises(KeyError):
            config.override(config.Config(), bad)
    for bad in ("timing.reference", "reference=1", "a.b.c=1"):
        with pytest.raises(ValueError):
            config.override(config.Config(), bad)
    assert set(config.frozen(c, "velocity")) == {"beat", "features"} and "timing" in config.frozen(c, "timing")


def test_settings_from_a_file(tmp_path):
    path = tmp_path / "own.json"
    path.write_text('{"timing": {"score": 6, "subdivisions": [4]}}')
    c = config.load(str(path), "timing.score=7")
    assert c.timing.score == 7 and c.timing.subdivisions == (4,)


def test_json_csv_and_markdown(spark, tmp_path):
    path = str(tmp_path / "r.json")
    for value in ({"a": float("nan"), "b": [1.5, float("inf")]}, {"a": 2}):
        files.write_json(spark, value, path)
    assert files.read_json(spark, path) == {"a": 2} and len(list(tmp_path.glob("*.tmp"))) == 0
    files.write_csv(spark.createDataFrame([(1, [1.0, 2.0])], "id int, q array<double>"), str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), header=True).first()["q"] == "[1.0,2.0]"
    assert files.markdown([{"a": 1.23456, "b": None}, {"a": math.inf, "b": "x"}]) == "| a | b |\n| --- | --- |\n| 1.235 | nan |\n| nan | x |\n"


def test_metadata_table(spark, tmp_path):
    good, bad = tmp_path / "good.csv", tmp_path / "bad.csv"
    good.write_text('midi_filename,split,canonical_composer,canonical_title\na.mid,train,"Bach, J. S.",Air\n')
    bad.write_text("midi_filename,split\na.mid,train\n")
    assert files.read_metadata(spark, str(good)).first()["canonical_composer"] == "Bach, J. S."
    with pytest.raises(ValueError):
        files.read_metadata(spark, str(bad))


def test_manifest_and_parts(spark, tmp_path):
    listed = spark.createDataFrame([(1, "train", 5, None), (2, "test", 0, "no MThd chunk")], "file_id int, split string, n_notes int, error string")
    stats = spark.createDataFrame([("train", 5)], "split string, n long")
    got = files.manifest(listed, stats, {"meta": ["file_id"]}, {"core": ["pitch"]}, {"v": 1})
    assert (got["n_files"], got["n_failures"], got["failures"][0]["file_id"], got["splits"]) == (1, 1, 2, [{"split": "train", "n": 5}])
    spark.range(6).selectExpr("cast(id % 2 as int) as file_id", "id as x").write.partitionBy("file_id").parquet(str(tmp_path / "p"))
    assert sorted((r["file_id"], r["n_rows"]) for r in files.parts_metadata(spark, str(tmp_path / "p")).groupBy("file_id").agg(F.sum("n_rows").alias("n_rows")).collect()) == [(0, 3), (1, 3)]


def test_functions_in_sql(spark):
    sql.register(spark)
    r = spark.sql("select clip_velocity(double('nan')) a, clip_velocity(999) b, slug('  Op. 3/b! ', 9) c, clamped_offset(30, 2, 50) d, quantile_at(array(0D, 10D, 30D), array(-1D, 0D, 2D), 1D) e, quantile_at(array(0D, 10D, 30D), array(-1D, 0D, 2D), -2D) f").first()
    assert tuple(r) == (64, 127, "Op_3_b", 50.0, 20.0, -10.0)
    spark.createDataFrame([(1, midi([(0, 10, 60)])), (2, b"x")], "file_id int, content binary").createOrReplaceTempView("midi_files")
    got = spark.sql("select f.file_id, m.msg_type, m.pitch from midi_files f, lateral parse_midi(f.content) m where m.pitch is not null").collect()
    assert [tuple(r) for r in got] == [(1, "note_on", 60), (1, "note_off", 60)]


def test_rules(spark):
    assert np.isclose(sum(onsets._BELL.values()), 2.5066, atol=0.01)
    b = spark.createDataFrame([(1, 3, 4), (1, 4, 4), (1, 3, 8), (1, 4, 8)], "file_id int, beats_per_bar int, beat_unit int")
    assert reports.meter_labels(b).first()["meter"] == "3/4"
