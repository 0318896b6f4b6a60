"""MIDI bytes, the feature store, boosting and the stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorespark.operators import boosting, grouping, trees
from scorespark.sources import adapters, smf, store
from scorespark.streaming import causal

HEAD = b"MThd\x00\x00\x00\x06\x00\x01\x00\x01\x01\xe0"


def track(body: bytes) -> bytes:
    return b"MTrk" + len(body).to_bytes(4, "big") + body


def test_decode_running_status_meta_and_sysex():
    body = b"\x00\x90\x3c\x40" + b"\x00\xff\x51\x03\x07\xa1\x20" + b"\x81\x00\x3c\x00" + b"\x05\xf0\x02\x01\xf7" + b"\x00\xff\x58\x04\x03\x03\x18\x08" + b"\x00\xc0\x05" + b"\x01\xff\x2f\x00"
    kind, division, found = smf.decode(HEAD + track(body))
    assert (kind, division) == (1, 480)
    assert [(m["tick"], m["msg_type"]) for m in found] == [(0, "note_on"), (0, "set_tempo"), (128, "note_on"), (133, "sysex"), (133, "time_signature"), (133, "program_change"), (134, "end_of_track")]
    assert found[2]["velocity"] == 0 and found[1]["tempo_us"] == 500000 and (found[4]["num"], found[4]["den"]) == (3, 8)
    again = smf.encode([[(m["tick"], m["raw"]) for m in found]], division, kind)
    assert smf.decode(again) == (kind, division, found)


@pytest.mark.parametrize("data", [b"", b"MThd", HEAD[:9] + b"\x02" + HEAD[10:], HEAD[:12] + b"\xe7\x28", HEAD[:12] + b"\0\0", HEAD + track(b"\x00\x3c\x40"), HEAD + track(b"\x00\x90\x3c"), HEAD + b"MTrk\0\0\0\x09\0"])
def test_bad_files_are_refused(data):
    with pytest.raises(smf.MidiError):
        smf.decode(data)


def test_bad_files_do_not_stop_good_ones(spark):
    good = HEAD + track(b"\x00\x90\xbc\xff\x60\x80\x3c\x00\x00\xff\x2f\x00")
    d = smf.decode_files(spark.createDataFrame([(1, good), (2, b"no"), (3, None)], "file_id int, content binary"))
    assert {r["file_id"]: r["error"] is None for r in d.select("file_id", "error").collect()} == {1: True, 2: False, 3: False}


def test_read_and_patch(spark, tmp_path):
    (tmp_path / "a.mid").write_bytes(HEAD + track(b"\x00\x90\x3c\x40\x60\x3c\x00\x00\x90\x3e\x50\x60\x80\x3e\x00\x00\xff\x2f\x00"))
    rows = smf.messages(smf.read_midi(spark, str(tmp_path)))
    v = spark.createDataFrame([(0, 0, 300.0), (0, 1, 5.0)], "track int, msg_index long, new_velocity double").join(rows.select("file_id").distinct())
    got = smf.messages(smf.decode_files(smf.encode_files(smf.patch_velocities(rows, v)))).orderBy("msg_index").collect()
    assert [m["velocity"] for m in got[:4]] == [127, 0, 80, 0]


def test_retime_orders_a_tick(spark):
    rows = smf.messages(smf.decode_files(spark.createDataFrame([(1, HEAD + track(b"\x00\x90\x3c\x40\x10\xb0\x40\x7f\x10\x80\x3c\x00\x00\xff\x2f\x00"))], "file_id int, content binary")))
    moves = spark.createDataFrame([(1, 0, 0, 16.4), (1, 0, 2, 90.0)], "file_id int, track int, msg_index long, new_tick double")
    got = smf.retime(rows, moves).orderBy("msg_index").collect()
    assert [(m["tick"], m["msg_type"]) for m in got] == [(16, "control_change"), (16, "note_on"), (90, "note_off"), (90, "end_of_track")]


def test_store_resumes_and_refuses(spark, tmp_path):
    path = str(tmp_path / "store")
    f = spark.createDataFrame([(i, j, "train" if i < 2 else "test", float(j)) for i in range(3) for j in range(4)], "file_id int, note_idx int, split string, x double")
    store.build(f.where("file_id = 0"), path, {"v": 1})
    store.build(f.withColumn("x", F.col("x") + 100), path, {"v": 1})
    assert store.read(spark, path, ["x"], ["train"], [0]).agg(F.max("x")).first()[0] == 3
    assert {(r["split"], r["n_files"], r["n_rows"]) for r in store.manifest(spark, path).collect()} == {("train", 2, 8), ("test", 1, 4)}
    with pytest.raises(store.StoreMismatch):
        store.build(f, path, {"v": 2})
    store.build(f.where("file_id = 2"), path, {"v": 2}, overwrite=True)
    assert spark.read.parquet(path + "/features").count() == 4
    plan = store.read(spark, path, ["x"], ["train"], [0])._jdf.queryExecution().executedPlan().toString()
    assert "(split" in plan.split("PartitionFilters")[1] and "file_id" in plan.split("PushedFilters")[1]


def _data(spark, n=1500):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 2))
    x[rng.random(n) < 0.2, 1] = np.nan
    y = np.where(x[:, 0] < 0.2, 3.0, -1.0) + np.where(np.isnan(x[:, 1]), 5.0, 0.0) + rng.normal(size=n) * 0.1
    return spark.createDataFrame([(i, float(a), None if np.isnan(b) else float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "id int, a double, b double, y double")


def test_boosting_learns_steps_and_missing_values(spark):
    df = _data(spark)
    grown, base = boosting.train(df, ["a", "b"], "y", rounds=10, depth=2, rate=0.5)
    mse = trees.score(df, grown, ["a", "b"], base).agg(F.avg((F.col("score") - F.col("y")) ** 2)).first()[0]
    assert mse < 0.2


def test_boosting_covers_the_quantile(spark):
    df = _data(spark)
    grown, base = boosting.train(df, ["a", "b"], "y", rounds=10, depth=2, rate=0.5, quantile=0.9)
    below = trees.score(df, grown, ["a", "b"], base).agg(F.avg((F.col("y") <= F.col("score")).cast("int"))).first()[0]
    assert 0.84 < below < 0.96


def test_boosting_without_rows(spark):
    assert boosting.train(spark.createDataFrame([], "a double, y double"), ["a"], "y") == ([], 0.0)


def test_kept_margins_change_nothing(spark, monkeypatch):
    df = _data(spark, 400)
    once = boosting.train(df, ["a", "b"], "y", rounds=7, depth=2, rate=0.4)
    monkeypatch.setattr(boosting, "REFRESH", 2)
    often = boosting.train(df, ["a", "b"], "y", rounds=7, depth=2, rate=0.4)
    assert [t.feature for t in once[0]] == [t.feature for t in often[0]]
    assert np.allclose([v for t in once[0] for v in t.value], [v for t in often[0] for v in t.value], atol=1e-4)


def test_boosting_stops_early(spark):
    """On noise there is nothing to learn: the validation loss rises soon."""
    rng = np.random.default_rng(1)
    made = lambda n: spark.createDataFrame([tuple(map(float, r)) for r in rng.normal(size=(n, 3))], "a double, b double, y double")
    stats: list = []
    grown, _ = boosting.train(made(300), ["a", "b"], "y", rounds=12, depth=3, rate=0.5, validation=made(300), patience=2, stats=stats)
    assert 1 <= len(grown) < 10 and {s[0] for s in stats} <= {"a", "b"} and all(g > 0 for _, g, _ in stats)


def test_boosting_weights_and_draws(spark):
    """Rows of weight 0 teach nothing; drawn rows and columns still learn the step."""
    df = _data(spark, 800).withColumn("w", F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.0)).withColumn("y", F.when(F.col("id") % 2 == 0, F.col("y")).otherwise(1000.0))
    grown, base = boosting.train(df, ["a", "b"], "y", rounds=12, depth=2, rate=0.5, weight="w", subsample=0.7, colsample=0.5, seed=3)
    kept = trees.score(df.where("w > 0"), grown, ["a", "b"], base)
    assert base < 10 and kept.agg(F.avg((F.col("score") - F.col("y")) ** 2)).first()[0] < 1.5
    assert {sum(x >= 0 for x in t.left) > 0 for t in grown} == {True}


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    notes = adapters.loose_notes(spark, sf_dir)
    cuts = [0.0, 1.0, 2.5, 5.0]
    for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        notes.where((F.col("onset_s") >= lo) & (F.col("onset_s") < hi)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(notes.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = causal.causal_features(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    key = ["file_id", "note_id", "group_id", "trailing"]
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*key).collect()))
    batch = grouping.anchored_groups(notes).join(causal.batch_counts(notes), ["file_id", "note_id"]).select(*key)
    assert got == sorted(map(tuple, batch.collect())) and got
