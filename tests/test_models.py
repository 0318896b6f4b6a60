"""Correlated takes and the beat tracker."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorespark.operators import sampling, tracking


def test_splitmix_take_of_one_piece(spark):
    """Against a plain computation of the same take."""
    gamma, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1

    def uniform(k, seed=9):
        z = (seed + k * gamma) & mask
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & mask
        z = (z ^ z >> 27) * 0x94D049BB133111EB & mask
        return ((z ^ z >> 31) >> 11) / 2**53 + 0.5 / 2**53

    def normals(start, n):
        out = []
        for k in range(start + 1, start + n + 1, 2):
            r, t = math.sqrt(-2 * math.log(uniform(k))), 2 * math.pi * uniform(k + 1)
            out += [r * math.cos(t), r * math.sin(t)]
        return out[:n]

    group, beat = [0, 0, 1, 2, 2], [0.0, 0.0, 0.5, 2.0, 2.0]
    eta, eps, shared = normals(0, 3), normals(4, 5), []
    for k, d in enumerate((0, 0.5, 1.5)):
        phi = math.exp(-d / 0.7)
        shared.append(eta[0] if not k else phi * shared[-1] + math.sqrt(1 - phi**2) * eta[k])
    want = [math.sqrt(0.6) * shared[g] + math.sqrt(0.4) * e for g, e in zip(group, eps)]
    n = spark.createDataFrame([(0, g, i, b, [30.0, -10.0, 0.0]) for i, (g, b) in enumerate(zip(group, beat))], "file_id int, group_id int, note_idx int, beat double, q array<double>")
    got = sampling.sample_offsets(n, "q", [0.1, 0.5, 0.9], sampling.Copula(0.6, 0.7), 9).orderBy("note_idx").collect()
    assert [r["latent"] for r in got] == pytest.approx(want, abs=1e-12)
    k9 = sampling._knots([0.1, 0.5, 0.9])[2]
    assert [r["sampled"] for r in got] == pytest.approx([z / k9 * (30 if z > 0 else 10) for z in (max(-2.5, min(2.5, x)) for x in want)])


def test_scores_invert_quantiles(spark):
    levels, q = [0.1, 0.3, 0.5, 0.7, 0.9], [-20.0, -3.0, 0.0, 5.0, 40.0]
    df = spark.createDataFrame([(z / 4, q) for z in range(-12, 13)], "z double, q array<double>")
    back = df.withColumn("y", sampling.quantile_value(F.col("q"), levels, F.col("z"))).select("z", sampling.normal_score(F.col("q"), levels, F.col("y")).alias("b")).collect()
    assert all(abs(r["z"] - r["b"]) < 1e-9 for r in back)
    flat = df.limit(1).select(sampling.normal_score(F.array(*[F.lit(1.0)] * 5), levels, F.lit(1.0)).alias("b")).first()["b"]
    assert flat == pytest.approx(sampling._knots(levels)[0] / 2 + sampling._knots(levels)[1] / 2)


def test_copula_recovers_its_parameters(spark):
    notes = spark.range(24000).selectExpr("cast(id div 2400 as int) as file_id", "cast((id % 2400) div 2 as int) as group_id", "cast(id % 2400 as int) as note_idx", "cast(((id % 2400) div 2) / 4.0 as double) as beat")
    true = sampling.Copula(0.6, 0.7)
    z = sampling.latent(notes, true, 5).withColumn("z", F.col("latent") * 0.5)
    got = sampling.fit(z)
    assert abs(got.rho - 0.6) < 0.05 and 0.5 < got.ell < 1.0
    assert sampling.fit(z.limit(0)) == sampling.Copula()
    there = z.select("z", sampling.to_model_score(sampling.calibrated_score(F.col("z"), got), got).alias("b")).where("abs(z) < 1").agg(F.max(F.abs(F.col("z") - F.col("b")))).first()[0]
    assert there < 1e-6


def test_null_scores_stay_null(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0, 3.0])], "z double, q array<double>")
    r = df.select(sampling.quantile_value(F.col("q"), [0.1, 0.5, 0.9], F.col("z")), sampling.normal_score(F.col("q"), [0.1, 0.5, 0.9], F.col("z"))).first()
    assert tuple(r) == (None, None)


def _piece(bpm: float, beats: int, m: int, seed: int = 1):
    rng = np.random.default_rng(seed)
    t = 60 / bpm * np.arange(beats) + 0.5
    rows = []
    for i, x in enumerate(t):
        rows += [(x, 0.5 * 60 / bpm, 72 + i % 5)]
        if i % m == 0:
            rows += [(x, 60 / bpm * m * 0.9, 36 + 5 * (i // m % 2)), (x, 60 / bpm, 48), (x, 60 / bpm, 64)]
        elif rng.random() < 0.5:
            rows += [(x + 30 / bpm, 0.1, 76)]
    on, dur, pitch = map(np.array, zip(*rows))
    on = on + rng.normal(0, 0.008, len(on))
    return t, on, on + dur, pitch


def test_tracker_finds_beats_and_bars(spark):
    made = {(80, 4): _piece(80, 64, 4), (100, 3): _piece(100, 64, 3), (120, 4): _piece(120, 64, 4)}
    rows = [(bpm, float(a), float(b), int(c)) for (bpm, _), (_, on, off, pitch) in made.items() for a, b, c in zip(on, off, pitch)]
    found = tracking.track_beats(spark.createDataFrame(rows, "file_id int, onset_s double, offset_s double, pitch int")).toPandas()
    for (bpm, m), (t, *_) in made.items():
        own = found[found["file_id"] == bpm].sort_values("beat")
        got, place = own["time_s"].to_numpy(), own["beat_in_bar"].to_numpy()
        hit = sum(np.abs(got - x).min() < 0.07 for x in t)
        assert 2 * hit / (len(got) + len(t)) > 0.9
        assert set(own["beats_per_bar"]) == {m}
        first = [np.abs(t[::m] - x).min() < 0.07 for x in got[place == 0]]
        assert np.mean(first) > 0.8


def test_best_path_equals_a_frame_by_frame_program():
    rng = np.random.default_rng(2)
    env, period = rng.random(400) * (np.arange(400) % 20 < 3), 20 + 4 * np.sin(np.arange(400) / 50)
    total, before = env.copy(), [-1] * 400
    for t in range(400):
        p = max(2, int(np.rint(period[t])))
        top, at = max(((total[u] - 60 * np.log((t - u) / p) ** 2, -u) for u in range(max(0, t - 2 * p), t - max(1, p // 2) + 1)), default=(0, 0))
        if top > 0:
            total[t], before[t] = env[t] + top, -at
    p = int(np.rint(period[390]))
    at, want = 390 - p + int(total[390 - p : 392].argmax()), []
    while at >= 0:
        want.append(at)
        at = before[at]
    assert tracking.best_path(env, period, 60.0, 390).tolist() == want[::-1]


def test_tracker_in_spark_and_short_pieces(spark):
    _, on, off, pitch = _piece(120, 48, 4)
    rows = [(1, float(a), float(b), int(c)) for a, b, c in zip(on, off, pitch)] + [(2, 0.0, 1.0, 60), (2, None, 1.0, 60)]
    got = tracking.track_beats(spark.createDataFrame(rows, "file_id int, onset_s double, offset_s double, pitch int")).orderBy("file_id", "beat").collect()
    assert [r["time_s"] for r in got if r["file_id"] == 2] == pytest.approx([0.0, 0.6, 1.2, 1.8, 2.4])
    times = [r["time_s"] for r in got if r["file_id"] == 1]
    assert len(times) > 40 and all(b > a for a, b in zip(times, times[1:]))
