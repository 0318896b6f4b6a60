"""Gradient boosting of trees by distributed histograms, for squared and pinball loss.

Features are cut into bins at approximate quantiles (a mergeable sketch over all rows).
For each level of a tree every task adds up gradients by node, feature and bin, and emits
those sums; they are summed by key, and the driver gets nodes x features x bins rows at
most, whatever the input. Missing values have a bin of their own and go to the side that
gains more. For pinball loss a leaf's value is the quantile of its rows' residuals.

Each row carries its margin, which is written anew every ``REFRESH`` rounds; in between only
the trees since then are scored, so a round costs the same however many there were before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import shared_folder
from .trees import Tree, predict

REFRESH = 16


def _matrix(batch: pa.RecordBatch, features: list[str]) -> np.ndarray:
    cols = [batch.column(f).to_numpy(zero_copy_only=False) for f in features]
    return np.stack([np.asarray(c, dtype=float) for c in cols], 1) if cols else np.empty((batch.num_rows, 0))


def _gradient(y: np.ndarray, p: np.ndarray, quantile: float | None) -> np.ndarray:
    return y - p if quantile is None else np.where(y >= p, quantile, quantile - 1.0)


def _best(hist: np.ndarray, l2: float, least: float) -> tuple[float, int, int, bool] | None:
    """Of one node's (features, bins + 1, [g, n]) sums, the last bin being missing: gain,
    feature, first bin on the right, whether missing values go left."""
    total = hist[0].sum(axis=0)
    value = lambda s: s[..., 0] ** 2 / (s[..., 1] + l2)
    best = None
    left = np.cumsum(hist[:, :-1], axis=1)[:, :-1]
    for missing_left in (True, False):
        a = left + hist[:, -1:, :] if missing_left else left
        b = total - a
        gain = np.where((a[..., 1] >= least) & (b[..., 1] >= least), value(a) + value(b) - value(total), -np.inf)
        if gain.size:
            f, k = np.unravel_index(int(np.argmax(gain)), gain.shape)
            if gain[f, k] > 1e-9 and (best is None or gain[f, k] > best[0]):
                best = (float(gain[f, k]), int(f), int(k) + 1, missing_left)
    return best


def _share(k: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """A number in [0, 1) for each row and tree, by hash."""
    mask = (1 << 64) - 1
    x = k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((tree * 0xD1342543DE82EF95 + seed * 0x2545F4914F6CDD1D) & mask)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return (x >> np.uint64(11)).astype(float) / 2.0**53


class _Rows:
    """A table of features, target, weight, row number and margin, in a shared folder."""

    def __init__(self, df: DataFrame, features: list[str], target: str, weight: str | None):
        as_number = [F.coalesce(F.col(f).cast("float").cast("double"), F.lit(float("nan"))).alias(f) for f in features]
        w = (F.lit(1.0) if weight is None else F.coalesce(F.col(weight).cast("double"), F.lit(0.0))).alias("_w")
        flat = df.where(F.col(target).isNotNull()).select(*as_number, F.col(target).cast("double").alias("_y"), w)
        self.features, self.done = features, 0
        self._write(flat.where("_w > 0").withColumn("_k", F.monotonically_increasing_id()).withColumn("_m", F.lit(0.0)))

    def _write(self, df: DataFrame) -> None:
        path = shared_folder(df.sparkSession, "boosting")
        df.write.parquet(path)
        self.table = df.sparkSession.read.parquet(path)

    def each(self, grown: list[Tree], work, schema: str):
        """A DataFrame of what work(batch, features, margin) yields, and the broadcast to release
        when it has been read."""
        shared = self.table.sparkSession.sparkContext.broadcast(grown[self.done :])  # REFRESH trees at most
        features = self.features

        def run(batches):
            def margined():
                for b in batches:
                    if b.num_rows:
                        x = _matrix(b, features)
                        yield b, x, b.column("_m").to_numpy(zero_copy_only=False) + predict(shared.value, x)[:, 0].astype(float)

            yield from work(margined())

        return self.table.mapInArrow(run, schema), shared

    def gather(self, grown: list[Tree], work, schema: str, finish=lambda df: df) -> list:
        df, shared = self.each(grown, work, schema)
        rows = finish(df).collect()  # sums: bounded by nodes, features and bins
        shared.destroy()
        return rows

    def set_base(self, base: float) -> None:
        self.table = self.table.withColumn("_m", F.lit(float(base)))

    def refresh(self, grown: list[Tree]) -> None:
        """Writes the margins after all trees so far."""

        def work(parts):
            for b, _, margin in parts:
                yield b.set_column(b.schema.get_field_index("_m"), "_m", pa.array(margin))

        df, shared = self.each(grown, work, self.table.schema)
        self._write(df)
        shared.destroy()
        self.done = len(grown)


def train(
    df: DataFrame, features: list[str], target: str, rounds: int = 20, depth: int = 4, rate: float = 0.1, quantile: float | None = None, bins: int = 64, l2: float = 1.0, least_rows: int = 20,
    weight: str | None = None, subsample: float = 1.0, colsample: float = 1.0, seed: int = 0, validation: DataFrame | None = None, patience: int | None = None, stats: list | None = None,
) -> tuple[list[Tree], float]:
    """The trees and the base score; trees.score() applies them. Rows without a target or with a
    weight of 0 are not learnt from; null features are missing. With no row left there is no
    tree. ``weight``: of the gradients (for pinball loss leaves take rows alike, so use 0 and 1).
    ``subsample``, ``colsample``: shares of rows (by hash) and features drawn for each tree.
    ``patience``: with ``validation`` rows, stops when their loss hasn't fallen for so many rounds, and
    keeps the trees up to the best round. ``stats`` gets a (feature, gain, cover) for each split."""
    spark = df.sparkSession
    data = _Rows(df, features, target, weight)
    middle = F.sum(F.col("_y") * F.col("_w")) / F.sum("_w") if quantile is None else F.percentile_approx("_y", quantile, 10_000)
    base = data.table.agg(middle.alias("m")).first()["m"]
    if base is None:
        return [], 0.0
    marks = data.table.select(*(F.nanvl(F.col(f), F.lit(None)).alias(f) for f in features)).approxQuantile(features, [i / bins for i in range(1, bins)], 0.25 / bins)
    cuts = [np.unique(np.array(m, dtype=np.float64)) for m in marks]
    width = max((len(c) for c in cuts), default=0) + 1
    edges = spark.sparkContext.broadcast(cuts)  # features x bins numbers
    data.set_base(base)
    held = _Rows(validation, features, target, weight) if validation is not None and patience else None
    if held:
        held.set_base(base)
    rng, losses = np.random.default_rng(seed), []
    grown: list[Tree] = []
    for number_of_tree in range(rounds):
        use = sorted(rng.choice(len(features), max(1, round(colsample * len(features))), replace=False).tolist()) if features else []
        nodes = {"left": [-1], "right": [-1], "feature": [0], "value": [0.0], "default_left": [False]}
        as_tree = lambda: Tree(*(tuple(nodes[k]) for k in ("left", "right", "feature", "value", "default_left")))  # noqa: B023, E731
        live = [0]
        for _ in range(depth):
            shape, number = as_tree(), {n: i for i, n in enumerate(live)}

            def sums(parts, shape=shape, number=number, use=use, t=number_of_tree):
                out = np.zeros((len(number), len(use), width + 1, 2))
                place = np.array([number.get(n, -1) for n in range(len(shape.left))])
                for b, x, margin in parts:
                    w = b.column("_w").to_numpy(zero_copy_only=False)
                    g = _gradient(b.column("_y").to_numpy(zero_copy_only=False), margin, quantile) * w
                    own = place[leaf_of(shape, x)]
                    ok = own >= 0
                    if subsample < 1:
                        ok &= _share(b.column("_k").to_numpy(zero_copy_only=False), t, seed) < subsample
                    size = len(number) * (width + 1)
                    for j, f in enumerate(use):
                        v = x[ok, f]
                        slot = own[ok] * (width + 1) + np.where(np.isnan(v), width, np.searchsorted(edges.value[f], v, side="right"))
                        out[:, j, :, 0] += np.bincount(slot, g[ok], size).reshape(len(number), -1)
                        out[:, j, :, 1] += np.bincount(slot, w[ok], size).reshape(len(number), -1)
                at = np.argwhere(out[..., 1] > 0)
                node, j, k = at.T.astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(j), pa.array(k), pa.array(out[node, j, k, 0]), pa.array(out[node, j, k, 1])], names=["node", "f", "k", "g", "n"])

            hist = np.zeros((len(live), max(1, len(use)), width + 1, 2))
            for r in data.gather(grown, sums, "node int, f int, k int, g double, n double", lambda d: d.groupBy("node", "f", "k").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))):
                hist[r["node"], r["f"], r["k"]] = r["g"], r["n"]
            nxt = []
            for i, n in enumerate(live):
                total = hist[i, 0].sum(axis=0)
                nodes["value"][n] = rate * total[0] / (total[1] + l2)
                found = _best(hist[i], l2, least_rows) if features else None
                if found is None or found[2] > len(cuts[use[found[1]]]):
                    continue
                gain, j, k, missing_left = found
                f = use[j]
                a = hist[i, j, :k].sum(axis=0) + (hist[i, j, -1] if missing_left else 0)
                b = total - a
                new = len(nodes["left"])
                for s in (a, b):
                    for key, v in (("left", -1), ("right", -1), ("feature", 0), ("value", rate * s[0] / (s[1] + l2)), ("default_left", False)):
                        nodes[key].append(v)
                nodes["left"][n], nodes["right"][n], nodes["feature"][n], nodes["value"][n], nodes["default_left"][n] = new, new + 1, f, float(cuts[f][k - 1]), missing_left
                if stats is not None:
                    stats.append((features[f], gain, float(total[1])))
                nxt += [new, new + 1]
            live = nxt
            if not live:
                break
        if quantile is not None:
            shape = as_tree()

            def residuals(parts, shape=shape):
                for b, x, margin in parts:
                    r = b.column("_y").to_numpy(zero_copy_only=False) - margin
                    yield pa.RecordBatch.from_arrays([pa.array(leaf_of(shape, x).astype(np.int32)), pa.array(r)], names=["leaf", "r"])

            for r in data.gather(grown, residuals, "leaf int, r double", lambda d: d.groupBy("leaf").agg(F.percentile_approx("r", quantile, 10_000).alias("v"))):
                nodes["value"][r["leaf"]] = rate * r["v"]
        grown.append(as_tree())
        if held:
            losses.append(_loss(held, grown, quantile))
            best = int(np.argmin(losses))
            if len(losses) - 1 - best >= patience:
                break
        for table in (data, held):
            if table and len(grown) - table.done >= REFRESH and number_of_tree + 1 < rounds:
                table.refresh(grown)
    return grown[: int(np.argmin(losses)) + 1] if losses else grown, float(base)


def _loss(held: _Rows, grown: list[Tree], quantile: float | None) -> float:
    """Mean squared or pinball loss; tasks emit one sum each."""

    def work(parts):
        total, n = 0.0, 0.0
        for b, _, margin in parts:
            d, w = b.column("_y").to_numpy(zero_copy_only=False) - margin, b.column("_w").to_numpy(zero_copy_only=False)
            total += float((w * (d * d if quantile is None else np.maximum(quantile * d, (quantile - 1) * d))).sum())
            n += float(w.sum())
        yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([n])], names=["s", "n"])

    r = held.gather(grown, work, "s double, n double", lambda d: d.agg(F.sum("s").alias("s"), F.sum("n").alias("n")))[0]
    return r["s"] / r["n"] if r["n"] else 0.0


def train_quantiles(df: DataFrame, features: list[str], target: str, levels: list[float], **options) -> list[Tree]:
    """The trees of all levels, one output each, for trees.score_outputs() with a base of 0: each
    output's base score is a tree of one leaf."""
    out: list[Tree] = []
    for k, level in enumerate(levels):
        grown, base = train(df, features, target, quantile=level, **options)
        out.append(Tree((-1,), (-1,), (0,), (base,), (False,), k))
        out += [Tree(t.left, t.right, t.feature, t.value, t.default_left, k) for t in grown]
    return out


def leaf_of(t: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf in which each row ends."""
    left, right, feature = (np.array(v) for v in (t.left, t.right, t.feature))
    value, default = np.array(t.value, np.float32), np.array(t.default_left)
    at = np.zeros(len(x), np.int64)
    while (live := np.flatnonzero(left[at] >= 0)).size:
        n = at[live]
        v = x[live, feature[n]].astype(np.float32)
        at[live] = np.where(np.where(np.isnan(v), default[n], v < value[n]), left[n], right[n])
    return at
