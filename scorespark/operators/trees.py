"""Scoring of tree ensembles: vectorised over a batch's rows, level by level."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tree:
    """Parallel node arrays; left = -1 marks a leaf, whose value is its score. A row goes left
    if its feature is below the value, and by default_left if it is missing."""

    left: tuple[int, ...]
    right: tuple[int, ...]
    feature: tuple[int, ...]
    value: tuple[float, ...]
    default_left: tuple[bool, ...]
    output: int = 0


def predict(trees: list[Tree], x: np.ndarray, base: float = 0.0, outputs: int = 1) -> np.ndarray:
    """float32 sums in tree order."""
    total = np.full((len(x), outputs), base, np.float32)
    for t in trees:
        left, right, feature = map(np.array, (t.left, t.right, t.feature))
        value, default = np.array(t.value, np.float32), np.array(t.default_left)
        at = np.zeros(len(x), np.int64)
        while (live := np.flatnonzero(left[at] >= 0)).size:
            n = at[live]
            v = x[live, feature[n]].astype(np.float32)
            go = np.where(np.isnan(v), default[n], v < value[n])
            at[live] = np.where(go, left[n], right[n])
        total[:, t.output] += value[at]
    return total


def score(df: DataFrame, trees: list[Tree], features: list[str], base: float = 0.0, out: str = "score") -> DataFrame:
    """Adds a float column; null features count as missing."""
    shared = df.sparkSession.sparkContext.broadcast(trees)  # a model, whatever the rows

    @F.pandas_udf("float")
    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series(predict(shared.value, np.stack([c.to_numpy(dtype=float, na_value=np.nan) for c in cols], 1), base)[:, 0])

    inputs: list[Column] = [F.col(f).cast("double") for f in features]
    return df.withColumn(out, run(*inputs))


def score_outputs(df: DataFrame, trees: list[Tree], features: list[str], outputs: int, base: float = 0.0, ascending: bool = False, out: str = "scores") -> DataFrame:
    """Adds an array<float> with every output's score; ``ascending`` sorts it, so that
    quantiles never cross."""
    shared = df.sparkSession.sparkContext.broadcast(trees)  # a model, whatever the rows

    @F.pandas_udf("array<float>")
    def run(*cols: pd.Series) -> pd.Series:
        got = predict(shared.value, np.stack([c.to_numpy(dtype=float, na_value=np.nan) for c in cols], 1), base, outputs)
        return pd.Series(list(np.sort(got, axis=1) if ascending else got))

    inputs: list[Column] = [F.col(f).cast("double") for f in features]
    return df.withColumn(out, run(*inputs))


def guard_inputs(columns: list[str], experiment: str = "primary", timing: bool = False) -> None:
    """Refuses columns that would leak the target into a model."""
    targets = {"velocity", "baseline_velocity", "velocity_delta"}
    meta = {"note_idx", "note_order", "group_id", "onset_s", "group_time_s"}
    bad = [c for c in columns if c in meta or c in targets]
    if experiment != "performance_conditioned":
        bad += [c for c in columns if "velocity" in c or c.startswith("pc_")]
    if timing:
        bad += [c for c in columns if c.startswith("perf_") or c in {"offset_ms", "score_beat", "ref_time_s"}]
    if bad:
        raise ValueError(f"these columns may not be model inputs: {sorted(set(bad))}")
