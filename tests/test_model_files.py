"""Model files: JSON boosters, the binary format, refusals, and scores of what was read."""

import json
import struct

import numpy as np
import pytest

from scorespark.operators.trees import Tree, predict, score_outputs
from scorespark.sources import models

TREES = [
    Tree((1, -1, -1), (2, -1, -1), (0, 0, 0), (60.5, -2.0, 3.0), (True, False, False), 0),
    Tree((1, -1, 3, -1, -1), (2, -1, 4, -1, -1), (1, 0, 0, 0, 0), (0.25, 1.0, 72.0, 0.5, -4.0), (False,) * 5, 1),
]
FOREST = models.Forest(TREES, 0.5, 2, ("pitch", "dur_s"), "timing", {"context": "bidirectional", "quantile_levels": "0.1 0.9"})


def booster(**change) -> dict:
    tree = lambda t: {
        "left_children": list(t.left), "right_children": list(t.right), "split_indices": list(t.feature), "split_conditions": list(t.value), "default_left": [int(x) for x in t.default_left],
        "split_type": [change.get("split_type", 0)] * len(t.left), "tree_param": {"size_leaf_vector": change.get("leaf", "1")},
    }
    model = {"gbtree_model_param": {"num_parallel_tree": change.get("parallel", "1")}, "trees": [tree(t) for t in TREES], "tree_info": [t.output for t in TREES]}
    return {"learner": {
        "objective": {"name": change.get("objective", "reg:quantileerror")}, "learner_model_param": {"base_score": "[5E-1]", "num_target": "2"},
        "gradient_booster": {"name": change.get("name", "gbtree"), "model": model}, "feature_names": ["pitch", "dur_s"],
    }}


def test_json_booster():
    got = models.forest_from_json(json.dumps(booster()))
    assert got.trees == TREES and (got.base, got.outputs, got.features, got.task) == (0.5, 2, ("pitch", "dur_s"), "timing")


@pytest.mark.parametrize("change", [{"objective": "binary:logistic"}, {"name": "dart"}, {"parallel": "4"}, {"split_type": 1}, {"leaf": "3"}])
def test_json_refusals(change):
    with pytest.raises(models.ModelError):
        models.forest_from_json(json.dumps(booster(**change)))


def test_binary_round_trip():
    assert models.from_binary(models.to_binary(FOREST)) == FOREST


def test_version_one_has_one_output():
    header = b"base_score=0.5\nfeatures=pitch dur_s\n"
    t = TREES[0]
    arrays = b"".join(np.array(getattr(t, k)).astype(kind).tobytes() for k, kind in models.ARRAYS)
    got = models.from_binary(models.MAGIC + struct.pack("<II", 1, len(header)) + header + struct.pack("<II", 1, 3) + arrays)
    assert got.trees == [t] and got.task == "velocity" and got.outputs == 1


def test_binary_refusals():
    good = models.to_binary(FOREST)
    for bad in (b"", b"NOPE" + good[4:], good[:-1], good[:4] + struct.pack("<I", 3) + good[8:], good.replace(b"features=", b"featured=")):
        with pytest.raises(models.ModelError):
            models.from_binary(bad)
    loop = Tree((0, -1, -1), (2, -1, -1), (0, 0, 0), (1.0, 0.0, 0.0), (False,) * 3)
    far = Tree((1, -1, -1), (2, -1, -1), (9, 0, 0), (1.0, 0.0, 0.0), (False,) * 3)
    for t in (loop, far, Tree((), (), (), (), ()), Tree((-1,), (-1,), (0,), (1.0,), (False,), 5)):
        with pytest.raises(models.ModelError):
            models.to_binary(models.Forest([t], 0.0, 1, ("a",)))


def test_scores_of_all_outputs(spark):
    rows = [(60.0, 0.1), (61.0, 0.3), (None, None), (80.0, 0.5)]
    df = spark.createDataFrame(rows, "pitch double, dur_s double")
    got = [r["scores"] for r in score_outputs(df, TREES, ["pitch", "dur_s"], 2, 0.5).collect()]
    assert got == [[-1.5, 1.5], [3.5, 1.0], [-1.5, -3.5], [3.5, -3.5]]
    assert [r["scores"] for r in score_outputs(df, TREES, ["pitch", "dur_s"], 2, 0.5, ascending=True).collect()][1] == [1.0, 3.5]
    x = np.array(rows, dtype=float)
    assert predict(models.from_binary(models.to_binary(FOREST)).trees, x, 0.5, 2).tolist() == got
