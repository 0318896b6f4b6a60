"""Tree ensembles from and to files: boosters as JSON, and the binary model format.

A model file is read whole by the driver: its size is that of the model, whatever the rows.
``trees.score`` and ``trees.score_outputs`` apply it to a DataFrame.
"""

from __future__ import annotations

import json
import struct
from dataclasses import dataclass, field

import numpy as np

from ..operators.trees import Tree

# Fixed values of the binary format: little-endian; magic, version, header of key=value lines, trees.
MAGIC = b"HBRO"
VERSION = 2
#: Objective of a booster -> task of a model.
TASKS = {"reg:squarederror": "velocity", "reg:quantileerror": "timing"}
#: Arrays of a tree in the order they are stored, with their types.
ARRAYS = (("left", "<i4"), ("right", "<i4"), ("feature", "<i4"), ("value", "<f4"), ("default_left", "u1"))


class ModelError(ValueError):
    """A file that isn't a model this engine can apply."""


@dataclass(frozen=True)
class Forest:
    trees: list[Tree]
    base: float = 0.0
    outputs: int = 1
    features: tuple[str, ...] = ()
    task: str = "velocity"
    settings: dict[str, str] = field(default_factory=dict)  # further header lines, kept as they are

    def check(self) -> Forest:
        """Children come after their parents, and every index is in range; else ModelError."""
        if self.outputs < 1 or self.task not in TASKS.values():
            raise ModelError(f"{self.outputs} outputs, task {self.task!r}")
        for number, t in enumerate(self.trees):
            n = len(t.left)
            inner = np.flatnonzero(np.array(t.left) != -1)
            kids = np.array([t.left, t.right], dtype=np.int64)[:, inner]
            named = np.array(t.feature, dtype=np.int64)[inner]
            if not n or {len(a) for a in (t.right, t.feature, t.value, t.default_left)} != {n}:
                raise ModelError(f"tree {number} is empty or its arrays differ in length")
            if not 0 <= t.output < self.outputs:
                raise ModelError(f"tree {number} belongs to output {t.output} of {self.outputs}")
            if (kids <= inner).any() or (kids >= n).any() or (named < 0).any() or (self.features and (named >= len(self.features)).any()):
                raise ModelError(f"tree {number} has an index out of range")
        return self


def _tree(arrays: dict, output: int) -> Tree:
    return Tree(
        *(tuple(int(v) for v in arrays[k]) for k in ("left", "right", "feature")),
        tuple(float(v) for v in np.asarray(arrays["value"], dtype=np.float32)),
        tuple(bool(v) for v in arrays["default_left"]),
        output,
    )


def forest_from_json(text: str, features: tuple[str, ...] = ()) -> Forest:
    """A booster saved as JSON. Only plain tree boosters with numeric splits and scalar
    leaves; others raise ModelError. ``features``: names, where the file has none."""
    learner = json.loads(text)["learner"]
    task = TASKS.get(learner["objective"]["name"])
    booster = learner["gradient_booster"]
    if task is None or booster["name"] != "gbtree":
        raise ModelError(f"objective {learner['objective']['name']}, booster {booster['name']}")
    model, params = booster["model"], learner["learner_model_param"]
    if int(model["gbtree_model_param"].get("num_parallel_tree", 1)) != 1:
        raise ModelError("parallel trees")
    grown = []
    for t, output in zip(model["trees"], model["tree_info"]):
        if any(map(int, t.get("split_type", ()))) or int(t["tree_param"].get("size_leaf_vector", 1)) > 1:
            raise ModelError("categorical splits or vector leaves")
        stored = zip(("left", "right", "feature", "value", "default_left"), ("left_children", "right_children", "split_indices", "split_conditions", "default_left"))
        grown.append(_tree({k: t[name] for k, name in stored}, int(output)))
    try:
        base = float(str(params["base_score"]).strip("[]"))
    except ValueError:
        raise ModelError(f"base score {params['base_score']}: one for all outputs is wanted") from None
    return Forest(grown, base, max(1, int(params.get("num_target", 1))), tuple(features or learner.get("feature_names") or ()), task).check()


def to_binary(forest: Forest) -> bytes:
    own = {"task": forest.task, "base_score": repr(float(forest.base)), "num_outputs": str(forest.outputs), "features": " ".join(forest.features)}
    lines = own | {k: v for k, v in forest.settings.items() if k not in own}
    if any("\n" in v or "=" in k for k, v in lines.items()) or any(len(f.split()) != 1 for f in forest.features):
        raise ModelError("a header line can't hold these names or settings")
    header = "".join(f"{k}={v}\n" for k, v in lines.items()).encode()
    parts = [MAGIC, struct.pack("<II", VERSION, len(header)), header, struct.pack("<I", len(forest.trees))]
    for t in forest.check().trees:
        parts.append(struct.pack("<II", t.output, len(t.left)))
        parts += [np.array(getattr(t, k)).astype(kind).tobytes() for k, kind in ARRAYS]
    return b"".join(parts)


def from_binary(data: bytes) -> Forest:
    """Version 2, and version 1, whose trees don't name an output."""
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise ModelError("the file ends early")
        at += n
        return data[at - n : at]

    word = lambda: struct.unpack("<I", take(4))[0]
    if take(4) != MAGIC:
        raise ModelError("not a model file")
    version = word()
    if version not in (1, VERSION):
        raise ModelError(f"version {version}")
    lines = dict(x.split("=", 1) for x in take(word()).decode().split("\n") if "=" in x)
    try:
        known = {"base": float(lines.pop("base_score")), "features": tuple(lines.pop("features").split()), "outputs": int(lines.pop("num_outputs", 1)), "task": lines.pop("task", "velocity")}
    except KeyError as e:
        raise ModelError(f"the header lacks {e}") from None
    grown = []
    for _ in range(word()):
        output, n = word() if version > 1 else 0, word()
        grown.append(_tree({k: np.frombuffer(take(n * np.dtype(kind).itemsize), kind) for k, kind in ARRAYS}, output))
    return Forest(grown, settings=lines, **known).check()
