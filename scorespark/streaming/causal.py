"""Causal features of a stream of notes: anchored groups and trailing note counts.

Notes of a file must arrive in order of (onset_s, pitch, note_id); inside a micro-batch any
order will do. A note that begins before one that was emitted in an earlier micro-batch is late: it
gets no group and no count. State of a file: the open group's onset and number, and the onsets of
the trailing window, so it is bounded by the notes of ``width`` seconds; it is dropped when no note
of the file came for ``idle_ms`` (a file that goes on after that begins anew).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.grouping import TOLERANCE_S

OUT = "file_id int, note_id bigint, onset_s double, pitch int, group_id int, trailing int"
STATE = "anchor double, group int, recent array<double>"


def causal_features(notes: DataFrame, tolerance_s: float = TOLERANCE_S, width: float = 3.0, idle_ms: int = 3_600_000) -> DataFrame:
    """group_id and trailing: notes that began in [onset - width, onset], up to this note in
    order. Append mode; a row is final when it is emitted."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        anchor, group, recent = state.get if state.exists else (None, -1, [])
        recent = list(recent)
        rows = pd.concat(list(parts)).sort_values(["onset_s", "pitch", "note_id"], kind="stable")
        groups, counts = [], []
        emitted = recent[-1] if len(recent) else None
        for t in rows["onset_s"]:
            if emitted is not None and t < emitted:
                groups.append(None)
                counts.append(None)
                continue
            if anchor is None or t - anchor > tolerance_s:
                anchor, group = t, group + 1
            recent.append(t)
            while recent[0] < t - width:
                recent.pop(0)
            groups.append(group)
            counts.append(len(recent))
        state.update((anchor, group, recent))
        state.setTimeoutDuration(idle_ms)
        yield rows.assign(group_id=pd.array(groups, "Int32"), trailing=pd.array(counts, "Int32"))[["file_id", "note_id", "onset_s", "pitch", "group_id", "trailing"]]

    flat = notes.select("file_id", "note_id", "onset_s", "pitch").where("file_id is not null and onset_s is not null")
    return flat.groupBy("file_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def batch_counts(notes: DataFrame, width: float = 3.0) -> DataFrame:
    """``trailing`` of a whole table by windows alone: notes up to this one in order, less
    those that began before the window."""
    w = Window.partitionBy("file_id").orderBy("onset_s", "pitch", "note_id")
    probe = notes.select("file_id", "note_id", "onset_s", "pitch", F.row_number().over(w).alias("_rank"))
    starts = notes.select("file_id", "onset_s", F.lit(1).alias("_n")).groupBy("file_id", "onset_s").agg(F.sum("_n").alias("_n"))
    marks = starts.select("file_id", F.col("onset_s").alias("_t"), "_n", F.lit(None).cast("bigint").alias("note_id")).unionByName(
        probe.select("file_id", (F.col("onset_s") - width).alias("_t"), F.lit(0).cast("bigint").alias("_n"), "note_id")
    )
    gone = F.sum("_n").over(Window.partitionBy("file_id").orderBy("_t", F.col("note_id").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    lost = marks.withColumn("_gone", gone).where("note_id is not null").select("file_id", "note_id", "_gone")
    return probe.join(lost, ["file_id", "note_id"]).select("file_id", "note_id", (F.col("_rank") - F.col("_gone")).cast("int").alias("trailing"))
