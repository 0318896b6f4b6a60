"""The engine's functions for SQL: after ``register(spark)`` they are callable from spark.sql().

Scalars are SQL functions, so Catalyst inlines them; reading a MIDI file is a table function.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..sources import smf

_SQL = {
    "clip_velocity(v DOUBLE) RETURNS INT": "cast(greatest(1D, least(127D, rint(case when v is null or isnan(v) or abs(v) = double('infinity') then 64D else v end))) as int)",
    "shape_dynamics(v DOUBLE, median DOUBLE, scale DOUBLE, shift DOUBLE) RETURNS DOUBLE": "median + (v - median) * scale + shift",
    "snap_to(beat DOUBLE, a INT, b INT) RETURNS DOUBLE": "case when abs(rint(beat * b) / b - beat) < abs(rint(beat * a) / a - beat) then rint(beat * b) / b else rint(beat * a) / a end",
    "clamped_offset(ms DOUBLE, scale DOUBLE, most DOUBLE) RETURNS DOUBLE": "greatest(-most, least(most, ms * scale))",
    "slug(t STRING, n INT) RETURNS STRING": "substring(btrim(regexp_replace(t, '[^A-Za-z0-9]+', '_'), '_'), 1, n)",
    "quantile_at(q ARRAY<DOUBLE>, knots ARRAY<DOUBLE>, z DOUBLE) RETURNS DOUBLE": (
        "element_at(transform(array(greatest(1, least(size(knots) - 1, size(filter(knots, k -> k < greatest(-3.5D, least(3.5D, z))))))),"
        " i -> q[i - 1] + (greatest(-3.5D, least(3.5D, z)) - knots[i - 1]) * (q[i] - q[i - 1]) / (knots[i] - knots[i - 1])), 1)"
    ),
}


@udtf(returnType="track int, msg_index bigint, tick bigint, msg_type string, channel int, pitch int, velocity int, tempo_us int")
class ParseMidi:
    """The messages of one file; none of bytes that are no MIDI file."""

    def eval(self, content: bytes):
        try:
            found = smf.decode(bytes(content or b""))[2]
        except smf.MidiError:
            return
        for m in found:
            yield tuple(m.get(k) for k in ("track", "msg_index", "tick", "msg_type", "channel", "pitch", "velocity", "tempo_us"))


def register(spark: SparkSession) -> list[str]:
    """Registers all functions for the session; returns their names."""
    for head, body in _SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("parse_midi", ParseMidi)
    return [h.split("(")[0] for h in _SQL] + ["parse_midi"]


