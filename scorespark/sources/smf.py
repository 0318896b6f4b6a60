"""Standard MIDI files: bytes to message rows and back, and the two write-backs.

A message row: file_id, track, msg_index, tick, msg_type, channel, pitch, velocity,
tempo_us, num, den, raw (the whole event with its status byte, without the delta time).
Fields that a message doesn't have are null. A file is decoded in one task: a MIDI file is
small, and rows of many files are spread over all tasks.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar

_MESSAGE = pa.struct([("track", pa.int32()), ("msg_index", pa.int64()), ("tick", pa.int64()), ("msg_type", pa.string()), ("channel", pa.int32()), ("pitch", pa.int32()), ("velocity", pa.int32()), ("tempo_us", pa.int32()), ("num", pa.int32()), ("den", pa.int32()), ("raw", pa.binary())])
_MESSAGE_DDL = "struct<track:int,msg_index:bigint,tick:bigint,msg_type:string,channel:int,pitch:int,velocity:int,tempo_us:int,num:int,den:int,raw:binary>"
_CHANNEL = {0x8: ("note_off", 2), 0x9: ("note_on", 2), 0xA: ("polytouch", 2), 0xB: ("control_change", 2), 0xC: ("program_change", 1), 0xD: ("aftertouch", 1), 0xE: ("pitchwheel", 2)}
_META = {0x2F: "end_of_track", 0x51: "set_tempo", 0x58: "time_signature"}
END_OF_TRACK = b"\xff\x2f\x00"


class MidiError(ValueError):
    """Bytes that are no usable MIDI file."""


def _length(data: bytes, at: int, end: int) -> tuple[int, int]:
    """A variable-length quantity (four bytes at most) and the place after it."""
    value = 0
    for i in range(at, min(at + 4, end)):
        value = value << 7 | data[i] & 0x7F
        if data[i] < 0x80:
            return value, i + 1
    raise MidiError("bad variable-length quantity")


def _quantity(n: int) -> bytes:
    if not 0 <= n < 1 << 28:
        raise MidiError(f"{n} does not fit a variable-length quantity")
    out = [n & 0x7F]
    while n := n >> 7:
        out.append(n & 0x7F | 0x80)
    return bytes(reversed(out))


def _track(data: bytes, at: int, end: int, track: int) -> list[dict]:
    found, tick, running = [], 0, None
    while at < end:
        delta, at = _length(data, at, end)
        tick += delta
        if at >= end:
            raise MidiError("track ends inside an event")
        row = dict.fromkeys(("channel", "pitch", "velocity", "tempo_us", "num", "den")) | {"track": track, "msg_index": len(found), "tick": tick}
        status = data[at]
        if status == 0xFF:
            if at + 1 >= end:
                raise MidiError("track ends inside an event")
            size, body = _length(data, at + 2, end)
            kind, stop, head = data[at + 1], body + size, data[at : at + 2]
            load = data[body:stop]
            row |= {"msg_type": _META.get(kind, "meta"), "raw": head + _quantity(size) + load}
            if kind == 0x51 and size >= 3:
                row["tempo_us"] = int.from_bytes(load[:3], "big")
            elif kind == 0x58 and size >= 2 and load[1] < 31:
                row |= {"num": load[0], "den": 1 << load[1]}
        elif status in (0xF0, 0xF7):
            size, body = _length(data, at + 1, end)
            stop = body + size
            row |= {"msg_type": "sysex", "raw": bytes([status]) + _quantity(size) + data[body:stop]}
        elif status > 0xF0:
            raise MidiError(f"status {status:#x} in a file")
        else:
            if status >= 0x80:
                running, at = status, at + 1
            elif running is None:
                raise MidiError("running status without a status")
            name, size = _CHANNEL[running >> 4]
            stop = at + size
            load = bytes(min(b, 127) for b in data[at:stop])
            row |= {"msg_type": name, "channel": running & 15, "raw": bytes([running]) + load}
            if size == 2 and len(load) == 2 and running >> 4 <= 0x9:
                row |= {"pitch": load[0], "velocity": load[1]}
        if stop > end:
            raise MidiError("track ends inside an event")
        at = stop
        found.append(row)
        if row["msg_type"] == "end_of_track":
            break
    return found


def decode(data: bytes) -> tuple[int, int, list[dict]]:
    """Format, ticks per beat and the messages of all tracks."""
    if len(data) < 14 or data[:4] != b"MThd":
        raise MidiError("no MThd chunk")
    size, kind, _, division = struct.unpack(">IHHH", data[4:14])
    if kind >= 2:
        raise MidiError("tracks of format 2 have no common time")
    if not 0 < division < 0x8000:
        raise MidiError("SMPTE or zero division")
    at, track, found = 8 + size, 0, []
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "big")
        at += 8
        if at + size > len(data):
            raise MidiError("file ends inside a chunk")
        if name == b"MTrk":
            found += _track(data, at, at + size, track)
            track += 1
        at += size
    return kind, division, found


def encode(tracks: list[list[tuple[int, bytes]]], division: int, kind: int = 1) -> bytes:
    """tracks: (tick, raw) in order. A track without an end gets one at its last tick."""
    out = [b"MThd" + struct.pack(">IHHH", 6, kind, len(tracks), division)]
    for events in tracks:
        body, last = [], 0
        if not events or events[-1][1] != END_OF_TRACK:
            events = [*events, (events[-1][0] if events else 0, END_OF_TRACK)]
        for tick, raw in events:
            body += [_quantity(tick - last), raw]
            last = tick
        data = b"".join(body)
        out.append(b"MTrk" + struct.pack(">I", len(data)) + data)
    return b"".join(out)


def decode_files(files: DataFrame, id_col: str = "file_id", content: str = "content") -> DataFrame:
    """file_id, format, division, error, messages: one row a file. A file that can't be
    read (or is null) has an error and no messages; it doesn't stop the others."""
    flat = files.select(F.col(id_col).alias("file_id"), F.col(content).alias("content"))

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):  # a file at a time: one may have many messages
                try:
                    kind, division, found, error = *decode(b.column("content")[i].as_py() or b""), None
                except MidiError as e:
                    kind, division, found, error = None, None, [], str(e)
                yield pa.RecordBatch.from_arrays([b.column("file_id").slice(i, 1), pa.array([kind], pa.int32()), pa.array([division], pa.int32()), pa.array([error], pa.string()), pa.array([found], pa.list_(_MESSAGE))], names=["file_id", "format", "division", "error", "messages"])

    return flat.mapInArrow(run, f"file_id {dict(flat.dtypes)['file_id']}, format int, division int, error string, messages array<{_MESSAGE_DDL}>")


def messages(decoded: DataFrame) -> DataFrame:
    return decoded.where("error is null").select("file_id", "division", F.inline("messages"))


def read_midi(spark: SparkSession, path: str) -> DataFrame:
    """decode_files() of every *.mid and *.midi below ``path``, by any store Spark reads."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{mid,midi,MID,MIDI}").option("recursiveFileLookup", "true").load(path)
    return decode_files(files, "path")


def raw_of() -> Column:
    """The event bytes of note and tempo rows made in SQL."""
    note = F.format_string("%02X%02X%02X", F.when(F.col("msg_type") == "note_on", 0x90).otherwise(0x80) + F.col("channel"), "pitch", "velocity")
    return F.unhex(F.when(F.col("msg_type").isin("note_on", "note_off"), note).when(F.col("msg_type") == "set_tempo", F.format_string("FF5103%06X", "tempo_us")))


def encode_files(rows: DataFrame, division: int = 480) -> DataFrame:
    """file_id, content. rows: file_id, track, msg_index, tick, raw. Rows stream in order, one
    file at a time; track numbers that are missing become empty tracks."""
    ordered = rows.select("file_id", "track", "msg_index", "tick", "raw").repartition("file_id").sortWithinPartitions("file_id", "track", "msg_index")
    kind = rows.schema["file_id"].dataType.simpleString()

    def run(batches):
        file, tracks, typ = None, [], None
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([file], typ), pa.array([encode(tracks, division)], pa.binary())], names=["file_id", "content"])
        for b in batches:
            typ = b.column("file_id").type
            for f, t, tick, raw in zip(*(b.column(c).to_pylist() for c in ("file_id", "track", "tick", "raw"))):
                if tracks and f != file:
                    yield batch()
                    tracks = []
                file = f
                while len(tracks) <= t:
                    tracks.append([])
                tracks[t].append((tick, raw))
        if tracks:
            yield batch()

    return ordered.mapInArrow(run, f"file_id {kind}, content binary")


_PLACE = ["file_id", "track", "msg_index"]


def patch_velocities(rows: DataFrame, velocities: DataFrame) -> DataFrame:
    """velocities: file_id, track, msg_index, new_velocity. Changes the note starts that are
    named, rounded and clipped to 1..127; all other messages stay as they are."""
    v = F.when(F.col("new_velocity").isNotNull() & (F.col("msg_type") == "note_on") & (F.col("velocity") > 0), scalar.clip_velocity(F.col("new_velocity"))).cast("int")
    named = rows.join(velocities.select(*_PLACE, "new_velocity"), _PLACE, "left").withColumn("_v", v)
    raw = F.when(F.col("_v").isNotNull(), F.concat(F.substring("raw", 1, 2), F.unhex(F.format_string("%02X", "_v")))).otherwise(F.col("raw"))
    return named.withColumns({"raw": raw, "velocity": F.coalesce("_v", "velocity")}).select(*rows.columns)


def flat_copy(rows: DataFrame, velocity: int = 64) -> DataFrame:
    """Every note start at one velocity."""
    return patch_velocities(rows, rows.select(*_PLACE, F.lit(float(velocity)).alias("new_velocity")))


def retime(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """moves: file_id, track, msg_index, new_tick. Other messages keep their tick. At one tick
    come meta events, releases, other channel events, note starts; a track ends at its
    last event or its old end, whichever is later. Messages are numbered anew."""
    at = F.greatest(F.lit(0), F.coalesce(F.rint("new_tick").cast("long"), "tick"))
    moved = rows.join(moves.select(*_PLACE, "new_tick"), _PLACE, "left").withColumn("tick", at).drop("new_tick")
    start = (F.col("msg_type") == "note_on") & (F.col("velocity") > 0)
    rank = F.when(F.col("msg_type").isin("meta", "set_tempo", "time_signature"), 0).when(start, 3).when(F.col("msg_type").isin("note_on", "note_off"), 1).otherwise(2)
    last = F.col("msg_type") == "end_of_track"
    ranked = moved.withColumn("_rank", F.when(last, 9).otherwise(rank)).withColumn("tick", F.when(last, F.max("tick").over(Window.partitionBy("file_id", "track"))).otherwise(F.col("tick")))
    order = Window.partitionBy("file_id", "track").orderBy("tick", "_rank", "msg_index")
    return ranked.withColumn("msg_index", F.row_number().over(order).cast("long") - 1).select(*rows.columns)
