"""Token ids in sorted-string-table shards.

A shard file: data blocks, a Bloom filter, a sparse index and a footer. Entries ascend
by key; in a block a key is stored as the length of the prefix that it shares with the
one before and the rest of it. The index has the first key, offset and length of each
block. A lookup asks the Bloom filter, finds the block by binary search in the index,
and reads that block only. Layout, all integers little-endian, varint = LEB128:

    block   varint count, then entries (varint shared, varint rest, varint value length,
            rest of key, value); zlib-packed; then crc32 of the packed bytes (u32)
    bloom   u8 number of hashes, u32 number of bits, bits
    index   varint count, then (varint key length, key, varint offset, varint length)
    footer  u64 bloom offset, u64 index offset, u64 entries, u64 ids, u8 id width,
            8 bytes "SSTIDS01"

Keys keep order as bytes: a null is 00, an integer 01 and 8 bytes (sign flipped), a
string 02 and its UTF-8. The value is the document's ids, 2 or 4 bytes each.

Defined cases: null and empty texts have the end id only; a very long text is one entry; ids are
integers or texts; rows of equal id are neighbours, ordered by text (by the texts' hashes
where one id has several shards' worth of rows), and a lookup returns all of them; null
ids come first; an id that the id width can't hold is an error; an empty table makes no
shard; extra columns are ignored. A task writes each shard under a
fresh name and reports it in the manifest, so a repeated or speculative attempt leaves
an unlisted file and never a wrong one.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, partitions, stash, table, with_range_bucket
from .tokens import BYTE_BPE, encoder, tokenizer_path

BLOCK_BYTES = 64 * 1024
END_ID = 2
MAGIC = b"SSTIDS01"
FOOTER = struct.Struct("<QQQQB8s")


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI, and the path in it."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def key_bytes(key) -> bytes:
    if key is None:
        return b"\x00"
    if isinstance(key, int):
        return b"\x01" + struct.pack(">Q", (key + (1 << 63)) & ((1 << 64) - 1))
    return b"\x02" + key.encode("utf-8")


def key_value(raw: bytes):
    if raw[0] == 0:
        return None
    return struct.unpack(">Q", raw[1:])[0] - (1 << 63) if raw[0] == 1 else raw[1:].decode("utf-8")


def put_varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def get_varint(buf: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, hashes: int, bits: int) -> list[int]:
    h = xxhash.xxh128_intdigest(key)
    a, b = h & ((1 << 64) - 1), h >> 64 | 1
    return [(a + i * b) % bits for i in range(hashes)]


class SSTableWriter:
    """add() keys in ascending order, then close(). id_width: bytes of an id."""

    def __init__(self, sink, id_width: int = 2, block_bytes: int = BLOCK_BYTES, bits_per_key: int = 10):
        self.sink, self.id_width, self.block_bytes, self.bits_per_key = sink, id_width, block_bytes, bits_per_key
        self.at = self.n_entries = self.n_ids = 0
        self.index: list[tuple[bytes, int, int]] = []
        self.seen: list[bytes] = []
        self._reset()

    def _reset(self) -> None:
        self.block, self.size, self.count, self.first, self.last = [], 0, 0, None, b""

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.seen and key < self.seen[-1]:
            raise ValueError("keys must ascend")
        if len(ids) and int(ids.max()) >> 8 * self.id_width:
            raise ValueError(f"id {int(ids.max())} needs more than {self.id_width} bytes")
        value = ids.astype(f"<u{self.id_width}").tobytes()
        shared = 0
        if self.first is None:
            self.first = key
        else:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        entry = put_varint(shared) + put_varint(len(key) - shared) + put_varint(len(value)) + key[shared:]
        self.block += [entry, value]
        self.size += len(entry) + len(value)
        self.count += 1
        self.last = key
        self.seen.append(key)
        self.n_entries += 1
        self.n_ids += len(ids)
        if self.size >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.count:
            packed = zlib.compress(put_varint(self.count) + b"".join(self.block), 1)
            self.sink.write(packed + struct.pack("<I", zlib.crc32(packed)))
            self.index.append((self.first, self.at, len(packed) + 4))
            self.at += len(packed) + 4
            self._reset()

    def close(self) -> None:
        self._flush()
        bits = max(64, self.bits_per_key * self.n_entries)
        hashes = max(1, round(self.bits_per_key * 0.69))
        bloom = bytearray((bits + 7) // 8)
        for k in self.seen:
            for p in _probes(k, hashes, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        bloom_at = self.at
        self.sink.write(struct.pack("<BI", hashes, bits) + bytes(bloom))
        index_at = bloom_at + 5 + len(bloom)
        self.sink.write(put_varint(len(self.index)) + b"".join(put_varint(len(k)) + k + put_varint(o) + put_varint(n) for k, o, n in self.index))
        self.sink.write(FOOTER.pack(bloom_at, index_at, self.n_entries, self.n_ids, self.id_width, MAGIC))


class SSTableReader:
    """source: a seekable binary file. Footer, index and Bloom filter are read at once,
    blocks when needed."""

    def __init__(self, source):
        self.source = source
        end = source.seek(0, 2)
        if end < FOOTER.size:
            raise ValueError("not a shard")
        self.bloom_at, self.index_at, self.n_entries, self.n_ids, self.id_width, magic = FOOTER.unpack(self._read(end - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        raw = self._read(self.bloom_at, self.index_at - self.bloom_at)
        self.hashes, self.bits = struct.unpack_from("<BI", raw)
        self.bloom = raw[5:]
        raw = self._read(self.index_at, end - FOOTER.size - self.index_at)
        n, at = get_varint(raw, 0)
        self.firsts, self.blocks = [], []
        for _ in range(n):
            k, at = get_varint(raw, at)
            self.firsts.append(raw[at : at + k])
            offset, at = get_varint(raw, at + k)
            length, at = get_varint(raw, at)
            self.blocks.append((offset, length))

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _entries(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        raw = self._read(*self.blocks[i])
        if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError(f"block {i} is damaged")
        buf = zlib.decompress(raw[:-4])
        n, at = get_varint(buf, 0)
        key = b""
        for _ in range(n):
            shared, at = get_varint(buf, at)
            rest, at = get_varint(buf, at)
            size, at = get_varint(buf, at)
            key = key[:shared] + buf[at : at + rest]
            at += rest
            yield key, np.frombuffer(buf, f"<u{self.id_width}", size // self.id_width, at)
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.blocks)):
            yield from self._entries(i)

    def may_hold(self, key: bytes) -> bool:
        return self.n_entries > 0 and all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.hashes, self.bits))

    def get(self, key) -> list[np.ndarray]:
        """Ids of every entry with that key, in stored order."""
        raw, found = key_bytes(key), []
        if self.may_hold(raw):
            for i in range(max(0, bisect.bisect_left(self.firsts, raw) - 1), len(self.blocks)):
                if self.firsts[i] > raw:
                    break
                found += [v for k, v in self._entries(i) if k == raw]
        return found


_MANIFEST = "bucket int, path string, first binary, n_entries bigint, n_ids bigint, n_bytes bigint"


def write_shards(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text", id_width: int | None = None) -> DataFrame:
    """Writes ``docs`` as shards below ``folder`` (a URI that all executors reach), in
    ascending id order over all shards, and returns the manifest: bucket (ascends with
    the ids), path, first key, entries, ids, bytes. The work is done when it returns. ``id_width``: by
    default as many bytes as the vocabulary's ids and end_id need, 2 or 4."""
    spark = docs.sparkSession
    tokenizer = tokenizer or tokenizer_path(BYTE_BPE)
    if id_width is None:
        id_width = 2 if max(encoder(tokenizer).tok.get_vocab_size(), end_id or 0) < 1 << 16 else 4
    flat = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed, n_buckets = with_range_bucket(flat, "id", 2 * partitions(spark))
    dealt = keyed.withColumn("task", F.shiftright("bucket", 1)).repartitionById(-(-n_buckets // 2), "task")
    spread = dealt.sortWithinPartitions("bucket", "id", "_order", "text").select("id", "text", "bucket")
    tail = np.array([] if end_id is None else [end_id], dtype=np.uint32)

    def run(batches):
        enc = encoder(tokenizer)
        store, base = open_fs(folder)
        store.create_dir(base, recursive=True)
        out, writer, sink, now = [], None, None, None

        def done():
            writer.close()
            size = sink.tell()
            sink.close()
            out.append((now[0], now[1], writer.seen[0], writer.n_entries, writer.n_ids, size))

        for b in batches:
            for i, ids, bucket in zip(b.column("id").to_pylist(), enc.each(b.column("text")), b.column("bucket").to_pylist()):
                if now is None or now[0] != bucket:
                    if writer:
                        done()
                    name = f"ids-{bucket:06d}-{uuid.uuid4().hex}.sst"
                    now, sink = (bucket, name), store.open_output_stream(f"{base}/{name}")
                    writer = SSTableWriter(sink, id_width)
                writer.add(key_bytes(i), np.concatenate([ids, tail]))
        if writer:
            done()
        types = [pa.int32(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(types)], names=["bucket", "path", "first", "n_entries", "n_ids", "n_bytes"])

    return stash(spread.mapInArrow(run, _MANIFEST), "sst-manifest")


def read_shards(spark: SparkSession, folder: str, manifest: DataFrame, kind: str = "bigint") -> DataFrame:
    """id, start (ids of all documents before it), n_tokens, ids_crc32, read back from
    the shards. The manifest has one row a shard; the running sum over it is taken on
    the driver."""
    at, rows = 0, []
    for r in sorted(manifest.collect(), key=lambda r: r["bucket"]):
        rows.append((r["bucket"], r["path"], at))
        at += r["n_ids"]
    if not rows:
        return spark.createDataFrame([], f"id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")
    parts = spark.createDataFrame(rows, "bucket int, path string, start bigint").repartition(min(len(rows), 2 * partitions(spark)), "bucket")

    def run(batches):
        store, base = open_fs(folder)
        own = pa.string() if kind == "string" else pa.int64()
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
                out = []
                with store.open_input_file(f"{base}/{path}") as f:
                    for key, ids in SSTableReader(f):
                        out.append((key_value(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], own), *(pa.array([r[j] for r in out], pa.int64()) for j in (1, 2, 3))], names=["id", "start", "n_tokens", "ids_crc32"])

    return parts.mapInArrow(run, f"id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def lookup(folder: str, manifest_rows: list, key) -> list[np.ndarray]:
    """Ids of the documents with that identifier: one shard by the first keys, then one
    block. manifest_rows: collected rows of the manifest, one a shard."""
    rows = sorted(manifest_rows, key=lambda r: r["bucket"])
    raw, found = key_bytes(key), []
    i = max(0, bisect.bisect_left([bytes(r["first"]) for r in rows], raw) - 1)
    store, base = open_fs(folder)
    for r in rows[i:]:
        if bytes(r["first"]) > raw:
            break
        with store.open_input_file(f"{base}/{r['path']}") as f:
            found += SSTableReader(f).get(key)
    return found


def op5_token_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "token-shards")
    manifest = write_shards(table(spark, sf_dir, "documents"), folder)
    return read_shards(spark, folder, manifest).withColumnRenamed("id", "doc_id")
