"""WARC archives: a normaliser for monolithic gzip files, with sidecar offset indexes.

``write_monolithic`` writes each partition's records as one gzip stream, as crawlers'
tools often do. ``normalise`` inflates such a stream once, front to back, in bounded
memory, writes every record anew as a gzip member of its own, and beside it an index
(one line a record: offset, length, type, record id, digest). ``read_archive`` goes by
the index and inflates single members.

Records with equal payloads of at least ``MIN_REVISIT`` bytes: the one with the largest id
is the response, the others are revisits (identical-payload-digest profile) that carry
its HTTP head and no payload.

Defined cases: null html is an empty payload; a null url is left out; control characters
in a url are percent-encoded; rows that repeat the largest id are all responses; a null id
is smaller than any other, and a revisit of a response without id refers to null; an empty
table writes no file; extra columns are ignored. Files have fresh names and count only
if the manifest lists them, so repeated attempts do no harm.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, partitions, stash, table
from .sstable import open_fs

MIN_REVISIT = 0
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
READ = 1 << 18


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def _clean(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record_uri(page_id) -> str:
    return "urn:page:" + ("" if page_id is None else str(page_id))


def build_record(page_id, url: str | None, payload: bytes, payload_digest: str, n_bytes: int, refers_to: str | None) -> bytes:
    """A response, or a revisit if ``refers_to`` (a record URI) is given; a revisit's
    payload is dropped. Digest and length are those of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode("ascii")
    block = http + (b"" if refers_to is not None else payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_uri(page_id)}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{payload_digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def inflate(source) -> Iterator[bytes]:
    """Bytes of a gzip file, one member or many, front to back, never seeking."""
    z = zlib.decompressobj(31)
    while raw := source.read(READ):
        while raw:
            yield z.decompress(raw, READ)
            while z.unconsumed_tail:
                yield z.decompress(z.unconsumed_tail, READ)
            raw = z.unused_data
            if z.eof:
                z = zlib.decompressobj(31)
            elif not raw:
                break


def split_records(stream: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, whole record) of each record of an inflated stream."""
    buf = bytearray()

    def fill(enough) -> bool:
        while not enough():
            part = next(stream, None)
            if part is None:
                return False
            buf.extend(part)
        return True

    while True:
        if not fill(lambda: len(buf) >= 5):
            if bytes(buf).strip():
                raise ValueError("trailing bytes")
            return
        if buf[:5] != b"WARC/":
            raise ValueError("no record where one should begin")
        at = 0

        def headed() -> bool:
            nonlocal at
            found = buf.find(b"\r\n\r\n", at)
            at = found if found >= 0 else max(0, len(buf) - 3)
            return found >= 0

        if not fill(headed):
            raise ValueError("a record is cut off")
        head = parse_head(bytes(buf[:at]))
        end = at + 4 + int(head["content-length"]) + 4
        if not fill(lambda: len(buf) >= end):
            raise ValueError("a record is cut off")
        yield head, bytes(buf[:end])
        del buf[:end]


def gzip_member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def normalise_file(source, sink, index) -> int:
    """Monolithic gzip in, one member a record out, and the index. Returns the records."""
    at = n = 0
    for head, record in split_records(inflate(source)):
        member = gzip_member(record)
        sink.write(member)
        line = f"{at} {len(member)} {head['warc-type']} {head['warc-record-id'].strip('<>')} {head.get('warc-payload-digest', '-')}\n"
        index.write(line.encode("utf-8"))
        at += len(member)
        n += 1
    return n


def read_archive(source, index) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """(WARC fields, HTTP fields, payload) by the index, member by member."""
    for line in index.read().decode("utf-8").splitlines():
        offset, length = map(int, line.split(" ")[:2])
        source.seek(offset)
        record = zlib.decompress(source.read(length), 31)
        cut = record.index(b"\r\n\r\n")
        head = parse_head(record[:cut])
        block = record[cut + 4 : cut + 4 + int(head["content-length"])]
        end = block.index(b"\r\n\r\n")
        yield head, parse_head(block[:end]), block[end + 4 :]


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_REVISIT) -> DataFrame:
    """id, url, payload, digest, n_bytes, of_id, revisit. A payload's largest id is found
    with partial aggregation. Only light rows go to that join, html only to the one by
    id, so a payload that many pages have makes no heavy task."""
    flat = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    full = flat.withColumn("sha", F.unhex(F.sha1("payload"))).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    most = full.where(F.col("n_bytes") >= min_bytes).groupBy("sha", "n_bytes").agg(F.max("id").alias("of_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    light = full.select("id", "sha", "n_bytes").join(most, ["sha", "n_bytes"])
    again = stash(light.where(~F.col("id").eqNullSafe(F.col("of_id"))).select("id", "sha", F.col("of_id"), F.lit(True).alias("revisit")).distinct(), "revisits")
    back = again.withColumnsRenamed({"id": "_id", "sha": "_sha"})
    return full.join(back, full["id"].eqNullSafe(back["_id"]) & (full["sha"] == back["_sha"]), "left").select("id", "url", "payload", "sha", "n_bytes", "of_id", F.coalesce("revisit", F.lit(False)).alias("revisit"))


def write_monolithic(records: DataFrame, folder: str) -> DataFrame:
    """One gzip stream a partition below ``folder``. Returns the manifest (path, n)."""

    def run(batches):
        store, base = open_fs(folder)
        store.create_dir(base, recursive=True)
        sink, n, name = None, 0, f"crawl-{uuid.uuid4().hex}.warc.gz"
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        for b in batches:
            for i, url, payload, sha, size, of_id, again in zip(*(b.column(c).to_pylist() for c in ("id", "url", "payload", "sha", "n_bytes", "of_id", "revisit"))):
                sink = sink or store.open_output_stream(f"{base}/{name}", compression=None)
                sink.write(z.compress(build_record(i, url, payload, base64.b32encode(sha).decode("ascii"), size, record_uri(of_id) if again else None)))
                n += 1
        if sink:
            sink.write(z.flush())
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["path", "n"])

    return stash(records.mapInArrow(run, "path string, n bigint"), "warc-manifest")


def _per_file(manifest: DataFrame) -> DataFrame:
    """A task for each few files. The manifest has one row a file."""
    n = manifest.count()
    return manifest.repartition(max(1, min(n, 2 * partitions(manifest.sparkSession))), "path")


def normalise(manifest: DataFrame, folder: str) -> DataFrame:
    """Normalises each listed file; returns the new manifest: path, index_path, n."""

    def run(batches):
        store, base = open_fs(folder)
        for b in batches:
            out = []
            for path in b.column("path").to_pylist():
                name = f"records-{uuid.uuid4().hex}.warc.gz"
                with store.open_input_stream(f"{base}/{path}", compression=None) as source, store.open_output_stream(f"{base}/{name}", compression=None) as sink, store.open_output_stream(f"{base}/{name}.idx", compression=None) as index:
                    out.append((name, f"{name}.idx", normalise_file(source, sink, index)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.int64())], names=["path", "index_path", "n"])

    return stash(_per_file(manifest).mapInArrow(run, "path string, index_path string, n bigint"), "warc-records")


def read_records(manifest: DataFrame, folder: str, kind: str = "bigint") -> DataFrame:
    """id, payload_bytes, payload_digest, record_type, refers_to, read back; a response's
    digest is computed from its payload again."""
    own = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]

    def ident(uri: str | None):
        value = None if uri is None else uri.strip("<>").removeprefix("urn:page:")
        return None if not value else value if kind == "string" else int(value)

    def run(batches):
        store, base = open_fs(folder)
        for b in batches:
            for path, at in zip(b.column("path").to_pylist(), b.column("index_path").to_pylist()):
                rows = []
                with store.open_input_file(f"{base}/{path}") as source, store.open_input_stream(f"{base}/{at}", compression=None) as index:
                    for head, http, payload in read_archive(source, index):
                        said = head["warc-payload-digest"].removeprefix("sha1:")
                        response = head["warc-type"] == "response"
                        if response and (digest(payload) != said or len(payload) != int(http["content-length"])):
                            raise ValueError(f"{head['warc-record-id']} is damaged")
                        rows.append((ident(head["warc-record-id"]), int(http["content-length"]), said, head["warc-type"], ident(head.get("warc-refers-to"))))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], own), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.string()), pa.array([r[4] for r in rows], own)], names=["id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return _per_file(manifest).mapInArrow(run, f"id {kind}, payload_bytes bigint, payload_digest string, record_type string, refers_to {kind}")


def op7_warc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    pages = table(spark, sf_dir, "pages")
    written = normalise(write_monolithic(with_revisits(pages), folder), folder)
    return read_records(written, folder).withColumnRenamed("id", "page_id")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS hex FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS last FROM d)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, CAST(k // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM r
"""
