"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections import Counter

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and every executor see: ``spark.checkpoint.dir`` of
    the session. Where that is unset (tests), one below the warehouse is set."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str, rows_a_file: int = 0) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: cuts the
    lineage, and a lost executor costs one reread instead of the work before.
    rows_a_file: at most so many (0: any number), where each becomes many rows in the task that reads it."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("maxRecordsPerFile", rows_a_file).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stash(df: DataFrame) -> None:
    """Removes what ``stash`` wrote; nothing that is still to be run may read ``df``."""
    sc = df.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """_row, doc (a struct of all columns, whatever their names): rows with a number that is fixed
    once they are written."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    return stash(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*cols).alias("doc")), name)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (replicated by the shared store), eager."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fold_is(id_col: str, mod: int, rem: int) -> Column:
    """True where crc32(id as text) mod ``mod`` is ``rem``; a null id is in no fold."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(mod)) == rem, F.lit(False))


def hash_share(id_col: str, share: float, seed: int) -> Column:
    """A fixed pseudo-random ``share`` of ids."""
    if share >= 1:
        return F.lit(True)
    return F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)), F.lit(1_000_003)) < int(share * 1_000_003)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


_NO_ID = -1.7976931348623157e308


def id_number(df: DataFrame, id_col: str) -> Column:
    """A double that ascends with the id (ties allowed); null ids come first. Of texts
    the six bytes after the prefix that all of them share."""
    kind, col = dict(df.dtypes)[id_col], F.col(id_col)
    if kind in ("date", "timestamp"):
        col = col.cast("timestamp").cast("double")
    elif kind == "string":
        ends = df.agg(F.min(id_col), F.max(id_col)).first()
        low, high = ((x or "").encode() for x in ends)
        same = next((i for i, (x, y) in enumerate(zip(low, high)) if x != y), min(len(low), len(high)))
        part = F.hex(F.substring(F.encode(col, "UTF-8"), same + 1, 6))
        col = F.conv(F.rpad(part, 12, "0"), 16, 10).cast("double")
    else:
        col = col.cast("double")
    return F.coalesce(col, F.lit(_NO_ID))


def with_range_bucket(df: DataFrame, id_col: str, n: int, text_col: str = "text", out: str = "bucket") -> tuple[DataFrame, int]:
    """Adds an int bucket (from 0) that ascends with the id, about n of them with about equally
    many rows each, and ``_order``, which orders rows of equal id; returns the number of
    buckets too. The cut points come from a mergeable quantile sketch. Equal ids share a
    bucket, but for an id (or none) that has several buckets' worth of rows: these are
    spread in the order of their texts' hashes, and ``_order`` is that hash."""
    keyed = df.withColumn("_key", id_number(df, id_col))
    found = sorted(keyed.approxQuantile("_key", [i / n for i in range(1, n)], 0.25 / n)) if n > 1 else []
    times = Counter(found)
    hot = [c for c, k in times.items() if k > 1]
    if hot:  # unlike ids may share a number
        one = keyed.where(F.col("_key").isin(hot)).groupBy("_key").agg((F.min(id_col).eqNullSafe(F.max(id_col))).alias("one")).where("one").collect()
        hot = [r["_key"] for r in one]
    cuts = sorted(times)
    if not cuts:
        return keyed.withColumn(out, F.lit(0)).withColumn("_order", F.lit(0).cast("bigint")).drop("_key"), 1
    b = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="_key", outputCol="_region")
    placed = b.transform(keyed).withColumn("_region", F.col("_region").cast("int"))
    if not hot:
        return placed.withColumn(out, F.col("_region")).withColumn("_order", F.lit(0).cast("bigint")).drop("_key", "_region"), len(cuts) + 1
    parts = [times[c] if c in hot else 0 for c in cuts]
    first, at = [0], 1
    for k in parts:
        first.append(at)
        at += k + 1
    share = F.get(F.lit([0, *parts]), F.col("_region"))
    hashed = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    sub = F.least(F.floor((hashed / 2.0**64 + 0.5) * share), share - 1).cast("int")
    spread = F.when((share > 0) & F.col("_key").isin(hot), sub).otherwise(share)
    placed = placed.withColumn(out, (F.get(F.lit(first), F.col("_region")) + spread).cast("int"))
    return placed.withColumn("_order", hashed).drop("_key", "_region"), at


def texts_of(batch: pa.RecordBatch, col: str = "text") -> list[str]:
    """Texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(col).to_pylist()]


class Cache(dict):
    """Word cache of a worker: two generations, so that memory stays bounded and
    frequent words stay in. ``make`` fills misses; its value depends on the key only."""

    def __init__(self, make, size: int = 250_000):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def trim(self) -> None:
        """Called between texts."""
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()
