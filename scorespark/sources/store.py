"""Feature store: Parquet by split, built in steps that can be resumed.

Below the path: ``features`` (partitioned by split, zstd), ``config`` (one row, a hash of
what the features were made with). Only Spark touches the store, so any file system will do.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class StoreMismatch(ValueError):
    """The store was made with another configuration."""


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh name in the folder that driver and executors share."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def build(features: DataFrame, path: str, config: dict, overwrite: bool = False) -> None:
    """Adds the files (file_id) that the store lacks. features has split and file_id. Files
    appear when the job commits, so a stopped build leaves no part of a file. Another
    config is refused, unless all is to be overwritten."""
    spark = features.sparkSession
    mark = hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()
    known = None if overwrite else _read(spark, f"{path}/config")
    if known is not None and known.first()["mark"] != mark:
        raise StoreMismatch(f"{path} was built with another configuration")
    if known is None:
        spark.createDataFrame([(mark, json.dumps(config, sort_keys=True))], "mark string, config string").write.mode("overwrite").parquet(f"{path}/config")
    have = None if overwrite else _read(spark, f"{path}/features")
    todo = features if have is None else features.join(have.select("file_id").distinct(), "file_id", "left_anti").select(*features.columns)
    by = [c for c in ("split", "file_id", "note_idx") if c in features.columns]
    todo.repartition("split", "file_id").sortWithinPartitions(*by).write.partitionBy("split").option("compression", "zstd").mode("overwrite" if overwrite else "append").parquet(f"{path}/features")


def read(spark: SparkSession, path: str, columns: list[str], splits: list[str] | None = None, files: list[int] | None = None) -> DataFrame:
    """Only the given columns; splits prune folders, files are pushed to the scan."""
    df = spark.read.parquet(f"{path}/features")
    if splits is not None:
        df = df.where(F.col("split").isin(splits))
    if files is not None:
        df = df.where(F.col("file_id").isin(files))
    return df.select(*columns)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """split, n_files, n_rows, n_columns."""
    df = spark.read.parquet(f"{path}/features")
    return df.groupBy("split").agg(F.countDistinct("file_id").alias("n_files"), F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))
