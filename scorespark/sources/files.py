"""Small files beside the data: metadata tables, JSON, CSV and Markdown, and the manifest.

Tables are read and written by Spark, so any store it reaches will do; JSON and Markdown are
single small texts, made on the driver from aggregates, and written through Spark's file system
so that a reader never sees half a file.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ("midi_filename", "split", "canonical_composer", "canonical_title")


def read_metadata(spark: SparkSession, path: str, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """A CSV table with a header; a required column that it lacks is a ValueError."""
    df = spark.read.csv(path, header=True, escape='"', multiLine=True)
    lacking = [c for c in required if c not in df.columns]
    if lacking:
        raise ValueError(f"{path} has no column {', '.join(lacking)}")
    return df


def with_metadata(df: DataFrame, files: DataFrame, columns: tuple[str, ...] = ("canonical_composer", "canonical_title"), most: int = 1_000_000) -> DataFrame:
    """Adds columns of the file table; files it doesn't list get nulls. Up to ``most`` files the
    table is broadcast, beyond that joined by a shuffle."""
    small = files.select("file_id", *columns)
    return df.join(F.broadcast(small) if small.count() <= most else small.hint("merge"), "file_id", "left")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, jvm


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """Under another name first, then renamed over the old file."""
    fs, at, jvm = _fs(spark, path)
    new = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(new, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    if fs.exists(at):
        fs.delete(at, False)
    if not fs.rename(new, at):
        raise OSError(f"could not rename to {path}")


def read_text(spark: SparkSession, path: str) -> str:
    rows = spark.read.text(path, wholetext=True).collect()  # one small file
    return rows[0][0] if rows else ""


def _finite(x):
    if isinstance(x, dict):
        return {str(k): _finite(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [_finite(v) for v in x]
    return None if isinstance(x, float) and not math.isfinite(x) else x


def write_json(spark: SparkSession, value, path: str) -> None:
    """What isn't finite becomes null."""
    write_text(spark, json.dumps(_finite(value), indent=2, allow_nan=False), path)


def read_json(spark: SparkSession, path: str):
    return json.loads(read_text(spark, path))


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV parts with headers; arrays as JSON texts."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").csv(path, header=True)


def dump_features(table: DataFrame, path: str) -> None:
    """A feature table in canonical order within each file."""
    write_csv(table.repartition("file_id").sortWithinPartitions("file_id", "note_idx"), path)


def dump_quantiles(df: DataFrame, path: str, levels: list[float], quantiles: str = "q") -> None:
    """A column for each level, beside the file, the note and the offset."""
    each = [F.get(F.col(quantiles), i).alias(f"q{round(100 * a):02d}") for i, a in enumerate(levels)]
    write_csv(df.select("file_id", "note_id", *each, *[c for c in ("offset_ms",) if c in df.columns]), path)


def markdown(rows: list[dict], columns: list[str] | None = None, digits: int = 3) -> str:
    """A table of a few rows; missing and not finite numbers are "nan"."""
    columns = columns or list(rows[0] if rows else [])

    def cell(v) -> str:
        if v is None or isinstance(v, float) and not math.isfinite(v):
            return "nan"
        return f"{v:.{digits}f}" if isinstance(v, float) else str(v)

    lines = [columns, ["---"] * len(columns), *([cell(r.get(c)) for c in columns] for r in rows)]
    return "\n".join(f"| {' | '.join(x)} |" for x in lines) + "\n"


def manifest(files: DataFrame, splits: DataFrame, roles: dict[str, list[str]], groups: dict[str, list[str]], settings: dict) -> dict:
    """What a data set holds. files: file_id, split, n_notes, error and more (those with an error are
    listed as failures); splits: a few rows of statistics; roles: columns by use."""
    bad = files.where("error is not null")
    return {
        "n_files": files.where("error is null").count(),
        "n_failures": bad.count(),
        "failures": [r.asDict() for r in bad.select("file_id", "error").orderBy("file_id").limit(10).collect()],  # a report's first ten
        "splits": [r.asDict() for r in splits.orderBy("split").collect()],
        "columns": roles,
        "feature_groups": groups,
        "settings": settings,
    }


def parts_metadata(spark: SparkSession, path: str) -> DataFrame:
    """path, file_id, split, n_rows of each part of a feature store: from its folders and footers."""
    df = spark.read.parquet(path)
    own = [c for c in ("split", "file_id") if c in df.columns]
    return df.groupBy(F.col("_metadata.file_path").alias("path"), *own).agg(F.count("*").alias("n_rows"))
