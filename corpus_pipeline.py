"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
and read again as the next stage's docs. All but the last return documents' columns.

Defined cases, in every stage: null and empty texts have no letter and leave at the language
stage; very long texts are read whole; rows without an id, or of one id, stand or fall by their
own text; an empty table passes through; other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scorespark.llm import decontaminate, language, near_copies, packing, quality
from scorespark.llm.common import fold_is, new_folder, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the ordinal classifier grades as poor go."""
    return quality.select_documents(docs, quality.train_on_labels(spark, docs, sf_dir))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, and those in which no language has half, go."""
    return language.keep_identified(docs, language.train(docs.where(~fold_is("doc_id", 5, 0))))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash tries over 5-word shingles; of each component of texts with a similarity of 0.8
    or more the smallest doc_id stays."""
    return near_copies.keep_one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a ten-word window of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents that are left, placed in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Trained models, hashes of shingles and packing can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
