"""The corpus pipeline over `documents`: quality rules, exact dedup, near dedup, mixing to target weights, packing.

Each stage works on all that the one before kept. All but the last return the columns of `documents`: lines that the
quality rules remove are gone from the texts from there on, a document that the mix takes more than once is as many
rows, and the document that a source's budget cuts holds its first words only. The last returns the packed pieces.

Nulls, empty tables, repeated rows and other columns are treated as the operators define; see their modules.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.common import drop_folders, stored, written
from netloom.llm.exact_dedup import drop_exact_duplicates
from netloom.llm.mixing import mixed_rows
from netloom.llm.near_dup import drop_near_duplicates
from netloom.llm.packing import pack
from netloom.llm.quality import cleaned


def _counted(docs: DataFrame) -> DataFrame:
    """docs with n_chars, where there is such a column, of the texts as they now are."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(cleaned(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(mixed_rows(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL can express neither the near dedup by signatures nor the packing; a test holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each result is stored in the shared folder and read by the next stage. What a stage
    read and wrote on its way is deleted once its result is stored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    read: set[str] = set()
    for name, stage in STAGES[:-1]:
        before = written(spark)
        result = stage(spark, docs, sf_dir)
        on_the_way = written(spark) - before
        docs = stored(result, name.replace(" ", "-"))
        drop_folders(spark, on_the_way | read)
        read = written(spark) - before - on_the_way
    return STAGES[-1][1](spark, docs, sf_dir)
