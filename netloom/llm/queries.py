"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from netloom.llm import oracle
from netloom.llm.best_fit import pack_best_fit
from netloom.llm.binary import read_token_files, write_token_files
from netloom.llm.collocations import collocations
from netloom.llm.exact_dedup import exact_dedup
from netloom.llm.hard_negatives import hard_negatives, relabelled
from netloom.llm.html import extract
from netloom.llm.licenses import scan
from netloom.llm.mixing import mix
from netloom.llm.near_dup import near_duplicates
from netloom.llm.packing import pack
from netloom.llm.quality import measure
from netloom.llm.sharding import shard_by_bytes
from netloom.llm.warc import digests, read_archive, write_archive


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_documents(spark, sf_dir))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(_documents(spark, sf_dir))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(_documents(spark, sf_dir)).drop("clean_text")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_archive(spark, write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_documents(spark, sf_dir))


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_best_fit(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(relabelled(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op3_packing": op3_packing,
    "op4_minhash": op4_minhash,
    "op6_mixing": op6_mixing,
    "op8_sharding": op8_sharding,
    "op9_token_files": op9_token_files,
    "op10_quality": op10_quality,
    "op7_warc": op7_warc,
    "op2_html_extraction": op2_html_extraction,
    "op5_license_scan": op5_license_scan,
    "op11_best_fit": op11_best_fit,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": oracle.EXACT_DEDUP,
    "op6_mixing": oracle.MIXING,
    "op8_sharding": oracle.SHARDING,
    "op10_quality": oracle.QUALITY,
    "op7_warc": oracle.WARC,
    "op5_license_scan": oracle.LICENSES,
    "op12_hard_negatives": oracle.HARD_NEGATIVES,
    "op13_collocations": oracle.COLLOCATIONS,
}
