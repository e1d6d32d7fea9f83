"""Exact dedup by content sort.

Texts are normalised (runs of white space become one space; null counts as empty) and range-partitioned by their bytes
with sampled splitters; Spark's external sort puts equal texts next to each other, and a window whose groups are made by
full comparison of neighbouring rows names the smallest identifier of each run.

A text that holds a large share of all rows would land in one range. Such texts are found in a bounded sample (hashes
only); their rows get a salt as second sort key, so that their run is cut over many partitions, and one small
aggregation over these rows alone, pre-aggregated in each map task with the whole text as key, joins the cut runs.

Defined results: null text equals the empty text; a null identifier sorts last and is named only if the whole group has
none; of repeated rows (same text and identifier) exactly one is kept; an empty table gives no rows; other columns of
the input are never looked at, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.llm.common import collapsed, shuffle_partitions

#: Sampled rows for each shuffle partition when hot texts are looked for.
SAMPLE_ROWS = 200
#: A text is hot from this share of one partition's rows.
HOT_SHARE = 0.25
#: Characters of a text in its range key.
HEAD = 16


def _hot(base: DataFrame, rows: int, parts: int) -> list[tuple[int, int]]:
    """(hash, salts) of the texts that hold a large share of all rows: at most parts / HOT_SHARE of them, from a sample
    of SAMPLE_ROWS x parts rows. A miss costs balance only, never a result."""
    share = min(1.0, SAMPLE_ROWS * parts / max(rows, 1))
    least = max(16.0, rows * share * HOT_SHARE / parts)
    seen = base.sample(share, 7).groupBy(F.xxhash64("norm").alias("h")).count().filter(F.col("count") >= least).collect()
    return [(r["h"], math.ceil(4 * parts * r["count"] / (rows * share))) for r in seen]


def _sorted_runs(df: DataFrame, id_col: str, text_col: str, carry: Column | None) -> DataFrame:
    spark = df.sparkSession
    parts = shuffle_partitions(spark)
    base = df.select(F.col(id_col).alias("doc_id"), collapsed(F.col(text_col)).alias("norm"), *([] if carry is None else [carry.alias("carried")]))
    hot = _hot(base.select("norm"), df.count(), parts)
    salt, joined = F.lit(0), None
    if hot:
        table = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({h}L, {n})" for h, n in hot) + " AS t(hot_hash, salts)")
        base = base.join(F.broadcast(table), F.xxhash64("norm") == F.col("hot_hash"), "left")
        joined = base.filter("salts IS NOT NULL").groupBy("norm").agg(F.min("doc_id").alias("hot_keep"), F.count(F.lit(1)).alias("hot_size"))
        joined = joined.select(F.sha2("norm", 256).alias("hot_sha"), "hot_keep", "hot_size")
        salt = F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.col("salts"))).otherwise(0)
    # Splitters are sampled from short keys, a prefix and a hash of the text, so what the driver gets of them is bounded
    # whatever the length of texts. Rows are sorted by the whole text too, and runs end where neighbours differ.
    key = ["head", "hash"] + ["salt"] * bool(hot)
    base = base.select("doc_id", "norm", F.substring("norm", 1, HEAD).alias("head"), F.xxhash64("norm").alias("hash"), salt.cast("int").alias("salt"), *([] if carry is None else ["carried"]))
    # One exchange: the range partitioning is also what the window needs.
    runs = base.repartitionByRange(*key).sortWithinPartitions(*key, "norm", F.asc_nulls_last("doc_id"))
    run = W.partitionBy(*key, "norm")
    runs = runs.select(
        "doc_id",
        F.row_number().over(run.orderBy(F.asc_nulls_last("doc_id"))).alias("place"),
        F.min("doc_id").over(run).alias("run_keep"),
        F.count(F.lit(1)).over(run).alias("run_size"),
        F.sha2("norm", 256).alias("text_sha256"),
        *([] if carry is None else ["carried"]),
    )
    if joined is None:
        return runs.select("doc_id", F.col("run_keep").alias("keep_id"), F.col("run_size").alias("group_size"), (F.col("place") == 1).alias("kept"), "text_sha256", *([] if carry is None else ["carried"]))
    # At most a row for each hot text, 100 bytes each: the bound that permits the broadcast.
    runs = runs.join(F.broadcast(joined), F.col("text_sha256") == F.col("hot_sha"), "left")
    keep = F.when(F.col("hot_sha").isNotNull(), F.col("hot_keep")).otherwise(F.col("run_keep"))
    return runs.select("doc_id", keep.alias("keep_id"), F.coalesce("hot_size", "run_size").alias("group_size"), ((F.col("place") == 1) & (F.col("hot_sha").isNull() | F.col("doc_id").eqNullSafe(keep))).alias("kept"), "text_sha256", *([] if carry is None else ["carried"]))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of df: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text in UTF-8)."""
    return _sorted_runs(df, id_col, text_col, None)


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay, all columns as they were. They travel with the sort, so there is no join back."""
    names = [f"c{i}" for i in range(len(df.columns))]
    renamed = df.toDF(*names)
    of = dict(zip(df.columns, names, strict=True))
    kept = _sorted_runs(renamed, of[id_col], of[text_col], F.struct(*names)).filter("kept")
    return kept.select(*(F.col(f"carried.{n}").alias(c) for n, c in zip(names, df.columns, strict=True)))
