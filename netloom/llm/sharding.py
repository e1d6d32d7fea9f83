"""Sharding by global byte-size prefix sums.

Documents in identifier order get the number of bytes before them from per-partition totals; a document belongs to the
shard in whose equal share of all bytes its middle lies. Shards are contiguous in that order, and their sizes differ by
less than one document. The law is `bytes`; equal texts are not held together, since one group of copies may be larger
than a shard.

Defined results: null text has no bytes (size 1); null identifiers sort first; repeated rows each get a slot of their
own; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import placed, with_prefix


def shard_by_bytes(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: it belongs to another law)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = df.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit(1).cast("long").alias("one"))
    order = ["doc_id", "text_crc32", "size"]
    table = placed(narrow, order, tag="shard")
    total = table.agg(F.sum("size")).first()[0] or 1
    cut = with_prefix(table, order, {"start": "size", "place": "one"}).withColumn("shard", F.expr(f"CAST(((start * 2 + size) * {int(shards)}) DIV {2 * total} AS INT)"))
    # A row for each shard.
    first = cut.groupBy("shard").agg(F.min("place").alias("first_place")).withColumnRenamed("shard", "first_shard")
    out = cut.join(F.broadcast(first), F.col("shard") == F.col("first_shard"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first_place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(df: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the rows of df as Parquet in folders shard=0 .. in identifier order.

    Shards are runs of identifiers, so their first identifiers (a row for each shard) are all that meets the texts. Rows
    that share an identifier across a cut all go to the upper shard; rows without one go to the lowest."""
    starts = shard_by_bytes(df, shards, id_col, text_col).groupBy("shard").agg(F.min("doc_id").alias("least")).filter("least IS NOT NULL").collect()
    shard = F.greatest(F.lit(0), *(F.when(F.col(id_col) >= r["least"], r["shard"]) for r in starts))
    df.withColumn("shard", shard).repartitionByRange("shard", id_col).sortWithinPartitions("shard", id_col).write.partitionBy("shard").parquet(path)
