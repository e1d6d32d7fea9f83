"""What the corpus operators share: the shared work folder, word patterns, and distributed prefix sums."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
import weakref
from collections.abc import Callable, Sequence
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

T = TypeVar("T")

#: White space and words as the contracts define them (bytes 20 and 09 to 0D).
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. A local one is made only where the session has none, and in
    local mode only: on a cluster, other machines could not read it."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="corpus-work-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return str(root)


def work_path(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder. Everything one application writes lies under one folder; see `release`."""
    return f"{shared_dir(spark).rstrip('/')}/corpus-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Deletes all that this application's operators wrote to the shared folder; results not yet read are lost."""
    _delete(spark, f"{shared_dir(spark).rstrip('/')}/corpus-{spark.sparkContext.applicationId}")


#: Paths of stored tables by the table's number, for `dropped`.
_PATHS: dict[int, str] = {}


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = path
    weakref.finalize(out, _PATHS.pop, id(out), None)
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that `stored` gave, once all that reads them is stored itself."""
    for t in tables:
        if (path := _PATHS.pop(id(t), None)) is not None:
            _delete(t.sparkSession, path)


def written(spark: SparkSession) -> set[str]:
    """The folders that this application's operators have in the shared folder now."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/corpus-{spark.sparkContext.applicationId}")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return {str(f.getPath()) for f in fs.listStatus(at)} if fs.exists(at) else set()


def drop_folders(spark: SparkSession, paths: set[str]) -> None:
    for path in paths:
        _delete(spark, path)


def short_batches(spark: SparkSession, rows: int = 512) -> None:
    """Lets Arrow batches have `rows` rows at most: with long texts the usual 10,000 take hundreds of MB in each task.

    This is a setting of the session, since plans read it when they run; a lower one stays as it is."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


_KEPT: dict[str, object] = {}


def worker_cache(name: str, make: Callable[[], T]) -> T:
    """What a Python worker keeps between tasks: one operator's cache at a time. Workers are reused, and the caches of
    several operators together would not fit beside the executor's heap; another name frees what was kept."""
    if name not in _KEPT:
        _KEPT.clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # not on every platform
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        _KEPT[name] = make()
    return _KEPT[name]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def collapsed(text: Column) -> Column:
    """The text with every run of white space replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def words(text: Column) -> Column:
    """The array of words; empty for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def placed(df: DataFrame, order: Sequence[str], within: Sequence[str] = (), tag: str = "prefix") -> DataFrame:
    """df range-partitioned by (within, order), with its partition's number in `_part`, and stored: the numbers are
    fixed from then on, whatever is computed again. df should be narrow."""
    return stored(df.repartitionByRange(*within, *order).withColumn("_part", F.spark_partition_id()), tag)


def with_prefix(table: DataFrame, order: Sequence[str], sums: dict[str, str], within: Sequence[str] = ()) -> DataFrame:
    """Adds exclusive running sums to a `placed` table (with the same order and within), exact over the whole table and
    without a single-task sort.

    Range partitions split a hot `within` key over many tasks. Totals by partition become offsets (a row for each
    partition and key), and each partition adds its own running sums. sums maps a new column to the column it sums;
    order has to decide between rows, or equal rows share their places in any order.
    """
    totals = table.groupBy("_part", *within).agg(*(F.sum(v).alias(f"_all_{k}") for k, v in sums.items()))
    before = W.partitionBy(*within).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(F.col("_part").alias("_part_o"), *(F.col(c).alias(f"_o_{c}") for c in within), *(F.coalesce(F.sum(f"_all_{k}").over(before), F.lit(0)).alias(f"_off_{k}") for k in sums))
    same = F.col("_part") == F.col("_part_o")
    for c in within:
        same = same & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    inside = W.partitionBy("_part", *within).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    ran = table.select("*", *(F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_run_{k}") for k, v in sums.items()))
    names = [c for c in table.columns if c != "_part"]
    return ran.join(offsets, same).select(*names, *((F.col(f"_run_{k}") + F.col(f"_off_{k}")).alias(k) for k in sums))
