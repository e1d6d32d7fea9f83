"""Counts files, annotation, factors in file names, and simulated activity.

Everything is read by Spark's own readers with explicit schemas; nothing is listed or opened on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: File name pattern, factor order, and the columns of annotation files that are read (from 0).
COUNTS_PATTERN = "*Annotated_counts.csv"
FACTORS = ("experiment", "subject", "hemisphere", "signal", "group")
ANNOTATION_COLUMNS = {"id": 0, "region": 1, "acronym": 2, "parent_id": 7, "parent_acronym": 8}
UNLABELED = "Unlabeled"


def read_counts(spark: SparkSession, path: str | Sequence[str], balanced: bool = True) -> DataFrame:
    """file, id, value of headerless csv or txt files; txt is split at white space. balanced=False takes ragged lines
    and keeps their first two fields; fields that are no numbers are null. With several paths a file is named with its
    folder, since folders may have files of the same name."""
    several = not isinstance(path, str)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+/[^/]+)$", 1) if several else F.col("_metadata.file_name")
    text = (path if isinstance(path, str) else path[0]).endswith(".txt")
    path = list(path) if several else path
    if balanced and not text:
        return spark.read.schema("id int, value double").csv(path, mode="PERMISSIVE").select(name.alias("file"), "id", "value")
    fields = F.split(F.trim("value"), r"\s+" if text else r"\s*,\s*")
    return spark.read.text(path).filter(F.trim("value") != "").select(name.alias("file"), F.get(fields, F.lit(0)).try_cast("int").alias("id"), F.get(fields, F.lit(1)).try_cast("double").alias("value"))


def read_table(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """A generic csv or txt table with all of its columns."""
    return spark.read.csv(path, header=header, inferSchema=True, sep="\t" if path.endswith(".txt") else ",")


def read_annotation(spark: SparkSession, path: str, drop_unlabeled: bool = True, name: str = "region") -> DataFrame:
    """id, parent_id, region, acronym, parent_acronym, read by position; `name` says which field names a region."""
    raw = spark.read.csv(path, header=True, sep="\t" if path.endswith(".txt") else ",")
    at = {k: F.col(f"`{raw.columns[i]}`") for k, i in ANNOTATION_COLUMNS.items()}
    out = raw.select(at["id"].try_cast("int").alias("id"), at["parent_id"].try_cast("int").alias("parent_id"), at["region"].alias("region"), F.replace(at["acronym"], F.lit("-"), F.lit(".")).alias("acronym"), F.replace(at["parent_acronym"], F.lit("-"), F.lit(".")).alias("parent_acronym"))
    if drop_unlabeled:
        out = out.filter(~F.col("region").eqNullSafe(F.lit(UNLABELED)))
    return out if name == "region" else out.withColumn("region", F.col(name))


def factors_of(file: Column) -> list[Column]:
    """The factors in a file name: fields between underscores before `_An`."""
    parts = F.split(F.regexp_replace(F.regexp_replace(file, "^.*/", ""), "_An.*", ""), "_")
    return [F.get(parts, F.lit(i)).alias(f) for i, f in enumerate(FACTORS)]


def fill_counts(counts: DataFrame, annotation: DataFrame) -> DataFrame:
    """file, id, acronym, value for every file and annotated id: the first value of an id in a file, 0 if absent."""
    first = counts.withColumn("_row", F.monotonically_increasing_id()).groupBy("file", "id").agg(F.min_by("value", "_row").alias("value"))
    grid = counts.select("file").distinct().crossJoin(annotation.select("id", "acronym"))
    return grid.join(first, ["file", "id"], "left").select("file", "id", "acronym", F.coalesce("value", F.lit(0.0)).alias("value"))


def ingest(spark: SparkSession, annotation_path: str, data_path: str | Sequence[str], balanced: bool = True, layer_1: bool = True, roll_up: bool = True, trim: bool = False, keep: Sequence[str] | DataFrame | None = None, add: Sequence[str] = (), activity_zero: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(regions, samples, activity) of one or more folders of counts files.

    samples: sample, the factors, and signal_level, the number of the signal among all signals in falling order; activity:
    sample, region (acronym), value. Options: layer_1=False drops first layers, roll_up adds children to parents, trim keeps
    surviving leaves, keep names acronyms (a list, or a table with a column acronym) and `add` more of them. All-zero regions
    are dropped, unless activity_zero. regions has anatomical_group and color."""
    from netloom.operators import hierarchy, prep

    regions = read_annotation(spark, annotation_path)
    folders = f"{data_path.rstrip('/')}/{COUNTS_PATTERN}" if isinstance(data_path, str) else [f"{p.rstrip('/')}/{COUNTS_PATTERN}" for p in data_path]
    counts = fill_counts(read_counts(spark, folders, balanced), regions)
    samples = counts.select(F.col("file").alias("sample"), *factors_of(F.col("file"))).distinct()
    # A handful of signals: their numbers come from pairs of them.
    signals = samples.select("signal").distinct()
    number = signals.join(signals.withColumnRenamed("signal", "after"), F.col("after") >= F.col("signal"), "left").groupBy("signal").agg(F.count("after").cast("int").alias("signal_level"))
    samples = samples.join(number, "signal", "left").select("sample", *FACTORS, "signal_level")
    activity = counts.select(F.lit("all").alias("net"), F.col("file").alias("sample"), "id", "value")
    kept = regions if layer_1 else hierarchy.drop_layer_1(regions)
    if roll_up:
        activity = hierarchy.tree_sum(kept, activity)
    if trim:
        kept = hierarchy.trim(kept)
    if keep is not None and not isinstance(keep, DataFrame):
        kept = kept.filter(F.col("acronym").isin(*keep, *add))
    elif keep is not None:
        named = F.col("acronym").isin(*add) if add else F.lit(False)
        kept = kept.filter(named).unionByName(kept.filter(~named).join(keep.select("acronym").distinct(), "acronym", "left_semi").select(*kept.columns))
    activity = activity.join(kept.select("id", F.col("acronym").alias("region")), "id").select("net", "sample", "region", "value")
    regions = hierarchy.colored(hierarchy.grouped(kept))
    return regions, samples, (activity if activity_zero else prep.drop_zero_regions(activity)).drop("net")


def write_counts(counts: DataFrame, folder: str) -> list[str]:
    """Writes counts (folder, file, id, value) as headerless files `folder`/<folder>/<file> and returns the folders.

    Spark writes each file from one task; only their names, a row for each file, are seen by the driver."""
    spark = counts.sparkSession
    lines = counts.select("folder", "file", F.concat_ws(",", "id", "value").alias("value"))
    lines.repartition("folder", "file").write.partitionBy("folder", "file").text(f"{folder}/raw")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    folders = set()
    for r in counts.select("folder", "file").distinct().collect():
        fs.mkdirs(path(f"{folder}/{r['folder']}"))
        for part in fs.listStatus(path(f"{folder}/raw/folder={r['folder']}/file={r['file']}")):
            fs.rename(part.getPath(), path(f"{folder}/{r['folder']}/{r['file']}"))
        folders.add(f"{folder}/{r['folder']}")
    return sorted(folders)


def network_of_file(spark: SparkSession, path: str, clean: bool = False, **options: object) -> tuple[DataFrame, DataFrame]:
    """(edges, vertices) of one table file with a row for each sample and a column for each region; options go to
    `build_networks`."""
    from netloom.operators import network, prep

    wide = read_table(spark, path).withColumn("sample", F.monotonically_increasing_id())
    names = [c for c in wide.columns if c != "sample"]
    cells = wide.select("sample", F.explode(F.array(*(F.struct(F.lit(c).alias("region"), F.col(f"`{c}`").try_cast("double").alias("value")) for c in names))).alias("c"))
    activity = cells.select(F.lit(path.rsplit("/", 1)[-1]).alias("net"), "sample", "c.region", "c.value")
    return network.build_networks(prep.clean(activity) if clean else activity, **options)


def gaussian(spark: SparkSession, subjects: int = 50, groups: int = 2, size: int = 100, means: tuple[float, float] = (400.0, 400.0), sds: tuple[float, float] = (10.0, 50.0), diff: bool = False, seed: int = 0) -> DataFrame:
    """sample, level, region, value: Gaussian activity with group labels dealt at random; with diff the first half of
    the groups has the second mean and standard deviation."""
    from pyspark.sql import Window as W

    people = spark.range(subjects).withColumn("level", (F.row_number().over(W.orderBy(F.xxhash64("id", F.lit(seed)))) % groups + 1).cast("string"))
    other = (F.col("level").cast("int") <= groups // 2) & F.lit(diff)
    cells = people.crossJoin(spark.range(size).select(F.format_string("r%04d", "id").alias("region")))
    z = F.randn(seed)
    return cells.select(F.col("id").cast("string").alias("sample"), "level", "region", F.when(other, z * sds[1] + means[1]).otherwise(z * sds[0] + means[0]).alias("value"))
