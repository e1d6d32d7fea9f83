"""How the test tables stand for the library's data model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators import network, prep

CUT = 0.2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def six(column: str | Column) -> Column:
    """Rounded to six places, without negative zero."""
    c = F.round(F.col(column) if isinstance(column, str) else column, 6)
    return F.when(c == 0, F.lit(0.0)).otherwise(c)


def rounded(df: DataFrame) -> DataFrame:
    """All doubles to six places."""
    return df.select(*(six(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """net (return flag), sample (month), region (brand), value (quantity); absent cells have no row."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_returnflag", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return li.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_returnflag").alias("net"), F.date_format("l_shipdate", "yyyy-MM").alias("sample"), F.col("p_brand").alias("region")).agg(F.sum("l_quantity").alias("value"))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells with zeros for absent ones. The aggregate is small against its input and read three times: once for
    samples, regions and values each, so it is written once."""
    c = network.checkpointed(cells(spark, sf_dir))
    return prep.fill_absent(c, c, c)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.corr_edges(activity(spark, sf_dir))


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.graph(edges(spark, sf_dir).filter(F.abs("r") > CUT))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir).select("net", "region").distinct()
    return network.match_nodes(c.withColumnRenamed("region", "node"))


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands by their first digit."""
    return nodes(spark, sf_dir).withColumn("comm", F.substring("node", 7, 1).cast("int"))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, parent_id, region, acronym: a root, regions, nations, suppliers."""
    r = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1).alias("id"), F.lit(0).cast("long").alias("parent_id"), F.col("r_name").alias("region"))
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).alias("id"), (F.col("n_regionkey") + 1).alias("parent_id"), F.col("n_name").alias("region"))
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1000).alias("id"), (F.col("s_nationkey") + 100).alias("parent_id"), F.col("s_name").alias("region"))
    root = spark.sql("SELECT CAST(0 AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent_id, 'root' AS region")
    t = root.unionByName(r.select(F.col("id").cast("long"), "parent_id", "region")).unionByName(n.select(F.col("id").cast("long"), F.col("parent_id").cast("long"), "region")).unionByName(s.select(F.col("id").cast("long"), F.col("parent_id").cast("long"), "region"))
    return t.withColumn("acronym", F.regexp_replace("region", "[-# ]", "."))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """net (return flag), sample (line status), id (supplier), value (quantity)."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_returnflag").alias("net"), F.col("l_linestatus").alias("sample"), (F.col("l_suppkey") + 1000).cast("long").alias("id")).agg(F.sum("l_quantity").alias("value"))


def partitions(spark: SparkSession, sf_dir: str, n: int = 6) -> DataFrame:
    """net, part, node, comm: fixed labelings of the brands, communities of changing size."""
    names = table(spark, sf_dir, "part").select(F.col("p_brand").alias("node")).distinct()
    number = F.regexp_extract("node", r"(\d+)$", 1).cast("long")
    return names.crossJoin(spark.range(1, n + 1).withColumnRenamed("id", "part")).select(F.lit("brands").alias("net"), "part", "node", F.pmod(number * F.col("part") + F.col("part") * F.col("part"), F.lit(2) + F.pmod("part", F.lit(3))).cast("int").alias("comm"))
