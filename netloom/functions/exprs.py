"""Column expressions used by several operators. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ratio_or_zero(a: Column, b: Column) -> Column:
    """a / b, 0 where a is 0, null where only b is 0."""
    return F.when(a == 0, F.lit(0.0)).otherwise(a / F.nullif(b, F.lit(0)))


def fisher_z(r: Column) -> Column:
    return F.atanh(r)


def average_rank(value: Column, by: Sequence[str]) -> Column:
    """Ranks with ties at their mean, within `by`."""
    return F.rank().over(W.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(W.partitionBy(*by, value)) - 1) / F.lit(2.0)


def z_score(value: Column, by: Sequence[str]) -> Column:
    """(x - mean) / sd within `by`; null for a single row or no variance."""
    w = W.partitionBy(*by)
    return (value - F.avg(value).over(w)) / F.nullif(F.stddev_samp(value).over(w), F.lit(0.0))


def adjusted(df: DataFrame, p: str, method: str, by: Sequence[str] = (), out: str = "p_adjusted") -> DataFrame:
    """df with the adjusted p-values (none, bonferroni, holm, bh) within `by` in a new column. Nulls do not count.

    Rows of a group with equal p-values have one adjusted value, so that is found for distinct p-values with their counts.
    Ranges of them have running sums and extremes of their own, to which one row a range brings those of the others."""
    if method == "none":
        return df.withColumn(out, F.col(p))
    if method not in ("bonferroni", "holm", "bh"):
        raise ValueError(f"unknown method {method!r}")
    from netloom.operators.network import checkpointed

    # Adjusted values are joined by p-value, and p-values computed again may differ in their last bits. Structs of nulls are equal.
    rows = checkpointed(df).withColumn("_g", F.struct(F.lit(0), *by)).withColumn("_p", F.col(p))
    steps = rows.filter("_p IS NOT NULL").groupBy("_g", "_p").agg(F.count(F.lit(1)).alias("_n"))
    if method == "bonferroni":
        steps = rows.groupBy("_g").agg(F.count("_p").alias("_m"))
        return rows.join(steps, "_g").withColumn(out, F.when(F.col("_p").isNotNull(), F.least(F.lit(1.0), F.col("_p") * F.col("_m")))).drop("_g", "_p", "_m")
    steps = checkpointed(steps.repartitionByRange("_g", "_p").withColumn("_range", F.spark_partition_id()))
    group, here = W.partitionBy("_g"), W.partitionBy("_g", "_range")
    sums = steps.groupBy("_g", "_range").agg(F.sum("_n").alias("_own"))
    sums = sums.select("_g", "_range", F.sum("_own").over(group).alias("_m"), (F.sum("_own").over(group.orderBy("_range")) - F.col("_own")).alias("_before"))
    # _k is the rank of a step's last row, which is its least value of bh; holm has its largest at the first.
    ranked = steps.join(sums, ["_g", "_range"]).withColumn("_k", F.col("_before") + F.sum("_n").over(here.orderBy("_p")))
    if method == "holm":
        most, order, both, value = F.max, F.asc, F.greatest, F.col("_p") * (F.col("_m") - F.col("_k") + F.col("_n"))
    else:
        most, order, both, value = F.min, F.desc, F.least, F.col("_p") * F.col("_m") / F.col("_k")
    valued = ranked.select("_g", "_range", "_p", value.alias("_v"))
    past = valued.groupBy("_g", "_range").agg(most("_v").alias("_e"))
    past = past.select("_g", "_range", most("_e").over(group.orderBy(order("_range")).rowsBetween(W.unboundedPreceding, -1)).alias("_e"))
    found = valued.join(past, ["_g", "_range"]).select("_g", "_p", both("_e", most("_v").over(here.orderBy(order("_p")))).alias("_v"))
    return rows.join(found, ["_g", "_p"], "left").withColumn(out, F.when(F.col("_p").isNotNull(), F.least(F.lit(1.0), F.col("_v")))).drop("_g", "_p", "_v")
