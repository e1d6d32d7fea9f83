"""Result tables: significance, direction, hubs. comparisons: contrast, node, metric, diff, p_value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_higher_group(comparisons: DataFrame) -> DataFrame:
    """The side of the contrast with the larger value: the first if the difference is over 0, else the second."""
    sides = F.split("contrast", " ~ ")
    return comparisons.withColumn("higher_group", F.when(F.col("diff") > 0, sides[0]).otherwise(sides[1]))


def significant(comparisons: DataFrame, alpha: float = 0.05, trim: bool = False, pattern: str | None = None) -> DataFrame:
    """With higher_group and significant (0 or 1); trim keeps significant rows only, pattern rows by contrast."""
    out = comparisons if pattern is None else comparisons.filter(F.col("contrast").rlike(pattern))
    out = with_higher_group(out).withColumn("significant", (F.col("p_value") <= alpha).cast("int"))
    return out.filter("significant = 1") if trim else out


def hubs(significant_rows: DataFrame) -> DataFrame:
    """node, metric, group, won, lost, score: significant comparisons of a group, by exact side of the contrast."""
    sides = F.split("contrast", " ~ ")
    each = significant_rows.select("node", "metric", "higher_group", "significant", F.explode(sides).alias("group"))
    won = F.when((F.col("significant") == 1) & (F.col("group") == F.col("higher_group")), 1).otherwise(0)
    lost = F.when((F.col("significant") == 1) & (F.col("group") != F.col("higher_group")), 1).otherwise(0)
    return each.groupBy("node", "metric", "group").agg(F.sum(won).alias("won"), F.sum(lost).alias("lost"), F.sum(won - lost).alias("score"))


def edge_effect(comparisons: DataFrame, cut: float = 0.05) -> DataFrame:
    """contrast, node, effect: 1 where the first side is at least the second, else -1; 0 where p is over the cut."""
    sign = F.when(F.col("diff") >= 0, 1).otherwise(-1)
    return comparisons.select("contrast", "node", F.when(F.col("p_value") > cut, 0).otherwise(sign).alias("effect"))
