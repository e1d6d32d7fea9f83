"""Activity tables before networks are built: missing values, empty regions, collapsing, scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.functions.exprs import z_score


def clean(activity: DataFrame, real_zeros: bool = True, missing_below: float = 0.5, fill: bool = True) -> DataFrame:
    """Regions whose share of missing values is below the limit, missing values filled with the region's mean.

    With real_zeros=False zeros count as missing."""
    value = F.col("value") if real_zeros else F.nullif("value", F.lit(0.0))
    by = W.partitionBy("net", "region")
    kept = activity.withColumn("value", value).withColumn("_gone", F.avg(F.col("value").isNull().cast("double")).over(by)).filter(F.col("_gone") < missing_below).drop("_gone")
    return kept.withColumn("value", F.coalesce("value", F.avg("value").over(by))) if fill else kept


def drop_zero_regions(activity: DataFrame, by: Sequence[str] = ("net", "region")) -> DataFrame:
    """Without the regions whose values sum to zero or less."""
    return activity.join(activity.groupBy(*by).agg(F.sum("value").alias("_s")).filter("_s > 0").select(*by), list(by), "left_semi")


def fill_absent(cells: DataFrame, samples: DataFrame, regions: DataFrame, keys: Sequence[str] = ("net", "sample")) -> DataFrame:
    """One row for each sample and region; absent cells are 0, cells of unknown regions are dropped."""
    grid = samples.select(*keys).distinct().crossJoin(regions.select("region").distinct())
    return grid.join(cells, [*keys, "region"], "left").select(*keys, "region", F.coalesce("value", F.lit(0.0)).alias("value"))


def collapse(activity: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Means over the factors that are not among keys, as of both hemispheres."""
    return activity.groupBy(*keys, "region").agg(F.avg("value").alias("value"))


def z_by_level(activity: DataFrame, levels: Sequence[str]) -> DataFrame:
    """z-scores of each region within each level of the factors' interaction."""
    return activity.withColumn("z", z_score(F.col("value"), [*levels, "region"]))


def scale_by_factor(activity: DataFrame, factor: str, whole: bool = True) -> DataFrame:
    """z-scores within the levels of a factor, over all regions together or (whole=False) by region."""
    return activity.withColumn("z", z_score(F.col("value"), [factor] if whole else [factor, "region"]))


def interaction(*factors: str) -> Column:
    """The level name of several factors."""
    return F.concat_ws(".", *factors)


def level_order(samples: DataFrame, factors: Sequence[str]) -> DataFrame:
    """level, level_idx of the factors' interaction; the first factor varies fastest."""
    levels = samples.select(*factors).distinct()
    return levels.select(interaction(*factors).alias("level"), F.row_number().over(W.orderBy(*reversed(factors))).alias("level_idx"))


def level_profile(activity: DataFrame, edges: DataFrame) -> DataFrame:
    """net, region, mean_r2 (over all regions, itself with 1), mean_signal, coef_var. Regions without a defined
    correlation, or with nothing but perfect ones, are left out."""
    both = edges.select("net", F.col("src").alias("region"), "r").unionByName(edges.select("net", F.col("dst").alias("region"), "r"))
    r2 = both.groupBy("net", "region").agg(((F.sum(F.col("r") * F.col("r")) + 1) / (F.count(F.lit(1)) + 1)).alias("mean_r2"), F.count_if(F.col("r").isNull()).alias("undefined"))
    signal = activity.groupBy("net", "region").agg(F.avg("value").alias("mean_signal"), (F.stddev_samp("value") / F.nullif(F.avg("value"), F.lit(0.0))).alias("coef_var"))
    return r2.filter("undefined = 0 AND mean_r2 < 1").join(signal, ["net", "region"]).select("net", "region", "mean_r2", "mean_signal", "coef_var")
