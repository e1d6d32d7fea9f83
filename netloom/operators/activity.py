"""Comparisons of activity between groups, and of activity with connectivity."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions.dist import chi2_upper, f_upper, t_quantile, t_two_sided
from netloom.functions.exprs import adjusted
from netloom.operators.network import corr_edges
from netloom.operators.prep import level_profile


def moments(values: DataFrame, keys: Sequence[str], arm: str) -> DataFrame:
    """keys, arm, n, mean, var of a column `value`."""
    return values.groupBy(*keys, F.col(arm).alias("arm")).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("var"))


def arm_pairs(m: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two arms of moments side by side, each unordered pair once: keys, a, b, n_a, .. var_b."""
    side = lambda s: m.select(*keys, F.col("arm").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("n", "mean", "var")))
    if keys:
        return side("a").join(side("b"), list(keys)).filter("a < b")
    return side("a").join(side("b"), F.col("a") < F.col("b"))


def welch(values: DataFrame, keys: Sequence[str], arm: str) -> DataFrame:
    """keys, a, b, t, df of each pair of arms."""
    p = arm_pairs(moments(values, keys, arm), keys)
    ea, eb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    df = F.pow(ea + eb, F.lit(2.0)) / F.nullif(F.pow(ea, F.lit(2.0)) / F.nullif(F.col("n_a") - 1, F.lit(0)) + F.pow(eb, F.lit(2.0)) / F.nullif(F.col("n_b") - 1, F.lit(0)), F.lit(0.0))
    return p.select(*keys, "a", "b", ((F.col("mean_a") - F.col("mean_b")) / F.nullif(F.sqrt(ea + eb), F.lit(0.0))).alias("t"), df.alias("df"), (F.col("mean_a") - F.col("mean_b")).alias("diff"))


def welch_test(values: DataFrame, keys: Sequence[str], arm: str, confidence: float = 0.95) -> DataFrame:
    """welch with p, lower and upper."""
    w = welch(values, keys, arm)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            t, df = f["t"].to_numpy(float), f["df"].to_numpy(float)
            f["p"] = t_two_sided(t, df)
            with np.errstate(all="ignore"):
                half = np.where(t != 0, np.abs(f["diff"].to_numpy(float) / t), np.nan) * t_quantile((1 + confidence) / 2, df)
            f["lower"], f["upper"] = f["diff"] - half, f["diff"] + half
            yield f.astype({c: object for c in ("p", "lower", "upper")}).where(f.notna(), None)

    return w.mapInPandas(run, ", ".join(f"{n} {t}" for n, t in w.dtypes) + ", p double, lower double, upper double")


def cohens_d(values: DataFrame, keys: Sequence[str], arm: str) -> DataFrame:
    """keys, a, b, d of each unordered pair of arms, by the pooled standard deviation."""
    p = arm_pairs(moments(values, keys, arm), keys)
    pooled = F.sqrt(((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b")) / F.nullif(F.col("n_a") + F.col("n_b") - 2, F.lit(0)))
    return p.select(*keys, "a", "b", ((F.col("mean_a") - F.col("mean_b")) / F.nullif(pooled, F.lit(0.0))).alias("d"))


def cohens_d_one_sample(values: DataFrame, keys: Sequence[str], h0: float = 0.0) -> DataFrame:
    """keys, d: |h0 - mean| / sd."""
    return values.groupBy(*keys).agg((F.abs(F.lit(h0) - F.avg("value")) / F.nullif(F.stddev_samp("value"), F.lit(0.0))).alias("d"))


def regression(points: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """keys, n, beta, intercept, std_error, t, r2, f, deviance, null_deviance of y on x by least squares."""
    m = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_samp(x).alias("vx"), F.var_samp(y).alias("vy"), F.covar_samp(x, y).alias("cxy")
    )
    beta = F.col("cxy") / F.nullif("vx", F.lit(0.0))
    m = m.withColumn("beta", beta).withColumn("null_deviance", F.col("vy") * (F.col("n") - 1))
    m = m.withColumn("deviance", F.greatest(F.lit(0.0), F.col("null_deviance") - F.col("beta") * F.col("cxy") * (F.col("n") - 1)))
    m = m.withColumn("std_error", F.sqrt(F.col("deviance") / F.nullif(F.col("n") - 2, F.lit(0)) / F.nullif(F.col("vx") * (F.col("n") - 1), F.lit(0.0))))
    t = F.col("beta") / F.nullif("std_error", F.lit(0.0))
    return m.select(*keys, "n", "beta", (F.col("my") - F.col("beta") * F.col("mx")).alias("intercept"), "std_error", t.alias("t"), (1 - F.col("deviance") / F.nullif("null_deviance", F.lit(0.0))).alias("r2"), (t * t).alias("f"), "deviance", "null_deviance")


def regression_test(points: DataFrame, keys: Sequence[str], x: str, y: str, model: str = "lm") -> DataFrame:
    """regression with p, lower, upper, and for lm the model's p by F; for glm (Gaussian) the deviance test's p,
    Nagelkerke's pseudo R squared and the likelihood ratio with its p."""
    r = regression(points, keys, x, y)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            b, se, t, n, fv, dev, null = (f[c].to_numpy(float) for c in ("beta", "std_error", "t", "n", "f", "deviance", "null_deviance"))
            ok = (n > 2) & np.isfinite(t)
            df = np.where(ok, n - 2, np.nan)
            half = se * t_quantile(0.975, df)
            new = {"p": t_two_sided(t, df), "lower": b - half, "upper": b + half}
            with np.errstate(all="ignore"):
                if model == "lm":
                    new |= {"model_p": f_upper(fv, 1, df), "pseudo_r2": np.full(len(f), np.nan), "ratio_p": np.full(len(f), np.nan)}
                else:
                    # Likelihoods of Gaussian models; deviances over the dispersion are chi-squared.
                    ratio = n * np.log(null / dev)
                    top, most = 1 - np.exp(-ratio / n), 1 - np.exp(-np.log(2 * np.pi * null / n) - 1)
                    new |= {"model_p": chi2_upper((null - dev) / (dev / df), 1), "pseudo_r2": np.where(most > 0, top / most, np.nan), "ratio_p": chi2_upper(ratio, 1)}
            for c, v in new.items():
                f[c] = pd.Series(np.where(ok, v, np.nan), index=f.index).astype(object).where(ok & ~np.isnan(v), None)
            yield f

    return r.mapInPandas(run, ", ".join(f"{n} {t}" for n, t in r.dtypes) + ", p double, lower double, upper double, model_p double, pseudo_r2 double, ratio_p double")


def resample_weights(samples: DataFrame, resamples: int, by: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """rep, by, sample, times: bootstrap draws with replacement from an md5 of (seed, rep, draw), equal in any engine.

    Each row draws a place; the share of rows of one sample is its weight. Rep 0 is the sample itself."""
    from pyspark.sql import Window as W

    spark = samples.sparkSession
    w = W.partitionBy(*by)
    placed = samples.select(*by, "sample").distinct().select("*", (F.row_number().over(w.orderBy("sample")) - 1).cast("long").alias("place"), F.count(F.lit(1)).over(w).alias("total"))
    reps = spark.range(resamples + 1).withColumnRenamed("id", "rep")
    text = F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), *by, F.col("sample").cast("string"))
    draw = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long") % F.col("total")
    drawn = placed.crossJoin(reps).select("rep", *by, F.when(F.col("rep") == 0, F.col("place")).otherwise(draw).alias("place"))
    return drawn.groupBy("rep", *by, "place").agg(F.count(F.lit(1)).alias("times")).join(placed, [*by, "place"]).select("rep", *by, "sample", "times")


def boot_welch(values: DataFrame, keys: Sequence[str], arm: str, resamples: int = 1000, seed: int = 0) -> DataFrame:
    """rep, keys, a, b, t: Welch's t of each bootstrap; draws are stratified by arm, so designs stay balanced.

    values: sample, keys, arm, value. Weighted moments replace repeated rows."""
    weights = resample_weights(values.select("sample", F.col(arm).alias("_arm")), resamples, ["_arm"], seed)
    v = values.withColumnRenamed(arm, "_arm").join(weights, ["_arm", "sample"])
    m = v.groupBy("rep", *keys, F.col("_arm").alias("arm")).agg(F.sum("times").alias("n"), F.sum(F.col("times") * F.col("value")).alias("s"), F.sum(F.col("times") * F.col("value") * F.col("value")).alias("q"))
    m = m.select("rep", *keys, "arm", "n", (F.col("s") / F.col("n")).alias("mean"), ((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / F.nullif(F.col("n") - 1, F.lit(0))).alias("var"))
    p = arm_pairs(m, ["rep", *keys])
    return p.select("rep", *keys, "a", "b", ((F.col("mean_a") - F.col("mean_b")) / F.nullif(F.sqrt(F.col("var_a") / F.col("n_a") + F.col("var_b") / F.col("n_b")), F.lit(0.0))).alias("t"))


def boot_summary(replicates: DataFrame, keys: Sequence[str], value: str, fixed: float | None = None, confidence: float = 0.95) -> DataFrame:
    """keys, stat, std_error, p, lower, upper from replicates (rep 0 is the data): p is the share of |replicates| over
    |stat| (or a fixed value), the interval is the basic one."""
    stat = replicates.filter("rep = 0").select(*keys, F.col(value).alias("stat"))
    many = replicates.filter("rep > 0").join(stat, list(keys))
    limit = F.abs("stat") if fixed is None else F.lit(abs(fixed))
    tail = (1 - confidence) / 2
    out = many.groupBy(*keys, "stat").agg(F.stddev_samp(value).alias("std_error"), F.avg((F.abs(value) > limit).cast("double")).alias("p"), F.expr(f"percentile({value}, {1 - tail})").alias("high"), F.expr(f"percentile({value}, {tail})").alias("low"))
    return out.select(*keys, "stat", "std_error", "p", (2 * F.col("stat") - F.col("high")).alias("lower"), (2 * F.col("stat") - F.col("low")).alias("upper"))


def boot_regression(points: DataFrame, keys: Sequence[str], x: str, y: str, resamples: int = 10_000, seed: int = 0) -> DataFrame:
    """rep, keys, beta of bootstraps over the rows of each key. points: sample, keys, x, y."""
    weights = resample_weights(points.select("sample", *keys), resamples, keys, seed)
    w = points.join(weights, [*keys, "sample"])
    t, a, b = F.col("times"), F.col(x), F.col(y)
    m = w.groupBy("rep", *keys).agg(F.sum(t).alias("n"), F.sum(t * a).alias("sx"), F.sum(t * b).alias("sy"), F.sum(t * a * a).alias("sxx"), F.sum(t * a * b).alias("sxy"))
    return m.select("rep", *keys, ((F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.nullif(F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"), F.lit(0.0))).alias("beta"))


def bootstrap(values: DataFrame, keys: Sequence[str], statistic: Callable[[DataFrame], DataFrame], strata: Sequence[str] = (), resamples: int = 1000, seed: int = 0, confidence: float = 0.95) -> DataFrame:
    """boot_summary of any statistic: a function from rows (rep, keys, the columns of values, times) to (rep, keys,
    stat), where times is how often the row was drawn. values: sample, keys, strata and what the statistic reads."""
    weights = resample_weights(values.select("sample", *strata), resamples, list(strata), seed)
    drawn = values.join(weights, [*strata, "sample"])
    return boot_summary(statistic(drawn).withColumnRenamed("stat", "_value"), keys, "_value", confidence=confidence)


def factor_comparison(activity: DataFrame, factor: str, isolated: Sequence[str] = (), boot: bool = False, resamples: int = 1000, seed: int = 0, fdr: bool = False) -> DataFrame:
    """net, region, a, b, t, (std_error,) p, lower, upper, (adj_p): the levels of `factor` compared in each region, apart
    for each combination of the isolated factors. activity: sample, region, value and the factors; Welch's test, or the
    bootstrap of its t; fdr adjusts p within a net."""
    values = activity.withColumn("net", F.concat_ws(".", *isolated) if isolated else F.lit(factor))
    keys = ["net", "region"]
    if boot:
        out = boot_summary(boot_welch(values, keys, factor, resamples, seed), [*keys, "a", "b"], "t").withColumnRenamed("stat", "t")
    else:
        out = welch_test(values, keys, factor).select(*keys, "a", "b", "t", "p", "lower", "upper")
    return adjusted(out, "p", "bh", ["net"], "adj_p") if fdr else out


def activity_connectivity(activity: DataFrame, model: str = "lm", boot: bool = False, resamples: int = 10_000, seed: int = 0) -> DataFrame:
    """net, predictor and the regression of mean r squared on mean_signal and on coef_var, a row for each: by
    `regression_test`, or the bootstrap of the slope. activity: net, sample, region, value; nets are levels of factors."""
    profile = level_profile(activity, corr_edges(activity))
    pair = F.explode(F.array(*(F.struct(F.lit(c).alias("predictor"), F.col(c).alias("x")) for c in ("mean_signal", "coef_var"))))
    points = profile.select("net", F.col("region").alias("sample"), F.col("mean_r2").alias("y"), pair.alias("v")).select("net", "sample", "y", "v.predictor", "v.x")
    keys = ["net", "predictor"]
    if boot:
        return boot_summary(boot_regression(points.filter("x IS NOT NULL"), keys, "x", "y", resamples, seed), keys, "beta").withColumnRenamed("stat", "beta")
    return regression_test(points, keys, "x", "y", model)
