"""Correlation networks: all nets of an activity table in one job.

Pairs are made by a self join on (net, sample), the partitioning that both sides share, and reduced to moments in each
map task. For many regions or samples `gram_edges` multiplies tiles of them instead and adds up the moments.

A correlation means the same on every path: over the samples in which both regions have a value, repeated cells once with
their mean, null where a side does not vary; pairs without such a sample have no row.
"""

from __future__ import annotations

import hashlib
import math
import tempfile
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.functions.dist import critical_r, t_two_sided
from netloom.functions.exprs import adjusted, average_rank, fisher_z


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r; null where a side does not vary (the built-in corr raises an error there in ANSI mode)."""
    return F.covar_samp(x, y) / F.nullif(F.stddev_samp(x) * F.stddev_samp(y), F.lit(0.0))


def averaged(activity: DataFrame, keys: Sequence[str] = ("net",)) -> DataFrame:
    """keys, sample, region, value: a cell that occurs more than once has the mean of its values; null and NaN are no
    values. Partitioned by (keys, sample), as the pairs of a sample's regions need it."""
    on = [*keys, "sample"]
    value = F.nanvl(F.col("value").cast("double"), F.lit(None).cast("double"))
    return activity.select(*on, "region", value.alias("value")).repartition(*on).groupBy(*on, "region").agg(F.avg("value").alias("value"))


def _pairs(cells: DataFrame, on: Sequence[str], *columns: str) -> DataFrame:
    """on, src, dst and the columns of both regions (x_ and y_) where both have a value."""
    side = lambda name, mark: cells.select(*on, F.col("region").alias(name), F.col("value").alias(mark), *(F.col(c).alias(f"{mark}_{c}") for c in columns))
    return side("src", "x").join(side("dst", "y"), list(on)).filter("src < dst AND x IS NOT NULL AND y IS NOT NULL")


def corr_edges(activity: DataFrame, method: str = "pearson", keys: Sequence[str] = ("net",)) -> DataFrame:
    """keys, src, dst, r, n of every pair of regions (src < dst) with a sample in which both have a value.

    r and n are those of these samples; where a side does not vary in them, r is null. Repeated cells count once, with
    their mean. Ranks (spearman) are of the same samples."""
    on, by = [*keys, "sample"], [*keys, "src", "dst"]
    cells = averaged(activity, keys)
    x, y = F.col("x"), F.col("y")
    if method == "pearson":
        return _pairs(cells, on).groupBy(*by).agg(correlation(x, y).alias("r"), F.count(F.lit(1)).alias("n"))
    if method != "spearman":
        raise ValueError(f"unknown method {method!r}")
    # Two regions with values in all samples of the net have their own ranks in every pair; others are ranked by pair.
    samples = cells.select(*on).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"))
    here = cells.filter("value IS NOT NULL").withColumn("rank", average_rank(F.col("value"), [*keys, "region"])).withColumn("own", F.count(F.lit(1)).over(W.partitionBy(*keys, "region")))
    here = here.join(samples, list(keys)).withColumn("whole", F.col("own") == F.col("samples")).drop("own", "samples")
    pairs = _pairs(here, on, "rank", "whole")
    whole = F.col("x_whole") & F.col("y_whole")
    plain = pairs.filter(whole).select(*by, F.col("x_rank").alias("x"), F.col("y_rank").alias("y"))
    ranked = pairs.filter(~whole).select(*by, average_rank(x, by).alias("x"), average_rank(y, by).alias("y"))
    return plain.unionByName(ranked).groupBy(*by).agg(correlation(x, y).alias("r"), F.count(F.lit(1)).alias("n"))


#: Regions and samples of a tile of `gram_edges`.
TILE_REGIONS, TILE_SAMPLES = 512, 4096


def moments(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """n, sum x, sum y, sum xx, sum yy, sum xy of each column of x with each of y, over the rows where both have values."""
    here, there = ~np.isnan(x), ~np.isnan(y)
    x, y, p, q = np.where(here, x, 0.0), np.where(there, y, 0.0), here.astype(float), there.astype(float)
    return p.T @ q, x.T @ q, p.T @ y, (x * x).T @ q, p.T @ (y * y), x.T @ y


def gram_edges(activity: DataFrame, tile_regions: int = TILE_REGIONS, tile_samples: int = TILE_SAMPLES) -> DataFrame:
    """The same as corr_edges by products of tiles: blocks of samples times two blocks of regions, a task each.

    A cell moves once for each block of regions, instead of into a row for each other region; tiles give the moments of
    their pairs, which add up over the blocks of samples. Values are taken from their region's mean first, so sums lose
    nothing; a variance within 1e-12 of a region's sum of squares is none."""
    region = W.partitionBy("net", "region")
    cells = averaged(activity).filter("value IS NOT NULL")
    centred = F.when(F.max("value").over(region) == F.min("value").over(region), F.lit(0.0)).otherwise(F.col("value") - F.avg("value").over(region))
    sizes = cells.groupBy("net").agg(F.countDistinct("region").alias("regions"), F.countDistinct("sample").alias("samples"))
    tiles = sizes.select("net", F.ceil(F.col("regions") / tile_regions).alias("tiles"), F.ceil(F.col("samples") / tile_samples).alias("blocks"))
    own = cells.withColumn("value", centred).join(tiles, "net").withColumn("tile", F.pmod(F.xxhash64("region"), "tiles"))
    copies = own.select("net", "sample", "region", "value", "tile", F.pmod(F.xxhash64("sample"), "blocks").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other"))
    copies = copies.select("net", "block", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", F.col("sample").cast("string").alias("sample"), "region", "value")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at, names = pd.factorize(pdf["sample"])
        sides = []
        for tile in (pdf["low"].iloc[0], pdf["high"].iloc[0]):
            mine = (pdf["tile"] == tile).to_numpy()
            column, regions = pd.factorize(pdf["region"][mine], sort=True)
            x = np.full((len(names), len(regions)), np.nan)
            x[at[mine], column] = pdf["value"].to_numpy()[mine]
            sides.append((regions.to_numpy(str), x))
        (left, x), (right, y) = sides
        sums = moments(x, y)
        i, j = np.nonzero((left[:, None] < right[None, :]) if pdf["low"].iloc[0] == pdf["high"].iloc[0] else np.ones((len(left), len(right)), bool))
        i, j = i[sums[0][i, j] > 0], j[sums[0][i, j] > 0]
        turn = left[i] > right[j]
        x_sum, y_sum, xx, yy = (m[i, j] for m in sums[1:5])
        pick = lambda a, b: np.where(turn, b, a)
        return pd.DataFrame({"net": pdf["net"].iloc[0], "src": pick(left[i], right[j]), "dst": pick(right[j], left[i]), "n": sums[0][i, j], "x": pick(x_sum, y_sum), "y": pick(y_sum, x_sum), "xx": pick(xx, yy), "yy": pick(yy, xx), "xy": sums[5][i, j]})

    parts = copies.groupBy("net", "block", "low", "high").applyInPandas(run, "net string, src string, dst string, " + ", ".join(f"{c} double" for c in ("n", "x", "y", "xx", "yy", "xy")))
    total = parts.groupBy("net", "src", "dst").agg(*(F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")))
    spread = lambda s, q: F.when(F.col(q) - F.col(s) * F.col(s) / F.col("n") > F.lit(1e-12) * F.col(q), F.col(q) - F.col(s) * F.col(s) / F.col("n"))
    r = (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / F.sqrt(spread("x", "xx") * spread("y", "yy"))
    return total.select("net", "src", "dst", r.alias("r"), F.col("n").cast("long").alias("n"))


def with_p(edges: DataFrame) -> DataFrame:
    """edges with the two-sided p-value of each r, by the t distribution with n - 2 degrees of freedom."""

    @F.pandas_udf("double")
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        x, df = r.to_numpy(float), n.to_numpy(float) - 2
        inside = (np.abs(x) < 1) & (df > 0)
        safe = np.where(inside, x, 0.0)
        out = t_two_sided(safe * np.sqrt(np.where(inside, df, 1.0) / (1 - safe * safe)), df)
        return pd.Series(np.where(inside, out, np.where((np.abs(x) >= 1) & (df > 0) & np.isfinite(x), 0.0, np.nan)))

    return edges.withColumn("p", p("r", "n")).withColumn("p", F.nanvl("p", F.lit(None).cast("double")))


def fill_undefined(edges: DataFrame, weak_link: int | None = None) -> DataFrame:
    """Undefined correlations become 0, or 10**-weak_link; undefined p-values 1; infinite correlations 1."""
    other = 0.0 if weak_link is None else 10.0**-weak_link
    r = F.when(F.col("r").isNull() | F.isnan("r"), F.lit(other)).when(F.abs("r") == float("inf"), F.lit(1.0)).otherwise(F.col("r"))
    out = edges.withColumn("r", r)
    return out.withColumn("p", F.coalesce(F.nanvl("p", F.lit(None).cast("double")), F.lit(1.0))) if "p" in edges.columns else out


def negatives(edges: DataFrame, policy: str, column: str = "r") -> DataFrame:
    """keep, zero or abs."""
    r = F.col(column)
    return edges.withColumn(column, {"keep": r, "zero": F.greatest(r, F.lit(0.0)), "abs": F.abs(r)}[policy])


def threshold(edges: DataFrame, kind: str, cuts: Sequence[float]) -> DataFrame:
    """edges for each cut (a column `cut`), r set to 0 where it does not pass.

    r: |r| above the cut. p: p-value under the cut; without a column `p`, |r| above the critical value of n samples.
    cost: the cut is the share of the largest |r| that stays."""
    many = edges.crossJoin(F.broadcast(edges.sparkSession.createDataFrame([(float(c),) for c in cuts], "cut double")))
    if kind == "r":
        passes = F.abs("r") > F.col("cut")
    elif kind == "p" and "p" in edges.columns:
        passes = F.col("p") < F.col("cut")
    elif kind == "p":
        sizes = [r["n"] for r in edges.select("n").distinct().collect()]
        limits = [zip(sizes, [float(c)] * len(sizes), critical_r(np.array(sizes, float), c).tolist(), strict=True) for c in cuts]
        table = edges.sparkSession.createDataFrame([x for each in limits for x in each], "n long, cut double, limit double")
        many = many.join(F.broadcast(table), ["n", "cut"])
        passes = F.abs("r") > F.col("limit")
    elif kind == "cost":
        each = [F.struct(F.lit(float(c)).alias("cut"), F.expr(f"percentile(abs(r), {1 - float(c)!r}D)").alias("limit")) for c in cuts]
        limits = edges.groupBy("net").agg(F.array(*each).alias("all")).select("net", F.explode("all").alias("x")).select("net", "x.cut", "x.limit")
        many = many.join(limits, ["net", "cut"])
        passes = F.abs("r") >= F.col("limit")
    else:
        raise ValueError(f"unknown kind {kind!r}")
    return many.withColumn("r", F.when(passes, F.col("r")).otherwise(F.lit(0.0))).drop("limit")


def normalize(edges: DataFrame, how: str) -> DataFrame:
    """fisherz; max_norm over a unit diagonal (the identity unless r is over 1), or max_edge_norm over the edges;
    max_min_norm to 0..1 over the edges of a net."""
    net, r = W.partitionBy("net"), F.col("r")
    if how == "fisherz":
        return edges.withColumn("r", fisher_z(r))
    if how == "max_norm":
        return edges.withColumn("r", r / F.greatest(F.lit(1.0), F.max(r).over(net)))
    if how == "max_edge_norm":
        return edges.withColumn("r", r / F.nullif(F.max(r).over(net), F.lit(0.0)))
    if how == "max_min_norm":
        return edges.withColumn("r", (r - F.min(r).over(net)) / F.nullif(F.max(r).over(net) - F.min(r).over(net), F.lit(0.0)))
    raise ValueError(f"unknown normalization {how!r}")


#: Bootstraps that one task makes of a network it has read.
REPS_A_TASK = 50


def boot_ratio(activity: DataFrame, resamples: int = 1000, seed: int = 87) -> DataFrame:
    """net, src, dst, ratio: Fisher z of the correlation over the sd of its bootstrap; undefined ratios are 0.

    Samples are drawn with replacement by md5(seed : rep : net : sample), so any engine draws the same. A net's cells go
    once to each block of REPS_A_TASK replicates; sums over the blocks give the sd."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        net, block = pdf["net"].iloc[0], int(pdf["block"].iloc[0])
        wide = pdf.pivot_table(index="sample", columns="region", values="value", aggfunc="first").sort_index().sort_index(axis=1)
        x, names, samples = wide.to_numpy(float), wide.columns.to_numpy(), wide.index.tolist()
        i, j = np.triu_indices(x.shape[1], 1)

        def z(rows: np.ndarray) -> np.ndarray:
            with np.errstate(all="ignore"):
                v = np.arctanh(np.clip(np.corrcoef(rows, rowvar=False)[i, j], -1, 1))
            return np.where(np.isinf(v), np.sign(v) * 4, v)

        n = np.zeros(len(i))
        s, q = n.copy(), n.copy()
        for rep in range(block * REPS_A_TASK + 1, min((block + 1) * REPS_A_TASK, resamples) + 1):
            drawn = [int(hashlib.md5(f"{seed}:{rep}:{net}:{name}".encode()).hexdigest()[:12], 16) % len(x) for name in samples]
            v = z(x[drawn])
            good = np.isfinite(v)
            v = np.where(good, v, 0)
            n, s, q = n + good, s + v, q + v * v
        real = z(x) if block == 0 else np.full(len(i), np.nan)
        return pd.DataFrame({"net": net, "src": names[i], "dst": names[j], "n": n, "s": s, "q": q, "z": real})

    blocks = activity.sparkSession.range(max(1, math.ceil(resamples / REPS_A_TASK))).withColumnRenamed("id", "block")
    parts = activity.select("net", "sample", "region", "value").crossJoin(F.broadcast(blocks)).groupBy("net", "block").applyInPandas(run, "net string, src string, dst string, n double, s double, q double, z double")
    total = parts.groupBy("net", "src", "dst").agg(*(F.sum(c).alias(c) for c in "nsq"), F.max(F.nanvl("z", F.lit(None).cast("double"))).alias("z"))
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("q") - F.col("s") * F.col("s") / F.nullif("n", F.lit(0.0))) / F.nullif(F.col("n") - 1, F.lit(0.0)))
    return total.select("net", "src", "dst", F.coalesce(F.col("z") / F.nullif(sd, F.lit(0.0)), F.lit(0.0)).alias("ratio"))


def graph(edges: DataFrame, column: str = "r") -> DataFrame:
    """net, src, dst, weight of the edges that are not zero."""
    return edges.filter((F.col(column) != 0) & F.col(column).isNotNull()).select("net", "src", "dst", F.col(column).alias("weight"))


def vertices(activity: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """net, node, counts (mean value), with the attributes of regions joined by name. Isolated nodes are kept."""
    out = activity.groupBy("net", F.col("region").alias("node")).agg(F.avg("value").alias("counts"))
    return out if regions is None else out.join(regions.withColumnRenamed("region", "node"), "node", "left")


def build_networks(activity: DataFrame, factors: Sequence[str] | None = None, method: str = "pearson", weak_link: int | None = None, negs: str = "keep", kind: str | None = None, cuts: Sequence[float] = (0.0,), how: str | None = None, p_adjust: str = "none", regions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, vertices) of a net for each level of the factors' interaction, and each cut if there are several.

    p_adjust names a correction of p-values within each net, for kind="p"; a pair has one p-value. regions (region, ...)
    gives the vertices their attributes."""
    if factors:
        activity = activity.withColumn("net", F.concat_ws(".", *factors))
    edges = corr_edges(activity, method)
    if kind == "p" and p_adjust != "none":
        edges = adjusted(with_p(edges), "p", p_adjust, ["net"], "p")
    edges = negatives(fill_undefined(edges, weak_link), negs)
    nodes = vertices(activity, regions)
    if kind is not None:
        edges = threshold(edges, kind, cuts)
        if len(cuts) > 1:
            edges = edges.withColumn("net", F.concat_ws(".", "net", "cut"))
            names = edges.sparkSession.createDataFrame([(float(c),) for c in cuts], "cut double")
            nodes = nodes.crossJoin(F.broadcast(names)).withColumn("net", F.concat_ws(".", "net", "cut")).drop("cut")
    if how is not None:
        edges = normalize(edges, how)
    return graph(edges), nodes


def ends(edges: DataFrame) -> DataFrame:
    """net, node, other, weight: each edge from both of its ends, in one pass over the edges."""
    both = F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other"))))
    return edges.select("net", "weight", both.alias("e")).select("net", "e.node", "e.other", "weight")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share. Where none is set a local one is made, in local mode only: other
    machines could not read it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="networks-")
        sc.setCheckpointDir(folder)
    return str(sc.getCheckpointDir())


def checkpointed(df: DataFrame) -> DataFrame:
    """df written once to the shared checkpoint folder and read from there; for tables that several steps read."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def drop_isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(ends(edges).select("net", "node").distinct(), ["net", "node"], "left_semi")


def match_nodes(nodes: DataFrame) -> DataFrame:
    """net, node for every net and every node of any net."""
    return nodes.select("net").distinct().crossJoin(nodes.select("node").distinct())


def dense(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """net, src, dst, weight of every pair of nodes over all nets; pairs that a net lacks are 0."""
    all_nodes = match_nodes(nodes)
    pairs = all_nodes.select("net", F.col("node").alias("src")).join(all_nodes.select("net", F.col("node").alias("dst")), "net").filter("src < dst")
    return pairs.join(edges, ["net", "src", "dst"], "left").select("net", "src", "dst", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def match_to_membership(edges: DataFrame, membership: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) with exactly the nodes of the membership: others go with their edges, missing ones are isolated."""
    keep = membership.select("net", "node")
    e = edges.join(keep.withColumnRenamed("node", "src"), ["net", "src"], "left_semi").join(keep.withColumnRenamed("node", "dst"), ["net", "dst"], "left_semi")
    return e.select("net", "src", "dst", "weight"), keep.distinct()


def map_networks(edges: DataFrame, fn, schema: str) -> DataFrame:  # noqa: ANN001
    """fn(net, names, matrix) -> pandas frame, for every net; the matrix is symmetric with a zero diagonal."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, m = to_matrix(pdf)
        return fn(pdf["net"].iloc[0], names, m)

    return edges.groupBy("net").applyInPandas(run, schema)


def map_networks_with(edges: DataFrame, other: DataFrame, fn, schema: str) -> DataFrame:  # noqa: ANN001
    """fn(net, names, matrix, frame) -> pandas frame, for every net and its rows of a second table (net, ...), as of its
    membership."""

    def run(pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        names, m = to_matrix(pdf)
        return fn((pdf if len(pdf) else own)["net"].iloc[0], names, m, own)

    return edges.groupBy("net").cogroup(other.groupBy("net")).applyInPandas(run, schema)


def to_matrix(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rows with dst null name isolated nodes."""
    names = np.unique(np.concatenate([pdf["src"].to_numpy(str), pdf["dst"].dropna().to_numpy(str)]))
    at = {n: k for k, n in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    real = pdf.dropna(subset=["dst"])
    i, j = real["src"].map(at).to_numpy(int), real["dst"].map(at).to_numpy(int)
    m[i, j] = m[j, i] = real["weight"].to_numpy(float)
    return names, m


def to_edge_list(pdf: pd.DataFrame, nodes: Sequence[str] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(names, i, j, weight) of the rows with dst; names are of all rows and of nodes."""
    names = np.unique(np.concatenate([pdf["src"].to_numpy(str), pdf["dst"].dropna().to_numpy(str), np.asarray(nodes, str)]))
    real = pdf.dropna(subset=["dst"])
    return names, np.searchsorted(names, real["src"].to_numpy(str)), np.searchsorted(names, real["dst"].to_numpy(str)), real["weight"].to_numpy(float)


def with_isolated(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges and, for nodes without one, a row without dst; the form that map_networks takes."""
    alone = nodes.select("net", "node").distinct().join(ends(edges).select("net", "node").distinct(), ["net", "node"], "left_anti")
    return edges.select("net", "src", "dst", "weight").unionByName(alone.select("net", F.col("node").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(0.0).alias("weight")))
