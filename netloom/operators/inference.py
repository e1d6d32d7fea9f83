"""Permutation inference: one framework for all comparisons between networks.

Labels are shuffled by md5(rep : sample), so every engine and any partitioning draws the same permutations. A replicate
is a network like any other: `net` is `rep|level`, and one job computes the metrics of all of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.functions.dist import critical_r
from netloom.operators import community, network, nodal, paths


def permuted_labels(samples: DataFrame, resamples: int, seed: int = 0, start: int = 0) -> DataFrame:
    """rep, sample, level: rep 0 has the true labels, the others a permutation each. samples: sample, level. Replicates
    are those from `start` on."""
    spark = samples.sparkSession
    base = samples.select("sample", "level", F.row_number().over(W.orderBy("level", "sample")).alias("place"))
    reps = spark.range(start, resamples + 1).withColumnRenamed("id", "rep")
    text = F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), F.col("sample").cast("string"))
    key = F.when(F.col("rep") == 0, F.lpad(F.col("place").cast("string"), 12, "0")).otherwise(F.md5(text))
    drawn = base.crossJoin(reps).select("rep", "sample", F.row_number().over(W.partitionBy("rep").orderBy(key, "sample")).alias("place"))
    return drawn.join(F.broadcast(base.select("place", "level")) if samples.count() < 1_000_000 else base.select("place", "level"), "place").select("rep", "sample", "level")


def permuted_activity(activity: DataFrame, samples: DataFrame, resamples: int, seed: int = 0, start: int = 0) -> DataFrame:
    """net (rep|level), sample, region, value. activity: sample, region, value."""
    labels = permuted_labels(samples, resamples, seed, start)
    return activity.join(labels, "sample").select(F.concat_ws("|", "rep", "level").alias("net"), "sample", "region", "value")


#: Replicates that one task makes of an experiment it has read, at most, and the cells of an experiment that may be read so.
REPS_A_TASK, CELLS_A_TASK = 50, 20_000_000


def _blocks(activity: DataFrame, samples: DataFrame, resamples: int, seed: int, start: int = 0) -> tuple[DataFrame, DataFrame]:
    """(cells, labels) to group by `block`. The experiment goes to each block of replicates as one row for each region:
    cells has block, region, and the samples and values of the region in arrays. Blocks are as many as there are task
    slots, or more, so that none makes over REPS_A_TASK replicates."""
    spark = activity.sparkSession
    reps = resamples + 1 - start
    blocks = max(math.ceil(reps / REPS_A_TASK), min(spark.sparkContext.defaultParallelism, reps))
    labels = permuted_labels(samples, resamples, seed, start).withColumn("block", F.pmod("rep", F.lit(blocks)))
    mean = network.averaged(activity.withColumn("net", F.lit(""))).select(F.col("sample").cast("string").alias("sample"), "region", "value")
    packed = mean.groupBy("region").agg(F.collect_list(F.struct("sample", F.coalesce("value", F.lit(float("nan"))).alias("value"))).alias("cells"))
    packed = packed.select("region", F.col("cells.sample").alias("samples"), F.col("cells.value").alias("values"))
    return packed.crossJoin(F.broadcast(spark.range(blocks).withColumnRenamed("id", "block"))), labels


def _matrix(pdf: pd.DataFrame) -> tuple[np.ndarray, dict[str, int], np.ndarray]:
    """(regions, the row of each sample, values) of a block's cells; absent ones are nan."""
    pdf = pdf.sort_values("region")
    at, samples = pd.factorize(np.concatenate(pdf["samples"].to_list()))
    x = np.full((len(samples), len(pdf)), np.nan)
    x[at, np.repeat(np.arange(len(pdf)), pdf["samples"].map(len))] = np.concatenate(pdf["values"].to_list())
    return pdf["region"].to_numpy(str), {name: k for k, name in enumerate(samples)}, x


def _rows_of(own: pd.DataFrame, place: dict[str, int]) -> dict[tuple[int, str], list[int]]:
    """The rows of the samples of each replicate and level."""
    return {key: [place[name] for name in f["sample"].astype(str) if name in place] for key, f in own.groupby(["rep", "level"])}


def permuted_edges(activity: DataFrame, samples: DataFrame, resamples: int, seed: int = 0, start: int = 0) -> DataFrame:
    """net (rep|level), src, dst, r, n: corr_edges of permuted_activity by matrix products; the experiment's cells go once
    to each block of replicates. A region that has no pair in a net is a row without dst, so that no node is lost."""
    cells, labels = _blocks(activity, samples, resamples, seed, start)

    def run(pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"net": [], "src": [], "dst": [], "r": [], "n": []})]
        if len(pdf):
            names, place, x = _matrix(pdf)
            i, j = np.triu_indices(len(names), 1)
            for (rep, level), rows in _rows_of(own, place).items():
                r, n = pairwise_r(x[rows])
                here = n[i, j] > 0
                out.append(pd.DataFrame({"net": f"{rep}|{level}", "src": names[i], "dst": names[j], "r": r[i, j], "n": n[i, j]})[here])
                alone = np.setdiff1d(np.arange(len(names)), np.concatenate([i[here], j[here]]))
                out.append(pd.DataFrame({"net": f"{rep}|{level}", "src": names[alone], "dst": None, "r": np.nan, "n": 0}))
        edges = pd.concat([f for f in out if len(f)] or out)
        # Only r itself becomes null where it is undefined.
        return edges.assign(r=pd.array(edges["r"].to_numpy(float), dtype="Float64"), n=edges["n"].astype("int64"))

    return cells.groupBy("block").cogroup(labels.groupBy("block")).applyInPandas(run, "net string, src string, dst string, r double, n long")


def pairwise_r(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(r, n) between the columns of x over the rows where both have a value; nan where one does not vary."""
    here = ~np.isnan(x)
    with np.errstate(all="ignore"):
        middle = np.where(here.any(axis=0), np.nansum(x, axis=0) / np.maximum(here.sum(axis=0), 1), 0.0)
        v, m = np.where(here, x - middle, 0.0), here.astype(float)
        n, s, q = m.T @ m, v.T @ m, (v * v).T @ m
        cov, var = v.T @ v - s * s.T / n, q - s * s / n
        # Rounding errors of a column that does not vary are no variance.
        scale = np.where(here, np.abs(x), 0.0).max(axis=0, initial=0.0)
        var = np.where(var > n * (1e-13 * scale[:, None]) ** 2, var, np.nan)
        return cov / np.sqrt(var * var.T), n.astype(int)


def _edges(activity: DataFrame) -> DataFrame:
    """The correlations of activity, which may be a table of them already."""
    return activity.filter("dst IS NOT NULL") if "src" in activity.columns else network.corr_edges(activity)


def _nodes(activity: DataFrame) -> DataFrame:
    """net, node of all regions, with and without a pair."""
    if "src" not in activity.columns:
        return activity.select("net", F.col("region").alias("node")).distinct()
    return activity.select("net", F.explode(F.array("src", "dst")).alias("node")).filter("node IS NOT NULL").distinct()


def contrasts(metrics: DataFrame, first_minus_second: bool = True, absolute: bool = False) -> DataFrame:
    """rep, contrast, node, metric, diff of each pair of levels a < b. metrics: net (rep|level), node, metric, value.

    The contrast is named in the direction of the difference: `a ~ b` for first minus second, `b ~ a` for the other."""
    at = F.split("net", r"\|", 2)
    m = metrics.select(at[0].cast("long").alias("rep"), at[1].alias("level"), "node", "metric", "value")
    both = m.alias("x").join(m.alias("y"), F.expr("x.rep = y.rep AND x.node = y.node AND x.metric = y.metric AND x.level < y.level"))
    diff = F.col("x.value") - F.col("y.value") if first_minus_second or absolute else F.col("y.value") - F.col("x.value")
    name = F.concat_ws(" ~ ", "x.level", "y.level") if first_minus_second or absolute else F.concat_ws(" ~ ", "y.level", "x.level")
    # What is not a number is undefined, as null is.
    diff = F.nanvl(F.abs(diff) if absolute else diff, F.lit(None).cast("double"))
    return both.select("x.rep", name.alias("contrast"), F.col("x.node").alias("node"), F.col("x.metric").alias("metric"), diff.alias("diff"))


def p_values(diffs: DataFrame, comparator: str = ">", two_sided: bool = True) -> DataFrame:
    """contrast, node, metric, diff, p_value: the share of replicates beyond the data's difference (rep 0), undefined
    ones left out. The null distribution is never stored: it is reduced to a mean in each map task."""
    real = diffs.filter("rep = 0").drop("rep").withColumnRenamed("diff", "real")
    null = diffs.filter("rep > 0").join(real, ["contrast", "metric", "node"])
    x, y = (F.abs("diff"), F.abs("real")) if two_sided else (F.col("diff"), F.col("real"))
    beyond = x >= y if comparator == ">=" else x > y
    return null.groupBy("contrast", "node", "metric", F.col("real").alias("diff")).agg(F.avg(beyond.cast("double")).alias("p_value")).select("contrast", "node", "metric", "diff", "p_value")


def permutation_test(activity: DataFrame, samples: DataFrame, metric_fn: Callable[[DataFrame], DataFrame], resamples: int = 10_000, seed: int = 0, first_minus_second: bool = True, absolute: bool = False, comparator: str = ">") -> DataFrame:
    """p_values of metric_fn (-> net, node, metric, value) under permuted labels.

    metric_fn takes the correlations of all replicates (net, src, dst, r, n), or their activity (net, sample, region,
    value) where an experiment has more than CELLS_A_TASK cells; the metrics below take either, and both have the same
    correlations and nodes. It may round; ties between a replicate and the data then count by `comparator`."""
    small = activity.limit(CELLS_A_TASK + 1).count() <= CELLS_A_TASK
    metrics = metric_fn((permuted_edges if small else permuted_activity)(activity, samples, resamples, seed))
    return p_values(contrasts(metrics, first_minus_second, absolute), comparator)


def redrawn_test(activity: DataFrame, samples: DataFrame, metric_fn: Callable[[DataFrame], DataFrame], resamples: int = 10_000, seed: int = 0, first_minus_second: bool = True, absolute: bool = False, comparator: str = ">", most_attempts: int | None = None) -> DataFrame:
    """permutation_test with defined replicates only, and the columns replicates and attempts.

    Permutations are numbered attempts. An attempt in which any difference that the data have is undefined is rejected and
    drawn again, until there are `resamples` accepted ones or `most_attempts` (ten times as many) are spent; the accepted
    ones with the smallest numbers count, so rounds do not change the result. Differences that the data themselves do not
    define are left out. `attempts` is how many were drawn for the replicates that count."""
    most = 10 * resamples if most_attempts is None else most_attempts
    small = activity.limit(CELLS_A_TASK + 1).count() <= CELLS_A_TASK
    draw = permuted_edges if small else permuted_activity
    keys = ["contrast", "metric", "node"]

    def diffs(first: int, last: int) -> DataFrame:
        metrics = metric_fn(draw(activity, samples, last, seed, first))
        return network.checkpointed(contrasts(metrics, first_minus_second, absolute))

    found = diffs(0, min(resamples, most))
    real = network.checkpointed(found.filter("rep = 0 AND diff IS NOT NULL").select(*keys, F.col("diff").alias("real")))
    wanted = real.count()
    null, accepted, done, good = None, None, min(resamples, most), 0
    part = found.filter("rep > 0")
    while True:
        # One row for each attempt; an attempt counts where all that the data define is defined.
        whole = part.filter("diff IS NOT NULL").join(real, keys, "left_semi").groupBy("rep").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == wanted).select("rep")
        whole = network.checkpointed(whole)
        null, accepted = (part, whole) if null is None else (null.unionByName(part), accepted.unionByName(whole))
        good += whole.count()
        if good >= resamples or done >= most or not wanted:
            break
        # As many as are missing at the share accepted so far, and a few more.
        first, done = done + 1, min(most, done + max(8, math.ceil(1.2 * (resamples - good) * done / max(good, done / 100))))
        part = diffs(first, done)
    last = accepted.orderBy("rep").limit(resamples).agg(F.max("rep"), F.count(F.lit(1))).first()
    used = null.join(accepted.filter(F.col("rep") <= (last[0] or 0)), "rep", "left_semi").unionByName(found.filter("rep = 0 AND diff IS NOT NULL"))
    out = p_values(used, comparator)
    return out.withColumn("replicates", F.lit(int(last[1])).cast("long")).withColumn("attempts", F.lit(int(last[0] or done)).cast("long"))


def edge_values(r: np.ndarray, n: np.ndarray, weak_link: int | None = None, negs: str = "keep", kind: str | None = None, cut: float = 0.0, how: str | None = None) -> np.ndarray:
    """edge_metrics of the pairs of one net (n > 0), in numpy."""
    v = np.where(np.isnan(r), 0.0 if weak_link is None else 10.0**-weak_link, np.where(np.isinf(r), 1.0, r))
    v = {"keep": v, "zero": np.maximum(v, 0.0), "abs": np.abs(v)}[negs]
    if kind is not None and len(v):
        if kind == "r":
            passes = np.abs(v) > cut
        elif kind == "p":
            passes = np.abs(v) > critical_r(n, cut)
        elif kind == "cost":
            passes = np.abs(v) >= np.quantile(np.abs(v), 1 - cut)
        else:
            raise ValueError(f"unknown kind {kind!r}")
        v = np.where(passes, v, 0.0)
    with np.errstate(all="ignore"):
        if how == "fisherz":
            v = np.arctanh(v)
        elif how == "max_norm":
            v = v / max(1.0, v.max(initial=-np.inf))
        elif how == "max_edge_norm":
            v = v / (v.max(initial=-np.inf) or np.nan)
        elif how == "max_min_norm":
            low, high = v.min(initial=np.inf), v.max(initial=-np.inf)
            v = (v - low) / ((high - low) or np.nan)
        elif how is not None:
            raise ValueError(f"unknown normalization {how!r}")
    return v


def edge_permutation_test(activity: DataFrame, samples: DataFrame, resamples: int = 10_000, seed: int = 0, first_minus_second: bool = True, absolute: bool = False, comparator: str = ">", places: int | None = None, **options: object) -> DataFrame:
    """permutation_test of edge_metrics(places, **options) with counts that add up.

    Each block of replicates compares its differences with the data's own at once and gives, for each pair of levels and
    each edge, how many replicates are defined and how many are beyond; blocks add up. What is shuffled does not grow with
    the replicates of a block. The experiment has to fit a task, as in permuted_edges; an experiment of more than
    CELLS_A_TASK cells takes the way of permutation_test, whose result is the same."""
    if activity.limit(CELLS_A_TASK + 1).count() > CELLS_A_TASK:
        return permutation_test(activity, samples, lambda x: edge_metrics(x, places, **options), resamples, seed, first_minus_second, absolute, comparator)
    cells, labels = _blocks(activity, samples, resamples, seed, 1)
    # The data's own labels go to every block.
    blocks = cells.select("block").distinct()
    labels = labels.unionByName(permuted_labels(samples, 0, seed).crossJoin(F.broadcast(blocks)).select(*labels.columns))

    def run(pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        names, place, x = _matrix(pdf)
        i, j = np.triu_indices(len(names), 1)
        values: dict[int, dict[str, np.ndarray]] = {}
        for (rep, level), rows in _rows_of(own, place).items():
            r, n = pairwise_r(x[rows])
            r, n = r[i, j], n[i, j]
            v = np.full(len(i), np.nan)
            v[n > 0] = edge_values(r[n > 0], n[n > 0], **options)
            values.setdefault(rep, {})[level] = v if places is None else np.round(v, places)
        levels = sorted(values[0])
        pairs = [(a, b) for k, a in enumerate(levels) for b in levels[k + 1 :]]
        forward = first_minus_second or absolute
        out = []
        for a, b in pairs:
            diff = lambda nets, a=a, b=b: nets[a] - nets[b] if forward else nets[b] - nets[a]
            with np.errstate(all="ignore"):
                real = diff(values[0])
                beyond, defined = np.zeros(len(i), int), np.zeros(len(i), int)
                for rep, nets in values.items():
                    if rep and a in nets and b in nets:
                        d = np.abs(diff(nets))
                        defined += ~np.isnan(d)
                        beyond += d >= np.abs(real) if comparator == ">=" else d > np.abs(real)
            here = ~np.isnan(real)
            node = [f"{p} ~ {q}" for p, q in zip(names[i[here]], names[j[here]], strict=True)]
            out.append(pd.DataFrame({"contrast": f"{a} ~ {b}" if forward else f"{b} ~ {a}", "node": node, "diff": np.abs(real[here]) if absolute else real[here], "beyond": beyond[here], "defined": defined[here]}))
        return pd.concat(out) if out else pd.DataFrame({"contrast": [], "node": [], "diff": [], "beyond": [], "defined": []})

    def met(pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        return run(pdf, own) if len(pdf) and len(own) else pd.DataFrame({"contrast": [], "node": [], "diff": [], "beyond": [], "defined": []})

    counts = cells.groupBy("block").cogroup(labels.groupBy("block")).applyInPandas(met, "contrast string, node string, diff double, beyond long, defined long")
    total = counts.groupBy("contrast", "node").agg(F.max("diff").alias("diff"), F.sum("beyond").alias("beyond"), F.sum("defined").alias("defined"))
    return total.filter("defined > 0").select("contrast", "node", F.lit("r").alias("metric"), "diff", (F.col("beyond") / F.col("defined")).alias("p_value"))


def _long(wide: DataFrame, columns: list[str], places: int | None) -> DataFrame:
    """net, node, metric, value from a column for each metric."""
    value = lambda c: F.round(F.col(c), places) if places is not None else F.col(c)
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), value(c).alias("value")) for c in columns)))
    return wide.select("net", F.col("node") if "node" in wide.columns else F.lit("").alias("node"), pairs.alias("m")).select("net", "node", "m.metric", "m.value")


def edge_metrics(activity: DataFrame, places: int | None = None, weak_link: int | None = None, negs: str = "keep", kind: str | None = None, cut: float = 0.0, how: str | None = None) -> DataFrame:
    """The correlation of every edge, 0 (or 10**-weak_link) where it is undefined, with the policies, threshold and
    normalisation of built networks; the node is `src ~ dst`."""
    e = network.negatives(network.fill_undefined(_edges(activity), weak_link), negs)
    if kind is not None:
        e = network.threshold(e, kind, [cut]).drop("cut")
    if how is not None:
        e = network.normalize(e, how)
    return _long(e.select("net", F.concat_ws(" ~ ", "src", "dst").alias("node"), "r"), ["r"], places)


def _graph(activity: DataFrame, cut: float) -> tuple[DataFrame, DataFrame]:
    # Metrics read the edges several times; the pairs of all replicates are made once.
    if "src" in activity.columns:
        activity = network.checkpointed(activity)
    e = network.checkpointed(network.fill_undefined(_edges(activity)))
    return network.graph(e.filter(F.abs("r") > cut)), network.checkpointed(_nodes(activity))


#: Metrics of `nodal_measures`; any of them can be compared.
NODAL = ("degree", "strength", "signed_strength", "leverage", "burt", "transitivity", "nodal_efficiency", "betweenness", "closeness", "eigenvector")


def nodal_metrics(activity: DataFrame, cut: float = 0.2, metrics: Sequence[str] = NODAL, places: int | None = None) -> DataFrame:
    edges, nodes = _graph(activity, cut)
    return _long(nodal.nodal_measures(edges, nodes, metrics), [m.lower() for m in metrics], places)


def global_metrics(activity: DataFrame, membership: DataFrame, cut: float = 0.2, places: int | None = None, quality: Callable[[DataFrame, DataFrame], DataFrame] = community.q_signed) -> DataFrame:
    """mean_fc, gc_size, gc_pct, density and modularity against a membership (node, comm); `quality` gives the latter as
    (net, value) of edges and a membership (net, node, comm). What is undefined is null, and then no replicate counts it."""
    edges, nodes = _graph(activity, cut)
    m = nodes.join(membership, "node")
    q = quality(edges, m)
    q = q.select("net", F.col(next(c for c in q.columns if c != "net")).alias("modularity"))
    n = nodes.groupBy("net").agg(F.count(F.lit(1)).alias("n"))
    base = n.join(edges.groupBy("net").agg(F.avg("weight").alias("mean_fc"), F.count(F.lit(1)).alias("m")), "net", "left").join(q, "net", "left").join(paths.giant_sizes(edges, nodes), "net")
    wide = base.select("net", "mean_fc", F.col("gc_size").cast("double").alias("gc_size"), (F.col("gc_size") * 100.0 / F.col("n")).alias("gc_pct"), (F.coalesce("m", F.lit(0)) * 2.0 / (F.col("n") * (F.col("n") - 1))).alias("density"), "modularity")
    return _long(wide, ["mean_fc", "gc_size", "gc_pct", "density", "modularity"], places)


def community_node_metrics(activity: DataFrame, membership: DataFrame, cut: float = 0.2, base: str | None = None, metrics: tuple[str, ...] = ("participation", "diversity", "gateway", "wcs"), places: int | None = None) -> DataFrame:
    """Signed community metrics of each node. membership: level, node, comm; each net takes that of its own level, or all
    take that of the level `base`."""
    edges, nodes = _graph(activity, cut)
    level = F.split("net", r"\|", 2)[1]
    if base is None:
        m = nodes.withColumn("level", level).join(membership, ["level", "node"]).select("net", "node", "comm")
    else:
        m = nodes.join(membership.filter(F.col("level") == base).select("node", "comm"), "node")
    m = network.checkpointed(m)
    edges, _ = network.match_to_membership(edges, m)
    return _long(community.community_metrics(edges, m, metrics).drop("comm"), list(metrics), places)


def spectral_density(m: np.ndarray, grid: np.ndarray, bandwidth: str = "Silverman") -> np.ndarray:
    """Gaussian kernel density of a symmetric matrix's eigenvalues over a grid, of unit mass."""
    v = np.linalg.eigvalsh(m)
    n = len(v)
    if bandwidth == "Sturges":
        h = (v.max() - v.min()) / (np.ceil(np.log2(n)) + 1)
    else:
        sd, middle = v.std(ddof=1), (np.percentile(v, 75) - np.percentile(v, 25)) / 1.34
        # A quartile range of rounding errors, as of equal eigenvalues, says nothing.
        h = 0.9 * (min(sd, middle) if middle > 1e-9 * sd else sd) * n**-0.2
    h = h or 1e-6
    y = np.exp(-0.5 * ((grid[:, None] - v[None, :]) / h) ** 2).sum(axis=1)
    return y / (y.sum() * (grid[1] - grid[0]))


def entropy_similarity(matrices: dict[str, np.ndarray], points: int = 1024, bandwidth: str = "Silverman") -> dict[str, float]:
    """Kullback-Leibler divergence of each network's spectral density from the mean density, and their mean as `KL`."""
    all_values = np.concatenate([np.linalg.eigvalsh(m) for m in matrices.values()])
    pad = 3 * (all_values.std() or 1.0)
    grid = np.linspace(all_values.min() - pad, all_values.max() + pad, points)
    f = {k: spectral_density(m, grid, bandwidth) for k, m in matrices.items()}
    mean = np.mean(list(f.values()), axis=0)
    step = grid[1] - grid[0]
    out = {}
    for k, y in f.items():
        ok = (y > 0) & (mean > 0)
        out[k] = float((y[ok] * np.log(y[ok] / mean[ok])).sum() * step)
    out["KL"] = float(np.mean(list(out.values())))
    return out


#: Permutations that one task makes of an experiment it has read, at least.
PERMUTATIONS_A_TASK = 50


def anogva(activity: DataFrame, samples: DataFrame, resamples: int = 10_000, seed: int = 0, pairwise: bool = True) -> DataFrame:
    """contrast, kl, p_value: spectral divergence between the levels' networks, over all levels and by pairs; p is the
    share of permutations with a larger divergence.

    The experiment's cells go once to each block of permutations, so one experiment has to fit a task."""
    spark = activity.sparkSession
    blocks = max(1, min(math.ceil((resamples + 1) / PERMUTATIONS_A_TASK), 1000))
    labelled = activity.select("sample", "region", "value").join(samples.select("sample", "level").distinct(), "sample")
    copies = labelled.crossJoin(F.broadcast(spark.range(blocks).withColumnRenamed("id", "block")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="sample", columns="region", values="value", aggfunc="first").sort_index().sort_index(axis=1)
        labels = pdf.drop_duplicates("sample").set_index("sample")["level"].reindex(wide.index).to_numpy(str)
        x, levels = wide.to_numpy(float), sorted(set(labels))
        groups = {"all": levels} | ({f"{a} ~ {b}": [a, b] for i, a in enumerate(levels) for b in levels[i + 1 :]} if pairwise else {})
        rows = []
        for rep in range(int(pdf["block"].iloc[0]), resamples + 1, blocks):
            own = labels if rep == 0 else np.random.default_rng([seed, rep]).permutation(labels)
            with np.errstate(all="ignore"):
                nets = {lv: np.nan_to_num(np.corrcoef(x[own == lv], rowvar=False)) - np.eye(x.shape[1]) for lv in levels}
            rows += [(rep, c, entropy_similarity({lv: nets[lv] for lv in g})["KL"]) for c, g in groups.items()]
        return pd.DataFrame(rows, columns=["rep", "contrast", "kl"])

    null = copies.groupBy("block").applyInPandas(run, "rep long, contrast string, kl double")
    w = W.partitionBy("contrast")
    real = null.withColumn("real", F.max(F.when(F.col("rep") == 0, F.col("kl"))).over(w)).filter("rep > 0")
    return real.groupBy("contrast", F.col("real").alias("kl")).agg(F.avg((F.col("kl") > F.col("real")).cast("double")).alias("p_value")).select("contrast", "kl", "p_value")


def anogva_simulation(spark, subjects: int = 50, groups: int = 2, size: int = 100, runs: int = 1, resamples: int = 1000, seed: int = 0, diff: bool = False, means: tuple[float, float] = (400.0, 400.0), sds: tuple[float, float] = (10.0, 50.0)) -> DataFrame:  # noqa: ANN001
    """alpha, rejected: the share of simulated experiments with a p-value of at most alpha, 0 to 1 by 0.02."""

    def run(frames):  # noqa: ANN001, ANN202
        for f in frames:
            out = []
            for k in f["id"]:
                rng = np.random.default_rng([seed, int(k)])
                labels = rng.permutation(np.arange(subjects) % groups)
                x = rng.normal(means[0], sds[0], (subjects, size))
                if diff:
                    half = np.isin(labels, np.arange(groups // 2))
                    x[half] = rng.normal(means[1], sds[1], (half.sum(), size))

                def kl(own: np.ndarray, x: np.ndarray = x) -> float:
                    return entropy_similarity({g: np.nan_to_num(np.corrcoef(x[own == g], rowvar=False)) - np.eye(size) for g in range(groups)}, 256)["KL"]

                real = kl(labels)
                out.append(np.mean([kl(rng.permutation(labels)) > real for _ in range(resamples)]))
            yield pd.DataFrame({"p": out})

    p = spark.range(0, runs, 1, max(1, min(runs, 1000))).mapInPandas(run, "p double")
    alphas = spark.range(51).select((F.col("id") * 0.02).alias("alpha"))
    return p.crossJoin(alphas).groupBy("alpha").agg(F.avg((F.col("p") <= F.col("alpha")).cast("double")).alias("rejected"))
