"""Nodal metrics as joins and aggregates: degree, strength, leverage, constraint, clustering, components."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators.network import checkpointed, ends


def _sizes(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("net").agg(F.count(F.lit(1)).alias("n_nodes"))


def _all(nodes: DataFrame, metrics: DataFrame, zero: tuple[str, ...]) -> DataFrame:
    return nodes.select("net", "node").join(metrics, ["net", "node"], "left").fillna(0.0, subset=list(zero))


def degree_strength(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """net, node, degree (over n - 1), strength (sum of weights)."""
    m = ends(edges).groupBy("net", "node").agg(F.count(F.lit(1)).cast("double").alias("k"), F.sum("weight").alias("strength"))
    out = _all(nodes, m, ("k", "strength")).join(_sizes(nodes), "net")
    return out.select("net", "node", F.coalesce(F.col("k") / F.nullif(F.col("n_nodes") - 1, F.lit(0)), F.lit(0.0)).alias("degree"), "strength")


def signed_strength(edges: DataFrame, nodes: DataFrame, sym: bool = False, normalized: bool = True, sizes: DataFrame | None = None) -> DataFrame:
    """net, node, s_pos, s_neg, s_signed. Asymmetric: s+ - (S- / (S+ + S-)) s-, with s = S / (n - 1).
    Symmetric: (s+ - s-) / (s+ + s-), or their difference if not normalized. Undefined is 0."""
    w = F.col("weight")
    m = ends(edges).groupBy("net", "node").agg(F.sum(F.greatest(w, F.lit(0.0))).alias("p"), F.sum(F.greatest(-w, F.lit(0.0))).alias("q"))
    key = ["net"] if sizes is None or "node" not in sizes.columns else ["net", "node"]
    out = _all(nodes, m, ("p", "q")).join(_sizes(nodes) if sizes is None else sizes, key)
    unit = F.nullif(F.col("n_nodes") - 1, F.lit(0)) if normalized or not sym else F.lit(1)
    pos, neg = F.coalesce(F.col("p") / unit, F.lit(0.0)), F.coalesce(F.col("q") / unit, F.lit(0.0))
    if not sym:
        signed = pos - F.col("q") / F.nullif(F.col("p") + F.col("q"), F.lit(0.0)) * neg
    elif normalized:
        signed = (pos - neg) / F.nullif(pos + neg, F.lit(0.0))
    else:
        signed = pos - neg
    return out.select("net", "node", pos.alias("s_pos"), neg.alias("s_neg"), F.coalesce(signed, F.lit(0.0)).alias("s_signed"))


def leverage(edges: DataFrame, nodes: DataFrame, weighted: bool = True, signed: bool = True) -> DataFrame:
    """net, node, leverage: mean over neighbours of (k_v - k_u) / (k_v + k_u); -1 where it is undefined.

    k is the signed strength, the strength (signed=False) or the number of edges (weighted=False too)."""
    if signed and not weighted:
        raise ValueError("leverage of unweighted edges has no sign: use signed=False")
    if signed:
        k = signed_strength(edges, nodes).select("net", "node", F.col("s_signed").alias("k"))
    else:
        k = ends(edges).groupBy("net", "node").agg((F.sum("weight") if weighted else F.count(F.lit(1)).cast("double")).alias("k"))
    e = ends(edges).join(k, ["net", "node"]).join(k.select("net", F.col("node").alias("other"), F.col("k").alias("ku")), ["net", "other"])
    # One undefined term makes the mean undefined.
    term = (F.col("k") - F.col("ku")) / F.nullif(F.col("k") + F.col("ku"), F.lit(0.0))
    m = e.groupBy("net", "node").agg(F.when(F.count_if(term.isNull()) == 0, F.avg(term)).alias("leverage"))
    return nodes.select("net", "node").join(m, ["net", "node"], "left").select("net", "node", F.coalesce("leverage", F.lit(-1.0)).alias("leverage"))


def constraint(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """net, node, burt: sum over other nodes j of (p_ij + sum_q p_iq p_qj)^2, p being shares of a node's strength.
    Undefined values are the net's largest plus 0.1."""
    e = ends(edges)
    total = e.groupBy("net", "node").agg(F.sum("weight").alias("s"))
    p = e.join(total, ["net", "node"]).select("net", "node", "other", (F.col("weight") / F.nullif("s", F.lit(0.0))).alias("p"))
    two = p.join(p.select("net", F.col("node").alias("other"), F.col("other").alias("third"), F.col("p").alias("p2")), ["net", "other"]).filter("node != third")
    reach = p.unionByName(two.select("net", "node", F.col("third").alias("other"), (F.col("p") * F.col("p2")).alias("p"))).groupBy("net", "node", "other").agg(F.sum("p").alias("p"))
    # Only direct neighbours constrain a node.
    near = reach.join(e.select("net", "node", "other"), ["net", "node", "other"], "left_semi")
    burt = near.groupBy("net", "node").agg(F.sum(F.col("p") * F.col("p")).alias("burt"))
    most = burt.groupBy("net").agg((F.max("burt") + 0.1).alias("most"))
    out = nodes.select("net", "node").join(burt, ["net", "node"], "left").join(most, "net", "left")
    return out.select("net", "node", F.coalesce("burt", "most").alias("burt"))


def triangles(edges: DataFrame) -> DataFrame:
    """net, a, b, c: each triangle once. Edges point from the end of fewer edges to that of more (ties by name), so a node
    has at most sqrt(2 m) edges that leave it, and pairs of them are at most m ** 1.5, however large a hub is."""
    k = ends(edges).groupBy("net", "node").agg(F.count(F.lit(1)).alias("k"))
    of = lambda end: k.select("net", F.col("node").alias(end), F.col("k").alias(f"k_{end}"))
    known = edges.select("net", "src", "dst").join(of("src"), ["net", "src"]).join(of("dst"), ["net", "dst"])
    up = F.struct("k_src", "src") < F.struct("k_dst", "dst")
    low, high = F.struct(F.col("k_src").alias("k"), F.col("src").alias("node")), F.struct(F.col("k_dst").alias("k"), F.col("dst").alias("node"))
    known = known.select("net", F.when(up, low).otherwise(high).alias("low"), F.when(up, high).otherwise(low).alias("high"))
    two = known.alias("x").join(known.alias("y"), F.expr("x.net = y.net AND x.low.node = y.low.node AND x.high < y.high")).select("x.net", F.col("x.low.node").alias("a"), F.col("x.high.node").alias("b"), F.col("y.high.node").alias("c"))
    return two.join(known.select("net", F.col("low.node").alias("b"), F.col("high.node").alias("c")), ["net", "b", "c"], "left_semi")


def transitivity(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """net, node, transitivity: closed share of the pairs of a node's neighbours; 0 with fewer than two."""
    k = ends(edges).groupBy("net", "node").agg(F.count(F.lit(1)).alias("k"))
    closed = triangles(edges).select("net", F.explode(F.array("a", "b", "c")).alias("node")).groupBy("net", "node").agg(F.count(F.lit(1)).alias("t"))
    share = closed.join(k, ["net", "node"]).select("net", "node", (F.col("t") * 2.0 / (F.col("k") * (F.col("k") - 1))).alias("transitivity"))
    return _all(nodes, share, ("transitivity",))


def components(edges: DataFrame, nodes: DataFrame, rounds: int = 100) -> DataFrame:
    """net, node, component (its smallest node): labels move to the least of the neighbours' until none changes.

    Labels are checkpointed in the shared folder each round, and jump over their own label to halve long paths."""
    e = checkpointed(ends(edges).select("net", "node", "other"))
    now = checkpointed(nodes.select("net", "node", F.col("node").alias("component")).distinct())
    for _ in range(rounds):
        seen = e.join(now.select("net", F.col("node").alias("other"), F.col("component").alias("c")), ["net", "other"]).groupBy("net", "node").agg(F.min("c").alias("c"))
        step = now.join(seen, ["net", "node"], "left").select("net", "node", "component", F.least("component", "c").alias("next"))
        jump = step.join(now.select("net", F.col("node").alias("next"), F.col("component").alias("far")), ["net", "next"], "left")
        new = checkpointed(jump.select("net", "node", F.col("component").alias("old"), F.least("next", "far").alias("component")))
        now = new.drop("old")
        if new.filter("component != old").isEmpty():
            return now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def nodal_measures(edges: DataFrame, nodes: DataFrame, metrics: Sequence[str] = ("degree", "strength", "signed_strength", "leverage", "burt", "transitivity", "nodal_efficiency", "betweenness", "closeness", "eigenvector")) -> DataFrame:
    """net, node and a column for each metric, named in any case; burt works on |weights|."""
    from netloom.operators.paths import METRICS, path_metrics

    wanted = [m.lower() for m in metrics]
    out = nodes.select("net", "node").distinct()
    if {"degree", "strength"} & set(wanted):
        out = out.join(degree_strength(edges, nodes), ["net", "node"])
    if "signed_strength" in wanted:
        out = out.join(signed_strength(edges, nodes).select("net", "node", F.col("s_signed").alias("signed_strength")), ["net", "node"])
    if "leverage" in wanted:
        out = out.join(leverage(edges, nodes), ["net", "node"])
    if "burt" in wanted:
        out = out.join(constraint(edges.withColumn("weight", F.abs("weight")), nodes), ["net", "node"], "left")
    if "transitivity" in wanted:
        out = out.join(transitivity(edges, nodes), ["net", "node"])
    paths = [m for m in wanted if m in (*METRICS, "local_efficiency")]
    if paths:
        out = out.join(path_metrics(edges, nodes, paths), ["net", "node"])
    if "efficiency_loss" in wanted:
        from netloom.operators.paths import efficiency_loss

        out = out.join(efficiency_loss(edges, nodes), ["net", "node"])
        wanted = [x for m in wanted for x in (["global_loss", "local_loss"] if m == "efficiency_loss" else [m])]
    # A network without edges has zeros.
    return out.select("net", "node", *(F.coalesce(F.col(m), F.lit(0.0)).alias(m) for m in wanted))


def general_measures(edges: DataFrame, nodes: DataFrame, membership: DataFrame, quality: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """net, mean_fc, gc_size, gc_pct, density, modularity against the membership: signed, or what `quality` gives as
    (net, value) of edges and membership."""
    from netloom.operators.community import q_signed

    n = _sizes(nodes)
    base = edges.groupBy("net").agg(F.avg("weight").alias("mean_fc"), F.count(F.lit(1)).alias("m"))
    giant = components(edges, nodes).groupBy("net", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("net").agg(F.max("c").alias("gc_size"))
    q = (quality or q_signed)(edges, membership)
    q = q.select("net", F.col(next(c for c in q.columns if c != "net")).alias("q_signed"))
    out = n.join(base, "net", "left").join(giant, "net", "left").join(q, "net", "left")
    return out.select("net", F.coalesce("mean_fc", F.lit(0.0)).alias("mean_fc"), "gc_size", (F.col("gc_size") * 100.0 / F.col("n_nodes")).alias("gc_pct"), (F.coalesce("m", F.lit(0)) * 2.0 / F.nullif(F.col("n_nodes") * (F.col("n_nodes") - 1), F.lit(0))).alias("density"), F.coalesce("q_signed", F.lit(0.0)).alias("modularity"))
