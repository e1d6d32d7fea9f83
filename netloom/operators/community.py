"""Modularity and community-based nodal metrics. membership: net, node, comm.

Several levels of a hierarchy are computed at once by putting the level into `net`: see `by_level`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators.network import ends
from netloom.operators.nodal import signed_strength


def by_level(edges: DataFrame, levels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, membership) for levels (net, level, node, comm): a net for each net and level."""
    named = F.concat_ws("/", "net", "level")
    e = edges.join(levels.select("net", "level").distinct(), "net").select(named.alias("net"), "src", "dst", "weight")
    return e, levels.select(named.alias("net"), "node", "comm")


def modularity_matrix(edges: DataFrame, nodes: DataFrame, gamma: float = 1.0) -> DataFrame:
    """net, src, dst, b of all ordered pairs: weight - gamma k_i k_j / v."""
    k = nodes.select("net", "node").join(ends(edges).groupBy("net", "node").agg(F.sum("weight").alias("k")), ["net", "node"], "left").fillna(0.0, subset=["k"])
    v = k.groupBy("net").agg(F.sum("k").alias("v"))
    pairs = k.select("net", F.col("node").alias("src"), F.col("k").alias("ki")).join(k.select("net", F.col("node").alias("dst"), F.col("k").alias("kj")), "net").join(v, "net")
    both = ends(edges).select("net", F.col("node").alias("src"), F.col("other").alias("dst"), "weight")
    out = pairs.join(both, ["net", "src", "dst"], "left")
    return out.select("net", "src", "dst", (F.coalesce("weight", F.lit(0.0)) - F.coalesce(gamma * F.col("ki") * F.col("kj") / F.nullif("v", F.lit(0.0)), F.lit(0.0))).alias("b"))


def _q_parts(edges: DataFrame, membership: DataFrame, gamma: float) -> DataFrame:
    """net, q, v of non-negative edges, as sum over communities of W_c / v - gamma (K_c / v)^2."""
    e = ends(edges).join(membership, ["net", "node"]).join(membership.select("net", F.col("node").alias("other"), F.col("comm").alias("comm2")), ["net", "other"])
    c = e.groupBy("net", "comm").agg(F.sum("weight").alias("k"), F.sum(F.when(F.col("comm") == F.col("comm2"), F.col("weight")).otherwise(F.lit(0.0))).alias("w"))
    t = c.groupBy("net").agg(F.sum("k").alias("v"), F.sum("w").alias("w"), F.sum(F.col("k") * F.col("k")).alias("k2"))
    return t.select("net", F.coalesce(F.col("w") / F.nullif("v", F.lit(0.0)) - gamma * F.col("k2") / F.nullif(F.col("v") * F.col("v"), F.lit(0.0)), F.lit(0.0)).alias("q"), "v")


def q(edges: DataFrame, membership: DataFrame, gamma: float = 1.0) -> DataFrame:
    """net, q."""
    return membership.select("net").distinct().join(_q_parts(edges, membership, gamma).select("net", "q"), "net", "left").fillna(0.0, subset=["q"])


def q_signed(edges: DataFrame, membership: DataFrame, gamma: float = 1.0) -> DataFrame:
    """net, q_signed: Q+ - (v- / (v+ + v-)) Q-."""
    pos = _q_parts(edges.filter("weight > 0"), membership, gamma).select("net", F.col("q").alias("qp"), F.col("v").alias("vp"))
    neg = _q_parts(edges.filter("weight < 0").withColumn("weight", -F.col("weight")), membership, gamma).select("net", F.col("q").alias("qn"), F.col("v").alias("vn"))
    out = membership.select("net").distinct().join(pos, "net", "left").join(neg, "net", "left").fillna(0.0)
    return out.select("net", (F.col("qp") - F.coalesce(F.col("vn") / F.nullif(F.col("vp") + F.col("vn"), F.lit(0.0)), F.lit(0.0)) * F.col("qn")).alias("q_signed"))


def _by_comm(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """net, node, comm of neighbours, and sums to it: p over positive, q over negative weights."""
    w = F.col("weight")
    e = ends(edges).join(membership.select("net", F.col("node").alias("other"), "comm"), ["net", "other"])
    return e.groupBy("net", "node", "comm").agg(F.sum(F.greatest(w, F.lit(0.0))).alias("p"), F.sum(F.greatest(-w, F.lit(0.0))).alias("q"))


def _signed(out: DataFrame, membership: DataFrame, name: str, pos, neg, sym: bool) -> DataFrame:  # noqa: ANN001
    both = out.select("net", "node", pos.alias("a"), neg.alias("b"), "sp", "sq")
    both = membership.select("net", "node").join(both, ["net", "node"], "left").fillna(0.0)
    share = F.coalesce(F.col("sq") / F.nullif(F.col("sp") + F.col("sq"), F.lit(0.0)), F.lit(0.0))
    signed = F.col("a") - F.col("b") if sym else F.col("a") - share * F.col("b")
    return both.select("net", "node", F.col("a").alias(f"{name}_pos"), F.col("b").alias(f"{name}_neg"), signed.alias(f"{name}_signed"))


def participation(edges: DataFrame, membership: DataFrame, sym: bool = False) -> DataFrame:
    """net, node, p_pos, p_neg, p_signed: 1 - sum_m (S_im / S_i)^2, 0 without edges of that sign."""
    g = _by_comm(edges, membership).groupBy("net", "node").agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"), F.sum(F.col("p") * F.col("p")).alias("p2"), F.sum(F.col("q") * F.col("q")).alias("q2"))
    of = lambda s, s2: F.when(F.col(s) > 0, 1 - F.col(s2) / (F.col(s) * F.col(s))).otherwise(F.lit(0.0))
    return _signed(g, membership, "p", of("sp", "p2"), of("sq", "q2"), sym)


def diversity(edges: DataFrame, membership: DataFrame, sym: bool = False) -> DataFrame:
    """net, node, h_pos, h_neg, h_signed: entropy of a node's strength over communities, over ln of their number."""
    m = membership.groupBy("net").agg(F.countDistinct("comm").alias("m"))
    c = _by_comm(edges, membership)
    total = c.groupBy("net", "node").agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))
    c = c.join(total, ["net", "node"])
    part = lambda x, s: F.when(F.col(x) > 0, -F.col(x) / F.col(s) * F.ln(F.col(x) / F.col(s))).otherwise(F.lit(0.0))
    g = c.groupBy("net", "node").agg(F.first("sp").alias("sp"), F.first("sq").alias("sq"), F.sum(part("p", "sp")).alias("ep"), F.sum(part("q", "sq")).alias("eq")).join(m, "net")
    of = lambda e: F.when(F.col("m") > 1, F.col(e) / F.ln(F.greatest(F.col("m"), F.lit(2)))).otherwise(F.lit(0.0))
    return _signed(g, membership, "h", of("ep"), of("eq"), sym)


def _gateway(edges: DataFrame, membership: DataFrame, centrality: DataFrame) -> DataFrame:
    """net, node, gw, s of non-negative edges. centrality: net, node, cent."""
    e = ends(edges).join(membership.select("net", F.col("node").alias("other"), F.col("comm").alias("to")), ["net", "other"])
    ks = e.join(centrality.select("net", F.col("node").alias("other"), "cent"), ["net", "other"], "left").groupBy("net", "node", "to").agg(F.sum("weight").alias("ks"), F.sum(F.coalesce("cent", F.lit(0.0))).alias("cs"))
    ks = ks.join(membership, ["net", "node"])
    size = membership.groupBy("net", "comm").agg(F.count(F.lit(1)).alias("size"))
    kjs = ks.groupBy("net", "comm", "to").agg(F.sum("ks").alias("kjs")).join(size, ["net", "comm"])
    kjs = kjs.select("net", "comm", "to", F.when(F.col("size") <= 1, F.lit(0.0)).when(F.col("comm") == F.col("to"), F.col("kjs") / 2).otherwise(F.col("kjs")).alias("kjs"))
    most = membership.join(centrality, ["net", "node"], "left").groupBy("net", "comm").agg(F.sum(F.coalesce("cent", F.lit(0.0))).alias("c")).groupBy("net").agg(F.max("c").alias("most"))
    k = ks.groupBy("net", "node").agg(F.sum("ks").alias("k"))
    t = ks.join(kjs, ["net", "comm", "to"]).join(most, "net").join(k, ["net", "node"])
    ksm = F.coalesce(F.col("ks") / F.nullif("kjs", F.lit(0.0)), F.lit(0.0))
    csm = F.coalesce(F.col("cs") / F.nullif("most", F.lit(0.0)), F.lit(0.0))
    term = F.col("ks") * F.col("ks") / F.nullif(F.col("k") * F.col("k"), F.lit(0.0)) * F.pow(1 - ksm * csm, F.lit(2.0))
    return t.groupBy("net", "node").agg((1 - F.sum(term)).alias("gw"), F.sum("ks").alias("s"))


def gateway(edges: DataFrame, membership: DataFrame, centtype: str = "str", sym: bool = False) -> DataFrame:
    """net, node, gw_pos, gw_neg, gw_signed; centtype: str (strength) or bet (betweenness)."""
    parts = []
    for sign, letter in ((1, "p"), (-1, "n")):
        e = edges.filter(F.col("weight") * sign > 0).withColumn("weight", F.col("weight") * sign)
        if centtype == "str":
            cent = ends(e).groupBy("net", "node").agg(F.sum("weight").alias("cent"))
        elif centtype == "bet":
            from netloom.operators.paths import path_metrics

            cent = path_metrics(e, membership.select("net", "node"), ("betweenness",)).select("net", "node", F.col("betweenness").alias("cent"))
        else:
            raise ValueError(f"unknown centrality {centtype!r}")
        parts.append(_gateway(e, membership, cent).select("net", "node", F.col("gw").alias(f"g{letter}"), F.col("s").alias("sp" if sign > 0 else "sq")))
    g = parts[0].join(parts[1], ["net", "node"], "full").fillna(0.0)
    return _signed(g, membership, "gw", F.col("gp"), F.col("gn"), sym)


def within_community_strength(edges: DataFrame, membership: DataFrame, signed: bool = True, normalized: bool = True) -> DataFrame:
    """net, node, wcs: signed strength inside the node's community (n is its size), or strength over its size."""
    mine = membership.select("net", F.col("node").alias("src"), "comm").join(edges, ["net", "src"])
    inside = mine.join(membership.select("net", F.col("node").alias("dst"), F.col("comm").alias("comm2")), ["net", "dst"]).filter("comm = comm2").select("net", "src", "dst", "weight")
    size = membership.join(membership.groupBy("net", "comm").agg(F.count(F.lit(1)).alias("n_nodes")), ["net", "comm"]).select("net", "node", "n_nodes")
    if signed:
        return signed_strength(inside, membership, normalized=normalized, sizes=size).select("net", "node", F.col("s_signed").alias("wcs"))
    s = ends(inside).groupBy("net", "node").agg(F.sum("weight").alias("s"))
    return size.join(s, ["net", "node"], "left").select("net", "node", (F.coalesce("s", F.lit(0.0)) / (F.col("n_nodes") if normalized else F.lit(1))).alias("wcs"))


def community_metrics(edges: DataFrame, membership: DataFrame, metrics: tuple[str, ...] = ("participation", "diversity", "gateway", "wcs"), sym: bool = False) -> DataFrame:
    """The signed value of each metric, a column each; a membership with a column `level` is evaluated at each level."""
    if "level" in membership.columns:
        edges, membership = by_level(edges, membership)
    of = {"participation": (participation, "p_signed"), "diversity": (diversity, "h_signed"), "gateway": (gateway, "gw_signed")}
    out = membership.select("net", "node", "comm")
    for m in metrics:
        if m == "wcs":
            part = within_community_strength(edges, membership)
        else:
            fn, column = of[m]
            part = fn(edges, membership, sym=sym).select("net", "node", F.col(column).alias(m))
        out = out.join(part, ["net", "node"])
    return out
