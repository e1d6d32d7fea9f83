"""Hand-made graphs, numpy versions and properties."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from netloom.functions import dist
from netloom.functions.exprs import adjusted
from netloom.operators import activity, community, hierarchy, inference, network, nodal, partition, paths, prep, report
from netloom.sources import counts


def _graph(spark, edges, nodes=None, net="g"):  # noqa: ANN001, ANN202
    e = spark.createDataFrame([(net, *sorted((a, b)), float(w)) for a, b, w in edges], "net string, src string, dst string, weight double")
    names = sorted({x for a, b, _ in edges for x in (a, b)} | set(nodes or ()))
    return e, spark.createDataFrame([(net, n) for n in names], "net string, node string")


def _by(df, column, key="node"):  # noqa: ANN001, ANN202
    return {r[key]: r[column] for r in df.collect()}


SQUARE = [("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0), ("a", "d", 1.0), ("a", "c", -0.5)]


# Distributions against values of public tables.


def test_distributions() -> None:
    assert dist.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-9)
    assert dist.t_quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-7)
    assert dist.f_upper(4.964602744, 1, 10) == pytest.approx(0.05, abs=1e-9)
    assert dist.chi2_upper(3.841458821, 1) == pytest.approx(0.05, abs=1e-9)
    assert dist.normal_quantile(0.975)[0] == pytest.approx(1.959963985, abs=1e-8)
    assert dist.critical_r(12, 0.05) == pytest.approx(0.575982983, abs=1e-7)


@given(st.floats(0.5, 30), st.floats(0.5, 30), st.floats(0.01, 0.99))
@settings(max_examples=50, deadline=None)
def test_beta_is_symmetric(a: float, b: float, x: float) -> None:
    assert dist.beta_inc(a, b, x) == pytest.approx(1 - dist.beta_inc(b, a, 1 - x), abs=1e-9)


# Networks.


def test_correlation_policies(spark) -> None:  # noqa: ANN001
    rows = [("n", f"s{k}", r, v) for k in range(5) for r, v in (("a", float(k)), ("b", 2.0 * k + 1), ("c", float((k * 7) % 3)), ("d", 4.0))]
    e = network.corr_edges(spark.createDataFrame(rows, "net string, sample string, region string, value double"))
    r = {(x["src"], x["dst"]): x["r"] for x in e.collect()}
    assert r["a", "b"] == pytest.approx(1) and r["a", "d"] is None
    f = {(x["src"], x["dst"]): x["r"] for x in network.fill_undefined(e, weak_link=2).collect()}
    assert f["a", "d"] == 0.01
    p = {(x["src"], x["dst"]): x["p"] for x in network.fill_undefined(network.with_p(e)).collect()}
    assert p["a", "d"] == 1 and p["a", "b"] == pytest.approx(0, abs=1e-6)
    cost = network.threshold(network.fill_undefined(e), "cost", [0.1]).filter("r != 0").collect()
    assert [(x["src"], x["dst"]) for x in cost] == [("a", "b")]
    with pytest.raises(ValueError, match="unknown"):
        network.threshold(e, "nothing", [0.1])
    edges, nodes = network.build_networks(spark.createDataFrame(rows, "net string, sample string, region string, value double"), kind="r", cuts=(0.1, 0.9))
    assert {x["net"] for x in nodes.collect()} == {"n.0.1", "n.0.9"}
    assert edges.filter("net = 'n.0.9'").count() == 1


def _untidy(spark, seed: int = 1):  # noqa: ANN001, ANN202
    """Nulls, NaN, repeated cells, absent cells, a constant region, a region with one value, and no common samples."""
    rng = np.random.default_rng(seed)
    rows = [("n", f"s{k:02}", f"r{j}", None if rng.random() < 0.2 else float("nan") if rng.random() < 0.1 else float(rng.normal())) for k in range(20) for j in range(6) if rng.random() < 0.9]
    rows += [("n", f"s{k:02}", "r1", float(k)) for k in range(0, 20, 3)]
    rows += [("n", f"s{k:02}", "flat", 4.1) for k in range(20)] + [("n", "s03", "one", 2.0), ("n", "elsewhere", "far", 1.0), ("n", "else", "far", 2.0)]
    return spark.createDataFrame(rows, "net string, sample string, region string, value double")


def test_correlations_mean_the_same_on_every_path(spark) -> None:  # noqa: ANN001
    a = _untidy(spark)
    by = lambda df: {(r["src"], r["dst"]): (r["r"], r["n"]) for r in df.collect()}
    x = by(network.corr_edges(a))
    wide = a.toPandas().groupby(["sample", "region"])["value"].mean().unstack()
    names = sorted(wide.columns)
    for i, p in enumerate(names):
        for q in names[i + 1 :]:
            both = wide[[p, q]].dropna()
            if not len(both):
                assert (p, q) not in x
                continue
            r, n = x[p, q]
            assert n == len(both)
            sd = both.std()
            assert r is None if len(both) < 2 or (sd < 1e-12).any() else r == pytest.approx(both.corr().iloc[0, 1], abs=1e-9)
    assert any(r is None for r, _ in x.values()) and ("far", "r0") not in x
    samples = a.select("sample").distinct().selectExpr("sample", "'l' AS level")
    labelled = inference.permuted_edges(a.drop("net"), samples, 0)
    paths_of = [by(network.gram_edges(a)), by(network.gram_edges(a, 3, 7)), by(labelled.filter("dst IS NOT NULL")), by(network.corr_edges(inference.permuted_activity(a.drop("net"), samples, 0)))]
    for y in paths_of:
        assert x.keys() == y.keys()
        for k in x:
            assert x[k][1] == y[k][1] and ((x[k][0] is None and y[k][0] is None) or x[k][0] == pytest.approx(y[k][0], abs=1e-9)), k
    assert [r["src"] for r in labelled.filter("dst IS NULL").collect()] == ["far"]


def test_spearman_ranks_the_samples_of_the_pair(spark) -> None:  # noqa: ANN001
    a = _untidy(spark, 2)
    wide = a.toPandas().groupby(["sample", "region"])["value"].mean().unstack()
    got = {(r["src"], r["dst"]): r["r"] for r in network.corr_edges(a, "spearman").collect()}
    for p, q in (("r0", "r2"), ("r1", "r4"), ("r3", "r5")):
        both = wide[[p, q]].dropna().rank()
        assert got[p, q] == pytest.approx(both.corr().iloc[0, 1], abs=1e-9)


def test_permutations_keep_constant_regions_and_do_not_depend_on_size(spark, monkeypatch) -> None:  # noqa: ANN001
    a = _untidy(spark).drop("net")
    samples = a.select("sample").distinct().selectExpr("sample", "IF(substr(sample, 3, 1) < '5', 'x', 'y') AS level")
    rows = lambda df: sorted((r["contrast"], r["node"], round(r["diff"], 9), r["p_value"]) for r in df.collect())
    small = rows(inference.permutation_test(a, samples, lambda x: inference.edge_metrics(x, 9), 12))
    counted = rows(inference.edge_permutation_test(a, samples, 12, places=9))
    monkeypatch.setattr(inference, "CELLS_A_TASK", 3)
    large = rows(inference.permutation_test(a, samples, lambda x: inference.edge_metrics(x, 9), 12))
    assert small == large == counted
    assert sum("flat" in r[1] for r in small) >= 6


@pytest.mark.parametrize("options", [{}, {"negs": "abs", "kind": "r", "cut": 0.3}, {"negs": "zero", "kind": "cost", "cut": 0.5, "how": "max_edge_norm"}, {"weak_link": 2, "kind": "p", "cut": 0.4, "how": "fisherz"}, {"how": "max_min_norm"}, {"how": "max_norm"}])
def test_edge_policies_in_numpy_and_spark(spark, options) -> None:  # noqa: ANN001
    edges = network.corr_edges(_untidy(spark))
    want = {r["node"]: r["value"] for r in inference.edge_metrics(edges, **options).collect()}
    frame = edges.toPandas()
    got = inference.edge_values(frame["r"].to_numpy(float), frame["n"].to_numpy(), **options)
    for p, q, v in zip(frame["src"], frame["dst"], got, strict=True):
        w = want[f"{p} ~ {q}"]
        assert (w is None and np.isnan(v)) or w == pytest.approx(v, abs=1e-9)


def test_redraw_counts_defined_replicates(spark) -> None:  # noqa: ANN001
    """A metric that is undefined in about half of the attempts, known by their numbers."""
    a = spark.createDataFrame([(f"s{k}", r, float(k * (3 if r == "b" else 1) % 7)) for k in range(12) for r in "ab"], "sample string, region string, value double")
    samples = a.select("sample").distinct().selectExpr("sample", "IF(sample < 's5', 'x', 'y') AS level")
    from pyspark.sql import functions as F

    def metric(e):  # noqa: ANN001, ANN202
        rep = F.split("net", r"\|")[0].cast("long")
        return e.filter("dst IS NOT NULL").select("net", F.lit("").alias("node"), F.lit("m").alias("metric"), F.when((rep == 0) | (rep % 3 != 1), F.col("r")).alias("value"))

    got = inference.redrawn_test(a, samples, metric, 10).first()
    assert (got["replicates"], got["attempts"]) == (10, 15)  # 2 3 5 6 8 9 11 12 14 15
    got = inference.redrawn_test(a, samples, metric, 10, most_attempts=9).first()
    assert (got["replicates"], got["attempts"]) == (6, 9)


def test_isolated_nodes_stay(spark) -> None:  # noqa: ANN001
    e, n = _graph(spark, SQUARE, ["z"])
    assert _by(nodal.degree_strength(e, n), "degree") == {"a": 0.75, "b": 0.5, "c": 0.75, "d": 0.5, "z": 0.0}
    assert _by(nodal.leverage(e, n), "leverage")["z"] == -1
    assert _by(nodal.components(e, n), "component") == {"a": "a", "b": "a", "c": "a", "d": "a", "z": "z"}
    assert _by(nodal.transitivity(e, n), "transitivity") == {"a": pytest.approx(2 / 3), "b": 1.0, "c": pytest.approx(2 / 3), "d": 1.0, "z": 0.0}
    assert network.drop_isolated(n, e).count() == 4


def test_signed_strength(spark) -> None:  # noqa: ANN001
    e, n = _graph(spark, SQUARE)
    s = {r["node"]: r for r in nodal.signed_strength(e, n).collect()}
    assert s["a"]["s_pos"] == pytest.approx(2 / 3) and s["a"]["s_neg"] == pytest.approx(0.5 / 3)
    assert s["a"]["s_signed"] == pytest.approx(2 / 3 - 0.5 / 2.5 * 0.5 / 3)
    assert s["b"]["s_signed"] == pytest.approx(2 / 3)
    with pytest.raises(ValueError, match="sign"):
        nodal.leverage(e, n, weighted=False)


def test_constraint_of_a_star(spark) -> None:  # noqa: ANN001
    e, n = _graph(spark, [("h", "a", 1), ("h", "b", 1), ("h", "c", 1)])
    assert _by(nodal.constraint(e, n), "burt") == {"h": pytest.approx(1 / 3), "a": 1.0, "b": 1.0, "c": 1.0}


def test_triangles_of_a_star(spark) -> None:  # noqa: ANN001
    """A hub of 100,000 leaves, two of them linked: one triangle, and no pairs of all leaves."""
    from pyspark.sql import functions as F

    leaves = spark.range(100_000).select(F.lit("g").alias("net"), F.lit("hub").alias("src"), F.concat(F.lit("v"), "id").alias("dst"), F.lit(1.0).alias("weight"))
    e = leaves.unionByName(spark.createDataFrame([("g", "v1", "v2", 1.0)], "net string, src string, dst string, weight double"))
    assert [sorted(r[1:]) for r in nodal.triangles(e).collect()] == [["hub", "v1", "v2"]]
    nodes = network.ends(e).select("net", "node").distinct()
    got = {r["node"]: r["transitivity"] for r in nodal.transitivity(e, nodes).filter("transitivity > 0").collect()}
    assert got == {"v1": 1.0, "v2": 1.0, "hub": pytest.approx(2 / (100_000 * 99_999))}


def test_ami_of_pairs_needs_no_pairs(spark) -> None:  # noqa: ANN001
    """Co-classification of 3,000 nodes: 9 million pairs, from four counts."""
    rng = np.random.default_rng(0)
    c = rng.integers(0, 5, (2, 3000))
    rows = [(f"n{k}", f"v{i}", int(c[k, i])) for k in range(2) for i in range(3000)]
    got = partition.ami_between(spark.createDataFrame(rows, "net string, node string, comm int"), co_classification=True).first()["ami"]
    assert abs(got) < 1e-2


def test_paths_of_a_line(spark) -> None:  # noqa: ANN001
    e, n = _graph(spark, [("a", "b", 1), ("b", "c", 0.5)], ["z"])
    got = {r["node"]: r for r in paths.path_metrics(e, n).collect()}
    assert got["b"]["betweenness"] == 1 and got["a"]["betweenness"] == 0
    assert got["a"]["nodal_efficiency"] == pytest.approx((1 + 1 / 3) / 3) and got["z"]["nodal_efficiency"] == 0
    assert got["b"]["eigenvector"] == 1
    loss = _by(paths.efficiency_loss(e, n), "global_loss")
    assert loss["b"] == pytest.approx(1) and loss["z"] < 0


def _all_paths(n: int, w: dict, s: int, t: int) -> list:
    """All shortest simple paths from s to t by trying every one."""
    best, found = math.inf, []
    stack = [((s,), 0.0)]
    while stack:
        path, d = stack.pop()
        if path[-1] == t:
            if d < best - 1e-9:
                best, found = d, [path]
            elif d < best + 1e-9:
                found.append(path)
            continue
        stack += [((*path, v), d + 1 / abs(w[path[-1], v])) for v in range(n) if v not in path and (path[-1], v) in w]
    return [p for p in found]


@pytest.mark.parametrize("sources", [1, 3, 64])
def test_paths_against_every_path(spark, sources: int) -> None:  # noqa: ANN001
    """Ties and all, in blocks of sources of any size; the last node is alone."""
    rng = np.random.default_rng(5)
    n = 7
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]
    weight = {p: float(rng.choice([1.0, 0.5, -0.5, 0.25])) for p in pairs}
    w = {**weight, **{(j, i): x for (i, j), x in weight.items()}}
    e, nodes = _graph(spark, [(f"v{i}", f"v{j}", x) for (i, j), x in weight.items()], [f"v{k}" for k in range(n + 1)])
    got = {r["node"]: r for r in paths.path_metrics(e, nodes, ("nodal_efficiency", "betweenness", "closeness"), sources_a_task=sources).collect()}
    through, far = np.zeros(n), np.full((n, n), np.inf)
    for s in range(n):
        for t in range(n):
            if s != t and (all_of := _all_paths(n, w, s, t)):
                far[s, t] = sum(1 / abs(w[a, b]) for a, b in zip(all_of[0], all_of[0][1:], strict=False))
                for p in all_of:
                    for v in p[1:-1]:
                        through[v] += 0.5 / len(all_of)
    assert len(got) == n + 1 and got[f"v{n}"]["closeness"] == 0
    for v in range(n):
        there = far[v][np.isfinite(far[v])]
        assert got[f"v{v}"]["betweenness"] == pytest.approx(through[v])
        assert got[f"v{v}"]["nodal_efficiency"] == pytest.approx((1 / there).sum() / n)
        assert got[f"v{v}"]["closeness"] == pytest.approx(len(there) / there.sum())


def test_networks_without_edges(spark) -> None:  # noqa: ANN001
    e, n = _graph(spark, SQUARE)
    none = e.limit(0)
    m = n.selectExpr("net", "node", "1 AS comm")
    assert {r["betweenness"] for r in paths.path_metrics(none, n).collect()} == {0.0}
    assert nodal.general_measures(none, n, m).first()["density"] == 0
    assert community.q_signed(none, m).first()["q_signed"] == 0


def test_nodal_measures_and_files(spark, tmp_path) -> None:  # noqa: ANN001
    e, n = _graph(spark, SQUARE, ["z"])
    got = {r["node"]: r for r in nodal.nodal_measures(e, n, ("Degree", "burt", "Nodal_Efficiency", "efficiency_loss")).collect()}
    assert got["b"]["degree"] == 0.5 and got["z"]["nodal_efficiency"] == 0 and got["a"]["global_loss"] is not None
    none = nodal.nodal_measures(e.limit(0), n).collect()
    assert all(r["burt"] == 0 and r["betweenness"] == 0 for r in none)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 1)) + 0.1 * rng.normal(size=(40, 2))
    rows = np.column_stack([x, rng.normal(size=40)])
    (tmp_path / "t.csv").write_text("a,b,c\n" + "\n".join(",".join(map(str, r)) for r in rows))
    edges, nodes = counts.network_of_file(spark, str(tmp_path / "t.csv"), kind="p", cuts=(0.01,), p_adjust="holm")
    assert [(r["src"], r["dst"]) for r in edges.collect()] == [("a", "b")] and nodes.count() == 3
    sizes = network.map_networks_with(e, n, lambda net, names, m, own: own.groupby("net", as_index=False).size().rename(columns={"size": "k"}), "net string, k long")
    assert sizes.first()["k"] == 5


# Communities.

TWO = [("a", "b", 1), ("b", "c", 1), ("a", "c", 1), ("d", "e", 1), ("e", "f", 1), ("d", "f", 1), ("c", "d", 1)]
TWO_COMM = {"a": 1, "b": 1, "c": 1, "d": 2, "e": 2, "f": 2}


def _memb(spark, comm):  # noqa: ANN001, ANN202
    return spark.createDataFrame([("g", k, v) for k, v in comm.items()], "net string, node string, comm int")


def test_modularity(spark) -> None:  # noqa: ANN001
    e, n = _graph(spark, TWO)
    m = _memb(spark, TWO_COMM)
    assert community.q(e, m).first()["q"] == pytest.approx(12 / 14 - 0.5)
    same = sum(r["b"] for r in community.modularity_matrix(e, n).collect() if TWO_COMM[r["src"]] == TWO_COMM[r["dst"]])
    assert same / 14 == pytest.approx(12 / 14 - 0.5)
    other = _memb(spark, {k: 9 - v for k, v in TWO_COMM.items()})
    assert community.q_signed(e, other).first()["q_signed"] == pytest.approx(12 / 14 - 0.5)


def test_community_metrics(spark) -> None:  # noqa: ANN001
    e, _ = _graph(spark, TWO)
    m = _memb(spark, TWO_COMM)
    assert _by(community.participation(e, m), "p_signed") == {"a": 0.0, "b": 0.0, "c": pytest.approx(1 - 5 / 9), "d": pytest.approx(1 - 5 / 9), "e": 0.0, "f": 0.0}
    h = _by(community.diversity(e, m), "h_signed")
    assert h["c"] == pytest.approx(-(2 / 3 * math.log(2 / 3) + 1 / 3 * math.log(1 / 3)) / math.log(2)) and h["a"] == 0
    one = _memb(spark, dict.fromkeys(TWO_COMM, 1))
    assert set(_by(community.diversity(e, one), "h_signed").values()) == {0.0}
    assert set(_by(community.participation(e, one), "p_signed").values()) == {0.0}
    assert _by(community.within_community_strength(e, m), "wcs") == dict.fromkeys(TWO_COMM, 1.0)
    assert set(_by(community.gateway(e, m, "bet"), "gw_signed")) == set(TWO_COMM)


def test_membership_reconciliation(spark) -> None:  # noqa: ANN001
    e, _ = _graph(spark, TWO)
    edges, nodes = network.match_to_membership(e, _memb(spark, {"a": 1, "b": 1, "y": 2}))
    assert edges.count() == 1 and {r["node"] for r in nodes.collect()} == {"a", "b", "y"}
    both = network.match_nodes(_graph(spark, TWO)[1].unionByName(_graph(spark, SQUARE, net="h")[1]))
    assert both.count() == 12


@pytest.mark.parametrize("optimizer", ["louvain", "signed_louvain", "spectral"])
def test_two_triangles(spark, optimizer: str) -> None:  # noqa: ANN001
    e, n = _graph(spark, TWO)
    for part in partition.partition_runs(e, n, runs=3, optimizer=optimizer).groupBy("part").agg({"comm": "collect_list", "node": "collect_list"}).collect():
        comm = dict(zip(part["collect_list(node)"], part["collect_list(comm)"], strict=True))
        assert comm["a"] == comm["b"] == comm["c"] != comm["d"] == comm["e"] == comm["f"]


@given(st.integers(0, 10_000))
@settings(max_examples=20, deadline=None)
def test_louvain_reaches_no_worse_than_one_community(seed: int) -> None:
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(12, 12))
    m = np.triu(m, 1) + np.triu(m, 1).T
    b = partition.objective(m, "neg_asym")
    c = partition.louvain(b, rng)
    q = b[c[:, None] == c[None, :]].sum()
    assert q >= b.sum() - 1e-9 and q >= np.trace(b) - 1e-9


def test_spectral_is_deterministic_and_order_free() -> None:
    m = np.zeros((6, 6))
    for a, b, _ in TWO:
        i, j = ord(a) - 97, ord(b) - 97
        m[i, j] = m[j, i] = 1
    order = np.array([3, 0, 5, 1, 4, 2])
    c, d = partition.spectral_partition(m), partition.spectral_partition(m[np.ix_(order, order)])
    same = lambda v: v[:, None] == v[None, :]
    assert (same(c)[np.ix_(order, order)] == same(d)).all()


def _random_matrix(rng, n: int, signed: bool = False) -> np.ndarray:  # noqa: ANN001
    a = np.triu(rng.random((n, n)) * (rng.random((n, n)) < 0.7), 1) + np.triu(np.full((n, n), 0.01), 1)
    a = a * np.where(rng.random((n, n)) < 0.3, -1, 1) if signed else a
    return a + a.T


def _all_partitions(n: int):  # noqa: ANN202
    def grow(labels: list[int]):  # noqa: ANN202
        if len(labels) == n:
            yield np.array(labels)
            return
        for c in range(max(labels, default=-1) + 2):
            yield from grow([*labels, c])

    yield from grow([])


def _quality(b: np.ndarray, c: np.ndarray) -> float:
    return b[c[:, None] == c[None, :]].sum()


def test_divisions_against_brute_force() -> None:
    rng = np.random.default_rng(4)
    for _ in range(25):
        a = _random_matrix(rng, 7)
        b = partition.modularity_b(a)
        c = partition.spectral_partition(a)
        best = max(_quality(b, p) for p in _all_partitions(7))
        assert _quality(b, np.zeros(7, int)) - 1e-9 <= _quality(b, c) <= best + 1e-9
        # The pass of flips never loses, and is no worse than any single flip.
        side = np.where(rng.random(7) < 0.5, 1.0, -1.0)
        sub = b - np.diag(b.sum(axis=0))
        got = partition.flipped(sub, side)
        single = [side * np.where(np.arange(7) == k, -1, 1) for k in range(7)]
        assert got @ sub @ got >= max(s @ sub @ s for s in [side, *single]) - 1e-9
    two = np.kron(np.eye(2), np.ones((4, 4))) - np.eye(8) + 0.01
    assert partition.spectral_partition(two).tolist() == [0] * 4 + [1] * 4


@pytest.mark.parametrize("signed", [False, True])
def test_negative_share_against_its_definition(signed: bool) -> None:
    rng = np.random.default_rng(9)
    for _ in range(20):
        a = _random_matrix(rng, 8, signed)
        i, j = np.triu_indices(8, 1)
        x, p = a[i, j], (a - partition.modularity_b(a))[i, j]
        share = partition.NegativeShare(a)

        def plain(gamma: float, x: np.ndarray = x, p: np.ndarray = p) -> float:
            v = gamma * p - x
            return np.maximum(v, 0).sum() / np.abs(v).sum()

        for gamma in [*rng.normal(1, 2, 30), *(share.events + 1e-9)]:
            assert share.at(gamma) == pytest.approx(plain(gamma), abs=1e-9)
        if not signed:
            want = np.linspace(plain(share.events[0]) + 1e-6, 1 - 1e-6, 40)
            gammas = share.inverse(want)
            assert (np.diff(gammas) >= -1e-12).all()
            assert [plain(g) for g in gammas] == pytest.approx(want.tolist(), abs=1e-8)
            g = partition.event_gammas(a, n=12, low=0.5)
            assert g["b"].iloc[0] == pytest.approx(plain(0.5)) and g["gamma"].iloc[-1] == pytest.approx(share.events[-1])


def test_searches_and_objectives_of_ones_own(spark) -> None:  # noqa: ANN001
    e, n = _graph(spark, TWO)
    halves = lambda a, gamma, seed: np.arange(len(a)) % 2 + 10 * 0 * int(gamma)
    got = {r["node"]: r["comm"] for r in partition.partition_runs(e, n, runs=2, optimizer=halves).collect()}
    assert set(got.values()) == {1, 2}
    a = np.kron(np.eye(2), np.ones((3, 3))) - np.eye(6)
    assert partition.signed_louvain(a, 1.0, lambda m, gamma: m - 0.5 * gamma).tolist() == [0, 0, 0, 1, 1, 1]


def test_gammas(spark) -> None:  # noqa: ANN001
    e, n = _graph(spark, TWO)
    r = partition.gamma_ranges(e, n).first()
    assert 0 < r["gamma_min"] < r["gamma_max"] and r["converged"]
    g = partition.event_gammas(network.to_matrix(e.toPandas())[1], n=10, samples=10)
    assert len(g) == 10 and np.isfinite(g["gamma"]).all() and (np.diff(g["gamma"]) > -1e-9).all()


def _parts(spark, rows):  # noqa: ANN001, ANN202
    return spark.createDataFrame([("g", p, n, c) for p, part in enumerate(rows) for n, c in part.items()], "net string, part long, node string, comm int")


def test_partition_measures(spark) -> None:  # noqa: ANN001
    p = _parts(spark, [TWO_COMM, {k: 3 - v for k, v in TWO_COMM.items()}, dict.fromkeys(TWO_COMM, 1)])
    w = {(r["src"], r["dst"]): r["weight"] for r in partition.agreement(p).collect()}
    assert w["a", "b"] == 1 and w["a", "d"] == pytest.approx(1 / 3)
    assert partition.unique_partitions(p).select("part").distinct().count() == 2
    assert [r["p"] for r in partition.perm_model(p).orderBy("part").collect()] == [pytest.approx(12 / 30), pytest.approx(12 / 30), 1.0]
    local = partition.local_perm_model(p)
    exact = _by(partition.sampled_null(local, 0.5, 2000), "p")
    assert all(0 <= v <= 1 for v in exact.values())
    assert all(0 <= v <= 1 for v in _by(partition.normal_null(local), "p").values())
    both = p.alias("x").join(p.alias("y"), on=["node"]).selectExpr("x.part AS a", "y.part AS b", "x.comm AS c1", "y.comm AS c2")
    ami = {(r["a"], r["b"]): r["ami"] for r in partition.ami(both, ["a", "b"], "c1", "c2").collect()}
    assert ami[0, 1] == pytest.approx(1) and ami[0, 2] == pytest.approx(0, abs=1e-9)


# Consensus of one network in memory, to compare with.


def _factorize(v: np.ndarray) -> tuple:
    _, first, inverse = np.unique(v, return_index=True, return_inverse=True)
    return (np.argsort(np.argsort(first))[inverse],)


def _agree(c: np.ndarray) -> np.ndarray:
    """Agreement of partitions in columns."""
    d = np.mean([v[:, None] == v[None, :] for v in c.T], axis=0)
    np.fill_diagonal(d, 0)
    return d


def _null_of(c: np.ndarray, perm: str, alpha: float) -> np.ndarray:
    """Expected agreement by a null model, at the alpha quantile of the normal approximation."""
    n = len(c)
    sizes = np.array([[(v == x).sum() for x in v] for v in c.T]).T
    mu = (sizes - 1) / max(n - 1, 1)
    if perm == "global":
        mu = np.broadcast_to(((sizes - 1).sum(axis=0) / (n * max(n - 1, 1)))[None, :], mu.shape)
    p = np.clip(mu.mean(axis=1) + dist.normal_quantile(alpha)[0] * np.sqrt((mu * (1 - mu)).sum(axis=1)) / mu.shape[1], 0, 1)
    out = np.minimum(p[:, None], p[None, :])
    np.fill_diagonal(out, 0)
    return out


def _first_labels(v: np.ndarray) -> np.ndarray:
    return _factorize(v)[0]


def _consensus_labels(c: np.ndarray, perm: str | None = "local", alpha: float = 0.05, tau: float = 0.5, runs: int = 100, seed: int = 0, convergence: bool = True, max_iter: int = 50) -> tuple[np.ndarray, bool]:
    """(labels, converged) of partitions in columns: agreement less its null (or cut at tau) is partitioned again, until
    all runs agree. convergence=False subtracts once and splits by eigenvectors."""
    for k in range(max_iter):
        d = _agree(c)
        d = np.where(d >= tau, d, 0) if perm is None else d - _null_of(c, perm, alpha)
        if not convergence:
            return partition.spectral_partition(d), True
        if not d.any():
            return np.arange(len(d)), True
        c = np.array([_first_labels(partition.signed_louvain(d, 1.0, "custom", (seed, k, r))) for r in range(runs)]).T
        if (c == c[:, :1]).all():
            return c[:, 0], True
    return c[:, 0], False


def _hierarchical_labels(c: np.ndarray, alpha: float = 0.05, runs: int = 50, seed: int = 0, max_iter: int = 50, perm: str = "local") -> tuple[np.ndarray, bool]:
    """(labels by level, converged): each community is split by the consensus of its own nodes until none splits."""
    levels, ok = [np.zeros(len(c), int)], True
    while True:
        now, new = levels[-1], levels[-1] * 0
        used = 0
        for k in np.unique(now):
            at = np.flatnonzero(now == k)
            sub = np.array([_first_labels(v) for v in c[at].T]).T
            labels = np.zeros(len(at), int)
            if len(at) > 1:
                d = _agree(sub) - _null_of(sub, perm, alpha)
                if (d[~np.eye(len(at), dtype=bool)] <= 0).any():
                    labels, fine = _consensus_labels(sub, perm, alpha, runs=runs, seed=seed + len(levels), max_iter=max_iter)
                    ok &= fine
            new[at] = used + labels
            used += labels.max() + 1
        if used == now.max() + 1:
            return np.array(levels).T, ok
        levels.append(new)


def _noisy(seed: int, n: int = 12, parts: int = 9) -> list[dict[str, int]]:
    """Partitions of nested groups with nodes astray."""
    rng = np.random.default_rng(seed)
    names = [f"v{k:02}" for k in range(n)]
    return [{name: int(rng.integers(9)) if rng.random() < 0.15 else (k // 3 if p % 2 else k // 6) for k, name in enumerate(names)} for p in range(parts)]


@pytest.mark.parametrize(("perm", "convergence"), [("local", True), ("global", True), (None, True), ("local", False)])
def test_consensus_equals_that_in_memory(spark, perm, convergence) -> None:  # noqa: ANN001
    """Several nets at once, of which some converge before others, and one of a single node."""
    nets = {f"n{k}": _noisy(k) for k in range(3)} | {"one": [{"v": 1}, {"v": 2}]}
    rows = [(net, p, node, comm) for net, parts in nets.items() for p, m in enumerate(parts) for node, comm in m.items()]
    df = spark.createDataFrame(rows, "net string, part long, node string, comm int")
    got = {(r["net"], r["node"]): (r["comm"], r["converged"]) for r in partition.consensus(df, perm=perm, runs=20, convergence=convergence).collect()}
    assert len(got) == len({(net, node) for net, _, node, _ in rows})
    for net, parts in nets.items():
        names = sorted(parts[0])
        c = np.array([[m[node] for m in parts] for node in names])
        labels, ok = (np.zeros(1, int), True) if len(names) == 1 else _consensus_labels(c, perm, runs=20, convergence=convergence)
        assert [got[net, node] for node in names] == [(int(x) + 1, ok) for x in _factorize(labels)[0]]


def test_hierarchy_equals_that_in_memory(spark) -> None:  # noqa: ANN001
    nets = {f"n{k}": _noisy(k + 10) for k in range(2)}
    rows = [(net, p, node, comm) for net, parts in nets.items() for p, m in enumerate(parts) for node, comm in m.items()]
    got = {(r["net"], r["level"], r["node"]): r["comm"] for r in partition.hierarchical_consensus(spark.createDataFrame(rows, "net string, part long, node string, comm int"), runs=15).collect()}
    for net, parts in nets.items():
        names = sorted(parts[0])
        levels, _ = _hierarchical_labels(np.array([[m[node] for m in parts] for node in names]), runs=15)
        assert max(level for n, level, _ in got if n == net) == levels.shape[1]
        for k in range(levels.shape[1]):
            mine = [got[net, k + 1, node] for node in names]
            assert _factorize(np.array(mine))[0].tolist() == _factorize(levels[:, k])[0].tolist()
    assert max(level for _, level, _ in got) > 1


def test_consensus_takes_other_searches_and_nulls(spark) -> None:  # noqa: ANN001
    df = _parts(spark, _noisy(4))
    one = partition.consensus(df, runs=3, optimizer=lambda m, gamma, seed: np.zeros(len(m), int))
    assert {r["comm"] for r in one.collect()} == {1}
    exact = partition.consensus(df, runs=5, null=partition.exact_null)
    assert exact.count() == 12 and all(r["converged"] for r in exact.collect())


def test_consensus_query_where_nothing_agrees_beyond_chance(spark, tmp_path, monkeypatch) -> None:  # noqa: ANN001
    """Brands that all go together (A), of which every run makes one community, beside brands in two groups (R)."""
    from pyspark.sql import functions as F

    from netloom.plans import queries

    spark.range(6).select(F.col("id").alias("p_partkey"), F.format_string("Brand#1%d", "id").alias("p_brand")).write.parquet(f"{tmp_path}/part.parquet")
    rows = spark.range(6).withColumnRenamed("id", "l_partkey").crossJoin(spark.range(24).withColumnRenamed("id", "m")).crossJoin(spark.createDataFrame([("A",), ("R",)], "l_returnflag string"))
    value = F.when(F.expr("l_returnflag = 'A' OR l_partkey < 3"), F.col("m") * 10).otherwise(F.col("m") * 7 % 24 * 10) + F.col("l_partkey") * F.col("m") % 3
    rows.select("l_partkey", "l_returnflag", F.expr("CAST(add_months(DATE'2020-01-15', CAST(m AS INT)) AS TIMESTAMP)").alias("l_shipdate"), value.cast("double").alias("l_quantity")).write.parquet(f"{tmp_path}/lineitem.parquet")
    facts = lambda: {r["net"]: (r["n_nodes"], r["distinct_nodes"], r["numbered"], r["converged"], r["beats_one"], r["beats_single"]) for r in queries.QUERIES["consensus"](spark, str(tmp_path)).collect()}
    assert facts() == {"A": (6, 6, True, True, True, True), "R": (6, 6, True, True, True, True)}
    # Neither one community of all nor single nodes of the groups pass.
    made = partition.consensus
    monkeypatch.setattr(partition, "consensus", lambda *a, **b: made(*a, **b).withColumn("comm", F.lit(1)))
    assert not any(x[4] and x[5] for x in facts().values())
    single = F.substring("node", 8, 1).cast("int") + 1
    monkeypatch.setattr(partition, "consensus", lambda *a, **b: made(*a, **b).withColumn("comm", single))
    assert {k: bool(x[4] and x[5]) for k, x in facts().items()} == {"A": True, "R": False}


@given(st.integers(0, 10_000), st.sampled_from(["modularity", "neg_asym", "neg_sym", "potts", "custom"]))
@settings(max_examples=60, deadline=None)
def test_sparse_louvain_settles_as_the_dense_one(seed: int, mod: str) -> None:
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 14))
    a = np.triu(rng.normal(size=(n, n)) * (rng.random((n, n)) < 0.5), 1)
    a = np.abs(a) if mod == "modularity" else a
    i, j = np.nonzero(a)
    b = partition.objective(a + a.T, mod, 0.9)
    c = partition.SparseObjective(n, i, j, a[i, j], mod, 0.9).louvain(np.random.default_rng(seed))
    dense = partition.louvain(b, np.random.default_rng(seed))
    quality = lambda c: b[c[:, None] == c[None, :]].sum()
    to = b @ np.eye(c.max() + 2)[c]
    to[np.arange(n), c] -= np.diag(b)
    assert (to - to[np.arange(n), c][:, None]).max() <= 1e-8
    assert quality(c) == pytest.approx(quality(dense), abs=0.05 * np.abs(b).sum() + 1e-9)


def test_sparse_louvain_of_a_large_network() -> None:
    """4,000 nodes in 40 groups: no matrix of all pairs, and the groups come back."""
    rng = np.random.default_rng(1)
    group = np.arange(4000) % 40
    i = rng.integers(0, 4000, 40_000)
    j = np.where(rng.random(len(i)) < 0.85, (i + 40 * rng.integers(1, 100, len(i))) % 4000, rng.integers(0, 4000, len(i)))
    pair = np.unique(np.minimum(i, j)[i != j] * 4000 + np.maximum(i, j)[i != j])
    c = partition.SparseObjective(4000, pair // 4000, pair % 4000, np.ones(len(pair)), "modularity").louvain(np.random.default_rng(0))
    assert len(set(zip(c.tolist(), group.tolist(), strict=True))) == len(set(c.tolist())) == 40


def test_consensus(spark) -> None:  # noqa: ANN001
    noisy = [dict(TWO_COMM) for _ in range(9)]
    noisy[0]["c"] = 2
    got = partition.consensus(_parts(spark, noisy), runs=10).collect()
    comm = {r["node"]: r["comm"] for r in got}
    assert all(r["converged"] for r in got)
    assert comm["a"] == comm["b"] == comm["c"] != comm["d"] == comm["e"] == comm["f"]
    levels = partition.hierarchical_consensus(_parts(spark, noisy), runs=10).collect()
    top = {r["node"]: r["comm"] for r in levels if r["level"] == 1}
    second = {r["node"]: r["comm"] for r in levels if r["level"] == 2}
    assert set(top.values()) == {1} and second["a"] == second["c"] != second["f"]


# Preparation, the tree and files.


def test_deep_closure(spark) -> None:  # noqa: ANN001
    from pyspark.sql import functions as F

    chain = spark.range(700).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    up = hierarchy.deep_closure(chain)
    assert up.count() == up.distinct().count() == 700 * 701 // 2
    assert up.filter("id - ancestor_id != depth").isEmpty() and up.filter("id = 699").count() == 700
    small = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 3), (5, 99)], "id long, parent_id long")
    assert sorted(map(tuple, hierarchy.deep_closure(small).collect())) == sorted(map(tuple, hierarchy.closure(small).collect()))
    with pytest.raises(ValueError, match="cycle"):
        hierarchy.deep_closure(spark.createDataFrame([(1, 3), (2, 1), (3, 2), (4, None)], "id long, parent_id long"))


def test_deep_closure_sorts_no_paths(spark, monkeypatch) -> None:  # noqa: ANN001
    """Many regions in chains of five: joins that cannot broadcast hold steps and stream paths."""
    from pyspark.sql import functions as F

    plans, write = [], network.checkpointed
    monkeypatch.setattr(network, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or write(df))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        up = hierarchy.deep_closure(spark.range(120_000).select("id", F.when(F.col("id") % 5 != 0, F.col("id") - 1).alias("parent_id")))
        assert any("Join" in x for x in plans) and not any("SortMergeJoin" in x for x in plans)
        assert up.count() == up.distinct().count() == 120_000 * 3
        assert up.filter("id - ancestor_id != depth OR ancestor_id div 5 != id div 5").isEmpty()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_clean_and_scale(spark) -> None:  # noqa: ANN001
    rows = [("n", "1", "a", 1.0), ("n", "2", "a", None), ("n", "3", "a", 3.0), ("n", "1", "b", None), ("n", "2", "b", None), ("n", "3", "b", 5.0)]
    c = prep.clean(spark.createDataFrame(rows, "net string, sample string, region string, value double"))
    assert sorted((r["region"], r["value"]) for r in c.collect()) == [("a", 1.0), ("a", 2.0), ("a", 3.0)]
    z = prep.z_by_level(c, ["net"]).orderBy("sample").collect()
    assert [r["z"] for r in z] == [-1, 0, 1]
    one = prep.z_by_level(c.limit(1), ["net"]).first()
    assert one["z"] is None


REGIONS = [
    (997, None, "root", "root"), (8, 997, "Basic", "grey"), (567, 8, "Cerebrum", "CH"), (1, 567, "Visual areas", "VIS"), (2, 1, "Visual areas, layer 1", "VIS1"),
    (3, 567, "Dentate gyrus", "DG"), (4, 3, "Dentate gyrus, polymorph layer", "DG.po"), (5, 567, "Thalamus", "TH"), (1009, 997, "fiber tracts", "fiber"), (6, 1009, "tract", "t"),
]


def test_tree(spark) -> None:  # noqa: ANN001
    regions = spark.createDataFrame(REGIONS, "id int, parent_id int, region string, acronym string")
    act = spark.createDataFrame([("n", "s", i, 1.0) for i in (2, 4, 5, 6)], "net string, sample string, id int, value double")
    total = _by(hierarchy.tree_sum(regions, act), "value", "id")
    assert total[997] == 4 and total[567] == 3 and total[1] == 1 and total[3] == 1
    assert {r["region"] for r in hierarchy.drop_layer_1(regions).collect()} == {r[2] for r in REGIONS} - {"Visual areas, layer 1"}
    assert {r["region"] for r in hierarchy.trim(regions).collect()} == {"Visual areas", "Dentate gyrus", "Thalamus"}
    groups = _by(hierarchy.grouped(regions), "anatomical_group", "acronym")
    assert groups["VIS1"] == "Sensory cortices" and groups["TH"] == "Thalamus" and groups["fiber"] is None
    assert hierarchy.colored(hierarchy.grouped(regions)).filter("anatomical_group = 'Thalamus' AND color IS NOT NULL").count() == 1
    empty = spark.createDataFrame([("n", "s", 2, 0.0), ("n", "s", 4, 1.0)], "net string, sample string, id int, value double")
    assert 2 not in {r["id"] for r in hierarchy.drop_uncounted_children(regions, empty).collect()}


def test_ingest(spark, tmp_path) -> None:  # noqa: ANN001
    head = "id,region,acronym,x4,x5,x6,x7,parent_id,parent_acronym\n"
    lines = [f"{i},{r if ',' not in r else chr(34) + r + chr(34)},{a.replace('.', '-')},,,,,{p or ''},\n" for i, p, r, a in REGIONS]
    (tmp_path / "ids.csv").write_text(head + "".join(lines) + "77,Unlabeled,un,,,,,997,\n")
    (tmp_path / "d").mkdir()
    (tmp_path / "d/e_s1_L_fos_ctl_Annotated_counts.csv").write_text("2,3\n4,1,extra\nbad\n999,5\n2,100\n")
    (tmp_path / "d/e_s2_R_fos_exp_Annotated_counts.csv").write_text("5,2\n")
    regions, samples, act = counts.ingest(spark, str(tmp_path / "ids.csv"), str(tmp_path / "d"), balanced=False)
    assert {(r["subject"], r["hemisphere"], r["group"]) for r in samples.collect()} == {("s1", "L", "ctl"), ("s2", "R", "exp")}
    got = {(r["sample"][:4], r["region"]): r["value"] for r in act.collect()}
    assert got["e_s1", "VIS"] == 3 and got["e_s1", "root"] == 4 and got["e_s2", "TH"] == 2
    assert regions.filter("acronym = 'un'").count() == 0 and ("e_s1", "fiber") not in got


def test_factor_level_order(spark) -> None:  # noqa: ANN001
    s = spark.createDataFrame([("b", "x"), ("a", "x"), ("a", "y")], "g string, s string")
    assert [r["level"] for r in prep.level_order(s, ["g", "s"]).orderBy("level_idx").collect()] == ["a.x", "b.x", "a.y"]


# Inference and reports.


def test_permutations_are_permutations(spark) -> None:  # noqa: ANN001
    s = spark.createDataFrame([(f"s{k}", "a" if k < 4 else "b") for k in range(9)], "sample string, level string")
    got = inference.permuted_labels(s, 5).groupBy("rep", "level").count().collect()
    assert {(r["rep"], r["level"]): r["count"] for r in got} == {(k, lv): n for k in range(6) for lv, n in (("a", 4), ("b", 5))}
    true = inference.permuted_labels(s, 5).filter("rep = 0").join(s.withColumnRenamed("level", "own"), "sample")
    assert true.filter("level != own").count() == 0


def test_p_rules(spark) -> None:  # noqa: ANN001
    rows = [(f"{k}|{lv}", "n", "m", v) for k, d in enumerate((1.0, 1.0, 0.5, -2.0)) for lv, v in (("a", d), ("b", 0.0))]
    m = spark.createDataFrame(rows, "net string, node string, metric string, value double")
    d = inference.contrasts(m)
    assert inference.p_values(d).first()["p_value"] == pytest.approx(1 / 3)
    assert inference.p_values(d, ">=").first()["p_value"] == pytest.approx(2 / 3)
    assert inference.contrasts(m, first_minus_second=False).first()["contrast"] == "b ~ a"


def test_spectral_divergence() -> None:
    a, b = np.ones((5, 5)) - np.eye(5), np.diag(np.ones(4), 1) + np.diag(np.ones(4), -1)
    assert inference.entropy_similarity({"x": a, "y": a})["KL"] == pytest.approx(0, abs=1e-12)
    assert inference.entropy_similarity({"x": a, "y": b})["KL"] > 0.01


def test_anogva_is_uniform_under_the_null(spark) -> None:  # noqa: ANN001
    got = _by(inference.anogva_simulation(spark, subjects=20, size=8, runs=20, resamples=20), "rejected", "alpha")
    assert got[0.0] <= 0.3 and got[max(got)] == 1


def test_welch_and_regression(spark) -> None:  # noqa: ANN001
    x = [1.0, 2.0, 3.0, 4.0, 6.0]
    y = [2.0, 4.0, 8.0, 9.0]
    v = spark.createDataFrame([("r", "a", k) for k in x] + [("r", "b", k) for k in y], "region string, arm string, value double")
    r = activity.welch_test(v, ["region"], "arm").first()
    se = math.sqrt(np.var(x, ddof=1) / 5 + np.var(y, ddof=1) / 4)
    assert r["t"] == pytest.approx((np.mean(x) - np.mean(y)) / se) and r["lower"] < r["diff"] < r["upper"] and 0 < r["p"] < 1
    pts = spark.createDataFrame([("k", float(i), 2.0 * i + (i % 2)) for i in range(10)], "g string, x double, y double")
    fit = activity.regression_test(pts, ["g"], "x", "y").first()
    slope, intercept = np.polyfit(range(10), [2.0 * i + (i % 2) for i in range(10)], 1)
    assert fit["beta"] == pytest.approx(slope) and fit["intercept"] == pytest.approx(intercept) and fit["lower"] < slope < fit["upper"]
    assert fit["p"] == pytest.approx(fit["model_p"], abs=1e-12)


def test_adjusted_p(spark) -> None:  # noqa: ANN001
    p = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None)], "k int, p double")
    assert _by(adjusted(p, "p", "bh"), "p_adjusted", "k") == {1: pytest.approx(0.03), 2: pytest.approx(0.04), 3: pytest.approx(0.04), 4: None}
    assert _by(adjusted(p, "p", "holm"), "p_adjusted", "k") == {1: pytest.approx(0.03), 2: pytest.approx(0.06), 3: pytest.approx(0.06), 4: None}
    with pytest.raises(ValueError, match="unknown"):
        adjusted(p, "p", "other")


def test_adjusted_p_of_large_groups(spark) -> None:  # noqa: ANN001
    """Ties, nulls and a group without a name over several ranges; no step goes over a group's rows again for each row."""
    rng = np.random.default_rng(5)
    p = np.round(rng.random(3000) ** 3, 4)
    rows = [(k, None if k % 3 == 0 else "one", None if k % 10 == 0 else float(p[k])) for k in range(3000)]
    df = spark.createDataFrame(rows, "k int, family string, p double").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for method in ("bh", "holm", "bonferroni"):
            for by in (["family"], []):
                made = adjusted(df, "p", method, by)
                assert made.columns == ["k", "family", "p", "p_adjusted"] and "currentrow$(), unboundedfollowing$()" not in made._jdf.queryExecution().toString()
                got = _by(made, "p_adjusted", "k")
                assert len(got) == 3000 and all(got[k] is None for k in range(0, 3000, 10))
                for own in (None, "one") if by else (0,):
                    at = [k for k, f, x in rows if x is not None and (not by or f == own)]
                    x, m = p[at], len(at)
                    place = np.argsort(x, kind="stable")
                    rank = np.empty(m)
                    rank[place] = np.arange(1, m + 1)
                    want = x * m
                    if method == "bh":
                        want[place] = np.minimum.accumulate((want / rank)[place][::-1])[::-1]
                    elif method == "holm":
                        want[place] = np.maximum.accumulate((x * (m - rank + 1))[place])
                    assert [got[k] for k in at] == np.minimum(want, 1).tolist()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_hubs_use_exact_names(spark) -> None:  # noqa: ANN001
    rows = [("a ~ ab", "n", "m", 1.0, 0.01), ("ab ~ b", "n", "m", 0.0, 0.01), ("a ~ b", "n", "m", 2.0, 0.5)]
    s = report.significant(spark.createDataFrame(rows, "contrast string, node string, metric string, diff double, p_value double"))
    score = _by(report.hubs(s), "score", "group")
    assert score == {"a": 1, "ab": -2, "b": 1}


def test_noncounted_child_reads_all_counts(spark) -> None:  # noqa: ANN001
    from netloom.plans import data, queries

    sf = "/root/testdata/sf0.001"
    tree = {r["id"]: r["parent_id"] for r in data.tree(spark, sf).collect()}
    counted = {r["l_suppkey"] + 1000 for r in data.table(spark, sf, "lineitem").filter("l_quantity > 0").select("l_suppkey").distinct().collect()}
    parents = {tree[k] for k in counted if k in tree}
    assert max(counted) > 1005
    assert {r["id"] for r in queries.noncounted_child(spark, sf).collect()} == {k for k, up in tree.items() if up is None or up in parents}


def test_children_that_count_nothing_go(spark) -> None:  # noqa: ANN001
    tree = spark.createDataFrame([(0, None, "root"), (1, 0, "a"), (2, 0, "b"), (3, 1, "a1"), (4, 1, "a2"), (5, 2, "b1")], "id long, parent_id long, region string")
    values = spark.createDataFrame([(1, 5.0), (3, 0.0), (4, 2.0), (5, 0.0)], "id long, value double")
    assert {r["id"] for r in hierarchy.drop_uncounted_children(tree, values).collect()} == {0, 1, 2, 3, 4}
