"""Metrics over paths and spectra.

Shortest paths run from blocks of sources on adjacency lists, a block a task, and what they add to other nodes is summed
in Spark; spectra and local efficiency are dense numpy inside one task for each network."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.operators.network import map_networks, to_edge_list, to_matrix, with_isolated

METRICS = ("nodal_efficiency", "betweenness", "closeness", "eigenvector")


def lengths(m: np.ndarray) -> np.ndarray:
    """Edge lengths 1 / |weight|; no edge is infinitely long."""
    with np.errstate(divide="ignore"):
        d = 1 / np.abs(m)
    np.fill_diagonal(d, 0)
    return d


def all_distances(d: np.ndarray) -> np.ndarray:
    """Shortest distances between all nodes."""
    d = d.copy()
    for k in range(len(d)):
        np.minimum(d, d[:, k, None] + d[None, k, :], out=d)
    return d


def efficiency(m: np.ndarray) -> np.ndarray:
    """Mean inverse distance of each node to the others."""
    n = len(m)
    if n < 2:
        return np.zeros(n)
    with np.errstate(divide="ignore"):
        inv = 1 / all_distances(lengths(m))
    np.fill_diagonal(inv, 0)
    return inv.sum(axis=1) / (n - 1)


def local_efficiency(m: np.ndarray, of: Sequence[int] | None = None) -> np.ndarray:
    """Efficiency of the graph of each node's neighbours; of some nodes only, if they are given."""
    out = np.zeros(len(m))
    for v in range(len(m)) if of is None else of:
        near = np.flatnonzero(m[v])
        if len(near) > 1:
            out[v] = efficiency(m[np.ix_(near, near)]).mean()
    return out


def eigenvector(m: np.ndarray) -> np.ndarray:
    """The leading eigenvector, scaled to a largest entry of 1."""
    v = np.linalg.eigh(m)[1][:, -1]
    top = v[np.argmax(np.abs(v))]
    return v / top if top else np.zeros(len(m))


def node_values(m: np.ndarray, metrics: Sequence[str]) -> dict[str, np.ndarray]:
    """The metrics that take a whole network at once."""
    out = {}
    for name in metrics:
        if name not in ("eigenvector", "local_efficiency"):
            raise ValueError(f"unknown metric {name!r}")
        if not (m != 0).any():
            out[name] = np.zeros(len(m))
        else:
            out[name] = eigenvector(m) if name == "eigenvector" else local_efficiency(m)
    return out


#: Sources that one task takes of a network it has read.
SOURCES_A_TASK = 64
#: The metrics that come from shortest paths of one source after another.
SHARDED = ("nodal_efficiency", "betweenness", "closeness")


class Adjacency:
    """A network as one list of neighbours and edge lengths, 1 / |weight|, after another."""

    def __init__(self, n: int, i: np.ndarray, j: np.ndarray, weight: np.ndarray) -> None:
        real = weight != 0
        i, j, length = np.concatenate([i[real], j[real]]), np.concatenate([j[real], i[real]]), np.tile(1 / np.abs(weight[real]), 2)
        order = np.lexsort((j, i))
        self.n, self.at = n, np.searchsorted(i[order], np.arange(n + 1)).tolist()
        self.to, self.length = j[order].tolist(), length[order].tolist()

    def distances(self, source: int) -> tuple[list[float], list[int]]:
        """(distances, reached nodes in order of distance) from a source, with a heap."""
        distance, order, heap = [np.inf] * self.n, [], [(0.0, source)]
        distance[source] = 0.0
        while heap:
            d, v = heapq.heappop(heap)
            if d > distance[v]:
                continue
            order.append(v)
            for k in range(self.at[v], self.at[v + 1]):
                far = d + self.length[k]
                if far < distance[self.to[k]]:
                    distance[self.to[k]] = far
                    heapq.heappush(heap, (far, self.to[k]))
        return distance, order

    def dependencies(self, source: int, distance: list[float], order: list[int], tolerance: float = 1e-12) -> list[float]:
        """For each node, the shares of the shortest paths from the source that pass through it, over all ends. Lengths
        that differ by rounding only are equal."""
        paths, before = [0.0] * self.n, [[] for _ in range(self.n)]
        paths[source] = 1.0
        for v in order[1:]:
            near = distance[v]
            for k in range(self.at[v], self.at[v + 1]):
                u = self.to[k]
                if abs(distance[u] + self.length[k] - near) <= tolerance * (1 + near):
                    before[v].append(u)
                    paths[v] += paths[u]
        out = [0.0] * self.n
        for v in reversed(order[1:]):
            for u in before[v]:
                out[u] += paths[u] / paths[v] * (1 + out[v])
        out[source] = 0.0
        return out


def _from_sources(edges: DataFrame, nodes: DataFrame, metrics: Sequence[str], sources_a_task: int) -> DataFrame:
    """net, node and a column for each metric of SHARDED."""
    between = "betweenness" in metrics
    order = F.row_number().over(W.partitionBy("net").orderBy("node")) - 1
    work = nodes.select("net", "node").distinct().select("net", "node", order.alias("place"))
    work = work.select("net", "node", F.expr(f"CAST(place DIV {sources_a_task} AS BIGINT)").alias("block"))
    copies = edges.join(work.select("net", "block").distinct().toDF("net", "to_block"), "net").select(*(F.col(c).alias(c) for c in ("net", "src", "dst", "weight")), F.col("to_block").alias("block"))
    sizes = work.groupBy("net").agg(F.count(F.lit(1)).alias("n"))
    asked = work.join(sizes, "net")

    def run(pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame({"net": [], "node": [], "nodal_efficiency": [], "closeness": [], "betweenness": []})
        names, i, j, weight = to_edge_list(pdf, own["node"].to_numpy(str))
        graph, n = Adjacency(len(names), i, j, weight), int(own["n"].iloc[0])
        total = np.zeros(len(names))
        rows = {"nodal_efficiency": np.full(len(names), np.nan), "closeness": np.full(len(names), np.nan)}
        mine = np.searchsorted(names, own["node"].to_numpy(str))
        for s in mine.tolist():
            distance, reached = graph.distances(s)
            far = np.array(distance)[reached[1:]]
            rows["nodal_efficiency"][s] = (1 / far).sum() / (n - 1) if n > 1 else 0.0
            rows["closeness"][s] = len(far) / far.sum() if len(far) else 0.0
            if between:
                total += graph.dependencies(s, distance, reached)
        out = pd.DataFrame({"net": own["net"].iloc[0], "node": names} | rows | {"betweenness": total / 2})
        return out[out["nodal_efficiency"].notna() | (out["betweenness"] != 0)]

    parts = copies.groupBy("net", "block").cogroup(asked.groupBy("net", "block")).applyInPandas(run, "net string, node string, nodal_efficiency double, closeness double, betweenness double")
    # A node is a source in one block; to its betweenness all blocks add.
    return parts.groupBy("net", "node").agg(F.max("nodal_efficiency").alias("nodal_efficiency"), F.max("closeness").alias("closeness"), F.sum("betweenness").alias("betweenness")).select("net", "node", *metrics)


def path_metrics(edges: DataFrame, nodes: DataFrame, metrics: Sequence[str] = METRICS, normalized: bool = False, sources_a_task: int = SOURCES_A_TASK) -> DataFrame:
    """net, node and a column for each metric; a network without edges has zeros.

    What comes from shortest paths is computed by blocks of sources (SHARDED), so a network is spread over tasks; the
    eigenvector and local efficiency take one task for each network."""
    metrics = tuple(m.lower() for m in metrics)
    spread, whole = [m for m in metrics if m in SHARDED], [m for m in metrics if m not in SHARDED]
    out = _from_sources(edges, nodes, spread, sources_a_task) if spread else None
    if normalized and "nodal_efficiency" in spread:
        most = F.max("nodal_efficiency").over(W.partitionBy("net"))
        out = out.withColumn("nodal_efficiency", F.when(most > 0, F.col("nodal_efficiency") / most).otherwise(F.col("nodal_efficiency")))
    if whole:

        def run(net: str, names: np.ndarray, m: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame({"net": net, "node": names} | node_values(m, whole))

        dense = map_networks(with_isolated(edges, nodes), run, "net string, node string, " + ", ".join(f"{m} double" for m in whole))
        out = dense if out is None else out.join(dense, ["net", "node"])
    return out.select("net", "node", *metrics)


def giant_sizes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """net, gc_size: nodes of the largest component. For many networks of a size that fits a task; `nodal.components`
    serves networks of any size."""

    def run(net: str, names: np.ndarray, m: np.ndarray) -> pd.DataFrame:
        label = np.arange(len(m))
        linked = (m != 0) | np.eye(len(m), dtype=bool)
        while True:
            new = np.where(linked, label[None, :], len(m)).min(axis=1)
            new = new[new]
            if (new == label).all():
                return pd.DataFrame({"net": [net], "gc_size": [int(np.bincount(label).max())]})
            label = new

    return map_networks(with_isolated(edges, nodes), run, "net string, gc_size long")


#: Removals that one task computes of a network it has read.
REMOVALS_A_TASK = 16


def efficiency_loss(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """net, node, global_loss, local_loss: relative loss of mean efficiency, and of mean local efficiency, when the node
    is removed.

    A network's edges go once to each block of removed nodes. What the whole network has is computed once there, and a
    removal changes the local efficiency of the node's neighbours only."""
    order = F.row_number().over(W.partitionBy("net").orderBy("node")) - 1
    work = nodes.select("net", "node").distinct().select("net", "node", order.alias("place"))
    work = work.select("net", "node", F.expr(f"place DIV {REMOVALS_A_TASK}").alias("block"))
    full = with_isolated(edges, nodes)
    copies = full.join(work.select("net", "block").distinct().toDF("net", "to_block"), "net").select(*(F.col(c).alias(c) for c in full.columns), F.col("to_block").alias("block"))

    def run(pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        names, m = to_matrix(pdf)
        whole, local = efficiency(m).mean(), local_efficiency(m)
        rows = []
        for node in own["node"]:
            keep = names != node
            cut, left = m[np.ix_(keep, keep)], local[keep]
            near = np.flatnonzero(m[~keep][0][keep])
            left[near] = local_efficiency(cut, near)[near]
            pairs = [(whole, efficiency(cut).mean() if len(cut) else 0.0), (local.mean(), left.mean() if len(cut) else 0.0)]
            rows.append((own["net"].iloc[0], node, *(1 - b / a if a else 0.0 for a, b in pairs)))
        return pd.DataFrame(rows, columns=["net", "node", "global_loss", "local_loss"])

    return copies.groupBy("net", "block").cogroup(work.groupBy("net", "block")).applyInPandas(run, "net string, node string, global_loss double, local_loss double")
