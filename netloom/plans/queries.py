"""The library's queries: name -> (spark, sf_dir) -> DataFrame. Doubles are rounded to six places."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.functions import exprs
from netloom.operators import activity as act
from netloom.operators import community, hierarchy, inference, network, nodal, partition, paths, prep, report
from netloom.plans import data as d
from netloom.sources import counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = lambda spark, sf_dir: d.rounded(fn(spark, sf_dir))
    return fn


def _absolute(spark: SparkSession, sf: str) -> DataFrame:
    return d.graph(spark, sf).withColumn("weight", F.abs("weight"))


def _constant(activity: DataFrame) -> DataFrame:
    return activity.withColumn("value", F.when(F.col("region") == "Brand#11", F.lit(0.0)).otherwise(F.col("value")))


def _holed(spark: SparkSession, sf: str) -> DataFrame:
    """Activity with one region that never varies."""
    return _constant(d.activity(spark, sf))


def _nulled(spark: SparkSession, sf: str) -> DataFrame:
    """Activity with small values null, one region that never varies, and each fifth region twice, apart by 2."""
    a = _holed(spark, sf).withColumn("value", F.when(F.expr("value >= 20 OR region = 'Brand#11'"), F.col("value")))
    again = a.filter("region LIKE '%5'").withColumn("value", F.col("value") + 2)
    return a.unionByName(again)


@query
def brand_network_strength(spark: SparkSession, sf: str) -> DataFrame:
    return nodal.signed_strength(d.graph(spark, sf), d.nodes(spark, sf))


@query
def signed_strength_asym(spark: SparkSession, sf: str) -> DataFrame:
    return nodal.signed_strength(d.graph(spark, sf), d.nodes(spark, sf))


@query
def signed_strength_sym(spark: SparkSession, sf: str) -> DataFrame:
    return nodal.signed_strength(d.graph(spark, sf), d.nodes(spark, sf), sym=True)


@query
def corr_pearson(spark: SparkSession, sf: str) -> DataFrame:
    return d.edges(spark, sf)


@query
def corr_spearman(spark: SparkSession, sf: str) -> DataFrame:
    return network.corr_edges(d.activity(spark, sf), "spearman")


@query
def corr_by_group(spark: SparkSession, sf: str) -> DataFrame:
    """A net for each level of two factors."""
    li = d.table(spark, sf, "lineitem").join(d.table(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    cells = li.groupBy(F.concat_ws(".", "l_returnflag", "l_linestatus").alias("net"), F.date_format("l_shipdate", "yyyy-MM").alias("sample"), F.col("p_brand").alias("region")).agg(F.sum("l_quantity").alias("value"))
    return network.corr_edges(cells)


@query
def corr_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    e = d.table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("net"), F.col("vec_id").alias("sample"), F.posexplode("embedding").alias("pos", "value"))
    return network.corr_edges(e.select("net", "sample", F.lpad(F.col("pos").cast("string"), 2, "0").alias("region"), F.col("value").cast("double").alias("value")))


@query
def corr_gram(spark: SparkSession, sf: str) -> DataFrame:
    """corr_pearson by Gram matrices."""
    return network.gram_edges(d.activity(spark, sf))


@query
def corr_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """Pairwise-complete correlations of cells that are null, repeated, or never vary."""
    return network.corr_edges(_nulled(spark, sf))


@query
def corr_nulls_gram(spark: SparkSession, sf: str) -> DataFrame:
    """corr_nulls by tiles: blocks of 8 regions and 32 samples."""
    return network.gram_edges(_nulled(spark, sf), 8, 32)


@query
def corr_nulls_spearman(spark: SparkSession, sf: str) -> DataFrame:
    return network.corr_edges(_nulled(spark, sf), "spearman")


@query
def corr_nan_policy(spark: SparkSession, sf: str) -> DataFrame:
    return network.fill_undefined(network.corr_edges(_holed(spark, sf)))


@query
def corr_weak_link(spark: SparkSession, sf: str) -> DataFrame:
    return network.fill_undefined(network.corr_edges(_holed(spark, sf)), weak_link=3)


@query
def corr_negs_zero(spark: SparkSession, sf: str) -> DataFrame:
    return network.negatives(d.edges(spark, sf), "zero")


@query
def corr_negs_abs(spark: SparkSession, sf: str) -> DataFrame:
    return network.negatives(d.edges(spark, sf), "abs")


@query
def threshold_r(spark: SparkSession, sf: str) -> DataFrame:
    return network.threshold(d.edges(spark, sf), "r", [0.2])


@query
def threshold_grid(spark: SparkSession, sf: str) -> DataFrame:
    return network.threshold(d.edges(spark, sf), "r", [0.1, 0.2, 0.3])


@query
def threshold_cost(spark: SparkSession, sf: str) -> DataFrame:
    return network.threshold(d.edges(spark, sf), "cost", [0.25, 0.5])


@query
def norm_fisherz(spark: SparkSession, sf: str) -> DataFrame:
    return network.normalize(d.edges(spark, sf), "fisherz")


@query
def norm_max(spark: SparkSession, sf: str) -> DataFrame:
    return network.normalize(d.edges(spark, sf), "max_edge_norm")


@query
def norm_max_min(spark: SparkSession, sf: str) -> DataFrame:
    return network.normalize(d.edges(spark, sf), "max_min_norm")


@query
def degree(spark: SparkSession, sf: str) -> DataFrame:
    return nodal.degree_strength(d.graph(spark, sf), d.nodes(spark, sf)).drop("strength")


@query
def strength(spark: SparkSession, sf: str) -> DataFrame:
    return nodal.degree_strength(d.graph(spark, sf), d.nodes(spark, sf)).drop("degree")


@query
def leverage(spark: SparkSession, sf: str) -> DataFrame:
    return nodal.leverage(d.graph(spark, sf), d.nodes(spark, sf))


@query
def burt(spark: SparkSession, sf: str) -> DataFrame:
    return nodal.constraint(_absolute(spark, sf), d.nodes(spark, sf))


@query
def transitivity_local(spark: SparkSession, sf: str) -> DataFrame:
    return nodal.transitivity(d.graph(spark, sf), d.nodes(spark, sf))


@query
def components(spark: SparkSession, sf: str) -> DataFrame:
    return nodal.components(d.graph(spark, sf), d.nodes(spark, sf))


@query
def general_measures(spark: SparkSession, sf: str) -> DataFrame:
    return nodal.general_measures(d.graph(spark, sf), d.nodes(spark, sf), d.membership(spark, sf))


@query
def modularity_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return community.modularity_matrix(_absolute(spark, sf), d.nodes(spark, sf))


@query
def modularity_q(spark: SparkSession, sf: str) -> DataFrame:
    return community.q(_absolute(spark, sf), d.membership(spark, sf))


@query
def modularity_signed(spark: SparkSession, sf: str) -> DataFrame:
    return community.q_signed(d.graph(spark, sf), d.membership(spark, sf))


@query
def participation(spark: SparkSession, sf: str) -> DataFrame:
    return community.participation(d.graph(spark, sf), d.membership(spark, sf))


@query
def diversity(spark: SparkSession, sf: str) -> DataFrame:
    return community.diversity(d.graph(spark, sf), d.membership(spark, sf))


@query
def gateway_str(spark: SparkSession, sf: str) -> DataFrame:
    return community.gateway(d.graph(spark, sf), d.membership(spark, sf))


@query
def within_community_strength(spark: SparkSession, sf: str) -> DataFrame:
    return community.within_community_strength(d.graph(spark, sf), d.membership(spark, sf))


# Preparation and the tree.


@query
def clean_data(spark: SparkSession, sf: str) -> DataFrame:
    """Cells under 20 count as missing; regions missing a quarter or more go, the rest is filled with means."""
    a = d.activity(spark, sf).withColumn("value", F.when(F.col("value") >= 20, F.col("value")))
    return prep.clean(a, missing_below=0.25)


@query
def drop_zero_regions(spark: SparkSession, sf: str) -> DataFrame:
    return prep.drop_zero_regions(_holed(spark, sf))


@query
def lookup_fill(spark: SparkSession, sf: str) -> DataFrame:
    return d.activity(spark, sf)


@query
def collapse_mean(spark: SparkSession, sf: str) -> DataFrame:
    o = d.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("net"), F.date_format("o_orderdate", "yyyy-MM").alias("sample"), "o_orderstatus", F.lit("all").alias("region"), F.ln("o_totalprice").alias("value"))
    return prep.collapse(o, ["net", "sample"])


@query
def zscore_by_level(spark: SparkSession, sf: str) -> DataFrame:
    return prep.z_by_level(d.activity(spark, sf), ["net"])


@query
def scale_factor(spark: SparkSession, sf: str) -> DataFrame:
    return prep.scale_by_factor(d.activity(spark, sf), "net")


@query
def level_vs_corr(spark: SparkSession, sf: str) -> DataFrame:
    return prep.level_profile(d.activity(spark, sf), d.edges(spark, sf))


@query
def filename_factors(spark: SparkSession, sf: str) -> DataFrame:
    """Names of the counts files that nations would have."""
    n = d.table(spark, sf, "nation").select(F.format_string("exp1_s%d_%s_fos_%s_Annotated_counts.csv", "n_nationkey", F.when(F.col("n_regionkey") > 1, "L").otherwise("R"), F.replace("n_name", F.lit("_"), F.lit("."))).alias("file"))
    return n.select("file", *counts.factors_of(F.col("file")))


@query
def tree_sum(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.tree_sum(d.tree(spark, sf), d.counts(spark, sf))


@query
def subtree_filter(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.subtree(d.tree(spark, sf), 2).select("id", "parent_id", "region")


@query
def pattern_trim(spark: SparkSession, sf: str) -> DataFrame:
    """Leaves of the tree whose name has a 7, except one that stays; trimming with other rules."""
    first = "Supplier#000000007"
    return hierarchy.trim(d.tree(spark, sf), root=0, removed=(3,), rules=((("7",), (first,)),)).select("id", "parent_id", "region")


@query
def noncounted_child(spark: SparkSession, sf: str) -> DataFrame:
    """Parents whose children count nothing of their own lose them."""
    return hierarchy.drop_uncounted_children(d.tree(spark, sf), d.counts(spark, sf)).select("id", "parent_id", "region")


@query
def anatomical_group_map(spark: SparkSession, sf: str) -> DataFrame:
    groups = spark.sql("SELECT * FROM VALUES ('root', 'other'), ('AFRICA', 'south'), ('ASIA', 'east'), ('Nation_3', 'own'), ('NATION_3', 'own') AS t(root, anatomical_group)")
    return hierarchy.grouped(d.tree(spark, sf), groups).select("id", "region", "anatomical_group")


@query
def del_isolated(spark: SparkSession, sf: str) -> DataFrame:
    strong = d.graph(spark, sf).filter(F.abs("weight") > 0.3)
    return network.drop_isolated(d.nodes(spark, sf), strong)


@query
def nodes_match_zero_fill(spark: SparkSession, sf: str) -> DataFrame:
    return network.dense(d.graph(spark, sf), d.nodes(spark, sf))


@query
def match_net_to_comm(spark: SparkSession, sf: str) -> DataFrame:
    """Edges between the brands of two digits only."""
    m = d.membership(spark, sf).filter("comm IN (1, 2)")
    return network.match_to_membership(d.graph(spark, sf), m)[0]


@query
def threshold_p_rcrit(spark: SparkSession, sf: str) -> DataFrame:
    """p under 0.05 by the critical correlation of the number of samples."""
    return network.threshold(d.edges(spark, sf), "p", [0.05])


@query
def corr_p_values(spark: SparkSession, sf: str) -> DataFrame:
    return network.with_p(d.edges(spark, sf))


@query
def boot_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return network.boot_ratio(d.activity(spark, sf), resamples=100).withColumn("ratio", F.round("ratio", 5))


# Partitions.


@query
def agreement(spark: SparkSession, sf: str) -> DataFrame:
    return partition.agreement(d.partitions(spark, sf))


@query
def perm_model(spark: SparkSession, sf: str) -> DataFrame:
    return partition.perm_model(d.partitions(spark, sf))


@query
def local_perm_model(spark: SparkSession, sf: str) -> DataFrame:
    return partition.local_perm_model(d.partitions(spark, sf))


@query
def relabel_partitions(spark: SparkSession, sf: str) -> DataFrame:
    return partition.relabel(d.partitions(spark, sf))


@query
def unique_partitions(spark: SparkSession, sf: str) -> DataFrame:
    return partition.unique_partitions(d.partitions(spark, sf).unionByName(d.partitions(spark, sf).withColumn("part", F.col("part") + 100)))


@query
def ami_pairs(spark: SparkSession, sf: str) -> DataFrame:
    p = d.partitions(spark, sf)
    both = p.alias("x").join(p.alias("y"), F.expr("x.node = y.node AND x.part < y.part")).select(F.col("x.part").alias("a"), F.col("y.part").alias("b"), F.col("x.comm").alias("c1"), F.col("y.comm").alias("c2"))
    return partition.ami(both, ["a", "b"], "c1", "c2")


@query
def normal_approx_null(spark: SparkSession, sf: str) -> DataFrame:
    return partition.normal_null(partition.local_perm_model(d.partitions(spark, sf)))


@query
def sample_approx_null(spark: SparkSession, sf: str) -> DataFrame:
    """Quantiles of 10,000 draws are those of the exact distribution of the number of co-memberships, or next to them."""
    local = partition.local_perm_model(d.partitions(spark, sf))
    exact = partition.exact_null(local).withColumnRenamed("p", "exact")
    return partition.sampled_null(local).join(exact, ["net", "node"]).select("net", "node", "exact", (F.abs(F.col("p") - F.col("exact")) < 1.001 / 6).alias("near"))


def _facts(edges: DataFrame, nodes: DataFrame, partitions: DataFrame, mod: str = "neg_asym") -> DataFrame:
    """What a search's partitions have to be: of all nodes, no worse than one community, and not improved by a move."""
    q = partition.partition_quality(edges, nodes, partitions, mod)
    return q.select("net", "part", "n_nodes", (F.col("quality") >= F.col("whole") - 1e-9).alias("no_worse"), (F.col("best_move") <= 1e-8).alias("settled"))


@query
def louvain(spark: SparkSession, sf: str) -> DataFrame:
    g, n = d.graph(spark, sf), d.nodes(spark, sf)
    return _facts(g, n, partition.partition_runs(g, n, runs=5))


@query
def modularity_max(spark: SparkSession, sf: str) -> DataFrame:
    """The deterministic search by eigenvectors; its divisions never lose, single moves may still gain."""
    g, n = _absolute(spark, sf), d.nodes(spark, sf)
    return _facts(g, n, partition.partition_runs(g, n, optimizer="spectral"), "modularity").drop("settled")


@query
def multi_scale(spark: SparkSession, sf: str) -> DataFrame:
    g, n = d.graph(spark, sf), d.nodes(spark, sf)
    p = network.checkpointed(partition.multi_scale(g, n, step=0.25))
    return _facts(g, n, p).join(p.select("net", "part", "gamma").distinct(), ["net", "part"])


@query
def gamma_range(spark: SparkSession, sf: str) -> DataFrame:
    r = partition.gamma_ranges(_absolute(spark, sf), d.nodes(spark, sf))
    return r.select("net", "gamma_max", (F.col("gamma_min") <= F.col("gamma_max")).alias("ordered"), (F.col("gamma_min") > 0).alias("above_zero"), "converged")


@query
def event_resolutions(spark: SparkSession, sf: str) -> DataFrame:
    """Resolutions of 25 even steps of the negative share, from resolution 0.5 on."""
    return partition.event_resolutions(_absolute(spark, sf), d.nodes(spark, sf), 25, low=0.5).select("net", "part", F.round("gamma", 5).alias("gamma"), "b")


@query
def event_samples(spark: SparkSession, sf: str) -> DataFrame:
    g, n = _absolute(spark, sf), d.nodes(spark, sf)
    return _facts(g, n, partition.event_samples(g, n, n=40, samples=20))


def _brand_partitions(spark: SparkSession, sf: str, n: int, comm: str) -> DataFrame:
    """Partitions 1 to n of the brands; comm is SQL of part, number and rest (the brand's number and its rest by five)."""
    names = d.table(spark, sf, "part").select(F.col("p_brand").alias("node")).distinct()
    names = names.withColumn("number", F.regexp_extract("node", r"(\d+)$", 1).cast("int")).withColumn("rest", F.expr("number % 5"))
    return names.crossJoin(spark.range(1, n + 1).withColumnRenamed("id", "part")).select(F.lit("brands").alias("net"), "part", "node", F.expr(comm).cast("int").alias("comm"))


@query
def agreement_less_null(spark: SparkSession, sf: str) -> DataFrame:
    return partition.agreement_less_null(d.partitions(spark, sf))


@query
def consensus(spark: SparkSession, sf: str) -> DataFrame:
    """Every node once, communities numbered from 1, runs that came to agree, and labels that say what agrees: pairs within
    communities agree beyond chance in sum (single nodes hold nothing), and more than pairs across (of which one community of
    all has none). Where all runs found one community of all nodes, each pair agrees just as chance has it and no labels hold
    anything; then each node has to stay single."""
    parts = network.checkpointed(partition.partition_runs(d.graph(spark, sf), d.nodes(spark, sf), runs=20))
    c = network.checkpointed(partition.consensus(parts, runs=20))
    pairs = partition.agreement_less_null(parts)
    pairs = pairs.join(c.select("net", F.col("node").alias("src"), F.col("comm").alias("x")), ["net", "src"]).join(c.select("net", F.col("node").alias("dst"), F.col("comm").alias("y")), ["net", "dst"])
    held = pairs.groupBy("net").agg(F.avg(F.when(F.expr("x = y"), F.col("weight"))).alias("within"), F.avg(F.when(F.expr("x != y"), F.col("weight"))).alias("across"), (F.max(F.abs("weight")) < 1e-9).alias("nothing"))
    facts = c.groupBy("net").agg(F.count("node").alias("n_nodes"), F.countDistinct("node").alias("distinct_nodes"), (F.max("comm") == F.countDistinct("comm")).alias("numbered"), F.bool_and("converged").alias("converged"), (F.countDistinct("comm") == F.count("node")).alias("alone"))
    beats = lambda fact: F.when(F.col("nothing"), F.col("alone")).otherwise(F.expr(fact))
    return facts.join(held, "net").withColumn("beats_one", beats("within > across")).withColumn("beats_single", beats("within > 0")).drop("within", "across", "nothing", "alone")


@query
def consensus_planted(spark: SparkSession, sf: str) -> DataFrame:
    """Fifteen partitions of the brands by rest, each with some brands astray: the rests come back."""
    return partition.consensus(_brand_partitions(spark, sf, 15, "IF(number % 15 + 1 = part, 9, rest)"), runs=20)


@query
def hier_planted(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the partitions have two groups of rests, half the rests: levels of both, and then of single brands."""
    p = _brand_partitions(spark, sf, 20, "IF(part % 2 = 0, IF(rest <= 1, 1, 2), rest)")
    return partition.hierarchical_consensus(p, runs=20)


def _planted_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Brands with the same rest by five are linked by 1, others by a tenth."""
    nodes = d.table(spark, sf, "part").select(F.lit("brands").alias("net"), F.col("p_brand").alias("node")).distinct()
    pairs = nodes.withColumnRenamed("node", "src").join(nodes.withColumnRenamed("node", "dst"), "net").filter("src < dst")
    rest = lambda end: F.regexp_extract(end, r"(\d+)$", 1).cast("int") % 5
    return pairs.withColumn("weight", F.when(rest("src") == rest("dst"), F.lit(1.0)).otherwise(F.lit(0.1))), nodes


@query
def searches_planted(spark: SparkSession, sf: str) -> DataFrame:
    """What each search finds in a network of five plain communities, by value."""
    g, n = _planted_graph(spark, sf)
    found = [partition.relabel(partition.partition_runs(g, n, optimizer=name)).select(F.lit(name).alias("search"), "node", "comm") for name in ("louvain", "signed_louvain", "spectral", "sparse_louvain", "sparse_signed_louvain")]
    out = found[0]
    for each in found[1:]:
        out = out.unionByName(each)
    return out


@query
def hier_consensus(spark: SparkSession, sf: str) -> DataFrame:
    """Levels that start from one community and only ever divide communities."""
    parts = network.checkpointed(partition.event_samples(_absolute(spark, sf), d.nodes(spark, sf), n=40, samples=20))
    h = network.checkpointed(partition.hierarchical_consensus(parts, runs=20))
    up = h.select("net", (F.col("level") + 1).alias("level"), "node", F.col("comm").alias("above"))
    pure = h.join(up, ["net", "level", "node"]).groupBy("net", "level", "comm").agg(F.countDistinct("above").alias("parents")).groupBy("net").agg(F.max("parents").alias("parents"))
    first = h.filter("level = 1").groupBy("net").agg(F.count("node").alias("n_nodes"), F.countDistinct("comm").alias("first_communities"), F.bool_and("converged").alias("converged"))
    return first.join(pure, "net", "left").select("net", "n_nodes", "first_communities", F.coalesce("parents", F.lit(1)).alias("parents"), "converged")


@query
def clust_comp(spark: SparkSession, sf: str) -> DataFrame:
    """Fixed partitions against the brands' first digit."""
    p = d.partitions(spark, sf)
    m = p.select("net", "node").distinct().withColumn("comm", F.substring("node", 7, 1).cast("int"))
    return partition.ami_to(p, m)


@query
def group_ami(spark: SparkSession, sf: str) -> DataFrame:
    p = d.partitions(spark, sf)
    return partition.ami_between(p.select(F.format_string("p%d", "part").alias("net"), "node", "comm"))


# Paths.


@query
def nodal_efficiency(spark: SparkSession, sf: str) -> DataFrame:
    return paths.path_metrics(d.graph(spark, sf), d.nodes(spark, sf), ("nodal_efficiency",))


@query
def betweenness(spark: SparkSession, sf: str) -> DataFrame:
    return paths.path_metrics(d.graph(spark, sf), d.nodes(spark, sf), ("betweenness",))


@query
def closeness(spark: SparkSession, sf: str) -> DataFrame:
    return paths.path_metrics(d.graph(spark, sf), d.nodes(spark, sf), ("closeness",))


@query
def eigenvector(spark: SparkSession, sf: str) -> DataFrame:
    return paths.path_metrics(d.graph(spark, sf), d.nodes(spark, sf), ("eigenvector",))


@query
def efficiency_loss(spark: SparkSession, sf: str) -> DataFrame:
    return paths.efficiency_loss(d.graph(spark, sf), d.nodes(spark, sf))


@query
def gateway_bet(spark: SparkSession, sf: str) -> DataFrame:
    return community.gateway(d.graph(spark, sf), d.membership(spark, sf), "bet")


@query
def nodal_measures(spark: SparkSession, sf: str) -> DataFrame:
    """All nodal metrics in one table."""
    return nodal.nodal_measures(d.graph(spark, sf), d.nodes(spark, sf))


# Inference.

REPS = 20
#: |r| that few pairs of brands pass.
REDRAW_CUT = 0.31


def _samples(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(activity, samples): a sample is a month of a return flag, its level the flag."""
    a = d.activity(spark, sf).withColumn("sample", F.concat_ws(":", "net", "sample"))
    return a.drop("net"), a.select("sample", F.col("net").alias("level")).distinct()


def _brand_comm(spark: SparkSession, sf: str) -> DataFrame:
    return d.membership(spark, sf).withColumnRenamed("net", "level")


@query
def perm_edges(spark: SparkSession, sf: str) -> DataFrame:
    a, s = _samples(spark, sf)
    return inference.edge_permutation_test(a, s, REPS, places=9)


@query
def perm_edges_replicates(spark: SparkSession, sf: str) -> DataFrame:
    """perm_edges with every replicate's differences as rows, instead of counts that add up."""
    a, s = _samples(spark, sf)
    return inference.permutation_test(a, s, lambda x: inference.edge_metrics(x, 9), REPS)


@query
def perm_edges_1000(spark: SparkSession, sf: str) -> DataFrame:
    """A thousand permutations."""
    a, s = _samples(spark, sf)
    return inference.edge_permutation_test(a, s, 1000, places=9)


@query
def perm_edges_constant(spark: SparkSession, sf: str) -> DataFrame:
    """One region never varies: its edges are undefined, and stay."""
    a, s = _samples(spark, sf)
    return inference.permutation_test(_constant(a), s, lambda x: inference.edge_metrics(x, 9), REPS)


@query
def perm_redraw(spark: SparkSession, sf: str) -> DataFrame:
    """The cut leaves some permuted networks without an edge, and their mean connectivity undefined: drawn again."""
    a, s = _samples(spark, sf)
    m = _brand_comm(spark, sf).select("node", "comm").distinct()
    fn = lambda x: inference.global_metrics(x, m, REDRAW_CUT, places=6).filter("metric IN ('mean_fc', 'density')")
    return inference.redrawn_test(a, s, fn, REPS, absolute=True, comparator=">=", most_attempts=400)


@query
def perm_nodal(spark: SparkSession, sf: str) -> DataFrame:
    a, s = _samples(spark, sf)
    return inference.permutation_test(a, s, lambda x: inference.nodal_metrics(x, metrics=inference.NODAL[:-1], places=6), REPS, first_minus_second=False)


@query
def perm_general(spark: SparkSession, sf: str) -> DataFrame:
    a, s = _samples(spark, sf)
    m = _brand_comm(spark, sf).select("node", "comm").distinct()
    return inference.permutation_test(a, s, lambda x: inference.global_metrics(x, m, places=6), REPS, absolute=True, comparator=">=")


@query
def perm_cbm(spark: SparkSession, sf: str) -> DataFrame:
    a, s = _samples(spark, sf)
    return inference.permutation_test(a, s, lambda x: inference.community_node_metrics(x, _brand_comm(spark, sf), places=6), REPS)


@query
def perm_cbm_base(spark: SparkSession, sf: str) -> DataFrame:
    a, s = _samples(spark, sf)
    return inference.permutation_test(a, s, lambda x: inference.community_node_metrics(x, _brand_comm(spark, sf), base="A", places=6), REPS, first_minus_second=False)


@query
def functional_effect(spark: SparkSession, sf: str) -> DataFrame:
    """Differences of thresholded, normalised edges between levels."""
    a, s = _samples(spark, sf)
    m = inference.edge_metrics(inference.permuted_activity(a, s, 0), 6, negs="abs", kind="r", cut=0.1, how="fisherz")
    return inference.contrasts(m).drop("rep")


@query
def anogva(spark: SparkSession, sf: str) -> DataFrame:
    a, s = _samples(spark, sf)
    return inference.anogva(a, s, 200)


# Activity.


def _balances(spark: SparkSession, sf: str) -> DataFrame:
    return d.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("sample"), F.lit("balance").alias("region"), F.col("c_mktsegment").alias("arm"), F.col("c_acctbal").alias("value"))


@query
def welch_t(spark: SparkSession, sf: str) -> DataFrame:
    return act.welch(_balances(spark, sf), ["region"], "arm")


@query
def welch_test(spark: SparkSession, sf: str) -> DataFrame:
    return act.welch_test(_balances(spark, sf), ["region"], "arm")


@query
def cohens_d_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return act.cohens_d(_balances(spark, sf), ["region"], "arm")


@query
def cohens_d_one_sample(spark: SparkSession, sf: str) -> DataFrame:
    return act.cohens_d_one_sample(_balances(spark, sf), ["region", "arm"], 4500.0)


@query
def ols_activity_connectivity(spark: SparkSession, sf: str) -> DataFrame:
    return act.regression(prep.level_profile(d.activity(spark, sf), d.edges(spark, sf)), ["net"], "mean_signal", "mean_r2")


@query
def glm_activity_connectivity(spark: SparkSession, sf: str) -> DataFrame:
    return act.regression_test(prep.level_profile(d.activity(spark, sf), d.edges(spark, sf)), ["net"], "coef_var", "mean_r2", "glm")


@query
def factor_comp(spark: SparkSession, sf: str) -> DataFrame:
    """Order prices by status, apart for each priority, with adjusted p-values."""
    o = d.table(spark, sf, "orders").filter("o_orderstatus IN ('F', 'O')")
    o = o.select(F.col("o_orderkey").cast("string").alias("sample"), F.lit("price").alias("region"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), F.ln("o_totalprice").alias("value"))
    return act.factor_comparison(o, "status", ["priority"], fdr=True)


@query
def factor_comp_boot(spark: SparkSession, sf: str) -> DataFrame:
    return act.factor_comparison(_balances(spark, sf).withColumnRenamed("arm", "segment"), "segment", boot=True, resamples=30)


@query
def activity_vs_connectivity(spark: SparkSession, sf: str) -> DataFrame:
    return act.activity_connectivity(d.activity(spark, sf))


def _some_p(spark: SparkSession, sf: str) -> DataFrame:
    """p-values with ties and a null."""
    c = d.table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("family"), F.when(F.col("c_custkey") % 50 != 0, (F.col("c_custkey") * 7919 % 1000).cast("double") / F.lit(1000.0).cast("double")).alias("p"))


@query
def p_adjust_bh(spark: SparkSession, sf: str) -> DataFrame:
    return exprs.adjusted(_some_p(spark, sf), "p", "bh", ["family"])


@query
def p_adjust_holm(spark: SparkSession, sf: str) -> DataFrame:
    return exprs.adjusted(_some_p(spark, sf), "p", "holm", ["family"])


@query
def p_adjust_bonferroni(spark: SparkSession, sf: str) -> DataFrame:
    return exprs.adjusted(_some_p(spark, sf), "p", "bonferroni", ["family"])


@query
def boot_ci(spark: SparkSession, sf: str) -> DataFrame:
    """Bootstrap t with md5 draws."""
    return act.boot_summary(act.boot_welch(_balances(spark, sf), ["region"], "arm", 30), ["region", "a", "b"], "t")


@query
def boot_p_value(spark: SparkSession, sf: str) -> DataFrame:
    points = prep.level_profile(d.activity(spark, sf), d.edges(spark, sf)).withColumnRenamed("region", "sample")
    return act.boot_summary(act.boot_regression(points, ["net"], "mean_signal", "mean_r2", 30), ["net"], "beta").select("net", "stat", "std_error", "p")


# Reports on a fixed table of results.


def _results(spark: SparkSession, sf: str) -> DataFrame:
    c = d.table(spark, sf, "part")
    p = (F.col("p_partkey") * 37 % 100).cast("double") / F.lit(500.0).cast("double")
    diff = (F.col("p_partkey") * 13 % 21).cast("double") - F.lit(10.0).cast("double")
    pair = F.element_at(F.array(F.lit("a ~ ab"), F.lit("a ~ b"), F.lit("ab ~ b")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return c.select(pair.alias("contrast"), F.col("p_name").alias("node"), F.lit("degree").alias("metric"), diff.alias("diff"), p.alias("p_value"))


@query
def significant_comps(spark: SparkSession, sf: str) -> DataFrame:
    return report.significant(_results(spark, sf))


@query
def significant_comps_trimmed(spark: SparkSession, sf: str) -> DataFrame:
    return report.significant(_results(spark, sf), trim=True, pattern="^a ~")


@query
def higher_group(spark: SparkSession, sf: str) -> DataFrame:
    return report.with_higher_group(_results(spark, sf))


@query
def comparison_hubs(spark: SparkSession, sf: str) -> DataFrame:
    return report.hubs(report.significant(_results(spark, sf)))


@query
def sig_func_effect(spark: SparkSession, sf: str) -> DataFrame:
    return report.edge_effect(_results(spark, sf))


def _counts_files(spark: SparkSession, sf: str) -> tuple[str, list[str]]:
    """The tree as an annotation table and the suppliers' counts as files, a folder for each line status and a file for each
    return flag, in the shared folder: (annotation, folders)."""
    at = f"{network.shared_folder(spark)}/counts-{uuid.uuid4().hex[:12]}"
    tree = d.tree(spark, sf)
    text = [F.lit("").alias(f"c{k}") for k in range(3, 7)]
    parents = tree.select(F.col("id").alias("up"), F.col("acronym").alias("parent_acronym"))
    tree.join(parents, F.col("parent_id") == F.col("up"), "left").select("id", "region", "acronym", *text, "parent_id", "parent_acronym").write.csv(f"{at}/regions.csv", header=True)
    signal = F.when(F.col("net") == "A", "fos").otherwise("arc")
    name = F.concat(F.lit("e_"), F.col("net"), F.lit("_L_"), signal, F.lit("_ctl_Annotated_counts.csv"))
    return f"{at}/regions.csv", counts.write_counts(d.counts(spark, sf).select(F.col("sample").alias("folder"), name.alias("file"), "id", "value"), at)


@query
def tree_closure(spark: SparkSession, sf: str) -> DataFrame:
    """All ancestors by doubling."""
    return hierarchy.deep_closure(d.tree(spark, sf))


@query
def tree_closure_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Customers in chains of 300, each under the one before: how many ancestors each has, beyond a recursive query's levels."""
    chain = d.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 300 != 0, F.col("c_custkey") - 1).alias("parent_id"))
    return hierarchy.deep_closure(chain).groupBy("id").agg(F.count(F.lit(1)).alias("ancestors"), F.max("depth").alias("depth"), F.min("ancestor_id").alias("top"))


@query
def ingest_files(spark: SparkSession, sf: str) -> DataFrame:
    """Activity of several folders of files, rolled up the tree; regions without counts stay."""
    annotation, folders = _counts_files(spark, sf)
    return counts.ingest(spark, annotation, folders, activity_zero=True)[2]


@query
def ingest_kept(spark: SparkSession, sf: str) -> DataFrame:
    """The regions that a table names, and one more; ragged reading, regions without counts dropped."""
    annotation, folders = _counts_files(spark, sf)
    keep = d.table(spark, sf, "nation").select(F.regexp_replace("n_name", "[-# ]", ".").alias("acronym"))
    return counts.ingest(spark, annotation, folders, balanced=False, keep=keep, add=["root"])[2]


@query
def ingest_samples(spark: SparkSession, sf: str) -> DataFrame:
    annotation, folders = _counts_files(spark, sf)
    return counts.ingest(spark, annotation, folders)[1]


def _shape(spark: SparkSession, sf: str) -> tuple[int, int, int, float, float]:
    """Samples, levels and regions of the activity, the mean of its values and their standard deviation."""
    a, s = _samples(spark, sf)
    moments = a.agg(F.countDistinct("region"), F.avg("value"), F.stddev_samp("value")).first()
    return s.count(), s.select("level").distinct().count(), *moments


@query
def synthetic_source(spark: SparkSession, sf: str) -> DataFrame:
    """Simulated activity of the shape, mean and spread of the table's: cells and regions of each level, and whether the
    level's mean is within six standard errors of the table's."""
    people, levels, size, mean, sd = _shape(spark, sf)
    g = counts.gaussian(spark, people, levels, size, (mean, mean), (sd, sd))
    near = F.abs(F.avg("value") - mean) <= 6 * sd / F.sqrt(F.count(F.lit(1)))
    return g.groupBy("level").agg(F.count(F.lit(1)).alias("cells"), F.countDistinct("region").alias("regions"), near.alias("near"))


@query
def community_metrics_levels(spark: SparkSession, sf: str) -> DataFrame:
    """All community metrics at two levels of a hierarchy."""
    m = d.membership(spark, sf)
    levels = m.withColumn("level", F.lit(1)).unionByName(m.select("net", "node", F.lit(2).alias("level"), (F.col("comm") % 2).alias("comm")))
    return community.community_metrics(d.graph(spark, sf), levels)


# The rest of preparation, trees and hierarchies.


@query
def clean_data_zeros(spark: SparkSession, sf: str) -> DataFrame:
    """Zeros count as missing."""
    a = d.activity(spark, sf).withColumn("value", F.when(F.col("value") >= 20, F.col("value")).otherwise(F.lit(0.0)))
    return prep.clean(a, real_zeros=False, missing_below=0.25)


@query
def norm_max_diagonal(spark: SparkSession, sf: str) -> DataFrame:
    return network.normalize(d.edges(spark, sf).withColumn("r", F.col("r") * 4), "max_norm")


@query
def leverage_strength(spark: SparkSession, sf: str) -> DataFrame:
    return nodal.leverage(_absolute(spark, sf), d.nodes(spark, sf), signed=False)


@query
def leverage_degree(spark: SparkSession, sf: str) -> DataFrame:
    return nodal.leverage(d.graph(spark, sf), d.nodes(spark, sf), weighted=False, signed=False)


def _layered(spark: SparkSession, sf: str) -> DataFrame:
    """The tree with a layer in each name."""
    return d.tree(spark, sf).withColumn("region", F.concat("region", F.lit(", layer "), (F.col("id") % 4).cast("string")))


@query
def drop_layer_1(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.drop_layer_1(_layered(spark, sf), root=2).select("id", "parent_id", "region")


@query
def trim_default_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The default rules over names that they match and keep."""
    named = d.tree(spark, sf).withColumn("region", F.get(F.array(*map(F.lit, TRIM_NAMES)), (F.col("id") % len(TRIM_NAMES)).cast("int")))
    return hierarchy.trim(named, root=0).select("id", "parent_id", "region")


#: Names that the default rules remove, keep, or do not know.
TRIM_NAMES = tuple(dict.fromkeys(name for patterns, kept in hierarchy.TRIM_RULES for name in (*kept, patterns[0] + " of some kind", "Area/part, layer 6 " + patterns[-1], "Area " + patterns[0][:9])))


@query
def color_annotation(spark: SparkSession, sf: str) -> DataFrame:
    t = d.tree(spark, sf).filter("parent_id IS NOT NULL").select("id", "parent_id", "region")
    palette = hierarchy.colored(t, "parent_id", ["red", "green", "blue"]).select("id", F.col("color").alias("of_palette"))
    return hierarchy.colored(t, "parent_id").join(palette, "id").select("id", "parent_id", "color", "of_palette")


@query
def rename_tree(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.renamed(d.tree(spark, sf), "acronym").select("id", "parent_id", "region")


@query
def level_order(spark: SparkSession, sf: str) -> DataFrame:
    """Levels of two factors' interaction, the first varying fastest."""
    return prep.level_order(d.table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority").distinct(), ["o_orderstatus", "o_orderpriority"])


def _two_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Two levels for the first three partitions, one for the others."""
    p = d.partitions(spark, sf).select(F.format_string("p%d", "part").alias("net"), "part", "node", "comm")
    return p.select("net", F.lit(1).alias("level"), "node", (F.col("comm") % 2).alias("comm")).unionByName(p.filter("part <= 3").select("net", F.lit(2).alias("level"), "node", "comm"))


@query
def group_ami_levels(spark: SparkSession, sf: str) -> DataFrame:
    return partition.ami_between(_two_levels(spark, sf))


@query
def group_ami_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """By whether nodes are together."""
    p = d.partitions(spark, sf)
    return partition.ami_between(p.select(F.format_string("p%d", "part").alias("net"), "node", "comm"), co_classification=True)


@query
def anogva_test(spark: SparkSession, sf: str) -> DataFrame:
    """Simulated experiments of the table's mean and spread, as many as its levels and as large: shares of rejected ones are
    shares, and grow with the level."""
    people, levels, size, mean, sd = _shape(spark, sf)
    t = inference.anogva_simulation(spark, people, levels, size, runs=2 * levels, resamples=20, means=(mean, mean), sds=(sd, sd))
    before = F.lag("rejected", 1, 0.0).over(Window.orderBy("alpha"))
    return t.select("alpha", F.col("rejected").between(0.0, 1.0).alias("is_share"), (F.col("rejected") >= before).alias("grows"))
