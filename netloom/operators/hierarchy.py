"""The region tree: closure, roll-up, subtrees, trimming, groups.

Regions are rows (id, parent_id, region, acronym). Trees are small tables; the closure (id, ancestor_id, depth) is made
by a recursive query and joined to activity like any dimension.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.operators.network import checkpointed

#: Subtrees that trimming removes, and where one region moves first.
REMOVED_SUBTREES = (1009, 1024, 73, 512, 354)
MOVED_REGION, MOVED_TO = "Fields of Forel", 290
#: Regions that go by name pattern, and those of them that stay. A pattern of two parts needs both.
TRIM_RULES = (
    (("[,/6]", "ayer|stratum|6"), ()),
    (("Dentate gyrus",), ("Dentate gyrus",)),
    (("stria terminalis",), ("Bed nuclei of the stria terminalis", "Bed nuclei of the stria terminalis, anterior division", "Bed nuclei of the stria terminalis, posterior division")),
    (("Mediodorsal nucleus of thalamus",), ("Mediodorsal nucleus of thalamus",)),
    (("Ventral part of the lateral geniculate complex",), ("Ventral part of the lateral geniculate complex",)),
    (("Nucleus circularis",), ()),
    (
        ("Paraventricular hypothalamic nucleus",),
        (
            "Paraventricular hypothalamic nucleus",
            "Paraventricular hypothalamic nucleus, magnocellular division",
            "Paraventricular hypothalamic nucleus, parvicellular division",
            "Paraventricular hypothalamic nucleus, descending division",
        ),
    ),
    (("Dorsomedial nucleus of the hypothalamus",), ("Dorsomedial nucleus of the hypothalamus",)),
    (("Anterior hypothalamic nucleus",), ("Anterior hypothalamic nucleus",)),
    (("Supramammilary nucleus",), ("Supramammilary nucleus",)),
    (("Ventromedial hypothalamic nucleus",), ("Ventromedial hypothalamic nucleus",)),
    (("Parabrachial nucleus",), ("Parabrachial nucleus", "Parabrachial nucleus, lateral division", "Parabrachial nucleus, medial division")),
)
#: Subtree roots by name and the group that their descendants get. The deepest root decides.
GROUPS = {
    "Cerebral nuclei": "Cerebral Nuclei",
    "Cortical subplate": "Cortical subplate",
    "Olfactory areas": "Olfactory regions",
    "Hippocampal formation": "Hippocampal formation",
    "Somatomotor areas": "Motor cortices",
    "Somatosensory areas": "Sensory cortices",
    "Frontal pole, cerebral cortex": "Polymodal association cortices",
    "Infralimbic area": "Polymodal association cortices",
    "Anterior cingulate area": "Polymodal association cortices",
    "Prelimbic area": "Polymodal association cortices",
    "Orbital area": "Polymodal association cortices",
    "Agranular insular area": "Polymodal association cortices",
    "Retrosplenial area": "Polymodal association cortices",
    "Posterior parietal association areas": "Polymodal association cortices",
    "Temporal association areas": "Polymodal association cortices",
    "Ectorhinal area": "Polymodal association cortices",
    "Perirhinal area": "Polymodal association cortices",
    "Gustatory areas": "Sensory cortices",
    "Auditory areas": "Sensory cortices",
    "Visceral area": "Sensory cortices",
    "Visual areas": "Sensory cortices",
    "Thalamus": "Thalamus",
    "Hypothalamus": "Hypothalamus",
    "Midbrain": "Midbrain",
    "Hindbrain": "Hindbrain",
}


#: Regions from which on `deep_closure` asks for hash joins.
MANY_REGIONS = 100_000


def deep_closure(regions: DataFrame) -> DataFrame:
    """closure of trees of any depth, by doubling: each round joins the paths so far with the steps of 1, 2, 4, ... levels
    and the steps with themselves, so a tree of depth d takes about log2(d) rounds, checkpointed. Each path is made once. A
    cycle, which steps never leave, is an error.

    Of many regions, a task holds its share of the steps, at most one a region and parent; paths, of which there are many
    times more, stream past them and are never sorted."""
    from netloom.operators.network import checkpointed

    most, step = regions.count(), 1
    held = lambda df: df.hint("shuffle_hash") if most > MANY_REGIONS else df
    links = regions.select("id", F.col("parent_id").alias("up")).distinct()
    jump = checkpointed(links.join(held(links.select(F.col("id").alias("up")).distinct()), "up", "left_semi").select("id", "up"))
    paths = regions.select("id", F.col("id").alias("ancestor_id"), F.lit(0).alias("depth")).distinct()
    while not jump.isEmpty():
        if step >= most:
            raise ValueError("the regions' parents form a cycle")
        beyond = paths.join(held(jump.select(F.col("id").alias("at"), "up")), F.col("ancestor_id") == F.col("at")).select("id", F.col("up").alias("ancestor_id"), (F.col("depth") + step).alias("depth"))
        paths = checkpointed(paths.unionByName(beyond))
        jump = checkpointed(jump.join(held(jump.select(F.col("id").alias("at"), F.col("up").alias("far"))), F.col("up") == F.col("at")).select("id", F.col("far").alias("up")))
        step *= 2
    return paths


def closure(regions: DataFrame) -> DataFrame:
    """id, ancestor_id, depth of every region and each of its ancestors, itself at depth 0; one recursive query, for trees of
    up to 100 levels. `deep_closure` takes any depth."""
    name = f"tree_{uuid.uuid4().hex}"
    regions.select("id", "parent_id").createOrReplaceTempView(name)
    return regions.sparkSession.sql(f"""
        WITH RECURSIVE up(id, ancestor_id, depth) AS (
          SELECT id, id, 0 FROM {name}
          UNION ALL SELECT up.id, t.parent_id, up.depth + 1 FROM up JOIN {name} t ON up.ancestor_id = t.id WHERE t.parent_id IS NOT NULL)
        SELECT u.id, u.ancestor_id, u.depth FROM up u JOIN {name} t ON u.ancestor_id = t.id""")


def tree_sum(regions: DataFrame, activity: DataFrame, keys: Sequence[str] = ("net", "sample")) -> DataFrame:
    """Values of regions plus those of all their descendants. activity: keys, id, value."""
    up = F.broadcast(closure(regions)) if regions.count() <= 100_000 else closure(regions)
    return activity.join(up, "id").groupBy(*keys, F.col("ancestor_id").alias("id")).agg(F.sum(F.coalesce("value", F.lit(0.0))).alias("value"))


def subtree(regions: DataFrame, root: int) -> DataFrame:
    """The regions at and under a root."""
    return regions.join(closure(regions).filter(F.col("ancestor_id") == root).select("id"), "id", "left_semi")


def without_subtrees(regions: DataFrame, roots: Sequence[int]) -> DataFrame:
    return regions.join(closure(regions).filter(F.col("ancestor_id").isin(*roots)).select("id"), "id", "left_anti")


def drop_layer_1(regions: DataFrame, root: int = 8) -> DataFrame:
    """Without the first layers of cortices under a root."""
    first = subtree(regions, root).filter(F.col("region").rlike("ayers? 1"))
    return regions.join(first.select("id"), "id", "left_anti")


def matches_rules(name: Column, rules: Sequence = TRIM_RULES) -> Column:
    """Whether a rule removes a region of that name."""
    out = F.lit(False)
    for patterns, kept in rules:
        hit = F.lit(True)
        for p in patterns:
            hit = hit & name.rlike(p)
        out = out | (hit & ~name.isin(*kept) if kept else hit)
    return out


def leaves(regions: DataFrame) -> DataFrame:
    """The regions that are no region's parent."""
    return regions.join(regions.select(F.col("parent_id").alias("id")).filter("id IS NOT NULL").distinct(), "id", "left_anti")


def trim(regions: DataFrame, root: int = 8, removed: Sequence[int] = REMOVED_SUBTREES, rules: Sequence = TRIM_RULES) -> DataFrame:
    """The leaves that stay after removing subtrees and the names that rules match."""
    # The second closure's recursion would run the first one anew in every round.
    moved = checkpointed(without_subtrees(regions, removed)).withColumn("parent_id", F.when(F.col("region") == MOVED_REGION, F.lit(MOVED_TO)).otherwise(F.col("parent_id")))
    # Leaves read the kept regions twice, and both closures with them.
    return leaves(checkpointed(subtree(moved, root).filter(~matches_rules(F.col("region"), rules))))


def drop_uncounted_children(regions: DataFrame, activity: DataFrame) -> DataFrame:
    """Without the children of parents whose children count nothing in all samples."""
    totals = activity.groupBy("id").agg(F.sum("value").alias("total"))
    empty = regions.join(totals, "id", "left").groupBy("parent_id").agg(F.sum(F.coalesce("total", F.lit(0.0))).alias("s")).filter("s = 0").select("parent_id")
    return regions.join(empty, "parent_id", "left_anti").select(*regions.columns)


def grouped(regions: DataFrame, groups: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """regions with anatomical_group: that of the nearest ancestor (or the region itself) which names a group."""
    if not isinstance(groups, DataFrame):
        rows = [(k, v) for k, v in (groups or GROUPS).items()]
        groups = regions.sparkSession.createDataFrame(rows, "root string, anatomical_group string")
    named = regions.select(F.col("id").alias("ancestor_id"), F.col("region").alias("root")).join(groups, "root")
    nearest = closure(regions).join(named, "ancestor_id").groupBy("id").agg(F.min_by("anatomical_group", "depth").alias("anatomical_group"))
    return regions.join(nearest, "id", "left")


def colored(regions: DataFrame, by: str = "anatomical_group", palette: Sequence[str] | None = None, seed: int = 1987) -> DataFrame:
    """regions with a color for each level of a column: of the palette, else spread by the golden angle from a seed."""
    place = F.dense_rank().over(W.orderBy(by))
    if palette is not None:
        return regions.withColumn("color", F.get(F.array(*map(F.lit, palette)), (place - 1) % len(palette)))
    hue = F.pmod(F.lit(float(seed)) + place * 137.508, F.lit(360.0)).cast("int")
    return regions.withColumn("color", F.format_string("hsl(%d,65%%,50%%)", hue))


def renamed(regions: DataFrame, field: str) -> DataFrame:
    """regions whose name is another of their fields."""
    return regions.withColumn("region", F.col(field))
