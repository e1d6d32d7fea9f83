"""Mixing sources to target weights.

Every source has a target size: its weight's share of all words, at most `epochs` times what it has; what that cuts off
goes to the others by weight. Within a source, documents are range-sorted by a seeded hash; distributed prefix sums of
their word counts cut the order exactly at the budget. Budgets above a source's size repeat it whole first.

Defined results: null text has no words; a null source is a source of its own, last in order; a null identifier hashes
as the empty string; repeated rows count each for itself, in any order among them; rows that share an identifier, or
have none, are taken each by its own source and place; a source without words has target 0; an empty table gives no
rows; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.llm.common import SPACE_RUN, SPACES, n_words, placed, stored, with_prefix


def targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), epochs: int = 3) -> DataFrame:
    """source, source_size, target, budget from (source, source_size): a row for each source, which is few rows.

    Sources are saturated in order of source_size / weight: of the orders' prefixes, the least is taken after which no
    other source goes over its limit."""
    by_name = W.orderBy(F.asc_nulls_last("source"))
    cycle = F.array(*(F.lit(int(w)) for w in weights))
    s = sizes.select("source", "source_size", F.get(cycle, ((F.row_number().over(by_name) - 1) % len(weights)).cast("int")).cast("long").alias("w"))
    every, level = W.partitionBy(), W.orderBy((F.col("source_size") / F.col("w")), F.asc_nulls_last("source"))
    s = s.select("*", F.sum("source_size").over(every).alias("all_size"), F.sum("w").over(every).alias("all_w"), F.row_number().over(level).alias("k"), F.sum("source_size").over(level.rowsBetween(W.unboundedPreceding, -1)).alias("size_before"), F.sum("w").over(level.rowsBetween(W.unboundedPreceding, -1)).alias("w_before"))
    rest = F.col("all_size") - epochs * F.coalesce("size_before", F.lit(0))
    rest_w = F.col("all_w") - F.coalesce("w_before", F.lit(0))
    s = s.select("*", rest.alias("rest"), rest_w.alias("rest_w"))
    fits = F.col("w") * F.col("rest") <= epochs * F.col("source_size") * F.col("rest_w")
    # From the first source that fits on, all fit.
    first = F.min(F.when(fits, F.struct("k", "rest", "rest_w"))).over(every)
    s = s.select("*", first.alias("first"))
    below = F.col("first").isNull() | (F.col("k") < F.col("first.k"))
    target = F.when(below, (epochs * F.col("source_size")).cast("double")).otherwise((F.col("w") * F.col("first.rest")).cast("double") / F.col("first.rest_w").cast("double"))
    return s.select("source", "source_size", target.alias("target"), F.floor(target + 0.5).cast("long").alias("budget"))


def _mixed(df: DataFrame, weights: Sequence[int], epochs: int, seed: int, id_col: str, text_col: str, source_col: str, row: Sequence[str] = ()) -> DataFrame:
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    narrow = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), key.alias("key"), *row)
    order = ["key", "doc_id", "size", *row]
    table = placed(narrow, order, ["source"], tag="mix")
    plan = targets(table.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs)
    plan = plan.withColumnRenamed("source", "plan_source")
    ran = with_prefix(table, order, {"before": "size"}, ["source"]).join(plan, F.col("source").eqNullSafe(F.col("plan_source")))
    whole = F.when(F.col("source_size") > 0, F.expr("budget DIV greatest(source_size, 1)")).otherwise(F.lit(0).cast("long"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - whole * F.col("source_size") - F.col("before")))
    return ran.select("doc_id", "size", "source_size", "target", whole.alias("whole"), part.cast("long").alias("part"), *row)


def mix(df: DataFrame, weights: Sequence[int] = (1, 2, 3), epochs: int = 3, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken: `taken` words of the document enter the mix, repeats counted."""
    out = _mixed(df, weights, epochs, seed, id_col, text_col, source_col)
    return out.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("part")).alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    body = F.ltrim(text, F.lit(SPACES))
    return F.concat_ws(" ", F.slice(F.split(body, SPACE_RUN), F.lit(1), n.cast("int")))


def mixed_rows(df: DataFrame, weights: Sequence[int] = (1, 2, 3), epochs: int = 3, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself, with the columns of df: a row for each time a document is taken whole, and one with its first
    words for the document that the budget cuts. What is taken goes by stored row keys: identifiers may repeat or be
    null."""
    names = [f"c{i}" for i in range(len(df.columns))]
    of = dict(zip(df.columns, names, strict=True))
    keyed = stored(df.toDF(*names).withColumn("row", F.monotonically_increasing_id()), "rows")
    taken = _mixed(keyed, weights, epochs, seed, of[id_col], of[text_col], of[source_col], ["row"]).filter("whole > 0 OR part > 0")
    per_row = taken.select("row", F.expr("CAST(whole + IF(part = size AND size > 0, 1, 0) AS INT)").alias("n"), F.expr("IF(part < size, part, 0)").alias("first"))
    rows = keyed.join(per_row, "row").filter("n > 0 OR first > 0").withColumn("k", F.explode(F.expr("sequence(1, n + IF(first > 0, 1, 0))")))
    text = F.when(F.col("k") > F.col("n"), first_words(F.col(of[text_col]), F.col("first"))).otherwise(F.col(of[text_col]))
    return rows.select(*((text if c == text_col else F.col(n)).alias(c) for n, c in zip(names, df.columns, strict=True)))
