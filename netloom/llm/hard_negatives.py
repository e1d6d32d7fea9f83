"""Hard-negative mining by inner products, with an orthogonal rotation to principal axes.

Components become the integers floor(256 x). A rotation to the principal axes of (a bounded sample of) the vectors puts
most of their length into the leading components and leaves inner products as they are. Scores are therefore found in
steps: the products of the leading components first, and of what remains only the bound |rest of one| * |rest of the
other|, with a slack for the rounding of the rotation and the sums. A pair goes as soon as that interval cannot reach
what its anchor still needs: the fifth best score so far, or the windows of the anchor's positives. What is left is
verified by products of the integers themselves, so results are exact whatever the sample; it only decides the speed.

Anchors (rows whose id is divisible by `every`) are compared with all rows: blocks of anchors meet blocks of rows, each
two in one task, and each gives its best few for each anchor. A block has BLOCK rows whatever their labels or values, so a
label or a vector that a third of all rows have is nothing special. Two passes: positives, then the negatives in their
windows.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part; a null id comes
last among ties and is no anchor; a vector shorter than the longest counts as padded with zeros, an empty one as zeros;
rows that share an id are rows each (ties between them by the order of their stored keys), and only the anchor's own row
is not compared with it; an anchor without positives, or a positive without negatives in its window, has no row; an empty
table gives no rows; a score that does not fit 64 bits is an error; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.llm.common import dropped, short_batches, stored

#: Rows, and anchors, of a block.
BLOCK = 4096
#: Vectors that the rotation is fitted on, at most about so many.
FIT_ROWS = 50_000
#: Pairs that are looked at together in a task.
PAIRS = 1 << 18
#: Of the product of two lengths: far above the rounding of rotations and sums of up to 100,000 components.
SLACK = 1e-9


def relabelled(df: DataFrame, every: int = 7, labels: int = 10, id_col: str = "vec_id", label_col: str = "label") -> DataFrame:
    """df with label (label + 1) % labels in the rows whose id is divisible by `every`."""
    return df.withColumn(label_col, F.when(F.col(id_col) % every == 0, (F.col(label_col) + 1) % labels).otherwise(F.col(label_col)))


def _floor(x: Column) -> Column:
    """As a double: the built-in floor gives 64-bit integers, which large values pass."""
    near = F.rint(x)
    return near - (near > x).cast("double")


def _vectors(df: DataFrame, scale: int, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """row, id, label, v of the rows that take part."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    part = df.filter(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & finite)
    return part.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.transform(x, lambda c: _floor(c * scale)).alias("v"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of doubles as rows, padded with zeros."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lens = np.diff(flat.offsets.to_numpy())
    values = flat.flatten().to_numpy()
    if (lens == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(lens), width))
    out[np.repeat(np.arange(len(lens)), lens), np.arange(len(values)) - np.repeat(np.cumsum(lens) - lens, lens)] = values
    return out


def principal_axes(vectors: DataFrame, width: int, n: int) -> np.ndarray:
    """The eigenvectors, as columns by falling eigenvalue, of the second moments of about FIT_ROWS vectors."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = _matrix(batch.column(0), width)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    some = vectors.filter(F.pmod(F.xxhash64("row"), F.lit(max(1, -(-n // FIT_ROWS)))) == 0).select("v").repartition(8)
    total = sum((np.frombuffer(r["m"]).reshape(width, width) for r in some.mapInArrow(moments, "m binary").collect()), np.zeros((width, width)))
    with np.errstate(all="ignore"):
        good = np.isfinite(total).all()
    return np.linalg.eigh(total)[1][:, ::-1] if good and width else np.eye(width)


class _Side:
    """Vectors of a block: the integers, the rotated values, and the length of what follows each step's components."""

    def __init__(self, v: np.ndarray, axes: np.ndarray, steps: list[int]) -> None:
        self.v = v
        with np.errstate(all="ignore"):
            self.turned = v @ axes
            squares = self.turned**2
            self.length = np.sqrt(squares.sum(axis=1))
            self.rest = [np.sqrt(squares[:, w:].sum(axis=1)) for w in steps]
        self.most = np.abs(v).max(initial=0.0)


def _steps(width: int) -> list[int]:
    return sorted({max(1, width // 8), max(1, width // 4), max(1, width // 2)}) if width else [0]


def _exact(a: _Side, x: _Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The inner products of the integers."""
    out = np.empty(len(i), np.int64)
    small = a.most * x.most * max(a.v.shape[1], 1) < 2.0**62
    for at in range(0, len(i), 1 << 14):
        p, q = a.v[i[at : at + (1 << 14)]], x.v[j[at : at + (1 << 14)]]
        if small:
            out[at : at + len(p)] = np.einsum("nd,nd->n", p.astype(np.int64), q.astype(np.int64))
        else:
            out[at : at + len(p)] = [sum(int(b) * int(c) for b, c in zip(y, z, strict=True)) for y, z in zip(p, q, strict=True)]
    return out


def _promising(a: _Side, x: _Side, can: np.ndarray, low: np.ndarray, high: np.ndarray, steps: list[int], best: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs in `can` whose scores may lie from low to high of their anchor; with best, low rises to what
    that many of these pairs are sure to reach."""
    with np.errstate(all="ignore"):
        v = a.turned[:, : steps[0]] @ x.turned[:, : steps[0]].T
        off = a.rest[0][:, None] * x.rest[0] + SLACK * (a.length[:, None] * x.length)
        if best and can.shape[1] >= best:
            sure = np.where(can, np.nan_to_num(v - off, nan=-np.inf), -np.inf)
            low = np.maximum(low, np.partition(sure, -best, axis=1)[:, -best])
        # Negated, so that what is not a number stays.
        i, j = np.nonzero(can & ~(v + off < low[:, None]) & ~(v - off > high[:, None]))
        v = v[i, j]
        for k, w in enumerate(steps[1:], 1):
            v = v + np.einsum("nd,nd->n", a.turned[i, steps[k - 1] : w], x.turned[j, steps[k - 1] : w])
            off = a.rest[k][i] * x.rest[k][j] + SLACK * (a.length[i] * x.length[j])
            ok = ~(v + off < low[i]) & ~(v - off > high[i])
            i, j, v = i[ok], j[ok], v[ok]
    return i, j


def _first(group: np.ndarray, score: np.ndarray, tie: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Places of the first n of each group: high scores, then small ties and rows first."""
    order = np.lexsort((row, tie, -score, group))
    g = group[order]
    start = np.flatnonzero(np.diff(g, prepend=-1))
    return order[np.arange(len(g)) - np.repeat(start, np.diff(start, append=len(g))) < n]


def _met(asking: DataFrame, rows: DataFrame, n_anchor_blocks: int, n_row_blocks: int, fn, schema: str) -> DataFrame:  # noqa: ANN001
    """fn(anchors, rows) for each block of anchors and each block of rows."""
    number = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asking.withColumn("x", number(n_anchor_blocks)).withColumn("y", all_of(n_row_blocks))
    # Columns of their own: both sides may come from the same table.
    right = rows.select(*(F.col(c).alias(c) for c in rows.columns)).withColumn("y", number(n_row_blocks)).withColumn("x", all_of(n_anchor_blocks))

    def run(anchors: pa.Table, others: pa.Table) -> pa.Table:
        if not anchors.num_rows or not others.num_rows:
            return pa.Table.from_batches([], schema=fn.schema)
        return fn(anchors, others)

    return left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInArrow(run, schema)


def _subblocks(n_anchors: int, n_rows: int) -> Iterator[slice]:
    step = max(1, PAIRS // max(n_anchors, 1))
    for at in range(0, n_rows, step):
        yield slice(at, min(at + step, n_rows))


def _tie(column: pa.ChunkedArray) -> np.ndarray:
    return column.fill_null((1 << 63) - 1).to_numpy()


class _Positives:
    """Of a block of anchors and one of rows: each anchor's first rows of its label."""

    schema = pa.schema([("anchor", pa.int64()), ("row", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def __init__(self, axes, width: int, n: int) -> None:  # noqa: ANN001
        self.axes, self.width, self.n = axes, width, n

    def __call__(self, anchors: pa.Table, others: pa.Table) -> pa.Table:
        steps, axes = _steps(self.width), self.axes.value
        a_label, x_label = np.array(anchors["label"].to_pylist()), np.array(others["label"].to_pylist())
        a_row, x_row, tie = anchors["row"].to_numpy(), others["row"].to_numpy(), _tie(others["id"])
        a_v, x_v = _matrix(anchors["v"], self.width), _matrix(others["v"], self.width)
        found: list[np.ndarray] = []
        for label in np.unique(a_label):
            mine, theirs = np.flatnonzero(a_label == label), np.flatnonzero(x_label == label)
            a = _Side(a_v[mine], axes, steps)
            low, none = np.full(len(mine), -np.inf), np.empty(0, np.int64)
            i, j, score = none, none, none
            for part in _subblocks(len(mine), len(theirs)):
                at = theirs[part]
                x = _Side(x_v[at], axes, steps)
                p, q = _promising(a, x, a_row[mine][:, None] != x_row[at], low, np.full(len(mine), np.inf), steps, self.n)
                i, j, score = np.concatenate([i, p]), np.concatenate([j, at[q]]), np.concatenate([score, _exact(a, x, p, q)])
                keep = _first(i, score, tie[j], x_row[j], self.n)
                i, j, score = i[keep], j[keep], score[keep]
                count = np.bincount(i, minlength=len(mine))
                last = np.cumsum(count) - 1
                full = count == self.n
                low[full] = score[last[full]]
            found.append(np.stack([mine[i], j, score]))
        i, j, score = np.concatenate(found, axis=1)
        return pa.Table.from_arrays([pa.array(a_row[i]), pa.array(x_row[j]), others["id"].take(pa.array(j)).combine_chunks(), pa.array(score)], schema=self.schema)


class _Negatives:
    """Of a block of anchors, with the windows of their positives, and one of rows: each window's first rows of another
    label."""

    schema = pa.schema([("anchor", pa.int64()), ("positive", pa.int64()), ("row", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def __init__(self, axes, width: int, n: int) -> None:  # noqa: ANN001
        self.axes, self.width, self.n = axes, width, n

    def __call__(self, anchors: pa.Table, others: pa.Table) -> pa.Table:
        steps, axes = _steps(self.width), self.axes.value
        labels, coded = np.unique(np.array([*anchors["label"].to_pylist(), *others["label"].to_pylist()]), return_inverse=True)
        a_label, x_label = coded[: anchors.num_rows], coded[anchors.num_rows :]
        a_row, x_row, tie = anchors["row"].to_numpy(), others["row"].to_numpy(), _tie(others["id"])
        a, x_v = _Side(_matrix(anchors["v"], self.width), axes, steps), _matrix(others["v"], self.width)
        # The windows of all anchors, one after another.
        windows = anchors["windows"].combine_chunks()
        count = np.diff(windows.offsets.to_numpy())
        first, of = np.cumsum(count) - count, np.repeat(np.arange(len(count)), count)
        positive, lo, hi = (windows.flatten().field(k).to_numpy() for k in range(3))
        need, most = lo.astype(float), hi.astype(float)
        none = np.empty(0, np.int64)
        w, j, score = none, none, none
        for part in _subblocks(len(a_row), len(x_row)):
            x = _Side(x_v[part], axes, steps)
            low, high = np.minimum.reduceat(need, first), np.maximum.reduceat(most, first)
            # Windows as doubles: what is lost in them is below the slack of large scores.
            p, q = _promising(a, x, a_label[:, None] != x_label[part], low - 1e-6 * np.abs(low), high + 1e-6 * np.abs(high), steps)
            s = _exact(a, x, p, q)
            # Each pair in each of its anchor's windows.
            again = count[p]
            at = np.repeat(first[p] - (np.cumsum(again) - again), again) + np.arange(again.sum())
            s, q = np.repeat(s, again), np.repeat(q + part.start, again)
            ok = (lo[at] <= s) & (s <= hi[at])
            w, j, score = np.concatenate([w, at[ok]]), np.concatenate([j, q[ok]]), np.concatenate([score, s[ok]])
            keep = _first(w, score, tie[j], x_row[j], self.n)
            w, j, score = w[keep], j[keep], score[keep]
            have = np.bincount(w, minlength=len(lo))
            last, full = np.cumsum(have) - 1, have == self.n
            need[full] = np.maximum(need[full], score[last[full]])
        return pa.Table.from_arrays([pa.array(a_row[of[w]]), pa.array(positive[w]), pa.array(x_row[j]), others["id"].take(pa.array(j)).combine_chunks(), pa.array(score)], schema=self.schema)


def _ranked(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first n rows of each key, numbered; each map task passes on n of a key at most."""
    order = W.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def hard_negatives(df: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low_pct: int = 80, high_pct: int = 100, scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its first
    `positives` rows of the same label, the first `negatives` rows of another label with
    low_pct * positive_score <= 100 * negative_score <= high_pct * positive_score."""
    spark = df.sparkSession
    short_batches(spark, 2048)
    vectors = stored(_vectors(df, scale, id_col, label_col, vector_col), "vectors")
    n, n_anchors, width = vectors.agg(F.count(F.lit(1)), F.count(F.when(F.col("id") % every == 0, 1)), F.max(F.size("v"))).first()
    width = width or 0
    axes = spark.sparkContext.broadcast(principal_axes(vectors, width, n))
    blocks = max(1, -(-n_anchors // BLOCK)), max(1, -(-n // BLOCK))
    anchors = vectors.filter(F.col("id") % every == 0)
    near = _met(anchors, vectors, *blocks, _Positives(axes, width, positives), "anchor long, row long, id long, score long")
    near = stored(_ranked(near, ["anchor"], positives).select("anchor", "row", "id", "score"), "positives")
    # The window of integers for each positive: exact in decimals.
    bound = lambda pct, up: F.expr(f"CAST({'ceil' if up else 'floor'}(CAST(score AS DECIMAL(19,0)) * {pct} / 100BD) AS BIGINT)")
    windows = near.groupBy("anchor").agg(F.collect_list(F.struct(F.col("row").alias("positive"), bound(low_pct, True).alias("lo"), bound(high_pct, False).alias("hi"))).alias("windows"))
    asked = anchors.join(windows, F.col("row") == F.col("anchor")).drop("anchor")
    far = _met(asked, vectors, *blocks, _Negatives(axes, width, negatives), "anchor long, positive long, row long, id long, score long")
    far = stored(_ranked(far, ["anchor", "positive"], negatives), "negatives")
    told = near.select(F.col("anchor").alias("of"), F.col("row").alias("p"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = anchors.select(F.col("row").alias("a"), F.col("id").alias("anchor_id"))
    out = far.join(told, (F.col("anchor") == F.col("of")) & (F.col("positive") == F.col("p"))).join(names, F.col("anchor") == F.col("a"))
    result = stored(out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "hard-negatives")
    dropped(vectors, near, far)
    return result
