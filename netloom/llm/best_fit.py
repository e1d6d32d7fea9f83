"""Best-fit packing with exact complements.

Texts are encoded once, an end id after each, and cut only where they are longer than a sequence: pieces of the full
length, the first of which may be shorter. What is packed are lengths: their counts, a row for each of at most `length`
lengths, are all that the packing needs, however many pieces there are.

1. The longest length left opens a sequence. Sums of one, two and three of the lengths that are left are indexed; if one
   of them is exactly the gap, its lengths close the sequence (single before pair before triple; of several, that whose
   smallest length is largest, since small ones fill gaps later). Otherwise the longest that fits goes in, which is the
   best fit, and the gap is looked up anew. Availability counts: a combination takes a length as often as it holds it.
2. A filling so found is used for as many sequences as the counts permit, so one step packs millions of equal ones. Each
   use leaves a length with fewer pieces than a filling takes, so fillings are at most about length * ln(length).
3. Pieces get ranks within their length by distributed prefix sums; the fillings, laid out as ranges of ranks for each
   length, name each piece's sequence and offset. A length that a third of all pieces have is cut over many tasks.

The driver sees counts of lengths and fillings, whose size depends on `length` only.

Defined results: null and empty texts are the end id alone; null identifiers come first among equal lengths; repeated
rows are packed each; a text of any length is cut into pieces as said; an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import dropped, placed, short_batches, stored, with_prefix
from netloom.llm.tokens import Encoder


class SumIndex:
    """The sums of one, two and three of the lengths that are left (counts[l] pieces of length l)."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts.astype(np.int64)
        self.here = (self.counts > 0).astype(np.int64)
        self.here[0] = 0
        n = len(counts)
        #: For each sum, how many ordered pairs of lengths give it, whether or not one length is there twice.
        self.pairs = np.convolve(self.here, self.here)[:n]

    def take(self, length: int, n: int = 1) -> None:
        self.counts[length] -= n
        if not self.counts[length] and self.here[length]:
            # Two for each other length, one for the length with itself.
            self.pairs[length:] -= 2 * self.here[: len(self.pairs) - length]
            if 2 * length < len(self.pairs):
                self.pairs[2 * length] += 1
            self.here[length] = 0

    def put(self, length: int, n: int = 1) -> None:
        if not self.counts[length]:
            self.pairs[length:] += 2 * self.here[: len(self.pairs) - length]
            if 2 * length < len(self.pairs):
                self.pairs[2 * length] += 1
            self.here[length] = 1
        self.counts[length] += n

    def pair(self, total: int) -> tuple[int, int] | None:
        """Two lengths with this sum, the smaller as large as can be."""
        if total < 2 or not self.pairs[total]:
            return None
        small = np.arange(total // 2, 0, -1)
        ok = (self.here[small] > 0) & (self.here[total - small] > 0) & ((small * 2 != total) | (self.counts[small] > 1))
        at = int(np.argmax(ok))
        return (total - int(small[at]), int(small[at])) if ok[at] else None

    def triple(self, total: int) -> tuple[int, int, int] | None:
        """Three lengths with this sum, the smallest as large as can be."""
        if total < 3:
            return None
        third = np.arange(total // 3, 0, -1)
        for small in third[(self.here[third] > 0) & (self.pairs[total - third] > 0)].tolist():
            # Of the others, the smaller from `small` up.
            rest = total - small
            other = np.arange(rest // 2, small - 1, -1)
            need_small = 1 + (other == small) + (rest - other == small)
            ok = (self.here[other] > 0) & (self.here[rest - other] > 0) & ((other * 2 != rest) | (self.counts[other] > 1 + (other == small))) & (self.counts[small] >= need_small)
            at = int(np.argmax(ok)) if len(ok) else 0
            if len(ok) and ok[at]:
                return (rest - int(other[at]), int(other[at]), small)
        return None

    def complement(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths that are there and fill the gap exactly."""
        if self.counts[gap]:
            return (gap,)
        return self.pair(gap) or self.triple(gap)

    def longest(self, most: int) -> int:
        """The longest length there up to `most`; 0 if there is none."""
        at = np.flatnonzero(self.here[: most + 1])
        return int(at[-1]) if len(at) else 0


def fillings(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences); counts[l] pieces have length l, the last index is a sequence's."""
    size = len(counts) - 1
    left = SumIndex(counts)
    out = []
    while opened := left.longest(size):
        filling, gap = [opened], size - opened
        left.take(opened)
        while gap:
            exact = left.complement(gap)
            if exact is None and (one := left.longest(gap)):
                exact, gap = (one,), gap - one
            else:
                gap = 0
            for length in exact or ():
                left.take(length)
                filling.append(length)
        # The same filling again, as often as there are pieces for it.
        again = min(int(left.counts[length]) // k for length, k in Counter(filling).items())
        if again:
            for length, k in Counter(filling).items():
                left.take(length, again * k)
        out.append((tuple(filling), 1 + again))
    return out


def _ranges(found: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Ranges of ranks, by length and first rank: length, first rank, pieces of the length in a filling, the first
    sequence, and where the filling's pieces of that length start; equal lengths of a filling follow one another."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for filling, n in found:
        at = 0
        for length, k in Counter(filling).items():
            rows.append((length, used[length], k, sequence, at))
            used[length] += k * n
            at += k * length
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack_best_fit(df: DataFrame, vocab: str, length: int = 2048, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for)."""
    spark = df.sparkSession
    short_batches(spark)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    schema = pa.schema([(n, pa.list_(pa.int32()) if n == "ids" else pa.int64()) for n in names])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(vocab)
        rows: list[tuple] = []

        def written() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for doc_id, ids in encoder.encode_rows(batches):
            ids = np.append(ids, ids.dtype.type(end_id)).astype("<u4")
            starts = [0, *range(len(ids) % length or length, len(ids), length)]
            for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                rows.append((doc_id, k, a, b - a, zlib.crc32(ids[a:b]), *([ids[a:b].astype(np.int32)] if with_ids else ())))
            if len(rows) >= 4096:
                yield written()
                rows.clear()
        if rows:
            yield written()

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sql = ", ".join(f"{n} {'array<int>' if n == 'ids' else 'long'}" for n in names)
    pieces = stored(docs.mapInArrow(cut, sql), "pieces").withColumn("row", F.monotonically_increasing_id())
    pieces = stored(pieces, "keyed") if with_ids else pieces
    counts = np.zeros(length + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    ranges = _ranges(fillings(counts))
    keys = ["doc_id", "row"]
    narrow = pieces.drop("ids").withColumn("one", F.lit(1).cast("long"))
    ranked = with_prefix(placed(narrow, keys, ["length"], "lengths"), keys, {"rank": "one"}, ["length"])
    told = spark.sparkContext.broadcast(ranges)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, first, k, sequence, at = told.value.T
        # One ascending key for (length, rank): ranks stay below the number of pieces.
        begins = np.searchsorted(of, np.arange(length + 2))
        for batch in batches:
            n, rank = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            where = np.empty(len(n), np.int64)
            for one in np.unique(n).tolist():
                own = n == one
                where[own] = begins[one] + np.searchsorted(first[begins[one] : begins[one + 1]], rank[own], "right") - 1
            nth = rank - first[where]
            arrays = [batch.column(0), pa.array(sequence[where] + nth // np.maximum(k[where], 1)), pa.array(at[where] + nth % np.maximum(k[where], 1) * n)]
            yield pa.RecordBatch.from_arrays([*arrays, *batch.columns[3:]], names=["row", "sequence_id", "offset", *batch.schema.names[3:]])

    plain = [n for n in names if n != "ids"]
    out = ranked.select("row", "length", "rank", *(F.col(n).alias(f"_{n}") for n in plain)).mapInArrow(place, "row long, sequence_id long, offset long, " + ", ".join(f"_{n} long" for n in plain))
    if with_ids:
        out = out.join(pieces.select(F.col("row").alias("of"), "ids"), F.col("row") == F.col("of"))
    return out.select(F.col("_doc_id").alias("doc_id"), F.col("_piece").cast("int").alias("piece"), F.col("_start").alias("start"), F.col("_length").alias("length"), F.col("_ids_crc32").alias("ids_crc32"), "sequence_id", "offset", *(["ids"] if with_ids else []))
