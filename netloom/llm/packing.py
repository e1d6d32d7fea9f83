"""Packing along a space-filling curve.

Each text's byte trigrams are hashed to a signed vector, projected to four dimensions by a fixed random matrix and
ranked by its place on a Hilbert curve. Documents are range-sorted by that key (ties, as of copies, by identifier, so a
large group of copies is cut over many ranges), encoded, and laid one after another into sequences, cut wherever one
fills up: neighbours on the curve share sequences, and only the last sequence of a range is padded.

Long texts lie close together on the curve, so ranges of equal row counts would differ much in bytes. Ranges are cut at
equal bytes instead: keys and lengths alone are range-sorted first, distributed prefix sums of the lengths give the first
key of each range, and the texts then move once, straight to their range. The number of ranges grows with the bytes, so
a task's share does not.

Defined results: null text is the end id alone, at the curve's middle; null identifiers come first among ties; repeated
rows are packed each, in one range where they share the identifier; a text longer than a range is a range of its own; an
empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.llm.common import dropped, placed, short_batches, stored, with_prefix
from netloom.llm.tokens import Encoder

BUCKETS, DIMS, BITS = 256, 4, 15
#: Bytes of texts in a range, and the most ranges: the first keys of all of them, 16 bytes each, go to the driver and to
#: every task. Beyond that product ranges hold more bytes each; a task reads its range as a stream.
RANGE_BYTES, MOST_RANGES = 8 << 20, 100_000
#: Stands for a null identifier in keys.
NO_ID = -(1 << 63)


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of rows of unsigned coordinates below 2**bits (Skilling's transform, vectorised)."""
    x = [points[:, d].astype(np.int64) for d in range(points.shape[1])]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for d in range(n):
            high = (x[d] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[d]) & (q - 1))
            x[0] = np.where(high, x[0] ^ (q - 1), x[0] ^ swap)
            if d:
                x[d] = x[d] ^ swap
        q >>= 1
    for d in range(1, n):
        x[d] = x[d] ^ x[d - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[-1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(n):
            key = (key << 1) | (((x[d] ^ flip) >> b) & 1)
    return key


def text_vector(text: str | None) -> np.ndarray:
    """Signed counts of hashed byte trigrams, of length one; zero for texts under three bytes."""
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    v = np.zeros(BUCKETS)
    step = 1 << 20
    for at in range(0, max(len(b) - 2, 0), step):
        c = b[at : at + step + 2].astype(np.uint32)
        h = ((c[:-2] << 16 | c[1:-1] << 8 | c[2:]) * np.uint32(2654435761)) >> np.uint32(23)
        n = np.bincount(h, minlength=2 * BUCKETS)
        v += n[:BUCKETS] - n[BUCKETS:]
    norm = np.sqrt(v @ v)
    return v / norm if norm else v


def curve_keys(texts: list[str | None], seed: int = 0) -> np.ndarray:
    """The Hilbert key of each text."""
    matrix = np.random.default_rng(seed).standard_normal((BUCKETS, DIMS))
    flat = np.array([text_vector(t) for t in texts]).reshape(-1, BUCKETS) @ matrix
    unit = 1 / (1 + np.exp(-1.7 * flat))
    return hilbert_key(np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def _range_starts(keys: DataFrame, range_bytes: int) -> list[tuple[int, int]]:
    """The first (key, id) of each range but the first, of stored keys (key, id, bytes)."""
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    target = max(range_bytes, total // MOST_RANGES + 1)
    order = ["key", "id"]
    table = placed(keys, order, tag="curve")
    cut = with_prefix(table, order, {"before": "bytes"})
    starts = cut.groupBy(F.expr(f"before DIV {target}").alias("range")).agg(F.min(F.struct(*order)).alias("first"))
    first = sorted((r["first"]["key"], r["first"]["id"]) for r in starts.collect())
    dropped(table)
    return first[1:]


def pack(df: DataFrame, vocab: str, length: int = 2048, end_id: int = 1, with_ids: bool = False, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for)."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.array(curve_keys(batch.column(1).to_pylist(), seed), pa.int64())
            # The end id counts too: empty texts are not free.
            size = pc.add(pc.coalesce(pc.binary_length(batch.column(1)), 0), 1).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([keys, pc.coalesce(batch.column(0), NO_ID), size], names=["key", "id", "bytes"])

    short_batches(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keys = stored(docs.mapInArrow(measured, "key long, id long, bytes long"), "keys")
    starts = _range_starts(keys, range_bytes)
    dropped(keys)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = curve_keys(batch.column(1).to_pylist(), seed)
            at = [bisect_right(starts, k) for k in zip(keys.tolist(), pc.coalesce(batch.column(0), NO_ID).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int64()), pa.array(at, pa.int32())], names=["doc_id", "text", "key", "range"])

    names = ["part", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "seq", "offset"]
    schema = pa.schema([(n, pa.int64()) for n in names] + [("ids", pa.list_(pa.int32()))] * with_ids)

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder.of(vocab), TaskContext.get().partitionId()
        seq = fill = 0
        rows: list[tuple] = []

        def written() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for doc_id, ids in encoder.encode_rows(batches):
            ids = np.append(ids, ids.dtype.type(end_id)).astype("<u4")
            at = 0
            while at < len(ids):
                piece = ids[at : at + length - fill]
                rows.append((part, doc_id, at, len(piece), zlib.crc32(piece), len(ids), seq, fill, *([piece.tolist()] if with_ids else ())))
                at, fill = at + len(piece), fill + len(piece)
                if fill == length:
                    seq, fill = seq + 1, 0
            if len(rows) >= 4096:
                yield written()
                rows.clear()
        if rows:
            yield written()

    moved = docs.mapInArrow(keyed, "doc_id long, text string, key long, range int").repartitionById(len(starts) + 1, "range")
    ranged = moved.sortWithinPartitions("key", "doc_id").select("doc_id", "text")
    pieces = stored(ranged.mapInArrow(laid, ", ".join(f"{n} long" for n in names) + ", ids array<int>" * with_ids), "pieces")
    # A row for each range, at most MOST_RANGES.
    first = pieces.groupBy("part").agg((F.max("seq") + 1).alias("n")).select(F.col("part").alias("of"), F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first_id"))
    out = pieces.join(F.broadcast(first), F.col("part") == F.col("of"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first_id") + F.col("seq")).alias("sequence_id"), "offset", *(["ids"] if with_ids else []))
