"""Token-id files: one zstandard frame for each document, a document index, and a trailing seek table.

A file is a plain zstandard stream of independent frames, each the ids of one document as little-endian unsigned
integers, followed by two skippable frames: an index (identifier, whether it is null, id count of each frame) and the
seek table of the public zstandard seekable format, with compressed size, size and checksum (low half of XXH64) of each
frame. A reader takes the table from the end of the file and decompresses only the frames it wants.

Documents are range-partitioned by identifier; each task writes the file of its range under a name of its own and moves
it into place when it is whole, so a repeated or lost attempt leaves nothing that is read. What the successful attempts
wrote is listed in a stored manifest (a row for each file), from which files get their global start.

Defined results: null text is the end id alone; null identifiers come first; repeated rows are written each; an empty
table writes no file; other columns are not looked at.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.llm.common import short_batches, stored, work_path
from netloom.llm.tokens import Encoder

#: Fixed values of the seekable format.
SKIPPABLE_INDEX, SKIPPABLE_TABLE, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("width", "u1"), ("n", "<u4")])
_ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])
_MANIFEST = "part int, path string, docs long, tokens long"


def _filesystem(uri: str):  # noqa: ANN202
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class FrameWriter:
    """Appends documents to an open binary stream and ends it with index and seek table."""

    def __init__(self, out, level: int = 3) -> None:  # noqa: ANN001
        import zstandard

        self.out, self.pack = out, zstandard.ZstdCompressor(level=level, write_checksum=False)
        self.index: list[tuple] = []
        self.entries: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        import xxhash

        raw = ids.tobytes()
        frame = self.pack.compress(raw)
        self.out.write(frame)
        self.index.append((doc_id or 0, doc_id is None, ids.dtype.itemsize, len(ids)))
        self.entries.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def close(self) -> None:
        index = np.array(self.index, dtype=_INDEX).tobytes()
        table = np.array(self.entries, dtype=_ENTRY).tobytes() + struct.pack("<IBI", len(self.entries), 0x80, SEEK_MAGIC)
        for magic, body in ((SKIPPABLE_INDEX, index), (SKIPPABLE_TABLE, table)):
            self.out.write(struct.pack("<II", magic, len(body)) + body)
        self.out.close()


class FrameReader:
    """Random access to the documents of one file."""

    def __init__(self, source) -> None:  # noqa: ANN001
        import zstandard

        self.source, self.unpack = source, zstandard.ZstdDecompressor()
        end = source.size()
        n, flags, magic = struct.unpack("<IBI", source.read_at(9, end - 9))
        if magic != SEEK_MAGIC or flags != 0x80:
            raise ValueError("the file has no seek table")
        at = end - 9 - n * _ENTRY.itemsize - 8
        self.entries = np.frombuffer(source.read_at(n * _ENTRY.itemsize, at + 8), dtype=_ENTRY)
        self.index = np.frombuffer(source.read_at(n * _INDEX.itemsize, at - n * _INDEX.itemsize), dtype=_INDEX)
        self.at = np.concatenate([[0], np.cumsum(self.entries["packed"], dtype=np.int64)])

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document; ValueError if its bytes are damaged."""
        import xxhash

        raw = self.unpack.decompress(self.source.read_at(int(self.entries["packed"][k]), int(self.at[k])), max_output_size=int(self.entries["size"][k]))
        if len(raw) != self.entries["size"][k] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.entries["check"][k]:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(raw, dtype=f"<u{self.index['width'][k]}")

    def find(self, doc_id: int) -> list[int]:
        """The places of a document. Identifiers ascend after the null ones."""
        ids, nulls = self.index["doc_id"], int(self.index["null"].sum())
        return list(range(nulls + np.searchsorted(ids[nulls:], doc_id, "left"), nulls + np.searchsorted(ids[nulls:], doc_id, "right")))


def write_token_files(df: DataFrame, vocab: str, end_id: int = 2, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", level: int = 3) -> DataFrame:
    """Encodes and writes df below `folder` (default: a new one in the shared folder) in identifier order.

    Returns the manifest: part, path, docs, tokens, start (ids in all files before)."""
    short_batches(df.sparkSession)
    folder = folder or work_path(df.sparkSession, "token-files")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder.of(vocab), TaskContext.get().partitionId()
        fs, top = _filesystem(folder)
        name, out = f"part-{part:06d}-{uuid.uuid4().hex[:12]}.ids.zst", None
        docs = tokens = 0
        for doc_id, ids in encoder.encode_rows(batches):
            if out is None:
                fs.create_dir(top, recursive=True)
                out = FrameWriter(fs.open_output_stream(f"{top}/.{name}.tmp"), level)
            out.add(doc_id, np.append(ids, ids.dtype.type(end_id)))
            docs, tokens = docs + 1, tokens + len(ids) + 1
        if out is not None:
            out.close()
            fs.move(f"{top}/.{name}.tmp", f"{top}/{name}")
            row = {"part": [part], "path": [f"{folder}/{name}"], "docs": [docs], "tokens": [tokens]}
            yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    ranged = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    manifest = stored(ranged.select("doc_id", "text").mapInArrow(write, _MANIFEST), "token-manifest")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _open(path: str) -> FrameReader:
    fs, at = _filesystem(path)
    return FrameReader(fs.open_input_file(at))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Reads every document back: doc_id, start, n_tokens, ids_crc32. Every frame's checksum is compared."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = _open(path)
                crc = [zlib.crc32(file.ids(k).astype("<u4").tobytes()) for k in range(len(file.index))]
                n = file.index["n"].astype(np.int64)
                ids = pa.array(file.index["doc_id"].astype(np.int64), mask=file.index["null"].astype(bool))
                yield pa.RecordBatch.from_arrays([ids, pa.array(start + np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = max(1, manifest.count())
    return manifest.repartitionByRange(files, "part").select("path", "start").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, manifest: DataFrame, doc_ids: Iterable[int]) -> DataFrame:
    """doc_id and ids of the wanted documents; no other frame is decompressed."""
    wanted = sorted(set(doc_ids))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                file = _open(path)
                for doc_id in wanted:
                    for k in file.find(doc_id):
                        yield pa.RecordBatch.from_pydict({"doc_id": [doc_id], "ids": [file.ids(k).tolist()]}, schema=pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))]))

    return manifest.select("path").mapInArrow(read, "doc_id long, ids array<long>")
