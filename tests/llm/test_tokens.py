"""Packing and token files against the tokenizers library, text by text."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from netloom.llm.binary import FrameReader, _open, read_documents, read_token_files, write_token_files
from netloom.llm.packing import curve_keys, hilbert_key, pack
from netloom.llm.tokens import Encoder

VOCAB = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "/root/testdata/sf0.001/documents.parquet"
ODD = ["", " ", "a  b", " x", "x ", "a\n b", "it's  's don't", "<|endoftext|> a <|endoftext|>", "a   b", "a \x1c b", "é 1 2  3\t\t4 \r\n x", "one two\nthree four", "word " * 3000 + "end", "x" * 5000, "a  b c", "Ġ Ġx y"]


def _crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.fixture(scope="module")
def library() -> Tokenizer:
    return Tokenizer.from_file(VOCAB)


def test_encoder_equals_library(library: Tokenizer) -> None:
    for got, text in zip(Encoder(VOCAB).encode([*ODD, *ODD]), [*ODD, *ODD], strict=True):
        assert got.tolist() == library.encode(text, add_special_tokens=False).ids


def test_other_vocabularies_get_whole_texts() -> None:
    path = public_tokenizers.path("word_bpe_49k.json")
    library, encoder = Tokenizer.from_file(path), Encoder(path)
    assert not encoder.cuttable and Encoder(VOCAB).cuttable
    for got, text in zip(encoder.encode(ODD), ODD, strict=True):
        assert got.tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 2), (4, 2)])
def test_hilbert_neighbours_are_adjacent(dims: int, bits: int) -> None:
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
    key = hilbert_key(grid, bits)
    assert sorted(key.tolist()) == list(range(len(grid)))
    assert np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1).max() == 1


def test_equal_texts_have_equal_keys() -> None:
    assert len(set(curve_keys(["some text here", "some text here", None, ""]).tolist())) == 2


def _rows(spark):  # noqa: ANN001, ANN202
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(DOCS).collect()]
    return docs, spark.read.parquet(DOCS)


def test_token_files_round_trip(spark, library) -> None:  # noqa: ANN001
    docs, df = _rows(spark)
    manifest = write_token_files(df, VOCAB)
    got = {r["doc_id"]: r for r in read_token_files(manifest).collect()}
    at = 0
    for doc_id, text in sorted(docs):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[doc_id]["start"], got[doc_id]["n_tokens"], got[doc_id]["ids_crc32"]) == (at, len(ids), _crc(ids))
        at += len(ids)
    some = {r["doc_id"]: r["ids"] for r in read_documents(spark, manifest, [3, 77, 10**9]).collect()}
    assert some == {k: [*library.encode(dict(docs)[k], add_special_tokens=False).ids, 2] for k in (3, 77)}
    paths = [r["path"] for r in manifest.collect()]
    import zstandard

    with open(paths[0].removeprefix("file:"), "rb") as f:
        raw = f.read()
    frames = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert len(frames) == 2 * manifest.orderBy("part").first()["tokens"]  # any zstandard reader skips index and table

    class Damaged:
        def size(self) -> int:
            return len(raw)

        def read_at(self, n: int, at: int) -> bytes:
            return (raw[: 5] + bytes([raw[5] ^ 255]) + raw[6:])[at : at + n]

    with pytest.raises(Exception, match="."):
        FrameReader(Damaged()).ids(0)
    assert _open(paths[0]).ids(0).tolist()[-1] == 2


def test_token_files_edges(spark, library) -> None:  # noqa: ANN001
    rows = [(5, None, "x"), (5, None, "x"), (None, "a b", "y"), (7, "long " * 50_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string")
    got = sorted(read_token_files(write_token_files(df, VOCAB)).collect(), key=lambda r: r["start"])
    long = [*library.encode("long " * 50_000, add_special_tokens=False).ids, 2]
    assert [(r["doc_id"], r["n_tokens"]) for r in got] == [(None, 3), (5, 1), (5, 1), (7, len(long))]
    assert got[3]["ids_crc32"] == _crc(long)
    assert read_token_files(write_token_files(df.limit(0), VOCAB)).count() == 0


def _check_pack(pieces: list, docs: list, library: Tokenizer, length: int) -> None:
    of, seqs = defaultdict(list), defaultdict(list)
    for r in pieces:
        of[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append(r)
    assert set(of) == {d for d, _ in docs}
    for doc_id, text in docs:
        ids, at = [*library.encode(text or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(of[doc_id], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == _crc(ids[at : at + r["length"]])
            assert r["ids"] == ids[at : at + r["length"]]
            at += r["length"]
        assert at == len(ids)
    for rows in seqs.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= length
    assert sorted(seqs) == list(range(len(seqs)))


def test_pack(spark, library) -> None:  # noqa: ANN001
    docs, df = _rows(spark)
    pieces = pack(df, VOCAB, with_ids=True).collect()
    _check_pack(pieces, docs, library, 2048)
    used = sum(r["length"] for r in pieces)
    assert used / (2048 * len({r["sequence_id"] for r in pieces})) > 0.9


def test_ranges_hold_equal_bytes(spark, library, monkeypatch) -> None:  # noqa: ANN001
    """Long texts and copies lie together on the curve, yet no range holds much more than its bytes."""
    from netloom.llm import packing

    rows = [(k, f"word{k % 7} " * 2000) for k in range(60)] + [(100 + k, "the same short text") for k in range(900)] + [(2000 + k, f"t{k} u{k * 7}") for k in range(300)]
    held = []

    def watched(df, tag):  # noqa: ANN001, ANN202
        out = kept(df, tag)
        if tag == "pieces":
            held.extend(r["n"] for r in out.groupBy("part").agg({"doc_id": "count"}).withColumnRenamed("count(doc_id)", "n").collect())
        return out

    kept = packing.stored
    monkeypatch.setattr(packing, "stored", watched)
    pieces = pack(spark.createDataFrame(rows, "doc_id long, text string"), VOCAB, with_ids=True, range_bytes=30_000).collect()
    _check_pack(pieces, rows, library, 2048)
    total = sum(len(t) + 1 for _, t in rows)
    assert total / 30_000 * 0.6 <= len(held) <= total / 30_000 + 1


def test_pack_edges(spark, library) -> None:  # noqa: ANN001
    rows = [(None, "a b"), (1, None), (2, "long " * 9000), (3, "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, key int")
    _check_pack(pack(df, VOCAB, length=64, with_ids=True).collect(), rows, library, 64)
    assert pack(df.limit(0), VOCAB).count() == 0
    twice = pack(spark.createDataFrame([(1, "same"), (1, "same")], "doc_id long, text string"), VOCAB).collect()
    assert len(twice) == 2
