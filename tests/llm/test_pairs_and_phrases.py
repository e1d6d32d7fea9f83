"""Best-fit packing, hard negatives and collocations against brute force on small tables."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from netloom.llm import collocations as col
from netloom.llm import hard_negatives as hard
from netloom.llm.best_fit import SumIndex, fillings, pack_best_fit
from netloom.llm.oracle import COLLOCATIONS, HARD_NEGATIVES

VOCAB = public_tokenizers.path("byte_bpe_50k.json")


# Best-fit packing.


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 4), max_size=12), st.lists(st.integers(1, 40), max_size=6))
@settings(max_examples=150, deadline=None)
def test_sum_index(counts: dict, taken: list) -> None:
    array = np.zeros(41, np.int64)
    for k, n in counts.items():
        array[k] = n
    index = SumIndex(array)
    for k in taken:
        if index.counts[k]:
            index.take(k)
        else:
            index.put(k)
    left = index.counts
    there = [k for k in range(1, 41) if left[k]]
    enough = lambda c: all(left[k] >= n for k, n in Counter(c).items())
    for total in range(1, 41):
        pairs = [(total - b, b) for b in there if b <= total - b and enough((total - b, b))]
        triples = [(total - b - c, b, c) for c in there for b in there if c <= b <= total - b - c and enough((total - b - c, b, c))]
        want = (total,) if left[total] else max(pairs, key=lambda x: x[-1]) if pairs else None
        got = index.complement(total)
        if want is None and triples:
            assert got in triples and got[-1] == max(t[-1] for t in triples)
        else:
            assert got == want


@given(st.lists(st.integers(1, 64), max_size=60))
@settings(max_examples=100, deadline=None)
def test_fillings_use_every_piece_once(lengths: list) -> None:
    counts = np.bincount(lengths, minlength=65) if lengths else np.zeros(65, np.int64)
    found = fillings(counts)
    used: Counter = Counter()
    for filling, n in found:
        assert sum(filling) <= 64 and n > 0
        for k in filling:
            used[k] += n
    assert used == Counter(lengths)
    n = sum(n for _, n in found)
    # Plain best fit in falling order, one piece after another.
    gaps: list = []
    for k in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= k), default=None)
        if fit is None:
            gaps.append(64 - k)
        else:
            gaps[gaps.index(fit)] -= k
    assert n <= len(gaps) + 1 and n >= -(-sum(lengths) // 64)


def test_one_step_packs_many() -> None:
    counts = np.zeros(2049, np.int64)
    counts[[2048, 1500, 548, 1000, 24, 700]] = 10**9, 10**9, 10**9, 2 * 10**9, 2 * 10**9, 3
    found = fillings(counts)
    assert sum(n for _, n in found) == 3 * 10**9 + 2 and len(found) < 10


EDGES = [(5, "", "x"), (None, None, None), (5, "some words here", "y"), (7, "word " * 9000, "x"), (7, "word " * 9000, "x"), (8, "tie", None), (3, "tie", None), (-1, "é 1", "z")]


@pytest.fixture(scope="module")
def edges(spark):  # noqa: ANN001, ANN201
    """Null and repeated ids, empty and long texts, ties, repeated rows, columns with clashing names."""
    return spark.createDataFrame([(*r, 1, 2) for r in EDGES], "doc_id long, text string, sequence_id string, row long, length long")


def _packed(rows: list, texts: list, length: int) -> None:
    library = Tokenizer.from_file(VOCAB)
    want = Counter()
    for doc_id, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        starts = [0, *range(len(ids) % length or length, len(ids), length)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            want[doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= length
    total = sum(r["length"] for r in rows)
    assert -(-total // length) <= len(sequences)
    return len(sequences), -(-total // length)


def test_best_fit_of_documents(spark) -> None:  # noqa: ANN001
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    used, least = _packed(pack_best_fit(docs, VOCAB).collect(), texts, 2048)
    assert used <= least + 1
    used, least = _packed(pack_best_fit(docs, VOCAB, 256).collect(), texts, 256)
    assert used <= least + 2


def test_best_fit_edges(spark, edges) -> None:  # noqa: ANN001
    rows = pack_best_fit(edges, VOCAB, 128, with_ids=True).collect()
    _packed(rows, [r[:2] for r in EDGES], 128)
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)
    assert pack_best_fit(edges.limit(0), VOCAB).count() == 0


# Hard negatives.


def _brute(rows: list, every: int = 100, n: int = 5) -> list:
    """rows: (id, label, vector)."""
    part = [(i, lab, [math.floor(256 * float(x)) for x in v]) for i, lab, v in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    late = lambda i: (i is None, i or 0)
    for a, (i, lab, v) in enumerate(part):
        if i is None or i % every:
            continue
        scored = sorted(((-sum(p * q for p, q in zip(v, w, strict=False)), late(j), b, j, m) for b, (j, m, w) in enumerate(part) if b != a))
        for s, _, _, j, _ in [x for x in scored if x[4] == lab][:n]:
            near = [x for x in scored if x[4] != lab and 80 * -s <= 100 * -x[0] <= 100 * -s][:n]
            out += [(i, j, k, x[3], -s, -x[0]) for k, x in enumerate(near, 1)]
    return sorted(out, key=repr)


def _hard(df, **options) -> list:  # noqa: ANN001, ANN003
    return sorted((tuple(r) for r in hard.hard_negatives(df, **options).collect()), key=repr)


def _vectors(spark, rows: list):  # noqa: ANN001, ANN202
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label int, embedding array<double>, row long, score string")


@pytest.mark.parametrize(("seed", "width", "spread"), [(1, 16, 0.2), (2, 3, 1.0), (3, 1, 2.0), (4, 40, 0.01)])
def test_hard_negatives(spark, monkeypatch, seed: int, width: int, spread: float) -> None:  # noqa: ANN001
    monkeypatch.setattr(hard, "BLOCK", 60)
    monkeypatch.setattr(hard, "PAIRS", 200)
    rng = np.random.default_rng(seed)
    center = rng.normal(0, spread, (4, width))
    rows = []
    for i in range(260):
        lab = int(rng.integers(4))
        v = [float(np.float32(x)) for x in center[rng.integers(4)] + rng.normal(0, spread / 2, width)]
        rows.append((i, lab, v if i % 9 else rows[i // 2][2] if i else v))  # copies and ties
    assert _hard(_vectors(spark, rows), every=20) == _brute(rows, 20) != []


def test_hard_negatives_edges(spark) -> None:  # noqa: ANN001
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [0.5, 0.25]), (1, 1, [0.5, 0.2]), (2, 2, [0.5, 0.2]), (None, 2, [0.5, 0.2]), (None, 1, [0.4, 0.2]), (3, None, [1.0, 1.0]), (4, 1, None), (5, 1, [nan, 1.0]), (6, 2, [1.0, inf]), (7, 2, [None, 1.0]), (8, 2, []), (9, 1, [0.3]), (100, 1, [0.0, 0.0]), (100, 1, [0.5, 0.25]), (200, 9, [1.0, 1.0]), (300, None, [1.0, 1.0]), (-100, 2, [-0.5, 0.1]), (10, 2, [0.45, 0.22, 7.0])]
    assert _hard(_vectors(spark, rows)) == _brute(rows) != []
    df = _vectors(spark, rows)
    assert _hard(df.limit(0)) == [] and hard.hard_negatives(df.limit(0)).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert [(r["vec_id"], r["label"]) for r in hard.relabelled(df).filter("vec_id IN (0, 7, 9)").orderBy("vec_id").collect()] == [(0, 2), (7, 3), (9, 1)]


def test_hard_negatives_of_large_values(spark) -> None:  # noqa: ANN001
    """Scores beyond the integers that doubles hold, one apart."""
    big = float(1 << 22)
    rows = [(0, 1, [big, 0.5]), (1, 1, [big, 0.5]), (2, 2, [big, 0.5 - 1 / 256]), (3, 2, [big, 0.5]), (4, 2, [big, 0.5 + 1 / 256]), (5, 1, [big, 0.5 - 2 / 256])]
    assert _hard(_vectors(spark, rows)) == _brute(rows) != []


def test_hard_negatives_against_sql(spark) -> None:  # noqa: ANN001
    df = hard.relabelled(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"))
    con = duckdb.connect()
    con.sql("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    assert _hard(df) == sorted(con.sql(HARD_NEGATIVES).fetchall(), key=repr)


def test_bounds_discard(spark) -> None:  # noqa: ANN001
    """Where a few directions hold most of the lengths, nearly all pairs go before they are verified."""
    rng = np.random.default_rng(0)
    x = np.floor(256 * rng.normal(0, 1, (2000, 4)) @ rng.normal(0, 1, (4, 64)))
    axes, steps = np.linalg.eigh(x.T @ x)[1][:, ::-1], hard._steps(64)
    a, b = hard._Side(x[:20], axes, steps), hard._Side(x, axes, steps)
    i, j = hard._promising(a, b, np.arange(20)[:, None] != np.arange(2000), np.full(20, -np.inf), np.full(20, np.inf), steps, 5)
    exact = x[:20] @ x.T
    assert len(i) < 20 * 100
    exact[np.arange(20), np.arange(20)] = -np.inf
    for k in range(20):
        assert set(np.argsort(-exact[k])[:5]) <= set(j[i == k].tolist())


# Collocations.


def _collocations(rows: list, least: int, top: int = 2000, longest: int = 5) -> list:
    """rows: (lang, text)."""
    counts: dict = defaultdict(Counter)
    for lang, text in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            for size in range(1, longest + 1):
                counts[lang or "und"].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, f in counts.items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        often = {p: v for p, v in f.items() if v >= least}
        inside = {p[i : i + k] for p in often for k in range(1, len(p)) for i in range(len(p) - k + 1) if often[p] >= f[p[i : i + k]]}
        scored = []
        for p, a in often.items():
            if len(p) > 1 and p not in inside:
                s, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-s, -a, " ".join(p).encode(), a, f[p[:k]], f[p[k:]], n, s))
        out += [(lang, k, x[2].decode(), *x[3:]) for k, x in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def _mined(df, **options) -> list:  # noqa: ANN001, ANN003
    return sorted(tuple(r) for r in col.collocations(df, **options).collect())


ODD_TEXTS = [
    ("en", "The cat sat. The cat sat, the CAT sat on the mat"), ("en", None), ("en", ""), (None, "a b c a b c a b c"), ("und", "a b c"), ("en", "the cat\tsat \t on\nthe mat\x0bthe cat\x0csat\rx"),
    ("de", "Ä ä Straße Straße Straße. É"), ("fr", "a\u00a0b a\u00a0b a\u2028b"), ("en", " , . ; "), ("en", "x " * 500), ("en", "the cat sat on the mat"), ("en", "the cat sat on the mat"), ("zz", "\x00 \x1c \x1c a\x85b \x1c \x1c"), ("en", "w" * 5000 + " " + "w" * 5000),
]


@pytest.mark.parametrize(("least", "block", "share"), [(1, 6 << 20, 10**6), (2, 40, 3), (3, 1, 10**6)])
def test_collocations_of_odd_texts(spark, monkeypatch, least: int, block: int, share: int) -> None:  # noqa: ANN001
    monkeypatch.setattr(col, "BLOCK_BYTES", block)
    monkeypatch.setattr(col, "SHARE_KEYS", share)
    df = spark.createDataFrame([(lang, text, 1, "k", 2) for lang, text in ODD_TEXTS], "lang string, text string, size long, phrase string, id long")
    assert _mined(df, least=least) == _collocations(ODD_TEXTS, least) != []
    assert _mined(df, least=least, top=3) == _collocations(ODD_TEXTS, least, 3)
    assert _mined(df.limit(0)) == [] and _mined(df, least=10**6) == []


def test_collocations_of_random_texts(spark, monkeypatch) -> None:  # noqa: ANN001
    monkeypatch.setattr(col, "BLOCK_BYTES", 700)
    rng = random.Random(3)
    rows = [(rng.choice(["en", "de", None]), " ".join(rng.choice(["a", "b", "c", "d.", "e,", "F", "a b c d"]) for _ in range(rng.randint(0, 60)))) for _ in range(120)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    assert _mined(df, least=5) == _collocations(rows, 5)
    assert _mined(df, least=2, longest=3) == _collocations(rows, 2, longest=3)


def test_collocations_against_sql(spark) -> None:  # noqa: ANN001
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    many = docs.crossJoin(spark.range(3)).select("lang", "text")
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT lang, text FROM '/root/testdata/sf0.001/documents.parquet', range(3)")
    assert _mined(many) == sorted(con.sql(COLLOCATIONS).fetchall())


def test_scores_pass_64_bits(spark) -> None:  # noqa: ANN001
    """1000 a n of a phrase that occurs often in a long text stays exact."""
    rows = [("en", "a b " * 40000)] * 3
    got = _mined(spark.createDataFrame(rows, "lang string, text string"))
    assert got == _collocations(rows, 100)
