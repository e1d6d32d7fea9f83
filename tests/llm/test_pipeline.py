"""The pipeline against a plain Python version of its stages."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _clean(text: str | None) -> str | None:
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = {g for g, n in Counter(grams).items() if n > 1}
    covered = {i + k for i, g in enumerate(grams) if g in often for k in range(3)}
    if len(w) < 50 or 100 * len(covered) > 50 * len(w):
        return None
    good = []
    for line in dict.fromkeys(x for x in text.split("\n") if WORD.search(x)):
        n = len(WORD.findall(line))
        noise = sum(1 for x in WORD.findall(line) if re.search(r"[#*$%&|<>]|!!", x))
        ends = re.search(r"[.!?:;…\"'”’»)\]][\x20\x09-\x0D]*\Z", line) or n > 12
        if n <= 30 and re.search(r"(?i)all rights reserved|cookies? policy|privacy policy|sign (?:in|up)\b|click here", line):
            continue
        if ends and noise * 100 < n * 20 and len(re.findall(r"[|»›•]", line)) * 5 <= n:
            good.append(line)
    out = "\n".join(good)
    return out if len(WORD.findall(out)) * 100 >= len(w) * 50 else None


def _shingles(text: str) -> frozenset:
    w = text.encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def _mixed(docs: dict[int, tuple[str, str]]) -> dict[int, Counter]:
    sizes = {d: len(WORD.findall(t)) for d, (t, _) in docs.items()}
    total = defaultdict(int)
    for d, (_, s) in docs.items():
        total[s] += sizes[d]
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(total))}
    full: set = set()
    while True:
        rest = sum(total.values()) - sum(3 * total[s] for s in full)
        w = sum(weight[s] for s in total if s not in full)
        target = {s: 3 * total[s] if s in full else weight[s] * rest / w for s in total}
        over = {s for s in total if s not in full and target[s] > 3 * total[s]}
        if not over:
            break
        full |= over
    rows: dict[int, Counter] = defaultdict(Counter)
    for s in total:
        budget = int(target[s] + 0.5)
        order = sorted((hashlib.md5(f"0:{d}".encode()).hexdigest(), d) for d, (_, x) in docs.items() if x == s)
        whole, left = budget // total[s], budget % total[s]
        for _, d in order:
            take = min(sizes[d], left)
            left -= take
            n = whole + (take == sizes[d])
            if n:
                rows[d][docs[d][0]] += n
            if 0 < take < sizes[d]:
                rows[d][" ".join(WORD.findall(docs[d][0])[:take])] += 1
    return rows


def test_pipeline_against_brute_force(spark) -> None:  # noqa: ANN001
    table = spark.read.parquet(f"{SF}/documents.parquet").collect()
    docs = {r["doc_id"]: (c, r["source"]) for r in table if (c := _clean(r["text"])) is not None}
    first: dict[str, int] = {}
    for d in sorted(docs):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", docs[d][0]), d)
    docs = {d: docs[d] for d in first.values()}
    sets = {d: _shingles(t) for d, (t, _) in docs.items()}
    parent = {d: d for d in docs}

    def root(d: int) -> int:
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    docs = {d: v for d, v in docs.items() if root(d) == d}
    want = _mixed(docs)

    now = spark.read.parquet(f"{SF}/documents.parquet")
    columns = now.columns
    for _, stage in corpus_pipeline.STAGES[:4]:
        now = stage(spark, now, SF)
        assert now.columns == columns
    got: dict[int, Counter] = defaultdict(Counter)
    for r in now.collect():
        got[r["doc_id"]][r["text"]] += 1
        assert r["n_chars"] == len(r["text"])
    assert got == want

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {d: sum((len(library.encode(t, add_special_tokens=False).ids) + 1) * n for t, n in c.items()) for d, c in want.items()}
    pieces = corpus_pipeline.run(spark, SF).collect()
    out: Counter = Counter()
    for r in pieces:
        out[r["doc_id"]] += r["length"]
    assert out == tokens


def test_stages_of_an_empty_table(spark) -> None:  # noqa: ANN001
    now = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
    assert now.count() == 0


def test_stages_with_nulls_and_clashing_names(spark) -> None:  # noqa: ANN001
    text, own = (" ".join(f"{w}{i}" for i in range(80)) + "." for w in ("word", "own"))
    rows = [(1, text, None, "x", 1), (2, None, "s", "y", 2), (None, text + " more.", "s", None, 3), (1, text, None, "x", 1), (3, text.upper(), "s", "z", 4), (None, own, "s", None, 5)]
    now = spark.createDataFrame(rows, "doc_id long, text string, source string, norm string, size int")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        now = stage(spark, now, SF)
        assert now.columns == ["doc_id", "text", "source", "norm", "size"]
        # The row without an identifier that is like no other stays through every stage.
        assert any(r["doc_id"] is None and r["text"] == own for r in now.collect()) or k == 3
    # 160 words; s weighs 1 and the null source 2: 53 words of one, 107 of the other.
    got = Counter((r["doc_id"], r["size"], len(r["text"].split())) for r in now.collect())
    assert got == Counter([(None, 5, 53), (1, 1, 80), (1, 1, 27)])
    pieces = corpus_pipeline.STAGES[4][1](spark, now, SF).collect()
    assert {r["doc_id"] for r in pieces} == {None, 1}


def test_run_leaves_only_what_its_result_reads(spark) -> None:  # noqa: ANN001
    from netloom.llm.common import release, shared_dir, stored, written

    release(spark)
    pieces = corpus_pipeline.run(spark, SF)
    assert pieces.count() > 0
    names = sorted(f.rstrip("/").rsplit("/", 1)[1].rsplit("-", 1)[0] for f in written(spark))
    assert names == ["mixing", "pieces"]
    kept = stored(spark.range(3).toDF("a"), "kept")
    assert kept.count() == 3 and shared_dir(spark)
    release(spark)
    assert not written(spark)
