r"""Phrase collocation mining by vertical positional inverted lists.

Texts are lower-cased (A to Z) and cut at `[.,;:!?\x0A-\x0D]` into pieces, pieces at spaces and tabs into words.
Everything is counted for each language.

1. Tasks write an index: a row for each block of whole texts of one language (about BLOCK_BYTES of text), with the
   block's words and, for each word, the ascending list of its places. A piece's end takes a place of its own, so places
   of different pieces are never adjacent.
2. A word's frequency is the length of its lists over all blocks. Blocks send list lengths, not places: the words of a
   block are dealt by hash to shares, and a share adds up the lengths of its words over the blocks, keeps what is frequent,
   gives it a number and tells each block which of its lists go on.
3. Lists of k words are extended: the lists of a block are merged by place, and a phrase at place s goes on with the phrase
   at s + 1, which shares k - 1 words with it and ends in the adjacent word. Of the adjacent word's postings, those are the
   ones where the longer phrase's last k words are frequent too; no other extension can be frequent. Lengths of the
   extended lists are added up as in 2, and frequent ones are written as the lists of k + 1 words.
4. The frequencies of a phrase's first and last words come down from the two phrases that it was joined from, so scores
   need no lookup of texts. Ranks are global prefix sums in order of the score.

No list is ever whole in one task, so a word that a third of all places hold is nothing special: every block has its part
of the list, and sends one number for it. Memory holds one block, or one share of the candidates (SHARE_KEYS of them);
shares grow in number with the candidates.

Defined results: null and empty texts have no words; a null language counts as `und`; repeated rows count each; a table
without words or without frequent phrases gives no rows; identifiers are not looked at, nor are other columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import dropped, placed, short_batches, shuffle_partitions, stored, with_prefix

#: Bytes of text in a block, and of all blocks that a task has open (one for each language).
BLOCK_BYTES, OPEN_BYTES = 6 << 20, 48 << 20
#: Distinct candidates of all blocks together that a share is meant to hold.
SHARE_KEYS = 2_000_000
#: Piece ends become a byte that UTF-8 never has; what is left of white space divides words.
_END = b"\xff"
_CUT = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", _END * 10)

_INDEX = "block long, lang string, n long, words array<binary>, lens array<int>, steps array<int>"
_LISTS = "block long, ids array<long>, lens array<int>, steps array<int>"
#: What a share gives: for block -1 its frequent keys and their lengths, else which of a block's candidates go on.
_WORD_HITS = "block long, lang string, words array<binary>, ids array<long>, sums array<long>, codes array<int>"
_PAIR_HITS = "block long, lefts array<long>, rights array<long>, ids array<long>, sums array<long>"


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = []
    for part in schema.split(", "):
        name, kind = part.split(" ")
        fields.append((name, pa.list_(kinds[kind[6:-1]]) if kind.startswith("array") else kinds[kind]))
    return pa.schema(fields)


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    arrow = _arrow(schema)
    columns = zip(*rows, strict=True) if rows else [[] for _ in arrow]
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


def _steps(places: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Ascending lists, one after another, as differences; each list starts anew from 0. Small numbers pack well."""
    out = np.diff(places, prepend=0).astype(np.int32)
    first = np.cumsum(lens) - lens
    out[first[lens > 0]] = places[first[lens > 0]]
    return out


def _places(steps: np.ndarray, lens: np.ndarray) -> np.ndarray:
    total = np.cumsum(steps, dtype=np.int64)
    first = np.cumsum(lens) - lens
    before = np.where(first > 0, total[np.maximum(first - 1, 0)], 0) if len(total) else np.zeros(len(lens), np.int64)
    return total - np.repeat(before, lens)


def _lists(column: pa.ChunkedArray | pa.Array, k: int, dtype: type) -> np.ndarray:
    return np.asarray(column[k].values, dtype=dtype)


def _taken(places: np.ndarray, lens: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """The places of some of the lists, in the order of `keep`."""
    n = lens[keep]
    first = (np.cumsum(lens) - lens)[keep]
    ends = np.cumsum(n)
    return places[np.repeat(first - (ends - n), n) + np.arange(n.sum())]


def _indexed(block: int, lang: str, texts: list[bytes]) -> pa.RecordBatch:
    """The index row of a block."""
    tokens = pa.array((b" \xff ".join(texts)).lower().translate(_CUT).replace(_END, b" \xff ").split(), pa.binary())
    coded = tokens.dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int32)
    words = coded.dictionary
    order = np.argsort(codes, kind="stable")
    lens = np.bincount(codes, minlength=len(words))
    end = words.index(_END).as_py()
    if end >= 0:
        order = order[codes[order] != end]
        keep = np.arange(len(words)) != end
        words, lens = words.filter(pa.array(keep)), lens[keep]
    steps = _steps(order, lens)
    listed = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (words, pa.array(lens.astype(np.int32)), pa.array(steps))]
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([lang]), pa.array([int(lens.sum())], pa.int64()), *listed], schema=_arrow(_INDEX))


def _index(docs: DataFrame) -> DataFrame:
    """_INDEX rows of docs (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        block = TaskContext.get().partitionId() << 32

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                held.setdefault(lang, []).append(text)
                size[lang] = size.get(lang, 0) + len(text)
                while size and (size[lang] >= BLOCK_BYTES or sum(size.values()) >= OPEN_BYTES):
                    full = max(size, key=size.get)
                    yield _indexed(block, full, held.pop(full))
                    block += 1
                    del size[full]
                    if full == lang:
                        break
        for lang, texts in held.items():
            yield _indexed(block, lang, texts)
            block += 1

    return docs.mapInArrow(run, _INDEX)


def _each(column: pa.ChunkedArray) -> list[pa.Array]:
    """The values of each row's list."""
    return [chunk[k].values for chunk in column.chunks for k in range(len(chunk))]


def _dealt(block: int, at: np.ndarray, shares: int, columns: list[pa.Array], head: list, schema: pa.Schema) -> pa.RecordBatch:
    """A row for each share that has any of the columns' rows, which it gets in one list for each column."""
    order = np.argsort(at, kind="stable")
    cuts = np.searchsorted(at[order], np.arange(shares + 1))
    full = np.flatnonzero(np.diff(cuts))
    bounds = pa.array(np.append(cuts[full], cuts[-1]), pa.int32())
    lists = [pa.ListArray.from_arrays(bounds, c.take(pa.array(order))) for c in columns]
    fixed = [pa.array([v] * len(full), f.type) for v, f in zip([block, *head], list(schema)[1:], strict=False)]
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *fixed, *lists], schema=schema)


def _frequent_words(index: DataFrame, least: int, shares: int) -> DataFrame:
    """_WORD_HITS: the frequent words of each language, and for each block the codes of its frequent words."""
    chunk = "share int, block long, lang string, words array<binary>, codes array<int>, lens array<int>"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for k in range(batch.num_rows):
                words = batch.column(2)[k].values
                if len(words):
                    at = (np.fromiter((xxhash.xxh64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words)) % np.uint64(shares)).astype(np.int64)
                    columns = [words, pa.array(np.arange(len(words), dtype=np.int32)), batch.column(3)[k].values]
                    yield _dealt(batch.column(0)[k].as_py(), at, shares, columns, [batch.column(1)[k].as_py()], _arrow(chunk))

    def add(key: tuple, table: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        # The share and a place in it make a number that no other share gives.
        used = key[0].as_py() << 40
        langs = np.array(table["lang"].to_pylist())
        for lang in sorted(set(langs.tolist())):
            own = table.filter(pa.array(langs == lang))
            words = pa.concat_arrays(_each(own["words"])).dictionary_encode()
            which, lens = words.indices.to_numpy(), np.concatenate([c.to_numpy() for c in _each(own["lens"])])
            sums = np.bincount(which, weights=lens, minlength=len(words.dictionary)).astype(np.int64)
            often = np.flatnonzero(sums >= least)
            if not len(often):
                continue
            number = np.full(len(sums), -1, np.int64)
            number[often] = np.arange(used, used + len(often))
            rows.append((-1, lang, words.dictionary.take(pa.array(often)).to_pylist(), number[often], sums[often], None))
            used += len(often)
            at = 0
            for block, codes in zip(own["block"].to_pylist(), _each(own["codes"]), strict=True):
                now = number[which[at : at + len(codes)]]
                at += len(codes)
                if (now >= 0).any():
                    rows.append((block, lang, None, now[now >= 0], None, codes.to_numpy()[now >= 0]))
        return _table(_WORD_HITS, rows)

    return index.select("block", "lang", "words", "lens").mapInArrow(deal, chunk).groupBy("share").applyInArrow(add, _WORD_HITS)


def _first_lists(index: DataFrame, hits: DataFrame) -> DataFrame:
    """_LISTS of the frequent words."""

    def run(key: tuple, own: pa.Table, told: pa.Table) -> pa.Table:
        if not own.num_rows or not told.num_rows:
            return _table(_LISTS, [])
        codes = np.concatenate([c.to_numpy() for c in _each(told["codes"])])
        ids = np.concatenate([c.to_numpy() for c in _each(told["ids"])])
        lens = _each(own["lens"])[0].to_numpy()
        places = _places(_each(own["steps"])[0].to_numpy(), lens)
        return _table(_LISTS, [(key[0].as_py(), ids, lens[codes], _steps(_taken(places, lens, codes), lens[codes]))])

    blocks = index.select("block", "lens", "steps").groupBy("block")
    return blocks.cogroup(hits.filter("block >= 0").select("block", "ids", "codes").groupBy("block")).applyInArrow(run, _LISTS)


def _extended(lens: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, lens, places) of the extensions in a block: the lists merged by place, and places that follow one
    another joined; left and right are the numbers of the two lists in the block."""
    owner = np.repeat(np.arange(len(lens)), lens)
    places = _places(steps, lens)
    order = np.argsort(places, kind="stable")
    places, owner = places[order], owner[order]
    here = np.flatnonzero(places[1:] == places[:-1] + 1)
    pair = owner[here] * len(lens) + owner[here + 1]
    by = np.argsort(pair, kind="stable")
    pair, first = pair[by], np.flatnonzero(np.diff(pair[by], prepend=-1))
    return pair[first] // max(len(lens), 1), pair[first] % max(len(lens), 1), np.diff(first, append=len(pair)), places[here][by]


def _frequent_pairs(lists: DataFrame, least: int, shares: int) -> DataFrame:
    """_PAIR_HITS of the extensions of lists: what they were joined from, their numbers and lengths."""
    chunk = "share int, block long, lefts array<long>, rights array<long>, lens array<int>"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, lens = batch.column(1)[k].values.to_numpy(), batch.column(2)[k].values.to_numpy()
                left, right, n, _ = _extended(lens, batch.column(3)[k].values.to_numpy())
                if len(n):
                    left, right = ids[left], ids[right]
                    mixed = (left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (right.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
                    at = ((mixed >> np.uint64(29)) % np.uint64(shares)).astype(np.int64)
                    yield _dealt(batch.column(0)[k].as_py(), at, shares, [pa.array(left), pa.array(right), pa.array(n.astype(np.int32))], [], _arrow(chunk))

    def add(key: tuple, table: pa.Table) -> pa.Table:
        left, right, lens = (np.concatenate([c.to_numpy() for c in _each(table[name])]) for name in ("lefts", "rights", "lens"))
        order = np.lexsort((right, left))
        new = np.empty(len(order), bool)
        new[:1] = True
        new[1:] = (np.diff(left[order]) != 0) | (np.diff(right[order]) != 0)
        first = np.flatnonzero(new)
        sums = np.add.reduceat(lens[order].astype(np.int64), first)
        often = np.flatnonzero(sums >= least)
        if not len(often):
            return _table(_PAIR_HITS, [])
        number = np.full(len(sums), -1, np.int64)
        number[often] = (key[0].as_py() << 40) + np.arange(len(often))
        ids = np.empty(len(order), np.int64)
        ids[order] = np.repeat(number, np.diff(first, append=len(order)))
        at = order[first[often]]
        rows = [(-1, left[at], right[at], number[often], sums[often])]
        at = 0
        for block, own in zip(table["block"].to_pylist(), _each(table["lens"]), strict=True):
            part = slice(at, at + len(own))
            at += len(own)
            keep = ids[part] >= 0
            if keep.any():
                rows.append((block, left[part][keep], right[part][keep], ids[part][keep], None))
        return _table(_PAIR_HITS, rows)

    return lists.mapInArrow(deal, chunk).groupBy("share").applyInArrow(add, _PAIR_HITS)


def _next_lists(lists: DataFrame, hits: DataFrame) -> DataFrame:
    """_LISTS of the frequent extensions."""

    def run(key: tuple, own: pa.Table, told: pa.Table) -> pa.Table:
        if not own.num_rows or not told.num_rows:
            return _table(_LISTS, [])
        ids, lens, steps = (_each(own[name])[0].to_numpy() for name in ("ids", "lens", "steps"))
        lefts, rights, numbers = (np.concatenate([c.to_numpy() for c in _each(told[name])]) for name in ("lefts", "rights", "ids"))
        left, right, n, places = _extended(lens, steps)
        # Where each list's number stands in the block.
        by = np.argsort(ids)
        want = by[np.searchsorted(ids, lefts, sorter=by)] * len(ids) + by[np.searchsorted(ids, rights, sorter=by)]
        keep = np.searchsorted(left * len(ids) + right, want)
        return _table(_LISTS, [(key[0].as_py(), numbers, n[keep], _steps(_taken(places, n, keep), n[keep]))])

    return lists.groupBy("block").cogroup(hits.filter("block >= 0").select("block", "lefts", "rights", "ids").groupBy("block")).applyInArrow(run, _LISTS)


def _listed(hits: DataFrame, *names: str) -> DataFrame:
    """A row for each frequent key of stored hits."""
    zipped = F.explode(F.arrays_zip(*names)).alias("x")
    keep = [c for c in ("lang",) if c in hits.columns]
    return hits.filter("block = -1").select(*keep, zipped).select(*keep, *(f"x.{n}" for n in names))


def frequent_phrases(df: DataFrame, longest: int = 5, least: int = 100, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(phrases, totals). phrases, stored: size, lang, id, phrase, last, left, right, f, firsts, lasts of the phrases of 1 to
    `longest` words that occur `least` times or more; left and right are the numbers of the first and the last size - 1
    words, firsts and lasts the frequencies of the first and the last 1 to size words. totals: lang, n (all words)."""
    spark = df.sparkSession
    short_batches(spark)
    docs = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).filter("text IS NOT NULL AND text != ''")
    index = stored(_index(docs), "index")
    totals = stored(index.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    partitions = shuffle_partitions(spark)
    distinct = index.agg(F.sum(F.size("words"))).first()[0] or 0
    hits = stored(_frequent_words(index, least, max(partitions, -(-distinct // SHARE_KEYS))), "hits")
    none = F.lit(None).cast("long")
    words = _listed(hits, "words", "ids", "sums").select(F.lit(1).alias("size"), "lang", F.col("ids").alias("id"), F.col("words").cast("string").alias("phrase"), none.alias("left"), none.alias("right"), F.col("sums").alias("f"))
    level = stored(words.select("*", F.col("phrase").alias("last"), F.array("f").alias("firsts"), F.array("f").alias("lasts")), "phrases")
    levels = [level]
    lists = stored(_first_lists(index, hits), "lists")
    dropped(index, hits)
    for size in range(2, longest + 1):
        # No more candidates than places.
        places = lists.agg(F.sum(F.size("steps"))).first()[0] or 0
        hits = stored(_frequent_pairs(lists, least, max(partitions, -(-places // SHARE_KEYS))), "hits")
        pairs = _listed(hits, "lefts", "rights", "ids", "sums")
        a = level.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("head"), "firsts")
        b = level.select(F.col("id").alias("right"), "last", "lasts")
        joined = pairs.withColumnRenamed("lefts", "left").withColumnRenamed("rights", "right").join(a, "left").join(b, "right")
        sums = F.array("sums")
        level = stored(joined.select(F.lit(size).alias("size"), "lang", F.col("ids").alias("id"), F.concat_ws(" ", "head", "last").alias("phrase"), "left", "right", F.col("sums").alias("f"), "last", F.concat("firsts", sums).alias("firsts"), F.concat("lasts", sums).alias("lasts")), "phrases")
        levels.append(level)
        after = stored(_next_lists(lists, hits), "lists") if size < longest else None
        dropped(hits, lists)
        if after is None:
            break
        lists = after
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out, totals


def collocations(df: DataFrame, longest: int = 5, least: int = 100, top: int = 2000, cover_pct: int = 100, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first `top` phrases of two words or more. A phrase's score is
    that of its weakest cut, floor(1000 a n / (l r)); phrases inside a longer one that is as frequent (cover_pct of their
    frequency) are left out."""
    phrases, totals = frequent_phrases(df, longest, least, lang_col, text_col)
    phrases = phrases.filter("size > 1")
    # A phrase that a longer one covers is covered by one of a single word more, which is as frequent at least.
    longer = phrases.filter("size > 2").select(F.col("size").alias("of"), F.col("f").alias("g"), F.explode(F.array("left", "right")).alias("part"))
    covers = longer.groupBy("of", "part").agg(F.max("g").alias("g"))
    inside = (F.col("of") == F.col("size") + 1) & (F.col("part") == F.col("id")) & (F.col("g") * 100 >= F.col("f") * cover_pct)
    left = phrases.join(covers, inside, "left_anti").join(totals, "lang")
    # In decimals: the product of a, n and 1000 passes 64 bits.
    first, rest = "firsts[k - 1]", "lasts[size - k - 1]"
    score = f"(CAST(f AS DECIMAL(17,0)) * CAST(n AS DECIMAL(17,0)) * 1000BD) DIV (CAST({first} AS DECIMAL(19,0)) * CAST({rest} AS DECIMAL(19,0)))"
    weakest = F.expr(f"array_min(transform(sequence(1, size - 1), k -> named_struct('score', {score}, 'k', k, 'l', {first}, 'r', {rest})))")
    scored = left.select("lang", "phrase", F.col("f").alias("a"), "n", weakest.alias("b"))
    ranked = scored.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score", (-F.col("b.score")).alias("down"), (-F.col("a")).alias("rare"), F.lit(1).cast("long").alias("one"))
    order = ["down", "rare", "phrase"]
    out = with_prefix(placed(ranked, order, ["lang"], "scores"), order, {"before": "one"}, ["lang"])
    return out.filter(F.col("before") < top).select("lang", (F.col("before") + 1).cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
