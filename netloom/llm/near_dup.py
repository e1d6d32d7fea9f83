"""MinHash near-dedup with sequential Bayesian verification.

1. One pass over whole texts hashes each document's distinct shingles (five words; the whole sequence where there are
   fewer) to 64 bits, and gives a digest of the set and a MinHash signature. Documents with equal sets are one class
   from here on, named by the smallest of its stored row keys; identifiers only come back in the output.
2. Signatures are cut into bands; classes that share a band are candidates. A band's classes are not paired with each
   other: all are compared with the one of the smallest identifier (its pivot), which is linear in a band's size.
3. Candidates' signatures are compared batch by batch. With a uniform prior the similarity after m of n equal values is
   Beta(m + 1, n - m + 1); a pair goes as soon as the chance that it reaches the threshold is below `miss`.
4. Surviving candidates are verified exactly on full shingle sets; verified links give components.
5. Only where a band still holds classes of different components are its classes compared with each other, signatures
   in blocks inside a task. A pair between components that passes 3 is noted in the row of its first class, in the
   first band that both share; texts then meet in the same blocks and are verified there. A large band is cut into
   blocks, and each two blocks meet in one task: no candidate pair that could join two components is left out, none is
   ever a row of its own, and no task holds more than two blocks. Blocks grow with the root of a band's size, so the
   rows of n classes are n ** 1.5 / 16 and no more than n ** 2 / 16384, and they hold a bounded number of shingles.
   Components of all verified links are the result.

Sets whose sizes differ by more than the threshold allows cannot be linked (the intersection is no larger than the
smaller set, the union no smaller than the larger), so such pairs go before anything is compared.

With 32 bands of 4 values a pair at similarity 0.75 shares no band with probability 5e-6.

Defined results: null and word-less texts have an empty set and stand alone; a null identifier never names a component
unless it has no other; rows that share an identifier are judged each by its own text; repeated rows have equal sets and
so one component; of each component exactly one row is kept, one with the smallest identifier; an empty table gives no
rows; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import dropped, short_batches, stored, worker_cache
from netloom.llm.components import components

WORDS, BANDS, ROWS, BATCH = 5, 32, 4, 32
#: Classes of a band that are compared in one block: 16 times the root of the band's classes, within BLOCK and
#: 32 * BLOCK. A block of texts to verify holds about BLOCK_SHINGLES shingles (8 bytes each) and BLOCK_BYTES of text, or one
#: document.
BLOCK = 512
BLOCK_SHINGLES, BLOCK_BYTES = 1 << 22, 32 << 20
#: Rows of a table of crowded bands or of large components, under 50 bytes each, that may be broadcast; larger ones are
#: joined by a shuffle.
BROADCAST_BANDS = 1_000_000
#: Bits of the table that tells which texts may be needed; its size does not depend on the data.
FILTER_BITS = 1 << 22
HASHES = BANDS * ROWS
#: Word hashes kept in a worker, about 150 bytes each.
WORDS_KEPT = 100_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word)
        if len(self) < WORDS_KEPT:
            self[word] = h
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, k: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's shingles; A to Z count as a to z."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(worker_cache("word hashes", _WordHashes).__getitem__, words), np.uint64, len(words))
    n = max(len(words) - k + 1, 1)
    out = np.full(n, np.uint64(min(len(words), k)))
    for j in range(min(len(words), k)):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    return np.unique(_mixed(out))


def _coefficients(seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, 1 << 64, HASHES, dtype=np.uint64) | np.uint64(1), r.integers(0, 1 << 64, HASHES, dtype=np.uint64)


def signature(sets: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of each hash over the set, 32 bits each. Any length of set takes the same memory."""
    out = np.full(HASHES, np.uint64((1 << 64) - 1))
    for at in range(0, len(sets), 256):
        np.minimum(out, (((sets[at : at + 256, None] ^ b) * a) >> np.uint64(32)).min(axis=0), out=out)
    return out.astype("<u4")


def least_matches(n: int, threshold: float, miss: float) -> int:
    """The fewest equal values of n with which a pair goes on: P(similarity >= threshold) is at least miss.

    For a Beta(m + 1, n - m + 1) posterior that probability is P(Bin(n + 1, threshold) <= m)."""
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def _fingerprints(df: DataFrame, seed: int) -> DataFrame:
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _coefficients(seed)
        for batch in batches:
            size, low, high, sig = [], [], [], []
            volume = pc.coalesce(pc.binary_length(batch.column(2)), 0).cast(pa.int64())
            for text in batch.column(2).to_pylist():
                s = shingles(text)
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                size.append(len(s))
                low.append((d & (1 << 64) - 1) - (1 << 63))
                high.append((d >> 64) - (1 << 63))
                sig.append(signature(s, a, b).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(sig, pa.binary()), volume], names=["row", "doc_id", "n_shingles", "high", "low", "sig", "bytes"])

    return df.mapInArrow(run, "row long, doc_id long, n_shingles long, high long, low long, sig binary, bytes long")


def _band_keys(sig: np.ndarray) -> np.ndarray:
    """A key for each band of each signature."""
    parts = sig.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2])
    for r in range(ROWS):
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key.view(np.int64)


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, HASHES)


def _banded(classes: DataFrame) -> DataFrame:
    """band, rep, rank, size, bytes: a row for each class and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _band_keys(_signatures(batch.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *(pa.array(np.repeat(batch.column(c).to_numpy(zero_copy_only=False), BANDS)) for c in (0, 2, 3, 4))], names=["band", "rep", "rank", "size", "bytes"])

    # The order in which pivots are chosen, by identifier; any order gives right results.
    rank = F.coalesce("lead.doc_id", F.lit(1 << 62) + F.col("lead.row"))
    return classes.select("rep", "sig", rank.alias("rank"), "size", "bytes").mapInArrow(run, "band long, rep long, rank long, size long, bytes long")


def _may_link(x: str, y: str, pct: int) -> Column:
    """Whether sets of these sizes can reach the threshold."""
    return F.least(x, y) * 100 >= F.greatest(x, y) * pct


def _promising(pairs: DataFrame, classes: DataFrame, threshold: float, miss: float) -> DataFrame:
    """a, b, matches of the pairs that pass every batch of their signatures."""
    least = [(n, least_matches(n, threshold, miss)) for n in range(BATCH, HASHES + 1, BATCH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = _signatures(batch.column(2)), _signatures(batch.column(3))
            on, matches, done = np.arange(len(x)), np.zeros(len(x), np.int64), 0
            for n, m in least:
                matches[on] += (x[on, done:n] == y[on, done:n]).sum(axis=1)
                on, done = on[matches[on] >= m], n
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(on)), batch.column(1).take(pa.array(on)), pa.array(matches[on])], names=["a", "b", "matches"])

    side = classes.select("rep", "sig")
    both = pairs.join(side.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a").join(side.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b")
    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long, matches long")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """The runs of equal values in the first `keys` columns, which may cross batches."""
    held: list[pa.RecordBatch] = []
    last: tuple = ()
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy() for c in range(keys)], axis=1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(key[x].tolist())
            if held and now != last:
                yield last, held
                held = []
            last = now
            held.append(batch.slice(x, y - x))
    if held:
        yield last, held


def _matching(band: int, rep: np.ndarray, label: np.ndarray, block: np.ndarray, size: np.ndarray, sig: np.ndarray, least: list[tuple[int, int]], pct: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs with different labels (and, of two blocks, one in each) whose sizes permit a link, that pass
    every batch and share no band before this one."""
    left, right = [], []
    two = block.min() != block.max()
    bands = _band_keys(sig)
    own = int(np.flatnonzero(bands[0] == band)[0])
    step = max(1, min(32, (1 << 17) // len(rep)))
    for at in range(0, len(rep), step):
        part = slice(at, at + step)
        can = (label[part, None] != label[None, :]) & (rep[part, None] < rep[None, :])
        can &= np.minimum(size[part, None], size[None, :]) * 100 >= np.maximum(size[part, None], size[None, :]) * pct
        if two:
            can &= block[part, None] != block[None, :]
        i, j = np.nonzero(can)
        matches, done = (sig[at + i, :BATCH] == sig[j, :BATCH]).sum(axis=1), BATCH
        ok = matches >= least[0][1]
        i, j, matches = i[ok], j[ok], matches[ok]
        for n, m in least[1:]:
            matches = matches + (sig[at + i, done:n] == sig[j, done:n]).sum(axis=1)
            ok = matches >= m
            i, j, matches, done = i[ok], j[ok], matches[ok], n
        ok = ~(bands[at + i, :own] == bands[j, :own]).any(axis=1)
        left.append(at + i[ok])
        right.append(j[ok])
    return np.concatenate(left), np.concatenate(right)


def _forest(links: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of links, those that join what earlier ones do not: the same components with fewer links than nodes."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    out = []
    for u, v in links:
        x, y = root(u), root(v)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((u, v))
    return out


def _between(told: DataFrame, classes: DataFrame, docs: DataFrame, threshold_pct: int, miss: float) -> tuple[DataFrame, DataFrame]:
    """u, v of verified links that join all linked classes that share a band of told (band, rep, label, size, blocks)
    under different labels, and a stored table that they are read from; blocks is the band's number of blocks."""
    least = [(n, least_matches(n, threshold_pct / 100, miss)) for n in range(BATCH, HASHES + 1, BATCH)]
    key = ["band", "low", "high"]

    def note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for now, parts in _groups(batches, 3):
            rep, label, block, size = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in (3, 4, 5, 6))
            sig = np.concatenate([_signatures(p.column(7)) for p in parts])
            i, j = _matching(now[0], rep, label, block, size, sig, least, threshold_pct)
            if not len(i):
                continue
            places, at = np.unique(np.concatenate([i, j])), np.argsort(i, kind="stable")
            ends = np.searchsorted(i[at], places, "right")
            partners = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(rep[j[at]]))
            yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(places), k)) for k in now), pa.array(rep[places]), partners], names=[*key, "rep", "partners"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _groups(batches, 3):
            sets = {rep: shingles(text) for p in parts for rep, text in zip(p.column(3).to_pylist(), p.column(5).to_pylist(), strict=True)}
            found = _forest((rep, other) for p in parts for rep, others in zip(p.column(3).to_pylist(), p.column(4).to_pylist(), strict=True) for other in others if _linked(sets[rep], sets[other], threshold_pct))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["u", "v"])

    rows = told.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    # In a band of one block a class is one row; else it is one row for each block that its own meets.
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "rep", "label", "block", "size")
    rows = rows.join(classes.select("rep", "sig"), "rep").select(*key, "rep", "label", "block", "size", "sig")
    noted = stored(rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(note, "band long, low long, high long, rep long, partners array<long>"), "noted")
    texts = noted.join(_maybe_needed(docs, noted.select(F.col("rep").alias("id"))), F.col("rep") == F.col("row")).select(*key, "rep", "partners", "text")
    return texts.repartition(*key).sortWithinPartitions(*key).mapInArrow(verify, "u long, v long").distinct(), noted


def _linked(x: np.ndarray, y: np.ndarray, pct: int) -> bool:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared > 0 and 100 * shared >= pct * (len(x) + len(y) - shared)


def _maybe_needed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose key may be among ids, by a bit table that is broadcast: at most FILTER_BITS / 64 rows of
    16 bytes, 1 MB. All ids pass; others pass seldom while ids are few against the bits, so few texts are shuffled, and
    always when they are many, which costs the shuffle of all texts but no row."""
    word, bit = "CAST(pmod(xxhash64({0}), {1}) DIV 64 AS INT)", "shiftleft(CAST(1 AS BIGINT), CAST(pmod(xxhash64({0}), 64) AS INT))"
    bits = ids.select(F.expr(word.format("id", FILTER_BITS)).alias("_word"), F.expr(bit.format("id")).alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_mask"))
    of = docs.withColumn("_w", F.expr(word.format("row", FILTER_BITS))).join(F.broadcast(bits), F.col("_w") == F.col("_word"))
    return of.filter(F.expr(f"(_mask & {bit.format('row')}) != 0")).select("row", "text")


def _verified(pairs: DataFrame, docs: DataFrame, pct: int) -> DataFrame:
    """u, v of the pairs whose full shingle sets have 100 * intersection >= pct * union. Only texts of documents in a
    pair are moved."""
    texts = _maybe_needed(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, np.empty(0, np.uint64)
        for batch in batches:
            keep = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if (a, x) != last:
                    last, left = (a, x), shingles(x)
                keep.append(_linked(left, shingles(y), pct))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in (0, 1)], names=["u", "v"])

    with_b = pairs.select("a", "b").join(texts.select(F.col("row").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("row").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "u long, v long")


def _with_first(linked: DataFrame) -> DataFrame:
    """h, l, first: the smallest lead of each name. Names of many classes are joined by a broadcast, since a shuffle
    would bring all of their classes into one task."""
    firsts = stored(linked.groupBy("name").agg(F.min("lead").alias("first"), F.count(F.lit(1)).alias("n")), "firsts")
    large = firsts.filter(F.col("n") > BLOCK).select("name", "first")
    if large.count() > BROADCAST_BANDS:
        return linked.join(firsts, "name").select("h", "l", "first")
    small = firsts.filter(F.col("n") <= BLOCK).select("name", "first")
    rest = linked.join(F.broadcast(large.select("name")), "name", "left_anti").join(small, "name")
    return linked.join(F.broadcast(large), "name").select("h", "l", "first").unionByName(rest.select("h", "l", "first"))


def _with_pivots(bands: DataFrame, crowded: DataFrame) -> DataFrame:
    """bands with pivot and pivot_size, of the bands in crowded (band, pivot, pivot_size, n).

    A shuffle by band would bring a large band's classes into one task. Bands of more than `most` classes have their pivots
    broadcast: that is a BROADCAST_BANDS-th of all rows or BLOCK of them, so there are BROADCAST_BANDS of these bands at the
    most. The others are shuffled, and no task gets more than `most` rows of one of them."""
    most = max(BLOCK, -(-(crowded.agg(F.sum("n")).first()[0] or 0) // max(BROADCAST_BANDS, 1)))
    large, small = (crowded.filter(F.col("n") > most).drop("n"), crowded.filter(F.col("n") <= most).drop("n"))
    rest = bands.join(F.broadcast(large.select("band")), "band", "left_anti")
    return bands.join(F.broadcast(large), "band").unionByName(rest.join(small, "band"))


def _judged(docs: DataFrame, threshold_pct: int = 75, miss: float = 1e-9, seed: int = 0) -> DataFrame:
    """row, doc_id, n_shingles, component_id, kept for each row of docs (row, doc_id, text), whose keys are stored."""
    short_batches(docs.sparkSession)
    prints = stored(_fingerprints(docs, seed), "prints")
    named_by = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    classes = stored(prints.filter("sig IS NOT NULL").groupBy("high", "low", "sig").agg(F.min("row").alias("rep"), named_by.alias("lead"), F.max("n_shingles").alias("size"), F.max("bytes").alias("bytes")), "classes")
    bands = _banded(classes)
    pivot = F.min_by(F.struct("rep", "size"), "rank").alias("pivot")
    crowded = bands.groupBy("band").agg(pivot, F.count(F.lit(1)).alias("n")).filter("n > 1")
    crowded = stored(crowded.select("band", F.col("pivot.rep").alias("pivot"), F.col("pivot.size").alias("pivot_size"), "n"), "crowded")
    members = stored(_with_pivots(bands.drop("rank"), crowded), "bands")
    star = members.filter("rep != pivot").filter(_may_link("size", "pivot_size", threshold_pct)).select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    star = stored(_promising(star, classes, threshold_pct / 100, miss), "star")
    first = stored(_verified(star.select("a", "b"), docs, threshold_pct), "links")
    labels = stored(components(first), "labels")

    # Bands that still hold more than one component; with two classes there is no pair left.
    told = members.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").select("band", "rep", F.coalesce("component", "rep").alias("label"), "size", "bytes")
    mixed = told.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"), F.sum("bytes").alias("bytes")).filter("x != y AND n > 2")
    wide = F.least(F.greatest(F.lit(16.0) * F.sqrt("n"), F.lit(float(BLOCK))), F.lit(32.0 * BLOCK))
    blocks = F.ceil(F.greatest(F.col("n") / wide, F.col("shingles") / F.lit(float(BLOCK_SHINGLES)), F.col("bytes") / F.lit(float(BLOCK_BYTES)))).cast("long")
    mixed = stored(mixed.select("band", blocks.alias("blocks")), "mixed")
    # Joined by a shuffle, all rows of a crowded band would be in one task.
    told = told.drop("bytes").join(F.broadcast(mixed) if mixed.count() <= BROADCAST_BANDS else mixed, "band")
    second, noted = _between(told, classes, docs, threshold_pct, miss)
    final = components(first.unionByName(second))
    # All that came before is in `final`.
    dropped(crowded, members, star, first, labels, mixed, noted)

    of = classes.select(F.col("high").alias("h"), F.col("low").alias("l"), "rep", "lead").join(final, F.col("rep") == F.col("node"), "left")
    linked = of.filter("component IS NOT NULL").select("h", "l", "lead", F.col("component").alias("name"))
    named = of.filter("component IS NULL").select("h", "l", F.col("lead").alias("first")).unionByName(_with_first(linked))
    rows = prints.select("row", "doc_id", "n_shingles", "high", "low").join(named, (F.col("high") == F.col("h")) & (F.col("low") == F.col("l")) & (F.col("n_shingles") > 0), "left")
    alone = F.col("first").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return rows.select("row", "doc_id", "n_shingles", component.alias("component_id"), (alone | F.col("row").eqNullSafe(F.col("first.row"))).alias("kept"))


def near_duplicates(df: DataFrame, threshold_pct: int = 75, miss: float = 1e-9, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of df."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    docs = stored(docs, "docs")
    out = _judged(docs.select("row", "doc_id", "text"), threshold_pct, miss, seed).drop("row")
    dropped(docs)
    return out


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: float) -> DataFrame:
    """The rows of df that are kept, one of each component, all columns as they were."""
    names = [f"c{i}" for i in range(len(df.columns))]
    of = dict(zip(df.columns, names, strict=True))
    keyed = stored(df.toDF(*names).withColumn("row", F.monotonically_increasing_id()), "rows")
    docs = keyed.select("row", F.col(of[id_col]).cast("long").alias("doc_id"), F.col(of[text_col]).alias("text"))
    gone = _judged(docs, **options).filter("NOT kept").select("row")
    return keyed.join(gone, "row", "left_anti").select(*(F.col(n).alias(c) for n, c in zip(names, df.columns, strict=True)))
