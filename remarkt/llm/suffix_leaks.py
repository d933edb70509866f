"""Benchmark decontamination by suffix arrays of the training text.

Every task sorts the suffixes of its shard of documents (word by word) and binary-searches each suffix of the
benchmark's items in that array, word after word. What stays in range for a whole window is a verbatim match and
the range holds all its locations; it is confirmed on the bytes. Suffixes of documents that share no first words
with any test suffix can't match and are left out of the array before it is sorted. Matches are then followed beyond
the window, in the sorted suffixes of the benchmark, to the longest one of each document and where it lies.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import sent, staged
from .words import ALNUM, LOWER, Texts, groups, per_text, ranges, same_bytes, window_hashes

WINDOW = 10
#: Words two suffixes must share at least for the one to enter the array.
SEED = 3
#: Bytes of benchmark text that are searched in one pass, about; a larger benchmark takes more passes, one after the other.
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 4 << 20

FOUND = (("n_words", T.LongType()), ("spans", T.ArrayType(T.LongType())), ("items", T.ArrayType(T.StringType())), ("longest_match", T.LongType()), ("longest_at", T.LongType()), ("longest_item", T.StringType()), ("longest_item_at", T.LongType()))


@dataclass
class Suffixes:
    """A block of items, one after the other: hashes of their words, a 0 after each item, and the items' folded bytes.

    place: of each distinct window the first place of it; lengths: its words; pair_window, pair_item: the items that
    have it; order: places in the order of the suffixes there.
    """

    hashes: np.ndarray
    place: np.ndarray
    lengths: np.ndarray
    pair_window: np.ndarray
    pair_item: np.ndarray
    names: list[str]
    first: np.ndarray
    raw: bytes
    starts: np.ndarray
    ends: np.ndarray
    seeds: dict[int, np.ndarray]
    order: np.ndarray


def suffix_order(hashes: np.ndarray) -> np.ndarray:
    """Places in the order of the suffixes that start there, by doubling: a rank for 1, 2, 4, ... words."""
    rank = np.unique(hashes, return_inverse=True)[1].astype(np.int64)
    n, size = len(rank), 1
    while n:
        second = np.full(n, -1)
        second[: n - size] = rank[size:] if size < n else rank[:0]
        order = np.lexsort((second, rank))
        new = np.concatenate(([0], np.cumsum((np.diff(rank[order]) != 0) | (np.diff(second[order]) != 0))))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1 or size >= n:
            return order.astype(np.int32)
        size *= 2
    return np.zeros(0, np.int32)


def test_suffixes(rows: list[tuple[str, str]], window: int) -> Suffixes:
    """rows: (item id as text, text). Equal windows are one, with all the items that have them."""
    rows = sorted(rows)
    hashes, starts, ends, raw, sizes, used = [], [], [], [], [], 0
    column = pa.array([t for _, t in rows], pa.string())
    for lo, hi in ranges(column):
        texts = Texts(column.slice(lo, hi - lo))
        words = texts.words(ALNUM, LOWER)
        own = words.hashes() if words.n else np.zeros(0, np.uint64)
        raw.append(LOWER[texts.data].tobytes())
        for i in range(hi - lo):
            part = slice(words.first[i], words.first[i + 1])
            hashes += [own[part], np.zeros(1, np.uint64)]
            starts += [words.starts[part] + used, np.zeros(1, np.int64)]
            ends += [words.ends[part] + used, np.zeros(1, np.int64)]
            sizes.append(part.stop - part.start)
        used += len(raw[-1])
    flat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
    words, sizes = flat(hashes, np.uint64), np.array(sizes, np.int64)
    first = np.concatenate(([0], np.cumsum(sizes + 1))).astype(np.int64)
    length = np.minimum(window, sizes)
    counts = np.where(length > 0, sizes - length + 1, 0)
    item = np.repeat(np.arange(len(sizes)), counts)
    at = first[item] + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    keys = [np.where(k < length[item], words[np.minimum(at + k, max(len(words) - 1, 0))], 0) for k in range(window)] if len(at) else []
    order = np.lexsort((at, *keys[::-1], length[item])) if len(at) else np.zeros(0, np.int64)
    at, item, size = at[order], item[order], length[item[order]] if len(at) else np.zeros(0, np.int64)
    new = np.concatenate(([True], reduce(np.logical_or, [np.diff(size) != 0, *(k[order][1:] != k[order][:-1] for k in keys)]))) if len(at) else np.zeros(0, bool)
    which = np.cumsum(new) - 1
    pairs = np.unique(np.stack((which, item), 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
    place, lengths = at[new], size[new]
    few = np.minimum(lengths, SEED)
    seeds = {int(n): np.unique(window_hashes(words, place[few == n], int(n))) for n in set(few.tolist())}
    return Suffixes(words, place.astype(np.int32), lengths.astype(np.int32), pairs[:, 0].astype(np.int32), pairs[:, 1].astype(np.int32), [n for n, _ in rows], first, b"".join(raw), flat(starts, np.int32), flat(ends, np.int32), seeds, suffix_order(words))


def is_in(values: np.ndarray, held: np.ndarray) -> np.ndarray:
    at = np.searchsorted(held, values)
    at[at == len(held)] = 0
    return held[at] == values


def suffix_array(hashes: np.ndarray, left: np.ndarray, tests: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a shard's suffixes in the order of their first words, and those words; left: words to the end of the text."""
    window = int(tests.lengths.max())
    may = np.zeros(len(hashes), bool)
    for size, held in tests.seeds.items():
        at = np.flatnonzero(left >= size)
        may[at[is_in(window_hashes(hashes, at, size), held)]] = True
    at = np.flatnonzero(may)
    keys = np.zeros((window, len(at)), np.uint64)
    for k in range(window):
        has = left[at] > k
        keys[k, has] = hashes[at[has] + k]
    order = np.lexsort((at, *keys[::-1]))
    return at[order], keys[:, order]


def narrowed(lo: np.ndarray, hi: np.ndarray, wanted: np.ndarray, value_at) -> tuple[np.ndarray, np.ndarray]:
    """The parts of sorted ranges whose values are those wanted, by binary search in all at once. value_at: value at each of some places."""
    bounds = []
    for right in (False, True):
        a, b = lo.copy(), hi.copy()
        while (open_ := a < b).any():
            mid = (a + b) // 2
            value = value_at(mid)
            below = (value <= wanted if right else value < wanted) & open_
            a = np.where(below, mid + 1, a)
            b = np.where(open_ & ~below, mid, b)
        bounds.append(a)
    return bounds[0], bounds[1]


def search(keys: np.ndarray, tests: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows found in a suffix array and the range of each: its bounds are narrowed word by word, by binary search."""
    some, last = np.arange(len(tests.lengths)), keys.shape[1] - 1
    lo, hi = np.zeros(len(some), np.int64), np.full(len(some), keys.shape[1], np.int64)
    found = []
    for k in range(keys.shape[0]):
        lo, hi = narrowed(lo, hi, tests.hashes[tests.place[some] + k], lambda mid, k=k: keys[k, np.minimum(mid, last)])
        live = lo < hi
        some, lo, hi = some[live], lo[live], hi[live]
        whole = tests.lengths[some] == k + 1
        found.append((some[whole], lo[whole], hi[whole]))
        some, lo, hi = some[~whole], lo[~whole], hi[~whole]
        if not len(some):
            break
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def matches(words, hashes: np.ndarray, tests: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """All (position, window) at which a window occurs in the shard, each confirmed on the words' bytes."""
    none = np.zeros(0, np.int64)
    if not words.n or not len(tests.lengths):
        return none, none
    left = np.repeat(words.first[1:], words.counts) - np.arange(words.n)
    at, keys = suffix_array(hashes, left, tests)
    if not len(at):
        return none, none
    which, lo, hi = search(keys, tests)
    sizes = hi - lo
    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place, window = at[np.repeat(lo, sizes) + inside], np.repeat(which, sizes)
    if not len(place):
        return none, none
    same = confirmed(words, place, window, tests)
    return place[same], window[same]


def confirmed(words, place: np.ndarray, window: np.ndarray, tests: Suffixes, most: int = 1 << 20) -> np.ndarray:
    """Whether the words from each place on are those of the window, byte for byte; about most bytes at a time, or one window's."""
    folded, raw = LOWER[words.texts.data], np.frombuffer(tests.raw, np.uint8)
    first, lengths = tests.place[window], tests.lengths[window]
    upto = np.concatenate(([0], np.cumsum(tests.ends[first + lengths - 1] - tests.starts[first])))
    same, lo = np.zeros(len(place), bool), 0
    while lo < len(place):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + most, side="right")) - 1)
        n = lengths[lo:hi]
        begin = np.cumsum(n) - n
        step = np.arange(n.sum()) - np.repeat(begin, n)
        own, test = np.repeat(place[lo:hi], n) + step, np.repeat(first[lo:hi], n) + step
        sizes = words.ends[own] - words.starts[own]
        equal = sizes == tests.ends[test] - tests.starts[test]
        equal[equal] = same_bytes(folded, words.starts[own[equal]], raw, tests.starts[test[equal]], sizes[equal])
        same[lo:hi] = np.logical_and.reduceat(equal, begin)
        lo = hi
    return same


def extents(hashes: np.ndarray, at: np.ndarray, most: np.ndarray, tests: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words from each of at on, most of them, how many stand in some item one after the other; and the range of suffixes that begin so."""
    lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(tests.order), np.int64)
    found, some = np.zeros(len(at), np.int64), np.flatnonzero(most > 0)
    last = len(tests.hashes) - 1
    while len(some):
        depth = found[some]
        a, b = narrowed(lo[some], hi[some], hashes[at[some] + depth], lambda mid, depth=depth: tests.hashes[np.minimum(tests.order[np.minimum(mid, len(tests.order) - 1)] + depth, last)])
        live = a < b
        some = some[live]
        lo[some], hi[some] = a[live], b[live]
        found[some] += 1
        some = some[found[some] < most[some]]
    return found, lo, hi


def longest_matches(words, hashes: np.ndarray, place: np.ndarray, window: np.ndarray, tests: Suffixes) -> np.ndarray:
    """Rows of text, words, first word in the shard and place among the items: the longest match of each text with any, of equally long ones the first.

    A match is a run of words that an item has too, of a whole window at least, or a whole item that is shorter. Runs
    are followed where windows occur, and of those places only from where a match begins that no earlier one holds.
    """
    owner, end = words.text_of(), np.repeat(words.first[1:], words.counts)
    full = int(tests.lengths.max())
    short = tests.lengths[window] < full
    p, w = place[short], window[short]
    best = [np.stack((owner[p], tests.lengths[w], p, tests.place[w], np.full(len(p), -1)))]
    hits = np.unique(place[~short])
    # places that follow each other: a match can't go on where no window occurs
    new = np.concatenate(([True], (np.diff(hits) != 1) | (owner[hits[1:]] != owner[hits[:-1]]))) if len(hits) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    stop = np.append(at[1:], len(hits))[: len(at)]
    while len(at):
        p = hits[at]
        size, lo, hi = extents(hashes, p, end[p] - p, tests)
        best.append(np.stack((owner[p], size, p, lo, hi)))
        # the next match ends later: the first place from which one more word than this match has still occurs
        a, b = np.where(p + size < end[p], at + 1, stop), stop
        while (open_ := a < b).any():
            mid = (a + b) // 2
            q = hits[np.minimum(mid, len(hits) - 1)]
            need = np.where(open_, p + size + 1 - q, 0)
            occurs = extents(hashes, q, need, tests)[0] >= need
            a, b = np.where(open_ & ~occurs, mid + 1, a), np.where(open_ & occurs, mid, b)
        at, stop = a[a < stop], stop[a < stop]
    text, size, p, lo, hi = np.concatenate(best, axis=1)
    order = np.lexsort((lo, p, -size, text))
    pick = order[np.unique(text[order], return_index=True)[1]]
    there = [int(tests.order[a:b].min()) if b >= 0 else int(a) for a, b in zip(lo[pick], hi[pick], strict=True)]
    return np.stack((text[pick], size[pick], p[pick], np.array(there, np.int64)))


def leaks_of(column: pa.Array, tests: Suffixes) -> dict[str, pa.Array]:
    texts = Texts(column)
    words = texts.words(ALNUM, LOWER)
    hashes = words.hashes() if words.n else np.zeros(0, np.uint64)
    place, which = matches(words, hashes, tests)
    edge = np.zeros(words.n + 1, np.int64)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + tests.lengths[which], -1)
    hit = np.concatenate((np.cumsum(edge)[:-1] > 0, [False]))
    owner = words.text_of()
    # hit spans end where the next text begins
    first_word = np.zeros(words.n + 1, bool)
    first_word[words.first[:-1]] = True
    previous = np.concatenate(([False], hit[:-1]))
    begins = np.flatnonzero(hit & (~previous | first_word))
    ends = np.flatnonzero(previous & (~hit | first_word))
    spans = np.stack((begins - words.first[owner[begins]], ends - words.first[owner[begins]]), 1).ravel() if len(begins) else np.zeros(0, np.int64)
    span_counts = np.bincount(owner[begins], minlength=texts.n) if len(begins) else np.zeros(texts.n, np.int64)
    items: list[np.ndarray] = [np.zeros(0, np.int64)] * texts.n
    longest, at, item_at = np.zeros((3, texts.n), np.int64)
    item: list[str | None] = [None] * texts.n
    if len(place):
        n_windows = len(tests.lengths)
        pairs = np.unique(owner[place] * n_windows + which)
        text, window = pairs // n_windows, pairs % n_windows
        a, b = np.searchsorted(tests.pair_window, window), np.searchsorted(tests.pair_window, window, "right")
        inside = np.arange((b - a).sum()) - np.repeat(np.cumsum(b - a) - (b - a), b - a)
        n_items = len(tests.names)
        found = np.unique(np.repeat(text, b - a) * n_items + tests.pair_item[np.repeat(a, b - a) + inside])
        for begin, size in zip(*groups(found // n_items), strict=True):
            items[found[begin] // n_items] = found[begin : begin + size] % n_items
        for i, size, p, there in longest_matches(words, hashes, place, which, tests).T:
            k = int(np.searchsorted(tests.first, there, "right")) - 1
            longest[i], at[i], item[i], item_at[i] = size, p - words.first[i], tests.names[k], there - tests.first[k]
    none = longest == 0
    return {
        "n_words": pa.array(words.counts),
        "spans": pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(2 * span_counts))).astype(np.int32)), pa.array(spans)),
        "items": pa.array([sorted({tests.names[k] for k in own}) for own in items], pa.list_(pa.string())),
        "longest_match": pa.array(longest),
        "longest_at": pa.array(at),
        "longest_item": pa.array(item, pa.string()),
        "longest_item_at": pa.array(item_at, mask=none),
    }


def searched(docs: DataFrame, held: Broadcast, keep: tuple[str, ...]) -> DataFrame:
    """The kept columns of docs (text) and what a block of items finds in each row."""
    schema = T.StructType([*docs.select(*keep).schema.fields, *(T.StructField(n, t) for n, t in FOUND)])
    return per_text(docs, lambda column: leaks_of(column, held.value), schema, keep, most=SHARD_BYTES)


def covered(spans: str) -> Column:
    """Words inside sorted spans (begin, end, begin, end, ...) that may overlap."""
    return F.expr(f"if(size({spans}) = 0, 0L, aggregate(sequence(0, size({spans}) - 2, 2), struct(0L as n, 0L as upto), (s, i) -> struct(s.n + greatest(0L, {spans}[i + 1] - greatest(s.upto, {spans}[i])) as n, greatest(s.upto, {spans}[i + 1]) as upto), s -> s.n))")


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each row of docs, as struct ``row``: its words, hit words and items of the benchmark (item_id, text).

    Adds n_words, n_hit, items (sorted as text), longest_match (words of its longest verbatim match, 0 without one),
    longest_at (the word at which that starts, 0 without one), longest_item and longest_item_at (an item that has it
    and the word there; null without one); of equally long matches that of the first word, then of the first item as
    text, is meant. Null and empty texts have no words and no hits. Items without an id, text or
    words are left out; items with one id count once. Repeated rows of docs are each answered; an empty benchmark
    hits nothing; docs' columns may have any names. The benchmark is searched in blocks of about block_bytes of
    text: driver and workers hold one block at a time, some seven times its text. With one block nothing is
    shuffled. With more, each block is a pass over the documents whose hits alone are written, and these are joined
    back to the rows.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("text")).where("item is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(total / block_bytes))
    out = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["text"].alias("text"))
    if blocks == 1:
        found = searched(out, sent(docs.sparkSession, test_suffixes([tuple(r) for r in items.collect()], window)), ("row",))
        return found.select("row", "n_words", covered("spans").alias("n_hit"), "items", "longest_match", "longest_at", "longest_item", "longest_item_at")
    out = staged(out.withColumn("place", F.monotonically_increasing_id()), "documents")
    parts = []
    for k in range(blocks):
        # several rows of an item stay in one block
        rows = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).collect()]
        held = docs.sparkSession.sparkContext.broadcast(test_suffixes(rows, window))
        found = searched(out, held, ("place",))
        parts.append(staged(found if k == 0 else found.where("longest_match > 0"), "leaks"))
        held.destroy()
    words = parts[0].select("place", "n_words")
    # of each row as many entries as there are blocks at most
    each = reduce(DataFrame.unionByName, parts).where("longest_match > 0").groupBy("place").agg(F.collect_list(F.struct((-F.col("longest_match")).alias("m"), "longest_at", "longest_item", "longest_item_at", "spans", "items")).alias("all"))
    pairs = "array_sort(flatten(transform(all, x -> transform(sequence(0, size(x.spans) - 2, 2), i -> struct(x.spans[i] as a, x.spans[i + 1] as b)))))"
    each = each.select("place", F.expr(f"flatten(transform({pairs}, x -> array(x.a, x.b)))").alias("spans"), F.expr("array_sort(array_distinct(flatten(all.items)))").alias("items"), F.array_min(F.expr("transform(all, x -> struct(x.m, x.longest_at, x.longest_item, x.longest_item_at))")).alias("top"))
    joined = out.join(words, "place").join(each.select("place", covered("spans").alias("n_hit"), "items", "top"), "place", "left")
    zero = F.lit(0).cast("bigint")
    return joined.select("row", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce(-F.col("top.m"), zero).alias("longest_match"), F.coalesce("top.longest_at", zero).alias("longest_at"), "top.longest_item", "top.longest_item_at")


def without_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs that share no window with the benchmark, all columns as they were; nulls, ties and repeats as in ``leaks``."""
    return leaks(docs, benchmark, window).where("n_hit = 0").select("row.*")


def leak_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of docs the counts of ``leaks``, where nulls, ties, repeats and empty tables are stated, a digest of the items, and the longest match with its two places."""
    return leaks(docs.select("doc_id", "text"), benchmark, window).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        "longest_match", "longest_at", "longest_item", "longest_item_at",
    )
