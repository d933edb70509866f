"""Cross-tokenizer alignment by elementary intervals.

Two tokenizers cut the same bytes. The union of both end arrays gives the elementary intervals, searchsorted finds for
each the token of either side that owns it, and each interval is the overlap of exactly one pair of tokens. Ends that
both sides share close groups. A text is cut where neither tokenizer can join what is parted, and the distinct pieces
of a chunk are encoded and aligned once. How many documents hold a pair linked is counted over the corpus; the pairs of
most documents go to all tasks, up to a fixed number, and the others come by a join.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import sent, small_batches, staged
from .words import Texts, groups, ranges

#: Text of a chunk, and pairs that are sent to every task at most (17 bytes each).
CHUNK_BYTES, HOT = 4 << 20, 1 << 18
#: Classes of counts for each doubling, by which the pairs of most documents are found.
CLASSES = 8

TOKENS = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_products bigint, groups_sha256 string, pairs array<bigint>, times array<int>"
COUNTED = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_products", "groups_sha256")


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Tokenizers:
    """Ids of pieces by both tokenizers, and the bytes of each id."""

    def __init__(self, a: str, b: str):
        # Spark runs a task on each core already
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer, pre_tokenizers

        self.a = Tokenizer.from_file(a)
        # their strings in a text are plain text
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        # characters of bytes: those that stand for themselves and, in order, for the others
        alphabet = sorted(pre_tokenizers.ByteLevel.alphabet())
        others = iter([c for c in alphabet if ord(c) > 255])
        byte = {chr(n) if chr(n) in alphabet else next(others): n for n in range(256)}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, n in self.a.get_vocab().items():
            self.bytes_a[n] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in spelt], np.int64) for spelt in (self.bytes_a, self.bytes_b))
        self.space = self.b.piece_to_id("▁")

    def encode(self, pieces: list[str]) -> tuple[Side, Side]:
        """Ids by both; of a piece that either does not give back byte for byte, none. The second puts the leading space of a piece there itself."""
        a = [e.ids for e in self.a.encode_batch_fast(pieces, add_special_tokens=False)]
        b = self.b.encode([p[1:] for p in pieces], num_threads=1)
        for i in [i for i, p in enumerate(pieces) if p == " "]:
            b[i] = [self.space]
        whole = [p.encode() for p in pieces]
        sides = [Side(ids, spelt, sizes) for ids, spelt, sizes in ((a, self.bytes_a, self.sizes_a), (b, self.bytes_b, self.sizes_b))]
        if all(side.spelling() == b"".join(whole) for side in sides) and all((side.totals() == np.fromiter(map(len, whole), np.int64, len(whole))).all() for side in sides):
            return sides[0], sides[1]
        for i, w in enumerate(whole):
            if any(b"".join([spelt[k] for k in ids[i]]) != w for ids, spelt in ((a, self.bytes_a), (b, self.bytes_b))):
                a[i], b[i] = [], []
        return Side(a, self.bytes_a, self.sizes_a), Side(b, self.bytes_b, self.sizes_b)


class Side:
    """What one tokenizer makes of pieces: flat ids, the end of each in bytes, and the number of ids of each piece."""

    def __init__(self, ids: list[list[int]], spelt: list[bytes], sizes: np.ndarray):
        self.count = np.fromiter(map(len, ids), np.int64, len(ids))
        self.flat = list(chain.from_iterable(ids))
        self.spelt = spelt
        self.ids = np.array(self.flat, np.int64)
        self.ends = np.cumsum(sizes[self.ids])

    def spelling(self) -> bytes:
        return b"".join(map(self.spelt.__getitem__, self.flat))

    def totals(self) -> np.ndarray:
        """Bytes of each piece."""
        return np.diff(np.concatenate(([0], self.ends))[upto(self.count)])


@lru_cache(maxsize=1)
def tokenizers(a: str, b: str) -> Tokenizers:
    return Tokenizers(a, b)


def elementary(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each elementary interval the token of either side that owns it, and whether both end with it. The last ends are equal."""
    # union1d of two sorted arrays: a stable sort merges their two runs
    ends = np.sort(np.concatenate((ends_a, ends_b)), kind="stable")
    ends = ends[groups(ends)[0]]
    a, b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    return a, b, (ends_a[a] == ends) & (ends_b[b] == ends)


def cut(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Pieces of all texts, each text with a space before it, and the index of each text's first piece (and the number of pieces).

    Cuts are before a space that follows a sign or letter of ASCII, or that stands between any other character and one.
    """
    column = column.fill_null("") if column.null_count else column
    texts = Texts(pc.if_else(pc.equal(pc.binary_length(column), 0), "", pc.binary_join_element_wise("", column, " ")))
    data, offsets = texts.data, texts.offsets
    graphic = (data > 0x20) & (data < 0x7F)
    start = np.zeros(len(data) + 1, bool)
    if len(data) > 2:
        start[1:-2] = (data[1:-1] == 0x20) & (graphic[:-2] | ((data[:-2] >= 0x80) & graphic[2:]))
        start[-2] = data[-1] == 0x20 and graphic[-2]
    elif len(data) == 2:
        start[1] = data[1] == 0x20 and graphic[0]
    start[offsets] = True
    start[-1] = False
    at = np.flatnonzero(start)
    bounds = np.append(at, len(data)).astype(np.int64)
    pieces = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    return pieces, np.searchsorted(at, offsets)


def lists(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def joined(offsets: np.ndarray, values: pa.Array, sign: str) -> pa.Array:
    return pc.binary_join(lists(offsets, values), sign)


def upto(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts)))


def aligned(column: pa.Array, both: Tokenizers) -> dict[str, pa.Array]:
    """Of each text the counts, the digest of its groups, its distinct linked pairs and how often it has each."""
    pieces, first = cut(column)
    coded = pieces.dictionary_encode()
    known, of = coded.dictionary.to_pylist(), np.asarray(coded.indices)
    side_a, side_b = both.encode(known)
    a, ends_a, n_a, b, ends_b, n_b = side_a.ids, side_a.ends, side_a.count, side_b.ids, side_b.ends, side_b.count
    # the distinct pieces one after the other: where one ends, both sides end
    at_a, at_b, closes = elementary(ends_a, ends_b)
    piece_a, piece_b = np.repeat(np.arange(len(known)), n_a), np.repeat(np.arange(len(known)), n_b)
    piece_of_link = piece_a[at_a]
    links = np.bincount(piece_of_link, minlength=len(known))
    last = np.flatnonzero(closes)
    group_a, group_b = np.searchsorted(last, np.searchsorted(at_a, np.arange(len(a)))), np.searchsorted(last, np.searchsorted(at_b, np.arange(len(b))))
    in_a, in_b = np.bincount(group_a, minlength=len(last)), np.bincount(group_b, minlength=len(last))
    piece_of_group = piece_of_link[last]
    n_groups = np.bincount(piece_of_group, minlength=len(known))
    products = np.bincount(piece_of_group, in_a * in_b, minlength=len(known)).astype(np.int64)
    sides = [joined(upto(n), pc.cast(pa.array(ids), pa.string()), ",") for n, ids in ((in_a, a), (in_b, b))]
    strings = joined(upto(n_groups), pc.binary_join_element_wise(*sides, "|"), ";")

    # texts: one with a piece that has no ids has none
    texts, doc_of = len(first) - 1, np.repeat(np.arange(len(first) - 1), np.diff(first))
    whole = np.bincount(doc_of, n_a[of] == 0, minlength=texts) == 0
    held = whole[doc_of]
    of, doc_of = of[held], doc_of[held]
    first = upto(np.bincount(doc_of, minlength=texts))
    totals = {name: pa.array(np.bincount(doc_of, x[of], minlength=texts).astype(np.int64)) for name, x in (("n_a", n_a), ("n_b", n_b), ("n_groups", n_groups), ("n_links", links), ("n_products", products))}
    written = joined(first, strings.take(pa.array(of)), ";").to_pylist()
    digests = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in written]

    # distinct pairs of each text: those of its pieces, numbered
    distinct, number = np.unique(a[at_a] << 32 | b[at_b], return_inverse=True)
    start = upto(links)
    many = links[of]
    index = np.arange(many.sum()) + np.repeat(start[of] - upto(many)[:-1], many)
    keys = np.sort(np.repeat(doc_of, many) * max(len(distinct), 1) + number[index])
    runs, times = groups(keys)
    doc, pair = np.divmod(keys[runs], max(len(distinct), 1))
    bounds = pa.array(np.searchsorted(doc, np.arange(texts + 1)), pa.int32())
    return totals | {
        "groups_sha256": pa.array(digests, pa.string()),
        "pairs": pa.ListArray.from_arrays(bounds, pa.array(distinct[pair] if len(pair) else np.zeros(0, np.int64))),
        "times": pa.ListArray.from_arrays(bounds, pa.array(times, pa.int32())),
    }


def align(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """For each row of docs (doc_id, text) its tokens, groups and links, written once.

    n_a, n_b: tokens; n_groups: runs between offsets where both end; n_links: pairs of tokens that overlap; n_products: all pairs inside groups; groups_sha256: digest of ``a1,a2|b1;a3|b2``;
    pairs: the distinct linked ids, a * 2 ** 32 + b, sorted; times: how often each is linked; row: a number of the row.
    Texts that are null, empty or not given back byte for byte by both tokenizers have no tokens: counts are zero, digest and lists empty. Repeated rows and ids are each answered; other columns
    aren't read; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    a, b = paths or default_tokenizers()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, row = tokenizers(a, b), TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo, hi in ranges(batch.column(1), CHUNK_BYTES):
                made = aligned(batch.column(1).slice(lo, hi - lo), both)
                rows = pa.array(np.arange(row, row + hi - lo))
                row += hi - lo
                yield pa.RecordBatch.from_arrays([rows, batch.column(0).slice(lo, hi - lo), *made.values()], names=["row", "doc_id", *made])
            pa.default_memory_pool().release_unused()

    return staged(docs.select(F.col("doc_id").cast("bigint"), F.col("text")).mapInArrow(run, TOKENS), "aligned")


def pair_counts(found: DataFrame) -> DataFrame:
    """Of what ``align`` found: pair, n (rows that hold it linked) and best (no other pair of its first id has more; ties are all best)."""
    counts = found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    # at most as many rows in a group as the second vocabulary has ids
    return counts.select("pair", "n", (F.col("n") == F.max("n").over(Window.partitionBy(F.shiftright("pair", 32)))).alias("best"))


def hot_from(counts: DataFrame, most: int) -> int | None:
    """The class of counts from which on there are at most so many pairs; None where even the highest has more."""
    least, total = None, 0
    for c, n in sorted(counts.groupBy(class_of("n").alias("c")).count().collect(), reverse=True):
        total += n
        if total > most:
            break
        least = c
    return least


def class_of(n: str):
    return F.floor(F.log2(n) * CLASSES).cast("int")


def alignment_report(docs: DataFrame, paths: tuple[str, str] | None = None, hot: int = HOT) -> DataFrame:
    """Per row of docs the counts and digest of ``align``, where nulls, empty texts, repeated rows and empty tables are stated, and over its links:

    n_best (those whose pair is in as many rows as any of its first id), count_sum (rows that hold the pair, summed). hot: pairs that are sent to every task at most; those in fewer rows are joined.
    """
    found = align(docs, paths)
    spark = found.sparkSession
    counts = staged(pair_counts(found), "pairs")
    least = hot_from(counts, hot)
    is_hot = F.lit(False) if least is None else class_of("n") >= least
    top = counts.where(is_hot).orderBy("pair").toArrow()
    held = sent(spark, tuple(np.asarray(top.column(c).combine_chunks().to_numpy(zero_copy_only=False)) for c in ("pair", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = held.value
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("pairs"))
            pairs, times = np.asarray(lists.flatten()), np.asarray(batch.column(batch.schema.get_field_index("times")).flatten()).astype(np.int64)
            bounds = np.asarray(lists.offsets).astype(np.int64) - lists.offsets[0].as_py()
            at = np.minimum(np.searchsorted(pair, pairs), max(len(pair) - 1, 0))
            known = pair[at] == pairs if len(pair) else np.zeros(len(pairs), bool)
            at = at[known]
            sums = []
            for x in (best[at] * times[known], n[at] * times[known]):
                total = np.zeros(len(pairs), np.int64)
                total[known] = x
                total = upto(total)
                sums.append(pa.array(total[bounds[1:]] - total[bounds[:-1]]))
            rest = pa.array(upto(~known)[bounds], pa.int32())
            cold = [pa.ListArray.from_arrays(rest, pa.array(x[~known], t)) for x, t in ((pairs, pa.int64()), (times, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(COUNTED) + 1], *sums, *cold], names=["row", *COUNTED, "n_best", "count_sum", "pairs", "times"])

    schema = TOKENS.replace("pairs array", "n_best bigint, count_sum bigint, pairs array")
    known = found.mapInArrow(run, schema)
    report = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_products")
    if counts.where(~is_hot).isEmpty():
        return known.select("doc_id", *report)
    known = staged(known, "known")
    cold = known.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", "x.pairs", "x.times")
    cold = cold.join(counts.where(~is_hot), F.col("pairs") == F.col("pair")).groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum"))
    whole = known.drop("pairs", "times").join(cold, "row", "left")
    return whole.withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}).select("doc_id", *report)
