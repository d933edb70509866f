"""Ranked lexical search by sort-based accumulation.

A pass over the documents writes the terms that items hold, with their counts. Each task then takes ranges of
documents: the matched (item, document, impact) arrays are concatenated, their packed keys radix sorted, and equal keys
summed by reduceat. Of each item the best documents of a range go into a heap, and the heaps of all tasks are merged by
two rank windows.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import sent, small_batches, staged
from .words import ALNUM, LOWER, Texts, groups, ranges, same_bytes

BEST = 20
#: Text of a block of items, which is held by the driver and each worker, and its items at most: a radix sort's digit.
BLOCK_BYTES, BLOCK_ITEMS = 8 << 20, 1 << 16
#: Matched triples of a range (some 60 bytes each); a document alone can have more, as many as its block has terms.
TRIPLES = 1 << 20
#: First tasks of the merge for each item.
PARTS = 64

POSTINGS = "row bigint, doc_id bigint, n bigint, terms array<int>, tf array<bigint>"
FOUND = "item int, doc_id bigint, score bigint, part int"


@dataclass
class Terms:
    """Terms of a block of items: sorted hashes with the bytes of each, and for each the items that hold it and how often.

    Two terms of one hash are neighbours; bytes decide between them.
    """

    hashes: np.ndarray
    spelt: list[bytes]
    data: np.ndarray
    starts: np.ndarray
    first: np.ndarray
    items: np.ndarray
    times: np.ndarray


def hashed(texts: list[str]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Hash and folded bytes of each word, and the text it is in."""
    found = Texts(pa.array(texts, pa.large_string())).words(ALNUM, LOWER)
    data = LOWER[found.texts.data].tobytes()
    return found.hashes(), [data[a:b] for a, b in zip(found.starts.tolist(), found.ends.tolist(), strict=True)], found.text_of()


def terms_of(items: list[str]) -> Terms:
    held: dict[tuple[int, bytes], Counter] = defaultdict(Counter)
    hashes, spelt, of = hashed(items)
    for h, w, i in zip(hashes.tolist(), spelt, of.tolist(), strict=True):
        held[h, w][i] += 1
    keys = sorted(held)
    postings = [sorted(held[k].items()) for k in keys]
    sizes = [len(w) for _, w in keys]
    return Terms(
        np.array([h for h, _ in keys], np.uint64), [w for _, w in keys], np.frombuffer(b"".join(w for _, w in keys), np.uint8), np.concatenate(([0], np.cumsum(sizes))).astype(np.int64),
        np.concatenate(([0], np.cumsum([len(p) for p in postings]))).astype(np.int64), np.array([i for p in postings for i, _ in p], np.int64), np.array([n for p in postings for _, n in p], np.int64),
    )


def postings(column: pa.Array, terms: Terms) -> dict[str, pa.Array]:
    """Of each text the number of its terms, those of the block, sorted, and how often it has each."""
    texts = Texts(column)
    found = texts.words(ALNUM, LOWER)
    hashes, doc = found.hashes(), found.text_of()
    at = np.searchsorted(terms.hashes, hashes)
    word, term = [], []
    # terms of one hash are tried one after the other; nearly always there is one
    live = np.flatnonzero(at < len(terms.hashes))
    live = live[terms.hashes[at[live]] == hashes[live]]
    folded = LOWER[texts.data]
    while len(live):
        sizes = found.ends[live] - found.starts[live]
        right = terms.starts[at[live] + 1] - terms.starts[at[live]] == sizes
        some = live[right]
        right[right] = same_bytes(folded, found.starts[some], terms.data, terms.starts[at[some]], sizes[right])
        word.append(live[right])
        term.append(at[live[right]])
        live = live[~right]
        at[live] += 1
        live = live[at[live] < len(terms.hashes)]
        live = live[terms.hashes[at[live]] == hashes[live]]
    word, term = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (word, term))
    width = max(len(terms.hashes), 1)
    keys = np.sort(doc[word] * width + term)
    runs, tf = groups(keys)
    doc, term = np.divmod(keys[runs], width)
    bounds = pa.array(np.searchsorted(doc, np.arange(texts.n + 1)), pa.int32())
    return {"n": pa.array(found.counts.astype(np.int64)), "terms": pa.ListArray.from_arrays(bounds, pa.array(term, pa.int32())), "tf": pa.ListArray.from_arrays(bounds, pa.array(tf.astype(np.int64)))}


def radix_order(keys: np.ndarray, most: int) -> np.ndarray:
    """A stable order of keys under most, by digits of 16 bits from the lowest."""
    order = None
    for shift in range(0, max(int(most - 1).bit_length(), 1), 16):
        digit = ((keys if order is None else keys[order]) >> shift & 0xFFFF).astype(np.uint16)
        # numpy's stable sort of 16 bits is a radix sort
        by = np.argsort(digit, kind="stable")
        order = by if order is None else order[by]
    return order


def accumulate(items: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_items: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of impacts of equal (item, document), sorted; the documents come in order, so that their digits of the packed key are sorted already."""
    order = radix_order(items, n_items)
    packed = items[order] << 32 | docs[order]
    runs, _ = groups(packed)
    if not len(runs):
        return items, docs, impacts
    return packed[runs] >> 32, packed[runs] & 0xFFFFFFFF, np.add.reduceat(impacts[order], runs)


class Heaps:
    """Of each item the best documents seen: highest score, then smallest id, one without id last."""

    def __init__(self, best: int):
        self.best, self.held = best, defaultdict(list)

    def push(self, item: int, score: int, doc_id: int | None) -> None:
        entry, heap = (score, doc_id is not None, -(doc_id or 0)), self.held[item]
        if len(heap) < self.best:
            heapq.heappush(heap, entry)
        elif entry > heap[0]:
            heapq.heapreplace(heap, entry)

    def add(self, items: np.ndarray, docs: np.ndarray, scores: np.ndarray, ids: list[int | None]) -> None:
        """Sums sorted by item and document, documents in the order of their ids."""
        for a, size in zip(*groups(items), strict=True):
            item, of, doc = int(items[a]), scores[a : a + size], docs[a : a + size]
            least = 1
            if size > self.best:
                least = max(1, int(np.partition(of, size - self.best)[size - self.best]))
            if len(self.held[item]) == self.best:
                least = max(least, self.held[item][0][0])
            # of those equal to the least, the first ones can be enough
            above, ties = np.flatnonzero(of > least), np.flatnonzero(of == least)[: self.best]
            for k in (*above.tolist(), *ties.tolist()):
                self.push(item, int(of[k]), ids[doc[k]])

    def rows(self, part: int) -> pa.RecordBatch:
        flat = [(i, -d if known else None, s) for i, heap in self.held.items() for s, known, d in heap]
        columns = list(zip(*flat, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array([part] * len(flat), pa.int32())], names=["item", "doc_id", "score", "part"])


def in_ranges(batch: pa.RecordBatch, weights: np.ndarray, sizes: np.ndarray, total: int, all_terms: int, most: int) -> Iterator[tuple]:
    """Ranges of documents in the order of their ids: ids, and of each match its place there, its term and its impact."""
    ids, n = batch.column(1), np.asarray(batch.column(2)).astype(np.int64)
    order = np.asarray(pa.compute.sort_indices(ids, null_placement="at_end")).astype(np.int64)
    lists = batch.column(3).take(pa.array(order))
    terms, tf = np.asarray(lists.flatten()).astype(np.int64), np.asarray(batch.column(4).take(pa.array(order)).flatten()).astype(np.int64)
    bounds = np.asarray(lists.offsets).astype(np.int64) - lists.offsets[0].as_py()
    ids, n = ids.take(pa.array(order)).to_pylist(), n[order]
    # 25 * n * N may pass 64 bits only with a document of 1e15 / N terms and more
    m = 100 - 25 + 25 * n * total // max(all_terms, 1)
    doc = np.repeat(np.arange(len(ids)), np.diff(bounds))
    impact = weights[terms] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
    triples = np.concatenate(([0], np.cumsum(sizes[terms])))[bounds]
    lo = 0
    while lo < len(ids):
        hi = max(lo + 1, int(np.searchsorted(triples, triples[lo] + most, side="right")) - 1)
        a, b = bounds[lo], bounds[hi]
        yield ids[lo:hi], doc[a:b] - lo, terms[a:b], impact[a:b]
        lo = hi


def scored(found: DataFrame, terms: Terms, df: dict[int, int], total: int, all_terms: int, best: int, triples: int) -> DataFrame:
    """The best documents of each item in each task, in ranges of so many triples."""
    weights = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * df.get(t, 0) + 1))) if df.get(t) else 0 for t in range(len(terms.hashes))], np.int64)
    held = sent(found.sparkSession, (weights, terms.first, terms.items, terms.times))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, first, items, times = held.value
        n_items, sizes, heaps = int(items.max()) + 1 if len(items) else 1, np.diff(first), Heaps(best)
        for batch in batches:
            for ids, doc, term, impact in in_ranges(batch, weights, sizes, total, all_terms, triples):
                many = sizes[term]
                before = np.cumsum(many) - many
                index = np.arange(many.sum()) + np.repeat(first[term] - before, many)
                sums = accumulate(items[index], np.repeat(doc, many), np.repeat(impact, many) * times[index], n_items)
                heaps.add(*sums, ids)
        yield heaps.rows(TaskContext.get().partitionId() % PARTS)

    return found.mapInArrow(run, FOUND)


def blocks_of(items: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """Items with the number of their block; those of one id are in one."""
    total, rows = items.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16), F.lit(0)), F.count("*")).first()
    n = max(1, math.ceil(total / block_bytes), math.ceil(2 * rows / BLOCK_ITEMS) if rows > BLOCK_ITEMS else 1)
    return items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(n))), n


def search(docs: DataFrame, items: DataFrame, best: int = BEST, block_bytes: int = BLOCK_BYTES, triples: int = TRIPLES) -> DataFrame:
    """For each item (item_id, text) its highest-scoring documents (doc_id, text): item_id, rank from 1, doc_id, score.

    Scores are those of the query's contract, in whole numbers. Equal scores come by ascending id, documents without an id last. Null and empty texts have no terms, match nothing and count in
    no statistic. Repeated rows of docs, and rows that share an id, are documents each; rows of items that share an id (or have none) are one item of all their terms, repeats included. Items
    without a match give no rows, nor do empty tables; columns of other names aren't read. Items are searched in blocks of about block_bytes of text, which driver and workers hold one at a time;
    each block is a pass over the documents, whose matched terms alone are written.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"))
    items, blocks = blocks_of(items.select("item_id", "text"), block_bytes)
    parts = []
    for k in range(blocks):
        each: dict = defaultdict(list)
        for item_id, text in items.where(F.col("block") == k).select("item_id", "text").collect():
            each[item_id].append(text or "")
        # a space parts terms
        terms = terms_of([" ".join(texts) for texts in each.values()])
        held = sent(spark, terms)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            row = TaskContext.get().partitionId() << 40
            for batch in batches:
                for lo, hi in ranges(batch.column(1)):
                    made = postings(batch.column(1).slice(lo, hi - lo), held.value)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + hi - lo)), batch.column(0).slice(lo, hi - lo), *made.values()], names=["row", "doc_id", *made])
                    row += hi - lo
                pa.default_memory_pool().release_unused()

        found = staged(docs.mapInArrow(run, POSTINGS), "postings")
        total, all_terms = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        # as many rows as the block has terms
        df = {r.term: r.n for r in found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}
        names = spark.createDataFrame(list(enumerate(each)), items.select(F.lit(0).alias("item"), "item_id").schema)
        parts.append((scored(found, terms, df, total, all_terms, best, triples), names))

    def ranked(top: DataFrame, *by: str) -> DataFrame:
        return top.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).where(F.col("rank") <= best)

    # each task gives best rows of an item at most, a part has some of the tasks
    tops = [ranked(ranked(top, "item", "part"), "item").join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score") for top, names in parts]
    whole = tops[0]
    for more in tops[1:]:
        whole = whole.unionByName(more)
    return whole
