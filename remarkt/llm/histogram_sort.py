"""Sharding by histogram sort.

Rows are ordered by a key of 63 bits: a hash of the text, then of the whole row, then of its place in the input, so
that equal texts are neighbours and yet even one row that fills a third of the table can be cut. Each round counts the exact bytes and rows between
candidate boundaries over all partitions, and refines only intervals that hold a wanted boundary and are larger than
the tolerance. Once all splitters are known, rows are exchanged once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import sent, staged

#: Bits of the key; of those, the bits below the text's, for rows; of these, bits for the place of rows that are all alike; bits of the key resolved in a round.
KEY_BITS, ROW_BITS, PLACE_BITS, ROUND_BITS = 63, 32, 16, 9
FIRST_BITS = 12
#: Share of a shard's bytes by which a splitter may miss its target.
TOLERANCE = 0.005
#: Bytes of a sorted range, the unit of the exchange; more for very large inputs, so that no more than MOST_RANGES splitters are kept.
RANGE_BYTES, MOST_RANGES = 128 << 20, 1 << 16
LEAST_RANGES = 4


def sort_key(docs: DataFrame, text: str) -> Column:
    """Not negative. Columns that can't be hashed, those with maps at any depth, are hashed as JSON."""
    plain = lambda f: not any(x in f.dataType.simpleString() for x in ("map<", "variant"))
    row = F.xxhash64(*(docs[f.name] if plain(f) else F.to_json(F.struct(docs[f.name])) for f in docs.schema.fields))
    head = F.shiftleft(F.shiftrightunsigned(F.xxhash64(docs[text]), 64 - KEY_BITS + ROW_BITS), ROW_BITS)
    middle = F.shiftleft(F.shiftrightunsigned(row, 64 - ROW_BITS + PLACE_BITS), PLACE_BITS)
    return head.bitwiseOR(middle).bitwiseOR(F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - PLACE_BITS))


def size_of(text: Column, overhead: int) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + overhead


@dataclass
class Interval:
    lo: int
    bits: int
    size: int
    rows: int


def count_between(keys: DataFrame, intervals: list[Interval] | None, bits: int) -> list[Interval]:
    """Exact bytes and rows of each part of the intervals (None: of all keys), 2 ** bits parts of each."""
    if intervals is None:
        shift = KEY_BITS - bits
        found = keys.groupBy(F.shiftright("key", shift).alias("part")).agg(F.sum("size"), F.count(F.lit(1))).collect()
        return sorted((Interval(r[0] << shift, shift, r[1], r[2]) for r in found), key=lambda x: x.lo)
    out: list[Interval] = []
    for width in sorted({x.bits for x in intervals}):
        own = [x.lo >> width for x in intervals if x.bits == width]
        shift = max(0, width - bits)
        part = keys.where(F.shiftright("key", width).isin(own)).groupBy(F.shiftright("key", shift).alias("part")).agg(F.sum("size"), F.count(F.lit(1)))
        out += [Interval(r[0] << shift, shift, r[1], r[2]) for r in part.collect()]
    return sorted(out, key=lambda x: x.lo)


@dataclass
class Splitters:
    """Of each range: its first key, shard, and the rows of its shard before it."""

    first: np.ndarray
    shard: np.ndarray
    before: np.ndarray


def find_splitters(keys: DataFrame, shards: int, tolerance: float = TOLERANCE, range_bytes: int = RANGE_BYTES) -> Splitters:
    """keys: (key, size). The driver holds 2 ** FIRST_BITS intervals and at most 2 ** ROUND_BITS for each that is refined."""
    leaves = count_between(keys, None, FIRST_BITS)
    total = sum(x.size for x in leaves)
    aim = total / shards
    unit = max(min(range_bytes, total / (shards * LEAST_RANGES)), total / MOST_RANGES, 1)
    while True:
        upto, split = 0, []
        for x in leaves:
            inside = int(upto // aim) != int((upto + x.size) // aim) if aim else False
            if x.bits and x.rows > 1 and (inside and x.size > tolerance * aim or x.size > 2 * unit):
                split.append(x)
            upto += x.size
        if not split:
            break
        gone = {(x.lo, x.bits) for x in split}
        leaves = sorted([x for x in leaves if (x.lo, x.bits) not in gone] + count_between(keys, split, ROUND_BITS), key=lambda x: x.lo)
    first, shard, before = [], [], []
    upto = in_range = rows = 0
    for x in leaves:
        # a leaf goes where its middle lies, so each boundary is the nearer end of the leaf at its target
        at = min(shards - 1, int((upto + x.size / 2) / aim)) if aim else 0
        new = not shard or at != shard[-1]
        if new or in_range + x.size > unit:
            rows = 0 if new else rows
            first.append(x.lo)
            shard.append(at)
            before.append(rows)
            in_range = 0
        in_range += x.size
        rows += x.rows
        upto += x.size
    return Splitters(np.array(first or [0], np.int64), np.array(shard or [0], np.int32), np.array(before or [0], np.int64))


def shard_by_bytes(docs: DataFrame, shards: int, text: str = "text", tolerance: float = TOLERANCE, range_bytes: int = RANGE_BYTES, overhead: int = 8) -> DataFrame:
    """docs and, added, size, shard (0 to shards - 1, near equal in bytes) and slot (gapless from 0 in each shard).

    A row's size is its text's UTF-8 bytes (null: none) plus overhead. Equal texts stand together unless a boundary
    must fall among them; so do rows equal in all columns. Boundaries miss their targets by tolerance of a shard or
    half a row. Columns of docs named size, shard or slot are replaced. An empty table gives an empty result. Rows
    are written once with their keys, so that counts and exchange see the same ones, and the rounds of counting read
    16 bytes a row. The driver sees counts only, of bounded number; each range is a task of its own.
    """
    docs = docs.drop("size", "shard", "slot")
    # names of the rows' columns may clash, with each other's case too, so they are carried by number
    named = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    own = named.columns[docs.columns.index(text)]
    keyed = staged(named.select("*", size_of(named[own], overhead).alias("size"), F.monotonically_increasing_id().alias("place"), sort_key(named, own).alias("key")), "keyed")
    splitters = find_splitters(keyed.select("key", "size"), shards, tolerance, range_bytes)
    held = sent(docs.sparkSession, splitters)

    @F.pandas_udf("range int, shard int, before bigint")
    def place(key: pd.Series) -> pd.DataFrame:
        s = held.value
        at = np.maximum(np.searchsorted(s.first, key.to_numpy(), "right") - 1, 0)
        return pd.DataFrame({"range": at.astype(np.int32), "shard": s.shard[at], "before": s.before[at]})

    placed = keyed.withColumn("at", place("key")).select("*", F.col("at.range").alias("range")).repartitionById(len(splitters.first), "range")
    rank = F.row_number().over(Window.partitionBy("range").orderBy("key", "place"))
    return placed.select(*(F.col(c).alias(name) for c, name in zip(named.columns, docs.columns, strict=True)), "size", F.col("at.shard").alias("shard"), (F.col("at.before") + rank - 1).alias("slot"))


def shard_report(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Per row of docs (doc_id, text) its place by ``shard_by_bytes``, where nulls, repeated rows and empty tables are stated; other columns are not read."""
    found = shard_by_bytes(docs.select("doc_id", "text"), shards)
    return found.select("doc_id", "size", F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("bigint").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
