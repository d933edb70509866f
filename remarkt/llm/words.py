"""Words of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import small_batches

CHUNK_BYTES = 1 << 20

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACES
#: ASCII letters and digits and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, bool)
for _lo, _hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    ALNUM[_lo:_hi] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
AS_IS = np.arange(256, dtype=np.uint8)

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; changes x."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... n - 1 modulo 2 ** 64; kept for chunks of the usual size."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        held = np.ones(max(n, CHUNK_BYTES + 1), np.uint64)
        held[1:] = np.uint64(base)
        np.multiply.accumulate(held, out=held)
        if n <= 2 * CHUNK_BYTES:
            _powers[base] = held
    return held[:n]


class Texts:
    """Consecutive texts as one byte array; null texts are empty."""

    def __init__(self, array: pa.Array):
        if array.null_count:
            array = array.fill_null("")
        wide = pa.types.is_large_string(array.type)
        buffers, n = array.buffers(), len(array)
        kind = np.dtype(np.int64 if wide else np.int32)
        offsets = np.frombuffer(buffers[1], kind, n + 1, array.offset * kind.itemsize).astype(np.int64) if n else np.zeros(1, np.int64)
        data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
        self.data = data[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        self.n = n

    def words(self, inside: np.ndarray, fold: np.ndarray = AS_IS) -> Words:
        return Words(self, inside, fold)

    def sums(self, per_byte: np.ndarray) -> np.ndarray:
        """Per text, the sum of a boolean or small integer array over the bytes."""
        total = np.zeros(len(per_byte) + 1, np.int64)
        np.cumsum(per_byte, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


class Words:
    """starts, ends: bytes of each word; first: for each text the index of its first word, and the number of words at the end."""

    def __init__(self, texts: Texts, inside: np.ndarray, fold: np.ndarray):
        self.texts, self.fold = texts, fold
        data, offsets = texts.data, texts.offsets
        word = inside[data]
        start, end = word.copy(), word.copy()
        if len(word):
            start[1:] &= ~word[:-1]
            end[:-1] &= ~word[1:]
            at = offsets[:-1][offsets[:-1] < offsets[1:]]
            start[at] = word[at]
            last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
            end[last] = word[last]
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.n = len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """For each word the index of its text."""
        return np.repeat(np.arange(self.texts.n), self.counts)

    def hashes(self) -> np.ndarray:
        """64 bits for each word, the same wherever its folded bytes are the same."""
        data = self.texts.data
        total = np.zeros(len(data) + 1, np.uint64)
        np.multiply(self.fold[data].astype(np.uint64) + np.uint64(1), _power(_BASE, len(data)), out=total[1:])
        np.cumsum(total, out=total)
        found = (total[self.ends] - total[self.starts]) * _power(_BASE_INVERSE, len(data) + 1)[self.starts]
        return mix(found ^ (self.ends - self.starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def windows(self, size: int) -> np.ndarray:
        """Indices of words at which a window of so many words of one text starts."""
        left = np.repeat(self.first[1:], self.counts) - np.arange(self.n)
        return np.flatnonzero(left >= size)


_STEP = [np.uint64(pow(0xC2B2AE3D27D4EB4F, i + 1, 1 << 64)) for i in range(64)]


def window_hashes(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """64 bits for each window of size words that starts at one of at."""
    total = np.zeros(len(at), np.uint64)
    for i in range(size):
        total += hashes[at + i] * _STEP[i % 64]
    return mix(total)


def same_bytes(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether so many bytes are equal, for each pair of places."""
    if not len(sizes):
        return np.zeros(0, bool)
    before = np.concatenate(([0], np.cumsum(sizes)))
    step = np.arange(before[-1])
    equal = a[step + np.repeat(a_at - before[:-1], sizes)] == b[step + np.repeat(b_at - before[:-1], sizes)]
    return np.logical_and.reduceat(equal, before[:-1])


def ranges(array: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes of text, or of one row."""
    sizes = np.zeros(len(array), np.int64) if not len(array) else np.diff(Texts(array).offsets)
    lo, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most or i - lo >= 1 << 16:
            yield lo, i
            lo, held = i, 0
        held += size
    if lo < len(array):
        yield lo, len(array)


def per_text(df: DataFrame, make: Callable[[pa.Array], dict[str, pa.Array]], schema: str | T.StructType, keep: tuple[str, ...] = ("doc_id",), text: str = "text", most: int = CHUNK_BYTES) -> DataFrame:
    """The kept columns and, for each row, what make gives for its text. One row comes out for each that goes in; columns of other names are not read.

    schema: of the whole result, the kept columns first.
    """
    names = [*keep, "_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(keep))
            for lo, hi in ranges(column, most):
                made = make(column.slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(len(keep))), *made.values()], names=[*keep, *made])
        pa.default_memory_pool().release_unused()

    small_batches(df.sparkSession)
    return df.select(*(F.col(c) for c in keep), F.col(text).alias(names[-1])).mapInArrow(run, schema)


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal values in a sorted array."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return at, np.diff(np.append(at, len(keys)))
