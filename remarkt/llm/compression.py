"""Quality rules by compression bands.

zstandard sizes of whole documents and of fixed chunks reject repetitive or incompressible text, with limits
for each band of length. Counts of words, symbols and repeats come from the same pass over the bytes.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .words import NOT_SPACE, Texts, groups, mix, per_text, window_hashes

#: (bytes from, lowest ratio, highest ratio) of compressed to plain size; short texts compress less.
BANDS = ((0, 0.0, 9.0), (64, 0.40, 1.4), (256, 0.42, 0.92), (1024, 0.38, 0.72), (4096, 0.34, 0.68), (16384, 0.30, 0.66))
CHUNK = 2048
#: A chunk is out of bounds outside these; a document fails when over this share of its chunks is.
CHUNK_LIMITS, CHUNK_SHARE = (0.25, 0.74), 0.3
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_bytes bigint, zstd_ratio double, n_chunks bigint, n_bad_chunks bigint, in_band boolean, base_failed boolean, kept boolean"


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split(b"\n")
    if len(lines) == len(set(lines)):
        return 0
    seen: set[bytes] = set()
    again = 0
    for line in lines:
        if line in seen:
            again += bool(line.strip(b" \t\n\v\f\r"))
        else:
            seen.add(line)
    return again


def repeated_words(words, size: int = 5) -> np.ndarray:
    """Per text, the words inside windows of size words that the text has twice or more."""
    at = words.windows(size)
    if not len(at):
        return np.zeros(words.texts.n, np.int64)
    owner = words.text_of()
    keys = window_hashes(words.hashes(), at, size) ^ mix(owner[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys, kind="stable")
    begins, sizes = groups(keys[order])
    again = at[order[np.repeat(sizes > 1, sizes)]]
    edge = np.zeros(words.n + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + size, -1)
    hit = np.cumsum(edge)[:-1] > 0
    total = np.concatenate(([0], np.cumsum(hit)))
    return total[words.first[1:]] - total[words.first[:-1]]


def compression_rules(docs: DataFrame, bands: Sequence[tuple[int, float, float]] = BANDS, chunk: int = CHUNK, chunk_limits: tuple[float, float] = CHUNK_LIMITS, chunk_share: float = CHUNK_SHARE, level: int = 3) -> DataFrame:
    """One row for each row of docs (doc_id, text): counts, zstandard ratios and the verdict.

    Chunks cover every byte of a text: those of full length one after the other, then its last bytes; a text shorter
    than a chunk is one, within its band's limits. Null and empty texts have no words and fail; equal texts and repeated rows get the same verdict each; an empty
    table gives an empty result; other columns are not read. One pass, no shuffle; the memory of a task is bounded by
    one chunk of rows or its longest text.
    """
    limits = sorted(bands)
    edges = np.array([b[0] for b in limits])

    def make(column: pa.Array) -> dict[str, pa.Array]:
        texts = Texts(column)
        data, offsets = texts.data, texts.offsets
        words = texts.words(NOT_SPACE)
        n_words = words.counts
        heads = (data & 0xC0) != 0x80
        squeeze = zstandard.ZstdCompressor(level=level)
        raw = data.tobytes()
        sizes = np.diff(offsets)
        packed, chunks, bad, dups = np.zeros((4, texts.n), np.int64)
        for i in range(texts.n):
            one = raw[offsets[i] : offsets[i + 1]]
            if not one:
                continue
            packed[i] = len(squeeze.compress(one))
            dups[i] = duplicate_lines(one)
            if len(one) < chunk:
                continue
            # the last chunk is the text's last bytes, also where it begins inside the one before
            for k in (*range(0, len(one) - chunk, chunk), len(one) - chunk):
                share = len(squeeze.compress(one[k : k + chunk])) / chunk
                chunks[i] += 1
                bad[i] += not chunk_limits[0] <= share <= chunk_limits[1]
        ratio = packed / np.maximum(sizes, 1)
        band = np.searchsorted(edges, sizes, "right") - 1
        low, high = np.array([b[1] for b in limits])[band], np.array([b[2] for b in limits])[band]
        # a text shorter than a chunk is one, within the limits for its length
        short = (sizes > 0) & (sizes < chunk)
        chunks[short], bad[short] = 1, ((ratio < low) | (ratio > high))[short]
        in_band = (ratio >= low) & (ratio <= high) & (bad <= chunk_share * np.maximum(chunks, 1))
        repeats = repeated_words(words)
        failed = (n_words < 10) | (100 * repeats > 20 * n_words)
        made = {
            "n_words": n_words, "word_chars": texts.sums(heads & NOT_SPACE[data]), "n_symbols": texts.sums(SYMBOLS[data]), "n_dup_lines": dups, "n_repeat_words": repeats, "n_bytes": sizes,
            "zstd_ratio": ratio, "n_chunks": chunks, "n_bad_chunks": bad, "in_band": in_band, "base_failed": failed, "kept": in_band & ~failed,
        }
        return {k: pa.array(v) for k, v in made.items()}

    return per_text(docs, make, SCHEMA)
