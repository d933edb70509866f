"""Quality scores by votes of the nearest labelled documents in a latent-semantic space.

Texts become weighted counts of hashed words, of word shapes and of repetition; a truncated singular value
decomposition of labelled ones gives the space. Labelled vectors are broadcast (their number is a parameter), every
document's cosines with all of them are computed in blocks, and the nearest vote with their similarity.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import sent
from .words import LOWER, NOT_SPACE, Texts, groups, mix, per_text

#: Labelled documents to fit on at most (about), dimensions of the space, neighbours that vote, power of a similarity as weight.
SAMPLE, RANK, NEIGHBOURS, POWER = 4096, 48, 25, 4
WORDS, SHAPES, PAIRS, REPEATS = 1024, 256, 512, 192
WIDTH = WORDS + SHAPES + PAIRS + REPEATS
#: Share of each block of features in a text's vector.
WEIGHTS = (0.6, 1.0, 0.8, 1.2)
THRESHOLD = 0.3

#: Kinds of bytes, each a bit of a word's shape.
KIND = np.zeros(256, np.uint64)
for _bit, _bytes in enumerate((range(0x41, 0x5B), range(0x61, 0x7B), range(0x30, 0x3A), range(0x80, 0x100), b"!?", b"|", b"#*$%&<>{}[]=~^\\/", b".,;:'\"()-_+@`")):
    KIND[list(_bytes)] = 1 << _bit


def step(x: np.ndarray, most: int) -> np.ndarray:
    """Logarithmic steps of a count, 0 to most - 1."""
    return np.minimum(np.log2(x + 1).astype(np.int64), most - 1)


def features(column: pa.Array) -> np.ndarray:
    """Counts of each text: hashed words, shapes, pairs of shapes, then steps of its length and repetition."""
    texts = Texts(column)
    words = texts.words(NOT_SPACE, LOWER)
    found = np.zeros((texts.n, WIDTH), np.float32)
    owner, n = words.text_of(), words.counts

    def count(at: np.ndarray, bins: np.ndarray, lo: int, size: int) -> None:
        found[:, lo : lo + size] += np.bincount(at * size + bins, minlength=texts.n * size).reshape(texts.n, size)

    distinct = again = np.zeros(texts.n)
    if words.n:
        hashes = words.hashes()
        shape = np.bitwise_or.reduceat(KIND[texts.data], words.starts).astype(np.int64)
        inner = owner[1:] == owner[:-1]
        count(owner, (hashes % np.uint64(WORDS)).astype(np.int64), 0, WORDS)
        count(owner, shape, WORDS, SHAPES)
        both = mix((shape[:-1] * 256 + shape[1:]).astype(np.uint64)) % np.uint64(PAIRS)
        count(owner[1:][inner], both.astype(np.int64)[inner], WORDS + SHAPES, PAIRS)
        keys = hashes ^ mix(owner.astype(np.uint64) + np.uint64(1))
        order = np.argsort(keys, kind="stable")
        begins, _ = groups(keys[order])
        distinct = np.bincount(owner[order[begins]], minlength=texts.n)
        again = np.bincount(owner[1:][inner & (hashes[1:] == hashes[:-1])], minlength=texts.n)
    length = step(n, 16)
    for i, share in enumerate((distinct / np.maximum(n, 1), again / np.maximum(n, 1))):
        part = np.minimum((share * 6).astype(np.int64), 5)
        found[np.arange(texts.n), WORDS + SHAPES + PAIRS + i * 96 + length * 6 + part] = 1
    return found


@dataclass
class Space:
    idf: np.ndarray
    base: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    @staticmethod
    def fit(counts: np.ndarray, labels: np.ndarray, rank: int) -> Space:
        idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 0.1
        x = Space.weigh(counts, idf)
        _, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
        base = np.ascontiguousarray(vectors[:, ::-1][:, :rank].astype(np.float32))
        return Space(idf, base, Space.unit(x @ base), labels.astype(np.float32))

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)

    @staticmethod
    def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
        x, lo = np.log1p(counts) * idf, 0
        for size, weight in zip((WORDS, SHAPES, PAIRS, REPEATS), WEIGHTS, strict=True):
            x[:, lo : lo + size] = weight * Space.unit(x[:, lo : lo + size])
            lo += size
        return x

    def vote(self, counts: np.ndarray, neighbours: int, power: float, block: int = 256) -> np.ndarray:
        """Exact: each block of texts against all labelled vectors."""
        points, k = self.unit(self.weigh(counts, self.idf) @ self.base), min(neighbours, len(self.labels))
        found = np.zeros(len(points))
        for lo in range(0, len(points), block):
            cosine = points[lo : lo + block] @ self.vectors.T
            # of equal cosines at the edge the first labelled documents in their order vote
            edge = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, -k, None]
            over, tied = cosine > edge, cosine == edge
            chosen = over | tied & (np.cumsum(tied, axis=1) <= k - over.sum(1, keepdims=True))
            near = np.nonzero(chosen)[1].reshape(-1, k)
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 1e-6) ** power
            found[lo : lo + block] = (weight * self.labels[near]).sum(1) / weight.sum(1)
        return np.clip(found, 0, 1)


def labelled(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Counts and labels of about size labelled documents, chosen by a hash of the id. labels: (doc_id, quality).

    Of an id's several texts one is learnt from, that of the smallest hash, so that an id which repeats doesn't grow the sample.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = known.count()
    picked = known.where(F.pmod(F.xxhash64("doc_id", F.lit("votes")), F.lit(1 << 30)) < float(1 << 30) * min(1.0, size / max(n, 1)))
    # about size rows, so that this side may be broadcast
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    found = per_text(rows, lambda column: {"counts": pa.array([zlib.compress(r.tobytes(), 1) for r in features(column)], pa.binary())}, "doc_id bigint, quality int, counts binary", ("doc_id", "quality")).collect()
    found = sorted(found, key=lambda r: r.doc_id)
    return np.array([np.frombuffer(zlib.decompress(r.counts), np.float32) for r in found], np.float32).reshape(-1, WIDTH), np.array([r.quality for r in found])


def quality_votes(docs: DataFrame, learn: DataFrame, labels: DataFrame, size: int = SAMPLE, rank: int = RANK, neighbours: int = NEIGHBOURS, power: float = POWER, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier) and predicted for each row of docs (doc_id, text).

    Learns from rows of learn (doc_id, text) that labels (doc_id, quality) names, a bounded sample of them; an id
    with several labels counts with the largest, one with several texts with one of them. Of labelled documents with
    equal cosines those of smaller ids vote. Null texts score as empty ones; without labels all score 0.5;
    repeated rows get equal scores; an empty table gives an empty result; other columns are not read. Whole texts of
    all rows are scored in one pass without a shuffle.
    """
    counts, quality = labelled(learn, labels, size)
    held = sent(docs.sparkSession, Space.fit(counts, quality, rank) if len(counts) else None)

    def make(column: pa.Array) -> dict[str, pa.Array]:
        space = held.value
        score = space.vote(features(column), neighbours, power) if space else np.full(len(column), 0.5)
        return {"score": pa.array(score.astype(np.float64)), "predicted": pa.array((score >= threshold).astype(np.int32))}

    return per_text(docs, make, "doc_id bigint, score double, predicted int")


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns outside the held-out fifth; rows without an id are neither held out nor learnt from."""
    docs, rest = docs.select("doc_id", "text"), F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    found = quality_votes(docs, docs.where(rest != 0), labels.select("doc_id", "quality").where(rest != 0))
    return found.select("doc_id", F.coalesce(rest == 0, F.lit(False)).alias("held_out"), "score", "predicted")
