"""A hidden Markov language model over word classes, trained by Baum-Welch.

Words get a class: the most frequent ones their own, the others by a hash of their last bytes. States emit classes
and a class emits its words in proportion to their counts, so every text has an exact probability. Texts are encoded
once, against a dictionary for each block of them; counts of all words are summed over the corpus and joined back to
the dictionaries. Each round of training sums expected counts over partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chosen_path import by_group
from .scratch import sent, staged
from .words import LOWER, NOT_SPACE, Texts, mix, ranges

STATES, FREQUENT, ENDINGS = 8, 3000, 512
#: Rounds on a bounded sample of texts, whole, from a random start; rounds over the whole corpus.
FIRST_ROUNDS, ROUNDS, SAMPLE = 30, 3, 1500
#: Tokens that go step by step, and such segments side by side: cuts in the arithmetic, not in the model.
SEGMENT, PART = 128, 2048
SMOOTH = 0.2
BLOCK_TOKENS, MOST_TASKS = 2_000_000, 50_000
END = np.uint64(0x5EED0FE2D)
SLICES = 16

ENCODED = "block bigint, kind int, lid int, hash bigint, n bigint, ending int, doc_id bigint, held_out boolean, learn boolean, tokens binary"


def pack_ids(ids: np.ndarray, planes: int) -> bytes:
    """Low bytes of all numbers, then the next ones: the high ones are mostly 0 and compress."""
    return np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T[:planes]).tobytes()


def unpack_ids(data: bytes, planes: int) -> np.ndarray:
    part = np.frombuffer(data, np.uint8).reshape(planes, -1).astype(np.uint32)
    return sum(part[k] << np.uint32(8 * k) for k in range(planes))


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and endings of all tokens, the end of each text among them, and where each text's begin."""
    texts = Texts(column)
    words = texts.words(NOT_SPACE, LOWER)
    counts = words.counts
    first = np.concatenate(([0], np.cumsum(counts + 1)))
    hashes, endings = np.full(first[-1], END), np.zeros(first[-1], np.int32)
    if words.n:
        at = np.arange(words.n) + words.text_of()
        hashes[at] = words.hashes()
        low = LOWER[texts.data].astype(np.uint64)
        tail = low[words.ends - 1] * np.uint64(256) + np.where(words.ends - words.starts > 1, low[np.maximum(words.ends - 2, 0)], 0).astype(np.uint64)
        third = np.where(words.ends - words.starts > 2, low[np.maximum(words.ends - 3, 0)], 0).astype(np.uint64)
        endings[at] = 1 + (mix(tail * np.uint64(256) + third) % np.uint64(ENDINGS - 1)).astype(np.int32)
    return hashes, endings, first


def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of texts as numbers in the block's own dictionary (kind 1), and the dictionary (kind 0), frequent words first. In: doc_id, held_out, learn, text."""
    names = [f.split()[0] for f in ENCODED.split(", ")]
    task, made = TaskContext.get().partitionId(), 0
    held: list = []

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal made
        hashes = np.concatenate([h[1] for h in held])
        endings = np.concatenate([h[2] for h in held])
        sizes = np.concatenate([np.diff(h[3]) for h in held])
        own = pa.Table.from_batches([h[0] for h in held]).combine_chunks()
        words, where, inverse, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        learn = own.column("learn").to_numpy()
        ids, n = rank[inverse], len(words)
        learnt = np.bincount(ids[np.repeat(learn, sizes)], minlength=n)
        block = (task << 24) + made
        made += 1
        nulls = lambda kind, k: pa.nulls(k, kind)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, block)), pa.array(np.zeros(n, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(words[order].view(np.int64)), pa.array(learnt), pa.array(endings[where[order]]), nulls(pa.int64(), n), nulls(pa.bool_(), n), nulls(pa.bool_(), n), nulls(pa.binary(), n)], names=names
        )
        first, k = np.concatenate(([0], np.cumsum(sizes))), len(sizes)
        column = pa.array([pack_ids(ids[first[i] : first[i + 1]], 3) for i in range(k)], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(k, block)), pa.array(np.ones(k, np.int32)), nulls(pa.int32(), k), nulls(pa.int64(), k), pa.array(sizes), nulls(pa.int32(), k), own.column("doc_id").combine_chunks(), own.column("held_out").combine_chunks(), own.column("learn").combine_chunks(), column], names=names
        )
        held.clear()

    for batch in batches:
        for lo, hi in ranges(batch.column(3)):
            part = batch.slice(lo, hi - lo)
            held.append((part.select([0, 1, 2]), *tokens_of(part.column(3))))
            if sum(len(h[1]) for h in held) >= BLOCK_TOKENS:
                yield from flush()
    if held:
        yield from flush()


# --- the model


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @staticmethod
    def random(states: int, classes: np.ndarray, seed: int = 7) -> Model:
        """Near the classes' shares, so that rounds have something to part."""
        rng = np.random.default_rng(seed)
        emit = (classes + SMOOTH) * rng.uniform(0.3, 1.7, (states, len(classes)))
        move = rng.uniform(0.5, 1, (states, states)) + np.eye(states) * states
        return Model(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    @staticmethod
    def of_counts(vector: np.ndarray, states: int, smooth: float = SMOOTH) -> Model:
        start, move, emit = vector[:states] + smooth, vector[states : states + states**2].reshape(states, states) + smooth, vector[states + states**2 : -1].reshape(states, -1) + smooth
        return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    def transfers(self, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each whole segment does to a vector of states before it: a matrix, scaled, and the logarithm of its scale."""
        emit, states = np.ascontiguousarray(self.emit.T), len(self.start)
        total = emit[segments[:, 0]][:, :, None] * self.move
        logs = np.zeros(len(segments))
        for t in range(1, segments.shape[1]):
            total = ((total * emit[segments[:, t]][:, None, :]).reshape(-1, states) @ self.move).reshape(-1, states, states)
            if t % 8 == 7 or t == segments.shape[1] - 1:
                scale = total.max((1, 2))
                total /= scale[:, None, None]
                logs += np.log(scale)
        return total, logs

    def entries(self, cut: Cut) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """State shares before each segment's first token; of whole segments that others follow, their matrices, logarithms of scale and of the probability of their tokens."""
        whole = np.flatnonzero(~cut.last)
        parts = [self.transfers(cut.segments[whole[lo : lo + PART]]) for lo in range(0, len(whole), PART)]
        states = len(self.start)
        matrices = np.zeros((len(cut.last), states, states))
        logs = np.zeros((2, len(cut.last)))
        if parts:
            matrices[whole], logs[0, whole] = np.concatenate([m for m, _ in parts]), np.concatenate([g for _, g in parts])
        entry = np.repeat(self.start[None], len(cut.last), 0)
        for at in cut.steps():
            at = at[~cut.last[at]]
            after = (entry[at, None, :] @ matrices[at])[:, 0]
            scale = after.sum(1)
            entry[at + 1] = after / scale[:, None]
            logs[1, at] = logs[0, at] + np.log(scale)
        return entry, matrices, logs[0], logs[1]

    def expected(self, texts: list[np.ndarray]) -> np.ndarray:
        """Expected counts of starts, moves and emissions of whole texts, and their log-likelihood.

        Texts are cut so that their segments go side by side; states' shares before and after each segment are exact, by the segments' matrices.
        """
        states, classes = self.emit.shape
        cut = Cut(texts)
        emit = np.ascontiguousarray(self.emit.T)
        entry, matrices, _, _ = self.entries(cut)
        # what follows: for each segment the probability of its tokens and all after them, by the state of its first
        tokens = np.ones((len(cut.last), states))
        last = np.flatnonzero(cut.last & (cut.nth > 0))
        for t in range(int(cut.lengths[last].max(initial=0)) - 1, -1, -1):
            at = last[cut.lengths[last] > t]
            ahead = np.where((cut.lengths[at] > t + 1)[:, None], tokens[at] @ self.move.T, tokens[at])
            ahead *= emit[cut.segments[at, t]]
            tokens[at] = ahead / ahead.max(1, keepdims=True)
        for at in reversed(list(cut.steps())):
            at = at[~cut.last[at]]
            ahead = (matrices[at] @ tokens[at + 1][:, :, None])[:, :, 0]
            tokens[at] = ahead / ahead.max(1, keepdims=True)
        after = np.ones((len(cut.last), states))
        follows = np.flatnonzero(~cut.last)
        after[follows] = tokens[follows + 1] @ self.move.T
        move, starts, emitted, log = np.zeros((states, states)), np.zeros(states), np.zeros((states, classes)), 0.0
        order = np.argsort(-cut.lengths, kind="stable")
        for lo in range(0, len(order), PART):
            at = order[lo : lo + PART]
            segments, lengths = cut.segments[at], cut.lengths[at]
            n, most = len(at), int(lengths[0])
            alphas, gammas, scales = np.zeros((most, n, states)), np.zeros((most, n, states)), np.ones((most, n))
            live = [int(np.searchsorted(-lengths, -t, "left")) for t in range(most)]  # those longer than t
            alpha, ends = entry[at], np.zeros((n, states))
            for t in range(most):
                k = live[t]
                alpha = (alpha[:k] if t == 0 else alpha[:k] @ self.move) * emit[segments[:k, t]]
                scales[t, :k] = alpha.sum(1)
                alpha = alpha / scales[t, :k, None]
                alphas[t, :k] = alpha
                ends[:k] = alpha
            log += float(np.log(scales).sum())
            beta = after[at]
            beta = beta / (ends * beta).sum(1, keepdims=True)
            for t in range(most - 1, -1, -1):
                if t < most - 1:
                    j = live[t + 1]
                    ahead = beta[:j] * emit[segments[:j, t + 1]] / scales[t + 1, :j, None]
                    move += self.move * (alphas[t, :j].T @ ahead)
                    beta[:j] = ahead @ self.move.T
                gammas[t, : live[t]] = alphas[t, : live[t]] * beta[: live[t]]
            places = np.concatenate([segments[: live[t], t] for t in range(most)]).astype(np.int64)
            flat = np.concatenate([gammas[t, : live[t]] for t in range(most)])
            for s in range(states):
                emitted[s] += np.bincount(places, flat[:, s], classes)
            starts += gammas[0][cut.nth[at] == 0].sum(0)
            # moves from a segment's last token to the next one's first
            inner = np.flatnonzero(~cut.last[at])
            if len(inner):
                weight = (ends[inner] * after[at[inner]]).sum(1, keepdims=True)
                move += self.move * ((ends[inner] / weight).T @ tokens[at[inner] + 1])
        return np.concatenate((starts, move.ravel(), emitted.ravel(), [log]))

    def likelihood(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural log-likelihood of each text by the scaled forward recursion, segments side by side."""
        cut = Cut(texts)
        if not len(cut.last):
            return np.zeros(len(texts))
        entry, _, _, logs = self.entries(cut)
        emit, last = np.ascontiguousarray(self.emit.T), np.flatnonzero(cut.last)
        last = last[np.argsort(-cut.lengths[last], kind="stable")]
        lengths, alpha = cut.lengths[last], entry[last]
        for t in range(int(lengths[0])):
            k = int(np.searchsorted(-lengths, -t, "left"))
            alpha = (alpha[:k] @ self.move if t else alpha[:k]) * emit[cut.segments[last[:k], t]]
            scale = alpha.sum(1)
            alpha /= scale[:, None]
            logs[last[:k]] += np.log(scale)
        return np.bincount(cut.text, logs, len(texts))


class Cut:
    """Texts cut into segments of SEGMENT tokens, the last of each text shorter: for each segment its text, its place there (nth) and whether it is the last."""

    def __init__(self, texts: list[np.ndarray]):
        sizes = np.array([len(t) for t in texts], np.int64)
        counts = -(-sizes // SEGMENT)
        self.text = np.repeat(np.arange(len(texts)), counts)
        first = np.cumsum(counts) - counts
        self.nth = np.arange(counts.sum()) - np.repeat(first, counts)
        self.last = self.nth == counts[self.text] - 1
        self.lengths = np.minimum(SEGMENT, sizes[self.text] - SEGMENT * self.nth)
        self.segments = np.zeros((len(self.text), SEGMENT), np.uint16)
        if len(self.text):
            self.segments[np.arange(SEGMENT)[None] < self.lengths[:, None]] = np.concatenate(texts)

    def steps(self) -> Iterator[np.ndarray]:
        """Segments that are first in their texts, then those that are second, and so on."""
        order = np.argsort(self.nth, kind="stable")
        yield from np.split(order, np.flatnonzero(np.diff(self.nth[order])) + 1)


def together(texts: Iterator[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Some texts at a time, of PART segments or one text."""
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += -(-len(t) // SEGMENT)
        if n >= PART:
            yield held
            held, n = [], 0
    if held:
        yield held


def sum_counts(classed: DataFrame, model: Model) -> np.ndarray:
    """Expected counts over all texts learnt from: each task's sums in slices, which are added up apart."""
    held = sent(classed.sparkSession, model)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for texts in together(unpack_ids(b.as_py(), 2) for b in batch.column(0)):
                own = held.value.expected(texts)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([p.tobytes() for p in np.array_split(total, SLICES)], pa.binary())], names=["slice", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(v)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["slice", "sums"])

    kind = "slice int, sums binary"
    rows = classed.where("learn").select("classes").mapInArrow(expect, kind).repartition(SLICES, "slice").mapInArrow(add, kind).collect()
    return np.concatenate([np.frombuffer(r.sums) for r in sorted(rows, key=lambda r: r.slice)]) if rows else np.zeros(0)


def train(classed: DataFrame, shares: np.ndarray, states: int, rounds: int) -> Model:
    """shares: count of each class. The start comes from a bounded sample of unlike texts, by a hash of them; the rounds cover all."""
    model = Model.random(states, shares)
    learn = classed.where("learn")
    n = learn.count()
    if not n:
        return model
    picked = learn.select("classes", F.xxhash64("classes", F.lit("start")).alias("h")).where(F.pmod("h", F.lit(1 << 30)) < float(1 << 30) * min(1.0, SAMPLE / n))
    # copies are one, so about SAMPLE texts at most come
    few = picked.groupBy("h").agg(F.min("classes").alias("c")).collect()
    parts = list(together(unpack_ids(r.c, 2) for r in sorted(few, key=lambda r: r.h)))
    for _ in range(FIRST_ROUNDS if parts else 0):
        model = Model.of_counts(sum(map(model.expected, parts)), states)
    for _ in range(rounds):
        model = Model.of_counts(sum_counts(classed, model), states)
    return model


# --- the operator


def by_number(rows: DataFrame, coded: DataFrame) -> tuple[DataFrame, int]:
    """rows with nth, the number of their block among all, counted without gaps; and as many tasks as there are blocks, up to MOST_TASKS, so that none holds more than its share."""
    counts = coded.where("kind = 0 and lid = 0").groupBy(F.shiftright("block", 24).alias("task")).count().collect()
    # a row for each task that read documents
    upto, first = 0, []
    for task, n in sorted(counts):
        first.append((task, upto))
        upto += n
    known = rows.sparkSession.createDataFrame(first, "task bigint, first bigint")
    placed = rows.join(F.broadcast(known), F.shiftright("block", 24) == F.col("task")).withColumn("nth", (F.col("first") + F.col("block").bitwiseAND(F.lit((1 << 24) - 1))).cast("int"))
    return placed.drop("task", "first"), max(1, min(upto, MOST_TASKS))


def language_scores(docs: DataFrame, states: int = STATES, frequent: int = FREQUENT, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities) for each row of docs (doc_id, text, held_out, learn).

    Words are lower-cased and each text ends with one more token; null and empty texts are that token alone. Learns
    from rows marked learn; held_out is passed on. Repeated rows are scored alike; a table without rows to learn from
    gives uniform states; an empty table gives an empty result; other columns are not read. All words of all texts are
    counted and scored; what a task holds is bounded by a block of BLOCK_TOKENS, or its longest text.
    """
    spark = docs.sparkSession
    coded = staged(docs.select("doc_id", "held_out", "learn", "text").mapInArrow(encode, ENCODED), "encoded")
    entries = coded.where("kind = 0")
    counts = staged(entries.groupBy("hash").agg(F.sum("n").alias("c"), F.min("ending").alias("ending")), "counts")
    train_tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum((F.col("c") > 0).cast("long")), F.lit(0))).first()
    top = [r[0] for r in counts.where("c > 0").orderBy(F.desc("c"), "hash").select("hash", "c").limit(frequent).collect()]
    own = spark.createDataFrame([(h, ENDINGS + i) for i, h in enumerate(top)] or [(0, -1)], "hash bigint, own int")
    # frequent rows at most
    marked = counts.join(F.broadcast(own.where("own >= 0")), "hash", "left").withColumn("cls", F.coalesce("own", "ending"))
    n_classes = ENDINGS + len(top)
    shares, kinds = np.zeros(n_classes), np.zeros(n_classes)
    for r in marked.groupBy("cls").agg(F.sum("c").alias("c"), F.sum((F.col("c") > 0).cast("long")).alias("v")).collect():
        shares[r.cls], kinds[r.cls] = r.c, r.v
    held = sent(spark, (train_tokens, distinct, shares, kinds))

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, v, shares, kinds = held.value
        for batch in by_group(batches):
            keys = batch.column("block").to_numpy()
            for block in np.unique(keys):
                lo, hi = np.searchsorted(keys, [block, block + 1])
                part = batch.slice(lo, hi - lo)
                n = int(np.searchsorted(part.column("kind").to_numpy(), 1))
                c, cls = part.column("c").slice(0, n).to_numpy(), part.column("cls").slice(0, n).to_numpy()
                base = np.log10((c + 0.5) / (total + 0.5 * (v + 1)))
                # a frequent word is all of its class
                inner = np.where(cls >= ENDINGS, 0.0, np.log10((c + 0.5) / (shares[cls] + 0.5 * (kinds[cls] + 1))))
                rows = part.slice(n)
                out: list[list] = [[], [], [], [], []]
                for b in rows.column("tokens"):
                    ids = unpack_ids(b.as_py(), 3)
                    for column, value in zip(out, (len(ids), int((c[ids] > 0).sum()), float(base[ids].sum()), float(inner[ids].sum()), pack_ids(cls[ids], 2)), strict=True):
                        column.append(value)
                made = [pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), rows.column("learn"), *made], names=["doc_id", "held_out", "learn", "n_tokens", "n_known", "base_score", "inner", "classes"])

    words = entries.select("block", "kind", "lid", "hash").join(marked.select("hash", "c", "cls"), "hash").select("block", "kind", "lid", "c", "cls", *(F.lit(None).cast(k).alias(n) for n, k in (("doc_id", "long"), ("held_out", "boolean"), ("learn", "boolean"), ("tokens", "binary"))))
    texts = coded.where("kind = 1").select("block", "kind", "lid", F.lit(None).cast("long").alias("c"), F.lit(None).cast("int").alias("cls"), "doc_id", "held_out", "learn", "tokens")
    schema = "doc_id bigint, held_out boolean, learn boolean, n_tokens bigint, n_known bigint, base_score double, inner double, classes binary"
    placed, tasks = by_number(words.unionByName(texts), coded)
    classed = staged(placed.repartitionById(tasks, "nth").drop("nth").sortWithinPartitions("block", "kind", "lid").mapInArrow(classify, schema), "classes")
    model = sent(spark, train(classed, shares, states, rounds))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs = np.concatenate([model.value.likelihood(t) for t in together(unpack_ids(b.as_py(), 2) for b in batch.column(5))]) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(batch.column(6).to_numpy() + logs / np.log(10))], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    found = classed.select("doc_id", "held_out", "n_tokens", "n_known", "base_score", "classes", "inner").mapInArrow(score, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


def language_model_report(docs: DataFrame) -> DataFrame:
    """Holds out a fifth of the ids; rows without an id are neither held out nor learnt from. Null and empty texts, repeated rows and empty tables are as in ``language_scores``."""
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    return language_scores(docs.select("doc_id", "text", F.coalesce(rest == 1, F.lit(False)).alias("held_out"), F.coalesce(rest != 1, F.lit(False)).alias("learn")))
