"""Packing by non-negative least squares.

Documents are cut into whole windows and one rest each. Combinations of few rest lengths that fill a window are
enumerated, non-negative least squares finds how often to use each so that together they use up the histogram of
lengths, and the counts are rounded down. What the plan leaves over is packed greedily, the longest pieces first and
each into the fullest sequence that it fits. All of this is arithmetic on the counts of pieces of each length: a piece
then finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import os
import re
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate, chain, islice, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import sent, staged
from .words import ranges

WINDOW, END = 4096, 2
#: Tokens of a length class; pieces of a combination at most.
STEP, DEPTH = 32, 4
#: Words whose ids a task keeps (some 200 bytes each), and their characters; beyond either, and after the task, only those of its last texts.
MEMO, MEMO_CHARS = 300_000, 16 << 20

PIECES = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary, block bigint, nth bigint"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# --- tokens


class WordIds:
    """Ids of a text, word by word: the tokenizer drops white space and never joins what it parts, so words can be kept.

    markers: literal markers in a text, such as <|endoftext|>, become their own ids, as the tokenizer's default is; else they are plain text.
    Words are kept without their case (where that is plain) and without trailing signs, which are tokens apart.
    """

    #: White space as the tokenizer's normaliser has it (Unicode's); Arrow's takes four control characters more.
    SPACE = re.compile("[" + "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]+")
    CONTROLS = "\x1c\x1d\x1e\x1f"
    #: Trailing signs of their own pre-token; none of them is an apostrophe, which can start one with letters.
    SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
    #: Letters before this one (Latin, Greek, Cyrillic) are letters in every version of Unicode in use.
    OTHER = "\u0530"
    #: The one of them whose small form is a letter and a mark.
    TWO = "\u0130"

    def __init__(self, path: str, markers: bool = True):
        # Spark runs a task on each core already
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # words never hold a marker that counts: those are parted from the text before
        self.tokenizer.encode_special_tokens = True
        # characters of bytes, those that stand for themselves and, in order, for the others
        alphabet = sorted(pre_tokenizers.ByteLevel.alphabet())
        others = iter([c for c in alphabet if ord(c) > 255])
        self.characters = "".join(chr(b) if chr(b) in alphabet else next(others) for b in range(256))
        probe = ["don", "sll", "aé", "жω"]
        # whether a word of letters is one piece for the model, in these characters
        self.direct = [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(" ".join(probe))] == self.as_bytes(probe)
        vocabulary = self.tokenizer.get_vocab()
        self.markers = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.special] if markers else []
        self.parted = re.compile("(" + "|".join(map(re.escape, self.markers)) + ")")
        # keyed by what can't be a word
        self.special = {"": []} | {" " + t: [vocabulary[t]] for t in self.markers}
        self.recent: list[str] = []
        self.held: dict[str, int] = {}
        self.forget()

    def forget(self) -> None:
        """Keep only words of the last texts: what texts share is among them."""
        kept = {w: self.ids[self.upto[i] : self.upto[i + 1]] for w in self.recent if (i := self.held.get(w)) is not None} | self.special
        self.held, self.ids, self.upto, self.size = {}, array("I"), array("q", [0]), 0
        self.hold(list(kept), list(kept.values()))

    def hold(self, words: list[str], ids: list) -> None:
        """Keep the ids of words that are not held."""
        self.held.update(zip(words, range(len(self.held), len(self.held) + len(words)), strict=True))
        self.ids.extend(chain.from_iterable(ids))
        self.upto.extend(islice(accumulate(map(len, ids), initial=self.upto[-1]), 1, None))
        self.size += sum(map(len, words))

    def split(self, texts: list[str]) -> pa.ListArray:
        """The words of each text, with empty ones among them."""
        odd = [i for i, t in enumerate(texts) if any(c in t for c in self.CONTROLS) or any(m in t for m in self.markers)]
        found = pc.utf8_split_whitespace(pa.array(texts, pa.string()))
        if odd:
            found = found.to_pylist()
            for i in odd:
                pieces = self.parted.split(texts[i]) if self.markers else [texts[i]]
                found[i] = [w for k, p in enumerate(pieces) for w in ([" " + p] if k % 2 else self.SPACE.split(p))]
            return pa.array(found, pa.list_(pa.string()))
        return found

    def parts(self, words: pa.StringArray) -> tuple[pa.StringArray, pa.StringArray]:
        """Words without their case (where that is plain) and their trailing signs, and those."""
        base = pc.utf8_rtrim(words, self.SIGNS)
        # signs after a letter that stays one are a piece of their own; markers stay whole
        last = pc.utf8_slice_codeunits(base, -1)
        apart = pc.and_(pc.and_(pc.utf8_is_alpha(last), pc.less(last, self.OTHER)), pc.and_(pc.not_equal(last, self.TWO), pc.invert(pc.starts_with(words, " "))))
        base = pc.if_else(apart, base, words)
        signs = pc.binary_slice(words.cast(pa.binary()), 0, 0).cast(pa.string())
        own = np.flatnonzero(np.asarray(pc.binary_length(base)) < np.asarray(pc.binary_length(words)))
        if len(own):
            some = words.take(pa.array(own))
            lasting = [w[len(w.rstrip(self.SIGNS)) :] for w in some.to_numpy(zero_copy_only=False).tolist()]
            mask = np.zeros(len(words), bool)
            mask[own] = True
            signs = pc.replace_with_mask(signs, pa.array(mask), pa.array(lasting, pa.string()))
        return pc.if_else(pc.string_is_ascii(base), pc.ascii_lower(base), base), signs

    def as_bytes(self, words: list[str]) -> list[str]:
        """Words in the characters that stand for their bytes."""
        return " ".join(words).encode().decode("latin-1").translate(self.characters).split(self.characters[32])

    def learn(self, words: list[str]) -> None:
        # small letters as they are, others by the tokenizer's normaliser: the model needs no more where they stay letters
        plain = [w for w in words if w.isascii() and w.isalpha() and w.islower()] if self.direct else []
        others = [w for w in words if not w.isascii() and w.isalpha()] if self.direct else []
        normal = self.tokenizer.normalizer.normalize_str(" ".join(others)).split(" ") if others else []
        if len(normal) == len(others):
            kept = [(w, n) for w, n in zip(others, normal, strict=True) if n.isalpha() and max(n) < self.OTHER]
            pieces = [*plain, *(self.as_bytes([n for _, n in kept]) if kept else [])]
            plain = [*plain, *(w for w, _ in kept)]
        else:
            pieces = plain
        tokens = self.tokenizer.model.tokenize
        self.hold(plain, [[t.id for t in tokens(p)] for p in pieces])
        rest = [w for w in words if w not in self.held]
        for lo in range(0, len(rest), 10_000):
            part = rest[lo : lo + 10_000]
            self.hold(part, [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)])

    def places(self, words: list[str]) -> np.ndarray:
        """Where the ids of unlike words are; those not known are learnt."""
        at = np.fromiter(map(self.held.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        if len(self.held) + len(new) > MEMO or self.size > MEMO_CHARS:
            self.forget()
            at = np.fromiter(map(self.held.get, words, repeat(-1)), np.int64, len(words))
            new = np.flatnonzero(at < 0)
        if len(new):
            unknown = [words[i] for i in new.tolist()]
            self.learn(unknown)
            at[new] = np.fromiter(map(self.held.__getitem__, unknown), np.int64, len(unknown))
        self.recent = words
        return at

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, 4 bytes each."""
        words = self.split(texts)
        coded = words.flatten().dictionary_encode()
        base, signs = (x.dictionary_encode() for x in self.parts(coded.dictionary))
        bases, ends = (x.dictionary.to_numpy(zero_copy_only=False).tolist() for x in (base, signs))
        unlike = dict.fromkeys(chain(bases, ends))
        at = self.places(list(unlike))
        if len(unlike) < len(bases) + len(ends):
            # words of both kinds: the empty one, and signs alone
            where = dict(zip(unlike, at.tolist(), strict=True))
            at = np.array([where[w] for w in chain(bases, ends)], np.int64)
        # two runs of ids for each unlike word, and then those of all words in their order
        upto, kept = np.array(self.upto, np.int64), np.array(self.ids, "<u4")
        start, size = upto[:-1][at], np.diff(upto)[at]
        pairs = np.stack([base.indices.to_numpy(), signs.indices.to_numpy() + len(bases)], 1)
        flat, sizes = gathered(kept, start[pairs].ravel(), size[pairs].ravel()), size[pairs].sum(1)
        which = coded.indices.to_numpy()
        counts = sizes[which]
        ids = gathered(flat, (np.cumsum(sizes) - sizes)[which], counts)
        last = np.concatenate(([0], np.cumsum(counts)))[words.offsets.to_numpy()].tolist()
        return [ids[a:b].tobytes() for a, b in zip(last[:-1], last[1:], strict=True)]


def gathered(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Runs of values one after the other: counts[i] of them from starts[i] on."""
    before = np.cumsum(counts) - counts
    return values[np.repeat(starts - before, counts) + np.arange(counts.sum())]


@lru_cache(2)
def word_ids(path: str, markers: bool = True) -> WordIds:
    return WordIds(path, markers)


def pieces_of(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END, markers: bool = True) -> DataFrame:
    """Windows and rest of each document's ids, in the order of the input; block: the task; nth: rank among its pieces of one length."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
    names = [f.split()[0] for f in PIECES.split(", ")]
    last = array("I", [end]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, block, seen = word_ids(tokenizer, markers), TaskContext.get().partitionId(), {}
        try:
            for batch in batches:
                for lo, hi in ranges(batch.column(1), 2 << 20):
                    part = batch.slice(lo, hi - lo)
                    rows = []
                    for doc, ids in zip(part.column(0).to_pylist(), ids_of.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                        ids += last
                        n = len(ids) // 4
                        for start in range(0, n, window):
                            size = min(window, n - start)
                            nth = seen[size] = seen.get(size, -1) + 1
                            rows.append((doc, start, size, n, ids[4 * start : 4 * (start + size)], block, nth))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        finally:
            ids_of.forget()
            pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


# --- the plan


def combinations(total: int, depth: int) -> list[tuple[int, ...]]:
    """All ways to fill a window of so many steps with at most depth classes, the largest first."""
    found: list[tuple[int, ...]] = []

    def more(head: tuple[int, ...], rest: int, most: int) -> None:
        if not rest:
            found.append(head)
        elif len(head) < depth:
            for k in range(min(rest, most), (rest - 1) // (depth - len(head)), -1):
                more((*head, k), rest - k, k)

    more((), total, total)
    return found


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-8) -> np.ndarray:
    """The x >= 0 with the least |a x - b|, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, used = np.zeros(n), np.zeros(n, bool)
    scale = max(float(np.abs(b).max(initial=0)), 1e-30)
    for _ in range(3 * a.shape[0] + 30):
        slope = a.T @ (b - a @ x)
        slope[used] = -np.inf
        at = int(slope.argmax())
        if slope[at] <= tolerance * scale * a.shape[0]:
            break
        used[at] = True
        while True:
            own = np.flatnonzero(used)
            z = np.linalg.lstsq(a[:, own], b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[own] = z
                break
            low = z <= 0
            part = np.min(x[own][low] / np.maximum(x[own][low] - z[low], 1e-300))
            x[own] += part * (z - x[own])
            used[own[(x[own] <= 1e-12 * scale) & low]] = False
            x[~used] = 0
            if not used.any():
                break
    return x


def plan(histogram: dict[int, int], steps: int, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """Combinations and how often each is used, so that no class is used more than it has pieces."""
    left = np.zeros(steps + 1, np.int64)
    for k, v in histogram.items():
        left[k] = v
    whole = left[steps]
    left[steps] = 0
    options = [c for c in combinations(steps, depth) if len(c) > 1 and all(left[k] for k in c)]
    chosen = [((steps,), int(whole))] if whole else []
    if options:
        a = np.zeros((steps + 1, len(options)))
        for j, c in enumerate(options):
            for k in c:
                a[k, j] += 1
        # errors count by the tokens they leave over
        weight = np.arange(steps + 1)[:, None] / steps
        x = nnls(a * weight, left * weight[:, 0])
        for j in np.argsort(-x, kind="stable"):
            need = np.bincount(options[j], minlength=steps + 1)
            times = int(min(np.floor(x[j] + 1e-6), (left[need > 0] // need[need > 0]).min()))
            if times > 0:
                chosen.append((options[j], times))
                left -= times * need
    return chosen


# --- places


@dataclass
class Places:
    """Places of pieces by their rank among pieces of their length: a row for each range of ranks.

    Ranks lo to hi - 1 of a length lie in sequences at, at + 1, ..., per of them in each, from offset on.
    """

    length: list[int] = field(default_factory=list)
    lo: list[int] = field(default_factory=list)
    hi: list[int] = field(default_factory=list)
    at: list[int] = field(default_factory=list)
    per: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)

    def add(self, length: int, lo: int, hi: int, at: int, per: int, offset: int) -> None:
        for column, value in zip((self.length, self.lo, self.hi, self.at, self.per, self.offset), (length, lo, hi, at, per, offset), strict=True):
            column.append(value)


def places(histogram: dict[int, int], window: int, step: int, depth: int) -> tuple[Places, int]:
    """Where pieces of each length go (histogram: their number), and the number of sequences that the plan fills.

    There are a few rows for each length, combination and partly filled kind of sequence: their number has a bound
    that doesn't grow with the pieces.
    """
    classes: dict[int, list[list[int]]] = {}
    for length in sorted(histogram):
        classes.setdefault(-(-length // step), []).append([length, 0, histogram[length]])
    chosen = plan({k: sum(n for _, _, n in runs) for k, runs in classes.items()}, window // step, depth)
    found, room, planned = Places(), [], 0
    for kinds, times in chosen:
        taken = []
        for kind in kinds:
            own, need = [], times
            while need:
                run = classes[kind][-1]
                n = min(need, run[2])
                own.append((run[0], run[1], n))
                run[1], run[2], need = run[1] + n, run[2] - n, need - n
                if not run[2]:
                    classes[kind].pop()
            taken.append(own)
        # sequences of this combination whose parts have equal lengths
        done, at = 0, [(0, 0)] * len(kinds)
        while done < times:
            n = min(own[i][2] - used for own, (i, used) in zip(taken, at, strict=True))
            offset = 0
            for k, (own, (i, used)) in enumerate(zip(taken, at, strict=True)):
                length, first, count = own[i]
                found.add(length, first + used, first + used + n, planned + done, 1, offset)
                offset += length
                at[k] = (i, used + n) if used + n < count else (i + 1, 0)
            if offset < window:
                room.append((window - offset, planned + done, n))
            done += n
        planned += times
    rest = sorted((run for runs in classes.values() for run in runs), reverse=True)
    room.sort()
    least, sequences = rest[-1][0] if rest else 0, planned

    def keep(slack: int, at: int, count: int) -> None:
        if count and slack >= least:
            insort(room, (slack, at, count))

    for length, rank, left in rest:
        while left:
            i = bisect_left(room, (length,))
            if i == len(room):
                opened = -(-left // (window // length))
                room.append((window, sequences, opened))
                sequences += opened
            slack, at, count = room.pop(i)
            per, offset = slack // length, window - slack
            full = min(count, left // per)
            if full:
                found.add(length, rank, rank + full * per, at, per, offset)
                keep(slack - per * length, at, full)
                rank, left = rank + full * per, left - full * per
            if full < count:
                if left:
                    found.add(length, rank, rank + left, at + full, left, offset)
                    keep(slack - left * length, at + full, 1)
                    full, left = full + 1, 0
                keep(slack, at + full, count - full)
    return found, planned


# --- sequences


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, step: int = STEP, depth: int = DEPTH, end: int = END, markers: bool = True) -> DataFrame:
    """Pieces of all rows of docs (doc_id, text): doc_id, start, length, doc_tokens, ids (little-endian unsigned 32 bits), sequence_id, offset, planned.

    A null or empty text is its end token alone. Each row's ids lie in exactly one piece each, repeated rows too;
    lengths never sum to more than window in a sequence, and offsets are gapless from 0; of pieces of one length those
    of earlier tasks and rows come first. planned: the piece's place is of the least-squares plan, not of the greedy
    rest. markers: see WordIds. An empty table gives an empty result; other columns are not read. Ids are made once
    and written; ranks are sums over tasks' counts (a row for each task and length), so that no task or driver holds
    more than counts of the whole, and the ids move once, to their counts.
    """
    spark = docs.sparkSession
    pieces = staged(pieces_of(docs, tokenizer or default_tokenizer(), window, end, markers), "pieces")
    counts = staged(pieces.groupBy("block", "length").agg((F.max("nth") + 1).alias("n")), "counts")
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("block", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # at most window rows
    slots, planned = places({r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}, window, step, depth)
    table = pd.DataFrame(vars(slots), dtype=np.int64).sort_values(["length", "lo"])
    held = sent(spark, ((table["length"].to_numpy() << 40) + table["lo"].to_numpy(), *(table[c].to_numpy() for c in ("lo", "at", "per", "offset"))))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, lo, at, per, offset = held.value
        size, r = length.to_numpy(), rank.to_numpy()
        i = np.searchsorted(keys, (size << 40) + r, "right") - 1
        turn, nth = np.divmod(r - lo[i], per[i])
        return pd.DataFrame({"sequence_id": at[i] + turn, "offset": offset[i] + nth * size})

    # a row for each task and length, which grows with the corpus though its file is small: merged, not broadcast
    placed = pieces.join(bases.hint("merge"), ["block", "length"]).withColumn("place", place("length", F.col("base") + F.col("nth")))
    return placed.select("doc_id", "start", "length", "doc_tokens", "ids", "place.sequence_id", "place.offset", (F.col("place.sequence_id") < planned).alias("planned"))


def packing_report(docs: DataFrame) -> DataFrame:
    """Pieces of ``pack``, where nulls, ties, repeated rows and empty tables are stated, with a checksum for their ids."""
    found = pack(docs)
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "planned")
