"""Language identification by a convolutional network over bytes, trained here in numpy.

Filters of several widths slide over embedded bytes of a fixed-length window; the largest response of each filter
feeds a softmax. Every window of a text is scored and a text's probabilities are the geometric mean over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import sent, staged
from .words import Texts, per_text

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 16, 8
#: Documents to fit on, whole, shared evenly by the languages, one of each at least; unlike windows of them that reach the driver (256 bytes each), one of each language at least. The fit is bounded, scoring isn't.
SAMPLE, WINDOWS, EPOCHS = 2048, 1 << 16, 8
#: Bytes by class: 0 pads; letters without case; digits, white space, other ASCII; each byte beyond ASCII by its low bits.
CLASSES = 96
CLASS_OF = np.full(256, 29, np.uint8)
CLASS_OF[0x30:0x3A] = 28
CLASS_OF[[0x20, *range(0x09, 0x0E)]] = 27
CLASS_OF[0x61:0x7B] = CLASS_OF[0x41:0x5B] = np.arange(1, 27)
CLASS_OF[0x80:] = 32 + (np.arange(0x80, 0x100) & 63)

UNKNOWN = "und"


@dataclass
class Network:
    """embed: class by dimension; weights: for each width, offset by dimension by filter; out: filter by language."""

    languages: list[str]
    embed: np.ndarray
    weights: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The filters' responses to each pair of classes: a filter of width 3 or 4 is the sum of two of them."""
        one = [[self.embed @ w[j] for j in range(len(w))] for w in self.weights]
        pair = lambda a, b: (a[:, None] + b[None]).reshape(CLASSES * CLASSES, -1)
        heads = np.concatenate([pair(x[0], x[1]) for x in one], 1) + self.bias
        return heads.astype(np.float32), one[1][2].astype(np.float32), pair(one[2][2], one[2][3]).astype(np.float32)


def windows_of(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte classes of all windows of all texts (0 beyond the end), the text of each, and its bytes."""
    sizes = np.diff(texts.offsets)
    counts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(texts.n), counts)
    inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    begins = texts.offsets[owner] + inner * WINDOW
    used = np.minimum(WINDOW, texts.offsets[owner + 1] - begins)
    places = begins[:, None] + np.arange(WINDOW)
    classes = CLASS_OF[texts.data[np.minimum(places, max(len(texts.data) - 1, 0))]] if len(owner) else np.zeros((0, WINDOW), np.uint8)
    classes[np.arange(WINDOW)[None] >= used[:, None]] = 0
    return classes, owner, used


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(1, keepdims=True)
    return x - np.log(np.exp(x).sum(1, keepdims=True))


def pooled(classes: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Of each window the largest response of each filter, at least 0. tables: from Network.tables."""
    heads, third, tail = tables
    found = np.zeros((len(classes), heads.shape[1]), np.float32)
    for lo in range(0, len(classes), 32):
        part = classes[lo : lo + 32]
        pairs = part[:, :-1].astype(np.int32) * CLASSES + part[:, 1:]
        all_ = heads[pairs]
        found[lo : lo + 32, :FILTERS] = all_[:, :, :FILTERS].max(1)
        found[lo : lo + 32, FILTERS : 2 * FILTERS] = (all_[:, :-1, FILTERS : 2 * FILTERS] + third[part[:, 2:]]).max(1)
        found[lo : lo + 32, 2 * FILTERS :] = (all_[:, :-2, 2 * FILTERS :] + tail[pairs[:, 2:]]).max(1)
    return np.maximum(found, 0)


def train(texts: list[str], labels: list[str], epochs: int = EPOCHS, rate: float = 0.01, seed: int = 1) -> Network:
    """A network fit on all windows of the texts, each weighed by its bytes."""
    parts = [windows_of(Texts(pa.array([text], pa.string()))) for text in texts]
    windows, used = np.concatenate([w for w, _, _ in parts]), np.concatenate([u for _, _, u in parts])
    return fit(windows, np.repeat(np.array(labels, object), [len(u) for _, _, u in parts]).tolist(), used, epochs, rate, seed)


def fit(x: np.ndarray, labels: list[str], weights: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, seed: int = 1) -> Network:
    """Adam on the weighed cross-entropy of windows (byte classes); the same windows in the same order give the same network."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    number = {x: i for i, x in enumerate(languages)}
    y, weights = np.array([number[v] for v in labels]), np.asarray(weights, np.float32) / WINDOW
    p = [rng.normal(0, 0.3, (CLASSES, EMBED)), *(rng.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS)) for w in WIDTHS), np.zeros(FILTERS * len(WIDTHS)), rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))), np.zeros(len(languages))]
    p = [v.astype(np.float32) for v in p]
    p[0][0] = 0
    moment, square, step = [np.zeros_like(v) for v in p], [np.zeros_like(v) for v in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), 64):
            bx, by, bw = x[order[lo : lo + 64]], y[order[lo : lo + 64]], weights[order[lo : lo + 64]]
            emb = p[0][bx]
            tops, places = [], []
            for i, w in enumerate(WIDTHS):
                conv = sum(emb[:, j : WINDOW - w + 1 + j] @ p[1 + i][j] for j in range(w))
                at = conv.argmax(1)
                places.append(at)
                tops.append(np.take_along_axis(conv, at[:, None], 1)[:, 0])
            raw = np.concatenate(tops, 1) + p[4]
            act = np.maximum(raw, 0)
            prob = np.exp(log_softmax(act @ p[5] + p[6]))
            prob[np.arange(len(by)), by] -= 1
            prob *= (bw / bw.sum())[:, None]
            back = (prob @ p[5].T) * (raw > 0)
            grads = [np.zeros_like(p[0]), *(np.zeros_like(p[1 + i]) for i in range(len(WIDTHS))), back.sum(0), act.T @ prob, prob.sum(0)]
            rows = np.arange(len(bx))[:, None]
            for i, w in enumerate(WIDTHS):
                part = back[:, i * FILTERS : (i + 1) * FILTERS]
                for j in range(w):
                    here = places[i] + j
                    grads[1 + i][j] = np.einsum("nf,nfd->df", part, emb[rows, here])
                    at, back_in = bx[rows, here].ravel(), (part[:, :, None] * p[1 + i][j].T[None]).reshape(-1, EMBED)
                    grads[0] += np.stack([np.bincount(at, back_in[:, d], CLASSES) for d in range(EMBED)], 1).astype(np.float32)
            grads[0][0] = 0
            step += 1
            for v, g, m, s in zip(p, grads, moment, square, strict=True):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return Network(languages, p[0], p[1:4], p[4], p[5], p[6])


def picked(docs: DataFrame, size: int = SAMPLE) -> DataFrame:
    """About size whole (text, lang, doc_id) rows of docs, spread over all languages by a hash of the id; of each language one at least.

    Of the texts that share id and language one is learnt from, that of the smallest hash, so that an id which repeats doesn't grow the sample.
    """
    known = docs.where("text is not null and lang is not null and doc_id is not null").select("doc_id", "text", "lang", F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)).alias("_h"))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"), F.min("_h").alias("_least"))
    each = max(1, size // max(counts.count(), 1))
    # a row for each language, as many as the network has outputs
    rows = known.join(F.broadcast(counts), "lang").where((F.col("_h") < F.least(F.lit(1.0), each / F.col("_n")) * float(1 << 30)) | (F.col("_h") == F.col("_least")))
    return rows.groupBy("doc_id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def sample(docs: DataFrame, size: int = SAMPLE) -> list[tuple[str, str]]:
    """The texts and languages of picked."""
    return [(r.text, r.lang) for r in sorted(picked(docs, size).collect(), key=lambda r: (r.doc_id, r.lang))]


def network_of(docs: DataFrame, size: int = SAMPLE, epochs: int = EPOCHS, most: int = WINDOWS) -> Network | None:
    """Fit on the windows of picked texts, made in the tasks: equal ones of a language are one with their number, and beyond most of them a share of each language's by a hash. None without any window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, owner, used = windows_of(Texts(batch.column(1)))
            for lo in range(0, len(used), 1 << 14):
                some = slice(lo, lo + (1 << 14))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[some])), pa.array([w.tobytes() for w in classes[some]], pa.binary()), pa.array(used[some], pa.int64())], names=["lang", "window", "used"])

    windows = picked(docs, size).select("lang", "text").mapInArrow(run, "lang string, window binary, used bigint")
    windows = staged(windows.groupBy("lang", "window").agg(F.sum("used").alias("bytes")).withColumn("_h", F.pmod(F.xxhash64("lang", "window"), F.lit(1 << 30))), "windows")
    counts = windows.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"), F.min("_h").alias("_least"))
    each = max(1, most // max(counts.count(), 1))
    rows = windows.join(F.broadcast(counts), "lang").where((F.col("_h") < F.least(F.lit(1.0), each / F.col("_n")) * float(1 << 30)) | (F.col("_h") == F.col("_least")))
    held = rows.select("lang", "window", "bytes").orderBy("lang", "window").toArrow()
    if not held.num_rows:
        return None
    x = np.frombuffer(b"".join(held.column("window").to_pylist()), np.uint8).reshape(-1, WINDOW)
    return fit(x, held.column("lang").to_pylist(), np.asarray(held.column("bytes")), epochs)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def identify(docs: DataFrame, learn: DataFrame, keep: tuple[str, ...] = ("doc_id",), size: int = SAMPLE, epochs: int = EPOCHS) -> DataFrame:
    """The kept columns, lang_pred and score (0 to 1) for each row of docs (text), with a network fit on learn (doc_id, text, lang).

    Texts that are null or have no letter are ``und`` with score 0, and so is all if learn has no language. Whole
    texts are scored, window by window; of equally likely languages the first by name is taken; repeated rows get
    equal answers; an empty table gives an empty result;
    columns of other names are not read. The fit is on a bounded sample (SAMPLE, WINDOWS) with every window of its
    texts, however short, and every language of learn; scoring is one pass without a shuffle.
    """
    network = network_of(learn, size, epochs)
    held = sent(docs.sparkSession, (network, network.tables() if network else None))

    def make(column: pa.Array) -> dict[str, pa.Array]:
        network, tables = held.value
        texts = Texts(column)
        known = np.array([has_letter(t.as_py()) for t in column], bool)
        if network is None:
            return {"lang_pred": pa.array([UNKNOWN] * texts.n), "score": pa.array(np.zeros(texts.n))}
        total = np.zeros((texts.n, len(network.languages)))
        classes, owner, used = windows_of(texts)
        logs = log_softmax(pooled(classes, tables).astype(np.float64) @ network.out + network.out_bias)
        np.add.at(total, owner, logs * used[:, None])
        total /= np.maximum(np.diff(texts.offsets), 1)[:, None]
        prob = np.exp(log_softmax(total))
        best = prob.argmax(1)
        return {
            "lang_pred": pa.array([network.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], pa.string()),
            "score": pa.array(np.where(known, prob[np.arange(texts.n), best], 0.0)),
        }

    made = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return per_text(docs, make, T.StructType([*docs.select(*keep).schema.fields, *made]), keep)


def bucket(mod: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(mod))


def language_report(docs: DataFrame) -> DataFrame:
    """Fit on rows outside the held-out third; rows without an id are neither held out nor learnt from. Null and empty texts, ties, repeated rows and empty tables are as in ``identify``."""
    docs = docs.select("doc_id", "text", "lang")
    found = identify(docs, docs.where(bucket(3) != 1))
    return found.select("doc_id", F.coalesce(bucket(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")

