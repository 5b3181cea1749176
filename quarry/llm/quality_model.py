"""Quality by attention-based multiple-instance learning, in numpy.

A document is a bag of passages of ``PASSAGE`` words, all of them.  Each passage is encoded from rates of
its words and a hashed bag of words; gated attention weighs the encoded passages; the
weighted sum is scored.  Only documents carry labels: the attention is learned from them too.
The model is fitted on at most ``sample_rows`` labelled documents with at most ``sample_passages`` passages,
the ones with the smallest hash of the id; every document is scored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import chunks, stored, texts

PASSAGE, WORD_DIMS, HIDDEN, ATTENTION = 64, 32, 24, 16
TRAITS = 11
DIMS = TRAITS + WORD_DIMS + 2
SYMBOLS = frozenset("#*$%&|<>")


def word_traits(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Per distinct word: a row of traits, and its bucket."""
    out = np.zeros((len(words), TRAITS - 2), np.float32)
    bucket = np.zeros(len(words), np.int64)
    for k, w in enumerate(words):
        n = len(w)
        if not n:
            continue
        low = w.lower()
        plain = w.isalpha()
        out[k, 0] = n / 8
        out[k, 1] = n > 14
        if plain:
            out[k, 4] = n > 1 and w.isupper()
        else:
            signs = sum(c in SYMBOLS for c in w)
            out[k, 2] = min(signs, 4)
            out[k, 3] = signs == n
            out[k, 4] = sum(map(str.isalpha, w)) > 1 and w.isupper()
            out[k, 5] = w.count("!") + w.count("?")
            out[k, 6] = any(map(str.isdigit, w))
            out[k, 7] = w[-1] in ".,;:"
        out[k, 8] = w != low
        bucket[k] = zlib.crc32(low.strip(".,;:!?").encode()) % WORD_DIMS
    return out, bucket


def passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of all passages, and how many each text has (one at least, also of an empty text)."""
    words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(column))
    bounds = words.offsets.to_numpy().astype(np.int64)
    bounds -= bounds[0]
    coded = pc.dictionary_encode(words.flatten())
    codes = coded.indices.to_numpy().astype(np.int64)
    traits, bucket = word_traits(coded.dictionary.to_pylist())
    sizes = np.diff(bounds)
    count = -(-sizes // PASSAGE)
    n, total = len(codes), int(count.sum())
    first = np.cumsum(count) - count
    text = np.repeat(np.arange(len(sizes)), sizes)
    at = np.repeat(first, sizes) + (np.arange(n) - bounds[text]) // PASSAGE
    length = np.bincount(at, minlength=total).astype(np.float32)[:, None]
    x = np.zeros((total, DIMS), np.float32)
    starts = np.flatnonzero(np.diff(at, prepend=-1))
    for s in range(0, total, 4096):  # bounds what is gathered at once
        lo, hi = starts[s], starts[s + 4096] if s + 4096 < total else n
        x[s : s + 4096, : TRAITS - 2] = np.add.reduceat(traits[codes[lo:hi]], starts[s : s + 4096] - lo, axis=0)
    same = np.zeros(n, np.float32)
    same[1:] = (codes[1:] == codes[:-1]) & (text[1:] == text[:-1])
    x[:, TRAITS - 2] = np.bincount(at, same, total)
    x[:, TRAITS - 1] = np.bincount(at, repeated(codes, text), total)
    x[:, TRAITS : TRAITS + WORD_DIMS] = np.bincount(at * WORD_DIMS + bucket[codes], minlength=total * WORD_DIMS).reshape(total, -1)
    x /= length
    x[:, TRAITS + WORD_DIMS] = np.log1p(length[:, 0]) / 4
    x[:, TRAITS + WORD_DIMS + 1] = np.log1p(np.repeat(sizes, count)) / 8
    return x, count


def repeated(codes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """1 where the four words from here on are found again in the same text."""
    out = np.zeros(len(codes), np.float32)
    if len(codes) < 5:
        return out
    key = text[3:].astype(np.uint64)
    for k in range(4):
        key = (key ^ codes[k : len(codes) - 3 + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    whole = text[3:] == text[:-3]
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    pair = key[order[1:]] == key[order[:-1]]
    again[order[1:]] |= pair
    again[order[:-1]] |= pair
    out[: len(key)] = again & whole
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionModel:
    """Gated attention over encoded passages."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        make = lambda a, b: r.normal(0, a**-0.5, (a, b)).astype(np.float32)
        self.w = {"e": make(DIMS, HIDDEN), "f": np.zeros(HIDDEN, np.float32), "v": make(HIDDEN, ATTENTION), "u": make(HIDDEN, ATTENTION), "a": make(ATTENTION, 1), "o": make(HIDDEN, 1), "b": np.zeros(1, np.float32)}
        self.mean, self.scale = np.zeros(DIMS, np.float32), np.ones(DIMS, np.float32)

    def forward(self, x: np.ndarray, count: np.ndarray) -> tuple:
        w, first = self.w, np.cumsum(count) - count
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ w["e"] + w["f"])
        t, s = np.tanh(h @ w["v"]), sigmoid(h @ w["u"])
        e = (t * s @ w["a"])[:, 0]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), count))
        a = (e / np.repeat(np.add.reduceat(e, first), count))[:, None]
        z = np.add.reduceat(a * h, first, axis=0)
        return sigmoid((z @ w["o"])[:, 0] + w["b"]), (x, h, t, s, a, z, first)

    def score(self, x: np.ndarray, count: np.ndarray) -> np.ndarray:
        return self.forward(x, count)[0] if len(count) else np.zeros(0)

    def gradients(self, x: np.ndarray, count: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss by every weight."""
        p, (x, h, t, g, a, z, first) = self.forward(x, count)
        d = ((p - y) / len(y)).astype(np.float32)[:, None]
        w, back = self.w, lambda v: np.repeat(v, count, axis=0)
        grad = {"o": z.T @ d, "b": d.sum(0)}
        dz = back(d @ w["o"].T)
        da = (dz * h).sum(1, keepdims=True)
        de = a * (da - back(np.add.reduceat(a * da, first, axis=0)))
        grad["a"] = (t * g).T @ de
        dts = de @ w["a"].T
        dt, dg = dts * g * (1 - t * t), dts * t * g * (1 - g)
        grad["v"], grad["u"] = h.T @ dt, h.T @ dg
        dh = (a * dz + dt @ w["v"].T + dg @ w["u"].T) * (1 - h * h)
        grad["e"], grad["f"] = x.T @ dh, dh.sum(0)
        return grad

    def fit(self, x: np.ndarray, count: np.ndarray, y: np.ndarray, epochs: int = 24, size: int = 64, seed: int = 11) -> AttentionModel:
        r = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        ends = np.cumsum(count)
        one, two = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        step = 0
        for epoch in range(epochs):
            order = r.permutation(len(count))
            for s in range(0, len(order), size):
                own = order[s : s + size]
                rows = np.concatenate([np.arange(ends[k] - count[k], ends[k]) for k in own])
                c = count[own]
                w, grad = self.w, self.gradients(x[rows], c, y[own])
                step += 1
                rate = 0.006 * (1 - 0.9 * epoch / epochs)
                for k in w:
                    grad[k] = grad[k] + 1e-4 * w[k]
                    one[k] = 0.9 * one[k] + 0.1 * grad[k]
                    two[k] = 0.99 * two[k] + 0.01 * grad[k] ** 2
                    w[k] = (w[k] - rate * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self


def held_out(name: str = "doc_id", folds: int = 5) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(name).cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 6000, sample_passages: int = 200_000) -> AttentionModel | None:
    """A model of the labelled documents that aren't held out; null labels don't count; None if there are none.

    A document with both labels counts with each; of rows that share an id the smallest text counts.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    known = known.where(~held_out("id")).distinct().orderBy(F.xxhash64("id"), "id", "label").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")
    rows = rows.groupBy("id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            x, count = passages(texts(batch, "text"))
            ends = np.cumsum(count)
            raw = [x[e - c : e].astype("<f4").tobytes() for e, c in zip(ends, count, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.string()), batch.column("label"), pa.array(count, pa.int64()), pa.array(raw, pa.binary())], ["id", "label", "n", "x"])

    # One row a labelled document: their running total is small, their vectors may not be.
    encoded = stored(rows.mapInArrow(encode, "id string, label int, n long, x binary"), "labelled")
    upto = F.sum("n").over(Window.orderBy(F.xxhash64("id"), "id", "label"))
    within = encoded.select("id", "label", "n").withColumn("_upto", upto).where(F.col("_upto") <= sample_passages)
    got = sorted(tuple(r) for r in encoded.join(F.broadcast(within.select("id", "label")), ["id", "label"]).select("id", "label", "x").collect())
    if not got:
        return None
    bags = [np.frombuffer(r[2], "<f4").reshape(-1, DIMS) for r in got]
    return AttentionModel().fit(np.concatenate(bags), np.array([len(b) for b in bags]), np.array([r[1] for r in got], np.float32))


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    threshold: float = 0.3, sample_rows: int = 6000, sample_passages: int = 200_000,
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row.

    Null and empty texts are one empty passage and get a score; a null id counts as not held out;
    repeated rows get the same score; without any label every score is 0.5.  A text may be of any length; an empty
    table gives an empty result; further columns aren't read.
    """
    model = fitted(docs, labels, id_col, text_col, label_col, sample_rows, sample_passages)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            x, count = passages(texts(batch, "text"))
            p = np.full(batch.num_rows, 0.5) if model is None else model.score(x, count)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(p, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    scored = rows.mapInArrow(score, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
