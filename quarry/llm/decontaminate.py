"""Benchmark decontamination by spaced-seed hashing.

Fixed masks choose some of a window's words and ignore the others, so a window whose ignored words were
substituted still hashes alike.  The test items' hashes are joined to those of every training
window, and around each hit the two texts are compared word by word on the hit's diagonal: an
overlap is ``window`` aligned words (or a whole shorter item) of which ``agree`` are equal.
Masks are added for each length until no pattern of substitutions that ``agree`` allows is missed; items of a few
words are matched whole and exactly.

Words are compared without case, punctuation and symbols; words of symbols alone don't count.
The items' side is held by every task, in blocks of about ``block_words`` words, one block after the other: with a
larger benchmark the documents are scanned once for each block.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import chunks, stored, texts

MASKS = ("111111", "1101101011", "11001010111", "1010110010011")
#: Patterns of substitutions up to which masks are chosen one by one; beyond, one run of words that no pattern can break up is the mask.
PATTERNS = 20_000
SIGNS = re.compile(r"[\W_]+")
BITS = 22
#: Hits whose places are held at once.
HELD = 2_000_000


class Words(dict):
    """Word to the hash of its normal form; 0 for symbols alone."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        plain = SIGNS.sub("", word).lower()
        self[word] = h = xxhash.xxh3_64_intdigest(plain) or 1 if plain else 0
        return h


WORDS = Words()


def hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words that count, and where each text's words start and the last ones end."""
    split = pc.ascii_split_whitespace(column)
    bounds = split.offsets.to_numpy().astype(np.int64)
    bounds -= bounds[0]
    coded = pc.dictionary_encode(split.flatten())
    distinct = coded.dictionary.to_pylist()
    h = np.fromiter((WORDS[w] for w in distinct), np.uint64, len(distinct))[coded.indices.to_numpy()]
    counts = h != 0
    return h[counts], np.concatenate([[0], np.cumsum(counts)])[bounds]


def seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the chosen words of every window."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, 0x51ED270B, np.uint64)
    for k, c in enumerate(mask):
        if c == "1":
            out ^= h[k : k + n]
            out *= np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
    return out


@lru_cache(maxsize=None)
def masks(window: int, agree: float) -> tuple[str, ...]:
    """``MASKS`` and what further ones it takes to hit every window of so many words of which ``agree`` are equal."""
    wrong = window - int(np.ceil(agree * window - 1e-9))
    run = -(-(window - wrong) // (wrong + 1))
    if math.comb(window, wrong) > PATTERNS:
        return (*MASKS, "1" * run)
    equal = np.ones((math.comb(window, wrong), window), bool)
    for row, places in zip(equal, combinations(range(window), wrong), strict=True):
        row[list(places)] = False

    def hit(mask: str) -> np.ndarray:
        chosen = [k for k, c in enumerate(mask) if c == "1"]
        return np.any([equal[:, [p + k for k in chosen]].all(1) for p in range(window - len(mask) + 1)], 0) if len(mask) <= window else np.zeros(len(equal), bool)

    out = list(MASKS)
    left = ~np.any([hit(m) for m in MASKS], 0)
    weight = max(1, min(6, 2 * (window - wrong) // 3))
    tried = ["".join("1" if k in (0, *c) else "0" for k in range(max((0, *c)) + 1)) for c in combinations(range(1, window), weight - 1)]
    hits = np.stack([hit(m) for m in tried]) if left.any() else None
    while left.any():
        k = int((hits & left).sum(1).argmax())
        out.append(tried[k])
        left &= ~hits[k]
    return tuple(out)


class Index(NamedTuple):
    """The items' seeds, sorted by hash within each mask, and the items' words."""

    masks: list[str]
    hashes: list[np.ndarray]
    items: list[np.ndarray]
    places: list[np.ndarray]
    bitmaps: list[np.ndarray]
    words: np.ndarray
    bounds: np.ndarray
    ids: pa.Array


def index(ids: pa.Array, column: pa.Array, exact: int, window: int, agree: float) -> Index:
    """Items of fewer than ``exact`` words have one mask, the whole item."""
    words, bounds = hashed(column)
    parts: tuple[list, list, list, list] = ([], [], [], [])
    sizes = np.diff(bounds)
    suits = {n: masks(n, agree) if n >= exact else ("1" * n,) for n in {min(int(n), window) for n in sizes if n}}
    used = list(dict.fromkeys(m for ms in suits.values() for m in ms))
    for mask in used:
        h, item, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(len(ids)):
            own = words[bounds[k] : bounds[k + 1]]
            if mask in suits.get(min(len(own), window), ()):
                h.append(seeds(own, mask))
                item.append(np.full(len(h[-1]), k))
                place.append(np.arange(len(h[-1])))
        joined = np.concatenate(h)
        order = np.argsort(joined, kind="stable")
        bitmap = np.zeros(1 << BITS, bool)
        bitmap[joined >> np.uint64(64 - BITS)] = True
        for part, x in zip(parts, (joined[order], np.concatenate(item)[order], np.concatenate(place)[order], bitmap), strict=True):
            part.append(x)
    return Index(used, *parts, words, bounds, ids)


def overlap(a: np.ndarray, b: np.ndarray, window: int, agree: float) -> tuple[int, int, int] | None:
    """First and last place of the qualifying windows of two aligned word rows, and the equal words between; None if there is none."""
    window = min(window, len(a))
    if not window:
        return None
    equal = a == b
    sums = np.concatenate([[0], np.cumsum(equal)])
    good = np.flatnonzero(sums[window:] - sums[:-window] >= np.ceil(agree * window - 1e-9))
    if not len(good):
        return None
    start, end = int(good[0]), int(good[-1]) + window
    return start, end, int(sums[end] - sums[start])


def found(ix: Index, words: np.ndarray, bounds: np.ndarray, exact: int, window: int, agree: float) -> Iterator[tuple[int, int, int, int, int]]:
    """``text, item, first word, words, equal words`` of each verified overlap, the best of a text and item: most equal words, then longest, then last."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    seen: list[np.ndarray] = []
    best: dict[tuple[int, int], tuple[int, int, int]] = {}

    def verify() -> None:
        for t, item, diagonal in np.unique(np.concatenate(seen), axis=0).tolist() if sum(map(len, seen)) else ():
            first, size = int(ix.bounds[item]), int(ix.bounds[item + 1] - ix.bounds[item])
            lo, hi = max(int(bounds[t]), diagonal), min(int(bounds[t + 1]), diagonal + size)
            if hi - lo < min(window, size):
                continue
            if got := overlap(words[lo:hi], ix.words[first + lo - diagonal : first + hi - diagonal], window, agree if size >= exact else 1.0):
                row = got[2], got[1] - got[0], lo + got[0] - int(bounds[t])
                best[t, item] = max(best.get((t, item), row), row)
        seen.clear()

    for k, mask in enumerate(ix.masks):
        h = seeds(words, mask)
        at = np.flatnonzero(ix.bitmaps[k][h >> np.uint64(64 - BITS)])
        at = at[text[at] == text[at + len(mask) - 1]]
        low = np.searchsorted(ix.hashes[k], h[at], "left")
        n = np.searchsorted(ix.hashes[k], h[at], "right") - low
        ends, s = np.cumsum(n), 0
        while s < len(at):  # a seed that both sides have often gives many pairs of places
            e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + HELD, "right")))
            own = n[s:e]
            rep = np.repeat(at[s:e], own)
            which = np.repeat(low[s:e] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
            seen.append(np.stack([text[rep], ix.items[k][which], rep - ix.places[k][which]], 1))
            if sum(map(len, seen)) > HELD:
                verify()
            s = e
    verify()
    for (t, item), (equal, n, start) in sorted(best.items()):
        yield t, item, start, n, equal


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = 13, agree: float = 0.75, exact: int = 8, block_words: int = 2_000_000,
) -> DataFrame:
    """``doc_id, item_id, start_word, n_words, n_equal``: a row for each document and item that overlap, and no other rows.

    Items of fewer than ``exact`` words overlap where all their words stand in a row.  Null and empty texts on either side, and
    those of symbols alone, overlap with nothing.  Null ids are passed on; repeated documents give a row each; equal items each
    give theirs; of several overlaps the one with most equal words counts, then the longest, then the last.  A text may be of any
    length.  Empty tables give an empty result; further columns aren't read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).alias("id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    kinds = rows.schema[0].dataType.simpleString(), items.schema[0].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, start_word long, n_words long, n_equal long"
    size = items.agg(F.sum(F.size(F.split("text", r"\s+")))).head()[0] or 0
    blocks = -(-size // block_words) or 1

    def one(block: DataFrame) -> DataFrame:
        got = block.toArrow()
        ids, column = got.column("id").combine_chunks(), got.column("text").combine_chunks().cast(pa.string())
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
        held = spark.sparkContext.broadcast(index(ids, column, exact, window, agree))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ix = held.value
            for batch in chunks(batches, "text"):
                hits = list(found(ix, *hashed(texts(batch, "text")), exact, window, agree))
                if hits:
                    t, item, start, n, equal = (pa.array(x, pa.int64()) for x in zip(*hits, strict=True))
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(t), ix.ids.take(item), start, n, equal], ["doc_id", "item_id", "start_word", "n_words", "n_equal"])

        out = rows.mapInArrow(scan, schema)
        if blocks > 1:  # the next block is collected when this one is done with
            out = stored(out, "contaminated")
            held.destroy()
        return out

    if blocks == 1:
        return one(items)
    return reduce(DataFrame.unionByName, [one(items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k)) for k in range(blocks)])
