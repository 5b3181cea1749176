"""Best-fit packing by a grouping genetic algorithm on islands.

Texts are tokenised by word: no token of this vocabulary's pre-tokenizer crosses a space, so a
worker encodes each distinct space-free string once and gathers a text's ids from those.
Pieces shorter than a sequence are dealt to shards of bounded size.  A shard is packed by
several islands: each starts from best-fit packings of random orders and breeds.  A child
takes whole well-filled bins of one parent, drops the other parent's bins that hold the same
pieces, and best-fits what was displaced, longest first.  After each round an island's elite migrates to the next
island of its shard.  A shard that reaches ``ceil(tokens / size)`` bins can't be bettered and stops.
The emptiest bins of all shards are packed again together.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import chunks, stored, texts

#: Latin letters that no normal form changes, then signs among which no special token or contraction begins.
SIGNS, LETTERS = ".,;:!?#*$%&|\"()/+=@~>-", "".join(chr(k) for k in range(65, 256) if chr(k).isalpha() and k not in (170, 181, 186))
ONLY_LETTERS = f"^[{LETTERS}]*$"
_ENCODERS: dict[str, Encoder] = {}


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [k for k in range(256) if k not in own]
    return {chr(k): k for k in own} | {chr(256 + n): k for n, k in enumerate(rest)}


class Merger:
    """The vocabulary's merges of one pre-token, over bytes.

    Joins of bytes are looked up by what they make, not by their halves.  That gives the same ids:
    with neighbours x and y that make z, what was merged within them was merged alike in z alone, so if z
    alone is encoded as z, then x and y are the halves it is made of, and if not, z is never made and is left out here.
    The byte 1, which no run of letters or signs has, marks the word's end.
    """

    def __init__(self, model: object, vocabulary: dict[str, int], merges: list):
        import tiktoken
        from tokenizers.models import BPE

        pairs = [tuple(pair.split(" ")) if isinstance(pair, str) else tuple(pair) for pair in merges]
        within = BPE(vocabulary, pairs)  # the same merges without an end of the word
        letters, end = byte_letters(), b"\1"
        ranks = {bytes([k]): k for k in range(256)} | {bytes([k, 1]): 255 + k for k in range(256) if k != 1}
        ranks = {raw: k for k, raw in enumerate(ranks)}
        ids = {}
        for token, k in vocabulary.items():
            stem = token.removesuffix("</w>")
            if stem and all(c in letters for c in stem):
                ids[bytes(letters[c] for c in stem) + end * (stem != token)] = token, k
        for x, y in pairs:
            stem = (x + y).removesuffix("</w>")
            raw = bytes(letters[c] for c in stem) + end * (stem != x + y)
            alone = (model if stem != x + y else within).tokenize(stem)
            if raw not in ranks and [t.id for t in alone] == [vocabulary[x + y]]:
                ranks[raw] = len(ranks)
        self.all = tiktoken.Encoding("words", pat_str=r"[^\x01]+\x01", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        self.last = np.array([raw.endswith(end) for raw in ranks])
        self.ids = np.zeros(len(ranks), np.uint32)
        for raw, rank in ranks.items():
            self.ids[rank] = ids[raw][1] if raw in ids else 0

    def encode(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all runs in a row, and how many each has; an empty run has none."""
        full = pc.binary_length(runs).to_numpy() > 0
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(runs)], pa.int32()), runs), "\1")[0].as_py()
        got = np.array(self.all(joined + "\1"), np.int64)
        lengths = np.zeros(len(runs), np.int64)
        lengths[full] = np.diff(np.flatnonzero(self.last[got]), prepend=-1)
        return self.ids[got], lengths


class Ragged:
    """Rows of ids, one after the other, that can be appended to and gathered."""

    def __init__(self) -> None:
        self.flat = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 12, np.int64)
        self.n = 0

    def append(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        used, n = int(self.starts[self.n]), self.n + len(lengths)
        while used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.flat[used : used + len(flat)] = flat
        self.starts[self.n + 1 : n + 1] = used + np.cumsum(lengths)
        self.n = n

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the rows ``at``, and where each ends."""
        lengths = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(lengths)
        where = np.repeat(self.starts[at] - (ends - lengths), lengths)
        where += np.arange(len(where))
        return self.flat[where], ends


class Encoder:
    """Ids of whole texts by way of their distinct space-free strings."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.merger = Merger(self.model.model, self.model.get_vocab(with_added_tokens=False), json.load(f)["model"]["merges"])

    @classmethod
    def of(cls, path: str) -> Encoder:
        """This worker's encoder, kept from task to task."""
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def encode_words(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the space-free strings in a row, and how many each has.

        Most strings are a run of letters and a run of signs, each of them one pre-token; the different runs are
        merged here and put together.  The others go through the whole tokenizer.
        """
        letters = pc.utf8_rtrim(column, characters=SIGNS)
        plain = pc.match_substring_regex(letters, ONLY_LETTERS)
        parts = [pc.dictionary_encode(pc.if_else(plain, x, "")) for x in (pc.utf8_lower(letters), pc.utf8_ltrim(column, characters=LETTERS))]
        runs, signs = (x.dictionary for x in parts)
        two = np.stack([1 + parts[0].indices.to_numpy(), 1 + len(runs) + parts[1].indices.to_numpy()], 1).astype(np.int64)
        odd = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        two[odd, 0] = 1 + len(runs) + len(signs) + np.arange(len(odd))
        known = Ragged()
        known.append(np.zeros(0, np.uint32), np.zeros(1, np.int64))
        known.append(*self.merger.encode(pa.concat_arrays([runs, signs])))
        ids = [e.ids for e in self.model.encode_batch(column.take(pa.array(odd)).to_pylist(), add_special_tokens=False)]
        known.append(np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids)))
        flat, ends = known.take(two.ravel())
        return flat, np.diff(ends[1::2], prepend=0)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's ids start and the last ones end."""
        words = pc.split_pattern(pc.replace_substring(column, "\n", " "), " ")  # no token sees which white space it was
        bounds = words.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        coded = pc.dictionary_encode(words.flatten())
        rows = Ragged()
        rows.append(*self.encode_words(coded.dictionary))
        ids, ends = rows.take(coded.indices.to_numpy())
        return ids, np.concatenate([[0], ends])[bounds]


def pieces(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: the texts' ids with ``end_id`` after them, cut at ``size``.

    A null or empty text has one piece: the end id.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in chunks(batches, "text", 4 << 20):
            ids, bounds = encoder.encode(texts(batch, "text"))
            row, piece, start, length, crc = [], [], [], [], []
            for k in range(batch.num_rows):
                own = np.append(ids[bounds[k] : bounds[k + 1]], np.uint32(end_id)).astype("<u4")
                for p, s in enumerate(range(0, len(own), size)):
                    part = own[s : s + size]
                    row.append(k)
                    piece.append(p)
                    start.append(s)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            ids_col = batch.column("id").take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids_col, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names)

    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Packing:
    """Bins of item numbers, found by the room they have left."""

    def __init__(self, lengths: list[int], size: int, bins: list[list[int]] = ()):
        self.lengths, self.size = lengths, size
        self.bins: list[list[int]] = []
        self.left: list[int] = []
        self.room: list[list[int]] = [[] for _ in range(size + 1)]
        self.mask = 0
        for b in bins:
            self.add(list(b), size - sum(lengths[i] for i in b))

    def add(self, items: list[int], left: int) -> None:
        self.room[left].append(len(self.bins))
        self.mask |= 1 << left
        self.bins.append(items)
        self.left.append(left)

    def best_fit(self, items: list[int]) -> None:
        """Each item to the fullest bin that takes it."""
        lengths, room, left = self.lengths, self.room, self.left
        for i in items:
            n = lengths[i]
            if above := self.mask >> n:
                r = n + (above & -above).bit_length() - 1
                b = room[r].pop()
                if not room[r]:
                    self.mask &= ~(1 << r)
                self.bins[b].append(i)
                left[b] = r - n
                room[r - n].append(b)
                self.mask |= 1 << (r - n)
            else:
                self.add([i], self.size - n)

    def fitness(self) -> tuple[int, float]:
        """Fewer bins, then more uneven filling."""
        return len(self.bins), -sum((1 - x / self.size) ** 2 for x in self.left)


def decreasing(items: list[int], lengths: list[int]) -> list[int]:
    return sorted(items, key=lambda i: (-lengths[i], i))


def crossed(a: Packing, b: Packing, random: np.random.Generator, share: float = 0.3) -> Packing:
    """``a`` with whole bins of ``b``: the fuller a bin, the likelier it comes."""
    fill = 1 - np.asarray(b.left) / b.size
    chosen = np.flatnonzero(random.random(len(fill)) < share * fill**8)
    taken = {i for k in chosen for i in b.bins[k]}
    weak = random.random(len(a.bins)) < 0.02 + (np.asarray(a.left) > 0.02 * a.size) * 0.3
    rest, displaced = [b.bins[k] for k in chosen], []
    for own, goes in zip(a.bins, weak, strict=True):
        if goes or not taken.isdisjoint(own):
            displaced += [i for i in own if i not in taken]
        else:
            rest.append(own)
    child = Packing(a.lengths, a.size, rest)
    child.best_fit(decreasing(displaced, a.lengths))
    return child


def evolve(lengths: list[int], size: int, seed: int, guests: list[list[int]], population: int, generations: int, last: bool = False) -> tuple[list[int], int, bool]:
    """Bin of each item in the best packing bred, fullest bins first, their number, and whether that is the fewest possible.

    ``guests`` are packings to breed from beside the ones that best-fit makes of random orders; in the ``last`` round
    best-fit-decreasing comes in as well, so that no packing is worse than it.
    """
    random = np.random.default_rng(seed)
    bound = -(-sum(lengths) // size)
    everyone = []

    def enter(p: Packing) -> bool:
        everyone.append((p.fitness(), len(everyone), p))
        return len(p.bins) == bound

    for assigned in guests:
        bins: list[list[int]] = [[] for _ in range(max(assigned, default=-1) + 1)]
        for i, b in enumerate(assigned):
            bins[b].append(i)
        enter(Packing(lengths, size, bins))
    while len(everyone) < population:
        p = Packing(lengths, size)
        p.best_fit(random.permutation(len(lengths)).tolist())
        enter(p)
    done = not lengths
    for _ in range(generations):
        if done:
            break
        everyone = sorted(everyone, key=lambda e: e[:2])[:population]
        everyone = [(f, k, p) for k, (f, _, p) in enumerate(everyone)]
        for _ in range(population):
            a, b = random.choice(len(everyone), 2, replace=len(everyone) < 2)
            if done := enter(crossed(everyone[min(a, b)][2], everyone[max(a, b)][2], random)):
                break
    if last and not done:
        p = Packing(lengths, size)
        p.best_fit(decreasing(list(range(len(lengths))), lengths))
        enter(p)
    best = min(everyone, key=lambda e: e[:2])[2]
    assigned = [0] * len(lengths)
    for k, b in enumerate(sorted(range(len(best.bins)), key=lambda b: (best.left[b], b))):
        for i in best.bins[b]:
            assigned[i] = k
    return assigned, len(best.bins), len(best.bins) == bound


def packed(
    parts: DataFrame, size: int = 2048, shard: int = 8192, islands: int = 2, rounds: int = 2, population: int = 4, generations: int = 4, loose: int = 40, pooled: int = 64
) -> DataFrame:
    """``parts`` (of ``pieces``) with ``sequence_id`` and ``offset``.

    Full pieces fill a sequence alone.  Shards hold about ``shard`` of the other pieces and are dealt by row,
    so that repeated documents spread; their number follows the input and their size does not.  The ``loose`` emptiest
    bins of every shard are taken apart again and packed in the same way, those of ``pooled`` shards together, until one shard is left.
    """
    parts = stored(parts, "pieces").withColumn("_row", F.monotonically_increasing_id())
    names = parts.drop("_row").columns
    out = parts.where(F.col("length") >= size).select(*names, (-F.col("_row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    some = parts.where(F.col("length") < size)
    n, level = max(1, round(some.count() / shard)), 0
    dealt = some.withColumn("_shard", F.pmod(F.xxhash64("_row"), F.lit(n)))
    while True:
        rows = stored(binned(dealt, names, size, n, islands, rounds, population, generations, level), "bins")
        final = rows if n == 1 else rows.where(F.col("own") < F.col("bins") - loose)
        before = "sum(length) OVER (PARTITION BY _shard, own ORDER BY _row ROWS UNBOUNDED PRECEDING) - length"
        number = (F.col("_shard") * 64 + level) * (1 << 20) + F.col("own")
        out = out.unionByName(final.select(*names, number.alias("sequence_id"), F.expr(before).alias("offset")))
        if n == 1:
            return out
        dealt = rows.where(F.col("own") >= F.col("bins") - loose).select("_row", *names, F.floor(F.col("_shard") / pooled).alias("_shard"))
        n, level = -(-n // pooled), level + 1


def binned(dealt: DataFrame, names: list[str], size: int, n: int, islands: int, rounds: int, population: int, generations: int, level: int) -> DataFrame:
    """The rows of ``n`` shards with their bin ``own`` and the shard's number of ``bins``."""
    shards = stored(dealt.groupBy("_shard").agg(F.sort_array(F.collect_list(F.struct("_row", *names))).alias("parts")), "shards")

    def island(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # one shard at a time
                (row,) = batch.slice(k, 1).to_pylist()
                own = row["own"]
                guests = [g for g in (own, row["guest"]) if g]
                if row["done"]:
                    out = own, row["bins"], True
                else:
                    seed = ((row["_shard"] * 64 + row["island"]) * 64 + row["round"]) * 64 + level
                    out = evolve(row["lengths"], size, seed, guests, population, generations, row["round"] == rounds - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["_shard"]], pa.int64()), pa.array([row["island"]], pa.int32()), pa.array([out[0]], pa.list_(pa.int32())), pa.array([out[1]], pa.int32()), pa.array([out[2]])],
                    ["_shard", "island", "own", "bins", "done"],
                )

    lengths = shards.select("_shard", F.expr("transform(parts, p -> cast(p.length AS int))").alias("lengths"))
    state = lengths.select("_shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
    none = F.lit(None).cast("array<int>")
    state = state.select("_shard", "island", none.alias("own"), F.lit(0).alias("bins"), F.lit(False).alias("done"), none.alias("guest"))
    schema = "_shard long, island int, own array<int>, bins int, done boolean"
    tasks = dealt.sparkSession.sparkContext.defaultParallelism * 2
    tasks = max(min(tasks, n * islands), n * islands // 32)  # a task's islands are bounded whatever the input
    for k in range(rounds):
        if k:
            best = F.min_by(F.struct("own", "bins", "done"), F.struct("bins", "island")).alias("b")
            done = state.groupBy("_shard").agg(best, F.max("done").alias("any"))
            elite = state.select("_shard", ((F.col("island") + 1) % islands).alias("island"), F.col("own").alias("guest"))
            state = state.join(elite, ["_shard", "island"]).join(done, "_shard")
            keep = lambda c: F.when(F.col("any"), F.col(f"b.{c}")).otherwise(F.col(c)).alias(c)
            state = state.select("_shard", "island", keep("own"), keep("bins"), F.col("any").alias("done"), "guest")
        state = stored(lengths.join(state, "_shard").withColumn("round", F.lit(k)).repartition(tasks, "_shard", "island").mapInArrow(island, schema), "islands")
    best = state.groupBy("_shard").agg(F.min_by(F.struct("own", "bins"), F.struct("bins", "island")).alias("b"))
    rows = shards.join(best, "_shard").select("_shard", "b.bins", F.explode(F.arrays_zip("parts", "b.own")).alias("x"))
    return rows.select("_shard", "bins", F.col("x.own").alias("own"), "x.parts.*")


def best_fit_packing(docs: DataFrame, path: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """A row for each piece of each document: what it is and where it lies.

    Null texts count as empty and pack their end id; null ids stay null; repeated rows are packed each; an empty table gives
    an empty result; further columns aren't read.
    """
    return packed(pieces(docs, path, size, 0, id_col, text_col), size, **options)
