"""MinHash near-duplicates with tensored banding, verified on full sets.

Two collections of ``TABLES`` small hashes, each of ``BAND`` minhashes, give ``TABLES`` squared
table keys, the pairs of a hash of either collection: 576 tables from 192 minhashes instead of
4,608.  Two texts of similarity s share no key with probability at most 2 (1 - s^BAND)^TABLES;
for 0.8 that is 7 in 1,000,000.  Texts of similarity 0.3, which boilerplate makes common, share one with 3 in 100.

Equal sets are one node from the start.  Nodes that share a key are linked to one of them, not to
each other, and connected: the *candidate* groups.  Within a group all sets are compared exactly, by
products of incidence matrices, and only a spanning forest of the links leaves a task.  The sets of a large group first meet
a few of its own, the pivots: a cluster of near copies hangs together by these, at a cost in proportion to its size, and only pairs that they
don't connect are compared, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import chunks, row_key, stored, texts
from quarry.llm.graph import Forest, components

TABLES, BAND = 24, 4
#: Nodes with candidates up to which their rows' keys (16 bytes each) are sent to every task, to find their texts without moving all.
FEW_ROWS = 300_000
_R = np.random.default_rng(20)
ODD = (_R.integers(0, 1 << 63, 2 * TABLES * BAND, np.uint64) << np.uint64(1)) | np.uint64(1)
XOR = _R.integers(0, 1 << 63, 2 * TABLES * BAND, np.uint64)
MIX = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


HASHES = Hashes()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its ``size``-word shingles; fewer words are one shingle, none give an empty set."""
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(column)))
    bounds = split.offsets.to_numpy().astype(np.int64)
    bounds -= bounds[0]
    coded = pc.dictionary_encode(split.flatten())
    distinct = coded.dictionary.to_pylist()
    h = np.fromiter((HASHES[w] for w in distinct), np.uint64, len(distinct))[coded.indices.to_numpy()]
    empty = np.fromiter((not w for w in distinct), bool, len(distinct))[coded.indices.to_numpy()] if "" in distinct else np.zeros(len(h), bool)
    n = len(h) - size + 1
    s = np.zeros(max(n, 0), np.uint64)
    for k in range(size):
        s = mixed(s ^ h[k : k + max(n, 0)])
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(s[a : b - size + 1]))
        elif b - a == 0 or (b - a == 1 and empty[a]):
            out.append(s[:0])
        else:
            own = np.full(1, b - a, np.uint64)
            for x in h[a:b]:
                own = mixed(own ^ x) + np.uint64(b - a)
            out.append(own)
    return out


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """A row of minhashes for each non-empty set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(ODD), len(sets)), np.uint64)
    held = np.empty_like(flat)
    for k in range(len(ODD)):
        np.bitwise_xor(flat, XOR[k], out=held)
        np.multiply(held, ODD[k], out=held)
        out[k] = np.minimum.reduceat(held, starts)
    return out.T


def keyed(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The first collection's hashes with their table's number mixed in, and the second's as 16 bits."""
    m = minhashes(sets).reshape(len(sets), 2, TABLES, BAND)
    key = np.zeros(m.shape[:3], np.uint64) + np.arange(TABLES, dtype=np.uint64)
    for k in range(BAND):
        key = mixed(key ^ m[..., k])
    return key[:, 0].astype(np.int64), (key[:, 1] >> np.uint64(48)).astype("<u2")


def digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def signatures(rows: DataFrame, size: int) -> DataFrame:
    """``id, row, n, node, keys, bands`` of ``id, row, text``; node is the set's digest, null for an empty set."""
    names = ["id", "row", "n", "node", "keys", "bands"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 2 << 20):
            sets = shingle_sets(texts(batch, "text"), size)
            full = [k for k, s in enumerate(sets) if len(s)]
            nodes: list[bytes | None] = [None] * len(sets)
            keys: list[list[int] | None] = [None] * len(sets)
            bands: list[bytes | None] = [None] * len(sets)
            if full:
                a, b = keyed([sets[k] for k in full])
                for j, k in enumerate(full):
                    nodes[k], keys[k], bands[k] = digest(sets[k]), a[j].tolist(), b[j].tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("row"), pa.array(map(len, sets), pa.int64()), pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(bands, pa.binary())], names
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(sign, f"id {kind}, row binary, n long, node binary, keys array<long>, bands binary")


def candidates(nodes: DataFrame) -> DataFrame:
    """Edges ``a, b`` that connect each node with the smallest one of every table key it has.

    The rows of one hash of the first collection lie together, in the nodes' order; within them the second
    collection's hashes tell tables apart.  What a task keeps is the first node for each key of the hash at hand.
    A node has one edge, to the lowest of its keys' first nodes; the other first nodes are linked to that one.
    """

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, {}
        for batch in batches:
            keys = batch.column("key").to_numpy()
            edge = np.flatnonzero(np.diff(keys)) + 1
            starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(keys)]])
            shared = np.flatnonzero((ends - starts > 1) | (starts == 0) | (ends == len(keys)))
            nodes, bands = batch.column("node"), batch.column("bands")
            out = set()
            for s, e in zip(starts[shared].tolist(), ends[shared].tolist(), strict=True):
                if keys[s] != last:
                    last, seen = keys[s], {}
                for k in range(s, e):
                    node, band = nodes[k].as_py(), bands[k].as_py()
                    met = {seen.setdefault((j, band[j : j + 2]), node) for j in range(0, 2 * TABLES, 2)}
                    low = min(met)
                    met.add(node)
                    out.update((m, low) for m in met if m != low)
            if out:
                a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    rows = nodes.select("node", F.explode("keys").alias("key"), "bands")
    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(link, "a binary, b binary").distinct()


def linked(sets: list[np.ndarray], percent: int, columns: int = 2048) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose similarity is ``percent`` or more."""
    g = len(sets)
    n = np.array([len(s) for s in sets], np.float32)
    tokens, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    rank = np.cumsum(shared) - 1
    row = np.repeat(np.arange(g), n.astype(np.int64))
    keep = shared[inverse]
    row, column = row[keep], rank[inverse[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    meet = np.zeros((g, g), np.float32)
    for s in range(0, int(shared.sum()), columns):
        lo, hi = np.searchsorted(column, [s, s + columns])
        m = np.zeros((g, columns), np.float32)
        m[row[lo:hi], column[lo:hi] - s] = 1
        meet += m @ m.T
    forest = Forest()
    out = []
    a, b = np.nonzero(np.triu(100 * meet >= percent * (n[:, None] + n[None] - meet), 1))
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if forest.root(x) != forest.root(y):
            forest.join(x, y)
            out.append((x, y))
    return out


def resolved(rows: DataFrame, size: int) -> DataFrame:
    """``node, component, heavy, n, set`` of ``node, component, heavy, text``, for the rows whose text makes that node."""

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            sets = shingle_sets(texts(batch, "text"), size)
            right = [k for k, (s, node) in enumerate(zip(sets, batch.column("node"), strict=True)) if digest(s) == node.as_py()]
            took = batch.take(pa.array(right, pa.int64()))
            yield pa.RecordBatch.from_arrays([took.column("node"), took.column("component"), took.column("heavy"), pa.array([len(sets[k]) for k in right], pa.int64()), pa.array([sets[k].tobytes() for k in right], pa.binary())], ["node", "component", "heavy", "n", "set"])

    return rows.select("node", "component", "heavy", "text").mapInArrow(resolve, "node binary, component binary, heavy boolean, n long, set binary")


def pivoted(large: DataFrame, parts: DataFrame, percent: int, pivots: int) -> DataFrame:
    """``node, component, mask, linked`` of the sets ``large``: to which of ``pivots`` sets of its group each is linked, as bits and as nodes.

    ``parts`` has the number of ``parts`` of each group: the pivots are sent to every part, so that no task has a whole group.
    """
    w = Window.partitionBy("component").orderBy(F.xxhash64("node"), "node")
    few = large.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= pivots)
    few = stored(few.select("component", "_n", "node", "set"), "pivot-sets")
    few = few.join(parts, "component").select("component", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "_n", "node", "set")
    dealt = large.join(parts, "component").select("component", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), "node", "set")

    def meet(members: pa.Table, pivot: pa.Table) -> pa.Table:
        pivot = sorted(zip(pivot.column("_n").to_pylist(), pivot.column("node").to_pylist(), [np.frombuffer(x, np.uint64) for x in pivot.column("set").to_pylist()], strict=True), key=lambda x: x[0])
        masks, linked = [], []
        for node, own in zip(members.column("node").to_pylist(), members.column("set").to_pylist(), strict=True):
            own, mask, to = np.frombuffer(own, np.uint64), 0, []
            for k, other, theirs in pivot:
                at = np.searchsorted(theirs, own)
                common = int((theirs[np.minimum(at, len(theirs) - 1)] == own).sum())
                if 100 * common >= percent * (len(own) + len(theirs) - common):
                    mask |= 1 << (k - 1)
                    if other != node:
                        to.append(other)
            masks.append(mask)
            linked.append(to)
        return pa.table({"node": members.column("node"), "component": members.column("component"), "mask": pa.array(masks, pa.int64()), "linked": pa.array(linked, pa.list_(pa.binary()))})

    few = few.select(*[F.col(c).alias(c) for c in few.columns])  # columns of its own
    pairs = dealt.groupBy("component", "part").cogroup(few.groupBy("component", "part"))
    return pairs.applyInArrow(meet, "node binary, component binary, mask long, linked array<binary>")


def joined_masks(masks: DataFrame) -> DataFrame:
    """``component, mask, piece``: masks that share a pivot, or are connected by such, are one piece; the mask 0 is none (-1)."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for component, every in zip(batch.column("component").to_pylist(), batch.column("masks").to_pylist(), strict=True):
                forest = Forest()
                for m in every:
                    bits = [k for k in range(m.bit_length()) if m >> k & 1]
                    for k in bits[1:]:
                        forest.join(bits[0], k)
                out += [(component, m, forest.root((m & -m).bit_length() - 1) if m else -1) for m in every]
            c, m, q = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()), pa.array(m, pa.int64()), pa.array(q, pa.int32())], ["component", "mask", "piece"])

    return masks.groupBy("component").agg(F.collect_set("mask").alias("masks")).mapInArrow(join, "component binary, mask long, piece int")


def verified(members: DataFrame, rows: DataFrame, size: int, percent: int, most: int = 1200, most_shingles: int = 1_500_000, pivots: int = 8) -> DataFrame:
    """Edges ``a, b`` of the links within each candidate group; ``members`` has ``node, row, n, component``.

    A group of at most ``most`` sets and ``most_shingles`` shingles is compared in one task.  The sets of a larger one first meet
    ``pivots`` sets of it.  What is linked to one pivot is connected, and pieces that share a set are one: within a piece nothing is left
    to find.  The other pairs, of sets that are in no piece or in different ones, are compared in blocks; blocks whose sizes rule out a link never meet.
    """
    total = stored(members.groupBy("component").agg(F.count("*").alias("all"), F.sum("n").alias("sum")), "groups")
    heavy = (F.col("all") > most) | (F.col("sum") > most_shingles)
    own = rows.select("row", "text")
    if members.count() <= FEW_ROWS:
        own = own.join(F.broadcast(members.select("row")), "row", "left_semi")
    sets = stored(resolved(own.join(members.join(total, "component").select("node", "row", "component", heavy.alias("heavy")), "row"), size), "sets")
    dealt = sets.where("NOT heavy").select(F.col("component").alias("group"), "node", "set")
    parts = total.where(heavy).select("component", F.ceil(F.greatest(F.col("all") / most, F.col("sum") / most_shingles)).cast("int").alias("parts"))
    edges = None
    if not parts.isEmpty():
        large = stored(sets.where("heavy").dropDuplicates(["node"]), "large-sets")
        met = stored(pivoted(large, parts, percent, pivots), "pivots")
        edges = met.select(F.col("node").alias("a"), F.explode("linked").alias("b"))
        pieces = stored(joined_masks(met.select("component", "mask")), "pieces")
        kind = F.floor(F.log("n") / np.log(100 / percent) + 1e-9).cast("int")
        placed = stored(large.select("node", "component", "n", kind.alias("c")).join(met.select("node", "component", "mask"), ["node", "component"]).join(pieces, ["component", "mask"]).select("node", "component", "n", "c", F.col("piece").alias("q")), "placed")
        per = placed.groupBy("component", "c", "q").agg(F.ceil(F.greatest(F.count("*") / (most / 2), F.sum("n") / (most_shingles / 2))).cast("long").alias("b"))
        blocks = stored(per.groupBy("component").agg(F.collect_list(F.struct("c", "q", "b")).alias("blocks")), "blocks")
        own = "named_struct('c', c, 'q', q, 'i', pmod(xxhash64(node), element_at(filter(blocks, x -> x.c = c AND x.q = q), 1).b))"
        meets = f"""flatten(transform(filter(blocks, x -> abs(x.c - c) <= 1 AND (x.q <> q OR q < 0)),
            x -> transform(sequence(0L, x.b - 1), j -> array_sort(array({own}, named_struct('c', x.c, 'q', x.q, 'i', j))))))"""
        placed = placed.join(blocks, "component").select("node", "component", F.explode(F.expr(meets)).alias("m"))
        pairs = placed.join(large.select("node", "component", "set"), ["node", "component"])
        dealt = dealt.unionByName(pairs.select(F.md5(F.concat("component", F.to_json("m").cast("binary"))).cast("binary").alias("group"), "node", "set"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, {}

        def close() -> list[tuple[bytes, bytes]]:
            nodes = sorted(held)
            return [(nodes[x], nodes[y]) for x, y in linked([np.frombuffer(held[k], np.uint64) for k in nodes], percent)] if len(nodes) > 1 else []

        for batch in batches:
            out = []
            for group, node, raw in zip(batch.column("group").to_pylist(), batch.column("node").to_pylist(), batch.column("set").to_pylist(), strict=True):
                if group != last:
                    out += close()
                    last, held = group, {}
                held[node] = raw
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*out, strict=True)], ["a", "b"])
        if out := close():
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*out, strict=True)], ["a", "b"])

    found = dealt.repartition("group").sortWithinPartitions("group").mapInArrow(compare, "a binary, b binary")
    return found if edges is None else found.unionByName(edges)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row, and ``_row``, the hash of id and text.

    Documents are linked whose sets of ``size``-word shingles have a similarity of ``percent`` or more.  Texts without
    words, null or empty, have no shingle and are linked with nothing.  A component's id is its smallest
    id that isn't null; rows that repeat that id are all kept.  A text may be of any length; an empty table gives an
    empty result; further columns aren't read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_key(F.col(id_col), F.col(text_col)).alias("row"))
    signed = stored(signatures(rows, size), "signatures")
    nodes = signed.where("n > 0").groupBy("node").agg(F.min("id").alias("first"), F.min(F.struct("row", "n", "keys", "bands")).alias("s")).select("node", "first", "s.*")
    nodes = stored(nodes, "nodes")
    grouped = components(candidates(nodes))
    members = stored(nodes.select("node", "row", "n").join(grouped, "node"), "members")
    final = components(verified(members, rows, size, percent), forests=True)
    named = nodes.select("node", "first").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(smallest, "component").select("node", "component_id")
    out = signed.select("id", "row", "n", "node").join(named, "node", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), F.col("row").alias("_row"))
