"""Connected components by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stored


class Forest:
    """Union-find with the smallest node as root."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while (y := up.get(x, x)) != top:
            up[x], x = top, y
        return top

    def join(self, x, y) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def contracted(edges: DataFrame) -> DataFrame:
    """Each task's edges as stars around the smallest node it knows; batches bound the memory."""
    kind = edges.schema["a"].dataType.simpleString()

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forest = Forest()
            for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                forest.join(x, y)
            nodes = list(forest.up)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, batch.column("a").type), pa.array(map(forest.root, nodes), batch.column("a").type)], ["a", "b"])

    return edges.mapInArrow(stars, f"a {kind}, b {kind}")


def components(edges: DataFrame, forests: bool = False) -> DataFrame:
    """``node, component`` (the smallest node) for every node of the edges ``a, b``; no nodes without edges.

    ``forests`` says that the tasks' edges are forests already; contracting them would only cost each task a second Python worker.
    """
    edges = edges.where("a <> b").select("a", "b")
    edges = (edges if forests else contracted(edges)).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(edges, "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written, so that both sides of the join come straight from a shuffle: Spark then splits the rows of a large star's centre.
        low = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "lowest")
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        edges = stored(small.distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = now
