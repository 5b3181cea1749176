"""Exact nearest neighbours of unit vectors by dot product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    wide = "array<double>"
    return F.aggregate(F.zip_with(a.cast(wide), b.cast(wide), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def scores(chunks: DataFrame, queries: DataFrame, held: int = 1000) -> DataFrame:
    """``variant_id, chunk_id, score`` of every chunk for every query vector (``variant_id, query``).

    Queries are a stated set.  Up to ``held`` of them, counted first, are sent to every task, so the chunks (``chunk_id,
    embedding``) are scanned where they lie; of more, Spark deals out the pairs.
    """
    few = queries.count() <= held
    return chunks.crossJoin(F.broadcast(queries) if few else queries).select("variant_id", "chunk_id", dot(F.col("embedding"), F.col("query")).alias("score"))


def nearest(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` best chunks of a single query, ties by chunk."""
    return scored.orderBy(F.desc(F.round("score", 9)), "chunk_id").limit(k)
