"""Rescaling, blending, top-k and grouping of retrieval scores.

Ranks go by ``round(score, 9)`` and then by chunk, so they don't hang on the order of a sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TINY = 1e-9
#: Variants up to which their extremes (three numbers each) are sent to every task.
FEW_VARIANTS = 10_000


def rescaled(scored: DataFrame, column: str = "score", by: str = "variant_id", few: bool = False) -> DataFrame:
    """``column`` brought to 0..1 for each variant over the whole corpus; all 0 where they don't differ.

    The extremes are aggregated and joined back: a window would bring all rows of a variant to one task.  With ``few`` variants,
    which the caller has counted, they are sent to every task and no row moves.
    """
    ends = scored.groupBy(by).agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    span = F.col("_high") - F.col("_low")
    value = F.when(span < TINY, 0.0).otherwise((F.col(column) - F.col("_low")) / span)
    return scored.join(F.broadcast(ends) if few else ends, by).withColumn(column, value).drop("_low", "_high")


def order(score: str = "score") -> tuple[Column, Column]:
    return F.desc(F.round(score, 9)), F.col("chunk_id").asc()


def top(scored: DataFrame, k: int, by: str = "variant_id") -> DataFrame:
    """The ``k`` best positive chunks of each variant with their ``rank``."""
    ranked = scored.where(F.col("score") > 0).withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order())))
    return ranked.where(F.col("rank") <= k)


def blended(lexical: DataFrame, semantic: DataFrame | None, chunks: DataFrame, variants: DataFrame, alpha: float = 0.5) -> DataFrame:
    """``variant_id, chunk_id, score``: both scores rescaled over the same chunks, then mixed.

    Chunks without a common term score 0 before rescaling.  Without semantic scores the lexical ones stand alone.
    """
    every = semantic.select("variant_id", "chunk_id", F.col("score").alias("semantic")) if semantic is not None else chunks.select("chunk_id").crossJoin(F.broadcast(variants.select("variant_id")))
    both = every.join(lexical.select("variant_id", "chunk_id", F.col("score").alias("lexical")), ["variant_id", "chunk_id"], "left").fillna({"lexical": 0.0})
    few = variants.limit(FEW_VARIANTS + 1).count() <= FEW_VARIANTS
    both = rescaled(both, "lexical", few=few)
    if semantic is None:
        return both.select("variant_id", "chunk_id", F.col("lexical").alias("score"))
    both = rescaled(both, "semantic", few=few)
    return both.select("variant_id", "chunk_id", (alpha * F.col("lexical") + (1 - alpha) * F.col("semantic")).alias("score"))


def best_per_file(hits: DataFrame) -> DataFrame:
    """The best hit of each source; of equals the earliest (variant, then rank)."""
    w = Window.partitionBy("source").orderBy(F.desc(F.round("score", 9)), "variant_id", "rank")
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def top_per_file(hits: DataFrame, n: int = 3) -> DataFrame:
    """Of each source the ``n`` best different chunks, numbered by score as ``best`` and in page order as ``place``.

    A chunk found by several variants counts once, with its best score; a missing page differs from page 0 but sorts with it.
    """
    once = hits.groupBy("source", "page", "text").agg(F.max("score").alias("score"), F.min("chunk_id").alias("chunk_id"), F.min("knowledge_base").alias("knowledge_base"))
    ranked = once.withColumn("best", F.row_number().over(Window.partitionBy("source").orderBy(*order()))).where(F.col("best") <= n)
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(F.coalesce("page", F.lit(0)), "best")))


def contexts(grouped: DataFrame, separator: str = "\n\n---\n\n") -> DataFrame:
    """``source, knowledge_base, score, chunk_count, text`` of each source's chosen chunks, joined in page order."""
    parts = F.array_sort(F.collect_list(F.struct("place", "text")))
    return grouped.groupBy("source").agg(
        F.min("knowledge_base").alias("knowledge_base"), F.max("score").alias("score"), F.count("*").alias("chunk_count"),
        F.array_join(F.transform(parts, lambda p: p["text"]), separator).alias("text"),
    )


def overall_rank(scored: DataFrame, fine: int = 2048) -> DataFrame:
    """Every chunk's 1-based ``rank`` in its variant's list, for probes.

    A global rank without a global sort: a row is ranked within its slot, by what stands in the slots before.  A slot is a range of
    scores, and for a score of 0, which many chunks may have, a range of chunk ids; so it hangs on the row alone.
    """
    ends = scored.agg(F.min("chunk_id").alias("_first"), F.max("chunk_id").alias("_last"))
    share = (F.col("chunk_id").cast("double") - F.col("_first")) / (F.col("_last").cast("double") - F.col("_first") + 1)
    value = F.round("score", 9)
    slot = F.struct((-F.floor(value * fine)).alias("a"), F.when(value == 0, F.floor(share * fine)).otherwise(F.when(value < 0, fine).otherwise(-1)).alias("b"))
    rows = scored.crossJoin(F.broadcast(ends)).withColumn("_slot", slot).drop("_first", "_last")
    sizes = rows.groupBy("variant_id", "_slot").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy("variant_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.withColumn("_before", before).drop("_size")
    ranked = rows.withColumn("_in", F.row_number().over(Window.partitionBy("variant_id", "_slot").orderBy(*order())))
    return ranked.join(offsets, ["variant_id", "_slot"]).withColumn("rank", F.col("_in") + F.col("_before")).drop("_slot", "_in", "_before")
