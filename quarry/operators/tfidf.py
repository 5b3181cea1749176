"""A TF-IDF index in long form: terms, weights and norms are tables, never a matrix.

``weight = count * (ln((1 + N) / (1 + df)) + 1)``; vectors are compared by cosine.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import terms

VOCABULARY = 50_000
#: Chunk ids that several rows share, and terms of queries, up to which they are sent to every task.
FEW = 100_000


class Index(NamedTuple):
    """``postings(chunk_id, term, weight)``, ``vocabulary(term, df, cf, idf)``, ``norms(chunk_id, norm)``."""

    postings: DataFrame
    vocabulary: DataFrame
    norms: DataFrame


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def counted_terms(text: Column) -> Column:
    """The distinct terms of a text with their counts, as ``array<struct<term, count>>``: the runs of its sorted terms."""

    def runs(words: Column) -> Column:
        n = F.size(words)
        places = F.slice(F.sequence(F.lit(0), n), F.lit(1), n)
        first = F.filter(places, lambda i: ~F.get(words, i).eqNullSafe(F.get(words, i - 1)))
        count = lambda starts, at, k: (F.coalesce(F.get(starts, k + 1), n) - at).cast("long")
        return let(first, lambda starts: F.transform(starts, lambda at, k: F.struct(F.get(words, at).alias("term"), count(starts, at, k).alias("count"))))

    return let(F.sort_array(terms(text)), runs)


def counts(chunks: DataFrame) -> DataFrame:
    """``chunk_id, term, count`` of ``chunk_id, text``.

    Each text is counted where it lies.  Only rows that share their id have to meet, and only their counts are shuffled; the ids
    are counted first, and if too many are shared to be sent to every task, all counts are.
    """
    each = lambda rows: rows.select("chunk_id", F.inline(counted_terms(F.col("text"))))
    shared = chunks.groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("chunk_id").alias("_id"))
    n = shared.limit(FEW + 1).count()
    if not n:
        return each(chunks)
    among = lambda how: chunks.join(F.broadcast(shared), F.col("chunk_id").eqNullSafe(F.col("_id")), how)
    met = each(among("left_semi") if n <= FEW else chunks).groupBy("chunk_id", "term").agg(F.sum("count").alias("count"))
    return each(among("left_anti")).unionByName(met) if n <= FEW else met


def inverse(n: Column, df: Column) -> Column:
    return F.log((1 + n).cast("double") / (1 + df).cast("double")) + 1


def vocabulary(counted: DataFrame, n: DataFrame, most: int = VOCABULARY) -> DataFrame:
    """The ``most`` most frequent terms (ties by term) with their frequencies; ``n`` is the one-row number of chunks."""
    every = counted.groupBy("term").agg(F.count("*").alias("df"), F.sum("count").alias("cf"))
    top = every.orderBy(F.desc("cf"), "term").limit(most)
    return top.join(F.broadcast(n)).withColumn("idf", inverse(F.col("n"), F.col("df"))).drop("n")


def fit(chunks: DataFrame, most: int = VOCABULARY) -> Index:
    """The index of ``chunk_id, text``.  The vocabulary is capped, which bounds what the joins with it may broadcast.

    The hint is the table's own, so that the queries' terms meet the vocabulary that is sent to the postings, not one made again.
    """
    counted = counts(chunks)
    words = vocabulary(counted, chunks.agg(F.count("*").alias("n")), most)
    words = F.broadcast(words) if most <= VOCABULARY else words
    postings = counted.join(words, "term").select("chunk_id", "term", (F.col("count") * F.col("idf")).alias("weight"))
    norms = postings.groupBy("chunk_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return Index(postings, words, norms)


def query_vectors(queries: DataFrame, words: DataFrame) -> DataFrame:
    """``variant_id, term, q`` (unit vectors) of ``variant_id, text``; unknown terms count for nothing."""
    counted = queries.select("variant_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("variant_id", "term").agg(F.count("*").alias("count"))
    own = counted.join(words, "term").withColumn("q", F.col("count") * F.col("idf"))
    size = own.groupBy("variant_id").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("size"))
    return own.join(size, "variant_id").select("variant_id", "term", (F.col("q") / F.col("size")).alias("q"))


def scores(index: Index, queries: DataFrame) -> DataFrame:
    """``variant_id, chunk_id, score`` for the chunks that share a term with the variant; one pass for all variants.

    The query vectors are sent round if their terms, which are counted, are few; the postings stay where they are.
    """
    asked = query_vectors(queries, index.vocabulary)
    few = queries.select(F.explode(terms(F.col("text")))).limit(FEW + 1).count() <= FEW
    hits = index.postings.join(F.broadcast(asked) if few else asked, "term")
    dots = hits.groupBy("variant_id", "chunk_id").agg(F.sum(F.col("q") * F.col("weight")).alias("dot"))
    return dots.join(index.norms, "chunk_id").select("variant_id", "chunk_id", (F.col("dot") / F.col("norm")).alias("score"))
