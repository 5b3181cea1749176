"""Screening of names: edit distance of sorted tokens, or shared tokens, whichever is higher."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import edit_similarity, name_tokens, sorted_name, token_similarity

#: Screening names that a task may hold; with a longer list, best matches are found by keys instead of all pairs.
HELD = 20_000


def names(people: DataFrame, list_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct spellings of both sides with tokens and sorted form; scores depend on nothing else."""
    shaped = lambda df, p: df.where(F.col("name").isNotNull()).select("name").distinct().select(F.col("name").alias(f"{p}_name"), name_tokens(F.col("name")).alias(f"{p}_tokens"), sorted_name(F.col("name")).alias(f"{p}_sorted"))
    return shaped(people, "a"), shaped(list_, "b")


def pair_scores() -> tuple[Column, Column]:
    return edit_similarity(F.col("a_sorted"), F.col("b_sorted")).alias("similarity"), token_similarity(F.col("a_tokens"), F.col("b_tokens")).alias("jaccard")


def all_pairs(people: DataFrame, list_: DataFrame) -> DataFrame:
    """``a_name, b_name, similarity, jaccard`` for every pair of spellings; the list is sent round only if it is short."""
    a, b = names(people, list_)
    short = b.count() <= HELD
    b = F.broadcast(b) if short else b
    return a.repartition("a_name").crossJoin(b).select("a_name", "b_name", *pair_scores())


def likely_pairs(people: DataFrame, list_: DataFrame, threshold: float) -> DataFrame:
    """The pairs that can reach ``threshold``, by keys instead of a cross join.

    An edit similarity of t needs lengths l and m with ``min >= t * max``: join on the length, spread over the lengths it can meet.
    A token similarity of t needs a common token among the rarest ``n - ceil(t n) + 1`` distinct tokens of either side.
    """
    a, b = names(people, list_)
    slack = 1e-9
    lengths = F.sequence(F.ceil(F.length("a_sorted") * threshold - slack).cast("int"), F.floor(F.length("a_sorted") / threshold + slack).cast("int"))
    by_length = a.withColumn("_k", F.explode(lengths)).join(b.withColumn("_k", F.length("b_sorted")), "_k").select("a_name", "b_name")
    tokens = a.select(F.explode(F.array_distinct("a_tokens")).alias("t")).unionByName(b.select(F.explode(F.array_distinct("b_tokens")).alias("t")))
    frequency = tokens.groupBy("t").agg(F.count("*").alias("f"))

    def rare(df: DataFrame, p: str) -> DataFrame:
        rows = df.select(f"{p}_name", F.explode(F.array_distinct(f"{p}_tokens")).alias("t"), F.size(F.array_distinct(f"{p}_tokens")).alias("n")).join(frequency, "t")
        w = Window.partitionBy(f"{p}_name").orderBy("f", "t")
        return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= F.col("n") - F.ceil(F.col("n") * threshold - slack) + 1).select(f"{p}_name", "t")

    by_token = rare(a, "a").join(rare(b, "b"), "t").select("a_name", "b_name")
    pairs = by_length.unionByName(by_token).distinct()
    return pairs.join(a, "a_name").join(b, "b_name").select("a_name", "b_name", *pair_scores())


def best_matches(people: DataFrame, list_: DataFrame, threshold: float = 0.85, pruned: bool = False) -> DataFrame:
    """``customerid, customername, screening_name, best_score``: each customer's best match of ``threshold`` or more.

    ``people`` and ``list_`` have ``id, name``; names may be null and then match nothing.  Ties go to the smallest screening id.
    The threshold is applied before ranking, which keeps the same first row.
    """
    pruned = pruned or list_.select("name").distinct().count() > HELD
    pairs = likely_pairs(people, list_, threshold) if pruned else all_pairs(people, list_)
    best = pairs.withColumn("best_score", F.greatest("similarity", "jaccard")).where(F.col("best_score") >= threshold)
    first = list_.groupBy(F.col("name").alias("b_name")).agg(F.min("id").alias("screening_id"))
    w = Window.partitionBy("a_name").orderBy(F.desc("best_score"), "screening_id")
    chosen = best.join(first, "b_name").withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return people.join(chosen, people["name"] == chosen["a_name"]).select(F.col("id").alias("customerid"), F.col("name").alias("customername"), F.col("b_name").alias("screening_name"), "best_score")


def token_matches(people: DataFrame, list_: DataFrame) -> DataFrame:
    """``customerid, screening_id, matched``: distinct common tokens for each pair of ids that has some.

    Joined on the token; rows that share an id count together.
    """
    side = lambda df, name: df.where(F.col("name").isNotNull()).select(F.col("id").alias(name), F.explode(F.array_distinct(name_tokens(F.col("name")))).alias("token")).distinct()
    return side(people, "customerid").join(side(list_, "screening_id"), "token").groupBy("customerid", "screening_id").agg(F.count("*").alias("matched"))
