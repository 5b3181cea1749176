"""The operators' registered queries, each over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import table


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.packing import best_fit_packing

    return best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.html_text import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.chat import chat_format

    return chat_format(table(spark, sf_dir, "conversations"))


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.quality_model import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.near_dups import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), size=2).drop("_row")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.suffix_dedup import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents"))


def chat_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 9 over tool calls: the driver's conversations have none, so each user turn is told as a call, with results, references and flaws."""
    from quarry.llm.chat import chat_format
    from quarry.llm.oracle import CALLS

    turns = table(spark, sf_dir, "conversations").where("role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL").selectExpr("conv_id", "CAST(turn AS INT) AS t").distinct()
    turns.createOrReplaceTempView("chat_call_turns")
    return chat_format(spark.sql(CALLS.format(turns="chat_call_turns")))


def packing_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of operator 3's result: every document is there once and whole, every sequence gapless and no longer than allowed."""
    got = op3_best_fit_packing(spark, sf_dir)
    ends = got.groupBy("sequence_id").agg(F.sum("length").alias("used"), F.max(F.col("offset") + F.col("length")).alias("end"), F.count_distinct("offset").alias("starts"), F.count("*").alias("pieces"))
    bad = ends.agg(F.count_if((F.col("used") != F.col("end")) | (F.col("starts") != F.col("pieces")) | (F.col("used") > 2048)).alias("bad_sequences"))
    whole = got.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max(F.col("start") + F.col("length")).alias("end"), F.count("*").alias("pieces"), F.max("piece").alias("last"))
    return whole.agg(F.count("*").alias("documents"), F.count_if((F.col("n") != F.col("end")) | (F.col("last") != F.col("pieces") - 1) | (F.col("n") < 1)).alias("bad_documents")).crossJoin(bad)


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()} | {"chat_calls": chat_calls, "packing_rules": packing_rules}


def oracle_sql() -> dict[str, str]:
    from quarry.llm.oracle import SQL

    return dict(SQL)
