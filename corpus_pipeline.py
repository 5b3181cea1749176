"""From raw documents to packed training sequences, stage by stage.

Each stage takes what its predecessor kept, written as Parquet and read again.  All but the last
return the columns of ``documents``.  Rows are told apart by id and text together, so ids that repeat do no harm.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import row_key, stored
from quarry.llm.decontaminate import contaminated
from quarry.llm.near_dups import near_duplicates
from quarry.llm.packing import best_fit_packing
from quarry.llm.quality_rules import quality_rules
from quarry.llm.suffix_dedup import kept_texts
from quarry.session import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SQL expresses neither the estimates of the first stage nor the packing.
ORACLE_SQL = None


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS, row_key(F.col("doc_id"), F.col("text")).alias("_row"))


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` but for those named in ``rows``, which are the fewer."""
    return docs.join(rows.distinct(), "_row", "left_anti").select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    docs = keyed(docs)
    judged = quality_rules(docs, id_col="_row")
    return without(docs, judged.where("NOT kept").select(F.col("doc_id").alias("_row")))


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, by five-word shingles, the document with the smallest id stays; rows that repeat it wholly stay with it."""
    docs = keyed(docs)
    found = near_duplicates(docs, size=5, percent=80)
    return without(docs, found.where("NOT kept").select("_row"))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes and more that repeat go from the texts, and so do repeated passages of over 50 words, which mostly have fewer bytes; halves of characters at a cut go with them."""
    left = kept_texts(docs.select(*COLUMNS), words=51, passages_go=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("doc.text"))
    return left.select("doc.doc_id", text.alias("text"), "doc.lang", "doc.source", F.length(F.coalesce(text, F.lit(""))).cast("long").alias("n_chars"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    docs = keyed(docs)
    found = contaminated(docs, table(spark, sf_dir, "benchmark"), id_col="_row")
    return without(docs, found.select(F.col("doc_id").alias("_row")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences."""
    return best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("near-duplicates", near_dups), ("repeated strings", repeats), ("decontamination", decontaminate), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
