"""Building an index and asking it: the whole path from folders to cited answers.

Everything up to the evidence is one lazy plan.  Models stand at its edges as plain callables: a paraphraser and
an answerer run on the driver, once a question; a verifier is called once a file.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import chunking, ranking, tfidf, vector
from quarry.sources import files
from quarry.sources.config import IndexMissing, ModelMissing, Settings

log = logging.getLogger(__name__)
NOTHING = "Nothing relevant was found."


@dataclass(frozen=True)
class Models:
    """What may be plugged in; each part has an offline stand-in.

    ``paraphrase(question, n)`` gives lines, ``verify(question, text)`` an answer that begins with the affirmative or not,
    ``answer(question, evidence)`` a text, ``reformat(text)`` a rewritten page, ``embed(texts)`` unit vectors.
    """

    paraphrase: Callable[[str, int], str] | None = None
    verify: Callable[[str, str], str] | None = None
    answer: Callable[[str, list[dict]], str] | None = None
    reformat: Callable[[str], str] | None = None
    embed: Callable[[list[str]], list[list[float]]] | None = None
    synonyms: dict[str, list[str]] = field(default_factory=dict)


class Metrics(NamedTuple):
    files_ok: int
    files_skipped: int
    chunks: int


def reformatted(documents: DataFrame, reformat: Callable[[str], str]) -> DataFrame:
    """Documents rewritten by a model where that kept every exact token; errors leave the page as it was."""

    def each(batches):
        for pdf in batches:
            out = []
            for t in pdf["text"]:
                try:
                    out.append(reformat(t) if t and t.strip() else None)
                except Exception:  # the raw page stands
                    out.append(None)
            yield pdf.assign(rewritten=out)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in documents.schema)
    rewritten = documents.mapInPandas(each, f"{fields}, rewritten string")
    return rewritten.withColumn("text", T.guarded(F.col("text"), F.col("rewritten"))).drop("rewritten")


def embedding(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = 32) -> DataFrame:
    """``chunk_id, embedding``; the model is called with ``batch`` texts at a time."""

    def each(batches):
        import pandas as pd

        for pdf in batches:
            texts = list(pdf["text"])
            vectors = [v for s in range(0, len(texts), batch) for v in embed(texts[s : s + batch])]
            yield pd.DataFrame({"chunk_id": pdf["chunk_id"], "embedding": vectors})

    return chunks.select("chunk_id", "text").mapInPandas(each, "chunk_id long, embedding array<float>")


def documents(spark: SparkSession, settings: Settings, models: Models, parse: files.Parser | None) -> tuple[DataFrame, DataFrame]:
    """All documents of the folders, and the list of files; unreadable files have no document."""
    docs = files.markdown(spark, settings.folders)
    if parse:
        pages = files.pdf_documents(files.pdf_pages(spark, settings.folders, parse))
        if settings.reformat and models.reformat:
            pages = reformatted(pages, models.reformat)
        docs = docs.unionByName(pages)
    return docs, files.listing(spark, settings.folders)


def build(spark: SparkSession, settings: Settings, models: Models = Models(), parse: files.Parser | None = None) -> Metrics | None:
    """Writes the index as Parquet tables below ``settings.index``; without any chunk nothing is written and None returned."""
    docs, listed = documents(spark, settings, models, parse)
    chunks = chunking.with_ids(chunking.chunked(docs, settings.chunk_size, settings.chunk_overlap))
    at = settings.index.rstrip("/")
    chunks = chunks.select("chunk_id", "source", "page", "knowledge_base", "chunk_no", "text")
    if chunks.isEmpty():
        log.warning("no chunk in %s; no index is written", settings.folders)
        return None
    chunks.write.mode("overwrite").parquet(f"{at}/chunks")
    index_chunks(spark, at, models)
    per = spark.read.parquet(f"{at}/chunks").groupBy(F.col("source").alias("path")).agg(F.count("*").alias("n"))
    got = listed.select("path").distinct().join(per, "path", "left").agg(F.count("n"), F.count_if(F.col("n").isNull()), F.coalesce(F.sum("n"), F.lit(0))).head()
    return Metrics(*got)


def index_chunks(spark: SparkSession, at: str, models: Models) -> None:
    """(Re)builds the index tables of the chunks that lie at ``at``."""
    chunks = spark.read.parquet(f"{at}/chunks")
    index = tfidf.fit(chunks.select("chunk_id", "text"))
    index.vocabulary.write.mode("overwrite").parquet(f"{at}/vocabulary")
    index.postings.write.mode("overwrite").parquet(f"{at}/postings")
    postings = spark.read.parquet(f"{at}/postings")
    postings.groupBy("chunk_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm")).write.mode("overwrite").parquet(f"{at}/norms")
    if models.embed:
        embedding(chunks, models.embed).write.mode("overwrite").parquet(f"{at}/embeddings")


def append(spark: SparkSession, at: str, docs: DataFrame, settings: Settings, models: Models = Models()) -> int:
    """Adds documents' chunks (and vectors) to an index; the lexical tables wait for ``index_chunks``.

    Each table gets the rows that it lacks, so a call that was broken off between them is made whole by the next.
    """
    chunks = chunking.with_ids(chunking.chunked(docs, settings.chunk_size, settings.chunk_overlap)).select("chunk_id", "source", "page", "knowledge_base", "chunk_no", "text")

    def lacking(name: str) -> DataFrame:
        return chunks.join(spark.read.parquet(f"{at}/{name}").select("chunk_id"), "chunk_id", "left_anti") if files.exists(spark, f"{at}/{name}/_SUCCESS") else chunks

    if models.embed and not (new := lacking("embeddings")).isEmpty():
        embedding(new, models.embed).write.mode("append").parquet(f"{at}/embeddings")
    if n := (new := lacking("chunks")).count():
        new.write.mode("append").parquet(f"{at}/chunks")
    return n


class Opened(NamedTuple):
    chunks: DataFrame
    index: tfidf.Index
    embeddings: DataFrame | None


def opened(spark: SparkSession, at: str) -> Opened:
    at = at.rstrip("/")
    if not files.exists(spark, f"{at}/postings"):
        raise IndexMissing(f"no index at {at}: run build first")
    read = lambda name: spark.read.parquet(f"{at}/{name}")
    vectors = read("embeddings") if files.exists(spark, f"{at}/embeddings") else None
    return Opened(read("chunks"), tfidf.Index(read("postings"), read("vocabulary"), read("norms")), vectors)


def synonym_variant(question: str, synonyms: dict[str, list[str]]) -> list[str]:
    """The question with the synonyms of all dictionary terms in it, or nothing."""
    found = [s for term, others in synonyms.items() if term.lower() in question.lower() for s in others]
    return [" ".join([question, *found])] if found else []


def variants(question: str, settings: Settings, models: Models) -> list[str]:
    """The question, its synonym variant, then its paraphrases; a paraphraser's error costs its variants only."""
    out = [question, *synonym_variant(question, models.synonyms)]
    if models.paraphrase and settings.paraphrases > 0:
        try:
            lines = (models.paraphrase(question, settings.paraphrases) or "").split("\n")
            out += [x.strip("- ") for x in lines if x.strip()][: settings.paraphrases]
        except Exception as e:
            log.warning("paraphrasing failed: %s", type(e).__name__)
    return out


def retrieve(spark: SparkSession, index: Opened, questions: list[str], settings: Settings, models: Models) -> DataFrame:
    """The positive top hits of all variants at once, with their chunks."""
    asked = spark.createDataFrame(list(enumerate(questions)), "variant_id int, text string")
    lexical = tfidf.scores(index.index, asked)
    semantic = None
    if index.embeddings is not None and models.embed:
        vectors = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(models.embed(questions))], "variant_id int, query array<float>")
        semantic = vector.scores(index.embeddings, vectors)
    mixed = ranking.blended(lexical, semantic, index.chunks, asked, settings.alpha)
    return ranking.top(mixed, settings.candidates).join(index.chunks, "chunk_id")


class Checked(NamedTuple):
    evidence: list[dict]
    answer: str | None


def check(spark: SparkSession, settings: Settings, question: str, models: Models = Models()) -> Checked:
    """Files whose evidence the verifier confirms, and a cited answer.

    No candidates or nothing confirmed gives no evidence and no answer.  A verifier's error passes its file over; without a verifier
    every file counts.  An answerer's error is told in the answer, and the evidence stands.
    """
    index = opened(spark, settings.index)
    grouped = ranking.contexts(ranking.top_per_file(retrieve(spark, index, variants(question, settings, models), settings, models), settings.chunks_per_file))
    rows = grouped.orderBy(F.desc("score"), "source").collect()  # at most candidates x variants files
    confirmed = []
    for r in rows:
        if models.verify:
            try:
                if not models.verify(question, r["text"]).strip().upper().startswith("YA"):
                    continue
            except Exception as e:
                log.warning("%s wasn't verified: %s", r["source"], type(e).__name__)
                continue
        confirmed.append({"file": r["source"].rsplit("/", 1)[-1], "knowledge_base": r["knowledge_base"] or "unknown", "score": round(r["score"], 4), "chunk_count": r["chunk_count"], "text": r["text"]})
    if not confirmed:
        return Checked([], None)
    if not models.answer:
        return Checked(confirmed, None)
    try:
        return Checked(confirmed, models.answer(question, confirmed))
    except Exception as e:
        return Checked(confirmed, f"[ERROR] {type(e).__name__}: {e}")


def ask(spark: SparkSession, settings: Settings, question: str, models: Models) -> tuple[str, list[str]]:
    """An answer straight from the nearest chunks by vector, and the sorted labels of their sources."""
    index = opened(spark, settings.index)
    if index.embeddings is None or not models.embed or not models.answer:
        raise ModelMissing("asking needs an index with embeddings, an embedder and an answerer")
    query = spark.createDataFrame([(0, [float(x) for x in models.embed([question])[0]])], "variant_id int, query array<float>")
    near = vector.nearest(vector.scores(index.embeddings, query), settings.nearest).join(index.chunks, "chunk_id")
    rows = near.orderBy(F.desc(F.round("score", 9)), "chunk_id").select("text", "knowledge_base", "source", T.source_label(F.col("knowledge_base"), F.col("source")).alias("label")).collect()
    if not rows:
        return NOTHING, []
    try:
        return models.answer(question, [{"text": r["text"], "knowledge_base": r["knowledge_base"], "file": r["source"]} for r in rows]), sorted({r["label"] for r in rows})
    except Exception as e:
        return f"[ERROR] {type(e).__name__}: {e}", []


def report(spark: SparkSession, settings: Settings, question: str, keyword: str, to: str, models: Models = Models(), most: int = 5) -> DataFrame:
    """Writes the overall ranks of the first ``most`` chunks from files whose path has ``keyword`` as text lines."""
    index = opened(spark, settings.index)
    asked = spark.createDataFrame([(0, question)], "variant_id int, text string")
    ranked = ranking.overall_rank(ranking.blended(tfidf.scores(index.index, asked), None, index.chunks, asked)).join(index.chunks, "chunk_id")
    first = ranked.where(F.contains(F.lower("source"), F.lit(keyword.lower()))).orderBy("rank").limit(most)
    lines = first.select(F.format_string("rank %d | score %.4f | %s | page %s | %s", "rank", "score", T.file_name(F.col("source")), F.coalesce(F.col("page").cast("string"), F.lit("-")), F.substring("text", 1, 600)).alias("value"))
    lines.coalesce(1).write.mode("overwrite").text(to)
    return lines
