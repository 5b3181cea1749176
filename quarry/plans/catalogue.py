"""The registered queries over the driver's tables, each with its DuckDB SQL.

Documents stand for chunks, ``source`` for files, ``lang`` for knowledge bases and ``doc_id % 10`` for pages (none for 0);
``part`` names are screened against their own reversed spellings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import chunking, fuzzy, layout, ranking, tfidf, vector
from quarry.session import table

FLAGSHIP = "file_context_join"
#: Question and paraphrases; their numbers are also the query vectors' ids.
VARIANTS = [(0, "thing reason Ention erth the pour"), (1, "dans les nicht thing Herean"), (2, "thble ention und oder thand")]
SYNONYMS = [("thing", ["matter", "affair"]), ("the", ["that", "this"]), ("Nicht", ["kein"])]
ALPHA, CANDIDATES, PER_FILE = 0.5, 15, 3

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# --- inputs ---------------------------------------------------------------------------------------------------------


def chunks(spark: SparkSession, d: str) -> DataFrame:
    page = F.nullif(F.pmod(F.col("doc_id"), F.lit(10)), F.lit(0)).cast("int")
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "source", F.col("lang").alias("knowledge_base"), page.alias("page"))


def variants(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VARIANTS, "variant_id int, text string")


def embedded(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that have an embedding."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return chunks(spark, d).join(e, "chunk_id")


def query_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where(F.col("vec_id").isin([v for v, _ in VARIANTS])).select(F.col("vec_id").cast("int").alias("variant_id"), F.col("embedding").alias("query"))


_VALUES = ", ".join(f"({n}, '{t}')" for n, t in VARIANTS)
_CHUNKS = "chunks AS (SELECT doc_id AS chunk_id, text, source, lang AS knowledge_base, CAST(nullif(doc_id % 10, 0) AS INTEGER) AS page FROM documents)"
_VARIANTS = f"variants(variant_id, text) AS (VALUES {_VALUES})"


def _index(where: str = "chunks") -> str:
    """CTEs of the TF-IDF index over ``where``."""
    return f"""{_CHUNKS}, {_VARIANTS},
corpus AS ({'SELECT * FROM chunks' if where == 'chunks' else 'SELECT c.*, e.embedding FROM chunks c JOIN embeddings e ON e.vec_id = c.chunk_id'}),
tok AS (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM corpus),
tf AS (SELECT chunk_id, term, count(*) AS c FROM tok GROUP BY ALL),
vocab AS (SELECT term, df, cf, ln((1 + (SELECT count(*) FROM corpus))::DOUBLE / (1 + df)::DOUBLE) + 1 AS idf
  FROM (SELECT term, count(*) AS df, sum(c) AS cf FROM tf GROUP BY term) ORDER BY cf DESC, term LIMIT 50000),
post AS (SELECT chunk_id, term, c * idf AS weight FROM tf JOIN vocab USING (term)),
norms AS (SELECT chunk_id, sqrt(sum(weight * weight)) AS norm FROM post GROUP BY chunk_id),
q0 AS (SELECT variant_id, term, count(*) * any_value(idf) AS q FROM (SELECT variant_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM variants) JOIN vocab USING (term) GROUP BY variant_id, term),
q AS (SELECT variant_id, term, q / sqrt(sum(q * q) OVER (PARTITION BY variant_id)) AS q FROM q0),
lex AS (SELECT variant_id, chunk_id, sum(q * weight) / any_value(norm) AS score FROM post JOIN q USING (term) JOIN norms USING (chunk_id) GROUP BY variant_id, chunk_id)"""


_SEMANTIC = """qv AS (SELECT CAST(vec_id AS INTEGER) AS variant_id, embedding AS query FROM embeddings WHERE vec_id IN (0, 1, 2)),
sem AS (SELECT variant_id, chunk_id, list_dot_product(embedding::DOUBLE[], query::DOUBLE[]) AS score FROM corpus, qv)"""


def _hybrid(alpha: str = "0.5", extra: str = "") -> str:
    """CTEs down to ``hits``: the positive top of each variant."""
    scale = lambda c: f"CASE WHEN max({c}) OVER w - min({c}) OVER w < 1e-9 THEN 0 ELSE ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) END"
    return f"""{_index('embedded')}, {_SEMANTIC},
both_ AS (SELECT s.variant_id, s.chunk_id, s.score AS semantic, coalesce(l.score, 0) AS lexical FROM sem s LEFT JOIN lex l USING (variant_id, chunk_id)),
mixed AS (SELECT variant_id, chunk_id{extra}, {alpha} * ({scale('lexical')}) + (1 - {alpha}) * ({scale('semantic')}) AS score FROM both_ WINDOW w AS (PARTITION BY variant_id)),
hits AS (SELECT * FROM (SELECT m.*, c.source, c.page, c.text, c.knowledge_base, row_number() OVER (PARTITION BY variant_id ORDER BY round(score, 9) DESC, chunk_id) AS rank
  FROM mixed m JOIN corpus c USING (chunk_id) WHERE score > 0) WHERE rank <= {CANDIDATES})"""


_GROUPED = f"""once AS (SELECT source, page, text, max(score) AS score, min(chunk_id) AS chunk_id, min(knowledge_base) AS knowledge_base FROM hits GROUP BY source, page, text),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(score, 9) DESC, chunk_id) AS best FROM once) WHERE best <= {PER_FILE}),
grouped AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY coalesce(page, 0), best) AS place FROM best),
contexts AS (SELECT source, min(knowledge_base) AS knowledge_base, max(score) AS score, count(*) AS chunk_count, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place) AS text FROM grouped GROUP BY source)"""


def hybrid(spark: SparkSession, d: str, alpha: float = ALPHA) -> DataFrame:
    """Blended scores of every embedded chunk for every variant."""
    rows = embedded(spark, d)
    lexical = tfidf.scores(tfidf.fit(rows.select("chunk_id", "text")), variants(spark))
    semantic = vector.scores(rows.select("chunk_id", "embedding"), query_vectors(spark, d))
    return ranking.blended(lexical, semantic, rows, variants(spark), alpha)


def hits(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top(hybrid(spark, d), CANDIDATES).join(chunks(spark, d), "chunk_id")


def six(name: str = "score") -> Column:
    return F.round(name, 6).alias(name)


# --- lexical index --------------------------------------------------------------------------------------------------


@query("SELECT * FROM (WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM documents) SELECT count(*) AS tokens, count(DISTINCT term) AS terms, count(DISTINCT doc_id) AS chunks FROM t)")
def tfidf_df_stats(spark: SparkSession, d: str) -> DataFrame:
    counted = tfidf.counts(chunks(spark, d))
    per = counted.groupBy("term").agg(F.sum("count").alias("c"))
    ids = counted.select("chunk_id").distinct().agg(F.count("*").alias("chunks"))
    return per.agg(F.sum("c").cast("long").alias("tokens"), F.count("*").alias("terms")).crossJoin(ids)


@query(f"WITH {_index()} SELECT term, df, CAST(cf AS BIGINT) AS cf, round(idf, 6) AS idf FROM vocab")
def tfidf_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    index = tfidf.fit(chunks(spark, d))
    return index.vocabulary.select("term", "df", "cf", six("idf"))


@query(f"WITH {_index()} SELECT chunk_id, round(norm, 6) AS norm FROM norms")
def tfidf_norms(spark: SparkSession, d: str) -> DataFrame:
    return tfidf.fit(chunks(spark, d)).norms.select("chunk_id", six("norm"))


@query(f"WITH {_index()} SELECT chunk_id, round(score, 6) AS score FROM lex WHERE variant_id = 0 AND score > 0 ORDER BY round(score, 9) DESC, chunk_id LIMIT {CANDIDATES}")
def tfidf_topk(spark: SparkSession, d: str) -> DataFrame:
    index = tfidf.fit(chunks(spark, d))
    scored = tfidf.scores(index, variants(spark).where("variant_id = 0")).where("score > 0")
    return vector.nearest(scored, CANDIDATES).select("chunk_id", six())


@query(f"""WITH {_index()}, r AS (SELECT *, row_number() OVER (PARTITION BY variant_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM lex WHERE score > 0)
SELECT variant_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank <= {CANDIDATES}""")
def tfidf_topk_multi_variant(spark: SparkSession, d: str) -> DataFrame:
    index = tfidf.fit(chunks(spark, d))
    return ranking.top(tfidf.scores(index, variants(spark)), CANDIDATES).select("variant_id", "chunk_id", "rank", six())


# --- vectors, rescaling, blending -----------------------------------------------------------------------------------


@query("""SELECT vec_id AS chunk_id, round(list_dot_product(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 1)::DOUBLE[]), 6) AS score
FROM embeddings ORDER BY round(list_dot_product(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 1)::DOUBLE[]), 9) DESC, vec_id LIMIT 4""")
def knn_dot_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return vector.nearest(vector.scores(rows, query_vectors(spark, d).where("variant_id = 1")), 4).select("chunk_id", six())


@query(f"""WITH {_index('embedded')}, {_SEMANTIC}, r AS (SELECT *, row_number() OVER (PARTITION BY variant_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM sem)
SELECT variant_id, list_sort(list_distinct(list('[' || c.knowledge_base || '] ' || c.source))) AS sources FROM r JOIN corpus c USING (chunk_id) WHERE rank <= 4 GROUP BY variant_id""")
def knn_source_list(spark: SparkSession, d: str) -> DataFrame:
    rows = embedded(spark, d)
    near = ranking.top(vector.scores(rows, query_vectors(spark, d)), 4).join(rows.select("chunk_id", "source", "knowledge_base"), "chunk_id")
    return near.groupBy("variant_id").agg(F.array_sort(F.collect_set(T.source_label(F.col("knowledge_base"), F.col("source")))).alias("sources"))


@query(f"""WITH {_index('embedded')}, {_SEMANTIC} SELECT variant_id, chunk_id, round(CASE WHEN max(score) OVER w - min(score) OVER w < 1e-9 THEN 0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS score
FROM sem WINDOW w AS (PARTITION BY variant_id)""")
def minmax_scores(spark: SparkSession, d: str) -> DataFrame:
    return ranking.rescaled(vector.scores(embedded(spark, d), query_vectors(spark, d))).select("variant_id", "chunk_id", six())


@query(f"WITH {_hybrid()} SELECT variant_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM hits")
def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top(hybrid(spark, d), CANDIDATES).select("variant_id", "chunk_id", "rank", six())


_SWEEP = _hybrid("a.alpha").replace("FROM both_ WINDOW w AS (PARTITION BY variant_id)", "FROM both_, (VALUES (0.0::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) a(alpha) WINDOW w AS (PARTITION BY variant_id, alpha)").replace("SELECT variant_id, chunk_id, a.alpha *", "SELECT variant_id, chunk_id, a.alpha AS alpha, a.alpha *").replace("PARTITION BY variant_id ORDER BY", "PARTITION BY variant_id, alpha ORDER BY")


@query(f"WITH {_SWEEP} SELECT alpha, variant_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM hits")
def hybrid_alpha_sweep(spark: SparkSession, d: str) -> DataFrame:
    rows = embedded(spark, d)
    lexical = tfidf.scores(tfidf.fit(rows.select("chunk_id", "text")), variants(spark))
    semantic = vector.scores(rows.select("chunk_id", "embedding"), query_vectors(spark, d))
    parts = [ranking.top(ranking.blended(lexical, semantic, rows, variants(spark), a), CANDIDATES).withColumn("alpha", F.lit(a)) for a in (0.0, 0.5, 1.0)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("alpha", "variant_id", "chunk_id", "rank", six())


@query(f"""WITH {_index()}, grid AS (SELECT v.variant_id, c.chunk_id, coalesce(l.score, 0) AS score FROM corpus c CROSS JOIN variants v LEFT JOIN lex l ON l.variant_id = v.variant_id AND l.chunk_id = c.chunk_id),
m AS (SELECT variant_id, chunk_id, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-9 THEN 0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS score FROM grid WINDOW w AS (PARTITION BY variant_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY variant_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM m WHERE score > 0)
SELECT variant_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank <= {CANDIDATES}""")
def lexical_fallback_topk(spark: SparkSession, d: str) -> DataFrame:
    """What an index without embeddings answers."""
    rows = chunks(spark, d)
    lexical = tfidf.scores(tfidf.fit(rows), variants(spark))
    return ranking.top(ranking.blended(lexical, None, rows, variants(spark)), CANDIDATES).select("variant_id", "chunk_id", "rank", six())


# --- grouping -------------------------------------------------------------------------------------------------------


@query(f"WITH {_hybrid()}, b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(score, 9) DESC, variant_id, rank) AS n FROM hits) SELECT source, variant_id, chunk_id, round(score, 6) AS score FROM b WHERE n = 1")
def best_chunk_per_file(spark: SparkSession, d: str) -> DataFrame:
    return ranking.best_per_file(hits(spark, d)).select("source", "variant_id", "chunk_id", six())


@query(f"WITH {_hybrid()}, {_GROUPED} SELECT source, page, chunk_id, CAST(best AS INTEGER) AS best, CAST(place AS INTEGER) AS place, round(score, 6) AS score FROM grouped")
def top_chunks_per_file(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top_per_file(hits(spark, d), PER_FILE).select("source", "page", "chunk_id", "best", "place", six())


@query(f"WITH {_hybrid()}, {_GROUPED} SELECT source, knowledge_base, round(score, 4) AS score, chunk_count, text FROM contexts")
def file_context_join(spark: SparkSession, d: str) -> DataFrame:
    """The evidence of a question: each file's context, before any model is asked."""
    grouped = ranking.contexts(ranking.top_per_file(hits(spark, d), PER_FILE))
    return grouped.select("source", "knowledge_base", F.round("score", 4).alias("score"), "chunk_count", "text")


@query(f"""WITH {_hybrid()}, {_GROUPED}, verdict AS (SELECT source, max(quality) AS quality FROM grouped g JOIN labels l ON l.doc_id = g.chunk_id GROUP BY source)
SELECT c.source AS file, knowledge_base, round(score, 4) AS score, chunk_count FROM contexts c SEMI JOIN (SELECT source FROM verdict WHERE quality = 1) v ON v.source = c.source""")
def verified_files(spark: SparkSession, d: str) -> DataFrame:
    """Contexts of files whose verdict is favourable; a file without a verdict (a verifier's error) is passed over."""
    grouped = ranking.top_per_file(hits(spark, d), PER_FILE)
    verdict = grouped.join(table(spark, d, "labels").select(F.col("doc_id").alias("chunk_id"), "quality"), "chunk_id").groupBy("source").agg(F.max("quality").alias("quality"))
    kept = ranking.contexts(grouped).join(verdict.where("quality = 1"), "source", "left_semi")
    return kept.select(T.file_name(F.col("source")).alias("file"), "knowledge_base", F.round("score", 4).alias("score"), "chunk_count")


@query(f"""WITH {_hybrid()}, ranked AS (SELECT *, row_number() OVER (PARTITION BY variant_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM mixed)
SELECT variant_id, chunk_id, rank, round(score, 6) AS score FROM ranked JOIN chunks USING (chunk_id) WHERE contains(lower(source), 'src7') OR contains(lower(source), 'src11')""")
def rank_probe(spark: SparkSession, d: str) -> DataFrame:
    """The ranks, among all chunks, of those from the expected files."""
    ranked = ranking.overall_rank(hybrid(spark, d)).join(chunks(spark, d), "chunk_id")
    expected = F.contains(F.lower("source"), F.lit("src7")) | F.contains(F.lower("source"), F.lit("src11"))
    return ranked.where(expected).select("variant_id", "chunk_id", F.col("rank").cast("long").alias("rank"), six())


@query(f"""WITH {_hybrid()}, ranked AS (SELECT *, row_number() OVER (PARTITION BY variant_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM mixed WHERE variant_id = 0)
SELECT rank, chunk_id, round(score, 6) AS score, substring(text, 1, 500) AS preview FROM ranked JOIN chunks USING (chunk_id) WHERE contains(lower(source), 'src7') ORDER BY rank LIMIT 5""")
def rank_probe_first5(spark: SparkSession, d: str) -> DataFrame:
    ranked = ranking.overall_rank(hybrid(spark, d).where("variant_id = 0")).join(chunks(spark, d), "chunk_id")
    first = ranked.where(F.contains(F.lower("source"), F.lit("src7"))).orderBy("rank").limit(5)
    return first.select(F.col("rank").cast("long").alias("rank"), "chunk_id", six(), F.substring("text", 1, 500).alias("preview"))


@query("SELECT list_sort(list_distinct(list('[' || lang || '] ' || source))) AS sources FROM documents")
def distinct_sources(spark: SparkSession, d: str) -> DataFrame:
    few = table(spark, d, "documents").select("lang", "source").distinct()
    return few.agg(F.array_sort(F.collect_set(T.source_label(F.col("lang"), F.col("source")))).alias("sources"))


@query("SELECT page_id, CASE WHEN url IS NULL THEN 'unknown' ELSE list_extract(string_split(url, '/'), -1) END AS file, coalesce(CAST(nullif(page_id % 10, 0) AS INTEGER), 0) AS page FROM pages")
def basename_labels(spark: SparkSession, d: str) -> DataFrame:
    page = F.coalesce(F.nullif(F.pmod(F.col("page_id"), F.lit(10)), F.lit(0)).cast("int"), F.lit(0))
    return table(spark, d, "pages").select("page_id", T.file_name(F.coalesce("url", F.lit("unknown"))).alias("file"), page.alias("page"))


# --- names ----------------------------------------------------------------------------------------------------------


def people(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    parts = table(spark, d, "part")
    listed = parts.groupBy("p_name").agg(F.min("p_partkey").alias("id")).select("id", F.array_join(F.reverse(F.split("p_name", " ")), " ").alias("name"))
    return parts.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), listed


_PEOPLE = """people AS (SELECT p_partkey AS customerid, p_name AS customername FROM part),
listed AS (SELECT min(p_partkey) AS screening_id, array_to_string(list_reverse(string_split(p_name, ' ')), ' ') AS screening_name FROM part GROUP BY p_name)"""
_PAIRS = f"""{_PEOPLE}, a AS (SELECT *, string_split(lower(trim(customername)), ' ') AS ta, array_to_string(list_sort(string_split(lower(trim(customername)), ' ')), ' ') AS sa FROM people),
b AS (SELECT *, string_split(lower(trim(screening_name)), ' ') AS tb, array_to_string(list_sort(string_split(lower(trim(screening_name)), ' ')), ' ') AS sb FROM listed),
scored AS (SELECT customerid, customername, screening_id, screening_name, 1 - levenshtein(sa, sb)::DOUBLE / nullif(greatest(length(sa), length(sb)), 0)::DOUBLE AS similarity,
  len(list_intersect(ta, tb))::DOUBLE / nullif(len(ta) + len(tb) - len(list_intersect(ta, tb)), 0)::DOUBLE AS jaccard FROM a CROSS JOIN b)"""
_BEST = f"""WITH {_PAIRS}, ranked AS (SELECT *, greatest(similarity, jaccard) AS best_score, row_number() OVER (PARTITION BY customerid ORDER BY greatest(similarity, jaccard) DESC, screening_id) AS rn FROM scored)
SELECT customerid, customername, screening_name, round(best_score, 6) AS best_score FROM ranked WHERE rn = 1 AND best_score >= 0.85 ORDER BY best_score DESC, customerid"""


@query(f"""WITH {_PEOPLE}, t AS (SELECT customerid, unnest(list_distinct(string_split(lower(trim(customername)), ' '))) AS token FROM people),
u AS (SELECT screening_id, unnest(list_distinct(string_split(lower(trim(screening_name)), ' '))) AS token FROM listed)
SELECT customerid, screening_id, count(DISTINCT token) AS matched FROM t JOIN u USING (token) GROUP BY ALL""")
def fuzzy_token_match(spark: SparkSession, d: str) -> DataFrame:
    return fuzzy.token_matches(*people(spark, d))


@query(f"WITH {_PAIRS} SELECT DISTINCT customername, screening_name, round(similarity, 6) AS similarity, round(jaccard, 6) AS jaccard FROM scored")
def fuzzy_scores(spark: SparkSession, d: str) -> DataFrame:
    return fuzzy.all_pairs(*people(spark, d)).select(F.col("a_name").alias("customername"), F.col("b_name").alias("screening_name"), six("similarity"), six("jaccard"))


@query(_BEST)
def fuzzy_best_match(spark: SparkSession, d: str) -> DataFrame:
    return fuzzy.best_matches(*people(spark, d)).select("customerid", "customername", "screening_name", six("best_score")).orderBy(F.desc("best_score"), "customerid")


@query(_BEST)
def fuzzy_best_match_pruned(spark: SparkSession, d: str) -> DataFrame:
    return fuzzy.best_matches(*people(spark, d), pruned=True).select("customerid", "customername", "screening_name", six("best_score")).orderBy(F.desc("best_score"), "customerid")


# --- text and guards ------------------------------------------------------------------------------------------------

_TOKENS = "list_sort(list_distinct(regexp_extract_all({}, '[0-9]{{1,3}}(?:[.,][0-9]{{3}})*(?:[.,][0-9]+)?%?|[A-Z]{{2,}}[0-9][A-Z0-9\\-]*')))"


@query(f"SELECT doc_id, {_TOKENS.format('text')} AS tokens FROM documents")
def exact_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.exact_tokens(F.col("text")).alias("tokens"))


@query(f"""WITH r AS (SELECT doc_id, text, regexp_replace(text, '[0-4]', '9', 'g') AS rewritten FROM documents),
t AS (SELECT doc_id, list_filter({_TOKENS.format('text')}, lambda x: NOT list_contains({_TOKENS.format('rewritten')}, x)) AS missing FROM r)
SELECT doc_id, len(missing) = 0 AS ok, missing FROM t""")
def locked_token_check(spark: SparkSession, d: str) -> DataFrame:
    rewritten = F.regexp_replace("text", "[0-4]", "9")
    lost = table(spark, d, "documents").select("doc_id", T.lost_tokens(F.col("text"), rewritten).alias("missing"))
    return lost.select("doc_id", (F.size("missing") == 0).alias("ok"), "missing")


@query(f"""WITH r AS (SELECT doc_id, text, regexp_replace(text, '[0-4]', '9', 'g') AS rewritten FROM documents)
SELECT doc_id, md5(CASE WHEN trim(text) <> '' AND len(list_filter({_TOKENS.format('text')}, lambda x: NOT list_contains({_TOKENS.format('rewritten')}, x))) = 0 THEN rewritten ELSE text END) AS md5 FROM r""")
def guarded_rewrite(spark: SparkSession, d: str) -> DataFrame:
    rewritten = F.regexp_replace("text", "[0-4]", "9")
    return table(spark, d, "documents").select("doc_id", F.md5(T.guarded(F.col("text"), rewritten).cast("binary")).alias("md5"))


_SYNONYMS = ", ".join(f"({k}, '{t}', {s!r})" for k, (t, s) in enumerate(SYNONYMS))


@query(f"""WITH s(pos, term, synonyms) AS (VALUES {_SYNONYMS}),
m AS (SELECT item_id, any_value(text) AS text, array_to_string(flatten(list(synonyms ORDER BY pos)), ' ') AS added FROM benchmark, s WHERE contains(lower(text), lower(term)) GROUP BY item_id)
SELECT item_id, text || ' ' || added AS variant FROM m""")
def synonym_expand(spark: SparkSession, d: str) -> DataFrame:
    """Questions with the synonyms of every dictionary term they contain; the others have no variant."""
    words = spark.createDataFrame([(k, t, s) for k, (t, s) in enumerate(SYNONYMS)], "pos int, term string, synonyms array<string>")
    met = table(spark, d, "benchmark").join(F.broadcast(words), F.contains(F.lower("text"), F.lower("term")))
    listed = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "synonyms"))), lambda x: x["synonyms"]))
    return met.groupBy("item_id", "text").agg(listed.alias("s")).select("item_id", F.concat_ws(" ", "text", F.array_join("s", " ")).alias("variant"))


@query("""SELECT conv_id, turn, list_transform(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S')), lambda x: trim(x, '- '))[1:3] AS lines FROM conversations""")
def variant_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", T.variant_lines(F.col("text"), 3).alias("lines"))


@query("""SELECT conv_id, turn, starts_with(upper(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), 'TH') AS confirmed FROM conversations""")
def verdict_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", T.confirmed(F.col("text"), "TH").alias("confirmed"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '\\S')")
def nonblank_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("text").rlike(r"\S")).select("doc_id")


# --- layout ---------------------------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT l_orderkey, list([CAST(l_linenumber AS VARCHAR), CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END, CASE WHEN l_linestatus = 'O' THEN ' open' || chr(10) || 'item ' ELSE '' END][1:1 + l_linenumber % 3] ORDER BY l_linenumber, l_returnflag, l_linestatus) AS rows_ FROM lineitem GROUP BY l_orderkey),
c AS (SELECT l_orderkey, list_filter(list_transform(rows_, lambda r: list_transform(r, lambda x: replace(trim(coalesce(x, '')), chr(10), ' '))), lambda r: len(list_filter(r, lambda x: x <> '')) > 0) AS k FROM t),
w AS (SELECT l_orderkey, k, list_max(list_transform(k, lambda r: len(r))) AS n FROM c)
SELECT l_orderkey, array_to_string(list_concat(['| ' || array_to_string(list_resize(k[1], n, ''), ' | ') || ' |', '|' || array_to_string(list_transform(range(n), lambda i: '---'), '|') || '|'], list_transform(k[2:], lambda r: '| ' || array_to_string(list_resize(r, n, ''), ' | ') || ' |')), chr(10)) AS markdown FROM w""")
def table_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    """An order's lines as a ragged table with null and broken cells."""
    cells = F.array(F.col("l_linenumber").cast("string"), F.when(F.col("l_returnflag") == "N", None).otherwise(F.col("l_returnflag")), F.when(F.col("l_linestatus") == "O", F.lit(" open\nitem ")).otherwise(""))
    row = F.slice(cells, F.lit(1), 1 + F.col("l_linenumber") % 3)
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_returnflag"), F.col("l_linestatus"), row.alias("r")))), lambda x: x["r"])
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(rows.alias("rows")).select("l_orderkey", layout.markdown(F.col("rows")).alias("markdown"))


def page_words(spark: SparkSession, d: str) -> DataFrame:
    """An order's lines laid out as words of a page with one table box."""
    x0, top = (F.col("l_partkey") % 50).cast("double"), (F.col("l_suppkey") % 40).cast("double")
    word = F.struct(F.concat(F.lit("w"), F.col("l_linenumber").cast("string")).alias("text"), x0.alias("x0"), top.alias("top"), (x0 + 5).alias("x1"), (top + 2).alias("bottom"))
    words = F.transform(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), word.alias("w")))), lambda x: x["w"])
    box = F.array(F.struct(F.lit(10.0).alias("x0"), F.lit(5.0).alias("top"), F.lit(40.0).alias("x1"), F.lit(30.0).alias("bottom")))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(words.alias("words")).withColumn("boxes", box)


_LOOSE = """w AS (SELECT l_orderkey, l_linenumber AS k, 'w' || l_linenumber AS text, (l_partkey % 50)::DOUBLE AS x0, (l_suppkey % 40)::DOUBLE AS top FROM lineitem),
loose AS (SELECT * FROM w WHERE NOT (x0 >= 8 AND x0 + 5 <= 42 AND top >= 3 AND top + 2 <= 32))"""


@query(f"WITH {_LOOSE} SELECT l_orderkey, list(text ORDER BY k) AS words FROM loose GROUP BY l_orderkey")
def words_outside_tables(spark: SparkSession, d: str) -> DataFrame:
    kept = F.transform(layout.outside(F.col("words"), F.col("boxes")), lambda w: w["text"])
    return page_words(spark, d).select("l_orderkey", kept.alias("words")).where(F.size("words") > 0)


@query("""WITH RECURSIVE w AS (SELECT l_orderkey, 'w' || l_linenumber AS text, (l_partkey % 50)::DOUBLE AS x0, (l_suppkey % 40)::DOUBLE AS top,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_suppkey % 40)::DOUBLE, (l_partkey % 50)::DOUBLE, l_linenumber) AS i, l_linenumber AS k FROM lineitem),
f AS (SELECT l_orderkey, i, top AS anchor, 1 AS line FROM w WHERE i = 1
  UNION ALL SELECT w.l_orderkey, w.i, CASE WHEN abs(w.top - f.anchor) <= 3 THEN f.anchor ELSE w.top END, CASE WHEN abs(w.top - f.anchor) <= 3 THEN f.line ELSE f.line + 1 END FROM f JOIN w ON w.l_orderkey = f.l_orderkey AND w.i = f.i + 1),
l AS (SELECT l_orderkey, line, string_agg(text, ' ' ORDER BY x0, top, i) AS t FROM f JOIN w USING (l_orderkey, i) GROUP BY ALL)
SELECT l_orderkey, string_agg(t, chr(10) ORDER BY line) AS text FROM l GROUP BY l_orderkey""")
def words_to_lines(spark: SparkSession, d: str) -> DataFrame:
    return page_words(spark, d).select("l_orderkey", layout.lines(F.col("words")).alias("text"))


@query("""SELECT n_nationkey, array_to_string(list_filter([trim(CASE WHEN n_nationkey % 3 = 0 THEN '  ' ELSE ' ' || n_name || ' ' END), CASE WHEN n_nationkey % 2 = 0 THEN '| ' || n_name || ' |' ELSE '' END, '| ' || n_regionkey || ' |'], lambda x: x <> ''), chr(10) || chr(10)) AS text FROM nation""")
def page_assembly(spark: SparkSession, d: str) -> DataFrame:
    loose = F.when(F.col("n_nationkey") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "n_name", F.lit(" ")))
    tables = F.array(F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("| "), "n_name", F.lit(" |"))).otherwise(""), F.concat(F.lit("| "), F.col("n_regionkey").cast("string"), F.lit(" |")))
    return table(spark, d, "nation").select("n_nationkey", layout.page_text(loose, tables).alias("text"))


@query()
def recursive_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Every document in overlapping chunks; SQL can't express the splitter, so tests hold it against its contract."""
    rows = chunks(spark, d).drop("chunk_id")
    return chunking.with_ids(chunking.chunked(rows)).select("chunk_id", "source", "page", "chunk_no", F.length("text").alias("n_chars"))


@query("""WITH c AS (SELECT source, count(*) AS chunks, sum(CASE WHEN regexp_matches(text, '\\S') THEN 1 ELSE 0 END) AS filled FROM documents GROUP BY source)
SELECT CAST(sum(CASE WHEN filled > 0 THEN 1 ELSE 0 END) AS BIGINT) AS files_ok, CAST(sum(CASE WHEN filled = 0 THEN 1 ELSE 0 END) AS BIGINT) AS files_skipped, CAST(sum(filled) AS BIGINT) AS chunks, max(filled)::BIGINT AS most FROM c""")
def build_metrics(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "documents").groupBy("source").agg(F.count_if(F.col("text").rlike(r"\S")).alias("filled"))
    return per.agg(F.count_if(F.col("filled") > 0).alias("files_ok"), F.count_if(F.col("filled") == 0).alias("files_skipped"), F.sum("filled").alias("chunks"), F.max("filled").alias("most"))


@query("SELECT lang AS knowledge_base, source, count(*) AS chunks FROM documents GROUP BY ALL")
def chunks_per_file(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.col("lang").alias("knowledge_base"), "source").agg(F.count("*").alias("chunks"))
