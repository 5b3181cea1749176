"""Every registered query against its SQL on the smallest tables."""

import os
import random

import duckdb
import pytest

from quarry.operators import tfidf
from quarry.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    return [plain(x) for x in v] if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, db, name):
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    result = db.execute(catalogue.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(repr([plain(row[names.index(c)]) for c in columns]) for row in result.fetchall())
    assert got == want


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


LEXICAL = ["lexical_fallback_topk", "tfidf_topk_multi_variant", "tfidf_topk", "tfidf_norms", "tfidf_vocabulary"]


@pytest.mark.parametrize("few", [100_000, 2])
def test_texts_that_share_an_id_count_as_one(spark, tmp_path, monkeypatch, few):
    """Ids of several rows, of none, empty and null texts; few shared ids are sent round, beyond that every count is shuffled."""
    words = "thing reason Ention erth the pour dans les nicht Herean und oder thand THE x _a 12 1 éa Éa".split()
    r = random.Random(few)
    text = lambda: r.choice(["", " . ", "thing", " ".join(r.choice(words) for _ in range(r.randint(1, 30)))])
    rows = [(r.choice([k, k, 3, 4]), text(), "s", "k") for k in range(60)] + [(None, "the thing", "s", "k"), (None, "the pour", "s", "k"), (3, None, "s", "k"), (99, None, "s", "k")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    monkeypatch.setattr(tfidf, "FEW", few, raising=False)
    for name in LEXICAL:
        df = catalogue.QUERIES[name](spark, str(tmp_path))
        result = con.execute(catalogue.SQL[name])
        names = [d[0] for d in result.description]
        assert sorted(repr([plain(row[c]) for c in names]) for row in df.collect()) == sorted(repr([plain(x) for x in row]) for row in result.fetchall()), name


@pytest.mark.parametrize("name", LEXICAL)
def test_no_row_for_each_term_of_a_text_is_shuffled(spark, name):
    """Neither the counts, to be summed or to meet the queries, nor the postings; whatever Spark thinks of the queries' size."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = catalogue.QUERIES[name](spark, DATA)
        df.collect()
        moved, todo = [], [df._jdf.queryExecution().executedPlan()]
        while todo:
            node = todo.pop()
            kind = node.getClass().getSimpleName()
            if kind == "ShuffleExchangeExec":
                moved.append(node.metrics().apply("shuffleRecordsWritten").value())
            if kind in ("AdaptiveSparkPlanExec",):
                todo.append(node.executedPlan())
            elif kind.endswith("QueryStageExec"):
                todo.append(node.plan())
            else:
                todo += [node.children().apply(k) for k in range(node.children().size())]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    pairs = tfidf.counts(catalogue.chunks(spark, DATA)).count()
    assert moved and max(moved) < 0.75 * pairs, (moved, pairs)


def test_best_terms_of_the_partitions_are_merged_once(spark):
    """Each merge shuffles as many terms as the vocabulary holds from every partition; postings, norms and queries share one."""
    most = 50  # fewer than there are terms, or Spark leaves the merge out
    df = tfidf.scores(tfidf.fit(catalogue.chunks(spark, DATA), most), catalogue.variants(spark))
    assert df.collect()
    merges, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        merges += kind == "TakeOrderedAndProjectExec" and node.limit() == most
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            todo += [node.children().apply(k) for k in range(node.children().size())]
    assert merges == 1
