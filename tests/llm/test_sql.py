"""The operators' queries against their SQL, on the smallest tables and on odd rows."""

import os

import duckdb
import pytest

from quarry.llm import queries

DATA = "/root/testdata/sf0.001"


def plain(v):
    return f"{v:.6g}" if isinstance(v, float) else v


def compared(spark, name, folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        if f.endswith(".parquet"):
            files = f"{folder}/{f}" if os.path.isfile(f"{folder}/{f}") else f"{folder}/{f}/*.parquet"
            con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{files}')")
    df = queries.queries()[name](spark, str(folder))
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    result = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted(repr([plain(row[names.index(c)]) for c in columns]) for row in result.fetchall())
    return got


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert compared(spark, name, DATA)


@pytest.mark.parametrize("name", ["op1_decontaminate", "op4_suffix_dedup", "op7_quality_rules", "op8_near_duplicates"])
def test_odd_rows_equal_sql(spark, tmp_path, name):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    texts = [None, "", " \n\t", "word", "Word", "é É", item.upper(), item.replace("three", "3").replace("nine", "9"), "x " + item, "ab" * 500, "q" + "ab" * 450, "a\nb\na\n\n \n", "same line here\n" * 60, "### $$$ " * 20]
    rows = [(k, t, "en" if k % 2 else None, "s", 0) for k, t in enumerate([*texts, *texts[3:6]])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "too short"), (5, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert compared(spark, name, tmp_path)
