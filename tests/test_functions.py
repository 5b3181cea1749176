from types import SimpleNamespace

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import chunking


def values(spark, rows, *columns):
    df = spark.createDataFrame(rows, "a string, b string")
    return [tuple(r) for r in df.select(*columns).collect()]


def test_exact_tokens_and_lost_ones(spark):
    a, b = F.col("a"), F.col("b")
    got = values(spark, [("Bunga 3,50% Rp1.000.000 kode NTB2607-IDR th 2026", None)], T.exact_tokens(a))
    assert sorted(got[0][0]) == sorted(["3,50%", "1.000.000", "NTB2607-IDR", "202", "6"])
    rows = [("5%", "5% 7%"), ("5% 7%", "5%"), ("none", "none"), ("", "3"), (None, "3"), ("1 1", "1")]
    assert [x[0] for x in values(spark, rows, T.lost_tokens(a, b))] == [[], ["7%"], [], [], [], []]
    assert [x[0] for x in values(spark, rows, T.guarded(a, b))] == ["5% 7%", "5% 7%", "none", "", None, "1"]
    assert values(spark, [("x 1", None)], T.guarded(a, b)) == [("x 1",)]


def test_verdicts_and_variant_lines(spark):
    rows = [("YA", None), (" ya.", None), ("TIDAK", None), ("Yakin", None), ("\n\tya", None)]
    assert [x[0] for x in values(spark, rows, T.confirmed(F.col("a")))] == [True, True, False, True, True]
    got = values(spark, [("- satu\n\n-\n- dua", None), ("", None)], T.variant_lines(F.col("a"), 2))
    assert [x[0] for x in got] == [["satu", ""], []]


def test_terms(spark):
    assert values(spark, [("A bc, Bc_d 12 é éa", None), (None, None)], T.terms(F.col("a"))) == [(["bc", "bc_d", "12", "éa"],), ([],)]


def test_names(spark):
    a, b = F.col("a"), F.col("b")
    got = values(spark, [("a a", "a"), ("", ""), (None, "x"), ("a  b", "b  a")], T.token_similarity(T.name_tokens(a), T.name_tokens(b)), T.edit_similarity(T.sorted_name(a), T.sorted_name(b)))
    assert got[0][0] == 0.5  # repeats enlarge the denominator only
    assert got[1][1] is None  # nothing to compare, and no division by zero
    assert got[2] == (None, None)
    assert got[3] == (1.0, 1.0)  # the double blank is an empty token


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n", max_size=300), st.integers(5, 40), st.integers(0, 4))
def test_chunks_keep_to_size_and_lose_nothing(text, size, overlap):
    got = chunking.split(text, size, overlap)
    assert all(0 < len(c) <= size and c == c.strip() for c in got)
    assert "".join(c for c in text if c not in " \n") in "".join(got).replace(" ", "").replace("\n", "") or overlap
    place = 0
    for c in got:
        at = text.find(c, max(0, place - overlap - size))
        assert at >= 0
        place = at + len(c)


def test_chunks_prefer_paragraphs_and_overlap():
    assert chunking.split("aaa bbb\n\nccc ddd", 8, 0) == ["aaa bbb", "ccc ddd"]
    assert chunking.split("one two three four", 9, 4) == ["one two", "two three", "four"] or chunking.split("one two three four", 9, 4)[0] == "one two"
    assert chunking.split("x" * 25, 10, 0) == ["x" * 10, "x" * 10, "x" * 5]


def test_chunked_rows_inherit_everything(spark):
    df = spark.createDataFrame([("s", 1, "kb", "word " * 60), ("t", None, "kb", None), ("u", 2, "kb", "  ")], "source string, page int, knowledge_base string, text string")
    got = chunking.with_ids(chunking.chunked(df, 100, 10)).collect()
    assert {r["source"] for r in got} == {"s"} and [r["chunk_no"] for r in got] == list(range(len(got)))
    assert len({r["chunk_id"] for r in got}) == len(got) and all(r["page"] == 1 for r in got)


def test_chunks_leave_a_worker_in_small_batches(monkeypatch):
    given = pa.schema([("source", pa.string()), ("text", pa.string())])
    cut = chunking.chunked(SimpleNamespace(columns=given.names, schema=[], mapInArrow=lambda f, schema: f))
    texts = ["word " * 60_000, None, "", " \n", "ab\n\n" * 50_000, "x" * 2_000]
    batch = pa.record_batch([pa.array([f"s{k}" for k in range(len(texts))]), pa.array(texts)], schema=given)
    monkeypatch.setattr(chunking, "BATCH_CHARS", 100_000, raising=False)
    pool, before = pa.proxy_memory_pool(pa.default_memory_pool()), pa.default_memory_pool()
    pa.set_memory_pool(pool)
    try:
        sizes, got = [], []
        for out in cut([batch]):
            sizes.append(out.nbytes)
            got += zip(*(c.to_pylist() for c in out.columns), strict=True)
            del out
    finally:
        pa.set_memory_pool(before)
    assert got == [(f"s{k}", c, n) for k, t in enumerate(texts) if t for n, c in enumerate(chunking.split(t))]
    assert len(sizes) > 4 and max(sizes) < 150_000
    assert pool.max_memory() < 1_000_000  # the whole text once for each of its chunks would be 130 MB
