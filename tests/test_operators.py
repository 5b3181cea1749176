import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import fuzzy, layout, ranking, tfidf, vector

HITS = "variant_id int, rank int, chunk_id long, source string, knowledge_base string, page int, text string, score double"


def test_lines_hang_on_their_first_word(spark):
    words = [("a", 0.0, 10.0, 1.0, 1.0), ("c", 9.0, 12.5, 1.0, 1.0), ("b", 5.0, 12.0, 1.0, 1.0), ("d", 0.0, 13.5, 1.0, 1.0)]
    df = spark.createDataFrame([(words,), ([],)], f"words {layout.WORDS}")
    assert [r[0] for r in df.select(layout.lines(F.col("words"))).collect()] == ["a b c\nd", ""]


def test_words_near_a_box_are_inside(spark):
    words = [("in", 8.0, 8.0, 22.0, 22.0), ("out", 7.9, 8.0, 22.0, 22.0)]
    df = spark.createDataFrame([(words, [(10.0, 10.0, 20.0, 20.0)]), (words, None)], f"words {layout.WORDS}, boxes {layout.BOX}")
    got = df.select(F.transform(layout.outside(F.col("words"), F.col("boxes")), lambda w: w["text"])).collect()
    assert [r[0] for r in got] == [["out"], ["in", "out"]]


def test_markdown(spark):
    rows = [([["A", None], ["", ""], ["x\ny"]],), ([["", None]],), ([],), ([[" b "]],)]
    df = spark.createDataFrame(rows, "rows array<array<string>>")
    got = [r[0] for r in df.select(layout.markdown(F.col("rows"))).collect()]
    assert got == ["| A |  |\n|---|---|\n| x y |  |", "", "", "| b |\n|---|"]
    page = spark.createDataFrame([(" t \n", ["", "x"]), ("  ", None)], "a string, b array<string>")
    assert [r[0] for r in page.select(layout.page_text(F.col("a"), F.col("b"))).collect()] == ["t\n\nx", ""]


def test_rescaling_and_blending_edges(spark):
    one = spark.createDataFrame([(0, 1, 0.7)], "variant_id int, chunk_id long, score double")
    assert ranking.rescaled(one).head()["score"] == 0.0
    chunk = spark.createDataFrame([(1, "word here")], "chunk_id long, text string")
    asked = spark.createDataFrame([(0, "word")], "variant_id int, text string")
    lexical = tfidf.scores(tfidf.fit(chunk), asked)
    assert lexical.count() == 1  # found by words,
    assert ranking.top(ranking.blended(lexical, lexical, chunk, asked), 5).count() == 0  # but a corpus of one has no contrast
    assert tfidf.scores(tfidf.fit(chunk), spark.createDataFrame([(0, "unknown")], "variant_id int, text string")).count() == 0


def test_equal_chunks_rank_by_id(spark):
    chunks = spark.createDataFrame([(2, "same words"), (1, "same words"), (3, "other things")], "chunk_id long, text string")
    asked = spark.createDataFrame([(0, "same")], "variant_id int, text string")
    got = ranking.top(tfidf.scores(tfidf.fit(chunks), asked), 2).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == [1, 2]


def test_grouping(spark):
    rows = [(0, 1, 1, "f", "k", 3, "c", 0.9), (1, 1, 1, "f", "k", 3, "c", 0.7), (0, 2, 2, "f", "k", 1, "a", 0.8), (0, 3, 3, "f", "k", None, "n", 0.6), (0, 4, 4, "f", "k", 2, "b", 0.5), (0, 5, 5, "g", "k", 0, "z", 0.1)]
    hits = spark.createDataFrame(rows, HITS)
    got = ranking.contexts(ranking.top_per_file(hits, 3)).orderBy("source").collect()
    assert got[0]["text"] == "n\n\n---\n\na\n\n---\n\nc" and got[0]["chunk_count"] == 3 and got[0]["score"] == 0.9
    assert [(r["source"], r["chunk_id"]) for r in ranking.best_per_file(hits).orderBy("source").collect()] == [("f", 1), ("g", 5)]


def test_overall_rank_needs_no_single_task(spark):
    r = random.Random(18)
    score = lambda v: r.choice([0.0, 0.0, r.uniform(-0.3, 1), round(r.random(), 1), 1e-10, -1e-10]) if v else float(r.randint(0, 6))
    ids = [r.randint(-(2**62), 2**62) for _ in range(500)]
    rows = [(v, k, score(v)) for v in (0, 1) for k in ids]
    df = spark.createDataFrame(rows, "variant_id int, chunk_id long, score double")
    got = {(r["variant_id"], r["chunk_id"]): r["rank"] for r in ranking.overall_rank(df).collect()}
    for v in (0, 1):
        want = sorted((x for x in rows if x[0] == v), key=lambda x: (-round(x[2], 9), x[1]))
        assert [got[v, x[1]] for x in want] == list(range(1, 501))


def test_top_n_is_limited_before_the_shuffle(spark):
    df = spark.createDataFrame([(0, 1, 0.5)], "variant_id int, chunk_id long, score double")
    plan = ranking.top(df, 3)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_nearest(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "chunk_id long, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "variant_id int, query array<float>")
    assert [r["chunk_id"] for r in vector.nearest(vector.scores(rows, q), 2).collect()] == [1, 3]


@pytest.mark.parametrize("seed", [1, 2])
def test_pruned_screening_equals_all_pairs(spark, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcd") for _ in range(r.randint(1, 7)))
    left = [(k, " ".join(word() for _ in range(r.randint(1, 4)))) for k in range(60)]
    right = []
    for k in range(60):
        name = list(r.choice(left)[1])
        for _ in range(r.randint(0, 2)):
            name[r.randrange(len(name))] = r.choice("abcd ")
        right.append((k, " ".join(reversed("".join(name).split(" ")))))
    people = spark.createDataFrame([*left, (99, None), (98, ""), (97, left[0][1])], "id long, name string")
    listed = spark.createDataFrame([*right, (99, None), (98, "")], "id long, name string")
    for t in (0.6, 0.85):
        whole, few = (sorted(map(tuple, fuzzy.best_matches(people, listed, t, p).collect())) for p in (False, True))
        assert whole == few and whole


def test_token_matches_merge_rows_of_one_id(spark):
    people = spark.createDataFrame([(1, "ali baba"), (1, "cara"), (2, None)], "id long, name string")
    listed = spark.createDataFrame([(7, "cara ali ali")], "id long, name string")
    assert [tuple(r) for r in fuzzy.token_matches(people, listed).collect()] == [(1, 7, 2)]
