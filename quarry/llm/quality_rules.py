"""Quality rules by robust multivariate outliers, in DataFrame expressions only.

Every text gets exact counts (words, symbols, repeated lines, words in repeated five-word
windows).  Documents that fail the base rules go.  The others' counts become a vector of
five transformed statistics, rates with pseudo-counts so that short texts don't scatter.  Groups are each
language and source, each language, and all documents.  A group's minimum-covariance-determinant estimate rests on
its nearest half: from several starts, concentration steps go on until the determinant stops
falling, the start with the least determinant counts, and the rows within ``weigh`` of it make the final
mean and covariance.  These are drawn to the language's, and a language's to those of all documents, by
``prior`` pseudo-rows; so a group of any size has an estimate by the same rule.  Vectors whose squared
Mahalanobis distance exceeds ``cutoff`` are rejected.

Statistics are rounded to an integer grid.  Sums over a subset are then exact in any order, so a
task that runs again gives the same estimate; and an exact percentile needs a counter for each
grid value only, however many rows a hot source has, and is combined before the shuffle.  Distances
are ranked on a logarithmic grid of some hundred values for the same reason; ties are all in.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import WHITE, stored

#: Least spread of each statistic in grid units: keeps a covariance regular where most values are equal.
SPREAD = {"x_word": 35.0, "x_symbol": 60.0, "x_line": 60.0, "x_upper": 35.0, "x_repeat": 60.0}
GRID = 1000
P = list(SPREAD)
#: Groups up to which their estimates (a few hundred bytes each) are sent to every task; beyond, rows are joined by group.
FEW_GROUPS = 20_000
#: Makes the covariance of the nearest half of five normal variables that of all.
CONSISTENCY = 1.91
#: Steps of the distances' grid to a factor of e.
FINE = 90
ESTIMATE = [*[f"m_{x}" for x in P], *[f"l_{i}{j}" for i in range(len(P)) for j in range(i + 1)]]
PAIRS = [(i, j) for i in range(len(P)) for j in range(i + 1)]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def counted(docs: DataFrame, text_col: str = "text", window: int = 5) -> DataFrame:
    """``docs`` with the exact counts of its whole texts; null counts as empty.

    Windows are compared by a 64-bit hash within one document only.
    """
    white = WHITE.replace("\\", "\\\\")
    df = docs.withColumn("_t", F.coalesce(F.col(text_col), F.lit("")))
    bare = F.col("_t")
    for c in " \t\n\x0b\x0c\r":
        bare = F.replace(bare, F.lit(c), F.lit(""))
    df = df.withColumns({
        "_w": F.expr(f"array_remove(split(_t, '{white}'), '')"),
        "_l": F.expr(f"filter(split(_t, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"),
        "word_chars": F.length(bare).cast("long"),
        "n_symbols": F.expr("length(regexp_replace(_t, '[^#*$%&|<>]+', ''))").cast("long"),
        "n_upper": F.expr("length(regexp_replace(_t, '[^A-Z]+', ''))").cast("long"),
    })
    gram = ", ".join(f"_w[i + {k}]" for k in range(window))
    df = df.withColumns({
        "n_words": F.size("_w").cast("long"),
        "n_lines": F.size("_l").cast("long"),
        "n_dup_lines": F.expr("size(_l) - size(array_distinct(_l))").cast("long"),
        "_g": F.expr(f"CASE WHEN size(_w) > {window} THEN transform(sequence(0, size(_w) - {window}), i -> xxhash64({gram})) END"),
    }).drop("_w", "_l")
    df = df.withColumn("_s", F.expr("CASE WHEN size(array_distinct(_g)) < size(_g) THEN array_sort(transform(_g, (h, i) -> struct(h AS h, i AS i))) END"))
    again = "filter(_s, (x, k) -> (k > 0 AND _s[greatest(k - 1, 0)].h = x.h) OR (k < size(_s) - 1 AND _s[least(k + 1, size(_s) - 1)].h = x.h))"
    df = df.withColumn("_p", F.expr(f"array_sort(transform({again}, x -> x.i))")).drop("_g", "_s")
    covered = f"aggregate(_p, struct(-{window} AS at, 0L AS n), (a, i) -> struct(i AS at, a.n + least({window}, i - a.at) AS n), a -> a.n)"
    return df.withColumn("n_repeat_words", F.expr(f"coalesce({covered}, 0L)")).drop("_p", "_t")


def on_grid(df: DataFrame) -> DataFrame:
    """The transformed statistics as integers."""
    words = F.col("n_words") + 20
    rates = {
        "x_word": F.log((F.col("word_chars") + 100) / words),
        "x_symbol": F.log1p(10.0 * F.col("n_symbols") / words),
        "x_line": F.col("n_dup_lines") / (F.col("n_lines") + 4),
        "x_upper": F.col("n_upper") / (F.col("word_chars") + 100),
        "x_repeat": F.col("n_repeat_words") / words,
    }
    return df.withColumns({k: F.round(GRID * x).cast("long") for k, x in rates.items()})


def held(per_group: DataFrame, few: bool) -> DataFrame:
    """A table of one row a group, sent to every task where the groups were counted and are few; then no row moves to its group."""
    return F.broadcast(per_group) if few else stored(per_group, "mcd-groups")


def moments(rows: DataFrame, *by: str) -> DataFrame:
    """``_n`` and the means and covariances of each group."""
    sums = [F.count("*").alias("_n"), *[F.sum(x).cast("double").alias(f"_{x}") for x in P], *[F.sum(F.col(P[i]) * F.col(P[j])).cast("double").alias(f"_{i}{j}") for i, j in PAIRS]]
    old = [F.max("_old").alias("_old")] if "_old" in rows.columns else []
    got = rows.groupBy(*by).agg(*sums, *old)
    covariances = [((F.col(f"_{i}{j}") - F.col(f"_{P[i]}") * F.col(f"_{P[j]}") / F.col("_n")) / F.col("_n")).alias(f"v_{i}{j}") for i, j in PAIRS]
    return got.select(*by, "_n", *[(F.col(f"_{x}") / F.col("_n")).alias(f"m_{x}") for x in P], *covariances, *(["_old"] if old else []))


def factored(got: DataFrame, factor: float) -> DataFrame:
    """``got`` with the lower Cholesky factor of each covariance, times ``factor`` and with the least spreads added, and the log determinant ``_det``."""
    factors = []  # each refers to those before it in the same select
    for i, j in PAIRS:
        v: Column = F.col(f"v_{i}{j}") * F.lit(factor)
        if i == j:
            v = v + SPREAD[P[i]] ** 2
        for k in range(j):
            v = v - F.col(f"l_{i}{k}") * F.col(f"l_{j}{k}")
        factors.append((F.sqrt(v) if i == j else v / F.col(f"l_{j}{j}")).alias(f"l_{i}{j}"))
    return got.select("*", *factors, sum((F.log(f"l_{i}{i}") for i in range(1, len(P))), F.log("l_00")).alias("_det"))


def measured(rows: DataFrame, estimate: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """``rows`` with the squared distance ``_d`` to each estimate of their group: the sum of squares of the y that solve ``L y = x - m``."""
    out = rows.join(held(estimate, few), "_g", how)
    solved = []
    for i, x in enumerate(P):
        y = F.col(x) - F.col(f"m_{x}")
        for j in range(i):
            y = y - F.col(f"l_{i}{j}") * F.col(f"_y{j}")
        solved.append((y / F.col(f"l_{i}{i}")).alias(f"_y{i}"))
    total = sum((F.col(f"_y{i}") * F.col(f"_y{i}") for i in range(1, len(P))), F.col("_y0") * F.col("_y0"))
    return out.select("*", *solved, total.alias("_d")).drop(*ESTIMATE, *[f"_y{i}" for i in range(len(P))])


def nearest_half(df: DataFrame, few: bool) -> DataFrame:
    """The estimate of each group's and start's nearest half, by the distance ``_d``."""
    df = df.withColumn("_d", F.round(FINE * F.log1p(F.least("_d", F.lit(1e9)))).cast("int"))
    edges = df.groupBy("_g", "_start").agg(F.percentile("_d", F.lit(0.5)).alias("_edge"))
    near = df.join(held(edges, few), ["_g", "_start"]).where("_d <= _edge")
    got = factored(moments(near, "_g", "_start"), CONSISTENCY)
    return stored(got.select("_g", "_start", *ESTIMATE, "_det", *(["_old"] if "_old" in got.columns else [])), "mcd-half")


def least_determinant(pool: DataFrame, few: bool) -> DataFrame:
    """Of each group the estimate with the least determinant that concentration reaches from three starts.

    The starts are the rows nearest to the medians by squares of interquartile ranges, by such with far values
    bounded, and those with the lowest rates, where junk has high ones.
    """
    middle = stored(pool.groupBy("_g").agg(*[F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q_{x}") for x in P]), "mcd-middle")
    z = [(F.col(x) - F.col(f"q_{x}")[1]) / F.greatest((F.col(f"q_{x}")[2] - F.col(f"q_{x}")[0]) / 1.349, F.lit(SPREAD[x])) for x in P]
    apart = pool.join(held(middle, few), "_g").select("_g", *P, *[a.alias(f"z_{x}") for x, a in zip(P, z, strict=True)])
    z = [F.col(f"z_{x}") for x in P]
    bounded = [a / (1 + F.abs(a)) for a in z]
    starts = [sum((a * a for a in z[1:]), z[0] * z[0]), 100 * sum((a * a for a in bounded[1:]), bounded[0] * bounded[0]), F.greatest(F.lit(0.0), sum(z[2:], z[1]) + 100)]
    moving = nearest_half(apart.select("_g", *P, F.posexplode(F.array(*starts)).alias("_start", "_d")), few)
    seen = [moving]
    while not moving.isEmpty():
        new = nearest_half(measured(pool, moving.withColumnRenamed("_det", "_old"), few), few)
        moving = new.where("_det < _old - 1e-9").drop("_old")
        seen.append(moving)
    every = reduce(DataFrame.unionByName, seen)
    return stored(every.groupBy("_g").agg(F.min_by(F.struct(*ESTIMATE), F.struct("_det", "_start")).alias("e")).select("_g", "e.*"), "mcd-least")


def drawn(own: DataFrame, above: DataFrame, prior: float) -> DataFrame:
    """The moments of ``own`` drawn to those of ``above``, the groups ``_up``, by ``prior`` rows."""
    names = [f"m_{x}" for x in P] + [f"v_{i}{j}" for i, j in PAIRS]
    both = own.join(above.select(F.col("_g").alias("_up"), *[F.col(c).alias(f"u{c}") for c in names]), "_up")
    return both.select("_g", *[((F.col("_n") * F.col(c) + prior * F.col(f"u{c}")) / (F.col("_n") + prior)).alias(c) for c in names])


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    cutoff: float = 40.0, weigh: float = 30.0, prior: float = 50.0,
) -> DataFrame:
    """``doc_id``, the exact counts, ``base_failed``, ``kept`` and the ``distance`` of every row.

    Null texts count as empty and fail the base rules; null languages and sources form groups of their
    own; repeated rows are judged alike; a text may be of any length; an empty table gives an empty
    result.  Further columns aren't read, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("_lang"), F.col(source_col).cast("string").alias("_source"))
    rows = on_grid(counted(rows).drop("text"))
    named = lambda *names: F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    rows = stored(rows.select("doc_id", *COUNTS, *P, named("_lang").alias("_up"), named("_lang", "_source").alias("_g")), "quality-counts")
    rows = rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    pool = rows.where("NOT base_failed")
    groups = stored(pool.select("_g", "_up").distinct(), "mcd-names")
    few = 2 * groups.count() <= FEW_GROUPS
    pool = pool.select(F.explode(F.array(F.col("_g"), F.col("_up"), F.lit("all"))).alias("_g"), *P)
    near = measured(pool, least_determinant(pool, few), few).where(F.col("_d") <= weigh)
    own = stored(moments(near, "_g"), "mcd-moments")
    top = own.where("_g = 'all'")
    language = drawn(own.join(groups.select(F.col("_up").alias("_g")).distinct(), "_g").withColumn("_up", F.lit("all")), top, prior)
    estimate = stored(factored(drawn(own.join(groups, "_g"), language, prior), 1.0).select("_g", *ESTIMATE), "mcd-final")
    out = measured(rows, estimate, few, "left")
    return out.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.coalesce("_d", F.lit(0.0)) <= cutoff)).alias("kept"), F.round("_d", 3).alias("distance"))
