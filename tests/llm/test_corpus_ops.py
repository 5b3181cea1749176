"""Decontamination, duplicates, quality and the pipeline against brute force and known cases."""

import hashlib
import itertools
import math
import pathlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quarry.llm import decontaminate, graph, near_dups, quality_model, suffix_dedup
from quarry.llm.decontaminate import contaminated
from quarry.llm.quality_rules import COUNTS, counted, quality_rules

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def prose(r, n, size=400):
    return " ".join(f"w{r.randint(0, size)}" for _ in range(n))


# --- decontamination ---


def test_contaminated(spark):
    r = random.Random(1)
    items = [(k, prose(r, r.randint(15, 40))) for k in range(30)]
    docs, want = [], set()
    for k in range(120):
        text = prose(r, r.randint(0, 200))
        if k % 2:
            item = r.randrange(30)
            words = items[item][1].split()
            for _ in range(len(words) // 9):
                words[r.randrange(len(words))] = f"new{r.randint(0, 9)}"
            shown = [w.upper() + r.choice(["", ",", "###"]) for w in words]
            text = f"{text} {' '.join(shown)} {prose(r, 20)}"
            want.add((k, item))
        docs.append((k, text, "x"))
    docs += [(500, None, "x"), (501, "", "x"), (None, items[0][1], "x"), (502, items[1][1], "x"), (502, items[1][1], "x"), (503, " ".join(items[2][1].split()[:9]), "x"), (600, "some Too, few *** words!", "x"), (601, "too few more words", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (92, "too few words")], "item_id long, text string")
    got = contaminated(df, bench).collect()
    pairs = {(x["doc_id"], x["item_id"]) for x in got}
    assert (600, 92) in pairs and not any(i == 92 for d, i in pairs if d != 600)
    pairs -= {(600, 92)}
    assert pairs - {(None, 0), (502, 1)} <= want and {(None, 0), (502, 1)} <= pairs
    assert len(want - pairs) <= 1  # substitutions may leave an item under the share
    assert sum(x["doc_id"] == 502 for x in got) == 2
    in_blocks = contaminated(df, bench, block_words=200).collect()
    assert sorted(map(str, in_blocks)) == sorted(map(str, got))
    assert contaminated(df.limit(0), bench).collect() == [] and contaminated(df, bench.limit(0)).collect() == []


def test_no_allowed_substitution_is_missed():
    for n in range(8, 17):
        item = [f"w{k}" for k in range(n)]
        ix = decontaminate.index(pa.array([1]), pa.array([" ".join(item)]), 8, 13, 0.75)
        size = min(n, 13)
        wrong = size - -(-3 * size // 4)
        shown = [" ".join(f"x{k}" if k in c else w for k, w in enumerate(item[:size])) for c in itertools.combinations(range(size), wrong)]
        assert len(list(decontaminate.found(ix, *decontaminate.hashed(pa.array(shown)), 8, 13, 0.75))) == len(shown)


def test_common_seeds_are_paired_a_slice_at_a_time(monkeypatch):
    words = "a b c a b c a b c a b c a b c a b c"
    ix = decontaminate.index(pa.array([1, 2]), pa.array([words, "b c a"]), 8, 13, 0.75)
    text = decontaminate.hashed(pa.array([words * 3, "x " + words, "b c", None or ""]))
    whole = list(decontaminate.found(ix, *text, 8, 13, 0.75))
    monkeypatch.setattr(decontaminate, "HELD", 5)
    assert whole == list(decontaminate.found(ix, *text, 8, 13, 0.75)) and {x[:2] for x in whole} == {(0, 0), (0, 1), (1, 0), (1, 1)}


# --- graph ---


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2100)]
    forest = graph.Forest()
    for a, b in edges:
        forest.join(a, b)
    want = {x: forest.root(x) for a, b in edges for x in (a, b) if a != b}
    got = {x["node"]: x["component"] for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- near-duplicates ---


def brute_components(rows, size):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = WORDS.findall((t or "").translate(lower))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    forest = graph.Forest()
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                forest.join(a, b)
    low = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        low[forest.root(k)].append(i)
    return [(i, len(s), min((x for x in low[forest.root(k)] if x is not None), default=None) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))]


def edited(r, text, share):
    return " ".join(f"e{r.randint(0, 9999)}" if r.random() < share else w for w in text.split(" "))


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, size):
    r = random.Random(3)
    rows, k = [], 1000
    for n in (1, 2, 3, 12, 60, 150):
        base = prose(r, n, 5000)
        for _ in range(12):
            rows.append((k, edited(r, base, r.choice([0, 0.01, 0.03, 0.06]))))
            k -= 1
    rows += [(3, None), (4, ""), (5, " \n"), (6, "One TWO"), (7, "one\ttwo "), (8, "É é"), (9, "é é"), (6, "One TWO"), (None, "one two"), (None, "lonely row of null")]
    df = spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, kept string")
    want = Counter((i, n, c, i == c) for i, n, c in brute_components(rows, size))
    assert Counter(tuple(x)[:4] for x in near_dups.near_duplicates(df, size=size).collect()) == want
    assert near_dups.near_duplicates(df.limit(0)).collect() == []


def test_large_groups_are_compared_in_blocks(spark):
    r = random.Random(4)
    base = prose(r, 80, 5000)
    rows = [(k, edited(r, base, r.choice([0.02, 0.05, 0.1])) + " " + prose(r, r.randint(0, 30), 5000)) for k in range(150)]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("row", F.encode(F.concat("id", F.lit("")), "UTF-8"))
    signed = near_dups.signatures(df, 2)
    members = signed.select("node", "row", "n", F.lit(b"one").alias("component"))
    node = {x["id"]: bytes(x["node"]) for x in signed.collect()}
    want = {(i, c) for i, _, c in brute_components(rows, 2)}
    assert 20 < len({c for _, c in want}) < 140
    for most, pivots in ((1200, 8), (20, 8), (20, 1), (20, 3)):
        forest = graph.Forest()
        for e in near_dups.verified(members, df, 2, 80, most=most, pivots=pivots).collect():
            forest.join(bytes(e["a"]), bytes(e["b"]))
        low = {}
        for i in sorted(node):
            low.setdefault(forest.root(node[i]), i)
        assert {(i, low[forest.root(n)]) for i, n in node.items()} == want


def test_masks_that_share_a_pivot_are_one_piece(spark):
    df = spark.createDataFrame([(b"x", m) for m in (0, 1, 2, 6, 8, 8)] + [(b"y", 0)], "component binary, mask long")
    got = {(bytes(r["component"]), r["mask"]): r["piece"] for r in near_dups.joined_masks(df).collect()}
    assert got == {(b"x", 0): -1, (b"x", 1): 0, (b"x", 2): 1, (b"x", 6): 1, (b"x", 8): 3, (b"y", 0): -1}


def test_tensored_keys_find_pairs_at_the_threshold():
    r = np.random.default_rng(5)
    missed = 0
    for _ in range(400):
        x = r.integers(0, 1 << 63, 180, np.uint64)
        sets = [np.unique(x[:160]), np.unique(np.concatenate([x[:142], x[160:178]]))]  # 142 of 178: just under 0.8
        a, b = near_dups.keyed(sets)
        missed += not ((a[0] == a[1]).any() and (b[0] == b[1]).any())
    assert missed <= 2


# --- repeated strings ---


def brute_passages(ts, short, words):
    raw = [(t or "").encode() for t in ts]
    count = Counter(b[i : i + short] for b in raw for i in range(len(b) - short + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - short + 1):
            if count[b[i : i + short]] > 1:
                gone[i : i + short] = True
        runs, s = [], None
        for i in range(len(b) + 1):
            if gone[i] and s is None:
                s = i
            if not gone[i] and s is not None:
                runs.append(b[s:i])
                s = None
        runs = [x for x in runs if len(x.split()) >= words]
        out.append((len(runs), sum(map(len, runs))))
    return out


def brute_removed(ts, length):
    raw = [(t or "").encode() for t in ts]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((len(b), int(gone.sum()), int((gone[:1]).sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "core", "most"), [(60, 20, 20_000), (60, 20, 2), (400, 64, 20_000)])
def test_suffix_dedup(spark, length, core, most):
    r = random.Random(6)
    word = lambda: r.choice(["the", "of", f"é{r.randint(0, 99)}", f"q{r.randint(0, 9999)}"])
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(120) for _ in range(4)] + ["a" * 900, "ab" * 500, "line again\n" * 90]
    ts = []
    for _ in range(50):
        t = text(r.randint(0, 200))
        for _ in range(r.randint(0, 3)):
            p = r.choice(shared)
            t = t[: r.randint(0, len(t))] + p[r.randint(0, len(p) // 3) :] + text(r.randint(0, 30))
        ts.append(t)
    ts += [None, "", "x", ts[0], ts[0], shared[0][:length], "q" * (length - 1)]
    rows = [(k, t, 1) for k, t in enumerate(ts)] + [(0, ts[0], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_removed int")
    own = [t for _, t, _ in rows]
    short, words = length * 3 // 5, length // 10
    got = Counter(tuple(x) for x in suffix_dedup.suffix_dedup(df, length=length, core=core, most=most, short=short, words=words).collect())
    assert got == Counter((i, *x, *y) for (i, _, _), x, y in zip(rows, brute_removed(own, length), brute_passages(own, short, words), strict=True))
    assert sum(x[2] for x in got) > 0 and sum(x[5] for x in got) > 0
    assert suffix_dedup.suffix_dedup(df.limit(0)).collect() == []


def test_long_texts_are_sampled_in_parts():
    r = random.Random(13)
    ts = ["".join(r.choice("abc é") for _ in range(n)) for n in (0, 900, 30, 2500, 0, 59, 60)]
    body, bounds = suffix_dedup.raw(suffix_dedup.pa.array(ts))
    spread = lambda a, f, n: {(s + k, x) for x, s, m in zip(a.tolist(), f.tolist(), n.tolist(), strict=True) for k in range(m)}
    whole = spread(*suffix_dedup.runs(body, bounds, 60, 20))
    for part in (64, 100, 777):
        assert spread(*suffix_dedup.all_runs(body, bounds, 60, 20, part)) == whole
    assert len(whole) == sum(max(0, len(t.encode()) - 59) for t in ts)


def test_bands_of_offsets_change_nothing():
    r = random.Random(7)
    common = bytes(r.randint(97, 100) for _ in range(90))
    stretches = [bytes(r.randint(97, 100) for _ in range(30)) + common + bytes(r.randint(97, 100) for _ in range(30)) for _ in range(20)]
    lead, windows = np.full(20, 60), np.full(20, 150 - 50 + 1)
    groups = np.arange(20) % 3
    whole = suffix_dedup.compared(groups, lead, windows, stretches, 50)
    assert whole == suffix_dedup.compared(groups, lead, windows, stretches, 50, at_once=40) and all(whole)


def test_window_hashes_hang_on_the_window_alone():
    r = np.random.default_rng(1)
    window = r.integers(0, 256, 50, np.uint8)
    seen = set()
    for before, after in ((0, 0), (7, 0), (0, 9), (300, 1000)):
        body = np.concatenate([r.integers(0, 256, before, np.uint8), window, r.integers(0, 256, after, np.uint8)])
        seen.add(tuple(int(suffix_dedup.window_hashes(body, np.array([before]), 50, w)[0]) for w in (0, 1)))
    assert len(seen) == 1


def test_levels_merge_geometrically(spark, tmp_path):
    r = random.Random(15)
    shared = [prose(r, 60) for _ in range(5)]
    rows = [(k, f"{prose(r, 40)} {r.choice(shared)} {prose(r, 20)}") for k in range(140)]
    df = spark.createDataFrame(rows, "id long, text string").select(F.col("id"), F.unhex(F.lpad(F.hex("id"), 16, "0")).alias("row"), "text")
    spans = lambda family: {(bytes(x["row"]), s["at"] + k, s["kind"]) for x in family.spans(df).collect() for s in x["spans"] for k in range(s["windows"])}
    seen, ranks = [], []
    for k in range(7):  # opened anew for each batch, as a later run would
        suffix_dedup.Family(spark, f"{tmp_path}/one", 60, 20).add(df.where(f"id % 7 = {k}").select("row", "text"))
        ranks.append([rank for rank, _, _ in suffix_dedup.Family(spark, f"{tmp_path}/one", 60, 20).levels])
    assert ranks == [[0], [1], [1, 0], [2], [2, 0], [2, 1], [2, 1, 0]]
    seen = suffix_dedup.Family(spark, f"{tmp_path}/one", 60, 20)
    level = seen.levels[0][1]
    for at in pathlib.Path(level).glob("*.parquet"):  # every bucket is an array in order
        keys = pq.read_table(at).select(suffix_dedup.KEY).to_pylist()
        assert [tuple(x.values()) for x in keys] == sorted({tuple(x.values()) for x in keys})
    whole = suffix_dedup.Family(spark, f"{tmp_path}/two", 60, 20)
    whole.add(df.select("row", "text"))
    assert spans(seen) == spans(whole) and len(spans(whole)) > 1000
    wanted = [(i, removed) for (i, _), (_, removed, _, _) in zip(rows, brute_removed([t for _, t in rows], 60), strict=True)]
    assert sum(x for _, x in wanted) > 0 and {i for i, x in wanted if x} == {int.from_bytes(row, "big") for row, _, _ in spans(seen)}
    assert not spark.catalog.listTables()


# --- quality ---


def brute_counts(t):
    t = t or ""
    w = WORDS.findall(t)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    c, covered, seen, dup = Counter(grams), set(), set(), 0
    for i, g in enumerate(grams):
        if c[g] > 1:
            covered.update(range(i, i + 5))
    for line in t.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_exact_counts(spark):
    r = random.Random(8)
    ts = [None, "", " ", "\n\n", "a", "a b c d e", "a b c d e f a b c d e", "a a a a a a a", "l\nl\n \n \nm\nl", "\x0b\x1f\xa0 ü#*$"]
    ts += ["".join(r.choice(" \n\t\x0b\x0c\r\x1c aab#|é\xa0") for _ in range(r.randint(0, 120))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(ts)), "k long, text string")
    got = {x["k"]: tuple(x[c] for c in COUNTS) for x in counted(df).collect()}
    assert got == {k: brute_counts(t) for k, t in enumerate(ts)}


def test_outliers_go_and_prose_stays(spark):
    r = random.Random(9)
    vocabulary = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8))) for _ in range(800)]
    clean = lambda: ". ".join(" ".join(r.choice(vocabulary) for _ in range(12)).capitalize() for _ in range(r.randint(2, 40))) + "."
    rows = [(k, clean(), "en", "hot" if k % 3 else f"s{k % 7}") for k in range(600)]
    rows += [(1000 + k, " ".join(x + "###" for x in clean().split()), "en", "hot") for k in range(40)]
    rows += [(2000 + k, clean().upper().replace(" ", "!! "), "en", "hot") for k in range(40)]
    rows += [(3000, None, "en", "hot"), (3001, clean(), None, None), (3002, clean(), None, None), (0, rows[0][1], "en", rows[0][3])]
    df = spark.createDataFrame([(*x, 7) for x in rows], "doc_id long, text string, lang string, source string, n_words int")
    got = quality_rules(df).collect()
    assert len(got) == len(rows)
    kept = {x["doc_id"]: x["kept"] for x in got}
    assert sum(kept[k] for k in range(600)) >= 598
    assert not any(kept[k] for k in kept if 1000 <= k < 3000) and not kept[3000] and kept[3001]
    assert [tuple(x) for x in quality_rules(df).orderBy("doc_id").collect()] == sorted((tuple(x) for x in got), key=lambda x: x[0])
    assert quality_rules(df.limit(0)).collect() == []


def test_groups_with_much_junk_lose_it(spark):
    r = random.Random(14)
    vocabulary = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8))) for _ in range(800)]
    clean = lambda: ". ".join(" ".join(r.choice(vocabulary) for _ in range(12)).capitalize() for _ in range(r.randint(2, 40))) + "."
    junk = {(s, k) for s in (30, 45) for k in range(4 * s)}
    rows = [(f"{s}-{k}", " ".join(x + "###" for x in clean().split()) if (s, k) in junk else clean(), "en", f"s{s}") for s in (30, 45) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string")
    kept = {x["doc_id"] for x in quality_rules(df).collect() if x["kept"]}
    assert not kept & {f"{s}-{k}" for s, k in junk} and len(kept) >= 800 - len(junk) - 4


def test_quality_model(spark):
    r = random.Random(10)
    rows, labels = [], []
    for k in range(1500):
        good = r.random() < 0.7
        words = [r.choice(["tale", "river", "Stone", "walk,", "green.", "home"]) for _ in range(r.randint(5, 300))]
        if not good:
            at = r.randrange(len(words))
            words[at : at + 70] = [w + "$$$" for w in words[at : at + 70]]
        rows.append((k, " ".join(words), 0))
        labels.append((k, int(good)))
    rows += [(None, None, 0), (5000, "", 0), (0, rows[0][1], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    marks = spark.createDataFrame([*labels, (None, 1), (3, None), (99999, 0)], "doc_id long, quality int")
    got = quality_model.quality_scores(docs, marks).collect()
    truth = dict(labels)
    held = [x for x in got if x["held_out"]]
    assert len(got) == len(rows) and 200 < len(held) < 400
    assert np.mean([x["predicted"] == truth[x["doc_id"]] for x in held if x["doc_id"] in truth]) > 0.95
    assert all(0 <= x["score"] <= 1 for x in got)
    assert {x["score"] for x in quality_model.quality_scores(docs, marks.limit(0)).collect()} == {0.5}
    assert quality_model.quality_scores(docs.limit(0), marks).collect() == []


def brute_score(w, mean, scale, bag):
    """One document's score, passage by passage."""
    dot = lambda v, m: [sum(v[i] * m[i][j] for i in range(len(v))) for j in range(len(m[0]))]
    coded, logits = [], []
    for x in bag:
        x = [min(8, max(-8, (v - m) / s)) for v, m, s in zip(x, mean, scale, strict=True)]
        h = [math.tanh(v + f) for v, f in zip(dot(x, w["e"]), w["f"], strict=True)]
        gated = [math.tanh(v) / (1 + math.exp(-u)) for v, u in zip(dot(h, w["v"]), dot(h, w["u"]), strict=True)]
        coded.append(h)
        logits.append(dot(gated, w["a"])[0])
    weights = [math.exp(e - max(logits)) for e in logits]
    z = [sum(a * h[k] for a, h in zip(weights, coded, strict=True)) / sum(weights) for k in range(len(coded[0]))]
    return 1 / (1 + math.exp(-dot(z, w["o"])[0] - w["b"][0]))


def test_model_against_brute_force():
    r = np.random.default_rng(11)
    count = np.array([3, 1, 4])
    x = r.normal(size=(8, quality_model.DIMS)).astype(np.float32)
    y = np.array([0, 1, 1], np.float32)
    model = quality_model.AttentionModel()
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-3
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    bags = np.split(x.astype(float), np.cumsum(count)[:-1])
    plain = {k: v.tolist() for k, v in model.w.items()}
    assert np.allclose(model.score(x, count), [brute_score(plain, model.mean.tolist(), model.scale.tolist(), b.tolist()) for b in bags], atol=1e-6)

    def loss():
        p = model.score(x.astype(np.float64), count)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grad = model.gradients(x.astype(np.float64), count, y)
    for name, w in model.w.items():
        for at in r.integers(0, w.size, 12):
            i, step = np.unravel_index(at, w.shape), 1e-5
            own = w[i]
            w[i] = own + step
            up = loss()
            w[i] = own - step
            down = loss()
            w[i] = own
            assert abs(grad[name][i] - (up - down) / (2 * step)) < 1e-5, name
    before = loss()
    model.fit(x, count, y, epochs=60)
    assert loss() < 0.2 * before


def test_sample_is_bounded_by_passages(spark):
    docs = spark.createDataFrame([(k, "word " * 640, "x") for k in range(40)] + [(3, "zzz " * 640, "x")], "doc_id long, text string, label string")
    marks = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    sizes = []
    own = quality_model.AttentionModel.fit
    try:
        quality_model.AttentionModel.fit = lambda self, x, count, y: sizes.append((len(count), len(x))) or self
        for most in (55, 10**6):
            quality_model.fitted(docs, marks, sample_passages=most)
    finally:
        quality_model.AttentionModel.fit = own
    assert sizes[0] == (5, 50) and sizes[1][1] == 10 * sizes[1][0] > 200


# --- pipeline ---


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(12)
    bench = [(0, prose(r, 30, 9000))]
    passage = prose(r, 110, 9000)
    docs = [(k, prose(r, 150, 9000)) for k in range(80)]
    docs += [(100, docs[3][1]), (101, edited(r, docs[4][1], 0.01)), (102, prose(r, 60, 9000) + " " + bench[0][1]), (103, " ".join(w + "***" for w in docs[5][1].split()))]
    docs += [(110, prose(r, 60, 9000) + " " + passage), (111, passage + " " + prose(r, 60, 9000)), (112, None)]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        at = f"{tmp_path}/{k}"
        stage(spark, kept, str(tmp_path)).write.parquet(at)
        kept = spark.read.parquet(at)
        ids.append({x["doc_id"] for x in kept.select("doc_id").collect()})
        if k < 4:
            assert kept.columns == table.columns
        if k == 2:
            text = {x["doc_id"]: x["text"] for x in kept.collect()}
            assert passage[20:-20] not in text[110] and passage[20:-20] not in text[111] and text[7] == docs[7][1]
    clean = set(range(80))
    assert ids[0] == {i for i, _ in docs} - {103, 112}
    assert ids[1] == ids[0] - {100, 101}
    assert ids[2] == ids[1] and ids[3] == ids[2] - {102} and ids[4] == ids[3] and clean <= ids[4]
    assert {x["doc_id"] for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == ids[4]


@pytest.mark.parametrize("case", ["no documents", "no benchmark", "odd rows"])
def test_pipeline_of_odd_tables(spark, tmp_path, case):
    import corpus_pipeline

    r = random.Random(17)
    good = [(k, prose(r, 40, 9000)) for k in range(30)]
    long = (50, prose(r, 30_000, 90_000))
    odd = [(None, None), (None, good[1][1]), (7, ""), (7, good[7][1]), (60, " \n"), long, (51, long[1])]
    docs = {"no documents": [], "no benchmark": good, "odd rows": good + odd}[case]
    bench = {"no documents": [(1, "a b c")], "no benchmark": [], "odd rows": [(1, None), (None, ""), (2, good[2][1])]}[case]
    table = spark.createDataFrame([(i, t, None if k % 5 == 0 else "en", "s", None, "x", 1, "y") for k, (i, t) in enumerate(docs)], "doc_id long, text string, lang string, source string, n_chars long, kept string, row int, spans string")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {x["doc_id"]: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    want = {"no documents": set(), "no benchmark": set(range(30)), "odd rows": set(range(30)) - {2} | {50}}[case]
    assert set(got) == want


def test_every_operator_has_its_query():
    import __spark_entry__

    names = {n.split("_")[0] for n in __spark_entry__.queries() if re.match(r"op\d+_", n)}
    assert names == {f"op{k}" for k in range(1, 11)} and "pipeline" in __spark_entry__.queries()
