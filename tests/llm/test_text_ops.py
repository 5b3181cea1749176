"""Token counts, packing, HTML text, archives and chat against brute force."""

import hashlib
import io
import json
import random
import struct
import time
import zipfile
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from quarry.llm import html_text, packing, warc
from quarry.llm import token_counts as token_counts_module
from quarry.llm.chat import chat_format
from quarry.llm.token_counts import PieceCounter, token_counts

WORD, PIECE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "piece_bpe_32k.model"))
DOCS = "doc_id long, text string, id string, n_tokens int"


def strings(seed, n=3000):
    r = random.Random(seed)
    letters = " " * 6 + "abTHEéßxyz\n\t.,1'日▁<s>\0\x1c-İΣ"
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(n)] + ["", " ", "  ", "a ", " a", "▁", "<|endoftext|>x", "it's", "a" * 5000, "<unk> <s>"]


def test_piece_counts_equal_the_library():
    counter = PieceCounter(PIECE)
    ts = strings(1)
    assert counter.count(pa.array(ts)).tolist() == [len(x) for x in counter.model.encode(ts)]


def test_ids_equal_the_library():
    encoder = packing.Encoder.of(WORD)
    ts = strings(2) + ["the Thing's ###", "ÀÉ!! don't"]
    ids, at = encoder.encode(pa.array(ts))
    for k, e in enumerate(encoder.model.encode_batch(ts, add_special_tokens=False)):
        assert ids[at[k] : at[k + 1]].tolist() == e.ids


def test_ids_stay_right_chunk_after_chunk(monkeypatch):
    from tokenizers import Tokenizer

    r = random.Random(16)
    encoder, counter = packing.Encoder(WORD), PieceCounter(PIECE)
    monkeypatch.setattr(token_counts_module, "REMEMBERED", 40)
    model = Tokenizer.from_file(WORD)
    for _ in range(12):
        ts = [" ".join("".join(r.choice("abcdeü.#") for _ in range(r.randint(1, 6))) for _ in range(r.randint(0, 30))) for _ in range(5)]
        ids, bounds = encoder.encode(pa.array(ts))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [model.encode(t, add_special_tokens=False).ids for t in ts]
        assert counter.count(pa.array(ts)).tolist() == [len(counter.model.encode(t)) for t in ts]


def test_token_counts_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x", 0), (None, "a b", None, 1), (2, "", "", 2), (1, "a b", "", 3), (1, "a b", "", 3)], DOCS)
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts(df, PIECE, limit=1).collect())
    assert got == [("1", 0, 0, False), ("1", 3, 2, True), ("1", 3, 2, True), ("2", 0, 0, False), ("None", 3, 2, True)]
    assert token_counts(df.limit(0), PIECE).collect() == []


def placed(rows, size):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        place = 0
        for offset, length in sorted(b):
            assert offset == place
            place += length
        assert place <= size
    return len(bins)


def test_packing_places_every_piece_once(spark):
    r = random.Random(3)
    rows = [(k, " ".join("word" for _ in range(r.choice([0, 3, 20, 31, 40, 90])))) for k in range(300)] + [(300, None), (7, "word"), (7, "word"), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.best_fit_packing(df, WORD, 64, shard=50, population=4, generations=3).collect()
    lengths = defaultdict(int)
    for x in got:
        lengths[x["doc_id"]] += x["length"]
    assert lengths[300] == 1 and lengths[None] == 2 and lengths[0] == len(rows[0][1].split()) + 1
    assert len(got) == sum(-(-(len((t or "").split()) + 1) // 64) for _, t in rows)
    n, bound = placed(got, 64), -(-sum(x["length"] for x in got) // 64)
    assert n <= bound * 1.1 + 6
    first = next(x for x in got if x["doc_id"] == 300)
    assert first["ids_crc32"] == zlib.crc32(struct.pack("<I", 0))
    assert packing.best_fit_packing(df.limit(0), WORD).collect() == []


def test_islands_better_best_fit():
    r = random.Random(5)
    lengths = [r.choice([26, 27, 33, 34, 40, 47, 53, 60]) for _ in range(240)]
    plain = packing.Packing(lengths, 100)
    plain.best_fit(packing.decreasing(list(range(len(lengths))), lengths))
    assigned, n, _ = packing.evolve(lengths, 100, 1, [], 8, 25)
    assert n < len(plain.bins)  # breeding beats best-fit, and from random orders
    fill = np.bincount(assigned, weights=lengths)
    assert fill.max() <= 100 and len(fill) == n
    again = packing.evolve(lengths, 100, 1, [], 8, 25)
    assert again[0] == assigned  # the same after a lost executor
    assert packing.evolve(lengths, 100, 2, [assigned], 3, 2)[1] <= n  # a guest is never lost
    a, b = plain, packing.Packing(lengths, 100, [[i for i, x in enumerate(assigned) if x == k] for k in range(n)])
    child = packing.crossed(a, b, np.random.default_rng(0))
    assert sorted(i for x in child.bins for i in x) == list(range(len(lengths)))


def test_triplets_are_packed_better_than_best_fit():
    r = np.random.default_rng(3)
    lengths = []
    for _ in range(80):  # three items fill a bin exactly
        a = int(r.integers(380, 490))
        b = int(r.integers(250, (1000 - a) // 2 + 1))
        lengths += [a, b, 1000 - a - b]
    plain = packing.Packing(lengths, 1000)
    plain.best_fit(packing.decreasing(list(range(240)), lengths))
    assert packing.evolve(lengths, 1000, 1, [], 4, 40)[1] <= len(plain.bins) - 6
    assert packing.evolve(lengths, 1000, 1, [], 4, 0, last=True)[1] <= len(plain.bins)


def test_shards_share_their_emptiest_bins(spark):
    r = random.Random(15)
    parts = [(k, 0, 0, r.randint(1, 60), 0) for k in range(900)]
    df = spark.createDataFrame(parts, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.packed(df, 64, shard=40, pooled=5, loose=4).collect()
    assert sorted(x["doc_id"] for x in got) == list(range(900))
    alone = packing.packed(df, 64, shard=40, pooled=5, loose=0).collect()
    assert placed(got, 64) < placed(alone, 64)


def test_html_blocks():
    page = '<title>t</title><script>var a="<p>no</p>"</script><!-- no --><div class="ad">x</div><article><h1>A&amp;B</h1><p><b>one<br>two<p>three &lt;3 <a href="x>y">l</a></article>'
    got = html_text.blocks(page)
    assert [b.text for b in got] == ["t", "x", "A&B", "one two", "three <3 l"]
    assert got[1].path.name == "div ad" and got[-1].path.above.name == "article " and got[-1].linked == 1
    for odd in ("", "<", "<p", "a<b", "</p>", "<p title='", "<!--", "<script>"):
        html_text.blocks(odd)


@pytest.mark.parametrize(
    "page",
    ["<a " * 60_000, "<div>" * 40_000 + "x", "<div>x" * 30_000, "<p>x<span>" * 20_000, "</i>" * 40_000, "<b>" * 20_000 + "</i>" * 20_000, '<a title="' * 20_000 + ">", "<a \">\" " * 20_000, "<!-- " * 40_000,
     "<script></script " * 20_000 + ">", "<li>" * 30_000, "<ul><li>y" * 15_000, "<svg>" * 30_000, "</svg " * 30_000, "&" * 200_000, "<table><td>" * 15_000, "word " * 400_000],
)
def test_awkward_pages_take_time_in_proportion(page):
    root = html_text.Step(None, "")
    began = time.process_time()
    html_text.vectors(html_text.blocks(page, root))
    assert time.process_time() - began < 6  # about 100,000 tags; a quadratic cutter takes minutes


@pytest.mark.parametrize(
    "lead",
    ['<header><svg-icon name="x"></svg-icon></header>', "<template-card></template-card>", "<style-guide></style-guide>", '<a><svg class="i"/></a>', "<svg><path>", "<noscript>", "<template>", "<svg/><svg><text>no</text></svg>", "<SVG a='>'>no</svg ><svg>"],
)
def test_skipped_elements_end_where_they_should(lead):
    assert [b.text for b in html_text.blocks(f"{lead}<article><p>Main text</p></article>")] == ["Main text"]


def test_labeller_on_pages_it_has_not_seen():
    net = html_text.trained()
    r = np.random.default_rng(1234)
    pages = [html_text.made_page(r) for _ in range(120)]
    labels = net.label([html_text.vectors([b for b, _ in p]) for p in pages])
    right = [bool(x) == m for p, found in zip(pages, labels, strict=True) for (_, m), x in zip(p, found, strict=True)]
    assert np.mean(right) > 0.98


#: Pages written by hand in layouts that the generator doesn't make: source, main blocks.
BY_HAND = [
    (
        """<!DOCTYPE html><html lang=en><head><title>Harbour news</title><meta charset=utf-8></head><body class="home wp-custom">
<div id="page"><header class="site-header"><div class="logo"><a href="/">Harbour</a></div><nav class="main-navigation"><ul><li><a href="/a">News</a></li><li><a href="/b">Sport</a></li></ul></nav></header>
<main id="main"><article class="post-12 post type-post"><h1 class="entry-title">Bridge opens after two years</h1>
<div class="entry-content"><p>The new bridge over the harbour was opened on Monday by the mayor, two years after work began.</p>
<p>Some four hundred people walked across in the first hour, and the ferry will run until the end of the month.</p>
<div class="advertisement">Best prices for boots, order today!</div>
<h2>What comes next</h2><p>The council will decide in spring whether cars may use it at night.</p></div></article>
<section id="comments" class="comments-area"><h3>3 replies</h3><ol><li class="comment"><p>Great news, finally!</p></li></ol></section></main>
<aside id="secondary" class="widget-area"><h3>Recent posts</h3><ul><li><a href="/1">Old pier sold</a></li></ul></aside>
<footer class="site-footer"><p>Copyright 2024 Harbour Media. All rights reserved.</p></footer></div><script>track()</script></body></html>""",
        ["Bridge opens after two years", "The new bridge over the harbour was opened on Monday by the mayor, two years after work began.", "Some four hundred people walked across in the first hour, and the ferry will run until the end of the month.", "What comes next", "The council will decide in spring whether cars may use it at night."],
    ),
    (
        """<html><body><div class="topbar menu"><a href=/x>Docs</a> <a href=/y>Blog</a></div><div class="sidebar"><ul><li><a href=1>Install</a><li><a href=2>Usage</a></ul></div>
<div class="content"><h1>Reading a file</h1><p>Open the file first, then read it line by line. The handle is closed at the end of the block.</p>
<pre>with open(name) as f: print(f.read())</pre><ul><li>Small files can be read at once.</li><li>Large ones should be read in pieces.</li></ul>
<p>See also the <a href=/io>chapter on streams</a> for network sources.</p></div><div class="footer">&copy; The authors &middot; <a href=/p>Privacy</a></div></body></html>""",
        ["Reading a file", "Open the file first, then read it line by line. The handle is closed at the end of the block.", "with open(name) as f: print(f.read())", "Small files can be read at once.", "Large ones should be read in pieces.", "See also the chapter on streams for network sources."],
    ),
    (
        """<body><div class="cookie-notice">We use cookies to improve the site. <button>Accept</button></div><nav><a href=/>Start</a></nav><article><header><h1>Ein Tag am See</h1></header>
<p>Am fr&uuml;hen Morgen lag der Nebel noch &uuml;ber dem Wasser, und niemand war am Ufer zu sehen.</p><p>Gegen Mittag kamen die ersten G&auml;ste aus der Stadt.</p>
<form class="newsletter"><label>E-Mail</label><input><button>Abonnieren</button></form><p>Am Abend war es wieder still.</p></article><footer>Impressum</footer></body>""",
        ["Am frühen Morgen lag der Nebel noch über dem Wasser, und niemand war am Ufer zu sehen.", "Gegen Mittag kamen die ersten Gäste aus der Stadt.", "Am Abend war es wieder still."],
    ),
]


@pytest.mark.parametrize("n", range(len(BY_HAND)))
def test_labeller_on_pages_by_hand(n):
    source, main = BY_HAND[n]
    found = html_text.blocks(source)
    (kept,) = html_text.trained().label([html_text.vectors(found)])
    got = [b.text for b, k in zip(found, kept, strict=True) if k]
    assert [x for x in got if x in main] == main
    assert [x for x in got if x not in [*main, "Ein Tag am See"]] == []


def test_main_text(spark):
    nav, foot = "<nav><ul><li><a href=/a>aa</a><li><a href=/b>bb</a></ul></nav>", "<footer>&copy; site</footer>"
    body = f"<html><body>{nav}<div class=ad>Buy this now.</div><article><h1>Title here</h1><p>First  para\n of text, long enough.</p><p>Second &eacute; one.</p></article>{foot}</body></html>"
    df = spark.createDataFrame([(1, "u", body, "x"), (2, None, None, "x"), (None, "v", "", "x"), (1, "u", body, "x")], "page_id long, url string, html string, text string")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html_text.main_text(df).collect()]
    want = "Title here\n\nFirst para of text, long enough.\n\nSecond é one."
    assert got == [(1, want, len(want)), (2, "", 0), (None, "", 0), (1, want, len(want))]


def test_archives_round_trip(spark):
    big, small = "<p>é</p>" * 30, "<p>tiny</p>"
    rows = [(5, "u 1", big), (3, None, big), (9, "u", big), (4, "x", small), (6, "x", small), (7, None, None), (8, "y", "a" * 100_000), (3, None, big), (None, "n", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(map(tuple, warc.round_trip(df).collect()), key=str)

    def row(k, html, kind="response", to=None):
        raw = (html or "").encode()
        return k, len(raw), hashlib.sha256(raw).hexdigest(), kind, to

    want = [row(5, big, "revisit", 3), row(3, big), row(9, big, "revisit", 3), row(4, small), row(6, small), row(7, None), row(8, "a" * 100_000), row(3, big), row(None, big, "revisit", 3)]
    assert got == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).collect() == []
    rows = [{**r.asDict(), "kind": "x"} for r in df.collect()]
    one, two = (sorted(map(str, warc.deduplicated(df, few=n).collect())) for n in (0, 10**6))
    assert one == two and len(one) == len(rows)


def test_ids_of_text_come_back_as_they_were(spark):
    ids = ["a b", "a  b", "", " ", "x%20y", "é\r\nInjected: 1", None, "100%"]
    df = spark.createDataFrame([(i, "http://h/a b\n", "<p>" + "same " * 40, 0) for i in ids], "page_id string, url string, html string, refers_to int")
    got = [(x["page_id"], x["record_type"], x["refers_to"]) for x in warc.round_trip(df).collect()]
    assert sorted(got, key=str) == sorted([(i, "response" if i == "" else "revisit", None if i == "" else "") for i in ids], key=str)


def test_zip_directories():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.comment = b"PK\5\6 not the end"
        z.writestr("é.txt", "one")
        z.writestr("packed", "x" * 999, zipfile.ZIP_DEFLATED)
        with z.open("wide", "w", force_zip64=True) as f:
            f.write(b"two")
    raw = out.getvalue()
    members = warc.directory(io.BytesIO(raw), len(raw))
    assert [(m.name, raw[m.start : m.start + m.size]) for m in members] == [("é.txt", b"one"), ("wide", b"two")]
    with pytest.raises(ValueError):
        warc.directory(io.BytesIO(b"no archive"), 10)


def test_zip64_end_records():
    """A package whose sizes and places stand in the ZIP64 records only."""
    full, wide = 0xFFFFFFFF, 0xFFFF
    local = struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 0, 0, 0, 0, 0, full, full, 1, 0) + b"m"
    body = b"payload"
    extra = struct.pack("<HHQQQ", 1, 24, len(body), len(body), 0)
    central = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 0, 0, 0, 0, 0, full, full, 1, len(extra), 0, 0, 0, 0, full) + b"m" + extra
    at = len(local) + len(body)
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, 1, 1, len(central), at)
    locator = struct.pack("<4sIQI", b"PK\6\7", 0, at + len(central), 1)
    end = struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, wide, wide, full, full, 0)
    raw = local + body + central + end64 + locator + end
    (m,) = warc.directory(io.BytesIO(raw), len(raw))
    assert (m.name, raw[m.start : m.start + m.size]) == ("m", body)


def test_chat(spark):
    tools = {"tools": [{"name": "add", "parameters": {"properties": {"a": {"type": "number"}, "b": {"type": "integer"}}, "required": ["a", "b"]}}]}
    call = lambda i, **a: {"id": i, "name": "add", "arguments": a}
    rows = [
        (1, 0, "system", json.dumps(tools)), (1, 1, "user", 'say "x"\n é'),
        (1, 2, "assistant", json.dumps({"content": "now", "tool_calls": [call("c2", b={"$ref": "c1"}, a=1.50), call("c1", b=2, a=1)]})),
        (1, 3, "tool", json.dumps({"tool_call_id": "c2", "content": {"z": 1, "a": []}})), (1, 5, "tool", json.dumps({"tool_call_id": "c1", "content": "3"})),
        (1, 6, "tool", json.dumps({"tool_call_id": "c1", "content": "4"})), (1, 7, "tool", json.dumps({"tool_call_id": "zz"})),
        (1, 8, "assistant", json.dumps({"tool_calls": [call("d", b="no", q=1), {"id": "e", "name": "nope", "arguments": {}}, call("f", a={"$ref": "g"}, b=1), call("g", a={"$ref": "f"}, b=1), call("h", a=1, b=1), call("h", a=1, b=1)]})),
        (1, 9, "assistant", "{broken"), (2, 0, "user", None), (2, None, None, "x"), (None, 1, "assistant", json.dumps({"tool_calls": [{"id": None, "name": "add"}]})),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, json int")
    got = chat_format(df).collect()
    by = {(r["kind"], r["call_id"], r["turn"], r["part"]): r for r in got if r["conv_id"] == 1}
    assert len(got) == 6 + 9 + 4  # messages with content of their own, calls, results
    status = {k: r["status"] for k, r in by.items() if k[0] != "message"}
    assert status == {
        ("call", "c1", 2, 1): "ok", ("call", "c2", 2, 0): "ok", ("result", "c1", 5, 1): "ok", ("result", "c1", 6, 1): "repeated", ("result", "c2", 3, 0): "ok", ("result", "zz", 7, 0): "no call",
        ("call", "d", 8, 0): "invalid: missing a; type of b; unknown q", ("call", "e", 8, 1): "invalid: undeclared tool", ("call", "f", 8, 2): "cyclic", ("call", "g", 8, 3): "cyclic",
        ("call", "h", 8, 4): "duplicate id", ("call", "h", 8, 5): "duplicate id",
    }
    order = sorted(by.values(), key=lambda r: (r["at_turn"], r["level"], r["part"], r["turn"], r["json"]))
    names = [(r["kind"], r["call_id"]) for r in order]
    assert names.index(("call", "c1")) < names.index(("result", "c1")) < names.index(("call", "c2")) < names.index(("result", "c2"))
    assert by["call", "c2", 2, 0]["json"] == '{"arguments":{"a":1.5,"b":{"$ref":"c1"}},"id":"c2","name":"add","role":"assistant"}'
    assert by["result", "c2", 3, 0]["json"] == '{"content":{"a":[],"z":1},"role":"tool","tool_call_id":"c2"}'
    for r in got:
        assert json.dumps(json.loads(r["json"]), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r["json"]
    assert chat_format(df.limit(0)).collect() == []


def test_chat_json_behind_white_space(spark):
    lead = "\n\t\r "
    rows = [(1, 0, "system", lead + '{"tools": [{"name": "f", "parameters": {}}]}'), (1, 1, "assistant", lead + '{"tool_calls": [{"id": "a", "name": "f", "arguments": {}}]}'), (1, 2, "tool", lead + '{"tool_call_id": "a", "content": 1}')]
    got = chat_format(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r["kind"], r["status"]) for r in got) == [("call", "ok"), ("message", "ok"), ("result", "ok")]


def test_chat_schemas(spark):
    tool = lambda name, more=None, **p: {"name": name, "parameters": {"type": "object", "properties": p, **(more or {})}}
    tools = [tool("f", e={"enum": ["a", 1, None]}, c={"const": "x"}, t={"type": ["string", "null"]}), tool("g", {"additionalProperties": True}), tool("n", o={"type": "object", "properties": {"k": {"type": "string"}}}, r={"type": "integer", "minimum": 3})]
    calls = [("f", {"e": "a", "c": "x", "t": None}), ("f", {"e": 1, "t": "s"}), ("f", {"e": "b"}), ("f", {"c": "y"}), ("f", {"t": 1}), ("f", {"e": None}), ("g", {"q": 1}), ("n", {"o": {"k": 1}, "r": 1}), ("n", {}), ("n", {"r": "x"}), ("n", {"r": {"$ref": "0"}})]
    rows = [(1, 0, "system", json.dumps({"tools": tools})), (1, 1, "assistant", json.dumps({"tool_calls": [{"id": str(k), "name": n, "arguments": a} for k, (n, a) in enumerate(calls)]}))]
    rows += [(1, 2 + k, "tool", json.dumps({"tool_call_id": str(k)})) for k in range(len(calls))]
    got = chat_format(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("kind = 'call'").collect()
    want = ["ok", "ok", "invalid: value of e", "invalid: value of c", "invalid: type of t", "ok", "ok", "not validated: minimum of r; properties of o", "ok", "invalid: type of r", "ok"]
    assert [r["status"] for r in sorted(got, key=lambda r: int(r["call_id"]))] == want
