"""Main text of HTML pages by a recurrent block labeller.

A page is cut into leaf blocks.  Each block gets a vector: hashed elements and class names of
its tag path, hashed words, and a few rates.  A bidirectional LSTM in numpy reads a page's blocks in order and
labels every one, so a block's label depends on the whole page.  The weights are learned here
from ``PAGES`` generated pages, whose blocks are known by construction; the bound is a parameter and the seed is fixed.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import chunks

PAGES, EPOCHS, HIDDEN = 480, 14, 20
PATH_DIMS, WORD_DIMS, RATES = 192, 24, 8
DIMS = PATH_DIMS + WORD_DIMS + RATES
#: Pieces of a page; no part of an expression gives back what it took, so that none is read twice.
PIECE = (
    r"""<!--.*?(?:-->|(?P<cut>\Z))|<(?P<raw>script|style|textarea|iframe)(?=[\s/>])[^>]*+>.*?(?:</(?P=raw)(?=[\s/>])[^>]*+>|(?P<cut_raw>\Z))"""
    r"""|<(?P<shut>/?)(?P<tag>[a-z][^\s/>]*+)(?P<rest>{})>|<[!?/][^>]*+>|[^<]++|<"""
)
QUOTED = re.compile(PIECE.format(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""), re.I | re.S)
#: For the rest of a page after a quotation mark in a tag that nothing closes.
UNQUOTED = re.compile(PIECE.format(r"[^>]*+"), re.I | re.S)
#: What follows the last tag.
TAIL = re.compile(r"(?P<tag>(?!))?(?:[^<]+|<)")
BEGINS = re.compile(r"</?[a-z]", re.I)
#: Elements without text of the page; one that isn't closed loses its tag only.
SKIPPED = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in ("template", "noscript", "svg")}
NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element that starts ends an open one of these, if no such border lies between.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"})}
ENDS |= dict.fromkeys("p div ul ol dl table form article section aside nav header footer main h1 h2 h3 h4 h5 h6 blockquote pre figure hr fieldset".split(), ({"p"}, {"button", "td", "th", "table"}))


class Step:
    """A place among elements: the block elements from the root to here, shared by all blocks below."""

    __slots__ = ("above", "below", "name", "own")

    def __init__(self, above: Step | None, name: str):
        self.above, self.name = above, name
        self.below: dict[str, Step] = {}
        self.own: np.ndarray | None = None

    def to(self, name: str) -> Step:
        if (step := self.below.get(name)) is None:
            step = self.below[name] = Step(self, name)
        return step

    def vector(self) -> np.ndarray:
        """The hashed elements and class names on the way, each step's added to its parent's once."""
        way, at = [], self
        while at is not None and at.own is None:
            way.append(at)
            at = at.above
        for step in reversed(way):
            step.own = np.zeros(PATH_DIMS, np.float32) if step.above is None else step.above.own.copy()
            if step.above is not None:
                step.own[list(marks(step.name))] = 1
        return self.own


@lru_cache(4096)
def marks(name: str) -> frozenset[int]:
    """The buckets of an element, its names and their first letters."""
    tag, _, names = name.partition(" ")
    names = {x for x in re.split(r"[\s_-]+", names) if x}
    return frozenset(zlib.crc32(x.encode()) % PATH_DIMS for x in {tag} | {f".{x}" for x in names} | {f".{x[:6]}~" for x in names if len(x) >= 6})


class Block(NamedTuple):
    path: Step
    text: str
    linked: int


def tokens(page: str) -> Iterator[re.Match]:
    """The page's tokens outside of skipped elements, in time proportional to its length; what follows its last ``>`` is text."""
    last, at, pattern = page.rfind(">") + 1, 0, QUOTED
    unclosed: set[str] = set()
    while True:
        for m in pattern.finditer(page, at, last):
            tag = (m["tag"] or "").lower()
            if m["cut"] is not None or m["cut_raw"] is not None:
                return
            if m[0] == "<" and pattern is QUOTED and BEGINS.match(page, m.start()):
                at, pattern = m.start(), UNQUOTED
                break
            if tag not in SKIPPED:
                yield m
            elif not m["shut"] and tag not in unclosed and not (tag == "svg" and m["rest"].endswith("/")):
                if end := SKIPPED[tag].search(page, m.end(), last):
                    at = end.end()
                    break
                unclosed.add(tag)
        else:
            break
    yield from TAIL.finditer(page, max(at, last))


def blocks(page: str, root: Step | None = None) -> list[Block]:
    """The page's non-empty leaf blocks in order, character references decoded, white space made single."""
    out: list[Block] = []
    here = root or Step(None, "")
    stack: list[tuple[str, Step]] = []
    opened: dict[str, list[int]] = {}
    held: list[str] = []
    linked = 0
    last = lambda names: max((opened[t][-1] for t in names if opened.get(t)), default=-1)

    def flush() -> None:
        nonlocal held, linked
        if held:
            if text := " ".join(html.unescape("".join(held)).split()):
                out.append(Block(here, text, linked))
            held, linked = [], 0

    def shut(k: int) -> None:
        nonlocal here
        goes = stack[k:]
        if any(t not in INLINE for t, _ in goes):
            flush()
        here = goes[0][1]
        for t, _ in goes:
            opened[t].pop()
        del stack[k:]

    for m in tokens(page):
        tag = m["tag"]
        if tag is None:
            t = m[0]
            if t[0] != "<" or t == "<":
                held.append(t)
                linked += len(t) if opened.get("a") else 0
            continue
        tag = tag.lower()
        if m["shut"]:
            if opened.get(tag):
                shut(opened[tag][-1])
            elif tag in ("br", "p"):
                flush() if tag == "p" else held.append(" ")
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in ENDS:
            goes, border = ENDS[tag]
            if (k := last(goes)) > last(border):
                shut(k)
        if tag not in INLINE:
            flush()
        if tag not in VOID and not m["rest"].endswith("/"):
            opened.setdefault(tag, []).append(len(stack))
            stack.append((tag, here))
            if tag not in INLINE:
                names = " ".join(x for g in NAMES.findall(m["rest"]) for x in g if x) if m["rest"] else ""
                here = here.to(f"{tag} {names.lower()}")
    flush()
    return out


class Buckets(dict):
    """Word to bucket, hashed once."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = at = zlib.crc32(word.lower().encode()) % WORD_DIMS
        return at


BUCKETS = Buckets()


def vectors(page: list[Block]) -> np.ndarray:
    """One row a block."""
    x = np.zeros((len(page), DIMS), np.float32)
    for k, (path, text, linked) in enumerate(page):
        words = text.split(" ")
        n = len(text)
        x[k, :PATH_DIMS] = path.vector()
        x[k, PATH_DIMS : PATH_DIMS + WORD_DIMS] = np.sqrt(np.bincount([BUCKETS[w] for w in words], minlength=WORD_DIMS) / len(words))
        x[k, PATH_DIMS + WORD_DIMS :] = (np.log1p(n) / 5, np.log1p(len(words)) / 4, min(1, linked / n), text.count(".") / n * 10, text.count(",") / n * 10, (k + 1) / len(page), 1 / (k + 1), text[-1] in ".!?…")
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with a logistic output at each block."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        h = HIDDEN
        self.w = {}
        for side in "fb":
            self.w[f"x{side}"] = r.normal(0, DIMS**-0.5, (DIMS, 4 * h)).astype(np.float32)
            self.w[f"h{side}"] = r.normal(0, h**-0.5, (h, 4 * h)).astype(np.float32)
            self.w[f"c{side}"] = np.concatenate([np.ones(h), np.zeros(3 * h)]).astype(np.float32)
        self.w["o"] = r.normal(0, 0.3, (2 * h, 1)).astype(np.float32)
        self.w["d"] = np.zeros(1, np.float32)

    def scan(self, x: np.ndarray, mask: np.ndarray, side: str) -> tuple[np.ndarray, list]:
        """``x`` is (time, page, dim); padding leaves the state as it is."""
        t, n, _ = x.shape
        h = np.zeros((n, HIDDEN), np.float32)
        c = np.zeros_like(h)
        out, tape = np.zeros((t, n, HIDDEN), np.float32), [None] * t
        drive = (x.reshape(t * n, -1) @ self.w[f"x{side}"] + self.w[f"c{side}"]).reshape(t, n, -1)
        for k in range(t) if side == "f" else range(t - 1, -1, -1):
            z = drive[k] + h @ self.w[f"h{side}"]
            f, i, o = np.split(sigmoid(z[:, : 3 * HIDDEN]), 3, 1)
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[k][:, None]
            new = np.where(m, f * c + i * g, c)
            u = np.tanh(new)
            tape[k] = (h, c, f, i, o, g, u, m)
            h, c = np.where(m, o * u, h), new
            out[k] = h
        return out, tape

    def back(self, x: np.ndarray, tape: list, dout: np.ndarray, side: str, grad: dict) -> None:
        t, n, _ = x.shape
        dh = np.zeros((n, HIDDEN), np.float32)
        dc = np.zeros_like(dh)
        dz = np.zeros((t, n, 4 * HIDDEN), np.float32)
        for k in range(t - 1, -1, -1) if side == "f" else range(t):
            h, c, f, i, o, g, u, m = tape[k]
            dh = dh + dout[k]
            d = dc + dh * o * (1 - u * u)
            z = np.concatenate([d * c * f * (1 - f), d * g * i * (1 - i), dh * u * o * (1 - o), d * i * (1 - g * g)], 1) * m
            dz[k] = z
            grad[f"h{side}"] += h.T @ z
            dh = np.where(m, z @ self.w[f"h{side}"].T, dh)
            dc = np.where(m, d * f, dc)
        flat = dz.reshape(t * n, -1)
        grad[f"x{side}"] = x.reshape(t * n, -1).T @ flat
        grad[f"c{side}"] = flat.sum(0)

    def forward(self, x: np.ndarray, mask: np.ndarray) -> tuple:
        f, tf = self.scan(x, mask, "f")
        b, tb = self.scan(x, mask, "b")
        both = np.concatenate([f, b], 2)
        return sigmoid((both @ self.w["o"])[:, :, 0] + self.w["d"]), both, tf, tb

    def label(self, pages: list[np.ndarray], together: int = 48) -> list[np.ndarray]:
        """For each page, which blocks are main text; pages of like length go together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = [k for k in sorted(range(len(pages)), key=lambda k: len(pages[k])) if len(pages[k])]
        for s in range(0, len(order), together):
            part = order[s : s + together]
            x, mask = padded([pages[k] for k in part])
            p = self.forward(x, mask)[0]
            for j, k in enumerate(part):
                out[k] = p[: len(pages[k]), j] >= 0.5
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(map(len, pages))
    x = np.zeros((t, len(pages), DIMS), np.float32)
    mask = np.zeros((t, len(pages)), bool)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, True
    return x, mask


def made_page(r: np.random.Generator) -> list[tuple[Block, bool]]:
    """A generated page: its blocks, and whether each is main text."""
    syllables = "an be cor da en fi ga ho in ju ka lo me no or pa qui re st ti un ve wo ion ing ed ly er".split()
    vocabulary = ["".join(r.choice(syllables, r.integers(1, 4))) for _ in range(120)]
    pick = lambda *xs: xs[r.integers(len(xs))]

    def words(lo: int, hi: int) -> str:
        w = list(r.choice(vocabulary, r.integers(lo, hi + 1)))
        if r.random() < 0.7:
            w = [f"{x}{pick(',', '.')}" if r.random() < 0.1 else x for x in w]
            w[-1] += "."
        if r.random() < 0.08:
            w = [x + pick("###", "***", "&&&", "!!") for x in w]
        return html.escape(" ".join(w).capitalize())

    parts: list[tuple[str, bool]] = []
    put = lambda source, main=False: parts.append((source, main))

    def wrap(open_: str, close: str, body: list[tuple[str, bool]]) -> None:
        put(open_)
        parts.extend(body)
        put(close)

    def links(lo: int, hi: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{k}">{words(1, 2)}</a></li>' for k in range(r.integers(lo, hi))) + "</ul>"

    def noise() -> list[tuple[str, bool]]:
        name = pick("ad", "ad", "ad", "advert", "advertisement", "ad-slot", "ads banner", "sponsored", "promo", "share social", "related", "newsletter", "notice", "cookie-notice", "breadcrumb", "tags", "widget")
        tag = pick("div", "div", "div", "section", "aside", "p")
        body = links(2, 6) if r.random() < 0.25 and tag != "p" else words(3, 60)
        return [(f'<{tag} class="{name}">{body}</{tag}>', False)]

    def boiler(kind: str) -> None:
        if kind == "nav":
            wrap(*pick(("<nav>", "</nav>"), ('<div class="nav menu">', "</div>"), ('<div id="menu">', "</div>"), ('<div role="navigation">', "</div>")), [(links(3, 10), False)])
        elif kind == "header":
            wrap(*pick(("<header>", "</header>"), ('<div class="header">', "</div>"), ('<div id="header" class="site-header">', "</div>"), ('<div id="masthead">', "</div>")), [(f"<{pick('h1', 'div', 'p')}>{words(1, 5)}", False), (f"<p>{words(2, 12)}</p>", False)])
        elif kind == "footer":
            wrap(*pick(("<footer>", "</footer>"), ('<div class="footer">', "</div>"), ('<div id="footer">', "</div>")), [(f"&copy; {words(1, 3)} &middot; {words(3, 20)}", False)] + ([(links(2, 6), False)] if r.random() < 0.4 else []))
        elif kind == "aside":
            wrap(*pick(("<aside>", "</aside>"), ('<div class="sidebar">', "</div>"), ('<div id="sidebar">', "</div>")), [(f"<h3>{words(1, 4)}</h3>", False), (pick(links(2, 8), f"<p>{words(10, 90)}</p>"), False)])
        elif kind == "form":
            put(f'<form class="{pick("search", "login", "subscribe", "contact")}"><p>{words(2, 20)}</p><label>{words(1, 3)}</label><input name=q><button>{words(1, 2)}</button></form>')
        elif kind == "comments":
            wrap(*pick(('<section id="comments">', "</section>"), ('<div class="comments">', "</div>"), ('<div id="comments" class="comment-list">', "</div>"), ('<section class="comments">', "</section>"), ('<section id="comments" class="comments-area">', "</section>")), [(f"<{pick('h2', 'h3')}>{words(1, 3)}</h2></h3>", False)] * int(r.random() < 0.4) + [(f"<{pick('div', 'p', 'li', 'ol><li')} class=comment>{pick('', '<p>')}{words(4, 70)}</div>", False) for _ in range(r.integers(1, 6))])
        else:
            parts.extend(noise())

    def article() -> list[tuple[str, bool]]:
        title = words(3, 12)
        body = [(f"<h1>{title}</h1>", True)] if r.random() < 0.9 else []
        if r.random() < 0.4:
            body.append((f"<p><b>{title}<br>", True))
        for _ in range(r.integers(1, 14)):
            x = r.random()
            if x < 0.62:
                body.append((f"<p>{words(*pick((1, 3), (5, 30), (20, 140)))}{pick('</p>', '</p>', '</p>', '')}", True))
            elif x < 0.70:
                body.append((f"<p><b>{words(1, 60)}<br>", True))
            elif x < 0.78:
                body.append((f"<{pick('h2', 'h3')}>{words(1, 8)}</h2></h3>", True))
            elif x < 0.83:
                body.append((f"<ul><li>{words(2, 20)}</li><li>{words(2, 20)}</ul>", True))
            elif x < 0.85:
                body.append((f"<{pick('blockquote', 'pre', 'figcaption', 'div')}>{words(5, 50)}", True))
            elif x < 0.88:
                body.append((f'<p>{words(2, 20)} <a href="/x">{words(1, 12)}</a> {words(1, 10)}</p>', True))
            else:
                body.extend(noise())
        return body

    put(f"<html><head><title>{words(2, 12)}</title><style>p{{}}</style></head><body>")
    for kind in r.permutation(["header", "nav", "ad", "notice", "form"])[: r.integers(0, 4)]:
        boiler(kind)
    for k in range(r.integers(0, 2)):
        boiler("ad")
    where = pick(("<article>", "</article>"), ("<article>", "</article>"), ('<main><article class="post">', "</article></main>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="content">', "</div>"), ('<div class="article-body">', "</div>"), ('<div class="post entry-content">', "</div>"), ('<section class="article">', "</section>"))
    wrap(*where, article())
    for kind in r.permutation(["aside", "comments", "ad", "form", "nav"])[: r.integers(0, 4)]:
        boiler(kind)
    if r.random() < 0.85:
        boiler("footer")
    source, marked = "", []
    for k, (s, main) in enumerate(parts):
        marked.append(main)
        source += re.sub(r">([^<]*[^<\s][^<]*)", lambda m, k=k: f">\x01{k}\x02{m[1]}", s) if s.startswith("<") else f"\x01{k}\x02{s}"
    out = []
    for b in blocks(source):
        mark = re.search("\x01(\\d+)\x02", b.text)
        text = " ".join(re.sub("\x01\\d+\x02", "", b.text).split())
        if mark and text:
            out.append((Block(b.path, text, min(b.linked, len(text))), marked[int(mark[1])]))
    return out


@lru_cache(4)
def trained(pages: int = PAGES, epochs: int = EPOCHS, seed: int = 7) -> Labeller:
    """The labeller, learned from ``pages`` generated pages; the same for the same arguments."""
    r = np.random.default_rng(seed)
    data = []
    for _ in range(pages):
        made = made_page(r)
        data.append((vectors([b for b, _ in made]), np.array([m for _, m in made], np.float32)))
    net = Labeller(seed)
    first, second = ({k: np.zeros_like(v) for k, v in net.w.items()} for _ in range(2))
    step, size = 0, 24
    for epoch in range(epochs):
        order = sorted(r.permutation(pages), key=lambda k: len(data[k][1]) + r.random() * 6)
        groups = [order[s : s + size] for s in range(0, pages, size)]
        for g in r.permutation(len(groups)):
            part = [data[k] for k in groups[g]]
            x, mask = padded([a for a, _ in part])
            x = x * (r.random(x.shape) > 0.05)  # no single name may decide
            x = x.astype(np.float32)
            want = np.zeros(mask.shape, np.float32)
            for k, (_, y) in enumerate(part):
                want[: len(y), k] = y
            p, both, tf, tb = net.forward(x, mask)
            d = ((p - want) * mask / mask.sum()).astype(np.float32)[:, :, None]
            grad = {k: np.zeros_like(v) for k, v in net.w.items()}
            grad["o"] = np.einsum("tnh,tno->ho", both, d)
            grad["d"] = d.sum((0, 1))
            dboth = d @ net.w["o"].T
            net.back(x, tf, dboth[:, :, :HIDDEN], "f", grad)
            net.back(x, tb, dboth[:, :, HIDDEN:], "b", grad)
            step += 1
            rate = 0.012 * (1 - 0.9 * epoch / epochs)
            for k in net.w:
                first[k] = 0.9 * first[k] + 0.1 * grad[k]
                second[k] = 0.99 * second[k] + 0.01 * grad[k] ** 2
                net.w[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", net: Labeller | None = None) -> DataFrame:
    """``page_id, url, text, n_chars, n_blocks, n_kept`` for every page.

    Null and empty html, and pages without main text, give an empty text.  Ids, urls and
    repeated rows are passed on as they are; a page may be of any length and depth; further columns aren't read.
    """
    net = net or trained()
    names = ["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "html", 2 << 20):
            root = Step(None, "")  # shared by the pages of a chunk, which mostly have like paths
            found = [blocks(x or "", root) for x in batch.column("html").to_pylist()]
            kept = net.label([vectors(b) for b in found])
            text = ["\n\n".join(b.text for b, k in zip(f, w, strict=True) if k) for f, w in zip(found, kept, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64()), pa.array(map(len, found), pa.int64()), pa.array([int(w.sum()) for w in kept], pa.int64())], names
            )

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = [f.dataType.simpleString() for f in rows.schema]
    return rows.mapInArrow(extract, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long, n_blocks long, n_kept long")
