"""Main text of pages: gradient-boosted trees over DOM nodes, decoded down the hierarchy.

A page is walked once into block nodes with features of the node, its subtree and its siblings: density of text and links, attribute
tokens, depth, place. Trees give each node the odds that it belongs to the article. The decoder then chooses the most likely set of nodes
that is closed upwards: a node can only be kept inside kept ancestors, and below a dropped one all are dropped.
The trees are fitted on a bounded sample of the pages that have one ``article`` or ``main`` element, which is the silver answer, and on the
same texts dressed in other layouts, where neither exists. Where no page has one, fixed odds by tags and tokens take their place. Pages
are read in place; only ids are shuffled.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.boosting import Trees, boost
from leafmill.llm.common import arrow_rows, map_arrow

SAMPLE = 100  # pages that the trees are fitted on, at most
DRESSES = 4  # layouts made of each

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
SILENT = frozenset("head script style noscript template svg iframe object canvas button select textarea title".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe")
CLOSES_P = BLOCKS - {"html", "body"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
LISTS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "p": BLOCKS - {"p"}}
GOOD_TOKENS = "article content post entry story main body text page blog prose hentry paragraph".split()
BAD_TOKENS = (
    "nav menu header foot footer side sidebar aside ad ads advert advertisement sponsor banner promo cookie consent notice alert popup modal share social "
    "related recommended comment comments reply respond disqus form search login subscribe newsletter widget breadcrumb breadcrumbs tags meta copyright legal pager pagination toolbar"
).split()
SEMANTIC = frozenset(("article", "main"))
_GOOD, _BAD = frozenset(GOOD_TOKENS), frozenset(BAD_TOKENS)
SHARE, LINKS, BAD = 2, 5, 14  # places among the features: share of the page's text, share of links in the text, bad tokens
TAGS = "article main section div p h li td blockquote pre nav header footer aside form ul".split()

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)([^>\"']*)(>|[\"'])", re.S)
_QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
_END = {tag: re.compile(rf"</{tag}\s*>|\Z", re.I) for tag in RAW}
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?|\"[^\"]*\"|'[^']*'")
_MAY_HIDE = re.compile(r"hidden|display", re.I)
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_WORDS = re.compile(r"[a-z]+")


def hides(attributes: str) -> bool:
    """Whether an element's attributes hide it: hidden, aria-hidden="true" or a style of display: none. Words in other values do not."""
    if not _MAY_HIDE.search(attributes):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = (m[1] or "").lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true") or (name == "style" and _NO_DISPLAY.search(value)):
            return True
    return False


class Tokens:
    """The tags and comments of a page as (start, ending slash, tag or None, attributes), in time linear in the page.

    ``at`` is where the next one is sought, and may be moved on. Nothing after the last angle bracket is a tag, and once quotes have swallowed the
    rest of a page, later tags end at their first angle bracket, whatever they quote.
    """

    def __init__(self, source: str) -> None:
        self.source, self.at, self.last, self.quotes = source, 0, source.rfind(">"), True

    def __iter__(self) -> Iterator[tuple[int, str, str | None, str]]:
        source = self.source
        while self.at <= self.last and (token := _TOKEN.search(source, self.at)):
            start, tag, rest = token.start(), token[2], token[3]
            if start > self.last:
                break
            self.at = token.end()
            if tag is not None and token[4] != ">":
                end = _QUOTED.match(source, self.at - 1).end() if self.quotes else len(source)
                self.quotes = end < len(source)
                if not self.quotes or source[end] != ">":
                    end = source.find(">", self.at)
                if end < 0:
                    break
                rest, self.at = source[token.start(3) : end], end + 1
            yield start, token[1], tag, rest
        start = source.find("<!--", self.at)
        if start >= 0:  # a comment that does not end
            self.at = len(source)
            yield start, "", None, ""


class Page:
    """Block nodes of a page, parents before children, and its blocks of text: (node, text) in page order."""

    def __init__(self, source: str) -> None:
        self.tag: list[str] = []
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.names: list[frozenset] = []
        self.links: list[int] = []
        self.counts: list[tuple] = []  # good and bad tokens, article or main; then the same of all ancestors
        self.blocks: list[tuple[int, str]] = []
        self._add("html", -1, frozenset())
        self._walk(source)
        self.size = [1] * len(self.tag)
        for k in range(len(self.tag) - 1, 0, -1):
            self.size[self.parent[k]] += self.size[k]

    def _add(self, tag: str, parent: int, names: frozenset) -> int:
        above = self.counts[parent] if parent >= 0 else (0,) * 6
        self.tag.append(tag)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.names.append(names)
        self.links.append(0)
        good, bad = len(names & _GOOD) + (tag in _GOOD), len(names & _BAD) + (tag in _BAD)
        self.counts.append((good, bad, int(tag in SEMANTIC), above[3] + above[0], above[4] + above[1], above[5] + above[2]))
        return len(self.tag) - 1

    def _walk(self, source: str) -> None:
        stack: list[tuple[str, int, bool]] = [("html", 0, False)]  # open elements with their block node, and whether their text is not shown
        places: dict[str, list[int]] = {}  # in the stack, of the open elements of each tag
        blocks: list[int] = []  # in the stack, of open blocks
        outer: list[int] = []  # the same without paragraphs
        parts: list[str] = []
        silent = link = at = 0

        def flush() -> None:
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    self.blocks.append((stack[-1][1], text))
                parts.clear()

        def say(raw: str) -> None:
            if not silent:
                text = entities.unescape(raw) if "&" in raw else raw
                parts.append(text)
                if link:
                    self.links[stack[-1][1]] += len(text.strip())

        def close(to: int) -> None:
            nonlocal silent, link
            for tag, _, mute in stack[to:]:
                silent -= mute
                link -= tag == "a"
                places[tag].pop()  # the stack holds a tag's places in order, so as many go as stood here
            del stack[to:]
            for held in (blocks, outer):
                while held and held[-1] >= to:
                    held.pop()

        def top(tags) -> int:
            return max((places[t][-1] for t in tags if places.get(t)), default=0)

        tokens = Tokens(source)
        for start, ending, tag, rest in tokens:
            if start > at:
                say(source[at:start])
            at = tokens.at
            if tag is None:
                continue
            tag = tag.lower()
            if ending:
                found = top((tag,))
                if tag in ("html", "body") or not found or (tag not in BLOCKS and blocks and blocks[-1] > found):
                    continue
                if tag in BLOCKS:
                    flush()
                close(found)
                continue
            if tag == "br" or tag == "hr":
                flush()
                continue
            if tag in VOID or tag == "html":
                continue
            if tag in BLOCKS:
                flush()
                paragraph = top(("p",))
                if tag in CLOSES_P and paragraph > (outer[-1] if outer else 0):
                    close(paragraph)
                if tag in CLOSED_BY and tag != "p":
                    before = top(CLOSED_BY[tag])
                    if before > top(LISTS[tag]):
                        close(before)
            if rest.endswith("/") and tag not in BLOCKS:
                continue
            if tag in RAW:
                at = tokens.at = _END[tag].search(source, at).end()
                continue
            node = stack[-1][1]
            if tag in BLOCKS:
                names = [w for m in _NAMES.finditer(rest) for w in _WORDS.findall((m[1] or m[2] or m[3] or "").lower())] if rest else ()
                node = self._add(tag, node, frozenset(names))
            mute = tag in SILENT or hides(rest)
            silent += mute
            link += tag == "a"
            place = len(stack)
            places.setdefault(tag, []).append(place)
            if tag in BLOCKS:
                blocks.append(place)
                if tag != "p":
                    outer.append(place)
            stack.append((tag, node, mute))
        if at < len(source):
            say(source[at:])
        flush()

    def decode(self, yes: list[float], no: list[float]) -> list[bool]:
        """The most likely labelling that keeps a node only inside kept ancestors; the root is always kept.

        ``yes`` and ``no`` are the log likelihoods of each node to be kept and not.
        """
        parent, keep, drop = self.parent, list(yes), list(no)
        for k in range(len(parent) - 1, 0, -1):
            keep[parent[k]] += max(keep[k], drop[k])
            drop[parent[k]] += drop[k]
        kept = [True] * len(parent)
        for k in range(1, len(parent)):
            kept[k] = kept[parent[k]] and keep[k] > drop[k]
        return kept

    def text(self, kept: list[bool]) -> str:
        return "\n".join(text for node, text in self.blocks if kept[node])


def features(pages: list[Page], plain: bool = False) -> np.ndarray:
    """One row per node of all pages. ``plain`` hides what the silver answer was taken from: article and main."""
    starts = np.cumsum([0, *(len(p.tag) for p in pages)])
    n = int(starts[-1])
    base = np.repeat(starts[:-1], np.diff(starts))
    join = lambda what, kind=float: np.fromiter((x for p in pages for x in getattr(p, what)), kind, n)
    parent, size, links, depth = join("parent", np.int64) + base, join("size", np.int64), join("links"), join("depth")
    root = parent < base
    up = np.where(root, base, parent)
    node = np.fromiter((k + s for p, s in zip(pages, starts.tolist(), strict=False) for k, _ in p.blocks), np.int64)
    texts = [text for p in pages for _, text in p.blocks]
    chars = np.fromiter(map(len, texts), float, len(texts))
    sums = lambda weights: np.bincount(node, weights, minlength=n) if len(node) else np.zeros(n)
    own, count = sums(chars), sums(np.ones(len(texts)))
    words = sums(np.fromiter((t.count(" ") + 1 for t in texts), float, len(texts)))
    stops = sums(np.fromiter((t.count(".") + t.count(",") + t.count("!") + t.count("?") for t in texts), float, len(texts)))
    end = np.arange(n) + size

    def below(x: np.ndarray) -> np.ndarray:
        """Sums over subtrees: nodes of one are neighbours."""
        sums = np.concatenate(([0.0], np.cumsum(x)))
        return sums[end] - sums[:-1]

    total, total_links, total_stops, total_words, total_count = map(below, (own, links, stops, words, count))
    children = np.bincount(parent[~root], minlength=n).astype(float) if n else np.zeros(0)
    by_parent = np.argsort(np.where(root, -1, parent), kind="stable")
    order = np.zeros(n)
    ranked = np.where(root, -1, parent)[by_parent]
    first = np.concatenate(([True], ranked[1:] != ranked[:-1])) if n else np.zeros(0, bool)
    order[by_parent] = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0)) if n else 0
    order[root] = 0
    good, bad, semantic, in_good, in_bad, in_semantic = np.array([c for p in pages for c in p.counts], float).reshape(-1, 6).T
    if plain:
        good, in_good = good - semantic, in_good - in_semantic
    whole = np.maximum(total[base], 1) if n else total
    cum = np.cumsum(own) - own
    mean = total_words / np.maximum(total_count, 1)
    code = {t: k for k, t in enumerate(TAGS)} | {f"h{k}": TAGS.index("h") for k in range(1, 7)}
    if plain:
        code |= {t: code["div"] for t in SEMANTIC}
    kinds = np.fromiter((code.get(t, -1) for p in pages for t in p.tag), np.int64, n)
    columns = [
        np.log1p(total), np.log1p(own), total / whole, total / np.maximum(total[up], 1), np.log1p(total / size), total_links / np.maximum(total, 1),
        total_stops / np.maximum(total_words, 1), np.log1p(mean), depth, children, children[up], order / np.maximum(children[up], 1), (cum - cum[base]) / whole,
        good, bad, in_good, in_bad, good[up], bad[up], total_links[up] / np.maximum(total[up], 1), np.log1p(size), np.log1p(mean[up]),
    ]
    return np.stack([*columns, *(kinds == k for k in range(len(TAGS)))], axis=1)


def main_texts(trees: Trees, pages: list[Page]) -> list[str]:
    odds = trees.score(features(pages)) if pages else np.zeros(0)
    yes, no = (-np.logaddexp(0, -odds)).tolist(), (-np.logaddexp(0, odds)).tolist()
    out, at = [], 0
    for page in pages:
        end = at + len(page.tag)
        out.append(page.text(page.decode(yes[at:end], no[at:end])))
        at = end
    return out


def has_silver(source: str) -> bool:
    """Whether ``_silver`` has an answer for the page: one article element, or one main element and no article."""
    article = main = 0
    tokens = Tokens(source)
    for _, ending, tag, rest in tokens:
        if tag is None or ending:
            continue
        tag = tag.lower()
        if tag in RAW and not rest.endswith("/"):
            tokens.at = _END[tag].search(source, tokens.at).end()
        article, main = article + (tag == "article"), main + (tag == "main")
        if article > 1:
            return False
    return article == 1 or (article == 0 and main == 1)


def _silver(page: Page) -> np.ndarray | None:
    """Nodes inside the one article or main element, and those around it."""
    tops = [k for k, t in enumerate(page.tag) if t == "article"] or [k for k, t in enumerate(page.tag) if t == "main"]
    if len(tops) != 1:
        return None
    out = np.zeros(len(page.tag))
    for k in range(tops[0] + 1, len(page.tag)):
        out[k] = 1 if page.parent[k] == tops[0] or (page.parent[k] > tops[0] and out[page.parent[k]]) else 0
    at = tops[0]
    while at >= 0:
        out[at], at = 1, page.parent[at]
    for k, tag in enumerate(page.tag):  # what is never article, wherever it stands
        if k and (tag in ("nav", "aside", "form") or (page.parent[k] and out[page.parent[k]] == -1)):
            out[k] = -1
    return np.maximum(out, 0)


def _dress(rng: random.Random, title: str, texts: list[str], other: list[str]) -> tuple[str, str]:
    """The texts of an article in a layout drawn at random, with the usual surroundings; article nodes carry a mark."""
    mark = "data-main"
    line = lambda: rng.choice(other)[: rng.choice((30, 80, 300))]
    links = lambda n: "".join(f'<li><a href="/{k}">{line()[:24]}</a></li>' for k in range(n))
    around = [
        lambda: f"<nav><ul>{links(6)}</ul></nav>", lambda: f'<div class="menu">{links(4)}</div>', lambda: f'<div id="nav-main"><a href="/">{line()[:20]}</a> <a href="/b">{line()[:20]}</a></div>',
        lambda: f'<header><div class="logo">{line()[:30]}</div><p>{line()}</p></header>', lambda: f'<div class="site-header"><h1>{line()[:40]}</h1></div>',
        lambda: f'<div class="{rng.choice(("ad", "advert", "sponsored ads", "promo banner"))}"><p>{line()}</p></div>', lambda: f'<div class="ad">{line()}</div>',
        lambda: f'<div class="{rng.choice(("cookie-notice", "cookie consent", "alert notice", "popup"))}"><p>{line()}</p><button>OK</button></div>',
    ]
    after = [
        lambda: f"<footer><p>{line()}</p></footer>", lambda: f'<footer>&copy; {line()}</footer>', lambda: f'<div class="footer"><ul>{links(5)}</ul><p>{line()}</p></div>',
        lambda: f'<aside><h3>{line()[:20]}</h3><p>{line()}</p><ul>{links(3)}</ul></aside>', lambda: f'<div class="sidebar"><h4>{line()[:20]}</h4><p>{line()}</p></div>',
        lambda: f'<section class="comments"><h3>{line()[:12]}</h3>' + "".join(f'<div class="comment"><b>{line()[:9]}</b><p>{rng.choice(other)}</p></div>' for _ in range(rng.randint(1, 5))) + "</section>",
        lambda: f'<div id="comments"><ul>' + "".join(f'<li class="reply"><p>{rng.choice(other)}</p></li>' for _ in range(rng.randint(1, 4))) + "</ul></div>",
        lambda: f'<form action="/s"><label>{line()[:20]}</label><input name="q"><p>{line()}</p></form>', lambda: f'<div class="newsletter subscribe"><p>{line()}</p></div>',
        lambda: f'<div class="related"><h3>{line()[:20]}</h3><ul>{links(4)}</ul></div>', lambda: f'<div class="share social">{links(3)}</div>',
    ]
    body = [f"<h1 {mark}>{title}</h1>" if rng.random() < 0.7 else ""]
    for k, text in enumerate(texts):
        if k and rng.random() < 0.12:
            body.append(f"<h2 {mark}>{line()[:40]}</h2>")
        style = rng.random()
        body.append(f"<p {mark}>{text}</p>" if style < 0.75 else f"<blockquote {mark}>{text}</blockquote>" if style < 0.8 else f"<ul {mark}><li {mark}>{text[:90]}</li><li {mark}>{text[90:]}</li></ul>" if style < 0.9 else f"<div {mark}>{text}</div>")
        if rng.random() < 0.06:
            body.append(rng.choice((*around[5:], *after[7:]))())
    inner = "".join(body)
    name = rng.choice(("content", "post", "entry-content", "article-body", "story", "main-text", "page-content", "blog-post", "x1", ""))
    tag = rng.choice(("div", "div", "section", "article", "main", "td"))
    held = f'<{tag} {mark} class="{name}">{inner}</{tag}>' if name else f"<{tag} {mark}>{inner}</{tag}>"
    held = f"<table {mark}><tr {mark}>{held}</tr></table>" if tag == "td" else held
    if rng.random() < 0.5:
        held = f'<div {mark} id="{rng.choice(("wrap", "page", "container", "main"))}">{held}{rng.choice(after)() if rng.random() < 0.4 else ""}</div>'
    top = "".join(f() for f in rng.sample(around, rng.randint(1, 4)))
    end = "".join(f() for f in rng.sample(after, rng.randint(1, 5)))
    return f"<html><head><title>{title}</title></head><body>{top}{held}{end}</body></html>", mark


def training(pages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features and answers of the nodes of sampled pages and of their texts in other layouts."""
    rng = random.Random(5)
    xs, ys, articles = [], [], []
    for source in pages:
        page = Page(source)
        answer = _silver(page)
        if answer is None:
            continue
        for plain in (False, True):
            xs.append(features([page], plain)[1:])
            ys.append(answer[1:])
        texts = [entities.escape(t, quote=False) for node, t in page.blocks if answer[node]]
        if texts:
            articles.append(texts)
    pool = [t for texts in articles for t in texts]
    for texts in articles:
        for _ in range(DRESSES):
            some = texts[1:] or texts
            size = rng.randint(1, len(some))
            source, mark = _dress(rng, texts[0][:80], some[:size], pool)
            marked = Page(source.replace(f" {mark}", f" class={mark}"))
            plainer = Page(source.replace(f" {mark}", ""))
            xs.append(features([plainer])[1:])
            ys.append(np.array([float({"data", "main"} <= names and "data" in names) for names in marked.names])[1:])
    return (np.concatenate(xs), np.concatenate(ys)) if xs else (np.zeros((0, features([Page("")]).shape[1])), np.zeros(0))


def prior() -> Trees:
    """Fixed odds for tables without a silver answer: a node stays unless its tag or tokens are those of navigation, advertising, comments
    and the like, or half of its text is links; what holds more than half of the page's text stays in any case."""
    first = len(features([Page("")])[0]) - len(TAGS)
    against = [BAD, LINKS, *(first + TAGS.index(t) for t in ("nav", "header", "footer", "aside", "form"))]
    feature = np.array([[k, 0, SHARE] for k in against])
    cut = np.tile([0.5, np.inf, 0.5], (len(against), 1))
    return Trees(1.0, feature, cut, np.tile([0.0, 0.0, -1000.0, 0.0], (len(against), 1)))


def fit_on(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> Trees:
    """Trees fitted on at most ``sample`` whole pages, the first by the hash of their id among those that have a silver answer: one
    article element, or one main element and no article. If no page of the table has one, the odds are those of ``prior``."""
    html = F.col(html_col)
    may = pages.filter(html.rlike("(?i)<(article|main)")).select(F.xxhash64(id_col).alias("h"), F.xxhash64(id_col, html).alias("row"), html.alias("html"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["h", "row"]).filter(pa.array([has_silver(source.decode()) for (source,) in arrow_rows(batch, "html")], pa.bool_()))

    silver = map_arrow(may, scan, "h long, row long").distinct().orderBy("h", "row").limit(sample).select("row")
    chosen = may.join(F.broadcast(silver), "row", "left_semi")  # at most ``sample`` numbers
    sources = sorted(r["html"] for r in chosen.dropDuplicates(["row"]).select("html").collect())
    x, y = training(sources)
    return boost(x, y, rounds=30) if len(y) else prior()


def extract(pages: DataFrame, trees: Trees, html_col: str = "html") -> DataFrame:
    """Every row of ``pages`` without the html, with ``text`` instead: the main text of the whole page.

    Null, empty and text-free pages give ''. Character references are decoded, white space inside a block is one space, blocks are
    joined by a line end in page order. Repeated rows come back each; other columns pass through (one called ``text`` is replaced).
    """
    names = [c for c in pages.columns if c.lower() not in (html_col.lower(), "text")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name in names)
    shared = pages.sparkSession.sparkContext.broadcast((trees.base, trees.feature, trees.cut, trees.value))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Trees(*shared.value)
        for batch in batches:
            texts = main_texts(fitted, [Page((source or b"").decode()) for (source,) in arrow_rows(batch, html_col)])
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(texts, pa.string())], names=[*names, "text"])

    return map_arrow(pages, scan, f"{schema}, text string" if schema else "text string")
