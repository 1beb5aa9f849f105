"""The page event stream: open, text and close events of a page in one array.

Spark has no tree reader for tag soup, so this one small Arrow function walks a page
once and writes flat events. Everything asked of a page afterwards (selectors,
microdata, markdown, main content) is an expression over that array, so it
needs no further Python and no shuffle.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.sqltext import each, keep, quote
from leafmill.functions.text import ENTITY, NAMED, strip_space

EVENTS = (
    "array<struct<kind:string,tag:string,pos:int,parent:int,depth:int,nth:int,prev:int,rest:int,type_nth:int,type_rest:int,attrs:map<string,string>,"
    "text:string,hidden:boolean,aside:boolean,pre:boolean,lists:int,item:int,end:int>>"
)

# Element classes of HTML that decide nesting and visibility.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote center div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main nav ol p pre section table ul".split()
)
HIDDEN = frozenset("head script style noscript template svg".split())
ASIDE = frozenset("nav footer aside form".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search".split())
ASIDE_NAMES = re.compile(r"cookie|consent|banner|sidebar|breadcrumb|newsletter|popup|modal|advert", re.I)
ENDS_ITEM = {
    "li": (("li",), ("ul", "ol")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
    "a": (("a",), ("td", "table", "li")),
}
ENDS_PARAGRAPH = (("p",), ("td", "th", "li", "table", "div", "section", "article", "blockquote", "body"))
COUNTED = frozenset(("li", "tr", "td", "th"))
OWNERS = frozenset(("ul", "ol", "tr", "table"))


_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-z][^\s/>]*)([^>"']*)(>|["'])|([^<]+|<)""", re.S | re.I)
_QUOTED = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_REFERENCE = re.compile(ENTITY)
_RAW = {tag: re.compile(rf"</{tag}\s*>|\Z", re.I) for tag in ("script", "style", "textarea", "title")}


def _character(found: re.Match) -> str:
    name = found[1]
    if name[0] != "#":
        return NAMED.get(name, found[0])
    point = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
    return chr(point) if 0 < point < 0x110000 and not 0xD800 <= point < 0xE000 else "\ufffd"


def unescape(text: str) -> str:
    """Replace character references by the rule of ``decode_entities``."""
    return _REFERENCE.sub(_character, text)


def _attributes(text: str) -> list[tuple[str, str]]:
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(text):
        if value[:1] in ("'", '"') and value:
            value = value[1:-1]
        found.setdefault(name.lower(), unescape(value) if "&" in value else value)
    return list(found.items())


class _Open:
    """An element that is still open, with what its descendants inherit."""

    __slots__ = ("tag", "pos", "depth", "elements", "href", "hidden", "aside", "pre", "story", "lists", "item", "children")


def _page() -> _Open:
    """What stands above a page's outermost elements."""
    root = _Open()
    root.tag, root.pos, root.depth, root.href, root.elements = "", -1, -1, None, []
    root.hidden = root.aside = root.pre = root.story = False
    root.lists = root.item = root.children = 0
    return root


_FIELDS = [
    ("kind", pa.string()), ("tag", pa.string()), ("pos", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("nth", pa.int32()), ("prev", pa.int32()),
    ("rest", pa.int32()), ("type_nth", pa.int32()), ("type_rest", pa.int32()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()),
    ("hidden", pa.bool_()), ("aside", pa.bool_()), ("pre", pa.bool_()), ("lists", pa.int32()), ("item", pa.int32()), ("end", pa.int32()),
]


class Events:
    """Events of pages, a list per field; places count from each page's start."""

    def __init__(self):
        self.columns: dict[str, list] = {name: [] for name, _ in _FIELDS if name != "attrs"}
        self.names, self.values, self.held = [], [], []  # attributes laid end to end, and where each event's start
        self.offsets = [0]
        self.start = 0

    def _add(self, kind: str, tag: str, parent: int, text: str | None, of: _Open, lists: int, item: int) -> int:
        c = self.columns
        place = len(c["kind"]) - self.start
        for name, value in (("kind", kind), ("tag", tag), ("pos", place), ("parent", parent), ("text", text), ("hidden", of.hidden), ("aside", of.aside), ("pre", of.pre), ("lists", lists), ("item", item), ("end", place)):
            c[name].append(value)
        for name in ("depth", "nth", "prev", "rest", "type_nth", "type_rest"):
            c[name].append(None)
        return place

    def text(self, raw: str, of: _Open) -> None:
        self._add("text", "", of.pos, unescape(raw) if "&" in raw else raw, of, of.lists, of.item)
        self.held.append(None)

    def open(self, new: _Open, parent: _Open, attrs: list[tuple[str, str]]) -> None:
        new.pos = self._add("open", new.tag, parent.pos, None, new, new.lists, new.item)
        self.columns["depth"][-1] = new.depth
        self._attributes(attrs)
        parent.elements.append(new.pos)

    def close(self, done: _Open, parent: _Open) -> None:
        row = done.tag == "tr"
        place = self._add("close", done.tag, parent.pos, None, done, done.item if row else done.lists, done.children if row else done.item)
        if done.tag == "a" and done.href is not None:
            self._attributes([("href", done.href)])
        else:
            self.held.append(None)
        self.columns["end"][self.start + done.pos] = place
        self.settle(done)

    def _attributes(self, attrs: list[tuple[str, str]]) -> None:
        self.held.append(len(self.names))
        for name, value in attrs:
            self.names.append(name)
            self.values.append(value)

    def settle(self, parent: _Open) -> None:
        """Give the elements below one that has ended their places among each other."""
        c, start, before = self.columns, self.start, -1
        seen: Counter[str] = Counter()
        for k, place in enumerate(parent.elements):
            at = start + place
            tag = c["tag"][at]
            seen[tag] += 1
            c["nth"][at], c["prev"][at], c["rest"][at], c["type_nth"][at] = k + 1, before, len(parent.elements) - k - 1, seen[tag]
            before = place
        for place in parent.elements:
            at = start + place
            c["type_rest"][at] = seen[c["tag"][at]] - c["type_nth"][at]
        parent.elements = []

    def end_page(self) -> None:
        self.start = len(self.columns["kind"])
        self.offsets.append(self.start)

    def arrays(self) -> pa.Array:
        starts = pa.array([*self.held, len(self.names)], pa.int32())
        attrs = pa.MapArray.from_arrays(starts, pa.array(self.names, pa.string()), pa.array(self.values, pa.string()))
        arrays = [attrs if name == "attrs" else pa.array(self.columns[name], kind) for name, kind in _FIELDS]
        struct = pa.StructArray.from_arrays(arrays, names=[name for name, _ in _FIELDS])
        return pa.ListArray.from_arrays(pa.array(self.offsets, type=pa.int32()), struct)


def walk(html: str, events: Events) -> None:
    """Add the events of one page in document order, in time linear in the page.

    An element knows its parent, its depth, its place among its siblings and among those of its tag, from either end, and the sibling before
    it. Nothing it holds grows with its depth. A tag without an end is text; once quotes have swallowed the rest of a page, later tags end at
    their first angle bracket, whatever they quote.
    """
    stack: list[_Open] = []
    top = root = _page()
    depths: dict[str, list[int]] = {}  # of the open elements of each tag
    pending: list[str] = []
    position, size, last, quotes = 0, len(html), html.rfind(">"), True

    def close(depth: int) -> None:
        nonlocal top
        while len(stack) > depth:
            done = stack.pop()
            depths[done.tag].pop()
            top = stack[-1] if stack else root
            events.close(done, top)

    def deepest(tags: tuple | frozenset) -> int:
        return max((depths[tag][-1] for tag in tags if depths.get(tag)), default=-1)

    def close_to(tags: tuple, stops: tuple) -> None:
        depth = deepest(tags)
        if depth >= 0 and depth > deepest(stops):
            close(depth)

    while position < size:
        if position > last:
            pending.append(html[position:])
            break
        token = _TOKEN.match(html, position)
        at, position = position, token.end()
        if token[5] is not None:
            pending.append(token[5])
            continue
        tag, inner = token[2], token[3]
        if tag is not None and token[4] != ">":
            end = _QUOTED.match(html, position - 1).end() if quotes else size
            if end >= size:
                quotes = False
                end = html.find(">", position)
                if end < 0:
                    pending.append(html[at])
                    position = at + 1
                    continue
            if html[end] != ">":  # a quote that nothing closes
                end = html.find(">", position)
            inner, position = html[token.start(3) : end], end + 1
        if pending:
            events.text("".join(pending), top)
            pending.clear()
        if tag is None:
            continue
        tag = tag.lower()
        if token[1]:
            close_to((tag,), ())
            continue
        if tag in ENDS_ITEM:
            close_to(*ENDS_ITEM[tag])
        elif tag in BLOCK:
            close_to(*ENDS_PARAGRAPH)
        attrs = _attributes(inner) if inner else []
        held, new = dict(attrs), _Open()
        new.tag, new.href, new.children, new.item, new.elements = tag, held.get("href"), 0, 0, []
        if tag in COUNTED:
            depth = deepest(OWNERS)
            if depth >= 0:
                owner = stack[depth]
                owner.children += 1
                new.item = owner.children if tag != "li" or owner.tag == "ol" else 0
        new.depth = top.depth + 1
        new.hidden = top.hidden or tag in HIDDEN
        new.pre = top.pre or tag == "pre"
        new.story = top.story or tag in ("article", "main")
        new.lists = top.lists + (tag in ("ul", "ol"))
        new.aside = tag not in ("body", "html") and (
            top.aside
            or tag in ASIDE
            or held.get("role") in ASIDE_ROLES
            or not top.story
            and (tag == "header" or bool(ASIDE_NAMES.search(f"{held.get('id', '')} {held.get('class', '')}")))
        )
        events.open(new, top, attrs)
        if tag in VOID:
            continue
        depths.setdefault(tag, []).append(len(stack))
        stack.append(new)
        top = new
        if tag in _RAW:
            stop = _RAW[tag].search(html, position)
            if tag in ("textarea", "title") and stop.start() > position:
                events.text(html[position : stop.start()], top)
            position = stop.end()
            close(len(stack) - 1)
    if pending:
        events.text("".join(pending), top)
    close(0)
    events.settle(root)


#: Characters of html whose events are held as Python objects at a time, beside those of one page.
HELD_CHARS = 1_000_000


def _events(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Events of pages, given away whenever ``HELD_CHARS`` have been read: a worker holds as much whatever the size of a batch is."""
    for pages in batches:
        events, held = Events(), 0
        for page in pages:
            html = page.as_py()
            if html:
                walk(html, events)
                held += len(html)
            events.end_page()
            if held >= HELD_CHARS:
                yield events.arrays()
                events, held = Events(), 0
        if len(events.offsets) > 1:
            yield events.arrays()
    give_back()


def give_back() -> None:
    """Return a worker's free memory to the system at a task's end: Spark keeps idle workers, and they would hold on to it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def page_events(html: Column) -> Column:
    """Events of each page. Marked non-deterministic so that it is never run twice."""
    return F.arrow_udf(_events, EVENTS).asNondeterministic()(html)


def inside(events: str, node: str) -> str:
    """The events strictly inside an open event."""
    return f"slice({events}, {node}.pos + 2, greatest({node}.`end` - {node}.pos - 1, 0))"


def text_of(events: str, node: str, separator: str = " ") -> str:
    """Stripped text nodes below an open event, empty ones dropped, joined."""
    texts = each(keep(inside(events, node), lambda e: f"{e}.kind = 'text'"), lambda e: strip_space(f"{e}.text"))
    return f"array_join({keep(texts, lambda t: f'length({t}) > 0')}, {quote(separator)})"


def attr(node: str, name: str) -> str:
    return f"try_element_at({node}.attrs, {quote(name)})"
