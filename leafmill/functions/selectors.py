"""CSS selectors as sets of positions in the page event stream.

A selector is evaluated from left to right. Each compound picks a set of elements, as an ascending array of their positions, and a
combinator joins it with the set before: a child by its parent's position, a descendant by the intervals that are open where it starts, a
sibling by (parent, position). Joins look positions up by halving, so a selector costs n log n in the page, whatever its depth and
however many siblings an element has.

Types, ``*``, classes, ids, attributes (``= != ~= |= ^= $= *=``, with ``i``), the four combinators, lists, and the pseudo-classes in
``PLAIN``, ``SETS`` and ``NEVER``. One that CSS knows but that is not built here raises UnsupportedSelector when the plan is built; text that
is no selector at all is a BadSelector. ``:contains`` reads the text below each candidate, so nested candidates cost their depth.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from leafmill.functions.markup import attr, inside
from leafmill.functions.sqltext import any_of, each, fold, keep, let, quote

_NAME = r"-{0,2}(?:[^\W\d]|\\.)(?:[\w-]|\\.)*"
_GROUP = r"""\((?:"[^"]*"|'[^']*'|[^()"']|\((?:"[^"]*"|'[^']*'|[^()"']|\([^()]*\))*\))*\)"""
_PART = re.compile(
    rf"""(?P<tag>\*|{_NAME})|\.(?P<cls>{_NAME})|\#(?P<id>{_NAME})|:(?P<pseudo>-?[A-Za-z][A-Za-z-]*)(?P<group>{_GROUP})?
    |\[\s*(?P<key>[\w:-]+)\s*(?:(?P<op>[~|^$*!]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[\w-]+))\s*(?P<flag>\s[iIsS]\s*)?)?\]""",
    re.VERBOSE,
)
_TOKEN = re.compile(
    rf"""\s*(?P<sign>[>+~,])\s*|(?P<space>\s+)|(?P<compound>(?:\[(?:"[^"]*"|'[^']*'|[^\]"'])*\]|{_GROUP}|\\.|[^\s>+~,\[\]()])+)"""
)
_NTH = re.compile(r"(?:(?P<a>[+-]?\d*)n)?\s*(?P<b>[+-]?\s*\d+)?$", re.I)

# Pseudo-classes that look at an element alone, at places among siblings, at sets of elements; that never hold in a
# stored page; and further ones that CSS knows.
PLAIN = {
    "root": "{e}.parent < 0",
    "empty": "NOT exists(slice({events}, {e}.pos + 2, greatest({e}.`end` - {e}.pos - 1, 0)), x -> x.kind = 'open' OR x.text RLIKE '\\\\S')",
    "first-child": "{e}.nth = 1",
    "last-child": "{e}.rest = 0",
    "only-child": "({e}.nth = 1 AND {e}.rest = 0)",
    "first-of-type": "{e}.type_nth = 1",
    "last-of-type": "{e}.type_rest = 0",
    "only-of-type": "({e}.type_nth = 1 AND {e}.type_rest = 0)",
    "any-link": "({e}.tag IN ('a', 'area') AND {href} IS NOT NULL)",
    "link": "({e}.tag IN ('a', 'area') AND {href} IS NOT NULL)",
    "checked": "({e}.tag = 'input' AND {checked} IS NOT NULL OR {e}.tag = 'option' AND {selected} IS NOT NULL)",
    "disabled": "({e}.tag IN ('button', 'input', 'select', 'textarea', 'option', 'optgroup', 'fieldset') AND {disabled} IS NOT NULL)",
    "enabled": "({e}.tag IN ('button', 'input', 'select', 'textarea', 'option', 'optgroup', 'fieldset') AND {disabled} IS NULL)",
    "required": "({e}.tag IN ('input', 'select', 'textarea') AND {required} IS NOT NULL)",
    "optional": "({e}.tag IN ('input', 'select', 'textarea') AND {required} IS NULL)",
}
PLACES = {
    "nth-child": "{e}.nth",
    "nth-last-child": "({e}.rest + 1)",
    "nth-of-type": "{e}.type_nth",
    "nth-last-of-type": "({e}.type_rest + 1)",
}
SETS = ("not", "is", "where", "matches", "has")
TEXTS = ("contains", "-soup-contains", "-soup-contains-own")
NEVER = frozenset(
    "active current focus focus-visible focus-within future host hover local-link past paused playing target target-within user-invalid visited".split()
)
KNOWN = frozenset(
    "autofill blank default defined dir fullscreen host-context in-range indeterminate invalid lang modal nth-col nth-last-col out-of-range "
    "picture-in-picture placeholder-shown popover-open read-only read-write scope state valid".split()
)

Steps = list[tuple[str, str]]
Test = Callable[[str], str]


class BadSelector(ValueError):
    """The text is not a selector."""


class UnsupportedSelector(ValueError):
    """A selector that can be read but not evaluated here."""


def picked(selector: str, events: str) -> str:
    """The positions of the elements that a selector picks, ascending. ``events`` is a name, as it is used many times."""
    parts = [_chain(steps, events) for steps in _read(selector)]
    return parts[0] if len(parts) == 1 else f"array_sort(array_distinct(concat({', '.join(parts)})))"


def below(items: str, value: str) -> str:
    """How many of the ascending numbers ``items`` (a name) are less than ``value``."""

    def halve(s: str, _: str) -> str:
        middle = lambda m: (
            f"CASE WHEN {s}.lo >= {s}.hi THEN {s} WHEN get({items}, {m}) < {value} THEN named_struct('lo', {m} + 1, 'hi', {s}.hi) ELSE named_struct('lo', {s}.lo, 'hi', {m}) END"
        )
        return let(f"shiftright({s}.lo + {s}.hi, 1)", middle)

    rounds = f"sequence(0, CAST(ceil(log2(size({items}) + 1)) AS INT))"
    return f"{fold(rounds, f'''named_struct('lo', 0, 'hi', size({items}))''', halve)}.lo"


def within(items: str, start: str, end: str) -> str:
    """The part of ``items`` that is at least ``start`` and less than ``end``."""
    return let(below(items, start), lambda a: f"slice({items}, {a} + 1, greatest({below(items, end)} - {a}, 0))")


def _member(items: str, value: str) -> str:
    return f"coalesce(get({items}, {below(items, value)}) = {value}, false)"


def _read(selector: str, relative: bool = False) -> list[Steps]:
    """Each selector of a list as (combinator, compound) pairs from left to right; the first combinator is empty unless ``relative``."""
    found: list[Steps] = [[]]
    position, text, combinator = 0, selector.strip(), ""
    while position < len(text):
        token = _TOKEN.match(text, position)
        if token is None:
            raise BadSelector(selector)
        position = token.end()
        first = not found[-1]
        if token["compound"] is not None:
            found[-1].append((combinator or (" " if relative and first else ""), token["compound"]))
            combinator = ""
        elif combinator or first and not (relative and token["sign"] not in (None, ",")):
            raise BadSelector(selector)
        elif token["sign"] == ",":
            found.append([])
        else:
            combinator = token["sign"] or " "
    if combinator or not found[-1]:
        raise BadSelector(selector)
    return found


def _chain(steps: Steps, events: str) -> str:
    """The positions that a chain of compounds picks."""
    found = ""
    for combinator, compound in steps:
        found = _compound(compound, events) if not found else _joined(found, combinator, compound, events)
    return found


def _elements(events: str, test: Test) -> str:
    return each(keep(events, lambda e: f"{e}.kind = 'open' AND {test(e)}"), lambda e: f"{e}.pos")


def _compound(text: str, events: str) -> str:
    return _tested(text, events, lambda test: _elements(events, test))


def _joined(left: str, combinator: str, compound: str, events: str) -> str:
    """Of the elements of a compound, those that stand to one of ``left`` as the combinator says."""

    def related(found: str) -> str:
        def joined(test: Test) -> str:
            if combinator == ">":
                return _elements(events, lambda e: f"{e}.parent >= 0 AND {test(e)} AND {_member(found, f'{e}.parent')}")
            if combinator == "+":
                return _elements(events, lambda e: f"{e}.prev >= 0 AND {test(e)} AND {_member(found, f'{e}.prev')}")
            if combinator == "~":
                earlier = lambda k, e: f"{below(k, _key(f'{e}.parent', f'{e}.pos'))} > {below(k, _key(f'{e}.parent', '0'))}"
                return let(_keys(found, events), lambda k: _elements(events, lambda e: f"{e}.prev >= 0 AND {test(e)} AND {earlier(k, e)}"))
            ends = f"array_sort({each(found, lambda p: f'get({events}, {p}).`end`')})"
            opened = lambda closed, e: f"{below(found, f'{e}.pos')} > {below(closed, f'{e}.pos')}"
            return let(ends, lambda closed: _elements(events, lambda e: f"{test(e)} AND {opened(closed, e)}"))

        return f"CASE WHEN size({found}) = 0 THEN {found} ELSE {_tested(compound, events, joined)} END"

    return let(left, related)


def _key(parent: str, position: str) -> str:
    """A number by which elements stand by parent, then by position."""
    return f"(({parent} + 1) * 4294967296L + {position})"


def _keys(found: str, events: str) -> str:
    return f"array_sort({each(found, lambda p: _key(f'get({events}, {p}).parent', p))})"


def _tested(text: str, events: str, use: Callable[[Test], str]) -> str:
    """``use`` of the test of a compound, below the sets that its pseudo-classes need, each evaluated once."""
    position, tests, sets = 0, [], []
    while position < len(text):
        found = _PART.match(text, position)
        if found is None or (found["tag"] and position):
            raise BadSelector(text)
        position = found.end()
        name = (found["pseudo"] or "").lower()
        if name in SETS:
            sets.append(_set(name, found["group"], events))
        else:
            tests.append(_simple(found, events))

    def bound(k: int, known: list[Test]) -> str:
        if k == len(sets):
            return use(lambda e: "(" + " AND ".join(t(e) for t in known) + ")" if known else "true")
        prepared, holds = sets[k]
        return let(prepared, lambda name: bound(k + 1, [*known, lambda e: holds(name, e)]))

    return bound(0, tests)


def _set(name: str, group: str | None, events: str) -> tuple[str, Callable[[str, str], str]]:
    """A prepared array and the test of an element against it."""
    inner = (group or "")[1:-1].strip()
    if not inner:
        raise BadSelector(f":{name}{group or ''}")
    if name == "not":
        return picked(inner, events), lambda found, e: f"NOT {_member(found, f'{e}.pos')}"
    if name != "has":
        return picked(inner, events), lambda found, e: _member(found, f"{e}.pos")
    options = [_ahead(steps, events) for steps in _read(inner, relative=True)]
    fields = ", ".join(f"'o{k}', {prepared}" for k, (prepared, _) in enumerate(options))
    return f"named_struct({fields})", lambda held, e: any_of([let(f"{held}.o{k}", lambda found, holds=holds: holds(found, e)) for k, (_, holds) in enumerate(options)])


def _ahead(steps: Steps, events: str) -> tuple[str, Callable[[str, str], str]]:
    """What an element must have ahead of it: ``:has(a b)`` asks for an a that has a b itself, so sets are built from the right."""
    (combinator, compound), rest = steps[0], steps[1:]
    if rest:
        prepared, holds = _ahead(rest, events)
        reached = let(prepared, lambda found: _tested(compound, events, lambda test: _elements(events, lambda e: f"{test(e)} AND {holds(found, e)}")))
    else:
        reached = _compound(compound, events)
    pointers = lambda field: f"array_sort(array_distinct({let(reached, lambda r: each(r, lambda p: f'get({events}, {p}).{field}'))}))"
    if combinator == ">":
        return pointers("parent"), lambda found, e: _member(found, f"{e}.pos")
    if combinator == "+":
        return pointers("prev"), lambda found, e: _member(found, f"{e}.pos")
    if combinator == "~":
        later = lambda k, e: f"{below(k, _key(f'({e}.parent + 1)', '0'))} > {below(k, _key(f'{e}.parent', f'{e}.pos + 1'))}"
        return let(reached, lambda r: _keys(r, events)), later
    return reached, lambda found, e: f"{below(found, f'{e}.`end`')} > {below(found, f'{e}.pos + 1')}"


def _simple(found: re.Match, events: str) -> Test:
    """The test of a part that looks at the element alone."""
    if found["tag"]:
        tag = _plain(found["tag"]).lower()
        return lambda e: "true" if tag == "*" else f"{e}.tag = {quote(tag)}"
    if found["cls"]:
        return lambda e: f"array_contains({_words(attr(e, 'class'))}, {quote(_plain(found['cls']))})"
    if found["id"]:
        return lambda e: f"{attr(e, 'id')} <=> {quote(_plain(found['id']))}"
    if found["pseudo"]:
        return _pseudo(found["pseudo"].lower(), found["group"], events)
    return lambda e: _attribute(attr(e, found["key"].lower()), found)


def _plain(name: str) -> str:
    return re.sub(r"\\(.)", r"\1", name)


def _words(value: str) -> str:
    return f"split(coalesce({value}, ''), {quote(chr(92) + 's+')})"


def _attribute(value: str, found: re.Match) -> str:
    if found["op"] is None:
        return f"{value} IS NOT NULL"
    wanted = next(found[g] for g in ("dq", "sq", "bare") if found[g] is not None)
    if (found["flag"] or "").strip().lower() == "i":
        value, wanted = f"lower({value})", wanted.lower()
    if found["op"] in ("=", "!="):
        return f"{'NOT ' if found['op'] == '!=' else ''}{value} <=> {quote(wanted)}"
    held = f"coalesce({value}, '')"
    if found["op"] == "|=":
        return f"({value} <=> {quote(wanted)} OR startswith({held}, {quote(wanted + '-')}))"
    if not wanted:
        return "false"
    test = {"^=": "startswith", "$=": "endswith", "*=": "contains"}.get(found["op"])
    if test is None:
        return f"array_contains({_words(value)}, {quote(wanted)})"
    return f"{test}({held}, {quote(wanted)})"


def _pseudo(name: str, group: str | None, events: str) -> Test:
    inner = (group or "")[1:-1].strip()
    if name in PLAIN and group is None:
        keys = ("href", "checked", "selected", "disabled", "required")
        return lambda e: PLAIN[name].format(e=e, events=events, **{k: attr(e, k) for k in keys})
    if name in PLACES and inner:
        return lambda e: _nth(name, inner, PLACES[name].format(e=e))
    if name in TEXTS and inner:
        wanted = [next(t for t in found if t) for found in re.findall(r"""\s*(?:"([^"]+)"|'([^']+)'|([^,"'\s][^,"']*))\s*(?:,|$)""", inner)]
        if not wanted:
            raise BadSelector(f":{name}{group}")
        own = (lambda e: f"AND t.parent = {e}.pos") if name.endswith("own") else lambda e: ""
        text = lambda e: f"array_join(transform(filter({inside(events, e)}, t -> t.kind = 'text' {own(e)}), t -> t.text), '')"
        return lambda e: let(text(e), lambda held: any_of([f"contains({held}, {quote(w)})" for w in wanted]))
    if name in NEVER:
        return lambda e: "false"
    if name in KNOWN:
        raise UnsupportedSelector(f"pseudo-class :{name}{group or ''}")
    raise BadSelector(f"pseudo-class :{name}{group or ''}")


def _nth(name: str, formula: str, place: str) -> str:
    """Places an + b for n from 0."""
    text = {"odd": "2n+1", "even": "2n"}.get(formula.lower(), formula)
    found = _NTH.match(text)
    if found is None:
        if re.search(r"\sof\s", formula):
            raise UnsupportedSelector(f":{name}({formula})")
        raise BadSelector(f":{name}({formula})")
    a, b = found["a"], int((found["b"] or "0").replace(" ", ""))
    step = 0 if a is None else int(a + "1") if a in ("", "+", "-") else int(a)
    if step == 0:
        return f"{place} = {b}"
    side = ">=" if step > 0 else "<="
    return f"({place} {side} {b} AND ({place} - {b}) % {abs(step)} = 0)"
