"""Building blocks for expressions written as Spark SQL text.

Functions in this package take and give SQL text, and an operator turns the whole into
one Column with ``F.expr``. An expression of a thousand nodes is then parsed once in the
JVM rather than assembled by a thousand driver calls, and lambdas nest naturally.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

_names = itertools.count()
Body = Callable[[str], str]


def fresh() -> str:
    """A lambda variable no other expression uses."""
    return f"v{next(_names)}"


def quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: str, body: Body) -> str:
    """Evaluate ``value`` once and use it in ``body``, also within lambdas."""
    name = fresh()
    return f"transform(array({value}), {name} -> {body(name)})[0]"


def each(items: str, body: Body) -> str:
    name = fresh()
    return f"transform({items}, {name} -> {body(name)})"


def each_at(items: str, body: Callable[[str, str], str]) -> str:
    name, index = fresh(), fresh()
    return f"transform({items}, ({name}, {index}) -> {body(name, index)})"


def keep(items: str, test: Body) -> str:
    name = fresh()
    return f"filter({items}, {name} -> {test(name)})"


def some(items: str, test: Body) -> str:
    name = fresh()
    return f"exists({items}, {name} -> {test(name)})"


def zipped(left: str, right: str, body: Callable[[str, str], str]) -> str:
    a, b = fresh(), fresh()
    return f"zip_with({left}, {right}, ({a}, {b}) -> {body(a, b)})"


def fold(items: str, start: str, step: Callable[[str, str], str]) -> str:
    state, item = fresh(), fresh()
    return f"aggregate({items}, {start}, ({state}, {item}) -> {step(state, item)})"


def first(items: str) -> str:
    """First element, NULL when there is none."""
    return f"get({items}, 0)"


def blank_to_null(text: str) -> str:
    return let(text, lambda held: f"CASE WHEN {held} <> '' THEN {held} END")


def any_of(tests: list[str]) -> str:
    return "(" + " OR ".join(tests) + ")"


def contains_any(text: str, needles: tuple[str, ...] | list[str]) -> str:
    return any_of([f"contains({text}, {quote(n)})" for n in needles])


def first_by(items: str, key: str) -> str:
    """The first struct per ``key`` field of an array of structs, in array order.

    Sorting (key, position) puts equal keys side by side, which is n log n however
    many entries a page holds; comparing every entry with every other would not be.
    """
    tagged = each_at(items, lambda item, i: f"struct({item}.{key} AS k, {i} AS i, {item} AS item)")

    def distinct(ordered: str) -> str:
        entry, i = fresh(), fresh()
        repeated = f"{entry}.k <=> get({ordered}, {i} - 1).k"
        kept = f"filter({ordered}, ({entry}, {i}) -> {i} = 0 OR NOT ({repeated}))"
        placed = each(kept, lambda e: f"struct({e}.i AS i, {e}.item AS item)")
        return each(f"sort_array({placed})", lambda e: f"{e}.item")

    return let(f"sort_array({tagged})", distinct)

