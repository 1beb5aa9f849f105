"""User-defined extraction by CSS selectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions.markup import attr, page_events, text_of
from leafmill.functions.selectors import BadSelector, picked, within
from leafmill.functions.sqltext import any_of, each, first, keep, let
from leafmill.functions.text import strip_space
from leafmill.functions.urls import resolve

# Attributes that hold a list of words.
WORD_LISTS = ("class", "rel", "rev", "accept-charset", "headers", "accesskey", "dropzone")
NO_MATCH = "none of the selectors picked an element"


def _split(selector: str) -> tuple[str, str]:
    expression, _, attribute = (part.strip() for part in selector.partition("@"))
    return expression, attribute


def _field(selector: str, events: str, found: str | None, scope: str | None, url: str) -> str:
    """One field's value. ``found`` holds the positions that its selector picks in the page; None is text that is no selector, and gives an
    empty string."""
    expression, attribute = _split(selector)
    if not expression and scope is None:
        texts = each(keep(events, lambda e: f"{e}.kind = 'text'"), lambda e: strip_space(f"{e}.text"))
        return "''" if attribute else f"array_join({keep(texts, lambda t: f'length({t}) > 0')}, ' ')"
    if not expression:
        nodes = f"array({scope}.pos)"
    elif found is None:
        return "''"
    else:
        nodes = found if scope is None else within(found, f"{scope}.pos + 1", f"{scope}.`end`")

    def read(node: str) -> str:
        if not attribute:
            return text_of(events, node)
        value = attr(node, attribute.lower())
        if attribute in ("href", "src"):
            return f"CASE WHEN {value} IS NOT NULL THEN {resolve(url, value)} END"
        return f"regexp_replace({value}, '\\\\s+', ' ')" if attribute in WORD_LISTS else value

    return f"coalesce({first(each(f'slice({nodes}, 1, 1)', lambda p: let(f'get({events}, {p})', read)))}, '')"


def _picked(selector: str, events: str) -> str | None:
    """The positions that a field's selector picks; None if it has none or is no selector."""
    expression, _ = _split(selector)
    try:
        return picked(expression, events) if expression else None
    except BadSelector:
        return None


def selected_rows(
    pages: DataFrame, fields: dict[str, str], row_selector: str = "", carry: tuple[str, ...] = ()
) -> DataFrame:
    """One row per page, or per ``row_selector`` match within it, in one pass.

    ``"a@href"`` reads an attribute instead of the text. Rows whose fields are all
    empty are dropped; a page left without rows keeps one row with its ``error``.
    """
    if not fields:
        raise ValueError("provide at least one field, e.g. {'title': 'h1'}")
    keys, events, link = ["url", *carry], "__events", "url"
    sets = {name: positions for name, selector in fields.items() if (positions := _picked(selector, events)) is not None}

    def rows_of(found: str) -> str:
        """The rows, below what each field's selector picks, evaluated once a page and all side by side."""
        held = {name: f"{found}.f{k}" for k, name in enumerate(sets)}
        row = lambda scope: f"struct({', '.join(f'{_field(s, events, held.get(n), scope, link)} AS `{n}`' for n, s in fields.items())})"
        if not row_selector:
            return f"array({row(None)})"
        return each(each(picked(row_selector, events), lambda p: f"get({events}, {p})"), row)

    rows = let(f"named_struct({', '.join(f"'f{k}', {p}" for k, p in enumerate(sets.values()))})", rows_of) if sets else rows_of("")
    filled = keep(rows, lambda r: any_of([f"{r}.`{name}` <> ''" for name in fields]))
    read = pages.select(*keys, page_events(F.col("html")).alias("__events"))
    rows = read.select(*keys, F.posexplode_outer(F.expr(filled)).alias("pos", "__row"))
    return rows.select(*keys, "pos", "__row.*", F.when(F.col("pos").isNull(), NO_MATCH).alias("error"))


def extract_by_selector(
    pages: DataFrame, fields: dict[str, str], row_selector: str = "", carry: tuple[str, ...] = ()
) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of ``selected_rows``."""
    every = selected_rows(pages, fields, row_selector, carry)
    found = every.filter("error IS NULL").drop("error")
    return found, every.filter("error IS NOT NULL").select("url", *carry, "error")
