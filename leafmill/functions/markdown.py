"""Markdown of a page, written event by event."""

from __future__ import annotations

from leafmill.functions.markup import BLOCK, attr, inside
from leafmill.functions.sqltext import each, first, fold, keep, let, quote
from leafmill.functions.text import strip_space

MIN_ARTICLE_CHARS = 200  # a shorter main body counts as a miss
_HEADINGS = ", ".join(f"'h{n}'" for n in range(1, 7))
_PLAIN_BLOCKS = ", ".join(
    quote(tag) for tag in sorted(BLOCK) if tag not in ("pre", "blockquote", "hr", "ul", "ol") and not tag[1:].isdigit()
)


def _piece(e: str) -> str:
    """What one event contributes."""
    link, title = attr(e, "href"), attr(e, "title")
    flowed = f"regexp_replace(regexp_replace({e}.text, '([*_])', {quote(r'\\$1')}), {quote(r'[ \t\r\n\f]+')}, ' ')"
    image = (
        f"concat('![', coalesce({attr(e, 'alt')}, ''), '](', coalesce({attr(e, 'src')}, ''), "
        f"CASE WHEN {title} IS NULL THEN '' ELSE concat(' \"', {title}, '\"') END, ')')"
    )
    item = (
        f"concat('\\n', repeat('  ', greatest({e}.lists - 1, 0)), "
        f"CASE WHEN {e}.item > 0 THEN concat({e}.item, '. ') ELSE '* ' END)"
    )
    outer = f"CASE WHEN {e}.lists <= 1 THEN '\\n\\n' ELSE '' END"
    code = f"CASE WHEN {e}.pre THEN '' ELSE '`' END"
    opened = f"""CASE
 WHEN {e}.tag IN ({_HEADINGS}) THEN concat('\\n\\n', repeat('#', CAST(substring({e}.tag, 2, 1) AS INT)), ' ')
 WHEN {e}.tag = 'a' THEN CASE WHEN {link} IS NULL THEN '' ELSE '[' END
 WHEN {e}.tag IN ('b', 'strong') THEN '**' WHEN {e}.tag IN ('i', 'em') THEN '*'
 WHEN {e}.tag = 'br' THEN '  \\n' WHEN {e}.tag = 'hr' THEN '\\n\\n---\\n\\n' WHEN {e}.tag = 'img' THEN {image}
 WHEN {e}.tag = 'li' THEN {item} WHEN {e}.tag IN ('ul', 'ol') THEN {outer}
 WHEN {e}.tag = 'blockquote' THEN '\\n\\n> ' WHEN {e}.tag = 'pre' THEN '\\n\\n```\\n' WHEN {e}.tag = 'code' THEN {code}
 WHEN {e}.tag = 'tr' THEN '\\n' WHEN {e}.tag IN ('td', 'th') THEN CASE WHEN {e}.item > 1 THEN ' | ' ELSE '| ' END
 WHEN {e}.tag IN ({_PLAIN_BLOCKS}) THEN '\\n\\n' ELSE '' END"""
    closed = f"""CASE
 WHEN {e}.tag = 'a' THEN CASE WHEN {link} IS NULL THEN '' ELSE concat('](', {link}, ')') END
 WHEN {e}.tag IN ('b', 'strong') THEN '**' WHEN {e}.tag IN ('i', 'em') THEN '*'
 WHEN {e}.tag IN ('ul', 'ol') THEN {outer} WHEN {e}.tag = 'pre' THEN '\\n```\\n\\n' WHEN {e}.tag = 'code' THEN {code}
 WHEN {e}.tag = 'tr' THEN CASE WHEN {e}.lists = 1 THEN concat(' |\\n', repeat('| --- ', {e}.item), '|') ELSE ' |' END
 WHEN {e}.tag IN ('blockquote', {_HEADINGS}, {_PLAIN_BLOCKS}) THEN '\\n\\n' ELSE '' END"""
    return f"""CASE WHEN {e}.hidden THEN ''
 WHEN {e}.kind = 'text' THEN CASE WHEN {e}.pre THEN {e}.text ELSE {flowed} END
 WHEN {e}.kind = 'open' THEN {opened} ELSE {closed} END"""


def _tidy(markdown: str) -> str:
    """Blank lines hold nothing, come singly, and none stands at the ends."""
    trimmed = f"regexp_replace({markdown}, {quote(r'\n[ \t]+(?=\n|[^ \t*0-9])')}, '\\n')"
    single = f"regexp_replace({trimmed}, {quote(r'(?<![ ])[ \t](?=\n)')}, '')"
    return strip_space(f"regexp_replace({single}, '\\n{{3,}}', '\\n\\n')")


def events_to_markdown(events: str) -> str:
    return _tidy(f"array_join({each(events, _piece)}, '')")


def main_events(events: str) -> str:
    """Events of the article body without navigation, banners and footers.

    The first article or main element is the body. Without one, the page itself is,
    if at least half of its remaining text stands in paragraphs.
    """

    def is_body(e: str) -> str:
        return (
            f"({e}.kind = 'open' AND ({e}.tag IN ('article', 'main') OR coalesce({attr(e, 'role')} IN ('article', 'main')"
            f" OR {attr(e, 'itemprop')} = 'articleBody', false)))"
        )

    def kept(found: str) -> str:
        return keep(found, lambda e: f"NOT {e}.aside AND NOT {e}.hidden")

    def letters(found: str) -> str:
        return fold(found, "0", lambda total, e: f"{total} + length(coalesce({e}.text, ''))")

    def whole_page(page: str) -> str:
        parent = lambda e: f"get({events}, {e}.parent).tag"
        prose = keep(page, lambda e: f"{e}.kind = 'text' AND {parent(e)} IN ('p', 'b', 'i', 'em', 'strong', 'a')")
        total = letters(page)
        return f"CASE WHEN {total} > 0 AND {letters(prose)} * 2 >= {total} THEN {page} END"

    body = first(keep(events, is_body))
    return let(
        body,
        lambda b: f"CASE WHEN {b} IS NOT NULL THEN {kept(inside(events, b))} ELSE {let(kept(events), whole_page)} END",
    )


def article_markdown(events: str) -> str:
    """Main content as markdown, or NULL when there is no clear article."""
    written = events_to_markdown(main_events(events))
    return let(written, lambda m: f"CASE WHEN length({m}) >= {MIN_ARTICLE_CHARS} THEN {m} END")
