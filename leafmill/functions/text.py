"""Text of a page, as SQL expressions evaluated in the JVM."""

from __future__ import annotations

import json
from html.entities import name2codepoint

from leafmill.functions.sqltext import each, keep, let, quote, zipped

# Markup whose content is never part of a page's text.
_HIDDEN = (
    r"!--.*?(?:-->|\z)|script\b.*?(?:</script\s*>|\z)"
    r"|style\b.*?(?:</style\s*>|\z)|template\b.*?(?:</template\s*>|\z)"
)
# Inside of a tag, stepping over quoted values that may hold '>'. The quantifiers
# are possessive so that long tags cannot exhaust the regex stack.
_IN_TAG = r"""[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+"""
ATTRIBUTES = rf"""((?:\s|/){_IN_TAG})"""
# One shared '<' first, so that text between tags is skipped at a character a step.
_ANY_MARKUP = quote(rf"(?is)<(?:{_HIDDEN}|![a-z\[][^>]*>|/?[a-z]{_IN_TAG}>|/?[a-z][^>]*>)")
# The characters that count as surrounding whitespace.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
ENTITY = r"&(#0*[0-9]{1,7}|#[xX]0*[0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"
_ENTITY = quote(ENTITY)
# Named character references of HTML 4, from the standard library, as one constant map.
NAMED = {**{name: chr(point) for name, point in name2codepoint.items()}, "apos": "'"}
_ENTITIES = f"from_json({quote(json.dumps(NAMED))}, 'map<string,string>')"


def strip_comments(html: str) -> str:
    """Drop comments but leave scripts whole, since a script may hold ``<!--``."""
    pattern = quote(r"(?is)(<script\b.*?(?:</script\s*>|\z))|<!--.*?(?:-->|\z)")
    return f"CASE WHEN contains({html}, '<!--') THEN regexp_replace({html}, {pattern}, '$1') ELSE {html} END"


def strip_hidden(html: str) -> str:
    """Drop comments, scripts, styles and templates."""
    return f"regexp_replace({html}, {quote(f'(?is)<(?:{_HIDDEN})')}, ' ')"


def strip_space(text: str) -> str:
    """Strip whitespace of every kind from both ends."""
    return f"trim(BOTH {quote(WHITESPACE)} FROM {text})"


def decode_entities(text: str) -> str:
    """Replace character references; unknown names stay as written."""

    def character(point: str) -> str:
        usable = f"{point} > 0 AND {point} < 1114112 AND {point} NOT BETWEEN 55296 AND 57343"
        return f"CASE WHEN {usable} THEN decode(unhex(lpad(hex({point}), 8, '0')), 'UTF-32') ELSE '�' END"

    def decoded(name: str) -> str:
        number = (
            f"CASE WHEN lower(substring({name}, 2, 1)) = 'x' THEN conv(substring({name}, 3), 16, 10) "
            f"ELSE substring({name}, 2) END"
        )
        named = f"coalesce(try_element_at({_ENTITIES}, {name}), concat('&', {name}, ';'))"
        point = f"CAST({number} AS BIGINT)"
        return f"CASE WHEN {name} IS NULL THEN '' WHEN startswith({name}, '#') THEN {let(point, character)} ELSE {named} END"

    def rebuilt(held: str) -> str:
        names = f"regexp_extract_all({held}, {_ENTITY}, 1)"
        around = f"split({held}, {_ENTITY}, -1)"
        return f"array_join({zipped(around, names, lambda before, name: f'concat({before}, {decoded(name)})')}, '')"

    return let(text, lambda held: f"CASE WHEN contains({held}, '&') THEN {rebuilt(held)} ELSE {held} END")


def visible_text(html: str) -> str:
    """Text nodes joined by one space, as a reader of the page would see them."""
    marked = f"trim(BOTH '\u0001' FROM regexp_replace({html}, {_ANY_MARKUP}, '\u0001'))"
    return decode_entities(f"regexp_replace({marked}, '\u0001+', ' ')")


def stripped_text(html: str) -> str:
    """Text nodes stripped, empty ones dropped, joined by one space."""
    return _joined_nodes(html, " ")


def compact_text(html: str) -> str:
    """Text nodes stripped and joined without a separator (anchor text)."""
    return _joined_nodes(html, "")


def _joined_nodes(html: str, separator: str) -> str:
    nodes = each(f"split({html}, {_ANY_MARKUP}, -1)", lambda n: strip_space(decode_entities(n)))
    return f"array_join({keep(nodes, lambda n: f'{n} <> {quote(str())}')}, {quote(separator)})"


def page_title(html: str) -> str:
    """Content of the first title element, or an empty string."""
    pattern = quote(r"(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>")
    return strip_space(decode_entities(f"regexp_extract({strip_hidden(html)}, {pattern}, 1)"))


def attribute(attributes: str, name: str) -> str:
    """Value of one attribute in a tag's attribute text; NULL when it is absent."""
    pattern = quote(rf"""(?is)(?:^|[\s"'/]){name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
    bare = quote(rf"""(?is)(?:^|[\s"'/]){name}(?=[\s=/]|$)""")

    def value(held: str) -> str:
        quoted = f"""left({held}, 1) IN ('"', '\\'')"""
        inner = f"CASE WHEN {quoted} THEN substring({held}, 2, length({held}) - 2) ELSE {held} END"
        return (
            f"CASE WHEN {held} <> '' THEN {decode_entities(inner)} "
            f"WHEN regexp_like({attributes}, {bare}) THEN '' END"
        )

    return let(f"regexp_extract({attributes}, {pattern}, 1)", value)
