"""Row extraction: many rows per capture, de-duplicated within the page.

All matching happens in arrays inside the row that holds the page, so a scan of the
captures is followed by no shuffle and the html never leaves the scan stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.sqltext import each, each_at, first_by, keep, let, quote, zipped
from leafmill.functions.text import (
    ATTRIBUTES,
    attribute,
    compact_text,
    strip_hidden,
    strip_space,
    stripped_text,
    visible_text,
)
from leafmill.functions.urls import authority_of, is_web_url, resolve, split_url

# Patterns, limits and the social hosts.
CONTEXT_CHARS = 60
EMAIL = r"(?U)\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
EMAIL_MIN_CHARS = 6
PHONE = (
    r"(?U)(?<![\w.])(?:\+\d{1,3}[\s.\-]?|\(?0\d{1,4}\)?[\s.\-]?)(?:\d[\s.\-]?){6,12}\d(?![\w.])"
)
PHONE_MIN_CHARS = 9
PHONE_MIN_DIGITS, PHONE_MAX_DIGITS = 9, 15
SOCIAL_HOSTS = {
    "linkedin.com": "linkedin",
    "twitter.com": "twitter",
    "x.com": "twitter",
    "facebook.com": "facebook",
    "instagram.com": "instagram",
    "youtube.com": "youtube",
    "tiktok.com": "tiktok",
    "github.com": "github",
    "pinterest.com": "pinterest",
}

_ANCHOR = quote("(?is)<a" + ATTRIBUTES + r">(.*?)(?:</a\s*>|(?=<a[\s>])|\z)")


def _text_matches(text: str, pattern: str, shortest: int, hint, accept) -> str:
    """Matches of ``pattern`` with their surroundings, first per value, in text order.

    Context is rebuilt from the pieces between matches. ``shortest`` bounds how many
    earlier matches can lie within the context window, so this stays linear.
    """
    back = CONTEXT_CHARS // shortest + 1
    glue = lambda gap, hit: f"concat({gap}, coalesce({hit}, ''))"

    def hits(found: str, between: str) -> str:
        def one(hit: str, i: str) -> str:
            start = f"greatest({i} - {back}, 0)"
            earlier = zipped(
                f"slice({between}, {start} + 1, {i} - {start})", f"slice({found}, {start} + 1, {i} - {start})", glue
            )
            later = zipped(f"slice({between}, {i} + 2, {back + 1})", f"slice({found}, {i} + 2, {back})", glue)
            before = f"right(concat(array_join({earlier}, ''), get({between}, {i})), {CONTEXT_CHARS})"
            after = f"left(array_join({later}, ''), {CONTEXT_CHARS})"
            context = strip_space(f"concat({before}, {hit}, {after})")
            return f"struct({i} AS pos, {hit} AS value, {context} AS context)"

        rows = each_at(found, one)
        return first_by(keep(rows, lambda h: accept(f"{h}.value")) if accept else rows, "value")

    def search(held: str) -> str:
        pieces = (
            f"struct(regexp_extract_all({held}, {quote(pattern)}, 0) AS found, split({held}, {quote(pattern)}, -1) AS between)"
        )
        return f"CASE WHEN {hint(held)} THEN {let(pieces, lambda p: hits(f'{p}.found', f'{p}.between'))} END"

    return let(text, search)


def _contacts(captures: DataFrame, carry: tuple[str, ...], hits: str, possible: str = "true") -> DataFrame:
    keys = ["url", *carry]
    return captures.select(*keys, F.explode(F.expr(f"CASE WHEN {possible} THEN {hits} END")).alias("hit")).select(
        *keys, "hit.value", "hit.context", "hit.pos"
    )


def email_hits(text: str) -> str:
    """E-mail addresses of a text: array of struct(pos, value, context)."""
    return _text_matches(text, EMAIL, EMAIL_MIN_CHARS, lambda t: f"contains({t}, '@')", None)


def phone_hits(text: str) -> str:
    """Phone numbers of a text: array of struct(pos, value, context)."""

    def plausible(value: str) -> str:
        digits = f"length(regexp_replace({value}, {quote(r'(?U)\D')}, ''))"
        return f"{digits} BETWEEN {PHONE_MIN_DIGITS} AND {PHONE_MAX_DIGITS}"

    return _text_matches(text, PHONE, PHONE_MIN_CHARS, lambda t: f"(contains({t}, '+') OR contains({t}, '0'))", plausible)


def extract_emails(captures: DataFrame, carry: tuple[str, ...] = (), text: str | None = None) -> DataFrame:
    """Email addresses in the visible text: url, value, context, pos."""
    # Markup without an at sign, plain or as a character number, need not be read as text.
    return _contacts(captures, carry, email_hits(text or visible_text("html")), "true" if text else "contains(html, '@') OR contains(html, '&#')")


def extract_phones(captures: DataFrame, carry: tuple[str, ...] = (), text: str | None = None) -> DataFrame:
    """Phone numbers with a country code or a leading zero: url, value, context, pos."""
    return _contacts(captures, carry, phone_hits(text or visible_text("html")))


def extract_all_contacts(captures: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """E-mails, phones and social links of each page in one pass over its text: url, type (email, phone or the platform), value."""
    keys = ["url", *carry]
    typed = lambda hits, kind: each(f"coalesce({hits}, array())", lambda h: f"struct({kind(h)} AS type, {h}.value AS value)")
    texts = let(visible_text("html"), lambda t: f"concat({typed(email_hits(t), lambda _: quote('email'))}, {typed(phone_hits(t), lambda _: quote('phone'))})")
    every = f"concat({texts}, {typed(social_hits(), lambda h: f'{h}.platform')})"
    return captures.select(*keys, F.explode(F.expr(every)).alias("hit")).select(*keys, "hit.type", "hit.value")


def anchors(html: str, linked: bool = True) -> str:
    """Anchors in document order: attribute text, href, inner html; ``linked`` wants an href."""

    def found(visible: str) -> str:
        every = zipped(
            f"regexp_extract_all({visible}, {_ANCHOR}, 1)",
            f"regexp_extract_all({visible}, {_ANCHOR}, 2)",
            lambda head, body: f"struct({head} AS attrs, {attribute(head, 'href')} AS href, {body} AS inner_html)",
        )
        return keep(every, lambda a: f"{a}.href IS NOT NULL") if linked else every

    return let(strip_hidden(html), found)


def extract_links(captures: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Absolute http(s) links, first per target: url, value, context (anchor text), pos."""
    keys = ["url", *carry]
    named = each_at(
        anchors("html"),
        lambda a, i: f"struct({i} AS pos, {strip_space(a + '.href')} AS href, {a}.inner_html AS inner_html)",
    )
    wanted = keep(named, lambda a: f"{a}.href <> '' AND NOT startswith({a}.href, '#')")
    absolute = let(
        split_url("url"),
        lambda base: each(
            wanted,
            lambda a: f"struct({a}.pos AS pos, {resolve('url', a + '.href', base)} AS value, {a}.inner_html AS inner_html)",
        ),
    )
    links = first_by(keep(absolute, lambda a: is_web_url(a + ".value")), "value")
    return captures.select(*keys, F.explode(F.expr(links)).alias("link")).select(
        *keys, "link.value", F.expr(compact_text("link.inner_html")).alias("context"), "link.pos"
    )


def social_hits() -> str:
    """Profile links of a page on the known social hosts: array of struct(pos, value, platform)."""
    table = f"map({', '.join(quote(x) for pair in SOCIAL_HOSTS.items() for x in pair)})"
    absolute = let(
        split_url("url"),
        lambda base: each_at(
            anchors("html"),
            lambda a, i: f"struct({i} AS pos, {resolve('url', strip_space(a + '.href'), base)} AS value)",
        ),
    )

    def named(a: str) -> str:
        host = f"regexp_replace({authority_of(a + '.value')}, '^www[.]', '')"
        return f"struct({a}.pos AS pos, {a}.value AS value, try_element_at({table}, {host}) AS platform)"

    return first_by(keep(each(absolute, named), lambda a: f"{a}.platform IS NOT NULL"), "value")


def extract_social_links(captures: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Profile links on the known social hosts: url, platform, value, pos."""
    keys = ["url", *carry]
    return captures.select(*keys, F.explode(F.expr(social_hits())).alias("link")).select(
        *keys, "link.platform", "link.value", "link.pos"
    )


def _search_target(href: str) -> str:
    """Unwrap the search engine's redirect; other schemes give an empty string."""

    def unwrapped(full: str) -> str:
        path = f"regexp_extract({full}, '^[^:/?#]+://[^/?#]*([^?#]*)', 1)"
        redirect = f"contains({authority_of(full)}, 'duckduckgo.com') AND startswith({path}, '/l/')"
        packed = f"regexp_extract(regexp_extract({full}, {quote(r'\?([^#]*)')}, 1), '(?:^|&)uddg=([^&]+)', 1)"
        return (
            f"CASE WHEN {redirect} THEN coalesce(try_url_decode({packed}), {packed}) "
            f"WHEN {is_web_url(full)} THEN {full} ELSE '' END"
        )

    return let(f"CASE WHEN startswith({href}, '//') THEN concat('https:', {href}) ELSE {href} END", unwrapped)


def has_class(attributes: str, name: str) -> str:
    return f"array_contains(split(coalesce({attribute(attributes, 'class')}, ''), {quote(r'\s+')}), {quote(name)})"


def search_results(pages: DataFrame, limit: int | None = None, carry: tuple[str, ...] = ("query",)) -> DataFrame:
    """Ranked hits of captured result pages: rank, title, url, snippet."""
    block = quote(r"(?is)<([a-z][a-z0-9]*)(?=[^>]*result-snippet)" + ATTRIBUTES + r">(.*?)</\1\s*>")

    def found(visible: str) -> str:
        blocks = zipped(
            f"regexp_extract_all({visible}, {block}, 2)",
            f"regexp_extract_all({visible}, {block}, 3)",
            lambda head, body: f"struct({head} AS attrs, {body} AS inner_html)",
        )
        return each(
            keep(blocks, lambda b: has_class(b + ".attrs", "result-snippet")), lambda b: stripped_text(b + ".inner_html")
        )

    # An anchor without a target is no hit, but it still takes up its snippet's place.
    links = keep(anchors("html", linked=False), lambda a: has_class(a + ".attrs", "result-link"))

    def paired(snippets: str) -> str:
        hits = each_at(
            links,
            lambda a, i: f"struct({_search_target(f"coalesce({a}.href, '')")} AS url, {a}.inner_html AS inner_html, "
            f"coalesce(get({snippets}, {i}), '') AS snippet)",
        )
        return first_by(keep(hits, lambda h: f"{h}.url <> ''"), "url")

    every = let(let(strip_hidden("html"), found), paired)
    ranked = every if limit is None else f"slice({every}, 1, {max(limit, 1)})"
    return pages.select(*carry, F.posexplode(F.expr(ranked)).alias("i", "hit")).select(
        *carry,
        (F.col("i") + 1).alias("rank"),
        F.expr(stripped_text("hit.inner_html")).alias("title"),
        "hit.url",
        "hit.snippet",
    )


def network_responses(log: DataFrame, include_types: str = "json", max_body_chars: int | None = None) -> DataFrame:
    """Logged responses whose content type names a wanted kind, with their bodies, cut if asked."""
    kinds = [k.strip().lower() for k in include_types.split(",") if k.strip()] or ["json"]
    test = F.lit(False)
    for kind in kinds:
        test = test | F.lower("content_type").contains(kind)
    body = F.coalesce(F.col("body"), F.lit(""))
    return log.filter(test).withColumns(
        {
            "size": F.length(body),
            "body_truncated": F.lit(False) if max_body_chars is None else F.length(body) > max_body_chars,
            "body": body if max_body_chars is None else F.left(body, F.lit(max_body_chars)),
        }
    )


def largest_responses(log: DataFrame, per_page: int | None = None, **options) -> DataFrame:
    """The same, biggest first (ties by URL); with ``per_page``, only each page's largest."""
    found = network_responses(log, **options)
    order = [F.desc("size"), F.col("url")]
    if per_page is not None:
        place = F.row_number().over(Window.partitionBy("page_url").orderBy(*order))
        found = found.withColumn("place", place).filter(F.col("place") <= per_page).drop("place")
    return found.orderBy(*order)
