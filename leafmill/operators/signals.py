"""Page signals: one output row per capture, all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.markdown import article_markdown, events_to_markdown
from leafmill.functions.markup import page_events
from leafmill.functions.sqltext import contains_any, keep, let, quote
from leafmill.functions.text import ATTRIBUTES, attribute, page_title, strip_hidden, stripped_text
from leafmill.functions.urls import authority_of, is_web_url, origin_of

# Signatures, statuses and thresholds that decide each signal.
ARTICLE_MARKERS = ("<article", 'role="article"', "articleBody", "NewsArticle", "BlogPosting")
CHALLENGE_SIGNATURES = (
    "cf-browser-verification",
    "/cdn-cgi/challenge-platform",
    "__cf_chl",
    "<title>Just a moment",
    "Attention Required! | Cloudflare",
    "Pardon our interruption",
    "Checking your browser before you access",
    "Checking your browser before accessing",
    "Before you continue to Google",
    "verify that you're not a robot",
    "verify that you&#x27;re not a robot",
    "bots use DuckDuckGo too",
)
BLOCK_STATUSES = (403, 429, 503)
CONTENT_MIN_HTML, CONTENT_MIN_TEXT, CONTENT_MIN_LINKS = 10_000, 2_000, 10
SHELL_MIN_HTML, SHELL_MAX_TEXT, SHELL_MAX_LINKS = 500, 200, 3
PLATFORM_SIGNALS = {
    "shopify": ("Shopify.theme", "cdn.shopify.com", "x-shopify"),
    "wordpress": ("WordPress", "wp-content", "wp-json"),
    "squarespace": ("squarespace.com", "Squarespace"),
    "wix": ("wix.com", "x-wix-"),
    "webflow": ("webflow.com", "Webflow"),
}
JS_SIGNALS = ("__NEXT_DATA__", "window.__NUXT__", "ng-version", "data-reactroot", "__remixContext")


def title(html: str = "html") -> Column:
    return F.expr(page_title(html))


def links_sql(html: str) -> str:
    tags = f"regexp_extract_all({strip_hidden(html)}, {quote('(?is)<a' + ATTRIBUTES + '>')}, 1)"
    return f"size({keep(tags, lambda t: attribute(t, 'href') + ' IS NOT NULL')})"


def link_count(html: str = "html") -> Column:
    """Anchors that carry an href, whatever its scheme, repeats included."""
    return F.expr(links_sql(html))


def looks_like_an_article(html: str = "html") -> Column:
    return F.expr(contains_any(html, ARTICLE_MARKERS))


def is_html(content_type: str = "content_type", html: str = "html") -> Column:
    kind = F.lower(content_type)
    return (F.coalesce(F.length(html), F.lit(0)) > 0) & ((kind == "") | kind.contains("html") | kind.startswith("text/"))


def is_texty(content_type: str = "content_type") -> Column:
    kind = F.lower(content_type)
    named = kind.contains("html") | kind.contains("xml") | kind.contains("json")
    return (kind == "") | kind.startswith("text/") | named


def content_route(content_type: str = "content_type", html: str = "html") -> Column:
    """How a body is read: as html, as text it already is, or not at all."""
    return (
        F.when(is_html(content_type, html), "html")
        .when(F.lower(content_type).contains("pdf"), "pdf")
        .when(is_texty(content_type), "text")
        .otherwise("binary")
    )


def _content_sql(html: str) -> str:
    return (
        f"CASE WHEN coalesce(length({html}), 0) < {CONTENT_MIN_HTML} THEN false ELSE "
        f"length({stripped_text(html)}) >= {CONTENT_MIN_TEXT} AND {links_sql(html)} >= {CONTENT_MIN_LINKS} END"
    )


def looks_like_content(html: str = "html") -> Column:
    """Enough markup, text and links to be the real page; the cheap test comes first."""
    return F.expr(_content_sql(html))


def block_reason(status: str = "status_code", html: str = "html") -> Column:
    """``challenge`` or ``http_<status>`` for a refusal, NULL for a served page.

    A body that carries a real page is a real page, whatever the status says.
    """
    refused = f"coalesce({status} IN ({', '.join(map(str, BLOCK_STATUSES))}), false)"
    reason = let(
        f"coalesce({contains_any(html, CHALLENGE_SIGNATURES)}, false)",
        lambda challenged: f"CASE WHEN NOT ({challenged} OR {refused}) THEN NULL WHEN {_content_sql(html)} THEN NULL "
        f"WHEN {challenged} THEN 'challenge' ELSE concat('http_', {status}) END",
    )
    return F.expr(reason)


def platform(html: str = "html", headers: str | None = None) -> Column:
    """First platform, in fixed order, with a signal in the body or the headers."""
    parts = [html]
    if headers is not None:
        parts += [f"array_join(map_keys({headers}), ' ')", f"array_join(map_values({headers}), ' ')"]

    def choose(haystack: str) -> str:
        cases = [
            f"WHEN {contains_any(haystack, [s.lower() for s in needles])} THEN {quote(name)}"
            for name, needles in PLATFORM_SIGNALS.items()
        ]
        return f"CASE {' '.join(cases)} ELSE 'unknown' END"

    return F.expr(let(f"lower(concat_ws(' ', {', '.join(parts)}))", choose))


def requires_js(html: str = "html") -> Column:
    """A framework marker, or real markup with almost no text and no links."""
    return F.expr(
        f"CASE WHEN {contains_any(html, JS_SIGNALS)} THEN true WHEN coalesce(length({html}), 0) < {SHELL_MIN_HTML} THEN false "
        f"ELSE length({stripped_text(html)}) < {SHELL_MAX_TEXT} AND {links_sql(html)} < {SHELL_MAX_LINKS} END"
    )


def with_url_parts(df: DataFrame, url: str = "url") -> DataFrame:
    return df.withColumns({"domain": F.expr(authority_of(url)), "origin": F.expr(origin_of(url))})


def split_by_scheme(captures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Captures with an http or https URL, and an error row for every other one."""
    ok = F.expr(is_web_url("url"))
    message = F.concat(F.lit("ValueError: URL must use the http or https scheme: "), F.col("url"))
    return captures.filter(ok), captures.filter(~ok).select("url", message.alias("error"))


def with_block(captures: DataFrame) -> DataFrame:
    """Add ``blocked`` and ``block_reason``."""
    return captures.withColumn("block_reason", block_reason()).withColumn("blocked", F.col("block_reason").isNotNull())


def with_markdown(captures: DataFrame, main_content: str = "auto", html: str = "html") -> DataFrame:
    """Add ``markdown`` for html bodies.

    ``main_content`` is ``auto`` (isolate the article on article-shaped pages), ``on``
    or ``off``. Blocked pages get an empty text and are never parsed.
    """
    body = F.col(html)
    isolate = {"auto": looks_like_an_article(html), "on": F.lit(True), "off": F.lit(False)}[main_content]
    blocked = F.col("blocked") if "blocked" in captures.columns else F.lit(False)
    route = content_route("content_type", html) if "content_type" in captures.columns else F.lit("html")
    parsed = captures.withColumn("__route", F.when(blocked, "blocked").otherwise(route)).withColumn(
        "__events", page_events(F.when(F.col("__route") == "html", body))
    )
    article = F.when(isolate, F.expr(article_markdown("__events")))
    written = F.coalesce(article, F.expr(events_to_markdown("__events")))
    text = F.when(F.col("__route") == "html", written).when(F.col("__route").isin("pdf", "text"), body).otherwise("")
    return parsed.withColumn("markdown", text).drop("__route", "__events")


def page_signals(captures: DataFrame) -> DataFrame:
    """Title, links, block state, platform and rendering need of every capture."""
    return with_block(captures).withColumns(
        {
            "title": F.when(is_html(), title()).otherwise(""),
            "links_count": F.when(is_html(), link_count()).otherwise(0),
            "platform": platform("html", "headers" if "headers" in captures.columns else None),
            "requires_js": requires_js(),
        }
    )
