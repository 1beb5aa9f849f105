"""Queries over single pages: signals, extraction, selectors, products."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import text as text_functions
from leafmill.functions.markdown import article_markdown
from leafmill.functions.markup import page_events
from leafmill.functions.urls import authority_of, resolve, scheme_of
from leafmill.operators import documents, extract, products, selectors, signals
from leafmill.plans import workflows
from leafmill.plans.registry import ORACLES, query
from leafmill.plans.views import pages, portable, run, table, view

# --------------------------------------------------------------- pieces of oracle SQL

_TAGS = (
    r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<template\b.*?</template\s*>"
    r"|<![a-z\[][^>]*>|</?[a-z][^>]*>"
)
_HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<template\b.*?</template\s*>"


def _decoded(sql: str) -> str:
    for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("amp", "&")):
        sql = f"replace({sql}, '&{name};', '{char}')"
    return sql


def _visible(html: str) -> str:
    marked = f"trim(regexp_replace({html}, '{_TAGS}', chr(1), 'g'), chr(1))"
    return _decoded(f"regexp_replace({marked}, chr(1) || '+', ' ', 'g')")


def _stripped(html: str) -> str:
    nodes = f"list_transform(string_split(regexp_replace({html}, '{_TAGS}', chr(1), 'g'), chr(1)), lambda n: trim({_decoded('n')}))"
    return f"array_to_string(list_filter({nodes}, lambda n: n <> ''), ' ')"


def _links(html: str) -> str:
    return f"len(regexp_extract_all(regexp_replace({html}, '{_HIDDEN}', ' ', 'g'), '(?i)<a\\s[^>]*href\\s*='))"


def _any(html: str, needles: tuple[str, ...]) -> str:
    quoted = ["'" + n.replace("'", "''") + "'" for n in needles]
    return "(" + " OR ".join(f"contains({html}, {q})" for q in quoted) + ")"


_CONTENT = (
    f"(length(html) >= 10000 AND length({_stripped('html')}) >= 2000 AND {_links('html')} >= 10)"
)
_REASON = (
    f"CASE WHEN ({_any('html', signals.CHALLENGE_SIGNATURES)} OR status_code IN (403, 429, 503)) AND NOT {_CONTENT} THEN "
    f"CASE WHEN {_any('html', signals.CHALLENGE_SIGNATURES)} THEN 'challenge' ELSE 'http_' || CAST(status_code AS VARCHAR) END END"
)
_TITLE = f"trim({_decoded(chr(39).join(['regexp_extract(html, ', '(?is)<title[^>]*>(.*?)</title>', ', 1)']))})"
_HOST = "lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1))"


def captures(spark, sf):
    df = view(spark, sf, "captures")
    return df.withColumn("headers", F.create_map("header_name", "header_value")).drop("header_name", "header_value")


# --------------------------------------------------------------------------- signals


def page_overview(spark, sf):
    """Pages, articles, links and text per host: the flagship query."""
    read = pages(spark, sf).select(
        F.expr(authority_of("url")).alias("host"),
        signals.looks_like_an_article().alias("article"),
        signals.link_count().alias("links"),
        F.length(F.expr(text_functions.visible_text("html"))).alias("chars"),
        (F.length(signals.title()) > 0).alias("titled"),
    )
    return (
        read.groupBy("host")
        .agg(
            F.count("*").alias("pages"),
            F.sum(F.col("article").cast("bigint")).alias("articles"),
            F.sum(F.col("titled").cast("bigint")).alias("titled"),
            F.sum("links").cast("bigint").alias("links"),
            F.sum("chars").cast("bigint").alias("chars"),
        )
        .orderBy(F.desc("pages"), "host")
    )


query(
    "page_overview",
    f"""SELECT {_HOST} AS host, count(*) AS pages, CAST(sum(CASE WHEN contains(html, '<article') THEN 1 ELSE 0 END) AS BIGINT)
 AS articles, CAST(sum(CASE WHEN length({_TITLE}) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS titled,
 CAST(sum({_links('html')}) AS BIGINT) AS links, CAST(sum(length({_visible('html')})) AS BIGINT) AS chars
 FROM pages GROUP BY 1""",
)(page_overview)


@query("page_titles", f"SELECT page_id, {_TITLE} AS title FROM pages")
def page_titles(spark, sf):
    return pages(spark, sf).select("page_id", signals.title().alias("title"))


@query("visible_text", f"SELECT page_id, {_visible('html')} AS text FROM pages")
def visible_text(spark, sf):
    return pages(spark, sf).select("page_id", F.expr(text_functions.visible_text("html")).alias("text"))


@query("link_counts", f"SELECT page_id, CAST({_links('html')} AS BIGINT) AS links FROM ({portable('captures')}) c")
def link_counts(spark, sf):
    df = view(spark, sf, "captures")
    return df.select("page_id", signals.link_count().cast("bigint").alias("links"))


@query(
    "article_flags",
    f"SELECT page_id, {_any('html', signals.ARTICLE_MARKERS)} AS article FROM ({portable('captures')}) c",
)
def article_flags(spark, sf):
    return view(spark, sf, "captures").select(
        "page_id", signals.looks_like_an_article().alias("article")
    )


@query(
    "url_pieces",
    f"""SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS scheme, {_HOST} AS domain,
 regexp_extract(url, '^[a-z]+://[^/?#]*', 0) || '/' AS origin FROM pages""",
)
def url_pieces(spark, sf):
    web, _ = signals.split_by_scheme(pages(spark, sf))
    return signals.with_url_parts(web).select("page_id", F.expr(scheme_of("url")).alias("scheme"), "domain", "origin")


@query(
    "content_routes",
    f"""SELECT page_id, CASE WHEN content_type = '' OR contains(content_type, 'html') THEN 'html'
 WHEN contains(content_type, 'pdf') THEN 'pdf' ELSE 'binary' END AS route FROM ({portable('captures')}) c""",
)
def content_routes(spark, sf):
    return view(spark, sf, "captures").select(
        "page_id", signals.content_route().alias("route")
    )


@query("real_content", f"SELECT page_id, {_CONTENT} AS real_content FROM ({portable('captures')}) c")
def real_content(spark, sf):
    return view(spark, sf, "captures").select("page_id", signals.looks_like_content().alias("real_content"))


@query(
    "block_detection",
    f"""SELECT page_id, block_reason IS NOT NULL AS blocked, block_reason
 FROM (SELECT page_id, {_REASON} AS block_reason FROM ({portable('captures')}) c) r""",
)
def block_detection(spark, sf):
    return signals.with_block(view(spark, sf, "captures")).select("page_id", "blocked", "block_reason")


_HAY = "lower(html || ' ' || header_name || ' ' || header_value)"


@query(
    "platform_detection",
    "SELECT page_id, CASE "
    + " ".join(
        f"WHEN {_any(_HAY, tuple(s.lower() for s in needles))} THEN '{name}'" for name, needles in signals.PLATFORM_SIGNALS.items()
    )
    + f" ELSE 'unknown' END AS platform FROM ({portable('captures')}) c",
)
def platform_detection(spark, sf):
    return captures(spark, sf).select("page_id", signals.platform("html", "headers").alias("platform"))


@query(
    "rendering_need",
    f"""SELECT page_id, {_any('html', signals.JS_SIGNALS)} OR (length(html) >= 500 AND length({_stripped('html')}) < 200
 AND {_links('html')} < 3) AS requires_js FROM ({portable('captures')}) c""",
)
def rendering_need(spark, sf):
    return view(spark, sf, "captures").select("page_id", signals.requires_js().alias("requires_js"))


@query(
    "page_split",
    f"""SELECT page_id, url, CASE WHEN block_reason IS NULL THEN NULL ELSE 'blocked: ' || block_reason END AS error
 FROM (SELECT page_id, url, {_REASON} AS block_reason FROM ({portable('captures')}) c) r""",
)
def page_split(spark, sf):
    df = view(spark, sf, "captures").withColumn("url", F.concat("url", F.lit("|"), F.col("page_id").cast("string")))
    usable, errors = documents.split_pages(df)
    both = usable.select("url", F.lit(None).cast("string").alias("error")).unionByName(errors)
    cut = F.split("url", r"\|")
    return both.select(F.element_at(cut, -1).cast("bigint").alias("page_id"), F.element_at(cut, 1).alias("url"), "error")


@query(
    "front_matter",
    f"""SELECT page_id, '---' || chr(10) || 'url: ' || url || chr(10) || 'status_code: ' || CAST(status_code AS VARCHAR)
 || chr(10) || 'title: ' || CASE WHEN as_html THEN title ELSE '' END || chr(10) || 'links_count: '
 || CAST(CASE WHEN as_html THEN links ELSE 0 END AS VARCHAR) || chr(10) || 'blocked: '
 || CASE WHEN block_reason IS NULL THEN 'false' ELSE 'true' END || chr(10) || 'block_reason: ' || coalesce(block_reason, '')
 || chr(10) || '---' AS front_matter FROM (SELECT page_id, url, status_code,
 (content_type = '' OR contains(content_type, 'html')) AS as_html, {_TITLE} AS title, {_links('html')} AS links,
 {_REASON} AS block_reason FROM ({portable('captures')}) c) r""",
)
def front_matter(spark, sf):
    return signals.page_signals(captures(spark, sf)).select("page_id", documents.front_matter().alias("front_matter"))


@query(
    "blocked_documents",
    f"""SELECT page_id, '---' || chr(10) || 'url: ' || url || chr(10) || 'status_code: ' || CAST(status_code AS VARCHAR) || chr(10)
 || 'title: ' || CASE WHEN as_html THEN title ELSE '' END || chr(10) || 'links_count: '
 || CAST(CASE WHEN as_html THEN links ELSE 0 END AS VARCHAR) || chr(10) || 'blocked: true' || chr(10) || 'block_reason: ' || block_reason
 || chr(10) || '---' || chr(10) || chr(10) || 'No content: the capture is a refusal (' || block_reason
 || '), so it has no text. Another capture of this URL may hold it.' AS document
 FROM (SELECT page_id, url, status_code, (content_type = '' OR contains(content_type, 'html')) AS as_html, {_TITLE} AS title,
 {_links('html')} AS links, {_REASON} AS block_reason FROM ({portable('captures')}) c) r WHERE block_reason IS NOT NULL""",
)
def blocked_documents(spark, sf):
    refused = signals.page_signals(captures(spark, sf)).filter("blocked").withColumn("markdown", F.lit(""))
    return documents.page_document(refused).select("page_id", "document")


@query("page_documents")
def page_documents(spark, sf):
    written = signals.with_markdown(signals.page_signals(captures(spark, sf)))
    return documents.page_document(written).select("page_id", "document")


_PRAISE = "repeat(p_name || ' is made well. ', 12)"


@query(
    "article_documents",
    f"""SELECT 'https://parts.example/' || CAST(p_partkey AS VARCHAR) AS url, '---' || chr(10) || 'url: https://parts.example/' || CAST(p_partkey AS VARCHAR) || chr(10)
 || 'status_code: 200' || chr(10) || 'title: ' || p_name || chr(10) || 'links_count: 2' || chr(10) || 'blocked: false' || chr(10) || 'block_reason: ' || chr(10) || '---'
 || chr(10) || chr(10) || '# ' || p_name || chr(10) || chr(10) || p_type || ': ' || trim({_PRAISE}) || chr(10) || chr(10)
 || 'See [the part](/p/' || CAST(p_partkey AS VARCHAR) || ') in **size** ' || CAST(p_size AS VARCHAR) || '.' AS document FROM part""",
)
def article_documents(spark, sf):
    """Documents of articles between a menu, an advert and a footer that do not belong to them."""
    written = run(
        spark, sf,
        f"""SELECT 'https://parts.example/' || CAST(p_partkey AS STRING) AS url, 200 AS status_code, 'text/html' AS content_type,
 '<html><head><title>' || p_name || '</title></head><body><nav><a href="/">Home</a></nav><div class="advert">Buy now</div><article><h1>' || p_name
 || '</h1><p>' || p_type || ': ' || {_PRAISE} || '</p><p>See <a href="/p/' || CAST(p_partkey AS STRING) || '">the part</a> in <b>size</b> '
 || CAST(p_size AS STRING) || '.</p></article><footer>Parts of ' || p_brand || '</footer></body></html>' AS html FROM @part""",
        dealt="part",
    )
    return documents.page_document(signals.with_markdown(signals.page_signals(written))).select("url", "document")


_LETTERS = "regexp_replace({}, '[^A-Za-z0-9]', '', 'g')"
_ARTICLE = r"regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"


@query(
    "main_content",
    f"""SELECT page_id, md5({_LETTERS.format(_visible(_ARTICLE))}) AS letters FROM pages
 WHERE length({_LETTERS.format(_visible(_ARTICLE))}) >= 200""",
)
def main_content(spark, sf):
    """Letters of the isolated article; an article of few letters counts as a miss."""
    read = pages(spark, sf).select("page_id", page_events(F.col("html")).alias("events"))
    found = read.select("page_id", F.expr(article_markdown("events")).alias("markdown"))
    letters = F.regexp_replace("markdown", "[^A-Za-z0-9]", "")
    return found.filter(F.length(letters) >= 200).select("page_id", F.md5(letters).alias("letters"))


@query(
    "listing_markdown",
    """SELECT 'https://list.example/' || p_brand || '/' || CAST(p_partkey // 1000 AS VARCHAR) AS url,
 string_agg('## ' || p_name || chr(10) || chr(10) || '[go](/p/' || CAST(p_partkey AS VARCHAR) || ')'
 || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END, chr(10) || chr(10) ORDER BY p_partkey) AS markdown
 FROM part GROUP BY p_brand, p_partkey // 1000""",
)
def listing_markdown(spark, sf):
    return signals.with_markdown(view(spark, sf, "listing_pages"), "off").select("url", "markdown")


@query(
    "listing_documents",
    f"""SELECT '---' || chr(10) || 'url: ' || url || chr(10) || 'status_code: 200' || chr(10) || 'title: ' || chr(10) || 'links_count: '
 || CAST(n AS VARCHAR) || chr(10) || 'blocked: false' || chr(10) || 'block_reason: ' || chr(10) || '---' || chr(10) || chr(10) || markdown
 AS document FROM (SELECT m.url, m.markdown, c.n FROM ({ORACLES["listing_markdown"]}) m JOIN
 (SELECT 'https://list.example/' || p_brand || '/' || CAST(p_partkey // 1000 AS VARCHAR) AS url, count(*) AS n FROM part
 GROUP BY p_brand, p_partkey // 1000) c ON m.url = c.url) r""",
)
def listing_documents(spark, sf):
    pages_ = view(spark, sf, "listing_pages").withColumns({"status_code": F.lit(200), "content_type": F.lit("text/html")})
    written = signals.with_markdown(signals.page_signals(pages_))
    return documents.page_document(written).select("document")


@query(
    "resolved_references",
    """SELECT p_partkey, 'https://s' || CAST(p_partkey % 5 AS VARCHAR) || '.example/' ||
 CASE p_partkey % 4 WHEN 0 THEN 'a/x' WHEN 1 THEN 'x' WHEN 2 THEN 'a/b?q=1' ELSE 'a/' END AS target FROM part""",
)
def resolved_references(spark, sf):
    host = F.concat(F.lit("https://s"), (F.col("p_partkey") % 5).cast("string"), F.lit(".example/a/b?z=2#f"))
    kind = F.col("p_partkey") % 4
    reference = F.when(kind == 0, "x").when(kind == 1, "../x").when(kind == 2, "?q=1").otherwise("./c/..")
    cases = table(spark, sf, "part").select("p_partkey", host.alias("host"), reference.alias("ref"))
    return cases.select("p_partkey", F.expr(resolve("host", "ref")).alias("target"))


# ------------------------------------------------------------------------ extraction

_CONTACT_URL = """'https://' || source || '.example/' || CASE doc_id % 3 WHEN 0 THEN 'contact' WHEN 1 THEN 'about' ELSE 'page' END
 || '/' || CAST(doc_id AS VARCHAR)"""
_PHONE = "'+44 7700 ' || lpad(CAST(doc_id % 1000000 AS VARCHAR), 6, '0')"
_EMAIL = "'u' || CAST(doc_id % 97 AS VARCHAR) || '@' || source || '.example.com'"
_TEXT = f"'Call ' || {_PHONE} || ' or mail ' || {_EMAIL} || ' today © 2024 Order 1234 5678 GH F M'"


def _context(value: str) -> str:
    at = f"strpos({_TEXT}, {value})"
    start = f"greatest(1, {at} - 60)"
    return f"trim(substring({_TEXT}, {start}, {at} - {start} + length({value}) + 60))"


@query("emails", f"SELECT {_CONTACT_URL} AS url, {_EMAIL} AS value, {_context(_EMAIL)} AS context FROM documents")
def emails(spark, sf):
    return extract.extract_emails(view(spark, sf, "contact_pages")).select("url", "value", "context")


@query(
    "document_emails",
    r"""SELECT doc_id, value FROM (SELECT doc_id, unnest(regexp_extract_all(text,
 '\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b')) AS value FROM documents) m GROUP BY doc_id, value""",
)
def document_emails(spark, sf):
    df = table(spark, sf, "documents").select(F.col("source").alias("url"), "doc_id", "text")
    return extract.extract_emails(df, carry=("doc_id",), text="text").select("doc_id", "value")


@query("phones", f"SELECT {_CONTACT_URL} AS url, {_PHONE} AS value, {_context(_PHONE)} AS context FROM documents")
def phones(spark, sf):
    return extract.extract_phones(view(spark, sf, "contact_pages")).select("url", "value", "context")


@query(
    "links",
    """WITH p AS (SELECT p_partkey, 'https://s' || CAST(p_partkey % 5 AS VARCHAR) || '.example' AS host, p_partkey // 5 AS i FROM part),
 e AS (SELECT p_partkey, host, i, 0 AS pos, host || '/p/' || CAST(i * 2 AS VARCHAR) || '#a' AS value, 'l' AS context FROM p
 UNION ALL SELECT p_partkey, host, i, 1, host || '/p/' || CAST(i * 2 + 1 AS VARCHAR), 'r' FROM p
 UNION ALL SELECT p_partkey, host, i, 2, 'https://other.example/z', 'o' FROM p
 UNION ALL SELECT p_partkey, host, i, 3, host || '/p/1', 'home' FROM p)
 SELECT host || '/p/' || CAST(i AS VARCHAR) AS url, value, arg_min(context, pos) AS context FROM e
 GROUP BY p_partkey, host, i, value""",
)
def links(spark, sf):
    return extract.extract_links(view(spark, sf, "site_pages")).select("url", "value", "context")


@query(
    "social_links",
    f"SELECT {_CONTACT_URL} AS url, 'github' AS platform, 'https://www.github.com/u' || CAST(doc_id AS VARCHAR) AS value FROM documents",
)
def social_links(spark, sf):
    return extract.extract_social_links(view(spark, sf, "contact_pages")).select("url", "platform", "value")


@query(
    "selector_rows",
    """SELECT 'https://list.example/' || p_brand || '/' || CAST(p_partkey // 1000 AS VARCHAR) AS url, p_name AS title,
 'https://list.example/p/' || CAST(p_partkey AS VARCHAR) AS link, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END AS kind,
 'card c' || CAST(p_size AS VARCHAR) AS classes FROM part""",
)
def selector_rows(spark, sf):
    fields = {"title": "h2.t", "link": "a.l@href", "kind": "div.card > span.s", "classes": "@class"}
    rows, _ = selectors.extract_by_selector(view(spark, sf, "listing_pages"), fields, row_selector=".grid .card")
    return rows.select("url", *fields)


@query(
    "selector_pages",
    """SELECT page_id, regexp_extract(html, '<h1>(.*?)</h1>', 1) <> '' AS headed,
 'http' || regexp_extract(url, '^http(s?://[^/?#]*)', 1) || regexp_extract(html, '<li><a href="([^"]*)"', 1) AS first_link
 FROM pages""",
)
def selector_pages(spark, sf):
    fields = {"heading": "article > h1", "first_link": "nav li:bad, x", "link": "nav ul li a[href]@href"}
    rows, _ = selectors.extract_by_selector(pages(spark, sf), fields, carry=("page_id",))
    return rows.select("page_id", (F.col("heading") != "").alias("headed"), F.col("link").alias("first_link"))


# What each selector picks first on a listing page: a card is a div of class card with a heading, a link and, for two parts in three, a span.
_FORMS = {
    "has": ("div:has(> span.s) > h2.t", "min_by(p_name, p_partkey) FILTER (p_partkey % 3 <> 0)"),
    "has_not": (".card:not(:has(span)) h2", "min_by(p_name, p_partkey) FILTER (p_partkey % 3 = 0)"),
    "has_next": ("h2:has(+ a + span)", "min_by(p_name, p_partkey) FILTER (p_partkey % 3 <> 0)"),
    "has_later": ("h2:has(~ span)", "min_by(p_name, p_partkey) FILTER (p_partkey % 3 <> 0)"),
    "nth_last_child": (".grid > div:nth-last-child(1) h2", "max_by(p_name, p_partkey)"),
    "nth_last_of_type": (".grid > div:nth-last-of-type(2) h2", "max_by(p_name, p_partkey, 2)[2]"),
    "first_of_type": ("span:first-of-type", "min_by(p_type, p_partkey) FILTER (p_partkey % 3 <> 0)"),
    "last_of_type": ("div.card:last-of-type > h2:only-of-type", "max_by(p_name, p_partkey)"),
    "nth_of_type": (".card:nth-of-type(2) a@href", "'https://list.example/p/' || CAST(min_by(p_partkey, p_partkey, 2)[2] AS VARCHAR)"),
    "root": (":root > body > .grid > .card > h2", "min_by(p_name, p_partkey)"),
    "contains": (".card:contains('BRASS') h2", "min_by(p_name, p_partkey) FILTER (p_partkey % 3 <> 0 AND contains(p_type, 'BRASS') OR contains(p_name, 'BRASS'))"),
    "siblings": (".card ~ .card ~ .card h2", "min_by(p_name, p_partkey, 3)[3]"),
    "unlike": ("a[href!='x'][class='L' i]", "'go'"),
    "hovered": ("a:hover", "''"),
    "no_selector": ("a:linked", "''"),
}


@query(
    "selector_forms",
    f"""SELECT 'https://list.example/' || p_brand || '/' || CAST(p_partkey // 1000 AS VARCHAR) AS url,
 {', '.join(f"coalesce({answer}, '') AS {name}" for name, (_, answer) in _FORMS.items())} FROM part GROUP BY p_brand, p_partkey // 1000""",
)
def selector_forms(spark, sf):
    rows, _ = selectors.extract_by_selector(view(spark, sf, "listing_pages"), {name: selector for name, (selector, _) in _FORMS.items()})
    return rows.drop("pos")


@query(
    "selector_errors",
    """SELECT 'https://list.example/' || p_brand || '/' || CAST(p_partkey // 1000 AS VARCHAR) AS url,
 'none of the selectors picked an element' AS error FROM part GROUP BY p_brand, p_partkey // 1000 HAVING max(p_size) < 50""",
)
def selector_errors(spark, sf):
    _, errors = selectors.extract_by_selector(view(spark, sf, "listing_pages"), {"t": ".c50 .t"})
    return errors


_PRICE = "round(p_retailprice * 100) / 100"
_SHOP = "'https://shop' || CAST(p_partkey % 5 AS VARCHAR) || '.example'"


@query(
    "products",
    f"""SELECT {_SHOP} || '/p/' || CAST(p_partkey AS VARCHAR) AS url, p_name AS name, {_PRICE} AS price,
 CASE p_partkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' END AS currency, CASE p_partkey % 4 WHEN 0 THEN 'InStock' END AS availability,
 CASE WHEN p_partkey % 4 IN (0, 2) THEN p_brand END AS brand, CASE p_partkey % 4 WHEN 0 THEN 'S-' || CAST(p_partkey AS VARCHAR) END AS sku,
 CASE p_partkey % 4 WHEN 0 THEN {_SHOP} || '/p/img/' || CAST(p_partkey AS VARCHAR) || '.jpg'
 WHEN 2 THEN {_SHOP} || '/m/' || CAST(p_partkey AS VARCHAR) || '.png' END AS image,
 CASE p_partkey % 4 WHEN 0 THEN 4.5 END::DOUBLE AS rating, CASE p_partkey % 4 WHEN 0 THEN p_size END AS review_count,
 CASE p_partkey % 4 WHEN 0 THEN 'json-ld' WHEN 1 THEN 'opengraph' ELSE 'microdata' END AS source
 FROM part WHERE p_partkey % 4 < 3""",
)
def product_records(spark, sf):
    found, _ = products.extract_products(view(spark, sf, "product_pages"))
    return found.drop("description")


@query(
    "product_errors",
    f"""SELECT {_SHOP} || '/p/' || CAST(p_partkey AS VARCHAR) AS url, 'no structured product data on this page' AS error
 FROM part WHERE p_partkey % 4 = 3""",
)
def product_errors(spark, sf):
    return products.extract_products(view(spark, sf, "product_pages"))[1]


@query(
    "price_comparison",
    f"""SELECT {_SHOP} || '/p/' || CAST(p_partkey AS VARCHAR) AS url, p_name AS name, {_PRICE} AS price,
 CASE p_partkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' END AS currency,
 CASE p_partkey % 4 WHEN 0 THEN 'json-ld' WHEN 1 THEN 'opengraph' ELSE 'microdata' END AS source, false AS out_of_stock
 FROM part WHERE p_partkey % 4 < 3""",
)
def price_comparison(spark, sf):
    return workflows.compare_prices(view(spark, sf, "product_pages"))[0]


@query(
    "search_hits",
    """WITH h AS (SELECT p_brand || ' ' || CAST(p_partkey // 1000 AS VARCHAR) AS query, p_partkey, p_name, p_type,
 CASE p_partkey % 2 WHEN 0 THEN 'https://r.example/' ELSE 'https://d.example/' END || CAST(p_size AS VARCHAR) AS url FROM part),
 f AS (SELECT query, url, min(p_partkey) AS first_at, arg_min(p_name, p_partkey) AS title, arg_min(p_type, p_partkey) AS kind
 FROM h GROUP BY query, url),
 r AS (SELECT *, row_number() OVER (PARTITION BY f.query ORDER BY f.first_at) AS n FROM f)
 SELECT query, CAST(n AS BIGINT) AS rank, title, url, 'about ' || kind AS snippet FROM r""",
)
def search_hits(spark, sf):
    return extract.search_results(view(spark, sf, "search_pages")).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "network_responses",
    """SELECT page_url, url, method, status, content_type, CAST(length(b) AS BIGINT) AS size, b AS body,
 false AS body_truncated FROM (SELECT 'https://app.example/' || CAST(user_id AS VARCHAR) AS page_url,
 'https://api.example/' || event_type || '/' || CAST(event_id AS VARCHAR) AS url, 'GET' AS method, 200 AS status,
 CASE event_type WHEN 'click' THEN 'text/css' ELSE 'application/json' END AS content_type,
 repeat(props, CAST(1 + event_id % 40 AS INT)) AS b FROM events WHERE event_type <> 'view') r""",
)
def network_responses(spark, sf):
    found = extract.largest_responses(view(spark, sf, "network_log"), include_types="JSON, css")
    return found.drop("event_id").withColumn("size", F.col("size").cast("bigint"))


@query(
    "contact_finder",
    f"""WITH d AS (SELECT source || '.example' AS site, {_CONTACT_URL} AS url, {_PHONE} AS phone, {_EMAIL} AS email,
 'https://www.github.com/u' || CAST(doc_id AS VARCHAR) AS gh, doc_id % 3 < 2 AS liked FROM documents),
 c AS (SELECT site, url, 'email' AS type, email AS value FROM d
 UNION ALL SELECT site, url, 'phone', phone FROM d UNION ALL SELECT site, url, 'github', gh FROM d)
 SELECT site, type, value, count(DISTINCT url) AS pages, false AS shared FROM c GROUP BY site, type, value""",
)
def contact_finder(spark, sf):
    return workflows.find_contacts(view(spark, sf, "contact_pages"))
