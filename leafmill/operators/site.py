"""Site discovery over captured documents: sitemaps, link crawl, site profile."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.sqltext import each, keep, let, quote
from leafmill.functions.text import decode_entities, strip_space
from leafmill.functions.urls import authority_of, is_web_url, origin_of, resolve, split_url
from leafmill.operators.signals import block_reason, platform, requires_js
from leafmill.operators.runs import ranked
from leafmill.session import durable, scratch_path
from leafmill.sources.captures import latest_captures

# Fixed value: the sitemap namespace.
SITEMAP_NS = "http://www.sitemaps.org/schemas/sitemap/0.9"
# Sites may be broadcast up to this many hosts.
BROADCAST_HOSTS = 100_000
# A host with up to this many pages and links together is crawled in one task; a larger one level by level over all tasks.
# It holds 20 bytes a link to a captured page, and some copies of these while they are sorted.
HOST_LINKS = 8_000_000
# Levels of up to this many pages are not worth a call of numpy each.
FEW_PAGES = 32
# Levels of a crawl after which the visited pages are rewritten as one table.
LEVELS_PER_TABLE = 16
_HREF = r"""href=["']([^"']+)["']"""


def sitemap_documents(documents: DataFrame) -> DataFrame:
    """url, is_index and locs of every captured sitemap, by its latest capture; other bodies give no locs.

    Only ``loc`` elements in the sitemap namespace count, so image or video locs in the
    same file do not.
    """
    body = F.regexp_replace("body", r"(?s)<!--.*?(?:-->|\z)", "")
    root = r"(?s)^\s*(?:<\?.*?\?>\s*)*(?:<!DOCTYPE[^>]*>\s*)?<((?:[\w.-]+:)?[\w.-]+)([^>]*)>"
    name, declared = F.regexp_extract(body, root, 1), F.regexp_extract(body, root, 2)
    namespace = SITEMAP_NS.replace(".", r"\.")
    default = declared.rlike(rf"""\bxmlns\s*=\s*["']{namespace}["']""")
    prefix = F.regexp_extract(declared, rf"""\bxmlns:([\w.-]+)\s*=\s*["']{namespace}["']""", 1)
    mark = F.when(default, "").when(prefix != "", F.concat(prefix, F.lit(":")))
    closed = F.rtrim(body, F.lit(" \t\r\n")).endswith(F.concat(F.lit("</"), name, F.lit(">")))
    seen = [F.col("seen_at")] if "seen_at" in documents.columns else []
    read = documents.select("url", *seen, name.alias("root"), F.when(closed, mark).alias("mark"), body.alias("body"))
    plain = F.regexp_extract_all("body", F.lit(r"(?s)<loc(?:\s[^>]*)?>(.*?)</loc\s*>"), F.lit(1))
    prefixed = F.regexp_extract_all("body", F.lit(r"(?s)<([\w.-]+:)loc(?:\s[^>]*)?>.*?</\1loc\s*>"), F.lit(0))
    read = read.withColumns({"plain": plain, "prefixed": prefixed}).filter(F.col("mark").isNotNull())
    own = keep("prefixed", lambda e: f"startswith({e}, concat('<', mark))")
    inner = each(own, lambda e: f"regexp_extract({e}, '(?s)^<[^>]*>(.*)</[^>]*>$', 1)")
    raw = keep(f"CASE WHEN mark = '' THEN plain ELSE {inner} END", lambda t: f"{t} <> ''")
    cdata = quote(r"(?s)<!\[CDATA\[(.*?)\]\]>")
    locs = each(raw, lambda t: strip_space(decode_entities(f"regexp_replace({t}, {cdata}, '$1')")))
    is_index = F.col("root") == F.concat(F.col("mark"), F.lit("sitemapindex"))
    found = read.select("url", *seen, is_index.alias("is_index"), F.expr(locs).alias("locs"))
    return latest_captures(found).select("url", "is_index", "locs")


def robots_sitemaps(documents: DataFrame) -> DataFrame:
    """(origin, url, pos) of every ``Sitemap:`` line in captured robots files."""
    lines = F.split("body", r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]")
    files = latest_captures(documents.filter(F.col("url").endswith("/robots.txt")))
    rows = files.select(F.expr(origin_of("url")).alias("origin"), F.col("url").alias("robots"), F.posexplode(lines).alias("pos", "line"))
    rows = rows.filter(F.col("robots") == F.concat("origin", F.lit("robots.txt")))
    return rows.filter(F.lower("line").startswith("sitemap:")).select(
        "origin", F.expr(strip_space("regexp_extract(line, '(?s)^[^:]*:(.*)$', 1)")).alias("url"), "pos"
    )


def expand_sitemaps(starts: DataFrame, sitemaps: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Pages reached from each site's first sitemaps: site, url, path.

    ``starts`` holds (site, url, path). Level by level the frontier meets the captured sitemaps by URL; ``path`` is the position at each
    level and gives document order. Nothing is dropped as repeated: a sitemap that two indexes name gives its pages twice. The one rule, at
    every level: no index is followed below itself, so rings end where they close. Indexes are followed to any depth, or ``max_depth`` levels down.
    """
    frontier, found, depth = starts.withColumn("via", F.array("url")), None, 0
    while max_depth is None or depth <= max_depth:
        level = frontier.join(sitemaps, "url").select("site", "is_index", "path", "via", F.posexplode("locs").alias("i", "url"))
        level = durable(level.filter(~(F.col("is_index") & F.array_contains("via", F.col("url")))).select("site", "is_index", "url", F.array_append("path", F.col("i")).alias("path"), "via"))
        pages = level.filter(~F.col("is_index")).select("site", "url", "path")
        found = pages if found is None else found.unionByName(pages)
        frontier = level.filter("is_index").select("site", "url", "path", F.array_append("via", F.col("url")).alias("via"))
        if frontier.isEmpty():
            break
        depth += 1
    return found


def sitemap_pages(sites: DataFrame, documents: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(site, url, rank): page URLs of each site in document order, from /sitemap.xml, or else from its robots file."""
    usable = documents if "status_code" not in documents.columns else documents.filter("status_code = 200")
    sitemaps = durable(sitemap_documents(usable))
    roots = sites.select("site", F.expr(origin_of("site")).alias("origin")).distinct()
    none = F.array().cast("array<int>")
    direct = expand_sitemaps(
        roots.select("site", F.concat("origin", F.lit("sitemap.xml")).alias("url"), none.alias("path")), sitemaps, max_depth
    )
    left = roots.join(direct.select("site").distinct(), "site", "left_anti")
    named = left.join(robots_sitemaps(usable), "origin").select("site", "url", F.array("pos").alias("path"))
    pages = direct.unionByName(expand_sitemaps(named, sitemaps, max_depth))
    return ranked(pages, "site", "path", "rank").select("site", "url", F.col("rank").cast("long"))


def page_links(captures: DataFrame) -> DataFrame:
    """url and its same-host links in document order, fragments dropped, by the latest capture of each URL.

    Any ``href`` in the markup counts, not only anchors. Blocked pages keep their row
    with no links: they can be visited but lead nowhere.
    """
    hrefs = f"regexp_extract_all(html, {quote(_HREF)}, 1)"

    def local_links(base: str) -> str:
        absolute = each(hrefs, lambda h: f"substring_index({resolve('url', h, base)}, '#', 1)")
        return keep(absolute, lambda u: f"{is_web_url(u)} AND {authority_of(u)} = lower({base}.authority)")

    local = let(split_url("url"), local_links)
    blocked = F.lit(False)
    if "blocked" in captures.columns:
        blocked = F.col("blocked")
    elif "status_code" in captures.columns:
        blocked = block_reason().isNotNull()
    links = F.array_distinct(F.expr(local))
    seen = [F.col("seen_at")] if "seen_at" in captures.columns else []
    read = captures.select("url", *seen, F.when(blocked, F.array().cast("array<string>")).otherwise(links).alias("links"))
    return latest_captures(read).select("url", "links")


def _on_hosts(sites: DataFrame, captures: DataFrame) -> DataFrame:
    """Captures on the hosts of ``sites``, before their html is read; the hosts are sent to every task if they are few."""
    hosts = durable(sites.select(F.expr(authority_of("site")).alias("__host")).distinct())
    few = hosts.count() <= BROADCAST_HOSTS
    wanted = F.broadcast(hosts) if few else hosts
    return captures.withColumn("__host", F.expr(authority_of("url"))).join(wanted, "__host", "left_semi").drop("__host")


def crawl_by_links(sites: DataFrame, captures: DataFrame, limit: int | None = None, host_links: int = HOST_LINKS) -> DataFrame:
    """Breadth-first visit order of each site over its captured link graph.

    Gives (site, url, rank): every page that links lead to, or the first ``limit`` of a site; a link to a page
    that was not captured is skipped and not counted. Links are taken from the html once, on the sites' hosts only. As a crawl stays on its
    host, hosts of up to ``host_links`` pages and links are crawled to their end in one pass, each within a task, whatever their depth;
    all tasks together turn URLs into numbers before, so that a host's task holds numbers alone.
    Larger hosts advance one level per round, all at once; their links are stored by URL, so a round shuffles
    its frontier and slim rows of what was visited.
    """
    spark = captures.sparkSession
    host = F.expr(authority_of("url")).alias("host")
    links = durable(page_links(_on_hosts(sites, captures)).select(host, "url", "links", F.monotonically_increasing_id().alias("page")))
    sizes = links.groupBy("host").agg(F.sum(F.size("links") + 1).alias("n"))
    starts = sites.select(F.expr(authority_of("site")).alias("host"), "site").distinct()
    large = durable(sizes.filter(F.col("n") > host_links).select("host"))
    if large.isEmpty():
        return _within_hosts(starts, links, limit)
    small = _within_hosts(starts.join(large, "host", "left_anti"), links.join(large, "host", "left_anti"), limit)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"leafmill_links_{uuid.uuid4().hex}"
    (
        links.join(large, "host", "left_semi").select("url", "links")
        .repartition(buckets, "url")
        .write.bucketBy(buckets, "url")
        .option("path", scratch_path(spark, "links"))
        .saveAsTable(name)
    )
    try:
        return small.unionByName(_visit(starts.join(large, "host", "left_semi").select("site"), spark.table(name), limit, buckets))
    finally:
        spark.sql(f"DROP TABLE {name}")


def _within_hosts(starts: DataFrame, links: DataFrame, limit: int | None) -> DataFrame:
    """Crawls of hosts whose links are known to fit a task, as numbers of pages."""
    pages = links.select("url", "page")
    found = links.select("host", F.col("page").alias("source"), F.posexplode("links").alias("i", "url")).join(pages, "url")
    found = found.select("host", "source", "i", F.col("page").alias("target"))
    begun = starts.withColumn("url", F.col("site")).join(pages, "url").select("host", "site", "page")

    def crawl(sites: pa.Table, found: pa.Table) -> pa.Table:
        source, i, target = (found.column(c).to_numpy() for c in ("source", "i", "target"))
        order = np.lexsort((i, source))
        begin = sites.column("page").to_numpy()
        numbers = np.unique(np.concatenate([source, target, begin]))
        offsets = np.searchsorted(source[order], numbers, side="left")
        offsets = np.append(offsets, len(source))
        targets = np.searchsorted(numbers, target[order])
        out = [pa.table({"site": pa.array([], pa.string()), "page": pa.array([], pa.int64()), "rank": pa.array([], pa.int64())})]
        for site, first in zip(sites.column("site").to_pylist(), np.searchsorted(numbers, begin).tolist()):
            visited = numbers[visit_order(first, offsets, targets, limit)]
            out.append(pa.table({"site": pa.repeat(site, len(visited)), "page": visited, "rank": np.arange(1, len(visited) + 1)}))
        return pa.concat_tables(out)

    visits = begun.groupBy("host").cogroup(found.groupBy("host")).applyInArrow(crawl, "site string, page long, rank long")
    return visits.join(pages, "page").select("site", "url", "rank")


def visit_order(first: int, offsets: np.ndarray, targets: np.ndarray, limit: int | None = None) -> np.ndarray:
    """Pages from ``first`` on, level by level, each level in the order in which the one before names its pages.

    The links of page k are ``targets[offsets[k]:offsets[k + 1]]``. Levels of few pages, as chains have, are followed page by page.
    """
    seen = np.zeros(len(offsets) - 1, dtype=bool)
    seen[first] = True
    level, levels, count = np.array([first]), [], 0
    while len(level) and (limit is None or count < limit):
        levels.append(level)
        count += len(level)
        if len(level) <= FEW_PAGES:
            following = []
            for page in level.tolist():
                for k in targets[offsets[page] : offsets[page + 1]].tolist():
                    if not seen[k]:
                        seen[k] = True
                        following.append(k)
            level = np.array(following, dtype=np.int64)
            continue
        begin, sizes = offsets[level], offsets[level + 1] - offsets[level]
        named = targets[np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
        named = named[~seen[named]]
        level = named[np.sort(np.unique(named, return_index=True)[1])]
        seen[level] = True
    return np.concatenate([*levels, np.array([], dtype=np.int64)])[:limit]


def _visit(sites: DataFrame, links: DataFrame, limit: int | None, buckets: int) -> DataFrame:
    start = [F.lit(0).cast("long").alias(c) for c in ("parent", "i", "done")]
    frontier = sites.select("site", F.col("site").alias("url"), *start)
    levels: list[DataFrame] = []
    while True:
        asked = frontier.select("site", "url", F.struct("parent", "i").alias("order"), "done", F.lit(False).alias("seen"))
        for rows in levels:
            asked = asked.unionByName(rows.select("site", "url", F.lit(True).alias("seen")), allowMissingColumns=True)
        # One shuffle drops repeats and what was visited before. Only captured pages are
        # ever visited, so other URLs need not be remembered.
        fresh = (
            asked.groupBy("site", "url")
            .agg(F.min("order").alias("order"), F.max("done").alias("done"), F.bool_or("seen").alias("seen"))
            .filter(~F.col("seen"))
        )
        reached = fresh.join(links, "url")
        if limit is None:
            level = ranked(reached, "site", "order", "turn")
        else:
            turn = F.row_number().over(Window.partitionBy("site").orderBy("order"))
            level = reached.withColumn("turn", turn).filter(F.col("turn") <= limit)
        level = level.withColumn("rank", (F.col("done") + F.col("turn")).cast("long"))
        if limit is not None:
            level = level.filter(F.col("rank") <= limit)
        level = durable(level.select("site", "url", "rank", "links"))
        if level.isEmpty():
            break
        levels.append(level.select("site", "url", "rank"))
        if len(levels) > LEVELS_PER_TABLE:
            levels = [durable(_together(levels).repartition(buckets, "site", "url"))]
        ends = level.groupBy("site").agg(F.max("rank").alias("done"))
        if limit is not None:
            ends = ends.filter(F.col("done") < limit)
        frontier = level.select("site", F.col("rank").alias("parent"), F.posexplode("links").alias("i", "url")).join(ends, "site")
    return _together([level.select("site", "url", "rank"), *levels])


def _together(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def site_pages(
    sites: DataFrame, documents: DataFrame, captures: DataFrame, limit: int | None = None, mapped: DataFrame | None = None
) -> DataFrame:
    """Pages of each site: from its sitemap, or by following links where it has none.

    Gives (site, source, rank, url) with the site's ``count`` and ``truncated``: all pages, or the first ``limit`` of a
    site. ``mapped`` is what ``sitemap_pages`` gave, where it is known.
    """
    mapped = durable(sitemap_pages(sites, documents)) if mapped is None else mapped
    totals = mapped.groupBy("site").agg(F.count("*").alias("total"))
    count, cut, listed = F.col("total"), F.lit(False), mapped
    if limit is not None:
        count, cut, listed = F.least("total", F.lit(limit)), F.col("total") > limit, mapped.filter(F.col("rank") <= limit)
    listed = listed.join(totals, "site").select(
        "site", F.lit("sitemap").alias("source"), "rank", "url", count.cast("long").alias("count"), cut.alias("truncated")
    )
    unmapped = sites.select("site").distinct().join(totals.select("site"), "site", "left_anti")
    crawled = durable(crawl_by_links(unmapped, captures, limit))
    sizes = crawled.groupBy("site").agg(F.count("*").alias("count"))
    followed = crawled.join(sizes, "site").select(
        "site", F.lit("links").alias("source"), "rank", "url", "count", F.lit(False).alias("truncated")
    )
    return listed.unionByName(followed)


def site_profiles(sites: DataFrame, documents: DataFrame, captures: DataFrame, mapped: DataFrame | None = None) -> DataFrame:
    """Status, block state, platform, sitemap and rendering need of each site, by the latest capture of its home page."""
    mapped = sitemap_pages(sites, documents) if mapped is None else mapped
    mapped = mapped.groupBy("site").agg(F.count("*").alias("n"))
    headers = "headers" if "headers" in captures.columns else None
    home = captures.join(sites.select(F.col("site").alias("url")).distinct(), "url", "left_semi").select(
        F.col("url").alias("site"),
        "status_code",
        block_reason().isNotNull().alias("blocked"),
        *[F.col(c) for c in ("via", "seen_at") if c in captures.columns],
        platform("html", headers).alias("platform"),
        requires_js().alias("requires_js"),
    )
    home = latest_captures(home, "site").drop("seen_at")
    pages = F.coalesce("n", F.lit(0))
    return home.join(mapped, "site", "left").select(
        *home.columns,
        F.when(pages > 0, F.concat(F.expr(origin_of("site")), F.lit("sitemap.xml"))).alias("sitemap_url"),
        pages.alias("page_count_estimate"),
    )
