"""Queries over sites, catalogues, places and attempts."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import attempts, catalog, places, site
from leafmill.plans import workflows
from leafmill.plans.page_queries import _REASON
from leafmill.plans.registry import ORACLES, query
from leafmill.plans.views import portable, run, table, view
from leafmill.sources.tables import ResultTables

# ----------------------------------------------------------------------------- sites

def _homes(spark, sf):
    return run(spark, sf, "SELECT DISTINCT 'https://s' || CAST(p_partkey % 5 AS STRING) || '.example/p/1' AS site FROM @part")


_TREE = """t AS (SELECT p_partkey % 5 AS k, 'https://s' || CAST(p_partkey % 5 AS VARCHAR) || '.example' AS host,
 p_partkey // 5 AS i, p_partkey FROM part)"""


@query(
    "sitemap_pages",
    f"""WITH {_TREE} SELECT host || '/p/1' AS site, host || '/p/' || CAST(i AS VARCHAR) AS url,
 CAST(row_number() OVER (PARTITION BY host ORDER BY i) AS BIGINT) AS rank FROM t WHERE k < 3""",
)
def sitemap_pages(spark, sf):
    return site.sitemap_pages(_homes(spark, sf), view(spark, sf, "sitemaps"))


_KNOT = "'https://' || lower(replace(replace(r_name, ' ', ''), '#', '')) || '.example'"


def _knotted(spark, sf):
    """A site per region: its sitemap names itself, a ring of two indexes and a diamond, whose sitemap lists the nations."""
    xml = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    index = lambda *names: f"'<sitemapindex {xml}>' || " + " || ".join(f"'<sitemap><loc>' || {_KNOT} || '/{n}</loc></sitemap>'" for n in names) + " || '</sitemapindex>'"
    files = {"sitemap.xml": index("sitemap.xml", "a.xml", "b.xml", "a.xml"), "a.xml": index("b.xml", "leaf.xml"), "b.xml": index("a.xml", "leaf.xml", "sitemap.xml")}
    parts = [f"SELECT {_KNOT} || '/{name}' AS url, {body} AS body FROM @region" for name, body in files.items()]
    pages = f"listagg('<url><loc>' || {_KNOT} || '/n/' || n_name || '</loc></url>', '') WITHIN GROUP (ORDER BY n_nationkey)"
    parts.append(f"SELECT {_KNOT} || '/leaf.xml', '<urlset {xml}>' || {pages} || '</urlset>' FROM @region JOIN @nation ON n_regionkey = r_regionkey GROUP BY r_name")
    return run(spark, sf, " UNION ALL ".join(parts))


@query(
    "knotted_sitemaps",
    f"""WITH n AS (SELECT {_KNOT} AS host, n_name, n_nationkey, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) AS i, count(*) OVER (PARTITION BY r_name) AS total
 FROM region JOIN nation ON n_regionkey = r_regionkey)
 SELECT host || '/' AS site, host || '/n/' || n_name AS url, CAST(t * total + i AS BIGINT) AS rank FROM n CROSS JOIN (SELECT unnest(range(6)) AS t)""",
)
def knotted_sitemaps(spark, sf):
    """Six ways lead to the leaf: a, a-b, b-a, b, and a and a-b once more, as the site's sitemap names a twice."""
    return site.sitemap_pages(run(spark, sf, f"SELECT {_KNOT} || '/' AS site FROM @region"), _knotted(spark, sf))


@query(
    "robots_sitemaps",
    """SELECT 'https://s2.example/' AS origin, 'https://s2.example/sm' || CAST(b AS VARCHAR) || '.xml' AS url, CAST(b + 1 AS BIGINT) AS pos
 FROM (SELECT DISTINCT (p_partkey // 5) // 500 AS b FROM part WHERE p_partkey % 5 = 2) r""",
)
def robots_sitemaps(spark, sf):
    return site.robots_sitemaps(view(spark, sf, "sitemaps")).withColumn("pos", F.col("pos").cast("bigint"))


_CRAWL = f"""WITH {_TREE}, m AS (SELECT host, max(i) AS top FROM t GROUP BY host)
 SELECT t.host || '/p/1' AS site, t.host || '/p/' || CAST(i AS VARCHAR) AS url, CAST(i AS BIGINT) AS rank FROM t WHERE i >= 1"""


@query("link_crawl", _CRAWL)
def link_crawl(spark, sf):
    """A complete binary tree is visited in heap order, so a page's number is its rank."""
    return site.crawl_by_links(_homes(spark, sf), view(spark, sf, "site_pages"))


@query("link_crawl_first", _CRAWL + " AND i <= 500")
def link_crawl_first(spark, sf):
    """The first 500 pages of each site."""
    return site.crawl_by_links(_homes(spark, sf), view(spark, sf, "site_pages"), 500)


def _recaptured(spark, sf):
    """Each page captured up to three times, the latest with the real links; equal captures at equal times included."""
    captures = view(spark, sf, "site_pages").withColumn("page", F.xxhash64("url"))
    times = F.when(F.pmod("page", F.lit(3)) == 0, F.array(F.lit(2))).when(F.pmod("page", F.lit(3)) == 1, F.array(F.lit(2), F.lit(2))).otherwise(
        F.array(F.lit(1), F.lit(2), F.lit(0))
    )
    return captures.select("url", "html", F.explode(times).alias("seen_at")).withColumn(
        "html", F.when(F.col("seen_at") == 2, F.col("html")).otherwise(F.lit('<a href="/p/7">old</a>'))
    )


@query("recaptured_crawl", _CRAWL)
def recaptured_crawl(spark, sf):
    return site.crawl_by_links(_homes(spark, sf), _recaptured(spark, sf))


@query(
    "site_pages",
    f"""WITH {_TREE}, s AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY i) AS n FROM t WHERE k < 3),
 c AS (SELECT *, i AS n FROM t WHERE k >= 3 AND i >= 1),
 a AS (SELECT host, 'sitemap' AS source, i, n FROM s UNION ALL SELECT host, 'links', i, n FROM c),
 z AS (SELECT host, count(*) AS total FROM t WHERE k < 3 GROUP BY host UNION ALL SELECT host, count(*) FROM c GROUP BY host)
 SELECT a.host || '/p/1' AS site, a.source, CAST(a.n AS BIGINT) AS rank, a.host || '/p/' || CAST(a.i AS VARCHAR) AS url,
 CAST(z.total AS BIGINT) AS count, false AS truncated FROM a JOIN z ON a.host = z.host""",
)
def site_pages(spark, sf):
    return site.site_pages(_homes(spark, sf), view(spark, sf, "sitemaps"), view(spark, sf, "site_pages"))


def _site_captures(spark, sf):
    return view(spark, sf, "site_pages").withColumns(
        {"status_code": F.lit(200), "content_type": F.lit("text/html"), "via": F.lit("plain")}
    )


@query(
    "site_profiles",
    f"""WITH {_TREE}, z AS (SELECT host, k, count(*) AS n FROM t GROUP BY host, k)
 SELECT host || '/p/1' AS site, 200 AS status_code, false AS blocked, 'plain' AS via, 'unknown' AS platform, false AS requires_js,
 CASE WHEN k < 3 THEN host || '/sitemap.xml' END AS sitemap_url, CASE WHEN k < 3 THEN n ELSE 0 END AS page_count_estimate FROM z""",
)
def site_profiles(spark, sf):
    return site.site_profiles(_homes(spark, sf), view(spark, sf, "sitemaps"), _site_captures(spark, sf))


@query(
    "site_scrape",
    f"""WITH {_TREE}, a AS (SELECT host, 'sitemap' AS source, k, i, row_number() OVER (PARTITION BY host ORDER BY i) AS n FROM t
 WHERE k < 3 UNION ALL SELECT host, 'links', k, i, i FROM t WHERE k >= 3 AND i > 0)
 SELECT host || '/p/1' AS site, source, count(*) AS pages, CAST(0 AS BIGINT) AS blocked_pages, CAST(count(*) * 4 AS BIGINT) AS links
 FROM a GROUP BY host, source""",
)
def site_scrape(spark, sf):
    done = workflows.scrape_sites(_homes(spark, sf), view(spark, sf, "sitemaps"), _site_captures(spark, sf))
    return done.counts


@query("saved_scrape", ORACLES["site_scrape"])
def saved_scrape(spark, sf):
    """The counts of a scrape that was saved, from its table."""
    tables = ResultTables(spark, "leafmill_" + "".join(c if c.isalnum() else "_" for c in spark.sparkContext.applicationId))
    done = workflows.scrape_sites(_homes(spark, sf), view(spark, sf, "sitemaps"), _site_captures(spark, sf))
    workflows.save_scrape(tables, "scraped", done)
    return tables.read("scraped_counts")


# ------------------------------------------------------------------------ catalogues

PAGE = 10


_VARIANTS = """v AS (SELECT *, 'https://store' || CAST(p_partkey % 5 AS VARCHAR) || '.example' AS store FROM part
 WHERE p_partkey % 5 < 3 AND p_partkey % 7 <> 0),
 x AS (SELECT *, 1 AS n, 1000 + p_size + 0.5 AS price FROM v UNION ALL SELECT *, 2, p_size FROM v)"""


@query(
    "catalog_variants",
    f"""WITH {_VARIANTS} SELECT store AS store_url, p_name AS product_title, 'V' || CAST(n AS VARCHAR) AS variant_title,
 CASE n WHEN 2 THEN 'K2' END AS sku, CAST(price AS DOUBLE) AS price, CAST(NULL AS DOUBLE) AS compare_at_price, n = 1 AS available,
 CASE n WHEN 1 THEN 'L' ELSE 'L / Red' END AS options, p_brand AS vendor, p_type AS product_type, 'a, b' AS tags,
 'https://cdn.example/' || CAST(p_partkey AS VARCHAR) || '.jpg' AS image, store || '/products/h' || CAST(p_partkey AS VARCHAR)
 AS product_url, p_partkey AS product_id, CAST(n AS BIGINT) AS variant_id FROM x""",
)
def catalog_variants(spark, sf):
    items, _ = catalog.store_products(view(spark, sf, "catalog"), PAGE)
    return catalog.variant_rows(items)


@query(
    "catalog_products",
    """SELECT store_url, CAST(page AS BIGINT) AS page, CAST(pos AS BIGINT) AS pos, p_name AS title FROM (SELECT
 'https://store' || CAST(p_partkey % 5 AS VARCHAR) || '.example' AS store_url, 1 + p_partkey // 50 AS page, p_name,
 row_number() OVER (PARTITION BY p_partkey % 5 ORDER BY p_partkey) - 1 AS pos FROM part WHERE p_partkey % 5 < 3) r WHERE pos < 33""",
)
def catalog_products(spark, sf):
    items, _ = catalog.store_products(view(spark, sf, "catalog"), PAGE, max_products=33)
    return items.select(
        "store_url", F.col("page").cast("bigint").alias("page"), F.col("pos").cast("bigint").alias("pos"), F.col("item.title").alias("title")
    )


@query(
    "catalog_errors",
    """SELECT 'https://store3.example' AS store_url, 'https://store3.example/products.json is not JSON' AS error
 UNION ALL SELECT 'https://store4.example',
 'https://store4.example/ has no products.json, so it is no store of this kind'""",
)
def catalog_errors(spark, sf):
    return catalog.store_products(view(spark, sf, "catalog"), PAGE)[1]


@query(
    "catalog_collections",
    """SELECT store AS store_url, title, handle, products_count, store || '/collections/' || handle AS url FROM (
 SELECT 'https://store' || CAST(s_suppkey AS VARCHAR) || '.example' AS store, s_name AS title,
 'c' || CAST(s_suppkey AS VARCHAR) AS handle, s_nationkey * 3 AS products_count FROM supplier
 UNION ALL SELECT 'https://store' || CAST(s_suppkey AS VARCHAR) || '.example', 'All', 'all', 9 FROM supplier) c""",
)
def catalog_collections(spark, sf):
    return catalog.collections(view(spark, sf, "collections"))[0]


@query(
    "catalog_summary",
    f"""WITH {_VARIANTS} SELECT store AS store_url, count(*) AS variants, count(DISTINCT p_partkey) AS products,
 CAST(min(price) AS DOUBLE) AS min_price, CAST(max(price) AS DOUBLE) AS max_price, count(DISTINCT p_brand) AS vendors,
 CAST(sum(n - 1) AS BIGINT) AS out_of_stock FROM x GROUP BY store""",
)
def catalog_summary(spark, sf):
    done = workflows.export_catalogs(view(spark, sf, "catalog"), view(spark, sf, "collections"), PAGE)
    return done.summary


# ---------------------------------------------------------------------------- places

_LAT = "CAST('51.' || lpad(CAST({} AS VARCHAR), 4, '0') AS DOUBLE)"
_LON = "CAST('-2.' || lpad(CAST({} AS VARCHAR), 4, '0') AS DOUBLE)"
_AMENITY = "CASE c_nationkey % 3 WHEN 0 THEN 'dentist' WHEN 1 THEN 'cafe' ELSE 'pub' END"


@query(
    "place_search",
    f"""SELECT s_name AS query, r AS rank, s_name AS name, 'tourism/museum' AS category, s_name || ', Street ' || CAST(r AS VARCHAR)
 || ', Bath' AS address, {_LAT.format('s_suppkey * 13 % 997')} AS lat, {_LON.format('s_suppkey * 17 % 991')} AS lon, '+44 2' AS phone,
 CAST(NULL AS VARCHAR) AS website, CAST(NULL AS VARCHAR) AS opening_hours, 'way' AS osm_type, s_suppkey AS osm_id,
 'nominatim' AS source FROM supplier CROSS JOIN (SELECT 1 AS r UNION ALL SELECT 2) k WHERE s_suppkey % 6 <> 5""",
)
def place_search(spark, sf):
    return places.search_places(view(spark, sf, "geocode"))


@query(
    "map_elements",
    f"""SELECT c_custkey, CASE WHEN c_custkey % 10 <> 9 THEN c_name END AS name, 'amenity/' || {_AMENITY} AS category,
 'Bath' AS address, {_LAT.format('c_custkey % 997')} AS lat, {_LON.format('c_custkey % 991')} AS lon, '+44 1' AS phone,
 CAST(NULL AS VARCHAR) AS website, CAST(NULL AS VARCHAR) AS opening_hours, CASE c_custkey % 2 WHEN 0 THEN 'node' ELSE 'way' END AS osm_type,
 c_custkey AS osm_id, 'overpass' AS source FROM customer""",
)
def map_elements(spark, sf):
    return places.element_places(view(spark, sf, "places"), carry=("c_custkey",)).drop("tags")


_CATEGORY = "CASE p_partkey % 4 WHEN 0 THEN ' Estate Agent' WHEN 1 THEN 'gym' WHEN 2 THEN 'shop=' || p_type ELSE p_name END"


@query(
    "category_tags",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'office' WHEN 1 THEN 'leisure' ELSE 'shop' END AS tag_key,
 CASE p_partkey % 4 WHEN 0 THEN 'estate_agent' WHEN 1 THEN 'fitness_centre' ELSE lower(replace(p_type, ' ', '_')) END AS tag_value
 FROM part WHERE p_partkey % 4 < 3""",
)
def category_tags(spark, sf):
    asked = run(spark, sf, f"SELECT p_partkey, {_CATEGORY} AS category FROM @part")
    return places.category_tags(asked)[0].select("p_partkey", "tag_key", "tag_value")


@query(
    "category_errors",
    "SELECT p_partkey, 'no such category: ' || p_name AS error FROM part WHERE p_partkey % 4 = 3",
)
def category_errors(spark, sf):
    asked = run(spark, sf, f"SELECT p_partkey, {_CATEGORY} AS category FROM @part")
    return places.category_tags(asked)[1].select("p_partkey", "error")


_CENTRES = f"""SELECT s_name AS query, {_LAT.format('s_suppkey * 13 % 997')} AS lat, {_LON.format('s_suppkey * 17 % 991')} AS lon,
 s_name || ', Street 1, Bath' AS label FROM supplier WHERE s_suppkey % 6 <> 5"""


@query("geocoded_centres", _CENTRES)
def geocoded_centres(spark, sf):
    asked = table(spark, sf, "supplier").select(F.col("s_name").alias("query"))
    return places.geocode(asked, view(spark, sf, "geocode"))[0]


@query(
    "geocode_errors",
    "SELECT s_name AS query, 'no place found for ' || s_name AS error FROM supplier WHERE s_suppkey % 6 = 5",
)
def geocode_errors(spark, sf):
    asked = table(spark, sf, "supplier").select(F.col("s_name").alias("query"))
    return places.geocode(asked, view(spark, sf, "geocode"))[1]


_HAVERSINE = """2 * 6371000.0 * asin(sqrt(pow(sin(radians(p.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(p.lat))
 * pow(sin(radians(p.lon - c.lon) / 2), 2)))"""


@query(
    "nearby_places",
    f"""WITH c AS ({_CENTRES}), p AS (SELECT c_custkey, CASE WHEN c_custkey % 10 <> 9 THEN c_name END AS name, {_AMENITY} AS amenity,
 {_LAT.format('c_custkey % 997')} AS lat, {_LON.format('c_custkey % 991')} AS lon,
 CASE c_custkey % 2 WHEN 0 THEN 'node' ELSE 'way' END AS osm_type FROM customer),
 d AS (SELECT c.query, p.*, {_HAVERSINE} AS m FROM c CROSS JOIN p WHERE p.amenity = 'cafe' AND abs(p.lat - c.lat) < 0.02),
 r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY osm_type, c_custkey) AS n FROM d WHERE m <= 2000)
 SELECT query, osm_type, c_custkey AS osm_id, name, CAST(round(m) AS BIGINT) AS metres FROM r WHERE n <= 20 AND name IS NOT NULL""",
)
def nearby_places(spark, sf):
    asked = table(spark, sf, "supplier").select(F.col("s_name").alias("query"), F.lit("cafe").alias("category"))
    centres, _ = places.geocode(asked, view(spark, sf, "geocode"))
    tagged, _ = places.category_tags(asked)
    found = places.nearby_places(
        centres.join(tagged, "query"), places.element_places(view(spark, sf, "places")), radius_m=2000, limit=20
    )
    return found.select("query", "osm_type", "osm_id", "name", places.whole_metres(F.col("distance_m")).alias("metres"))


@query(
    "all_nearby_places",
    f"""WITH c AS ({_CENTRES}), p AS (SELECT c_custkey, CASE WHEN c_custkey % 10 <> 9 THEN c_name END AS name, {_AMENITY} AS amenity,
 {_LAT.format('c_custkey % 997')} AS lat, {_LON.format('c_custkey % 991')} AS lon,
 CASE c_custkey % 2 WHEN 0 THEN 'node' ELSE 'way' END AS osm_type FROM customer),
 d AS (SELECT c.query, p.*, {_HAVERSINE} AS m FROM c CROSS JOIN p WHERE abs(p.lat - c.lat) < 0.02)
 SELECT query, amenity, osm_type, c_custkey AS osm_id, name, CAST(round(m) AS BIGINT) AS metres FROM d WHERE m <= 2000 AND name IS NOT NULL""",
)
def all_nearby_places(spark, sf):
    """Every named place of the three categories, without a limit; ``nearby_places`` has the first twenty cafes by type and id."""
    asked = table(spark, sf, "supplier").select(F.col("s_name").alias("query"))
    centres, _ = places.geocode(asked, view(spark, sf, "geocode"))
    wanted = asked.withColumn("category", F.explode(F.array(*map(F.lit, ("dentist", "cafe", "pub")))))
    tagged, _ = places.category_tags(wanted)
    found = places.nearby_places(centres.join(tagged, "query"), places.element_places(view(spark, sf, "places")), radius_m=2000)
    return found.select(
        "query", F.col("tag_value").alias("amenity"), "osm_type", "osm_id", "name", places.whole_metres(F.col("distance_m")).alias("metres")
    )


# -------------------------------------------------------------------------- attempts

_MIRROR_STEPS = f"""a AS (SELECT *, CASE WHEN status_code IN (429, 502, 503, 504) THEN 'pass' WHEN status_code <> 200 THEN 'hard'
 WHEN body = '<busy>' THEN 'pass' ELSE 'ok' END AS outcome FROM ({portable('mirrors')}) m),
 e AS (SELECT request_id, min(attempt) FILTER (WHERE outcome <> 'pass') AS stop FROM a GROUP BY request_id)"""


@query(
    "first_usable_response",
    f"""WITH {_MIRROR_STEPS} SELECT a.request_id, a.host, a.body FROM a JOIN e ON a.request_id = e.request_id AND a.attempt = e.stop
 WHERE a.outcome = 'ok'""",
)
def first_usable_response(spark, sf):
    return attempts.first_usable_response(view(spark, sf, "mirrors"))[0]


@query(
    "unusable_responses",
    f"""WITH {_MIRROR_STEPS} SELECT a.request_id, 'HTTP ' || CAST(a.status_code AS VARCHAR) || ' from ' || a.host AS error
 FROM a JOIN e ON a.request_id = e.request_id AND a.attempt = e.stop WHERE a.outcome = 'hard'
 UNION ALL SELECT a.request_id, 'every source was unavailable (' || string_agg(host || CASE WHEN status_code = 200
 THEN ': non-JSON response' ELSE ': HTTP ' || CAST(status_code AS VARCHAR) END, '; ' ORDER BY attempt) || ')'
 FROM a JOIN e ON a.request_id = e.request_id WHERE e.stop IS NULL GROUP BY a.request_id""",
)
def unusable_responses(spark, sf):
    return attempts.first_usable_response(view(spark, sf, "mirrors"))[1]


@query(
    "best_attempt",
    f"""WITH a AS (SELECT *, {_REASON} AS reason FROM ({portable('attempts')}) t WHERE NOT failed),
 c AS (SELECT page_id, min(attempt) AS at FROM a WHERE reason IS NULL GROUP BY page_id),
 s AS (SELECT page_id, max(attempt) AS at FROM a WHERE reason IS NOT NULL GROUP BY page_id)
 SELECT a.page_id, a.url, CAST(a.attempt AS BIGINT) AS attempt, CASE WHEN c.at IS NULL THEN 'impersonate:exhausted' ELSE a.via END AS via,
 CAST(a.status_code AS BIGINT) AS status_code, a.reason AS block_reason FROM a LEFT JOIN c ON a.page_id = c.page_id
 LEFT JOIN s ON a.page_id = s.page_id WHERE a.attempt = coalesce(c.at, s.at)""",
)
def best_attempt(spark, sf):
    good, _ = attempts.best_attempt(view(spark, sf, "attempts"))
    return good.drop("html").withColumns(
        {"attempt": F.col("attempt").cast("bigint"), "status_code": F.col("status_code").cast("bigint")}
    )
