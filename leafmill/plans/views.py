"""Test views over the driver's tables: captures with known content planted in them.

Each view is one SQL text that reads the tables named ``@table``. Views whose rows are
built from many source rows do so in blocks of bounded size, so a view grows in rows
with the data and never in the size of a row.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def run(spark: SparkSession, sf_dir: str, sql: str, dealt: str | None = None) -> DataFrame:
    """A SQL text with ``@table`` names, over the Parquet files of ``sf_dir``.

    The rows of the table named by ``dealt`` are dealt over all tasks first: where each slim row becomes a page, a file of a few
    megabytes, whose splits may all but one be empty, is work for the whole cluster.
    """

    def source(m: re.Match) -> str:
        if m[1] not in TABLES:
            return m[0]
        files = f"parquet.`{sf_dir.rstrip('/')}/{m[1]}.parquet`"
        if m[1] != dealt:
            return files
        parts = max(spark.sparkContext.defaultParallelism, table(spark, sf_dir, dealt).rdd.getNumPartitions())
        return f"(SELECT /*+ REPARTITION({parts}) */ * FROM {files})"

    return spark.sql(re.sub(r"@(\w+)", source, sql))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source = PAGE_VIEWS.get(name)
    if name in ROW_VIEWS:
        return run(spark, sf_dir, VIEWS[name], dealt=source)
    df = run(spark, sf_dir, VIEWS[name])
    return df if source is None else spread(df, table(spark, sf_dir, source))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "pages")
    return spread(df, df)


def spread(df: DataFrame, source: DataFrame) -> DataFrame:
    """Give page work one partition per core when its source file has fewer splits.

    Parsing is bound by CPU, and a small file is read by a single task. A source that
    already fills the cluster is left as it is, so nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if source.rdd.getNumPartitions() < cores else df


def portable(name: str) -> str:
    """The text of a view with bare table names, for an engine that has them as views."""
    text = re.sub(r"@(\w+)", lambda m: m[1] if m[1] in TABLES else m[0], VIEWS[name])
    return text.replace("explode(array(", "unnest(list_value(")


# Captures with refusals, challenges, shells, real content under a refusal and headers.
_CAPTURES = """
SELECT page_id, url,
 CASE page_id % 11 WHEN 0 THEN '<script src="/cdn-cgi/challenge-platform/x"></script>' ELSE '' END
 || CASE page_id % 17 WHEN 0 THEN '<script id="__NEXT_DATA__">{}</script>' ELSE '' END
 || CASE page_id % 13 WHEN 0 THEN repeat('<a href="/more">more text here</a> ', 400) ELSE '' END
 || CASE page_id % 23 WHEN 4 THEN '<html><head><title>App</title></head><body>' || repeat('<div></div>', 80)
    || '</body></html>' ELSE html END AS html,
 CASE page_id % 7 WHEN 0 THEN 403 WHEN 1 THEN 429 WHEN 2 THEN 503 WHEN 3 THEN 202 ELSE 200 END AS status_code,
 CASE page_id % 19 WHEN 0 THEN 'image/png' WHEN 1 THEN 'application/pdf' WHEN 2 THEN ''
  ELSE 'text/html; charset=utf-8' END AS content_type,
 CASE page_id % 5 WHEN 0 THEN 'X-Wix-Request-Id' WHEN 1 THEN 'x-shopify-stage' ELSE 'server' END AS header_name,
 'nginx' AS header_value
FROM @pages
"""

# Product pages: JSON-LD in a graph, OpenGraph, microdata, malformed JSON-LD.
_PRODUCTS = """
SELECT p_partkey,
 'https://shop' || CAST(p_partkey % 5 AS STRING) || '.example/p/' || CAST(p_partkey AS STRING) AS url,
 CASE p_partkey % 4
 WHEN 0 THEN '<html><head><script type="application/ld+json">{"@graph":[{"@type":"WebSite"},{"@type":"Product","name":"'
  || p_name || '","brand":{"name":"' || p_brand || '"},"sku":"S-' || CAST(p_partkey AS STRING) || '","image":"img/'
  || CAST(p_partkey AS STRING) || '.jpg","offers":[{"price":"$' || price
  || '","priceCurrency":"USD","availability":"https://schema.org/InStock"}],"aggregateRating":{"ratingValue":"4.5","reviewCount":"'
  || CAST(p_size AS STRING) || '"}}]}</script></head><body>x</body></html>'
 WHEN 1 THEN '<html><head><meta property="og:title" content="' || p_name
  || '"/><meta property="product:price:amount" content="' || price
  || '"/><meta property="product:price:currency" content="EUR"/></head><body>x</body></html>'
 WHEN 2 THEN '<div itemscope itemtype="http://schema.org/Product"><span itemprop="name">' || p_name
  || '</span><a itemprop="brand" href="/b">' || p_brand || '</a><span itemprop="price">' || price
  || '</span><img itemprop="image" src="/m/' || CAST(p_partkey AS STRING) || '.png"/></div>'
 ELSE '<html><body><p>' || p_name || '</p><script type="application/ld+json">{bad,,}</script></body></html>' END AS html
FROM (SELECT *, CAST(CAST(floor(round(p_retailprice * 100) / 100) AS BIGINT) AS STRING) || '.'
  || lpad(CAST(CAST(round(p_retailprice * 100) AS BIGINT) % 100 AS STRING), 2, '0') AS price FROM @part)
"""

# Contact pages: a phone, an e-mail, one social link that counts and one that does not.
_CONTACTS = """
SELECT doc_id,
 'https://' || source || '.example/' || CASE doc_id % 3 WHEN 0 THEN 'contact' WHEN 1 THEN 'about' ELSE 'page' END || '/'
  || CAST(doc_id AS STRING) AS url,
 '<html><body><p>Call +44 7700 ' || lpad(CAST(doc_id % 1000000 AS STRING), 6, '0') || ' or mail u'
  || CAST(doc_id % 97 AS STRING) || '@' || source || '.example.com today</p><p>&copy; 2024 Order 1234 5678</p>'
  || '<a href="https://www.github.com/u' || CAST(doc_id AS STRING)
  || '">GH</a><a href="https://m.facebook.com/x">F</a><a href="mailto:a@b.com">M</a></body></html>' AS html
FROM @documents
"""

# Five hosts, each a binary tree of pages; pages past the end are not captured.
_SITE_PAGES = """
SELECT 'https://s' || CAST(p_partkey % 5 AS STRING) || '.example/p/' || CAST(i AS STRING) AS url,
 '<link href="/style.css"><a href="/p/' || CAST(i * 2 AS STRING) || '#a">l</a><a href="/p/' || CAST(i * 2 + 1 AS STRING)
  || '">r</a><a href="https://other.example/z">o</a><a href="/p/1">home</a>' AS html
FROM (SELECT p_partkey, CAST(floor(p_partkey / 5) AS BIGINT) AS i FROM @part)
"""

# Hosts 0 and 1: index of indexes of sitemaps; host 2: robots file only; 3 and 4: nothing.
_SITEMAPS = """
WITH p AS (SELECT p_partkey % 5 AS k, p_partkey, CAST(floor(p_partkey / 5) AS BIGINT) AS i FROM @part WHERE p_partkey % 5 < 3),
b AS (SELECT k, CAST(floor(i / 500) AS BIGINT) AS block, i, p_partkey FROM p)
SELECT 'https://s' || CAST(k AS STRING) || '.example/sitemap.xml' AS url,
 '<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' || listagg('<sitemap><loc>https://s'
  || CAST(k AS STRING) || '.example/ix' || CAST(part AS STRING) || '.xml</loc></sitemap>', '') WITHIN GROUP (ORDER BY part)
  || '</sitemapindex>' AS body
FROM (SELECT DISTINCT k, CAST(floor(block / 500) AS BIGINT) AS part FROM b WHERE k < 2) GROUP BY k
UNION ALL
SELECT 'https://s' || CAST(k AS STRING) || '.example/ix' || CAST(part AS STRING) || '.xml',
 '<?xml version="1.0"?><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' || listagg('<sitemap><loc> https://s'
  || CAST(k AS STRING) || '.example/sm' || CAST(block AS STRING) || '.xml </loc></sitemap>', '') WITHIN GROUP (ORDER BY block)
  || '</sitemapindex>'
FROM (SELECT DISTINCT k, block, CAST(floor(block / 500) AS BIGINT) AS part FROM b WHERE k < 2) GROUP BY k, part
UNION ALL
SELECT 'https://s2.example/robots.txt', 'User-agent: *' || chr(10) || listagg('SITEMAP: https://s2.example/sm'
  || CAST(block AS STRING) || '.xml', chr(10)) WITHIN GROUP (ORDER BY block)
FROM (SELECT DISTINCT block FROM b WHERE k = 2)
UNION ALL
SELECT 'https://s' || CAST(k AS STRING) || '.example/sm' || CAST(block AS STRING) || '.xml',
 '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' || listagg('<url><loc>https://s' || CAST(k AS STRING)
  || '.example/p/' || CAST(i AS STRING) || '</loc></url>', '') WITHIN GROUP (ORDER BY p_partkey) || '</urlset>'
FROM b GROUP BY k, block
"""

_SNAPSHOTS = """
SELECT 'https://t.example/' || CAST(conv_id AS STRING) AS url, turn,
 CASE turn % 3 WHEN 1 THEN lag(text) OVER (PARTITION BY conv_id ORDER BY turn) ELSE text END AS content
FROM @conversations
"""

_FETCH_LOG = """
SELECT event_id, ts, 'd' || CAST(user_id AS STRING) || '.example' AS domain,
 CASE event_type WHEN 'error' THEN 1 ELSE 0 END AS blocked FROM @events
"""

_REQUEST_LOG = """
SELECT event_id, ts, 'https://u.example/' || CAST(user_id AS STRING) AS url, event_type = 'view' AS js_render,
 event_type = 'error' AS bypass FROM @events
"""

_NETWORK_LOG = """
SELECT event_id, 'https://app.example/' || CAST(user_id AS STRING) AS page_url,
 'https://api.example/' || event_type || '/' || CAST(event_id AS STRING) AS url, 'GET' AS method, 200 AS status,
 CASE event_type WHEN 'click' THEN 'text/css' WHEN 'view' THEN 'image/png' ELSE 'application/json' END AS content_type,
 repeat(props, CAST(1 + event_id % 40 AS INT)) AS body FROM @events
"""

# Listings of at most 1000 parts a page; every third card lacks its .s element.
_LISTINGS = """
SELECT 'https://list.example/' || p_brand || '/' || CAST(CAST(floor(p_partkey / 1000) AS BIGINT) AS STRING) AS url,
 '<html><body><div class="grid">' || listagg('<div class="card c' || CAST(p_size AS STRING) || '"><h2 class="t">' || p_name
  || '</h2><a class="l" href="/p/' || CAST(p_partkey AS STRING) || '">go</a>'
  || CASE p_partkey % 3 WHEN 0 THEN '' ELSE '<span class="s">' || p_type || '</span>' END || '</div>', '')
  WITHIN GROUP (ORDER BY p_partkey) || '</div></body></html>' AS html
FROM @part GROUP BY p_brand, CAST(floor(p_partkey / 1000) AS BIGINT)
"""

_SEARCH_PAGES = """
SELECT p_brand || ' ' || CAST(CAST(floor(p_partkey / 1000) AS BIGINT) AS STRING) AS query,
 '<html><body>' || listagg('<a class="result-link" href="' || CASE p_partkey % 2
  WHEN 0 THEN '//duckduckgo.com/l/?uddg=https%3A%2F%2Fr.example%2F' || CAST(p_size AS STRING) || '&rut=x'
  ELSE 'https://d.example/' || CAST(p_size AS STRING) END || '">' || p_name || '</a><div class="result-snippet">about '
  || p_type || '</div>', '') WITHIN GROUP (ORDER BY p_partkey) || '</body></html>' AS html
FROM @part GROUP BY p_brand, CAST(floor(p_partkey / 1000) AS BIGINT)
"""

# Catalogue pages of ten products; store 3 answers html and store 4 answers 404.
_CATALOG = """
SELECT 'https://store' || CAST(store AS STRING) || '.example' AS store_url, page,
 CASE WHEN store = 4 THEN 404 ELSE 200 END AS status_code,
 CASE WHEN store = 3 THEN '<html>no</html>' ELSE '{"products":[' || listagg(obj, ',') WITHIN GROUP (ORDER BY p_partkey)
  || ']}' END AS body
FROM (SELECT p_partkey, p_partkey % 5 AS store, CAST(1 + floor(p_partkey / 50) AS BIGINT) AS page,
 '{"id":' || CAST(p_partkey AS STRING) || ',"title":"' || p_name || '","handle":"h' || CAST(p_partkey AS STRING)
  || '","vendor":"' || p_brand || '","product_type":"' || p_type
  || '","tags":["a","b"],"images":[{"src":"https://cdn.example/' || CAST(p_partkey AS STRING) || '.jpg"}],"variants":'
  || CASE p_partkey % 7 WHEN 0 THEN '[]' ELSE '[{"id":1,"title":"V1","sku":"","price":"1,'
  || lpad(CAST(p_size AS STRING), 3, '0') || '.50","available":true,"option1":"L"},{"id":2,"title":"V2","sku":"K2","price":"'
  || CAST(p_size AS STRING) || '.00","available":false,"option1":"L","option2":"Red"}]' END || '}' AS obj FROM @part) t
GROUP BY store, page
"""

_COLLECTIONS = """
SELECT 'https://store' || CAST(s_suppkey AS STRING) || '.example' AS store_url, CAST(1 AS BIGINT) AS page,
 200 AS status_code, '{"collections":[{"id":1,"title":"' || s_name || '","handle":"c' || CAST(s_suppkey AS STRING)
  || '","products_count":' || CAST(s_nationkey * 3 AS STRING)
  || '},{"id":2,"title":"All","handle":"all","products_count":9}]}' AS body FROM @supplier
"""

_RAGGED = """
SELECT p_partkey AS ord, CASE p_partkey % 3 WHEN 0 THEN '{"id":' || CAST(p_partkey AS STRING) || ',"name":"' || p_name || '"}'
 WHEN 1 THEN '{"id":' || CAST(p_partkey AS STRING) || ',"flag":true,"tags":["a","' || p_brand || '"]}'
 ELSE '{"size":' || CAST(p_size AS STRING) || ',"name":null,"ratio":0.5}' END AS obj FROM @part
"""

_PLACES = """
SELECT c_custkey, '{"type":"' || CASE c_custkey % 2 WHEN 0 THEN 'node","lat":' || lat || ',"lon":' || lon
  ELSE 'way","center":{"lat":' || lat || ',"lon":' || lon || '}' END || ',"id":' || CAST(c_custkey AS STRING) || ',"tags":{'
  || CASE c_custkey % 10 WHEN 9 THEN '' ELSE '"name":"' || c_name || '",' END || '"amenity":"' || CASE c_nationkey % 3
  WHEN 0 THEN 'dentist' WHEN 1 THEN 'cafe' ELSE 'pub' END || '","contact:phone":"+44 1","addr:city":"Bath"}}' AS body
FROM (SELECT *, '51.' || lpad(CAST(c_custkey % 997 AS STRING), 4, '0') AS lat,
 '-2.' || lpad(CAST(c_custkey % 991 AS STRING), 4, '0') AS lon FROM @customer) t
"""

_GEOCODE = """
SELECT s_name AS query, r AS rank, '{"display_name":"' || s_name || ', Street ' || CAST(r AS STRING) || ', Bath","lat":"51.'
  || lpad(CAST(s_suppkey * 13 % 997 AS STRING), 4, '0') || '","lon":"-2.' || lpad(CAST(s_suppkey * 17 % 991 AS STRING), 4, '0')
  || '","category":"tourism","type":"museum","osm_type":"way","osm_id":' || CAST(s_suppkey AS STRING)
  || ',"extratags":{"contact:phone":"+44 2"}}' AS body
FROM (SELECT *, explode(array(1, 2)) AS r FROM @supplier) t WHERE s_suppkey % 6 <> 5
"""

_ATTEMPTS = """
SELECT page_id, url, a AS attempt, CASE a WHEN 1 THEN 'plain' WHEN 2 THEN 'profile1' ELSE 'profile2' END AS via,
 CASE WHEN page_id % 10 = 0 THEN 403 WHEN (page_id + a) % 3 = 0 THEN 200 WHEN (page_id + a) % 3 = 1 THEN 403 ELSE 503 END
  AS status_code, page_id % 8 = a AS failed, html
FROM (SELECT *, explode(array(1, 2, 3)) AS a FROM @pages) t
"""

_MIRRORS = """
SELECT page_id AS request_id, a AS attempt, 'm' || CAST(a AS STRING) || '.example' AS host,
 CASE WHEN page_id % 5 = 0 THEN 504 WHEN (page_id * a) % 4 = 1 THEN 429 WHEN (page_id * a) % 9 = 2 THEN 400 ELSE 200 END
  AS status_code, CASE WHEN (page_id + a) % 4 = 0 THEN '<busy>' ELSE '{"elements":[]}' END AS body
FROM (SELECT *, explode(array(1, 2, 3)) AS a FROM @pages) t
"""

# Views whose rows are parsed as pages, with the table they come from.
PAGE_VIEWS = {
    "captures": "pages",
    "product_pages": "part",
    "contact_pages": "documents",
    "site_pages": "part",
    "listing_pages": "part",
    "search_pages": "part",
    "catalog": "part",
    "places": "customer",
    "attempts": "pages",
}

# Those that make a page of each row of a slim table.
ROW_VIEWS = ("product_pages", "site_pages", "places")

VIEWS = {
    "captures": _CAPTURES,
    "product_pages": _PRODUCTS,
    "contact_pages": _CONTACTS,
    "site_pages": _SITE_PAGES,
    "sitemaps": _SITEMAPS,
    "snapshots": _SNAPSHOTS,
    "fetch_log": _FETCH_LOG,
    "request_log": _REQUEST_LOG,
    "network_log": _NETWORK_LOG,
    "listing_pages": _LISTINGS,
    "search_pages": _SEARCH_PAGES,
    "catalog": _CATALOG,
    "collections": _COLLECTIONS,
    "ragged": _RAGGED,
    "places": _PLACES,
    "geocode": _GEOCODE,
    "attempts": _ATTEMPTS,
    "mirrors": _MIRRORS,
}
