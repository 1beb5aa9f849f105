import json
import random

import pytest
from pyspark.sql import functions as F

from leafmill.operators import attempts, catalog, places, site
from leafmill.sources.captures import latest_captures

NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'


def _documents(spark, rows):
    return spark.createDataFrame(rows, "url string, body string")


def _sites(spark, *urls):
    return spark.createDataFrame([(u,) for u in urls], "site string")


def _locs(*urls):
    return "".join(f"<url><loc> {u} </loc></url>" for u in urls)


def test_sitemaps_indexes_and_robots(spark):
    docs = _documents(
        spark,
        [
            ("https://a.example/sitemap.xml", f"<sitemapindex {NS}><sitemap><loc>https://a.example/1.xml</loc></sitemap>"
             "<sitemap><loc>https://a.example/bad.xml</loc></sitemap><sitemap><loc>https://a.example/2.xml</loc></sitemap></sitemapindex>"),
            ("https://a.example/1.xml", f'<?xml version="1.0"?><!-- c --><urlset {NS}>{_locs("https://a.example/x?a=1&amp;b=2", "https://a.example/x")}</urlset>'),
            ("https://a.example/bad.xml", f"<urlset {NS}><url><loc>https://a.example/cut"),
            ("https://a.example/2.xml", '<s:urlset xmlns:s="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:image="http://i"><s:url>'
             "<s:loc>https://a.example/x</s:loc><image:loc>https://a.example/pic</image:loc></s:url></s:urlset>"),
            ("https://b.example/robots.txt", "User-agent: *\nDisallow: /\nsiteMAP: https://b.example/own.xml\r\nSitemap: https://b.example/missing.xml"),
            ("https://b.example/own.xml", f"<urlset {NS}>{_locs('https://b.example/1')}</urlset>"),
            ("https://c.example/sitemap.xml", "<urlset><url><loc>https://c.example/none</loc></url></urlset>"),
        ],
    )
    found = site.sitemap_pages(_sites(spark, "https://a.example/", "https://b.example/deep/page", "https://c.example/"), docs)
    rows = [(r.site, r.url) for r in found.orderBy("site", "rank").collect()]
    assert rows == [
        ("https://a.example/", "https://a.example/x?a=1&b=2"), ("https://a.example/", "https://a.example/x"),
        ("https://a.example/", "https://a.example/x"), ("https://b.example/deep/page", "https://b.example/1"),
    ]


def test_sitemap_indexes_are_followed_to_any_depth(spark):
    index = lambda *urls: f"<sitemapindex {NS}>{''.join(f'<sitemap><loc>{u}</loc></sitemap>' for u in urls)}</sitemapindex>"
    for deep in (3, 7):
        docs = [("https://d.example/sitemap.xml", index("https://d.example/1.xml"))]
        docs += [(f"https://d.example/{i}.xml", index(f"https://d.example/{i + 1}.xml")) for i in range(1, deep)]
        docs.append((f"https://d.example/{deep}.xml", f"<urlset {NS}>{_locs('https://d.example/p')}</urlset>"))
        assert site.sitemap_pages(_sites(spark, "https://d.example/"), _documents(spark, docs)).count() == 1
        assert site.sitemap_pages(_sites(spark, "https://d.example/"), _documents(spark, docs), max_depth=3).count() == (deep == 3)


def test_rings_of_sitemap_indexes_end(spark):
    ring = f"<sitemapindex {NS}><loc>https://r.example/sitemap.xml</loc><loc>https://r.example/a.xml</loc></sitemapindex>"
    docs = [("https://r.example/sitemap.xml", ring), ("https://r.example/a.xml", f"<urlset {NS}>{_locs('https://r.example/p')}</urlset>")]
    found = site.sitemap_pages(_sites(spark, "https://r.example/"), _documents(spark, docs))
    assert [(r.url, r["rank"]) for r in found.collect()] == [("https://r.example/p", 1)]


def _tree(host, size, gaps, blocked):
    """Pages 1 to ``size``, each linking to three others below it, in order, and to much that does not count."""
    pages = []
    for n in range(1, size + 1):
        below = [f'<a href="/{k}#part">x</a>' for k in (3 * n - 1, 3 * n, 3 * n + 1)]
        noise = f"<a href='/1'>home</a><a href='/{(n + 1) // 3 or 1}'>up</a><a href='https://o.example/{n}'>o</a><a href='mailto:a@b'>m</a><link href='/theme.css'>"
        if n not in gaps:
            pages.append((f"{host}/{n}", noise + "".join(below), n in blocked))
    return pages


def test_pages_of_a_tree_are_visited_level_by_level(spark):
    """In a complete tree numbered by level, the visit order is the order of the numbers still reachable."""
    gaps, blocked = {5, 9, 22}, {3, 14}
    df = spark.createDataFrame(
        _tree("https://m.example", 60, gaps, blocked) + _tree("https://n.example", 40, set(), set()) + _tree("https://other.example", 9, set(), set()),
        "url string, html string, blocked boolean",
    )
    reachable = [1]
    for n in range(2, 61):
        above = (n + 1) // 3
        if n not in gaps and above in reachable and above not in blocked:
            reachable.append(n)
    sites = _sites(spark, "https://m.example/1", "https://n.example/1", "https://gone.example/")
    for limit, host_links in ((None, site.HOST_LINKS), (7, site.HOST_LINKS), (None, 0), (7, 100)):
        got = {(r.site, r.url): r["rank"] for r in site.crawl_by_links(sites, df, limit, host_links).collect()}
        want = {}
        for host, numbers in (("https://m.example", reachable), ("https://n.example", list(range(1, 41)))):
            want |= {(f"{host}/1", f"{host}/{n}"): i for i, n in enumerate(numbers[:limit], 1)}
        assert got == want


def test_a_long_chain_is_followed_to_its_end(spark):
    chain = [(f"https://c.example/{n}", f"<a href='/{n + 1}'>next</a>", False) for n in range(1, 401)]
    df = spark.createDataFrame(chain, "url string, html string, blocked boolean")
    got = site.crawl_by_links(_sites(spark, "https://c.example/1"), df)
    assert [r.url.rsplit("/", 1)[1] for r in got.orderBy("rank").collect()] == [str(n) for n in range(1, 401)]


def test_hosts_crawled_in_a_task_and_level_by_level_give_the_same(spark):
    rng = random.Random(7)
    pages = []
    for host, n in (("https://x.example", 60), ("https://y.example", 9)):
        for k in range(n):
            hrefs = "".join(f"<a href='/{rng.randrange(n + 5)}'>l</a>" for _ in range(rng.randint(0, 4)))
            pages.append((f"{host}/{k}", hrefs, rng.random() < 0.1))
    df = spark.createDataFrame(pages, "url string, html string, blocked boolean")
    sites = _sites(spark, "https://x.example/0", "https://x.example/3", "https://y.example/1", "https://z.example/")
    visits = [sorted(tuple(r) for r in site.crawl_by_links(sites, df, limit, most).collect()) for limit in (None, 20) for most in (10_000, 60, 0)]
    assert visits[0] == visits[1] == visits[2] and visits[3] == visits[4] == visits[5] and len(visits[0]) > 20


def test_the_latest_capture_counts_once(spark):
    rows = [("u", 1, "old"), ("u", 2, "new"), ("u", 2, "new"), ("v", None, "x"), ("v", 1, "y"), ("w", 1, "a"), ("w", 1, "b")]
    df = spark.createDataFrame(rows, "url string, seen_at int, html string")
    got = {r.url: r.html for r in latest_captures(df).collect()}
    assert (got["u"], got["v"], len(got)) == ("new", "y", 3) and latest_captures(df).count() == 3


# ------------------------------------------------------------------------ catalogues


# Page number, status and item ids (None: no JSON) of a store, then the ids read or the error's words.
SERIES = {
    "one short page": ([(1, 200, [1, 2])], [1, 2]),
    "full, then short": ([(1, 200, [1, 2, 3]), (2, 200, [4])], [1, 2, 3, 4]),
    "full, then empty": ([(1, 200, [1, 2, 3]), (2, 200, [])], [1, 2, 3]),
    "full, then uncaptured": ([(1, 200, [1, 2, 3]), (3, 200, [9])], [1, 2, 3]),
    "nothing after a short page counts": ([(1, 200, [1]), (2, 404, []), (3, 200, [9])], [1]),
    "first page missing": ([(2, 200, [1, 2])], []),
    "no catalogue": ([(1, 404, [])], "has no"),
    "refused later": ([(1, 200, [1, 2, 3]), (2, 503, [])], "answered with status 503"),
    "not JSON": ([(1, 200, [1, 2, 3]), (2, 200, None)], "is not JSON"),
    "captured twice": ([(1, 200, [1, 2, 3]), (1, 200, [1, 2, 3]), (2, 200, [4])], [1, 2, 3, 4]),
    "long": ([(n, 200, [3 * n, 3 * n + 1, 3 * n + 2]) for n in range(1, 131)], list(range(3, 393))),
}


@pytest.mark.parametrize("limit", [None, 4])
def test_page_series(spark, limit):
    rows = []
    for name, (pages, _) in SERIES.items():
        for number, status, ids in pages:
            rows.append((name, number, status, "<html>" if ids is None else json.dumps({"products": [{"id": i} for i in ids]})))
    df = spark.createDataFrame(rows, "store_url string, page int, status_code int, body string")
    items, errors = catalog.store_products(df, page_size=3, max_products=limit)
    got: dict = {}
    for r in items.select("store_url", "pos", F.col("item.id").alias("id")).orderBy("pos").collect():
        got.setdefault(r.store_url, []).append((r.pos, r.id))
    failed = {r.store_url: r.error for r in errors.collect()}
    for name, (_, want) in SERIES.items():
        if isinstance(want, str):
            assert want in failed[name] and name not in got
        else:
            assert name not in failed and got.get(name, []) == list(enumerate(want[:limit]))


def test_variant_rows(spark):
    body = {
        "products": [
            {"id": 1, "title": "A", "handle": "a", "vendor": "V", "tags": ["x", "y"], "images": [{"src": "i1"}, {"src": "i2"}],
             "variants": [{"id": 10, "title": "S", "sku": "", "price": "1,299.00", "compare_at_price": None, "available": True, "option1": "S", "option3": "Red"}]},
            {"id": 2, "title": "B", "tags": "p, q", "images": [], "variants": [{"id": 20, "price": "n/a"}]},
            {"id": 3, "title": "C", "handle": "c", "variants": []},
        ]
    }
    df = spark.createDataFrame([("shop.example/fr/", 1, 200, json.dumps(body))], "store_url string, page int, status_code int, body string")
    items, _ = catalog.store_products(df)
    a, b = catalog.variant_rows(items).orderBy("product_id").collect()
    assert (a.sku, a.price, a.compare_at_price, a.available, a.options, a.tags, a.image) == (None, 1299.0, None, True, "S / Red", "x, y", "i1")
    assert a.product_url == "https://shop.example/products/a"
    assert (b.price, b.available, b.options, b.tags, b.image, b.product_url) == (None, False, None, "p, q", None, None)


# ---------------------------------------------------------------------------- places


def test_geocoder_hits(spark):
    hits = [
        ("bath", 1, json.dumps({"name": "", "display_name": "Roman Baths, Bath", "lat": "51.38", "lon": "-2.36", "category": "tourism", "type": "museum",
                                "osm_type": "way", "osm_id": 7, "extratags": {"contact:phone": "+44 1", "website": "w"}})),
        ("bath", 2, json.dumps({"name": "N", "lat": "x", "type": "city"})),
        ("odd", 1, json.dumps({"display_name": "Odd", "lat": "nope", "lon": "1"})),
    ]
    df = spark.createDataFrame(hits, "query string, rank int, body string")
    one, two = places.search_places(df.filter("query = 'bath'")).orderBy("rank").collect()
    assert (one.name, one.category, one.lat, one.phone, one.website, one.osm_id) == ("Roman Baths", "tourism/museum", 51.38, "+44 1", "w", 7)
    assert (two.name, two.category, two.lat, two.phone) == ("N", "city", None, None)
    asked = spark.createDataFrame([("bath",), ("odd",), ("none",)], "query string")
    centres, errors = places.geocode(asked, df)
    assert [(r.query, r.lat, r.label) for r in centres.collect()] == [("bath", 51.38, "Roman Baths, Bath")]
    assert {r.query: r.error.split(" ")[1] for r in errors.collect()} == {"odd": "coordinates", "none": "place"}


def test_categories(spark):
    asked = spark.createDataFrame([(c,) for c in ("Cafe", " estate AGENT ", "shop=Wine", "=x", "k=", "", "zoo", "a=b=c")], "category string")
    good, bad = places.category_tags(asked)
    assert {r.category: (r.tag_key, r.tag_value) for r in good.collect()} == {
        "Cafe": ("amenity", "cafe"), " estate AGENT ": ("office", "estate_agent"), "shop=Wine": ("shop", "wine"), "a=b=c": ("a", "b=c"),
    }
    assert {r.category for r in bad.collect()} == {"=x", "k=", "", "zoo"}


@pytest.mark.parametrize(("radius", "limit"), [(3_000, 5), (400_000, 200), (50, 200)])
def test_nearby_equals_brute_force(spark, radius, limit):
    import math

    rng = random.Random(radius)
    spots = [(51.4, -2.3), (0.0, 179.99), (-0.01, -179.99), (89.95, 10.0), (89.97, -170.0), (60.0, 0.0)]
    centres = [(f"q{i}", lat, lon, "amenity", "cafe") for i, (lat, lon) in enumerate(spots)]
    rows = []
    for n in range(900):
        lat, lon = rng.choice(spots)
        spreadby = rng.choice([0.0005, 0.02, 1.0])
        lat = max(-90.0, min(90.0, lat + rng.uniform(-spreadby, spreadby)))
        lon = (lon + rng.uniform(-spreadby, spreadby) + 180) % 360 - 180
        rows.append((rng.choice(["node", "way"]), n, rng.choice(["n", "n", None]), lat, lon, {"amenity": rng.choice(["cafe", "cafe", "pub"])}))
    df = spark.createDataFrame(rows, "osm_type string, osm_id bigint, name string, lat double, lon double, tags map<string,string>")
    asked = spark.createDataFrame(centres, "query string, lat double, lon double, tag_key string, tag_value string")
    got = {(r.query, r.osm_id) for r in places.nearby_places(asked, df, radius, limit).collect()}

    def metres(a, b, c, d):
        p, q = math.radians(a), math.radians(c)
        x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * places.EARTH_M * math.asin(min(1.0, math.sqrt(x)))

    want = set()
    for name, lat, lon, _, _ in centres:
        near = sorted((r for r in rows if r[5]["amenity"] == "cafe" and metres(lat, lon, r[3], r[4]) <= radius), key=lambda r: (r[0], r[1]))
        want |= {(name, r[1]) for r in near[:limit] if r[2]}
    assert got == want


# -------------------------------------------------------------------------- attempts


def test_first_usable_response(spark):
    rows = [
        (1, 1, "m1", 504, ""), (1, 2, "m2", 200, "<busy>"), (1, 3, "m3", 200, '{"elements":[]}'),
        (2, 1, "m1", 429, ""), (2, 2, "m2", 400, ""), (2, 3, "m3", 200, "{}"), (3, 1, "m1", 502, ""), (3, 2, "m2", 200, "no"), (3, 3, "m3", 503, ""),
        (4, 1, "m1", 200, "{}"), (4, 2, "m2", 200, '{"a":1}'),
    ]
    df = spark.createDataFrame(rows, "request_id int, attempt int, host string, status_code int, body string")
    good, bad = attempts.first_usable_response(df)
    assert {r.request_id: (r.host, r.body) for r in good.collect()} == {1: ("m3", '{"elements":[]}'), 4: ("m1", "{}")}
    assert {r.request_id: r.error for r in bad.collect()} == {
        2: "HTTP 400 from m2", 3: "every source was unavailable (m1: HTTP 502; m2: non-JSON response; m3: HTTP 503)",
    }


def test_best_attempt(spark):
    def rows(url, *steps):
        return [(url, i + 1, via, status, failed, "<p>x</p>") for i, (via, status, failed) in enumerate(steps)]

    data = (
        rows("first", ("plain", 200, False), ("profile1", 200, False)) + rows("second", ("plain", 403, False), ("profile1", 0, True), ("profile2", 200, False))
        + rows("spent", ("plain", 403, False), ("profile1", 429, False), ("profile2", 0, True), ("stealth", 403, False))
        + rows("only_plain", ("plain", 503, False), ("profile1", 0, True)) + rows("dead", ("plain", 0, True), ("profile1", 0, True))
        + rows("stealth", ("plain", 403, False), ("stealth", 200, False))
    )
    df = spark.createDataFrame(data, "url string, attempt int, via string, status_code int, failed boolean, html string")
    good, bad = attempts.best_attempt(df)
    assert {r.url: (r.via, r.status_code) for r in good.collect()} == {
        "first": ("plain", 200), "second": ("profile2", 200), "spent": ("impersonate:exhausted", 429),
        "only_plain": ("impersonate:exhausted", 503), "stealth": ("stealth", 200),
    }
    assert [r.url for r in bad.collect()] == ["dead"]
    browser = (
        rows("kept", ("playwright", 403, False), ("plain", 403, False), ("profile1", 403, False)) + rows("fell", ("playwright", 403, False), ("plain", 200, False))
        + rows("crashed", ("playwright", 0, True), ("plain", 403, False)) + rows("alone", ("playwright", 403, False))
        + rows("lost", ("playwright", 403, False), ("plain", 0, True))
    )
    good, bad = attempts.best_attempt(spark.createDataFrame(browser, df.schema), browser_first=True)
    assert {r.url: r.via for r in good.collect()} == {
        "kept": "playwright", "fell": "plain", "crashed": "impersonate:exhausted", "alone": "playwright",
    }
    assert [r.url for r in bad.collect()] == ["lost"]
