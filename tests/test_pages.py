import random
import time

import pytest
from pyspark.sql import functions as F

from leafmill.functions.markdown import article_markdown
from leafmill.functions.markup import Events, page_events, text_of, walk
from leafmill.functions.selectors import BadSelector, UnsupportedSelector, picked
from leafmill.functions.sqltext import each
from leafmill.operators import documents, extract, products, selectors, signals

URL = "https://shop.example/p/1"
# What a reader of the story sees, and what stands around it.
STORY = [f"Verse {k} tells of a ferry on the lake and of the {w} it carried." for k, w in enumerate(("salt", "wool", "timber", "letters", "bells"))]
AROUND = {"menu": "Tours Prices Map", "promo-popup": "Win a boat trip", "crumbs breadcrumb": "Start / Lake", "rights": "All rights kept by the ferry office"}
CHALLENGE = '<script src="/cdn-cgi/challenge-platform/x"></script>'
REAL = "<p>" + "words of a real page " * 200 + "</p>" + '<a href="/l">link</a>' * 12 + "<i></i>" * 1000


def test_blocks_are_decided_by_signal_and_content(make_pages):
    df = make_pages(
        ("refused", "<p>no</p>", 403), ("challenge200", CHALLENGE, 200), ("both", CHALLENGE, 503),
        ("real403", REAL, 403), ("real_marked", CHALLENGE + REAL, 200), ("fine", "<p>Just a moment of prose</p>", 200),
        ("202", "please verify that you're not a robot", 202), ("404", "<p>gone</p>", 404),
    )
    got = {r.url: r.block_reason for r in signals.with_block(df).collect()}
    assert got == {
        "refused": "http_403", "challenge200": "challenge", "both": "challenge", "real403": None, "real_marked": None,
        "fine": None, "202": "challenge", "404": None,
    }


def test_platform_order_and_header_names(make_pages):
    df = make_pages(("a", "<link href='//CDN.shopify.com/x'> wp-content"), ("b", "x"), ("c", "plain"))
    df = df.withColumn("headers", F.when(F.col("url") == "b", F.create_map(F.lit("X-Wix-Request-Id"), F.lit("1"))))
    got = {r.url: r.p for r in df.select("url", signals.platform("html", "headers").alias("p")).collect()}
    assert got == {"a": "shopify", "b": "wix", "c": "unknown"}


def test_rendering_need(make_pages):
    shell = "<html><head><title>App</title></head><body>" + "<div></div>" * 80 + "</body></html>"
    df = make_pages(("marker", "<div data-reactroot>" + REAL), ("shell", shell), ("tiny", "<p>hi</p>"), ("full", REAL))
    got = {r.url: r.js for r in df.select("url", signals.requires_js().alias("js")).collect()}
    assert got == {"marker": True, "shell": True, "tiny": False, "full": False}


def test_content_routes(make_pages):
    kinds = {"": "html", "TEXT/HTML": "html", "text/plain": "html", "application/json": "text", "application/PDF": "pdf", "image/png": "binary"}
    df = make_pages(*[(k, "<p>x</p>") for k in kinds]).withColumn("content_type", F.col("url"))
    assert {r.url: r.r for r in df.select("url", signals.content_route().alias("r")).collect()} == kinds


def test_split_and_document(make_pages):
    df = make_pages(("https://a.example/", f"<title>T</title><nav><a href='/m'>{AROUND['menu']}</a></nav><main><h1>Ferry</h1><p>{'</p><p>'.join(STORY)}</p></main>"), ("https://b.example/", CHALLENGE, 403), ("https://c.example/", "x"))
    df = df.withColumn("error_type", F.when(F.col("url").contains("c."), "ReadTimeout")).withColumn("error_message", F.lit(" "))
    pages, errors = documents.split_pages(df)
    assert [r.url for r in pages.collect()] == ["https://a.example/"]
    assert {r.url: r.error for r in errors.collect()} == {
        "https://b.example/": "blocked: challenge", "https://c.example/": "ReadTimeout",
    }
    written = documents.page_document(signals.with_markdown(signals.page_signals(df))).collect()
    texts = {r.url: r.document for r in written}
    assert texts["https://a.example/"].startswith("---\nurl: https://a.example/\nstatus_code: 200\ntitle: T\nlinks_count: 1\nblocked: false\n")
    assert "a refusal (challenge)" in texts["https://b.example/"]


def test_url_schemes(make_pages):
    web, errors = signals.split_by_scheme(make_pages(("https://a/", ""), ("ftp://b/", ""), ("nope", "")))
    assert web.count() == 1 and errors.count() == 2


# ------------------------------------------------------------------------- markdown


def _markdown(make_pages, html, mode="off"):
    return signals.with_markdown(make_pages((URL, html)), mode).first().markdown


def test_markdown_forms(make_pages):
    page = (
        "<head><title>no</title></head><h2>Head</h2><p>a <b>bold</b> <em>it</em> <a href='/x'>link</a> 2*3</p><ul><li>one<li>two"
        "<ol><li>n1</li><li>n2</li></ol></ul><table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table>"
        "<pre>x  y\nz</pre><script>no</script><noscript>no</noscript><img src='i.png' alt='pic'>"
    )
    assert _markdown(make_pages, page) == (
        "## Head\n\na **bold** *it* [link](/x) 2\\*3\n\n* one\n* two\n  1. n1\n  2. n2\n\n| A | B |\n| --- | --- |\n| 1 | 2 |\n\n"
        "```\nx  y\nz\n```\n\n![pic](i.png)"
    )
    assert _markdown(make_pages, "") == ""


@pytest.mark.parametrize("home", ["<main>{}</main>", "<div role='article'>{}</div>", "<table><tr><td itemprop='articleBody'>{}</td></tr></table>", "<section>{}</section>"])
def test_main_content_is_the_story_without_what_stands_around(make_pages, home):
    """The same story in four layouts; the last has no element of its own for it, but most of its text in paragraphs."""
    told = "".join(f"<p>{verse}</p>" for verse in STORY)
    aside = f"<aside>{AROUND['rights']}</aside>"
    page = (
        f"<body><nav class=menu>{AROUND['menu']}</nav><div id=promo-popup>{AROUND['promo-popup']}</div><div class='crumbs breadcrumb'>{AROUND['crumbs breadcrumb']}</div>"
        f"{home.format(told + aside)}<form>{AROUND['menu']}</form></body>"
    )
    assert _markdown(make_pages, page, "on") == "\n\n".join(STORY)
    whole = _markdown(make_pages, page, "off")
    assert all(text in whole for text in (*STORY, *AROUND.values()))


def test_pages_without_a_story_are_written_whole(make_pages):
    menu = "".join(f"<tr><td><a href='/lake/{k}'>Landing {k}</a></td></tr>" for k in range(25))
    assert all(f"[Landing {k}](/lake/{k})" in _markdown(make_pages, f"<table>{menu}</table>", "on") for k in range(25))
    short = make_pages((URL, f"<main><p>{STORY[0]}</p></main>")).select(page_events(F.col("html")).alias("e"))
    assert short.select(F.expr(article_markdown("e")).alias("m")).first().m is None


# ----------------------------------------------------------------------- extraction


def test_emails_first_occurrence_and_context(make_pages):
    page = "<p>Write to bob@x.example or</p><p>Al.B+c&#64;Y.org.</p><p>again bob@x.example</p><a href='mailto:no@z.org'>m</a>"
    rows = extract.extract_emails(make_pages((URL, page))).orderBy("pos").collect()
    assert [r.value for r in rows] == ["bob@x.example", "Al.B+c@Y.org"]
    assert rows[0].context == "Write to bob@x.example or Al.B+c@Y.org. again bob@x.example m"


def test_addresses_planted_at_known_offsets_keep_their_context(make_pages):
    """Each text is laid out from pieces, so every address and what stands up to 60 characters around it are known beforehand."""
    rng = random.Random(3)
    filler, want, pages = "läuft 😀 über-die Brücke ", set(), []
    for number in range(40):
        text, first = "", {}
        for k in range(rng.randint(0, 12)):
            text += (filler * 5)[: rng.randint(1, 90)].strip() + " "
            address = f"m{rng.randrange(6)}.x@host-{number}.museum"
            first.setdefault(address, len(text))
            text += address + rng.choice((" ", ", ", ". "))
        text += filler
        pages.append((str(number), text))
        want |= {(str(number), address, text[max(0, at - 60) : at + len(address) + 60].strip()) for address, at in first.items()}
    got = {(r.url, r.value, r.context) for r in extract.extract_emails(make_pages(*pages), text="html").collect()}
    assert got == want and len(got) > 100


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("call +44 7700 900123 now", ["+44 7700 900123"]), ("tel (020) 7946 0958 x", ["(020) 7946 0958"]),
        ("© 2024 order 1234 5678 9012", []), ("+44 7700 900123.", []), ("a+44 7700 900123", []), ("+1 23456", []),
        ("+44 7700 900123 / +44 7700 900123", ["+44 7700 900123"]),
    ],
)
def test_phones(make_pages, text, found):
    assert [r.value for r in extract.extract_phones(make_pages((URL, f"<p>{text}</p>"))).collect()] == found


def test_links(make_pages):
    page = (
        "<!-- <a href='/no'>n</a> --><a href=' /a?x=1&amp;y=2 '> A <b>b</b> </a><a href='#f'>f</a><a href=''>e</a><a name=x>n</a>"
        "<a href='mailto:a@b.c'>m</a><a href='/a?x=1&y=2'>dup</a><a href='../up'>unclosed <a href='https://o.example'>o</a>"
    )
    rows = extract.extract_links(make_pages((URL, page))).orderBy("pos").collect()
    assert [(r.value, r.context) for r in rows] == [
        ("https://shop.example/a?x=1&y=2", "Ab"), ("https://shop.example/up", "unclosed"), ("https://o.example", "o"),
    ]
    assert make_pages((URL, page)).select(signals.link_count().alias("n")).first().n == 7


def test_social_hosts_match_exactly(make_pages):
    page = "".join(
        f"<a href='{u}'>x</a>"
        for u in ("https://www.GitHub.com/u", "https://m.facebook.com/x", "//x.com/me", "https://notx.com/me", "https://twitter.com/a")
    )
    rows = extract.extract_social_links(make_pages((URL, page))).orderBy("pos").collect()
    assert [(r.platform, r.value) for r in rows] == [
        ("github", "https://www.GitHub.com/u"), ("twitter", "https://x.com/me"), ("twitter", "https://twitter.com/a"),
    ]


def test_search_results(make_pages):
    page = (
        '<a class="result-link" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.example%2Fx%3Fq%3D1&rut=1">One <b>1</b></a>'
        '<td class="result-snippet">first <b>bit</b></td><a class="result-link" href="javascript:x">bad</a>'
        '<div class="result-snippet">second</div><a class="big result-link" href="https://b.example">Two</a>'
        '<td class="result-snippet">third</td><a class="result-link" href="https://a.example/x?q=1">dup</a>'
        '<a class="result-link">no target</a><a class="result-link" href="https://c.example">Three</a>'
        '<p class="result-snippet">fourth</p><p class="result-snippet">fifth</p><p class="result-snippet">sixth</p>'
    )
    df = make_pages((URL, page))
    rows = extract.search_results(df, carry=("url",)).orderBy("rank").collect()
    assert [(r["rank"], r.title, r.snippet) for r in rows] == [(1, "One 1", "first bit"), (2, "Two", "third"), (3, "Three", "sixth")]
    assert extract.search_results(df, limit=-3, carry=()).count() == 1


def test_selectors(make_pages):
    page = (
        '<div id="g" class="grid"><div class="card a"><h2 class="t">X <i>y</i></h2><a class="l" href="/1">go</a></div>'
        '<div class="card"><h2 class="t">Z</h2><p data-k="v w">p</p></div><div class="card"></div></div><h2>out</h2>'
    )
    df = make_pages((URL, page), ("https://e.example/", "<p>nothing</p>"))
    fields = {"t": "h2.t", "l": "a@href", "k": 'p[data-k~="w"]', "c": "@class", "bad": "h2:::"}
    rows, errors = selectors.extract_by_selector(df, fields, row_selector="#g > .card")
    assert [(r.t, r.l, r.k, r.c, r.bad) for r in rows.orderBy("pos").collect()] == [
        ("X y", "https://shop.example/1", "", "card a", ""), ("Z", "", "p", "card", ""), ("", "", "", "card", ""),
    ]
    assert [r.url for r in errors.collect()] == ["https://e.example/"]
    one, _ = selectors.extract_by_selector(df, {"h": "body h2, .grid h2", "a": "div.grid .card > a[href^='/']", "n": "div > h2 > i"})
    assert [(r.h, r.a, r.n) for r in one.collect()] == [("X y", "go", "y")]
    with pytest.raises(ValueError):
        selectors.extract_by_selector(df, {})


@pytest.mark.parametrize(
    ("selector", "found"),
    [
        ("li:first-child", "one"), ("li:last-child", "four"), ("li:nth-child(2n)", "two four"), ("li:nth-child(-n+2)", "one two"),
        ("li:nth-child(odd)", "one three"), ("li:nth-child(3)", "three"), ("h3 + p", "after"), ("h3 ~ p", "after later"),
        ("li:not(.x, :last-child)", "one three"), (":is(h3, li.x) i", "two"), ("[lang|=en]", "three"), ("b:only-child", "deep"),
        ("section > :not(ul):not(p):not(h3)", "deep"), (r".md\:w-1", "one"), ("ul li ~ li:nth-child(even)", "two four"),
    ],
)
def test_selector_forms(make_pages, selector, found):
    page = (
        "<section><ul><li class='md:w-1'>one</li><li class=x><i>two</i></li><li lang=en-GB>three<li>four</ul>"
        "<h3>head</h3><p>after</p><p>later</p><div><b>deep</b></div></section>"
    )
    read = make_pages((URL, page)).select(page_events(F.col("html")).alias("e"))
    texts = each(each(picked(selector, "e"), lambda p: f"get(e, {p})"), lambda n: text_of("e", n))
    assert " ".join(read.select(F.expr(texts).alias("t")).first().t) == found


@pytest.mark.parametrize(
    ("selector", "found"),
    [
        ("section:has(b) h3", "head"), ("div:has(> b)", "deep"), ("div:has(> i)", ""), ("h3:has(+ p)", "head"), ("p:has(+ div)", "later"), ("h3:has(~ div b)", "head"),
        ("li:has(i), h3:has(i)", "two"), ("ul:not(:has(b)) > li:nth-last-child(2)", "three"), ("p:nth-last-of-type(2)", "after"), ("p:last-of-type", "later"),
        ("div:only-of-type b", "deep"), ("section > :nth-of-type(1):not(ul):not(div)", "head after"), (":root > h3", "head"), ("p:contains(aft, 'no')", "after"),
        ("li:-soup-contains-own('two')", ""), ("li:contains('two')", "two"), ("li[lang='EN-gb' i]", "three"), ("li[class!=x]:not([lang])", "one four"),
        ("p:hover", ""), ("li:is(ul > .x, :first-child)", "one two"), ("section:has(ul i) > p:not(h3 + p)", "later"),
    ],
)
def test_further_selector_forms(make_pages, selector, found):
    test_selector_forms(make_pages, selector, found)


def test_selectors_that_cannot_be_evaluated_raise(make_pages):
    for selector in ("p:lang(en)", "input:placeholder-shown", "li:nth-child(2 of .x)"):
        with pytest.raises(UnsupportedSelector):
            selectors.extract_by_selector(make_pages((URL, "x")), {"v": selector})
    for selector in ("a:bad", "li:nth-child(x)", "p:", "> p", "p >", ":not()", "p::before"):
        with pytest.raises(BadSelector):
            picked(selector, "e")
        rows, errors = selectors.extract_by_selector(make_pages((URL, "<p>x</p>")), {"v": selector, "w": "p"})
        assert [(r.v, r.w) for r in rows.collect()] == [("", "x")] and errors.isEmpty()


def test_selectors_take_time_in_proportion_to_the_page(make_pages):
    wide = "<ul><li class=a>x</li>" + "<li>y</li>" * 100_000 + "</ul>"
    deep = "<div class=b>" * 3_000 + "<p>end</p>"
    start = time.time()
    rows, _ = selectors.extract_by_selector(make_pages((URL, wide), ("https://e.example/", deep)), {"v": "li.a ~ li:last-child", "w": ".b .b .b p", "n": "ul:has(.a ~ li) li"})
    assert sorted((r.v, r.w, r.n) for r in rows.collect()) == [("", "end", ""), ("y", "", "x")]
    assert time.time() - start < 60


@pytest.mark.parametrize("page", ["<a " * 350_000, "<div>" * 60_000 + "<p>" + "</b></x></p>" * 60_000, '<a "> "' * 150_000, "<ul><li>" + "<span>" * 40_000 + "<ul>" + "<i>" * 40_000 + "<li></li>" * 40_000, "<!" * 500_000])
def test_bad_pages_are_walked_in_linear_time(page):
    start, events = time.time(), Events()
    walk(page, events)
    assert time.time() - start < 4


def test_text_of_tags_that_do_not_end():
    events = Events()
    walk("<p>a <b x='1'>c</b> d <i e", events)
    assert "".join(t for t in events.columns["text"] if t) == "a c d <i e"


def test_elements_keep_their_depth(make_pages):
    page = '<div class="o">' + "<div>" * 400 + '<div class="i"><p>found</p></div>' + "</div>" * 401
    rows, _ = selectors.extract_by_selector(make_pages((URL, page)), {"v": "div.o div.i > p"})
    assert [r.v for r in rows.collect()] == ["found"]


# ------------------------------------------------------------------------- products


def _product(make_pages, html):
    found, missed = products.extract_products(make_pages((URL, html)))
    rows = found.collect()
    assert len(rows) + missed.count() == 1
    return rows[0].asDict() if rows else None


def _ld(body):
    return f'<script type="application/ld+json">{body}</script>'


def test_json_ld_variants(make_pages):
    full = _product(
        make_pages,
        _ld("{bad,,}") + _ld('[{"@type":"WebSite"},[{"@graph":[{"@type":["Thing","schema:Product"],"name":" N ","brand":[{"name":"B"}],'
        '"mpn":7,"image":[{"url":"/i.png"}],"offers":[null,{"price":"$1,299.50","priceCurrency":"USD","availability":"https://schema.org/InStock"}],'
        '"aggregateRating":{"ratingValue":4.5,"ratingCount":"12"},"description":"d"}]}]]'),
    )
    assert full == {
        "url": URL, "name": "N", "price": 1299.5, "currency": "USD", "availability": "InStock", "brand": "B", "sku": "7",
        "image": "https://shop.example/i.png", "rating": 4.5, "review_count": 12, "description": "d", "source": "json-ld",
    }
    plain = _product(make_pages, _ld('{"@type":"Product","name":"P","brand":"Z","offers":{"price":5},"image":"☂image/svg+xml"}'))
    assert (plain["price"], plain["brand"], plain["image"], plain["rating"]) == (5.0, "Z", None, None)
    assert _product(make_pages, _ld('{"@type":"Article","name":"x"}')) is None
    deep = '{"@graph":[' * 9 + '{"@type":"WebSite"},{"@type":"Product","name":"deep"}' + "]}" * 9
    assert _product(make_pages, _ld("[[[[[" + deep + "]]]]]"))["name"] == "deep"


def test_opengraph(make_pages):
    page = (
        '<meta property="og:title" content=" T "><meta property="og:title" content="second"><meta name="OG:TYPE" content="product">'
        '<meta property="og:image" content="//cdn.example/i.jpg">'
    )
    row = _product(make_pages, page)
    assert (row["name"], row["price"], row["image"], row["source"]) == ("T", None, "https://cdn.example/i.jpg", "opengraph")
    priced = _product(make_pages, '<meta property="og:price:amount" content="9,99"><meta property="og:price:currency" content="EUR">')
    assert (priced["price"], priced["currency"]) == (999.0, "EUR")
    assert _product(make_pages, '<meta property="og:title" content="only a title">') is None


def test_microdata(make_pages):
    page = (
        '<div itemscope itemtype="https://schema.org/Product"><span itemprop="name"> A <b>B</b></span><a itemprop="brand" href="/b">Br</a>'
        '<meta itemprop="price" content="3.20"><link itemprop="availability" href="x" content="http://schema.org/OutOfStock">'
        '<img itemprop="image" src="/m.png"></div>'
    )
    row = _product(make_pages, page)
    assert (row["name"], row["brand"], row["price"], row["availability"], row["image"]) == (
        "AB", "Br", 3.2, "OutOfStock", "https://shop.example/m.png",
    )
