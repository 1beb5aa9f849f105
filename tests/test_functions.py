import html as htmllib
import random
from urllib.parse import urljoin

from pyspark.sql import functions as F

from leafmill.functions import markup, numbers, text, urls
from leafmill.functions.sqltext import first_by


def _one(spark, value, sql):
    return spark.createDataFrame([(value,)], "x string").select(F.expr(sql).alias("y")).first().y


def test_resolve_agrees_with_the_standard_library(spark):
    bases = ["http://a/b/c/d;p?q", "http://a", "http://a/", "https://X.com/a/b/", "http://a/b/c#f?z", "http://h/a//b/c"]
    fixed = (
        "g:h g ./g g/ /g //g ?y g?y #s g#s g?y#s ;x g;x . ./ .. ../ ../g ../.. ../../ ../../g ../../../g /./g /../g g. ..g "
        "./../g ./g/. g/./h g/../h http:g HTTP://Foo/Bar?# mailto:a@b javascript:void(0) /a//b/../c //h/../x http://a/? x//y /.."
    ).split() + ["", " x", "\t/a\nb"]
    rng = random.Random(7)
    made = ["".join(rng.choice(["a", "b", "/", "..", ".", "?", "#", "=", "&", "/", "é"]) for _ in range(rng.randint(1, 9))) for _ in range(300)]
    # Two leading slashes without a host are read differently across versions of the standard library.
    made = [m for m in made if not m.startswith("//")]
    cases = [(b, r) for b in bases for r in fixed + made]
    got = spark.createDataFrame(cases, "b string, r string").select("b", "r", F.expr(urls.resolve("b", "r")).alias("o")).collect()
    wrong = [(r.b, r.r, r.o, urljoin(r.b, r.r)) for r in got if r.o != urljoin(r.b, r.r)]
    assert not wrong, wrong[:5]


def test_entities(spark):
    cases = ["plain", "a &amp; b", "&#8364;&#x20AC;&#X1F600;", "&bogus; &eacute;&nbsp;x", "&amp;amp;", "&#0; &#xD800;", "&copy", "R&D &lt;b&gt;"]
    want = ["plain", "a & b", "€€😀", "&bogus; é\xa0x", "&amp;", "� �", "&copy", "R&D <b>"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, x string")
    got = [r.y for r in df.orderBy("i").select(F.expr(text.decode_entities("x")).alias("y")).collect()]
    assert got == want
    assert got[2] == htmllib.unescape(cases[2])


def test_visible_text_joins_text_nodes_by_one_space(spark):
    page = "<html><title>T</title><script>var a='<p>no</p>'</script><body><p>a</p><p>b<b>c</b><!-- x > y -->d &lt;e&gt;</body>"
    assert _one(spark, page, text.visible_text("x")) == "T a b c d <e>"
    assert _one(spark, "<p title='x>y'>kept</p> <script>never closed", text.visible_text("x")).strip() == "kept"
    assert _one(spark, "", text.visible_text("x")) == ""


def test_long_tag_runs_do_not_exhaust_the_regex_stack(spark):
    page = "<div></div>" * 60_000 + "<a " + "b='c' " * 20_000 + "href='/x'>t</a>" + "<!--" * 20_000
    assert _one(spark, page, text.visible_text("x")).strip() == "t"


def test_titles(spark):
    assert _one(spark, "<html><head><TITLE lang=en> A &amp; B\n</TITLE></head>", text.page_title("x")) == "A & B"
    assert _one(spark, "<!-- <title>no</title> --><p>x</p>", text.page_title("x")) == ""


def test_attributes(spark):
    read = lambda attrs: _one(spark, attrs, text.attribute("x", "href"))
    assert read(' class="a" href="/x?a=1&amp;b=2"') == "/x?a=1&b=2"
    assert read(" HREF = '/y'") == "/y"
    assert read(" href=/z") == "/z"
    assert read(" href") == "" and read(' href=""') == ""
    assert read(' data-href="/no"') is None


def test_numbers(spark):
    read = lambda v, f: _one(spark, v, f("x"))
    assert read("$1,299.00", numbers.price_number) == 1299.0
    assert read("1.299,00", numbers.price_number) == 1.299
    assert read("free", numbers.price_number) is None
    assert read("1.299,00", numbers.catalog_number) == 1.299
    assert read("$5", numbers.catalog_number) is None
    assert read("1,234", numbers.price_count) == 1234


def test_first_by_keeps_the_first_of_each_key_in_order(spark):
    rng = random.Random(1)
    items = [(rng.choice("abcdef"), i) for i in range(200)]
    df = spark.createDataFrame([(items,)], "x array<struct<k:string,n:int>>")
    got = [(r.k, r.n) for r in df.select(F.expr(first_by("x", "k")).alias("y")).first().y]
    want, seen = [], set()
    for k, n in items:
        if k not in seen:
            seen.add(k)
            want.append((k, n))
    assert got == want


def _walked(page):
    """The events of a page as dicts, by place."""
    events = markup.Events()
    markup.walk(page, events)
    names = list(events.columns)
    assert len({len(column) for column in events.columns.values()} | {len(events.held)}) == 1
    events.end_page()
    assert len(events.arrays()) == 1
    return [dict(zip(names, row, strict=True)) for row in zip(*events.columns.values(), strict=True)]


def test_event_stream_nests_and_closes_everything():
    rows = _walked("<ul><li>a<li>b<ul><li>c</ul></ul><p>x<p>y<table><tr><td>1<td>2<tr><td>3</table>")
    opened = [r for r in rows if r["kind"] == "open"]
    assert sum(r["kind"] == "close" for r in rows) == len(opened)
    parents = [(r["tag"], rows[r["parent"]]["tag"] if r["parent"] >= 0 else None) for r in opened]
    assert parents == [
        ("ul", None), ("li", "ul"), ("li", "ul"), ("ul", "li"), ("li", "ul"), ("p", None), ("p", None),
        ("table", None), ("tr", "table"), ("td", "tr"), ("td", "tr"), ("tr", "table"), ("td", "tr"),
    ]
    for row in opened:
        assert row["pos"] < row["end"] < len(rows)
        above = rows[row["parent"]] if row["parent"] >= 0 else None
        assert above is None or (above["pos"] < row["pos"] < above["end"] and row["depth"] == above["depth"] + 1)
    items = [(r["nth"], r["prev"] >= 0, r["rest"], r["type_nth"], r["type_rest"]) for r in opened if r["tag"] == "li"]
    assert items == [(1, False, 1, 1, 1), (2, True, 0, 2, 0), (1, False, 0, 1, 0)]
    assert [(r["nth"], r["rest"], r["type_nth"], r["type_rest"]) for r in opened if r["tag"] == "p"] == [(2, 2, 1, 1), (3, 1, 2, 0)]


def test_event_stream_survives_broken_markup():
    for page in ("<", "<a", "<a href='x", "</p>", "<![cdata", "<!--", "<p class=\"a>b</p>", "<script>x", "a < b", "<div " * 50, "\x00<b>"):
        rows = _walked(page)
        assert [r["pos"] for r in rows] == list(range(len(rows)))
    assert [r["depth"] for r in _walked("<b>" * 5000 + "x") if r["kind"] == "open"] == list(range(5000))


def test_numbers_of_pages_neither_fail_nor_mislead(spark):
    from leafmill.functions import numbers

    df = spark.createDataFrame([("10d",), ("1,299.50",), ("NaN",), (" 7 ",), ("1e3",), ("99999999999",), ("",)], "x string")
    got = df.selectExpr(f"{numbers.catalog_number('x')} AS a", f"{numbers.price_count('x')} AS b").collect()
    assert [r.a for r in got] == [None, 1299.5, None, 7.0, 1000.0, 99999999999.0, None]
    assert [r.b for r in got] == [10, 1299, None, 7, 13, 99999999999, None]
