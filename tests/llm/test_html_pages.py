import random
import time

import pytest

from leafmill.llm import html_text


def _texts(source):
    return [t for _, t in html_text.Page(source).blocks]


@pytest.mark.parametrize(
    ("source", "texts"),
    [
        ('<p><i aria-hidden="true"></i> text</p><p>more</p>', ["text", "more"]),
        ("<article><div hidden>x</div><p>a</p><p>b</p></article><p>c</p>", ["a", "b", "c"]),
        ("<div><div style='color: red; DISPLAY : none'><div>x</div>y</div>a</div>b", ["a", "b"]),
        ("<p hidden>x<p>a</p><ul><li hidden>y<li>b</ul>", ["a", "b"]),
        ('<p title="The hidden cost">a</p><p class="mt-2 hidden md:block">b</p><p data-x=\'aria-hidden="true"\'>c</p>', ["a", "b", "c"]),
        ('<p aria-hidden="false">a</p><p aria-hidden=TRUE>x</p><p alt="display: none">b</p><p id=a hidden="">y</p>', ["a", "b"]),
        ("<p>a</p><div hidden>no</div><div>h</div>", ["a", "h"]),
        ("<div hidden><script>x('</div>')</script><svg aria-hidden=true><path/></svg></div><p>a</p>", ["a"]),
    ],
)
def test_text_after_hidden_elements_stays(source, texts):
    assert _texts(source) == texts


def test_hidden_links_end():
    page = html_text.Page('<div><a hidden href="/">x</a><p>not a link</p><p><a href="/">link</a></p></div>')
    assert sum(page.links) == len("link")
    assert [page.tag[page.parent[k]] for k, t in enumerate(page.tag) if t == "p"] == ["div", "div"]


def _prose(rng):
    return " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randint(8, 80))).capitalize() + "."


def test_silver_pages_are_told_without_a_tree():
    rng = random.Random(4)
    parts = ["<article>", "</article>", "<MAIN class=x>", "</main>", "<p>a", "<!-- <article> -->", "<script>'<main>'</script>", '<p title="<article>">', "<title/>", "<article", "<br/>"]
    pages = ["".join(rng.choices(parts, k=rng.randint(1, 7))) for _ in range(3000)]
    want = [html_text._silver(html_text.Page(s)) is not None for s in pages]
    assert [html_text.has_silver(s) for s in pages] == want and 0.1 < sum(want) / len(want) < 0.9


def test_pages_without_articles_keep_their_text(spark):
    rng = random.Random(5)
    rows, truth = [], {}
    for k in range(60):
        texts = [_prose(rng) for _ in range(rng.randint(2, 9))]
        body = "".join(f"<p>{t}</p>" for t in texts)
        comments = "".join(f'<div class="comment"><p>{_prose(rng)}</p></div>' for _ in range(2))
        top, end = f'<nav><a href="/">{_prose(rng)[:20]}</a></nav><div class="ad">{_prose(rng)[:60]}</div>', f"<div class='comments'>{comments}</div><footer>{_prose(rng)}</footer>"
        rows.append((k, f'<html><body class="no-sidebar">{top}<div class="wrap">{body}</div>{end if k % 2 else ""}</body></html>'))
        truth[k] = "\n".join(texts)
    pages = spark.createDataFrame(rows, "page_id long, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages, html_text.fit_on(pages)).collect()}
    assert all(got[k] for k in got) and sum(got[k] == truth[k] for k in truth) >= 50


def test_the_sample_is_of_pages_with_an_article_and_whole(spark, monkeypatch):
    rows = [(k, f"<div>{k}</div>") for k in range(300)] + [(k, f"<article><p>{k}</p></article>" + "x" * 250_000 + "<footer>end</footer>") for k in range(300, 303)]
    seen = []
    monkeypatch.setattr(html_text, "training", lambda pages, f=html_text.training: seen.extend(pages) or f(pages))
    html_text.fit_on(spark.createDataFrame(rows, "page_id long, html string"), sample=5)
    assert sorted(seen) == sorted(h for _, h in rows[300:])


def test_rows_without_ids_and_copies_do_not_crowd_the_sample(spark, monkeypatch):
    page = "<article><p>a</p></article>"
    rows = [(None, "<div>x <article")] * 50 + [(None, page), *[(7, page + "b")] * 50, (8, page + "c")]
    seen = []
    monkeypatch.setattr(html_text, "training", lambda pages, f=html_text.training: seen.extend(pages) or f(pages))
    html_text.fit_on(spark.createDataFrame(rows, "page_id long, html string"), sample=5)
    assert sorted(seen) == sorted([page, page + "b", page + "c"])


@pytest.mark.parametrize("page", ["<a " * 350_000, "<div>" * 50_000 + "</x></b>" * 50_000 + "</div>" * 50_000, '<a "> "' * 150_000, "<b>" + "<div>" * 30_000 + "</b>" * 60_000, "<p>x" + "<span>" * 40_000 + "<li>y" * 40_000, "<!" * 500_000])
def test_bad_pages_are_read_in_linear_time(page):
    start = time.time()
    html_text.Page(page)
    html_text.has_silver(page)
    assert time.time() - start < 6


def test_what_is_no_tag_is_text():
    assert _texts("<p>a <b x='>'>c</b> d <i e") == ["a c d <i e"]
    assert _texts("<p>a</p><!-- b > c") == ["a"] and _texts("<p>a</p>b <!-- c") == ["a", "b"]
    assert _texts('<p title="x>a</p><p>b</p>') == ["a", "b"]
