from leafmill.plans import workflows


def test_a_scrape_reads_the_latest_capture_and_counts_need_no_markdown(spark):
    home = '<a href="/2">two</a><a href="/3">three</a>'
    rows = [
        ("https://z.example/1", 2, home, 200), ("https://z.example/1", 1, "old", 503),
        ("https://z.example/2", 1, home, 503), ("https://z.example/2", 5, "<p>new</p>", 200), ("https://z.example/2", 5, "<p>new</p>", 200),
        ("https://z.example/3", 4, "no", 503),
    ]
    captures = spark.createDataFrame(rows, "url string, seen_at int, html string, status_code int").selectExpr("*", "'text/html' AS content_type", "'plain' AS via")
    sites = spark.createDataFrame([("https://z.example/1",)], "site string")
    documents = spark.createDataFrame([], "url string, body string")
    done = workflows.scrape_sites(sites, documents, captures)
    pages = {r.url[-1]: (r["rank"], r.blocked, r.links_count, r.markdown) for r in done.pages.collect()}
    assert pages == {"1": (1, False, 2, "[two](/2)[three](/3)"), "2": (2, False, 0, "new"), "3": (3, True, 0, "")}
    assert [(r.pages, r.blocked_pages, r["links"]) for r in done.counts.collect()] == [(3, 1, 2)]
    assert "ArrowEvalPython" in done.pages._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in done.counts._jdf.queryExecution().optimizedPlan().toString()
