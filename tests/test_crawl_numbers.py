from collections import deque

import numpy as np
from pyspark.sql import functions as F

from leafmill.operators import site


def _one_by_one(first, links, limit):
    waiting, seen, out = deque([first]), {first}, []
    while waiting and len(out) != limit:
        out.append(waiting.popleft())
        for k in links[out[-1]]:
            if k not in seen:
                seen.add(k)
                waiting.append(k)
    return out


def test_levels_taken_as_a_whole_keep_the_order_of_a_queue():
    rng = np.random.default_rng(7)
    for pages, most in ((1, 3), (40, 2), (3000, 6), (3000, 1)):
        links = [rng.permutation(pages)[: rng.integers(0, most + 1)].tolist() for _ in range(pages)]
        offsets = np.concatenate([[0], np.cumsum([len(k) for k in links])])
        targets = np.array([k for page in links for k in page], dtype=np.int64)
        for limit in (None, 0, 1, 35, 700):
            assert site.visit_order(0, offsets, targets, limit).tolist() == _one_by_one(0, links, limit)


def test_a_host_of_three_hundred_thousand_links_is_crawled_in_one_pass(spark, monkeypatch):
    """Level by level a crawl of one large host costs a round over all its pages for each of its levels."""
    monkeypatch.setattr(site, "_visit", lambda *_: (_ for _ in ()).throw(AssertionError("level by level")))
    n = F.col("id").cast("string")
    html = F.concat(F.lit('<a href="/'), (F.col("id") * 2).cast("string"), F.lit('">l</a><a href="/'), (F.col("id") * 2 + 1).cast("string"), F.lit('">r</a><a href="/1">h</a><a href="/no">n</a>'))
    pages = spark.range(1, 60_001).select(F.concat(F.lit("https://big.example/"), n).alias("url"), html.alias("html"))
    sites = spark.createDataFrame([("https://big.example/1",)], "site string")
    got = site.crawl_by_links(sites, pages)
    assert got.count() == got.filter(F.col("url") == F.concat(F.lit("https://big.example/"), F.col("rank").cast("string"))).count() == 60_000
