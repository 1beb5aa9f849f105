import numpy as np
from pyspark.sql import functions as F

from leafmill.llm import hamming_index


def test_queries_of_a_large_group_of_near_copies_scan(spark, monkeypatch):
    """They would meet the whole group in each bucket; the others are still probed, and all get their neighbours."""
    rng = np.random.default_rng(8)
    v = np.concatenate([np.repeat(rng.normal(size=(60, 32)), 10, axis=0) + rng.normal(size=(600, 32)) * 0.05, rng.normal(size=32) + rng.normal(size=(600, 32)) * 0.02])
    left = []
    scan = hamming_index._scan
    monkeypatch.setattr(hamming_index, "_scan", lambda index, queries, *rest: (left.extend(r[0] for r in queries.select("query_id").collect()), scan(index, queries, *rest))[1])
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for r in hamming_index.nearest(df, F.col("id") % 10 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert set(range(600, 1200, 10)) <= set(left)
    unit = hamming_index.unit_rows(v)
    scores = unit[::10] @ unit.T
    scores[np.arange(120), np.arange(0, 1200, 10)] = -2
    want = np.argsort(-scores, axis=1)[:, :5]
    assert np.mean([len(got[10 * k] & set(row.tolist())) / 5 for k, row in enumerate(want)]) >= 0.97
