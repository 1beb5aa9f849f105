import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import hamming_index


def _shaped(kind, rng):
    if kind == "clustered":  # groups with cosines of about 0.93 to 0.96
        centres = rng.normal(size=(12, 32))
        return np.repeat(centres, 100, axis=0) + rng.normal(size=(1200, 32)) * 0.24
    if kind == "tight":  # true neighbours a few bits apart
        return np.repeat(rng.normal(size=(120, 32)), 10, axis=0) + rng.normal(size=(1200, 32)) * 0.05
    return rng.normal(size=(1200, 32)) + 4.0  # a strong common mean


@pytest.mark.parametrize("kind", ["clustered", "shifted", "tight"])
def test_recall_in_dense_groups_and_with_a_common_mean(spark, kind):
    v = _shaped(kind, np.random.default_rng(3))
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for r in hamming_index.nearest(df, F.col("id") % 10 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    unit = hamming_index.unit_rows(v)
    scores = unit[::10] @ unit.T
    scores[np.arange(120), np.arange(0, 1200, 10)] = -2
    want = np.argsort(-scores, axis=1)[:, :5]
    recall = np.mean([len(got[10 * k] & set(row.tolist())) / 5 for k, row in enumerate(want)])
    print(kind, recall)
    assert recall >= 0.97


def test_the_score_from_which_probing_is_enough():
    scores = np.linspace(1, 0, 1001)
    assert hamming_index.sure_from(scores, np.where(scores >= 0.5, 10, 200)) == pytest.approx(0.5, abs=0.01)
    assert hamming_index.sure_from(scores, np.full(1001, 94)) == float("inf")
    assert hamming_index.sure_from(scores[:50], np.zeros(50)) == float("inf")


@pytest.mark.parametrize(("radius", "sure", "flips"), [(9, np.inf, 1), (31, np.inf, 1), (32, np.inf, 2), (63, np.inf, 3), (64, np.inf, 0), (110, np.inf, 0), (110, 0.9, 1)])
def test_the_radius_gives_the_flips(radius, sure, flips):
    assert hamming_index.Codes(np.zeros(2), np.eye(2), radius, sure).flips == flips


def test_probing_alone_answers_queries_with_near_neighbours(spark, monkeypatch):
    """With what true neighbours need within reach, nothing is left to scan, and probing has found every code within the radius."""
    v = _shaped("tight", np.random.default_rng(5))
    left = []
    scan = hamming_index._scan
    monkeypatch.setattr(hamming_index, "_scan", lambda index, queries, *rest: (left.append(queries.count()), scan(index, queries, *rest))[1])
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    rows = hamming_index.nearest(df, F.col("id") % 10 == 0).collect()
    assert left == [0] and len(rows) == 120 * 5
    assert all(r["vec_id"] // 10 == r["query_id"] // 10 for r in rows)
