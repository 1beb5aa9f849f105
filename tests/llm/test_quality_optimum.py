import numpy as np
from pyspark.sql import functions as F

from leafmill.llm import quality


def _loss(weights, cuts, x, y):
    """The mean cumulative-link loss, written out grade by grade."""
    out = 0.0
    for row, grade in zip(x, y, strict=True):
        u = row @ weights
        above = [1.0, *(1 / (1 + np.exp(-(u - c))) for c in cuts), 0.0]
        out -= np.log(max(above[grade] - above[grade + 1], 1e-12))
    return out / len(y)


def test_the_fit_reaches_the_optimum_that_plain_descent_finds():
    """Five features, three grades, noisy ratings: coordinate descent on the loss itself, with numeric slopes, is the answer to reach."""
    rng = np.random.default_rng(2)
    x = (rng.random((300, 5)) < 0.5).astype(float)
    score = x @ np.array([2.0, -1.5, 1.0, 0.0, -0.5]) + rng.logistic(size=300)
    y = np.digitize(score, [-0.3, 1.2])
    found = [np.flatnonzero(row).astype(np.int32) if row.any() else np.array([quality.BUCKETS - 1], np.int32) for row in x]
    model = quality.fit(found, y, 3)
    best, step = np.zeros(7), 0.5
    value = lambda p: _loss(p[:5], [p[5], p[5] + np.exp(p[6])], x, y)
    now = value(best)
    while step > 0.02:
        moved = False
        for k in range(7):
            for sign in (step, -step):
                trial = best.copy()
                trial[k] += sign
                if (here := value(trial)) < now - 1e-9:
                    best, now, moved = trial, here, True
        step = step if moved else step / 2
    assert _loss(model.weights[:5], model.thresholds, x, y) <= now * 1.02
    assert list(model.thresholds) == sorted(model.thresholds)


def test_rows_of_one_id_are_one_document(spark):
    docs = spark.createDataFrame([(1, "good text")] * 40 + [(1, None), (2, "bad text"), (None, "x")], "doc_id long, text string")
    ratings = spark.createDataFrame([(1, 2), (1, 2), (2, 0), (3, 1), (None, 1)], "id long, grade int")
    found, grades = quality.rated_sample(docs, ratings, sample=2)
    assert len(found) == len(grades) <= 2
    found, grades = quality.rated_sample(docs, ratings)
    assert sorted(grades) == [0, 2] and ratings.filter(F.col("id") == 3).count() == 1
