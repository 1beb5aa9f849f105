import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import hamming_index


def _vectors(spark, n):
    v = np.random.default_rng(4).normal(size=(n, 32))
    return v, spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")


def _plans(monkeypatch):
    """The plan of each step that is written, by its label, as it stands before it runs."""
    plans = {}
    written = hamming_index.written
    monkeypatch.setattr(hamming_index, "written", lambda df, label: (plans.__setitem__(label, df._jdf.queryExecution().sparkPlan().toString()), written(df, label))[1])
    return plans


def test_blocks_of_vectors_are_never_broadcast(spark, monkeypatch):
    """A few queries fill a file of some kilobytes, but each block of them meets every group of blocks: no side may go through the driver."""
    plans = _plans(monkeypatch)
    _, df = _vectors(spark, 600)
    assert hamming_index.nearest(df, F.col("id") % 50 == 0).count() == 12 * 5
    assert "Join" in plans["scanned"] and "Broadcast" not in plans["scanned"]


def test_probes_are_never_broadcast(spark, monkeypatch):
    """A query makes 16 x 17 probes or more of one row."""
    plans = _plans(monkeypatch)
    v = np.repeat(np.random.default_rng(5).normal(size=(60, 32)), 10, axis=0) + np.random.default_rng(6).normal(size=(600, 32)) * 0.05
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    assert hamming_index.nearest(df, F.col("id") % 10 == 0).count() == 60 * 5
    for label in ("crowded", "probed"):
        joins = [line for line in plans[label].splitlines() if "Join" in line]
        assert joins and not [line for line in joins if "Broadcast" in line and "LeftAnti" not in line], label


@pytest.mark.parametrize(("block", "held"), [(16, 2 * 16 * 32 * 8), (16, 1 << 25), (64, 1), (1000, 1 << 25)])
def test_every_block_of_queries_meets_every_block_of_entries_once(spark, monkeypatch, block, held):
    monkeypatch.setattr(hamming_index, "BLOCK", block)
    monkeypatch.setattr(hamming_index, "SET", held)
    v, df = _vectors(spark, 700)
    codes = hamming_index.learn(v, 5)
    shared = spark.sparkContext.broadcast((codes.centre, codes.rotations, 256))  # a radius that holds all codes
    index = df.select(F.col("vec_id").alias("key"), F.array("vec_id").alias("ids"), F.col("embedding").alias("v"))
    queries = df.filter("vec_id % 7 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    pairs = hamming_index._scan(index, queries, shared, 32, 5)
    assert pairs.count() == pairs.select("query_id", "vec_id").distinct().count()
    got = {}
    for r in hamming_index._cosine_rank(pairs, 5).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    unit = hamming_index.unit_rows(v)
    scores = unit[::7] @ unit.T
    scores[np.arange(100), np.arange(0, 700, 7)] = -2
    assert got == {7 * k: row.tolist() for k, row in enumerate(np.argsort(-scores, axis=1)[:, :5])}
