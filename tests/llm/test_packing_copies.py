from pyspark.sql import functions as F

from leafmill.llm import queries


def test_copies_and_near_copies_share_no_bin(spark, monkeypatch):
    base = [f"w{k}" for k in range(100)]
    texts = ["abc d", "abc d\n", "\tABC  d", "\nabc\td ", " ".join(base), " ".join([*base, "x"]), " ".join(["y", *base]), "other words"]
    docs = spark.createDataFrame([(k, t, f"s{k}") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    bins = {r["doc_id"]: r["bin_id"] for r in queries.op5(spark, "").collect()}
    assert len({bins[k] for k in range(4)}) == 4 and len({bins[k] for k in (4, 5, 6)}) == 3
    assert len(set(bins.values())) == 4
    twice = docs.unionByName(docs.filter("doc_id = 7").withColumn("doc_id", F.lit(0).cast("long")))
    monkeypatch.setattr(queries, "table", lambda *_: twice)
    assert queries.op5(spark, "").count() == 9
