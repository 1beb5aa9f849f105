import os

import corpus_pipeline
import oracle
from pyspark.sql import functions as F

SF_DIR = os.path.join(oracle.TESTDATA, "sf0.001")


def test_stages_keep_columns_and_decide(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF_DIR).collect(), docs.schema)
        after = docs.count()
        assert 0 < after <= before, name
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert {r[0] for r in packed.select("doc_id").collect()} == {r[0] for r in docs.select("doc_id").collect()}
    assert docs.filter(F.col("text").rlike(r"@mail[0-9]+\.example\.com")).isEmpty()


def test_stages_take_odd_rows(spark):
    rows = [(1, None, "en", None, None), (None, "x y", None, "s", 3), (2, "", "en", "s", 0), (3, "a b c", "en", "s", 5), (3, "a b c", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for docs_of in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs_of, SF_DIR)
            assert out.count() == docs_of.count(), name
