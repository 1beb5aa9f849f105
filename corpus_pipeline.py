"""A training corpus from raw documents: grade, deduplicate, decontaminate, redact, pack.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept; all but the last return the columns of
``docs``. Other tables are read from ``sf_dir``. ``run`` writes each stage's rows to the shared folder before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import decontamination, ngram_join, packing, pii, quality
from leafmill.llm.common import written
from leafmill.plans.views import table


def grade(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are good more likely than not. The model is fitted on rated documents among ``docs``; without any, all stay."""
    model = quality.fit_on(docs, table(spark, sf_dir, "labels"))
    if not model.weights.any():
        return docs
    graded = quality.grade_documents(docs, model)
    return graded.filter(quality.kept(graded.columns[-1])).select(docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest id. Repeated rows of an id are one document and stay together; rows
    without an id stay."""
    firsts = ngram_join.similar_components(docs).filter("doc_id = component_id").select("doc_id").distinct()
    return docs.join(firsts, "doc_id", "left_semi").unionByName(docs.filter("doc_id is null")).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more stands in the test items go; from the others the words that do are cut."""
    found = decontamination.find_windows(docs, table(spark, sf_dir, "benchmark"))
    hits = found.columns[-1]
    stay = decontamination.cut_hits(found.filter(~decontamination.contaminated(hits)), hits)
    return _resized(stay, F.col(f"{hits}.n_hit") > 0).select(docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind in brackets."""
    found = pii.find_spans(docs, pii.fit_on(docs))
    spans = found.columns[-1]
    some = F.size(f"{spans}.spans") > 0
    text = F.when(some, pii.redacted(F.col("text"), F.col(f"{spans}.spans"))).otherwise(F.col("text"))
    return _resized(found.withColumn("text", text), some).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin and place of every piece of every document."""
    return packing.best_fit(docs)


def _resized(docs: DataFrame, changed) -> DataFrame:
    return docs.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))


STAGES = [("quality", grade), ("near_duplicates", deduplicate), ("decontamination", decontaminate), ("personal_data", redact), ("packing", pack)]

#: The classifier and the components are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
