"""Readers of captured pages and the shape every operator expects of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CAPTURES = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("js_render", T.BooleanType()),
        T.StructField("via", T.StringType()),
        T.StructField("seen_at", T.TimestampType()),
    ]
)

# What a capture holds when its source did not record the column.
_DEFAULTS = {"status_code": 200, "content_type": "text/html", "js_render": False, "via": "plain"}


def as_captures(df: DataFrame) -> DataFrame:
    """Add the capture columns a source lacks; other columns pass through."""
    for field in CAPTURES.fields:
        if field.name not in df.columns:
            default = _DEFAULTS.get(field.name)
            df = df.withColumn(field.name, F.lit(default).cast(field.dataType))
    return df


def read_captures(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Captures stored as Parquet, ORC, JSON or CSV."""
    reader = spark.read.format(fmt).options(**options)
    if fmt == "json":
        reader = reader.schema(CAPTURES)
    return as_captures(reader.load(path))


def stream_captures(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """New capture files as they arrive."""
    return spark.readStream.format(fmt).schema(CAPTURES).options(**options).load(path)


def latest_captures(captures: DataFrame, *keys: str, order: str = "seen_at") -> DataFrame:
    """One row per key: the latest by ``order``; of rows at the same time one by their content, always the same.

    Choose on derived, slim columns where the html is no longer needed. Every task keeps one row of a key before
    the shuffle, so a page captured very often is no hot key.
    """
    by = list(keys or ("url",))
    plain = [f.name for f in captures.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    at = [F.desc_nulls_last(order)] if order in captures.columns else []
    turn = F.row_number().over(Window.partitionBy(*by).orderBy(*at, F.xxhash64(*plain)))
    return captures.withColumn("__turn", turn).filter("__turn = 1").drop("__turn")
