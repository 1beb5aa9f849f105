"""Batch split into usable pages and errors, and the rendered page document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.operators.signals import with_block


def describe_failure(kind: Column, message: Column) -> Column:
    """``Type: message``, or the type alone when the message is blank."""
    text = F.trim(F.coalesce(message, F.lit("")))
    return F.when(text == "", kind).otherwise(F.concat_ws(": ", kind, text))


def with_errors(captures: DataFrame) -> DataFrame:
    """Every capture with its block state and an ``error``, NULL for a usable page.

    A failed fetch is a row with ``error_type`` (and ``error_message``); a refused one
    is reported as ``blocked: <reason>``. One pass, for writing both kinds at once.
    """
    checked = with_block(captures)
    failed = F.col("error_type").isNotNull() if "error_type" in captures.columns else F.lit(False)
    reason = F.concat(F.lit("blocked: "), F.col("block_reason"))
    if "error_type" in captures.columns:
        reason = F.when(failed, describe_failure(F.col("error_type"), F.col("error_message"))).otherwise(reason)
    unusable = failed | F.coalesce(F.col("blocked"), F.lit(False))
    return checked.withColumn("error", F.when(unusable, reason))


def split_pages(captures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable pages, errors). Every row lands in exactly one of the two."""
    every = with_errors(captures)
    return every.filter("error IS NULL").drop("error"), every.filter("error IS NOT NULL").select("url", "error")


def front_matter() -> Column:
    return F.concat_ws(
        "\n",
        F.lit("---"),
        F.concat(F.lit("url: "), F.col("url")),
        F.concat(F.lit("status_code: "), F.col("status_code").cast("string")),
        F.concat(F.lit("title: "), F.col("title")),
        F.concat(F.lit("links_count: "), F.col("links_count").cast("string")),
        F.concat(F.lit("blocked: "), F.col("blocked").cast("string")),
        F.concat(F.lit("block_reason: "), F.coalesce(F.col("block_reason"), F.lit(""))),
        F.lit("---"),
    )


def page_document(pages: DataFrame) -> DataFrame:
    """Front matter and markdown, or a notice for a blocked page."""
    notice = F.concat(
        F.lit("No content: the capture is a refusal ("),
        F.col("block_reason"),
        F.lit(
            "), so it has no text. Another capture of this URL may hold it."
        ),
    )
    body = F.when(F.col("blocked"), notice).otherwise(F.col("markdown"))
    return pages.withColumn("document", F.concat_ws("\n\n", front_matter(), body))
