"""Choosing among logged attempts: first usable response, best attempt per URL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators.fetching import late_fetch
from leafmill.operators.places import RETRYABLE
from leafmill.operators.signals import block_reason
from leafmill.session import durable

# Labels of the tiers, in the order they are tried.
EXHAUSTED = "impersonate:exhausted"


def first_usable_response(attempts: DataFrame, sources: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(responses, errors) per request, trying all its sources in attempt order, or the first ``sources``.

    Busy statuses and bodies that are not JSON are passed over; another status is a
    hard error at once; when every source was passed over the error lists each problem.
    Only slim columns are folded; the bodies of the answers alone are fetched afterwards.
    """
    status, attempt = F.col("status_code"), F.col("attempt")
    failed = F.col("error_type") if "error_type" in attempts.columns else F.lit(None).cast("string")
    busy = status.isin(*RETRYABLE)
    is_json = F.try_parse_json("body").isNotNull()
    outcome = (
        F.when(failed.isNotNull(), "pass")
        .when(busy, "pass")
        .when(status != 200, "hard")
        .when(is_json, "ok")
        .otherwise("pass")
    )
    problem = F.concat(
        F.col("host"),
        F.when(failed.isNotNull(), F.concat(F.lit(": "), failed))
        .when(busy, F.concat(F.lit(": HTTP "), status.cast("string")))
        .otherwise(": non-JSON response"),
    )
    tried = attempts if sources is None else attempts.filter(attempt <= sources)
    content = F.xxhash64("body").alias("content")
    judged = tried.select("request_id", "attempt", "host", "status_code", content, outcome.alias("__outcome"), problem.alias("__problem"))
    ends = F.when(F.col("__outcome") != "pass", attempt)
    answer = F.struct("__outcome", "host", "status_code", "attempt", "content")
    skipped = F.when(F.col("__outcome") == "pass", F.struct(attempt.alias("a"), F.col("__problem").alias("p")))
    folded = durable(
        judged.groupBy("request_id").agg(F.min_by(answer, ends).alias("end"), F.sort_array(F.collect_set(skipped)).alias("skipped"))
    )
    won = folded.filter(F.col("end.__outcome") == "ok").select("request_id", "end.host", "end.attempt", "end.content")
    good = _one_each(late_fetch(won, tried.select("request_id", "attempt", content, "body"), ["request_id", "attempt", "content"]), ["request_id"])
    good = good.select("request_id", "host", "body")
    listed = F.concat_ws("; ", F.transform("skipped", lambda s: s["p"]))
    hard = F.concat(F.lit("HTTP "), F.col("end.status_code").cast("string"), F.lit(" from "), F.col("end.host"))
    message = F.when(F.col("end").isNull(), F.concat(F.lit("every source was unavailable ("), listed, F.lit(")"))).otherwise(hard)
    bad = folded.filter(F.col("end").isNull() | (F.col("end.__outcome") == "hard")).select(
        "request_id", message.alias("error")
    )
    return good, bad


def best_attempt(attempts: DataFrame, browser_first: bool = False) -> tuple[DataFrame, DataFrame]:
    """(chosen attempt per URL, errors) by the order in which tiers were tried.

    The first unblocked answer wins under its own label. If every answer was blocked, a
    static-first chain keeps the last one that is not the final ``stealth`` tier,
    relabelled. A browser-first chain keeps the browser's answer, provided the static
    tiers after it answered at all. No answer to keep is an error.
    """
    keys = [c for c in ("page_id", "url") if c in attempts.columns]
    attempt, via, answered = F.col("attempt"), F.col("via"), ~F.col("failed")
    judged = attempts.withColumn(
        "block_reason", F.when(answered, block_reason())
    )
    clear = answered & F.col("block_reason").isNull()
    blocked = answered & F.col("block_reason").isNotNull()
    static = ~via.isin("playwright", "stealth")
    spare = blocked & ((via != "stealth") if not browser_first else static)
    # Only slim columns are folded; the page itself is fetched for the winners.
    judged = judged.withColumn("content", F.xxhash64("html"))
    held = F.struct("attempt", "via", "status_code", "block_reason", "content")
    spared = F.struct("attempt", F.lit(EXHAUSTED).alias("via"), "status_code", "block_reason", "content")
    sums = [
        F.min_by(held, F.when(clear, attempt)).alias("clear"),
        F.max_by(spared, F.when(spare, attempt)).alias("spare"),
    ]
    best = F.coalesce("clear", "spare")
    if browser_first:
        sums += [
            F.max_by(held, F.when(blocked & (via == "playwright"), attempt)).alias("browser"),
            F.coalesce(F.bool_or(static), F.lit(False)).alias("tried"),
            F.coalesce(F.bool_or(static & answered), F.lit(False)).alias("static_answered"),
        ]
        kept = F.when(~F.col("tried") | F.col("static_answered"), F.col("browser"))
        best = F.coalesce("clear", kept, F.when(F.col("browser").isNull(), F.col("spare")))
    picked = durable(judged.groupBy(*keys).agg(*sums).select(*keys, best.alias("best")))
    best = picked.filter(F.col("best").isNotNull()).select(*keys, "best.*")
    pages = attempts.select(*keys, "attempt", F.xxhash64("html").alias("content"), "html")
    good = _one_each(late_fetch(best, pages, [*keys, "attempt", "content"]), keys)
    good = good.select(*keys, "attempt", "via", "status_code", "block_reason", "html")
    bad = picked.filter(F.col("best").isNull()).select(*keys, F.lit("no attempt was answered").alias("error"))
    return good, bad


def _one_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Repeated rows of an attempt count once."""
    once = F.row_number().over(Window.partitionBy(*keys).orderBy("attempt"))
    return rows.withColumn("__turn", once).filter("__turn = 1").drop("__turn")
