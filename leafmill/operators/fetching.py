"""Late fetch: wide columns of the rows that won, without a shuffle of those that lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.session import durable

FILTER_ROWS = 16_000_000  # winners up to which a filter of their keys is sent to every task: 4 bytes each, so 64 MB
SENT_ROWS = 100_000  # winners up to which their rows may be sent to every task
BITS = 32  # per winner; a row that lost passes with a chance of one in so many
_BUCKET = 32_768  # bits of one bitmap of Spark's bitmap functions


def late_fetch(winners: DataFrame, wide: DataFrame, keys: list[str]) -> DataFrame:
    """``winners`` joined with the rows of ``wide`` that have their ``keys``; nulls are equal.

    A filter, one bit for each winner's key in a bitmap of a proven size, is tested where the wide rows are scanned, so hardly any row
    but the winners' is shuffled. With more winners than a filter may have, the join is a plain one.
    """
    winners = durable(winners)
    n = winners.count()
    if n > SENT_ROWS:
        # Spark guesses their size by that of the files they come from, which says nothing of rows made of them.
        winners = winners.hint("merge")
    if not n or n > FILTER_ROWS:
        return _joined(winners, wide, keys)
    size = max(1, n * BITS // _BUCKET) * _BUCKET

    def bit() -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(size))

    maps = winners.select(bit().alias("bit")).groupBy(F.floor(F.col("bit") / _BUCKET).alias("__bucket")).agg(F.bitmap_construct_agg(F.pmod("bit", F.lit(_BUCKET))).alias("__map"))
    tested = wide.withColumn("__bit", bit()).withColumn("__bucket", F.floor(F.col("__bit") / _BUCKET))
    place = F.pmod("__bit", F.lit(_BUCKET)).cast("int")
    octet = F.conv(F.hex(F.substring("__map", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.call_function("shiftright", octet, F.pmod(place, F.lit(8))).bitwiseAND(1) == 1
    kept = tested.join(F.broadcast(maps), "__bucket").filter(held).drop("__bit", "__bucket", "__map")
    return _joined(winners, kept, keys)


def _joined(winners: DataFrame, wide: DataFrame, keys: list[str]) -> DataFrame:
    named = {k: f"__key{i}" for i, k in enumerate(keys)}
    same = [winners[k].eqNullSafe(F.col(named[k])) for k in keys]
    return winners.join(wide.withColumnsRenamed(named), same).drop(*named.values())
