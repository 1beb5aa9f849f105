"""Sorted runs: how ordered folds are spread over tasks whatever the key skew.

A fold over one key's rows in time order is sequential, but nothing forces all of a
key's rows into one task. Rows are range-partitioned on (key, order), which cuts a hot
key into many partitions of even size; each (key, partition) is a *run*. A fold then
takes three steps: summarise every run in parallel, chain the summaries of a key (as
many as it has partitions, so few), and apply each run with the state that enters it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.session import durable


def sorted_runs(df: DataFrame, keys: list[str], order: list[str], partitions: int | None = None) -> DataFrame:
    """Rows sorted by key and order, with their ``run`` number; written once.

    The rows are checkpointed because the range boundaries come from a sample: every
    later step must see the very same runs. The checkpoint keeps the partitions, so
    ``run`` is also the partition a row lives in.
    """
    ranged = (
        df.repartitionByRange(partitions, *keys, *order) if partitions else df.repartitionByRange(*keys, *order)
    )
    return durable(ranged.sortWithinPartitions(*keys, *order).withColumn("run", F.spark_partition_id()))


def with_previous(runs: DataFrame, keys: list[str], order: list[str], carried: list[str]) -> DataFrame:
    """Add ``previous``: the ``carried`` columns of the row before, within the key.

    The window is per run, never per key. The first row of a run takes the last row of
    the key's run before it. Only the first key of a partition can have one, so that
    table has fewer rows than there are partitions and is safe to broadcast.
    """
    within = Window.partitionBy(*keys, "run").orderBy(*order)
    row = F.struct(*carried)
    lasts = runs.groupBy(*keys, "run").agg(F.max_by(row, F.struct(*order)).alias("last"))
    entering = lasts.withColumn(
        "entering", F.lag("last").over(Window.partitionBy(*keys).orderBy("run"))
    ).filter(F.col("entering").isNotNull()).drop("last")
    local = runs.withColumn("__before", F.lag(row).over(within))
    joined = local.join(F.broadcast(entering), [*keys, "run"], "left")
    return joined.withColumn("previous", F.coalesce("__before", "entering")).drop("__before", "entering")


def ranked(df: DataFrame, key: str, order: str, into: str) -> DataFrame:
    """Number the rows of each key by ``order`` from 1, however many rows a key has.

    Rows are numbered within runs; a run starts where the key's earlier runs ended. There are at most as many
    keys and runs in that table as there are keys and partitions together.
    """
    runs = sorted_runs(df, [key], [order])
    sizes = runs.groupBy(key, "run").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(key).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(key, "run", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start")).filter("__start > 0")
    # Only the first key of a partition goes on from an earlier run, so this table has fewer rows than partitions.
    placed = runs.join(F.broadcast(starts), [key, "run"], "left")
    turn = F.row_number().over(Window.partitionBy(key, "run").orderBy(order))
    return placed.withColumn(into, turn + F.coalesce("__start", F.lit(0))).drop("__start", "run")
