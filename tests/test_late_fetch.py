from pyspark.sql import functions as F

from leafmill.operators import changes
from leafmill.operators.fetching import late_fetch


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_winners_are_not_sent_to_every_task(spark):
    wide = spark.range(300_000).select(F.col("id").alias("k"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("html"))
    for winners, joined in ((150_000, "SortMergeJoin"), (500, "BroadcastHashJoin")):
        got = late_fetch(spark.range(winners).select((F.col("id") * 2).alias("k")), wide, ["k"])
        assert joined in _plan(got)
        assert got.count() == winners == got.filter(F.col("html") == F.concat(F.lit("text "), F.col("k").cast("string"))).count()


def test_contents_of_diffs_are_not_sorted_where_they_are_scanned(spark):
    rows = [(f"u{n}", turn, f"a\n{n if turn else 0}\nb") for n in range(1, 30) for turn in (0, 1)]
    found = changes.history_diffs(spark.createDataFrame(rows, "url string, turn int, content string"), order="turn")
    steps = [line.strip(" :+-*()0123456789").split("(")[0].split(" ")[0] for line in _plan(found).splitlines()]
    # From the diff downwards: both steps of the aggregate of contents stand above the first exchange.
    assert steps[: steps.index("Exchange")].count("SortAggregate") == 2
    assert {(r.url, r.added_lines, r.removed_lines) for r in found.collect()} == {(f"u{n}", 1, 1) for n in range(1, 30)}
