from test_state import _requests, _reuse

from leafmill.streaming import stateful


def test_keys_of_a_bucket_share_a_state(spark, tmp_path):
    """Files that arrive in time order, captures that expire between them, many keys in few buckets."""
    rows, df = _requests(spark)
    for ttl, lateness in ((60, "1 day"), (5, "1 second")):
        place = tmp_path / str(ttl)
        ordered = sorted(df.collect(), key=lambda r: (r.ts, r.event_id))
        for i in range(3):
            part = ordered[i * len(ordered) // 3 : (i + 1) * len(ordered) // 3]
            spark.createDataFrame(part, df.schema).coalesce(1).write.parquet(str(place / "in" / str(i)))
        source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(place / "in"))
        query = (
            stateful.stream_reuse(source, ttl, lateness, buckets=2).writeStream.format("memory").queryName(f"reuse_{ttl}")
            .option("checkpointLocation", str(place / "ck")).trigger(availableNow=True).start()
        )
        query.awaitTermination(300)
        assert query.exception() is None
        got = {r.event_id: (r.from_cache, r.stored_at) for r in spark.table(f"reuse_{ttl}").collect()}
        assert got == _reuse(rows, ttl)
        held = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
        assert held and max(held) <= 2
