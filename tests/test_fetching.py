import random

from pyspark.sql import functions as F

from leafmill.operators import attempts, fetching, places
from leafmill.operators.fetching import late_fetch


def test_winners_meet_their_wide_rows_and_few_others_move(spark, monkeypatch):
    wide = spark.range(20_000).select(F.col("id").alias("k"), F.when(F.col("id") % 7 != 0, F.col("id") % 3).alias("a"), F.concat(F.lit("body "), F.col("id")).alias("body"))
    winners = wide.filter("k % 50 = 0").select("k", "a", F.lit("won").alias("why"))
    want = {(k, None if k % 7 == 0 else k % 3, "won", f"body {k}") for k in range(0, 20_000, 50)}
    assert {tuple(r) for r in late_fetch(winners, wide, ["k", "a"]).collect()} == want
    moved = []
    plain = fetching._joined
    monkeypatch.setattr(fetching, "_joined", lambda w, rows, keys: (moved.append(rows.count()), plain(w, rows, keys))[1])
    late_fetch(winners, wide, ["k", "a"]).count()
    assert 400 <= moved[0] < 400 + 20_000 / 16
    monkeypatch.setattr(fetching, "FILTER_ROWS", 10)
    assert {tuple(r) for r in late_fetch(winners, wide, ["k", "a"]).collect()} == want
    assert late_fetch(winners.limit(0), wide, ["k", "a"]).count() == 0


def test_no_body_is_aggregated(spark):
    rows = [(r, a, f"h{a}", 503 if (r + a) % 3 else 200, None if a % 5 == 0 else '{"n": %d}' % a) for r in range(30) for a in range(1, 5)]
    df = spark.createDataFrame([*rows, *rows[:9]], "request_id int, attempt int, host string, status_code int, body string")
    good, bad = attempts.first_usable_response(df)
    want = {}
    for r, a, host, status, body in sorted(rows):
        if status == 200 and body and r not in want:
            want[r] = (host, body)
    assert {r["request_id"]: (r["host"], r["body"]) for r in good.collect()} == want
    assert {r["request_id"] for r in bad.collect()} == set(range(30)) - set(want)
    plan = good._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate" in line and "body" in line]


def test_a_city_with_a_third_of_all_places_is_dealt_to_all_tasks(spark, monkeypatch):
    rng = random.Random(3)
    spots = [(k, 10.0 + (k % 2) * 1e-4, 20.0) if k % 3 == 0 else (k, rng.uniform(-60, 60), rng.uniform(-180, 180)) for k in range(6_000)]
    df = spark.createDataFrame(
        [("node", k, f"n{k}" if k % 9 else "", lat, lon, {"amenity": "cafe", **{f"x{i}": "y" for i in range(20)}}) for k, lat, lon in spots],
        "osm_type string, osm_id long, name string, lat double, lon double, tags map<string,string>",
    )
    centres = spark.createDataFrame([("q1", "amenity", "cafe", 10.0, 20.0), ("q2", "amenity", "cafe", -45.0, 0.0), ("q3", "shop", "toys", 10.0, 20.0)], "query string, tag_key string, tag_value string, lat double, lon double")
    found = places.nearby_places(centres, df, radius_m=2_000)
    assert {(r["query"], r["osm_id"]) for r in found.collect()} >= {("q1", k) for k in range(0, 6_000, 3) if k % 9}
    for name, value in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(name, value)
    found = places.nearby_places(centres, df, radius_m=2_000)
    sizes = sorted(r["n"] for r in found.filter("query = 'q1'").groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect())
    for name in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
        spark.conf.unset(name)
    assert len(sizes) >= 5 and sizes[-1] < 3 * sizes[len(sizes) // 2]
    monkeypatch.setattr(places, "FEW_TAGS", 1)
    assert places.nearby_places(centres, df, radius_m=2_000).count() == found.count()
