import os

import __spark_entry__ as entry
import oracle


def test_the_radius_search_has_a_query_without_limit(spark):
    sf_dir = os.path.join(oracle.TESTDATA, "sf0.01")
    rows = entry.queries()["all_nearby_places"](spark, sf_dir)
    assert {r[0] for r in rows.select("amenity").distinct().collect()} == {"dentist", "cafe", "pub"}
    assert rows.groupBy("query", "amenity").count().agg({"count": "max"}).first()[0] > 20
    oracle.compare(spark, sf_dir, "all_nearby_places", entry.queries()["all_nearby_places"], entry.oracle_sql()["all_nearby_places"])
