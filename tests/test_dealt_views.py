import os

import oracle
from pyspark.sql import functions as F

from leafmill.plans import views


def test_slim_rows_are_dealt_before_they_become_pages(spark):
    sf = os.path.join(oracle.TESTDATA, "sf0.01")
    dealt = views.run(spark, sf, "SELECT p_partkey FROM @part", dealt="part")
    assert dealt.filter("p_partkey >= 0").select(F.spark_partition_id()).distinct().count() == spark.sparkContext.defaultParallelism
    assert sorted(dealt.collect()) == sorted(views.run(spark, sf, "SELECT p_partkey FROM @part").collect())
