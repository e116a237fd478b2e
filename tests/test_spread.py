"""Costly text is made in many tasks, also of a table that is one task."""

from pyspark.sql import functions as F

from jobsieve.session import spread


def test_narrow_rows_are_dealt_out_unasked(spark):
    asked = spark.conf.get("jobsieve.spread")
    one = spark.range(1000).coalesce(1)
    spark.conf.unset("jobsieve.spread")
    try:
        parts = spread(one, narrow=True).select(F.spark_partition_id().alias("p"), "id")
        assert parts.select(F.count_distinct("p"), F.count_distinct("id")).first() == (4, 1000)
        assert spread(one).select(F.spark_partition_id().alias("p")).distinct().count() == 1
    finally:
        spark.conf.set("jobsieve.spread", asked)
