"""Rows without a key find nothing, so they need not meet in one task."""

from pyspark.sql import functions as F

from ledgerloom.operators import reconcile as RC


def test_rows_without_key_are_dealt_over_tasks(spark):
    rows = spark.range(0, 4000, 1, 8).select("id", F.when(F.col("id") % 100 == 0, F.col("id").cast("string")).alias("k"))
    side = spark.range(0, 4000, 50).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("n"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = RC._looked_up(rows, side.hint("merge"), ["k"])
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(sizes) < 3 * 4000 / int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert out.count() == 4000 and out.filter("n = 1").count() == 40 and out.columns == ["k", "id", "n"]
