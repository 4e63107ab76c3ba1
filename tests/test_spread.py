"""Costly work per row is dealt to several tasks a core, however few row groups a table has."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import roles as R

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("role", [R.schedules, R.older_schedules])
def test_documents_are_read_by_several_tasks(spark, role):
    rows = role(spark, SF).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(rows) >= 2 * spark.sparkContext.defaultParallelism
    assert sum(r["count"] for r in rows) == spark.read.parquet(f"{SF}/orders.parquet").count()
    assert max(r["count"] for r in rows) < sum(r["count"] for r in rows) / 4
