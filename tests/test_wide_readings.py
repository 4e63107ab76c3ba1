"""Two wide readings are merged as their rows would be, joined before their fields become rows."""

from ledgerloom.operators import validate as V


def test_wide_readings_merge_as_long_ones(spark):
    kind = "id string, net_premium string, stamp_duty string"
    first = spark.createDataFrame([("a", "1.00", "2"), ("b", None, "3"), ("c", "5", ""), ("d", "7", "8"), ("d", "7", "9"), (None, "1", "1")], kind)
    second = spark.createDataFrame([("a", "1,00", "2.5"), ("b", "4", None), ("c", "", ""), ("d", "7", "8"), ("e", "6", "6")], kind)
    fields = ["net_premium", "stamp_duty"]
    long = lambda df: df.unpivot("id", fields, "field", "value")
    rows = lambda df: sorted((str(r.id), r.field, r.value, r.status) for r in df.collect())
    wide = V.merge_wide_readings(first, second, ["id"], fields)
    assert rows(wide) == rows(V.merge_readings(long(first), long(second), ["id", "field"]))
    plan = wide._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")  # fields become rows after the join, not before
