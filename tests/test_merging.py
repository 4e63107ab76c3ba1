"""Counts that must hold, second passes, and backups without a schema."""

import os

import pytest

from ledgerloom.operators import validate as V
from ledgerloom.sources import readers as RD, writers as WR


@pytest.mark.parametrize("rows,expected,good", [(3, 3, True), (3, 4, False), (0, 0, True), (0, 2, False)])
def test_a_total_that_is_off_writes_nothing(spark, tmp_path, rows, expected, good):
    df = spark.range(rows).selectExpr("id", "cast(id as string) AS name", "array(id) AS list")
    path = str(tmp_path / "out")
    if good:
        V.exactly(df, expected).write.parquet(path)
        assert sorted(map(tuple, spark.read.parquet(path).collect())) == sorted(map(tuple, df.collect()))
    else:
        with pytest.raises(Exception, match=f"expected {expected} rows, found {rows}"):
            V.exactly(df, expected).write.parquet(path)
        assert not os.path.exists(f"{path}/_SUCCESS") and not [f for f in (os.listdir(path) if os.path.exists(path) else []) if f.startswith("part-")]


def test_second_pass_fills_blanks_of_review_fields_only(spark):
    first = spark.createDataFrame([(1, "chassis_no", "", "candidate"), (1, "vat", "", "candidate"), (2, "chassis_no", "A", "candidate")], "id int, field string, value string, status string")
    more = spark.createDataFrame([(1, "chassis_no", "B"), (1, "vat", "7"), (2, "chassis_no", "C"), (3, "car_make", "X"), (3, "car_model", "")], "id int, field string, value string")
    got = {(r.id, r.field): (r.value, r.status) for r in V.supplemented(first, more, ["id"]).collect()}
    assert got == {(1, "chassis_no"): ("B", "review"), (1, "vat"): (None, "candidate"), (2, "chassis_no"): ("A", "candidate"), (3, "car_make"): ("X", "review")}


def test_tables_of_different_shape_come_back_without_a_schema(spark, tmp_path):
    one = spark.createDataFrame([(1, "ก", True, None), (2**40, None, False, [1, 2])], "z long, a string, yes boolean, list array<long>")
    two = spark.createDataFrame([("k", (5, "n"))], "k string, s struct<x:long,y:string>")
    path = str(tmp_path / "b")
    counts = {r["_table"]: r.rows for r in WR.write_backup({"one": one, "two": two, "none": two.limit(0)}, path).collect()}
    assert counts == {"one": 2, "two": 1}
    meta = RD.read_backup_meta(spark, path).first()
    assert meta.tables == ["none", "one", "two"] and meta.format_version == 1 and meta.backup_at
    for name, df in (("one", one), ("two", two)):
        back = RD.read_backup_inferred(spark, path, name)
        assert back.schema.simpleString() == df.schema.simpleString()
        assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert RD.read_backup_inferred(spark, path, "none").count() == 0
