"""Costly columns are made once a row, and what is read from names stays as it was."""

from pyspark.sql import functions as F

from ledgerloom.functions.filenames import scan_year, stem_of
from ledgerloom.functions.numbers import vin_check_digit_ok
from ledgerloom.operators import rules as RU
from ledgerloom.session import once


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_filter_does_not_copy_the_column_it_reads(spark):
    names = spark.createDataFrame([("1กข12 กธ.42.pdf",), ("a.pdf",), (None,)], "name string")
    year = scan_year(stem_of("name")).cast("long")
    keep = "year_be between 38 and 43"
    got = once(names, year_be=year).filter(keep)
    assert [r.year_be for r in got.collect()] == [42]
    assert plan_of(got).count("regexp_extract") < plan_of(names.select(year.alias("year_be")).filter(keep)).count("regexp_extract")


def test_the_kind_of_a_file_is_told_once(spark):
    want = {
        "ใบขับขี่ กธ.pdf": None, "A.XLS": None, "x PRB.pdf": "prb", "พ.ร.บ 42": "prb", "Endorsement 1": "endorsement", "สลักหลัง": "endorsement",
        "กธ.42": "main", "เอกสาร": "other", "plain": None, "": None,
    }
    df = spark.createDataFrame([(n,) for n in want], "name string").withColumn("kind", F.lit("plate"))
    assert {r.name: r.k for r in df.select("name", RU.file_kind("name").alias("k")).collect()} == want
    known = df.select("name", RU.file_kind("name", "kind").alias("k"))
    assert {r.name: r.k for r in known.collect()} == {n: k or "main" for n, k in want.items()}
    assert plan_of(known).lower().count("rlike") <= 5


def test_check_digits_need_no_arrays(spark):
    df = spark.createDataFrame([("1M8GDM9AXKP042788",), ("1M8GDM9A1KP042788",), ("11111111111111111",), ("short",), (None,)], "v string")
    got = df.select(vin_check_digit_ok("v").alias("ok"))
    assert [r.ok for r in got.collect()] == [True, False, True, False, False]
    assert "aggregate(" not in plan_of(got)


def test_stems_are_those_of_the_pattern(spark):
    names = ["a.pdf", ".pdf", "..pdf", "a", "", "a.", "a.b.c", "กธ.42.pdf", "a.b\n", "a\n.b", "a.b\nc", "\n.b", "a.b\r\n", None, "a. ", "x_0001 (a) b.pdf", "ก (ข", "_1234"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    pattern = F.regexp_replace("name", r"(?<=.)\.[^.]*$", "")
    rows = df.select("name", stem_of("name").alias("got"), pattern.alias("want")).collect()
    assert [(r.name, r.got) for r in rows] == [(r.name, r.want) for r in rows]
    assert any(r.got != r.name for r in rows)
