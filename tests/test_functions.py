"""Scalar rules, with the places where they are easy to get wrong."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import dates as D, filenames as N, numbers as NU, text as X
from ledgerloom.operators import extract as E, rules as RU, validate as V


def values(spark, rows, column):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v string")
    return [r.out for r in df.select("i", column(F.col("v")).alias("out")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "profile,cases",
    [
        (D.date_web_form, {"2569-07-03": date(2026, 7, 3), "3/7/69": date(2069, 7, 3), "3/7/2569": date(2026, 7, 3), "1/99/2569": None, "": None}),
        (D.date_document, {"3/7/69": date(2026, 7, 3), "3/7/26": date(2026, 7, 3), "3กรกฎาคม2569": date(2026, 7, 3), "๓ ก.ค. ๒๕๖๙": date(2026, 7, 3), "30/2/2569": None}),
        (D.date_export, {"2026-07-03 00:00:00": date(2026, 7, 3), "3/7/2569": date(2026, 7, 3), "3/7/2401": None, "x": None}),
    ],
)
def test_date_profiles(spark, profile, cases):
    assert values(spark, list(cases), profile) == list(cases.values())


def test_dates_in_text_keep_order_and_era(spark):
    got = values(spark, ["end 1/2/2569 start 5 ม.ค. 68 then 3 March 25 and 1/2/2569"], D.dates_in_text)
    assert got == [[date(2026, 2, 1), date(2025, 1, 5), date(2025, 3, 3)]]


def test_keys(spark):
    assert values(spark, ["1กก 1234", None], X.plate_key) == ["1กก1234", ""]
    assert values(spark, ["1กก-1234"], lambda c: X.plate_key(c, drop_hyphen=True)) == ["1กก1234"]
    assert values(spark, ["บริษัท ตัวอย่าง", "ก นางสาว ข"], X.name_key) == ["ตัวอย่าง", "กข"]
    assert values(spark, ["นางสาว ตัวอย่าง", "x นาย"], X.name_key_anchored) == ["ตัวอย่าง", "xนาย"]
    assert values(spark, ["12/3 ถ.สีลม ม.4"], X.address_key) == ["123ถนนสีลมหมู่4"]
    assert values(spark, ["12/3 ถ.สีลม ม.4"], X.address_words_key) == ["ถนนสีลมหมู่"]


def test_numbers(spark):
    assert values(spark, ["๑,๒๓๔.๕๐", "null", ""], NU.to_decimal) == [Decimal("1234.50"), None, None]
    assert values(spark, ["12.7", "x"], NU.to_int_via_double) == [12, None]
    assert values(spark, ["0", "5", "-1"], NU.legacy_int) == [None, 5, None]
    assert values(spark, ["1M8GDM9AXKP042788", "1M8GDM9A1KP042788", "short", None], NU.vin_check_digit_ok) == [True, False, False, False]
    assert values(spark, ["12345678901234", "D0-70-69/1", "x" * 31], NU.plausible_policy_number) == [None, "D0-70-69/1", None]


def test_whole_number_needs_no_digit_beside_it(spark):
    df = spark.createDataFrame([("12", "120 12a"), ("12", "120 312"), ("12/3", "5/12/3x"), ("", "1")], "n string, t string")
    assert [r[0] for r in df.select(X.whole_number_in("n", "t")).collect()] == [True, False, True, False]


@pytest.mark.parametrize(
    "name,expected",
    [
        ("1กก1234 กธ.67.pdf", ("plate", "1กก1234", 2567)),
        ("1กก 1234พรบ.68_0001.pdf", ("plate", "1กก1234", 2568)),
        ("816814 พรบ.66.pdf", ("plate", "816814", 2566)),
        ("12-3ถนนสีลม กธ.67.pdf", ("address", "12-3 ถนนสีลม", 2567)),
        ("สมชายใจดี PA.67.pdf", ("name", "สมชายใจดี", 2567)),
        ("สมชายใจดี (สำเนา).pdf", ("name", "สมชายใจดี", None)),
        ("ABC.pdf", ("unknown", "ABC", None)),
    ],
)
def test_archive_names(spark, name, expected):
    df = spark.createDataFrame([(name,)], "name string")
    row = N.with_archive_name(df).first()
    assert (row.kind, row.key, row.year_be) == expected


@pytest.mark.parametrize(
    "row,expected",
    [
        (("1กก 1234", "main", "2026-09-10", None, None, None), "1กก1234-กธ-2569.pdf"),
        (("1กก1234", "main", "10/09/2569", "P", None, None), "1กก1234-พรบ.-2569.pdf"),
        (("1กก1234", "prb", "10/09/2569", "M", None, None), "1กก1234-พรบ.-2569.pdf"),
        (("1กก1234", "main", "2026-02-30", None, None, None), "รอตรวจข้อมูล.pdf"),
        (("1กก1234", "main", None, None, None, None), "รอตรวจข้อมูล.pdf"),
        (("1กก1234", "main", "69", None, None, None), "รอตรวจข้อมูล.pdf"),
        ((None, "main", None, "FIRE", None, None), "รอตรวจข้อมูล.pdf"),
        ((None, "main", None, "FIRE", "12/3 บางนา", None), "12-3 บางนา.pdf"),
        ((None, "main", None, "PA", None, "นาย ตัวอย่าง"), "นาย ตัวอย่าง.pdf"),
        (("1กก1", "endorsement", "2026-09-10", "M", None, None), "1กก1-กธ-2569-สลักหลัง.pdf"),
    ],
)
def test_display_names(spark, row, expected):
    df = spark.createDataFrame([row], "p string, d string, s string, t string, r string, n string")
    assert df.select(N.display_name("p", "d", "s", "t", "r", "n")).first()[0] == expected


def test_storage_keys_are_decoded_once(spark):
    base = "https://cdn.example"
    got = values(spark, [f"{base}/a%20b+c.pdf?x=1", "https://other.example/q/w.pdf#top"], lambda c: N.storage_key(c, base))
    assert got == ["a b+c.pdf", "q/w.pdf"]


def test_premium_ledger(spark):
    schema = (
        "net_premium decimal(18,2), stamp_duty decimal(18,2), vat decimal(18,2), total_premium decimal(18,2), prepaid_tax_1pct decimal(18,2), "
        "commission_pct decimal(9,4), commission_baht decimal(18,2), wht_10pct decimal(18,2), rounding decimal(18,2), paired_prb_total decimal(18,2)"
    )
    d = Decimal
    rows = [
        (d("1000.00"), d("4.00"), d("70.28"), d("1074.28"), d("10.00"), d("10"), None, None, d("0"), d("200.00")),
        (d("100"), d("1"), d("7.07"), d("200"), None, None, None, None, None, None),
    ]
    good, bad = V.premium_ledger(spark.createDataFrame(rows, schema)).collect()
    assert (good.commission_baht, good.wht_10pct, good.collected_amount, good.rejected) == (d("100.00"), d("10.00"), d("1174.28"), False)
    assert bad.rejected


def test_consensus(spark):
    cases = [
        ("net_premium", ["1,000.00", "1,000.00"], 96, "candidate"),
        ("net_premium", ["1,000.00", "7,000.00"], 96, "review"),
        ("net_premium", ["1.000.00", "1.000.00"], 96, "review"),
        ("net_premium", ["1,000.00"], 96, "review"),
        ("policy_number", ["-D0-70-69/123456", "DO-70-69/123456"], 95, "candidate"),
        ("policy_number", ["D0-70-69/123456", "D0-70-69/123456"], 90, "review"),
        ("insured_name", ["บริษัท", "บริษัท"], 100, "review"),
        ("coverage_start", ["3 ก ร ก ฎา ค ม 2569", "3/7/2569"], 70, "candidate"),
    ]
    rows = [(i, f, n, t, conf) for i, (f, texts, conf, _) in enumerate(cases) for n, t in enumerate(texts)]
    reads = spark.createDataFrame(rows, "doc int, field string, read_no int, text string, min_confidence int")
    reads = reads.withColumn("norm", V.normal_read(F.col("field"), F.col("text")))
    got = {r.doc: r.status for r in V.consensus(reads, ["doc"], F.col("field"), "norm").collect()}
    assert [got[i] for i in range(len(cases))] == [c[3] for c in cases]


def test_atomic_groups(spark):
    d, day = Decimal, date
    schema = "net_premium decimal(18,2), stamp_duty decimal(18,2), vat decimal(18,2), total_premium decimal(18,2), coverage_start date, coverage_end date"
    rows = [
        (d("1000"), d("4"), d("70.28"), d("1074.28"), day(2026, 7, 3), day(2027, 7, 3)),
        (d("1000"), None, d("70.28"), d("1074.28"), day(2026, 7, 3), day(2026, 7, 3)),
        (d("1000"), d("4"), d("70.28"), d("1074.30"), day(2026, 7, 3), day(2028, 7, 3)),
    ]
    got = V.atomic_groups(spark.createDataFrame(rows, schema)).collect()
    assert [(r.net_premium is not None, r.coverage_end is not None) for r in got] == [(True, True), (False, False), (False, False)]


def test_two_readers(spark):
    first = spark.createDataFrame([("1", "name", "A-B"), ("1", "plate", "x"), ("1", "vin", "v")], "doc string, field string, value string")
    second = spark.createDataFrame([("1", "name", "ab"), ("1", "plate", "y"), ("1", "vin", "")], "doc string, field string, value string")
    got = {r.field: (r.value, r.status) for r in V.merge_readings(first, second, ["doc", "field"]).collect()}
    assert got == {"name": ("ab", "candidate"), "plate": ("y", "review"), "vin": ("v", "kept")}


def test_noisy_notice(spark):
    text = (
        "RENEWAL NOTICE\nPolicy No. heading only\n00-70-69 ! 0 1 2 3 4 5\nperiod of insurance\n9/4/2569 to 9/4/2570\n"
        "MRHGM2620C P400001\nHONDA CITY 1.5\nYEAR\n2018\nNet Premium\n1,000.00\n"
    )
    row = E.read_fields(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert row.doc_type == "renewal_notice" and row.policy_number == "D0-70-69/012345"
    assert (row.coverage_start, row.coverage_end) == (date(2026, 4, 9), date(2027, 4, 9))
    assert (row.chassis_no, row.car_make, row.car_model, row.car_year) == ("MRHGM2620CP400001", "HONDA", "CITY 1.5", 2018)
    assert row.net_premium == Decimal("1000.00")


def test_heading_is_not_a_number(spark):
    assert values(spark, ["Policy Number: EXPIRY DATE 2569"], E.policy_numbers) == [[]]


@pytest.mark.parametrize(
    "facts,expected",
    [
        ({"given": "motor_main", "number": "D0-72-69/1"}, "motor_prb"),
        ({"given": "motor_main", "number": "D0-70-68/1", "title": "หนังสือแจ้งเตือนต่ออายุกรมธรรม์"}, "renewal_notice"),
        ({"title": "Personal Accident Policy"}, "other_policy"),
        ({"filename": "1กก1 พ.ร.บ.69.pdf"}, "motor_prb"),
        ({"filename": "1กก1 กธ.69.pdf"}, "motor_main"),
        ({"given": "unknown"}, "unknown"),
    ],
)
def test_document_class(spark, facts, expected):
    cols = [F.lit(facts.get(k)).cast("string") for k in ("title", "raw", "ptype", "number", "given", "filename")]
    assert spark.range(1).select(RU.document_class(*cols)).first()[0] == expected


def test_model_follows_the_chosen_make(spark):
    text = "HONDA CITY\nTOYOTA ALTIS 1.8\nMODEL x"
    row = E.read_fields(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert (row.car_make, row.car_model) == ("TOYOTA", "ALTIS 1.8")


def test_vin_runs_beside_other_signs(spark):
    vin = "MRHGM2640JP012345"
    cases = [f"_{vin}_", f"เลข{vin}ตัว", f"x {vin}.", f"Z{vin}Z9"]
    got = values(spark, cases, E.vin_candidates)
    assert got == [[vin], [vin], [vin], []]


def test_merge_warnings(spark):
    rows = [("d", "net_premium", "100.00", "candidate"), ("d", "stamp_duty", "1.00", "review"), ("d", "vat", "7.00", "kept"), ("d", "total_premium", "110.00", "review"), ("e", "net_premium", "1.00", "kept")]
    df = spark.createDataFrame(rows, "doc_id string, field string, value string, status string")
    got = {r.doc_id: (r.review_fields, len(r.warnings)) for r in V.merge_warnings(df, ["doc_id"]).collect()}
    assert got == {"d": (["stamp_duty", "total_premium"], 3), "e": ([], 0)}
