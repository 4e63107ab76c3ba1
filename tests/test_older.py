"""The older schedule reader and the merge of two readings, on texts written by hand."""

from datetime import date
from decimal import Decimal

import pytest

from ledgerloom.operators import older as OL, validate as V

WHOLE = """กข 1234 กท
Policy Numhcr : do-70-41/000012
ผู้เอาประกันภัย: สมชาย ใจดี
Use: own
ที่อยู่ 12/34 ซอยสุขใจ กรุงเทพ 10500 อาชีพ ค้าขาย
Chassis No: MR0H#12345678
TOYOTA COROLLA CROSS COROLLA
ปีรถ : 2562
คุ้มครอง 1 ม.ค. 62 ถึง 01/01/2563
Net Premeium (Baht) 1'234.50
Stamp Due 5.00
ภาษี 7% 8o6.75
รวมเบี้ยประกันภัยทั้งสิ้น : 1,326.25
นายหน้า ชื่อ: สมศรี มีสุข
ใบอนุญาต : a1234567
company code: abc"""


def read(spark, rows):
    df = spark.createDataFrame(rows, "id int, text string, name string")
    return {r.id: r for r in OL.read_older_fields(df, filename="name").collect()}


def test_every_field_of_a_whole_text(spark):
    r = read(spark, [(1, WHOLE, None)])[1]
    assert (r.policy_number, r.company_code, r.insured_name) == ("D0-70-41/000012", "ABC", "สมชาย ใจดี")
    assert (r.insured_address, r.license_plate, r.chassis_no) == ("12/34 ซอยสุขใจ กรุงเทพ 10500", "กข 1234 กท", "MR0H12345678")
    assert (r.car_make, r.car_model, r.car_year) == ("TOYOTA", "COROLLA CROSS", 2019)
    assert (r.coverage_start, r.coverage_end) == (date(2019, 1, 1), date(2020, 1, 1))
    assert (r.net_premium, r.stamp_duty, r.vat, r.total_premium) == (Decimal("1234.50"), Decimal("5.00"), Decimal("806.75"), Decimal("1326.25"))
    assert (r.broker_name, r.broker_license) == ("สมศรี มีสุข", "a1234567")


RULES = [
    ("Policy No. ABC", "policy_number", None),  # short
    ("Policy No: PO/RT-12345", "policy_number", "P0//T-12345"),  # O and R as the scanner mistakes them
    ("x D0-21-s6/000c32 y", "policy_number", "D0-21-S6/000C32"),
    ("สมชาย  ใจดี  Insured Name", "insured_name", "สมชาย"),  # cut at two blanks
    ("คุณ สมชาย\nAddress x", "insured_name", "คุณ สมชาย"),
    ("Insured name: John Smith", "insured_name", None),
    ("12 ถนนยาว กรุงเทพ 10500 และ 10600 x", "insured_address", "12 ถนนยาว กรุงเทพ 10500 และ 10600"),
    ("12 แถวเดียว\nถนน 10500", "insured_address", None),  # not over a line's end
    ("address สีลม 99 บางรัก 10500 lthe x", "insured_address", "สีลม 99 บางรัก 10500"),
    ("1กข 1234", "license_plate", "1กข 1234"),
    ("กขค 1234", "license_plate", None),
    ("กข 123 MRH0012345 2559 x", "chassis_no", "MRH0012345"),
    ("MRH0012345678 2559 sedan 1999", "car_year", 2016),
    ("Model Yr 1980, 2031, 2005", "car_year", 2005),
    ("KIA SORENTO-X", "car_model", "SORENTO-X"),
    ("NETT 50.00 600,000.00 120.00", "net_premium", Decimal("120.00")),
    ("GRAND 150.00 1'250.75", "total_premium", Decimal("1250.75")),
    ("Total Premium 1,500.00", "total_premium", Decimal("1500.00")),
    ("VAT: 4o.50", "vat", None),  # the o stands before a point
    ("STAMP at 101.00", "stamp_duty", Decimal("101.00")),
    ("agent Some Insurance", "broker_name", None),
    ("", "policy_number", None),
    (None, "vat", None),
]


def test_single_rules(spark):
    got = read(spark, [(i, text, None) for i, (text, _, _) in enumerate(RULES)])
    assert [(text, field, getattr(got[i], field)) for i, (text, field, _) in enumerate(RULES)] == RULES


def test_file_name_goes_first_and_its_date_only_fills_a_gap(spark):
    got = read(spark, [(1, "คุณ สมชาย 1/2/2560", "CHADA KODWA 09.07.17.pdf"), (2, "คุณ สมชาย 1/2/2560 1/2/2561", "CHADA KODWA 09.07.17.pdf")])
    assert [(got[i].insured_name, got[i].coverage_end) for i in (1, 2)] == [("Chada Kodwa", date(2017, 7, 9)), ("Chada Kodwa", date(2018, 2, 1))]


def test_repeated_rows_no_rows_clashing_names_and_very_long_texts(spark):
    assert len(read(spark, [])) == 0
    df = spark.createDataFrame([(1, WHOLE, "x"), (1, WHOLE, "x")], "_row int, text string, policy_number string")
    with pytest.raises(ValueError, match="policy_number"):
        OL.read_older_fields(df)
    rows = OL.older_fields(df, "f").collect()
    assert [(r["_row"], r.policy_number, r.f.policy_number) for r in rows] == [(1, "x", "D0-70-41/000012")] * 2
    long = "7" * 60_000 + "\n" + "ก ข 12 " * 20_000 + "\n" * 20_000 + " " * 20_000 + "\nNET " + "1,000.25 " * 3_000 + "\n" + WHOLE
    assert read(spark, [(1, long, None)])[1].stamp_duty == Decimal("5.00")


def test_verified_reading(spark):
    first = spark.createDataFrame(
        [(1, "motor_main", None, "D0-1", "10", "1", "1", "12"), (2, "motor_prb", "X", "", "10", "1", "1", "15"), (3, "fire", "", "N", None, None, None, None)],
        "id int, doc_type string, policy_type string, policy_number string, net_premium string, stamp_duty string, vat string, total_premium string",
    )
    second = spark.createDataFrame([(1, "d0 1", "13"), (2, "Q", ""), (9, "Z", "1")], "id int, policy_number string, total_premium string")
    got = {r.id: r for r in V.verified_reading(first, second, "id", ["policy_number", "total_premium", "car_make"]).collect()}
    assert sorted(got) == [1, 2, 3]
    assert (got[1].policy_number, got[1].total_premium, got[1].policy_type, got[1].review_fields, len(got[1].warnings)) == ("d0 1", "13", "M", ["total_premium"], 1)
    assert (got[2].policy_number, got[2].total_premium, got[2].policy_type, got[2].review_fields, len(got[2].warnings)) == ("Q", "15", "X", [], 1)
    assert (got[3].policy_number, got[3].policy_type, got[3].review_fields, got[3].warnings) == ("N", None, [], [])
