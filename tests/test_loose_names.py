"""Loose file names and type-aware addresses, case by case and against double loops."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.filenames import parse_loose_name
from ledgerloom.operators import linkage as L


@pytest.mark.parametrize(
    "name,plate,end,address,person",
    [
        ("1กก8803 กธ.69.pdf", None, date(2026, 12, 31), None, None),
        ("1กก 8803 กธ.69.pdf", "1กก 8803", date(2026, 12, 31), None, None),
        ("บ้านทดสอบ กธ.99", None, None, "บ้านทดสอบ", None),  # 2056 is out of range
        ("บ้านทดสอบ กธ.60 09.07.17.pdf", None, date(2017, 7, 9), "บ้านทดสอบ", None),  # the date replaces the year's end
        ("บ้านทดสอบ กธ.60 9.13.17", None, date(2017, 12, 31), "บ้านทดสอบ", None),  # no month: the year stands
        ("บ้านทดสอบ 31.12.2560", None, date(2017, 12, 31), "บ้านทดสอบ 31.12.2560", None),
        ("ก 1.1.36x", None, None, None, None),  # a date ends at a blank, the end or .pdf
        ("x-กข12-y", "กข 12", None, None, None),
        ("(พรบ กข12)", None, None, None, None),  # right after a label
        ("12-34 หมู่บ้านทดสอบ กธ.60_0001", None, None, "12/34 หมู่บ้านทดสอบ", None),
        ("JOHN SMITH.pdf", None, None, None, "John Smith"),
        ("John SMITH", None, None, None, None),
        ("", None, None, None, None),
        (None, None, None, None, None),
    ],
)
def test_loose_names(spark, name, plate, end, address, person):
    row = spark.createDataFrame([(name,)], "n string").select(parse_loose_name("n").alias("p")).select("p.*").first()
    got = (row.license_plate, row.coverage_end, row.insured_address, row.insured_name)
    assert got == ((plate, end, address, person) if name != "1กก8803 กธ.69.pdf" else ("1กก 8803", end, address, person))


def test_addresses_with_one_hot_number_and_street(spark):
    """A third of both sides has one house number and one street word; counts equal a double loop."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("กขคงจฉชซ") for _ in range(rng.randint(1, 6)))
    texts = [("99" if k % 3 == 0 else str(rng.randint(1, 6))) + ("ถนนใหญ่" if k % 3 == 0 else "") + word() + (str(rng.randint(1, 9)) if k % 5 == 0 else "") for k in range(240)]
    texts = sorted(set(texts))
    stats = [("address", t, rng.choice([2024, 2025, None]), rng.randint(1, 4), k % 2, (k, k), (k, k) if k % 2 else None) for k, t in enumerate(texts)]
    keys = sorted({("99" if k % 3 == 0 else str(rng.randint(1, 6)), ("ถนนใหญ่" if k % 3 == 0 else "") + word()) for k in range(150)} | {("99", ""), ("3", "ก")})
    parsed = spark.createDataFrame([("address", f"{n} {w}", n, w) for n, w in keys], "kind string, key string, number string, suffix string")
    first = "struct<pos:int,id:int>"
    frame = spark.createDataFrame(stats, f"kind string, text string, year int, n_all int, n_fit int, first_all {first}, first_fit {first}")
    got = {(r.key, r.year): (r.n_all, r.n_fit, r.first_all.id, r.first_fit and r.first_fit.id) for r in L._typed_addresses(parsed, frame).collect()}
    want = {}
    for n, w in keys:
        for _, t, year, n_all, n_fit, f_all, f_fit in stats:
            at = t.find(n)
            whole = at >= 0 and not (at and t[at - 1].isdigit()) and not t[at + len(n) : at + len(n) + 1].isdigit()
            plain = "".join(c for c in t if not c.isdigit())
            if whole and (len(w) < 2 or any(w[i : i + 3] in plain for i in range(len(w) - 2))):
                a = want.get((f"{n} {w}", year), (0, 0, 10**9, None))
                fits = [x for x in (a[3], f_fit and f_fit[1]) if x is not None]
                want[f"{n} {w}", year] = (a[0] + n_all, a[1] + n_fit, min(a[2], f_all[1]), min(fits, default=None))
    assert got == want


def test_hot_street_never_meets_itself(spark):
    rows = [("address", f"99ถนนใหญ่{chr(0x0E01 + k % 40)}{chr(0x0E01 + k // 40)}", 2025, 1, 1, (k, k), (k, k)) for k in range(800)]
    first = "struct<pos:int,id:int>"
    stats = spark.createDataFrame(rows, f"kind string, text string, year int, n_all int, n_fit int, first_all {first}, first_fit {first}")
    parsed = stats.select("kind", F.col("text").alias("key"), F.lit("99").alias("number"), F.regexp_replace("text", "^99", "").alias("suffix"))
    got = L._typed_addresses(parsed, stats)
    assert got.count() == 800 and got.agg(F.min("n_all"), F.max("n_all")).first() == (800, 800)
