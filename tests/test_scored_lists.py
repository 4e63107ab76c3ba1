"""Scored tiers are looked up in lists per key: rows made are the answers, not a row per probe and candidate."""

import datetime

from ledgerloom.operators import linkage as L

POLICIES = "id int, policy_type string, license_plate string, address string, person string, coverage_start date, coverage_end date"


def test_answers_come_out_of_lists(spark):
    end = datetime.date(2017, 6, 1)  # 60 in the names
    files = [(f"1กข1234 กธ.{y}.pdf",) for y in range(50, 66)] + [("1กข12 กธ.60.pdf",), ("สมบูรณ์ดี กธ.60.pdf",), ("สมบูรณ์ดีมาก กธ.61.pdf",)]
    rows = [(i, "M", "1กข 1234", None, f"นาย ไม่รู้จัก{i}", None, end) for i in range(50)]
    rows += [(100, "M", "9ฮฮ 1", "", "นาย สมบูรณ์ดีมาก", None, end), (101, "PA", None, None, None, None, None)]
    out = L.scored_files(spark.createDataFrame(rows, POLICIES), spark.createDataFrame(files, "name string"))
    assert "Window" not in out._jdf.queryExecution().toString()
    got = {}
    for r in out.orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append((r["confidence"], r["rank"], r["file"], r["score"], r["reason"]))
    # a fitting year lifts no score over 100, so names decide
    top = [("HIGH", 1, "1กข12 กธ.60.pdf", 100, "plate-prefix+year"), *[("HIGH", k, f"1กข1234 กธ.{48 + k}.pdf", 100, "plate-exact") for k in (2, 3)]]
    for i in range(50):
        assert got[i] == top
    assert [r[2:] for r in got[100]] == [("สมบูรณ์ดี กธ.60.pdf", 80, "name+year"), ("สมบูรณ์ดีมาก กธ.61.pdf", 60, "name")]
    assert got[101] == [("NONE", None, None, None, None)]
