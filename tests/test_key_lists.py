"""A key has one list by year, a text one row, and a policy's facts are looked up per key and year: files meet one row each."""

import datetime as dt

import pytest

from ledgerloom.operators import linkage as L
from ledgerloom.plans import roles as R
from test_listed_files import rows_made

POLICY = "id long, pos long, policy_type string, license_plate string, insured_address string, insured_name string, coverage_start date"


def made(spark, rows):
    return spark.createDataFrame([(i, i, kind, plate, place, None, None if y is None else dt.date(y, 1, 1)) for i, kind, plate, place, y in rows], POLICY)


def names(spark, *stems):
    return spark.createDataFrame([(n,) for n in stems], "name string")


PLACES = ["1/5 ถนนสีลม", "11/5 ถนนสีลม", "1/50 ถนนสีลม", "1-5 ถนนสีลม เขต 1/5", "1/5 ซอยอารีย์", "5 ถนนสีลม", "12345678901234/56 ถนนสีลม", "ถนนสีลม", "21/57 ถนน5ก"]
KEYS = ["1-5 ถนนสีลม", "1/5ถนนสีลม", "5 ถนนสีลม", "1-5 ซอย", "1-5 ก", "12345678901234-56 ถนนสีลม", "34-5 ถนนสีลม", "7 ถนน5ก", "21-57 ถนน5ก"]


@pytest.mark.parametrize("whole", [False, True])
def test_addresses_equal_double_loops(spark, whole):
    """Numbers with either separator, long ones, short places and places with digits."""
    policies = made(spark, [(i, "FIRE", None, place, 2000) for i, place in enumerate(PLACES)])
    stems = [f"{k.replace('/', '-')} กธ.43.pdf" for k in KEYS]
    out = (L.link_nearest_year if whole else L.link_year_band)(names(spark, *stems), policies).collect()

    def inside(number, text):
        at = [i for i in range(len(text)) if text.startswith(number, i)]
        free = lambda i: not (i and text[i - 1].isdigit()) and not text[i + len(number) :][:1].isdigit()
        return any(free(i) for i in at) if whole else bool(at)

    for r in out:
        number, place = r.key.split(" ")
        assert (r.number, r.suffix) == (number, place)
        start = place[:5] if len(place) >= 3 else ""
        texts = [p.replace(" ", "") for p in PLACES]
        hits = [i for i, t in enumerate(texts) if start in t and any(inside(n, t) for n in {number, number.replace("-", "/")})]
        assert (r.matches, r.policy_id) == (len(hits), min(hits, default=None)), r


def test_years_are_no_rows(spark):
    """One plate with 60 years of policies and 60 of files: before, each year asked for was a row that met each year there is."""
    policies = made(spark, [(i, "M", "1กก 1", None, 1960 + i) for i in range(60)])
    files = names(spark, *[f"1กก1 กธ.{y:02d}.pdf" for y in range(3, 63)])
    out = L.link_year_band(files, policies)
    got = {r.year_be: (r.matches, r.policy_id) for r in out.collect()}
    assert max(rows_made(out._jdf.queryExecution().executedPlan())) <= 60
    for y in range(3, 63):
        hits = [i for i in range(60) if abs(1960 + i + 543 - 2500 - y) <= 1]
        assert got[2500 + y] == (len(hits), min(hits))


def test_ids_of_policies_without_year(spark):
    """Tied on the nearest year, as ``link_nearest_year`` counts them: nothing but a policy without a year is one match."""
    policies = made(spark, [(1, "M", "1กก 1", None, None), (2, "M", "2กก 2", None, 1999), (3, "M", "2กก 2", None, 2003), (3, "M", "2กก 2", None, 2003)])
    files = names(spark, "1กก1 กธ.40.pdf", "2กก2 กธ.44.pdf")
    assert sorted((r.key, r.id) for r in L.linked_ids(files, policies).collect()) == [("1กก1", 1), ("2กก2", 2), ("2กก2", 3)]
    assert sorted((r.key, r.id) for r in L.linked_ids(files, policies, 1).collect()) == [("1กก1", 1)]


def test_facts_of_the_chosen_policy(spark):
    policies = made(spark, [(1, "M", "1กก 1", None, 1999), (2, "P", "1กก 1", None, 2001), (3, "PA", "1กก 1", None, 2000)])
    told = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "policy_id long, fact string")
    files = names(spark, "1กก1 กธ.42.pdf", "1กก1 พรบ.44.pdf", "1กก1 กธ.43.pdf", "9กก9 กธ.42.pdf")
    out = L.link_typed(files, policies, told=told, counts=False)
    assert "candidates" not in out.columns
    assert {r.name: (r.policy_id, r.told and r.told.fact) for r in out.collect()} == {
        "1กก1 กธ.42.pdf": (1, "a"), "1กก1 พรบ.44.pdf": (2, "b"), "1กก1 กธ.43.pdf": (1, "a"), "9กก9 กธ.42.pdf": (None, None),
    }
    any_type = {r.name: (r.policy_id, r.told and r.told.fact, r.candidates) for r in L.link_typed(files, policies, strict_type=False, told=told).collect()}
    assert any_type["1กก1 กธ.43.pdf"] == (1, "a", 3)
    with pytest.raises(ValueError):
        L.typed_answers(files, policies, strict_type=False, counts=False)


def test_parts_make_the_paths(spark):
    sf = "/root/testdata/sf0.001"
    want = R.files(spark, sf).select("path", "name")
    got = R.files_in_parts(spark, sf).select(R.path_of_parts().alias("path"), "name")
    assert want.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty()
