"""Files of a text are one list; a policy chooses inside its row, so policies and files of one text are never listed pair by pair."""

import datetime as dt

import pytest

from ledgerloom.operators import linkage as L

PLACE = "12/3 ถนนสีลม เขต 5"


def rows_made(node) -> list[int]:
    """Rows out of every operator of an executed plan."""
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return rows_made(node.executedPlan())
    if name.endswith("QueryStageExec"):
        return rows_made(node.plan())
    metric = node.metrics().get("numOutputRows")
    out = [metric.get().value()] if metric.isDefined() else []
    for at in range(node.children().size()):
        out += rows_made(node.children().apply(at))
    return out


def data(spark):
    people = [(i, "FIRE", None, PLACE, "นาย ก", dt.date(1970 + i % 50, 1, 1)) for i in range(400)]
    people += [(400 + i, "MP"[i % 2], "1กข 123", None, None, dt.date(1970 + i % 50, 1, 1)) for i in range(400)]
    people += [(900, "FIRE", None, PLACE, None, None), (901, None, None, None, None, None), (902, "PA", "", "", "", dt.date(2000, 1, 1)), (903, "M", None, PLACE, None, dt.date(2000, 1, 1))]
    policies = spark.createDataFrame(
        [(i, k, p, a, n, d, d) for i, k, p, a, n, d in people], "id long, policy_type string, license_plate string, address string, person string, coverage_start date, coverage_end date"
    )
    stems = ["12-3ถนนสีลม", "1กข123"]
    names = [f"{s} {label}.{year:02d}.pdf" for s in stems for label in ("กธ", "พรบ") for year in range(0, 100, 2)]
    return policies, spark.createDataFrame([(n,) for n in [*names, *names]], "name string")


@pytest.mark.parametrize("operator", [L.file_by_prefix_key, L.file_strict_cascade])
def test_one_text_with_many_policies_and_files(spark, operator):
    policies, files = data(spark)
    out = operator(policies, files)
    got = {r.id: r.file for r in out.collect()}
    assert len(got) == policies.count()
    assert max(rows_made(out._jdf.queryExecution().executedPlan())) < 2 * len(got)

    def best(stem, compulsory, year):
        label = "พรบ" if compulsory else "กธ"
        return f"{stem} {label}.{year if year is not None and year % 2 == 0 else 0:02d}.pdf"

    year = lambda i: (1970 + i % 50 + 543) % 100
    for i in range(400):
        assert got[i] == best("12-3ถนนสีลม", False, year(i))
        want = best("1กข123", i % 2, year(400 + i)) if operator is L.file_strict_cascade else None
        assert got[400 + i] == want
    assert got[900] == "12-3ถนนสีลม กธ.00.pdf" and got[901] is None and got[902] is None
    assert got[903] == (None if operator is L.file_strict_cascade else best("12-3ถนนสีลม", False, (2000 + 543) % 100))
