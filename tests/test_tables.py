"""Filters, windows, linkage, changes, sources and streams on small fixtures."""

import itertools
import json
import os
import random
import tempfile
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators import aggregates as A, changes as C, filters as FL, legacy as LG, linkage as L, windows as WN
from ledgerloom.schemas import LEGACY_COLUMNS
from ledgerloom.sources import readers as RD, writers as WR
from ledgerloom.streaming import intake as IN

TODAY = date(2026, 7, 1)


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_status_bounds_differ_between_list_and_counter(spark):
    ends = [TODAY + timedelta(days=n) for n in (-1, 0, 30, 31)]
    df = spark.createDataFrame([(i, e) for i, e in enumerate(ends)], "id int, coverage_end date")
    listed = {s: FL.coverage_status(df, s, TODAY).count() for s in ("active", "expiring", "expired")}
    assert listed == {"active": 2, "expiring": 2, "expired": 1}
    counted = A.status_counters(df, TODAY).first()
    assert (counted.total, counted.active, counted.expiring) == (4, 2, 1)


def test_filters_refuse_and_escape(spark):
    df = spark.createDataFrame([("100%",), ("100x",)], "insured_name string")
    assert df.filter(FL.containing("insured_name", "0%")).count() == 1
    with pytest.raises(ValueError):
        FL.where_any(df, ("insured_name", "between", 1))


def test_search_ignores_blanks_and_hyphens(spark):
    rows = [(p, "n", "x") for p in ("1กก 1234", "1กก-1234", "1กก1234", None)]
    df = spark.createDataFrame(rows, "license_plate string, insured_name string, policy_number string")
    assert FL.search(df, "1กก - 1234").count() == 3


def test_latest_per_customer(spark):
    rows = [(1, " Ann ", "2024-01-01", "u"), (2, "ann", "2025-01-01", None), (3, "ANN", "2023-01-01", "u"), (4, " ", "2025-01-01", None), (5, None, "2025-01-01", None)]
    df = spark.createDataFrame(rows, "id int, insured_name string, coverage_start string, pdf_url string").withColumns(
        {c: F.lit(None).cast(t) for c, t in (("coverage_end", "string"), ("created_at", "string"), ("pdf_filename", "string"), ("pdf_size", "int"))}
    )
    got = sorted((r.id, r.history_count) for r in A.latest_per_customer(df, ["id"]).collect())
    assert got == [(2, 2), (4, 0), (5, 0)]


def test_blank_numbers_are_never_duplicates(spark):
    rows = [("f0", 0, "N1", "m", 10), ("f1", 1, "", "m", 10), ("f2", 2, "", "m", 10), ("f3", 3, "N1", "m", 10), ("f4", 4, "N1", "p", 10)]
    df = spark.createDataFrame(rows, "file_id string, pos int, number string, cls string, total int")
    got = {r.file_id: r.duplicate_of for r in WN.mark_duplicates(df, "number", "cls", "total", "pos", "file_id").collect()}
    assert got == {"f0": None, "f1": None, "f2": None, "f3": "f0", "f4": None}


def test_positions_do_not_depend_on_partitions(spark):
    rows = [(random.Random(i).choice("aab"), i) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(7)
    want = {}
    seen = {}
    for k, v in sorted(rows, key=lambda r: r[1]):
        seen[k] = seen.get(k, 0) + 1
        want[v] = seen[k]
    assert {r.v: r.position for r in WN.keyed_positions(df, ["k"], ["v"]).collect()} == want
    assert [r.position for r in WN.global_positions(df, ["v"]).orderBy("v").collect()] == list(range(1, 201))


def test_containment_equals_the_double_loop(spark):
    rng = random.Random(3)
    word = lambda a, b: "".join(rng.choice("ab1") for _ in range(rng.randint(a, b)))
    keys, texts = sorted({word(1, 12) for _ in range(80)}), sorted({word(1, 25) for _ in range(80)})
    k = spark.createDataFrame([(w,) for w in keys], "key string")
    t = spark.createDataFrame([(w,) for w in texts], "text string")
    got = {tuple(r) for r in L.contained_either_way(k, t).select("key", "text").collect()}
    assert got == {(a, b) for a, b in itertools.product(keys, texts) if a in b or b in a}


def test_common_run_equals_brute_force(spark):
    rng = random.Random(4)
    pairs = [("".join(rng.choice("abc") for _ in range(rng.randint(0, 6))), "".join(rng.choice("abc") for _ in range(rng.randint(0, 6)))) for _ in range(200)]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").coalesce(1).select(X.shares_run("a", "b")).collect()]
    assert got == [any(a[i : i + 3] in b for i in range(len(a) - 2)) for a, b in pairs]


def test_type_aware_link(spark):
    policies = spark.createDataFrame(
        [
            (1, 1, "M", "1กก 1234 กท", None, None, "2024-05-01"), (2, 2, "M", "1กก1234", None, None, "2025-05-01"), (3, 3, "FIRE", None, "12/3 ถ.สีลม", None, "2024-01-01"),
            (4, 4, "FIRE", None, "112/3 ถ.สีลม", None, "2024-01-01"), (5, 5, "PA", None, None, "นาย สมชาย ใจดี", None), (6, 6, "M", None, None, "x", "2024-01-01"),
            (7, 7, "FIRE", "2ขข99", None, None, "2024-01-01"),
        ],
        "id int, pos int, policy_type string, license_plate string, insured_address string, insured_name string, coverage_start string",
    )
    names = ["1กก1234 กธ.68.pdf", "1กก1234 กธ.60.pdf", "12-3ถนนสีลม กธ.67.pdf", "สมชายใจดี PA.67.pdf", "2ขข99 กธ.67.pdf", "zzz.pdf"]
    files = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r.name: (r.policy_id, r.strategy, r.candidates) for r in L.link_typed(files, policies).collect()}
    assert got == {
        names[0]: (2, "type-match", 2),
        names[1]: (1, "type-match", 2),
        names[2]: (3, "type-match", 1),
        names[3]: (5, "type-match", 1),
        names[4]: (None, "no-match", 1),
        names[5]: (None, "no-match", 0),
    }
    loose = {r.name: (r.policy_id, r.strategy) for r in L.link_typed(files, policies, strict_type=False, strict_year=True).collect()}
    assert loose[names[4]] == (7, "fallback") and loose[names[1]] == (None, "no-match-year")


def test_upsert_twice_changes_nothing(spark):
    table = spark.createDataFrame([("a", True, 1), ("b", False, 2)], "k string, manually_edited boolean, v int")
    news = spark.createDataFrame([("a", 9, 1), ("b", 8, 1), ("b", 7, 2), ("c", 6, 1), (None, 5, 1)], "k string, v int, pos int")
    plan = C.protected_upsert(table, news, "k", "pos")
    assert {r.action: r.rows for r in C.action_counts(plan).collect()} == {"protected": 1, "update": 1, "insert": 1, "failed": 1}
    once = C.apply_upsert(table, plan, "k")
    assert sorted((r.k, r.v) for r in once.collect()) == [("a", 1), ("b", 7), ("c", 6)]
    twice = C.apply_upsert(once, C.protected_upsert(once, news, "k", "pos"), "k")
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))


def test_corrections_are_all_or_nothing(spark):
    table = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    good = spark.createDataFrame([("a", 5)], "k string, new_value int")
    bad = spark.createDataFrame([("a", 5), ("z", 6)], "k string, new_value int")
    assert sorted(map(tuple, C.exact_corrections(table, good, "k", "v")[1].collect())) == [("a", 5), ("b", 2)]
    report, after = C.exact_corrections(table, bad, "k", "v")
    assert sorted(map(tuple, after.collect())) == [("a", 1), ("b", 2)] and {r.hits for r in report.collect()} == {0, 1}
    with pytest.raises(ValueError):
        C.update_rows(table, None, v=F.lit(1))


def legacy_row(**values):
    return [values.get(c, "") for c in LEGACY_COLUMNS]


def test_legacy_files(spark, folder):
    rows = [legacy_row(app="1", policy="P1", namethai="ก,\"ข\"", datestart="3/7/2569", netpremium="0", kpp=""), legacy_row(app="2"), legacy_row(policy=" ")]
    import csv

    for name, encoding in (("a.csv", "utf-16"), ("b.csv", "utf-8-sig")):
        with open(os.path.join(folder, name), "w", encoding=encoding, newline="") as f:
            csv.writer(f).writerows([LEGACY_COLUMNS, *rows])
    one = LG.map_rows(RD.read_legacy_utf16(spark, f"{folder}/a.csv"), "csv").collect()
    assert [(r.policy_number, r.insured_name, r.coverage_start, r.net_premium) for r in one] == [("P1", 'ก,"ข"', date(2026, 7, 3), None)]
    two = LG.map_rows(RD.read_legacy_bom(spark, f"{folder}/b.csv"), "database").orderBy("app_number").collect()
    assert [(r.app_number, r.policy_number, r.net_premium) for r in two] == [("1", "P1", 0.0), ("2", None, None)]


def test_listing_hash_review_and_manifest(spark, folder):
    os.makedirs(f"{folder}/sub")
    for path, content in (("a.pdf", b"x"), ("sub/b c.pdf", b"x"), ("c.jpg", b"y")):
        with open(os.path.join(folder, path), "wb") as f:
            f.write(content)
    assert sorted((r["name"], r["length"]) for r in RD.list_files(spark, folder).collect()) == [("a.pdf", 1), ("b c.pdf", 1)]
    assert RD.hash_files(spark, folder).select("sha256").distinct().count() == 1
    with open(f"{folder}/review.json", "w") as f:
        json.dump({"records": {"x.pdf": {"parsed": {"policy_number": "N", "raw_text": "t"}}, "y.pdf": {"parsed": None}}}, f)
    got = [(r.position, r.filename, r.doc_type, r.policy_number, r.text) for r in RD.read_review(spark, f"{folder}/review.json").orderBy("position").collect()]
    assert got == [(0, "x.pdf", "unknown", "N", "t"), (1, "y.pdf", "unknown", None, "")]
    pair = dict(pair_id="1", main_file="m.pdf", main_policy_number="A", prb_file="p.pdf", prb_policy_number="B", chassis_no="V")
    with open(f"{folder}/manifest.json", "w") as f:
        json.dump({"exact_pairs": [pair], "standalone_policies": [dict(file="s.pdf", policy_number="C", doc_type="fire", note=None)]}, f)
    roles = sorted((r.role, r.file, r.policy_number) for r in RD.read_manifest(spark, f"{folder}/manifest.json").collect())
    assert roles == [("main", "m.pdf", "A"), ("prb", "p.pdf", "B"), ("standalone", "s.pdf", "C")]


def test_backup_round_trip(spark, folder):
    df = spark.createDataFrame([("1", "ก\n\"x\"", None), ("2", "", date(2026, 1, 1))], "id string, t string, d date")
    WR.write_backup({"t1": df, "t2": df.limit(1)}, f"{folder}/b")
    back = RD.read_backup(spark, f"{folder}/b", "t1", df.schema)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert WR.restored(df.filter("id = '1'"), back, append=True).count() == 2


def test_stream_barrier_and_resume(spark, folder):
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )
    schema = "batch_id string, file_id string, expected int"

    def arrive(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")

    def run():
        arrivals = IN.read_arrivals(spark, f"{folder}/in", spark.createDataFrame([], schema).schema, 1)
        q = IN.complete_batches(arrivals).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp")
        q.trigger(availableNow=True).start().awaitTermination()
        return sorted((r.batch_id, r.files) for r in spark.read.schema(IN.COMPLETE_BATCH).parquet(f"{folder}/out").collect())

    arrive(("a", "1", 2), ("b", "1", 1), ("c", "1", 3))
    assert run() == [("b", 1)]
    arrive(("a", "2", 2), ("c", "1", 3))
    assert run() == [("a", 2), ("b", 1)]
    assert run() == [("a", 2), ("b", 1)]


def test_pointers_across_batches(spark):
    seen = spark.createDataFrame([("h1", "0001")], "sha256 string, file_id string")
    batch = spark.createDataFrame([("h1", "0005"), ("h2", "0006"), ("h2", "0007")], "sha256 string, file_id string")
    got = {r.file_id: r.same_file_as for r in IN.with_pointers(batch, seen).collect()}
    assert got == {"0005": "0001", "0006": None, "0007": "0006"}


ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def test_pointers_through_the_stream(spark, folder):
    schema = "file_id string, sha256 string"
    spark.conf.set(*ROCKSDB)
    batches = [[("1", "a"), ("2", "b"), ("3", "a")], [("4", "b"), ("5", "c"), ("6", None)], [("7", "c"), ("8", "a"), ("9", None)]]
    for rows in batches:  # each run restarts from the checkpoint
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        IN.process_pointers(IN.read_arrivals(spark, f"{folder}/in", spark.createDataFrame([], schema).schema), f"{folder}/out", f"{folder}/cp").awaitTermination()
    got = {r.file_id: r.same_file_as for r in spark.read.parquet(f"{folder}/out").collect()}
    assert got == {"1": None, "2": None, "3": "1", "4": "2", "5": None, "6": None, "7": "5", "8": "1", "9": None}


def test_fifty_micro_batches_read_their_own_rows_only(spark, folder):
    """Numbers as file ids, a restart in the middle; input per micro-batch stays the same while the history grows."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(*ROCKSDB)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        schema = spark.createDataFrame([], "file_id long, sha256 string").schema
        want, first, sizes = {}, {}, []
        for half in range(2):
            for k in range(half * 25, half * 25 + 25):
                rows = [(k * 4 + i, f"h{(k * 4 + i) * 7 % 90}" if i else "hot") for i in range(4)]
                spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
                for n, h in rows:
                    want[n] = first.get(h)
                    first.setdefault(h, n)
            arrivals = IN.read_arrivals(spark, f"{folder}/in", schema, per_trigger=1)
            query = IN.process_pointers(arrivals, f"{folder}/out", f"{folder}/cp")
            query.awaitTermination()
            sizes += [p.numInputRows for p in query.recentProgress if p.numInputRows]
        assert {r.file_id: r.same_file_as for r in spark.read.parquet(f"{folder}/out").collect()} == want
        assert len(sizes) == 50 and len(set(sizes)) == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_progress_keeps_the_newest_row(spark, folder):
    schema = "batch_id string, file_id string, expected int"
    for rows in ([("a", "1", 3), ("b", "1", 1)], [("a", "2", 3)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        IN.progress(IN.read_arrivals(spark, f"{folder}/in", spark.createDataFrame([], schema).schema), f"{folder}/out", f"{folder}/cp").awaitTermination()
    assert {(r.batch_id, r.done, r.total, r.current) for r in IN.read_progress(spark, f"{folder}/out").collect()} == {("a", 2, 3, "2"), ("b", 1, 1, "1")}


def test_one_row_per_id_by_position(spark, folder):
    df = spark.createDataFrame([("1", "late", 9), ("1", "first", 2), ("2", "only", 5), (None, "x", 1), (None, "y", 2)], "id string, t string, at int")
    assert sorted((r.id or "", r.t) for r in WR.one_per_id(df, "at").collect()) == [("", "x"), ("", "y"), ("1", "first"), ("2", "only")]
    assert [(r.id, r.dropped) for r in WR.surplus_rows(df).collect()] == [("1", 1)]
    path = WR.write_snapshot(df.filter("id is not null"), folder, "v2", "at")
    assert {(r.id, r.t) for r in spark.read.parquet(path).collect()} == {("1", "first"), ("2", "only")}


def test_folder_of_a_cluster_must_be_named():
    from ledgerloom import session as S

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        S.ensure_checkpoint_dir(Session())


def test_long_house_numbers_are_found(spark):
    from ledgerloom.operators import linkage as L

    policies = spark.createDataFrame(
        [("p1", "1กก 1", "12345/12345/12345 ถนนสีลม", "นาย ก", date(2026, 1, 1), "FIRE", 0), ("p2", "1กก 2", "12345/12345/12346 ถนนสีลม", "นาย ข", date(2026, 1, 1), "FIRE", 1)],
        "id string, license_plate string, insured_address string, insured_name string, coverage_start date, policy_type string, pos int",
    )
    files = spark.createDataFrame([("12345-12345-12345ถนนสีลม กธ.69.pdf",)], "name string")
    parsed = L.parsed_names(files, 20).first()
    got = L.link_year_band(files, policies).first()
    assert parsed.kind == "address" and len(parsed.number) == 17 and (got.matches, got.policy_id) == (1, "p1")
