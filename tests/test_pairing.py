"""Pairing against a sequential greedy pass, and the safety cases."""

import hashlib
import itertools
import random
import re
import struct
from collections import Counter
from datetime import date
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.similarity import ratio_bound
from ledgerloom.operators import pairing as P, rules as RU, windows as WN
from ledgerloom.schemas import BATCH_DOCUMENTS

VIN = "MRHGM2620CP400001"


def doc(file_id, pos, kind, **facts):
    row = {f.name: None for f in BATCH_DOCUMENTS.fields}
    row.update(batch_id="b", file_id=file_id, pos=pos, doc_type=kind, **facts)
    return tuple(row[f.name] for f in BATCH_DOCUMENTS.fields)


def frame(spark, rows):
    df = spark.createDataFrame(rows, BATCH_DOCUMENTS)
    return P.with_facts(RU.classify_documents(df)).withColumn("doc_id", F.col("file_id"))


BASE = dict(chassis_no=VIN, license_plate="1กก8803", coverage_start=date(2026, 4, 9), insured_name="นาย ทดสอบ")


@pytest.mark.parametrize(
    "main,prb,expected",
    [
        ({}, {}, ["auto"]),
        ({}, {"coverage_start": date(2025, 4, 9)}, []),
        ({"requires_review": True}, {}, ["review"]),
        ({}, {"license_plate": "2กก9999"}, ["review"]),
        ({}, {"chassis_no": "MRHGM2620CP400002"}, []),
    ],
)
def test_safety_cases(spark, main, prb, expected):
    rows = [doc("0", 0, "motor_main", **{**BASE, **main}), doc("1", 1, "motor_prb", **{**BASE, **prb})]
    assert [r.status for r in P.pair_documents(frame(spark, rows)).collect()] == expected


def test_file_names_alone_propose_a_review_pair(spark):
    rows = [
        doc("0", 0, None, policy_number="D0-70-69/1", orig_filename="1กก8803 กธ.69.pdf"),
        doc("1", 1, None, policy_number="D0-72-69/2", orig_filename="1กก8803 พรบ.69.pdf"),
    ]
    got = P.pair_documents(frame(spark, rows)).collect()
    assert [(r.main_id, r.prb_id, r.status, r.score) for r in got] == [("0", "1", "review", 30)]


def pair_score(m, p):
    if m["vin"] and p["vin"] and m["vin"] != p["vin"] or m["year"] and p["year"] and m["year"] != p["year"]:
        return -999
    s = 50 * bool(m["vin"] and m["vin"] == p["vin"]) + 30 * bool(m["plate"] and m["plate"] == p["plate"])
    s += 15 * bool(m["year"] and m["year"] == p["year"])
    if m["name"] and p["name"] and SequenceMatcher(None, m["name"], p["name"]).ratio() >= 0.85:
        s += 10
    if m["car"] and p["car"] and (m["car"] in p["car"] or p["car"] in m["car"]):
        s += 5
    if m["file_plate"] and m["file_plate"] == p["file_plate"]:
        s += 25 + 5 * bool(m["file_year"] and m["file_year"] == p["file_year"])
    return s


def sequential(docs):
    """The definition: all pairs scored, highest first, ties in input order."""
    mains = [d for d in docs if d["doc_type"] == "motor_main"]
    prbs = [d for d in docs if d["doc_type"] == "motor_prb"]
    edges = [(pair_score(m, p), m["doc_id"], p["doc_id"]) for m in mains for p in prbs]
    edges = sorted([e for e in edges if e[0] >= 30], key=lambda e: -e[0])
    used, out = set(), []
    for s, m, p in edges:
        if m in used or p in used:
            continue
        used |= {m, p}
        rest = [e[0] for e in edges if (e[1] == m) != (e[2] == p)]
        out.append((m, p, s, s - max(rest) if rest else s))
    return sorted(out)


SCHEMA = (
    "doc_id string, pos long, doc_type string, vin string, plate string, year int, name string, car string, "
    "file_plate string, file_year int, flagged boolean"
)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_sequential_pass(spark, seed):
    rng = random.Random(seed)
    names = ["somchaijaidee", "somchaijaide", "wirotmeechok", "anongsuksai", None]
    rows = [
        dict(
            doc_id=f"{i:03d}", pos=i, doc_type=rng.choice(["motor_main", "motor_prb"]), vin=rng.choice(["V1", "V2", None, None]),
            plate=rng.choice(["HOT", "HOT", "A", "B", None]), year=rng.choice([2024, 2025, None]), name=rng.choice(names),
            car=rng.choice(["TOYOTA", "TOYOTACITY", None]), file_plate=rng.choice(["F", None, None]), file_year=rng.choice([2567, None]), flagged=False,
        )
        for i in range(46)
    ]
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    shuffled = docs.repartition(3, "name")
    got = sorted((r.main_id, r.prb_id, r.score, r.margin) for r in P.pair_documents(shuffled).collect())
    assert got == sequential(rows)


def test_one_plate_on_many_equal_documents_stays_small(spark):
    rows = [(f"m{i:04d}", i, "motor_main", None, "OTHER", 2025, f"name{i:04d}", None, None, None, False) for i in range(400)]
    rows += [(f"p{i:04d}", 1000 + i, "motor_prb", None, "OTHER", 2025, None, None, None, None, False) for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert P.candidate_edges(docs).count() == 1
    pairs = P.pair_documents(docs).collect()
    assert sorted((r.main_id, r.prb_id) for r in pairs) == [(f"m{i:04d}", f"p{i:04d}") for i in range(300)]


def test_a_large_block_of_different_names_is_one_edge(spark):
    """One plate and year on 20,000 mains and 20,000 partners, each name like one other at most."""
    n = 20_000
    name = lambda i: "".join(chr(0x4E00 + b % 20_000) for b in struct.unpack("<8H", hashlib.md5(b"%d" % i).digest()))
    rows = [(f"m{i:05d}", i, "motor_main", None, "OTHER", 2025, name(i), None, None, None, False) for i in range(n)]
    rows += [(f"p{i:05d}", n + i, "motor_prb", None, "OTHER", 2025, name(n + n // 2 - i), None, None, None, False) for i in range(n)]
    docs = spark.createDataFrame(rows, SCHEMA)
    edges = P.candidate_edges(docs)
    # plate; plate and name; never the pairs of documents
    assert edges.filter(F.col("score") == 45).count() == 1 and edges.count() <= 2 * n
    joined = edges.select(F.sum(F.col("m_n") + F.col("p_n"))).first()[0]
    assert joined < 5_000_000
    got = {r.main_id: (r.prb_id, r.score) for r in P.pair_documents(docs).collect()}
    # the sorted pass: equal names first, then what is left in order
    partner = {name(n + n // 2 - i): f"p{i:05d}" for i in range(n)}
    want = {f"m{i:05d}": (partner[name(i)], 55) for i in range(n) if name(i) in partner}
    used = {p for p, _ in want.values()}
    free = [f"p{i:05d}" for i in range(n) if f"p{i:05d}" not in used]
    want |= {m: (p, 45) for m, p in zip((f"m{i:05d}" for i in range(n) if f"m{i:05d}" not in want), free)}
    like = {m: v for m, v in got.items() if v[1] == 55}
    assert len(got) == n and {m: v for m, v in want.items() if v[1] == 55}.items() <= like.items()
    if len(like) == sum(v[1] == 55 for v in want.values()):  # no two of the other names are alike by chance
        assert got == want


@pytest.mark.parametrize("seed", [3])
def test_counts_of_pairs_equal_double_loops(spark, seed):
    rng = random.Random(seed)
    rows = [
        (f"{i:03d}", i, rng.choice(["motor_main", "motor_prb"]), rng.choice(["V1", "V2", "V3", None]), rng.choice(["A", "B", None]), rng.choice([2024, 2025, None]),
         rng.choice(["somchaijaidee", "somchaijaide", "wirotmeechok", None]), rng.choice(["TOYOTA", "TOYOTACITY", None]), rng.choice(["F", "G", None]), rng.choice([2567, 2568, None]), False)
        for i in range(120)
    ]
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    docs = [dict(zip(names, r)) for r in rows]
    want = Counter(s for m in docs for p in docs if m["doc_type"] == "motor_main" and p["doc_type"] == "motor_prb" if (s := pair_score(m, p)) >= 30)
    assert {r.score: r.pairs for r in P.candidate_counts(spark.createDataFrame(rows, SCHEMA)).collect()} == want


def test_similar_names_miss_nothing(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(3, 12))) for _ in range(60)]
    words += [w[:-1] for w in words[:30]] + [w + "a" for w in words[:20]]
    df = spark.createDataFrame([(w,) for w in sorted(set(words))], "name string")
    got = {tuple(r) for r in P.similar_names(df, df).collect()}
    want = {(a, b) for a, b in itertools.product(set(words), repeat=2) if SequenceMatcher(None, a, b).ratio() >= 0.85}
    assert got == want


def test_ratio_bound_is_never_below_the_ratio_and_cuts_pairs(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abกข่😀") for _ in range(rng.randint(1, 9))) for _ in range(60)] + ["a" * 230, "ab" * 130, "a.b*c$1"]
    pairs = spark.createDataFrame([(a, b) for a in words for b in words] + [("", "a"), (None, "a")], "a string, b string")
    rows = pairs.select("a", "b", ratio_bound("a", "b").alias("bound")).collect()
    assert [r.bound for r in rows if not r.a] == [None, None]
    truth = [(r.bound, SequenceMatcher(None, r.a, r.b).ratio()) for r in rows if r.a]
    assert all(bound >= ratio - 1e-12 for bound, ratio in truth)
    assert sum(ratio >= 0.85 for _, ratio in truth) <= sum(bound >= 0.85 for bound, _ in truth) < len(truth) / 10


def test_the_bound_stands_before_python(spark):
    df = spark.createDataFrame([("abcdef",), ("abcdeg",)], "name string")
    plan = P.similar_names(df, df)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("ArrowEvalPython", 1)
    assert "array_intersect" in below and "array_intersect" not in above


def test_anchor_cascade(spark):
    candidates = spark.createDataFrame(
        [("c1", ["N1"], ["V1"], ["P1"], ["a"], [2024]), ("c2", ["N2"], ["V1"], ["P1"], ["b"], [2025]), ("c3", ["N2"], [], ["P2"], [], [])],
        "cand_id string, numbers array<string>, vins array<string>, plates array<string>, names array<string>, years array<int>",
    )
    asked = spark.createDataFrame(
        [
            ("1", "N1", None, None, None, None), ("2", "N2", "V9", "P2", None, None), ("3", None, "V1", "P1", "a", 2024),
            ("4", None, "V9", "P1", "a", 2024), ("5", None, None, "P1", None, None), ("6", None, None, "P2", "z", 2020),
        ],
        "doc_id string, number string, vin string, plate string, name string, year int",
    )
    got = {r.doc_id: (r.parent_id, r.reason) for r in P.attach_by_anchor(asked, candidates).collect()}
    assert got == {
        "1": ("c1", "policy_number"),
        "2": (None, "policy_number_ambiguous"),
        "3": (None, "chassis_ambiguous"),
        "4": ("c1", "plate_year_name"),
        "5": (None, "no_unique_evidence"),
        "6": ("c3", "plate_year_name"),
    }


def one_after_another(docs):
    """The mains of a batch in turn, each against every free partner."""
    pairs, unmatched = [], []
    for batch in sorted({d[0] for d in docs}):
        rows = sorted((d for d in docs if d[0] == batch), key=lambda d: (d[2], d[1]))
        free = [d for d in rows if d[3] == "motor_prb"]
        done = set()
        for _, main, pos, kind, year, vins, tokens in rows:
            if kind != "motor_main" or not free:
                continue
            def points(p):
                n = sum(len(t) >= 5 or any(c.isdigit() for c in t) for t in set(tokens) & set(p[6]))
                apart = abs(pos - p[2])
                return 80 * bool(set(vins) & set(p[5])) + 20 * (year is not None and year == p[4]) + (18 if apart == 1 else 8 if apart <= 3 else 0) + min(22, 3 * n)
            order = sorted(free, key=lambda p: -points(p))
            best, second = order[0], points(order[1]) if len(order) > 1 else 0
            high = points(best) >= 80 or (points(best) >= 44 and abs(pos - best[2]) == 1 and year is not None and year == best[4])
            ready = high and points(best) - second >= 8
            pairs.append((batch, main, best[1], points(best), second, "ready_for_review" if ready else "needs_manual_check"))
            if ready:
                done |= {main, best[1]}
                free.remove(best)
        unmatched += [(batch, d[1]) for d in rows if d[3] in ("motor_main", "motor_prb") and d[1] not in done]
    return sorted(pairs), sorted(unmatched)


EVIDENCE = "batch_id string, doc_id string, pos int, doc_type string, year int, vins array<string>, tokens array<string>"


def paired(spark, rows):
    pairs, unmatched = P.pair_by_evidence(spark.createDataFrame(rows, EVIDENCE))
    return sorted(tuple(r)[:6] for r in pairs.collect()), sorted((r.batch_id, r.doc_id) for r in unmatched.collect())


def test_evidence_pairs_equal_one_pass(spark):
    rng = random.Random(21)
    rows = []
    for b in range(40):
        for i in range(rng.randint(1, 14)):
            kind = rng.choice(["motor_main", "motor_prb", "motor_main", "motor_prb", "fire"])
            tokens = [rng.choice(["TOKEN1", "LONGWORD", "abc", "X9", "Y8", "Z7", "W6", "V5"]) for _ in range(rng.randint(0, 7))]
            rows.append((f"b{b}", f"d{i:02d}", rng.choice([i, i, i - 1]), kind, rng.choice([2024, 2025, None]), rng.sample(["V1", "V2", "V3"], rng.choice([0, 0, 1])), tokens))
    assert paired(spark, rows) == one_after_another(rows)


def test_evidence_pairs_in_a_large_batch(spark):
    rng = random.Random(22)
    rows = []
    for i in range(5000):
        kind = "motor_main" if i % 2 == 0 else "motor_prb"
        rows.append(("big", f"d{i:05d}", i, kind, 2020 + i // 2 % 5, [f"V{i // 2}"] if rng.random() < 0.7 else [], [f"T{i // 4}", f"U{i // 2}", f"N{i // 2}"]))
    got, unmatched = paired(spark, rows)
    want, left = one_after_another(rows)
    assert got == want and unmatched == left
    assert sum(p[5] == "ready_for_review" for p in got) > 1000


def test_a_tie_with_the_year_alone_goes_to_the_earlier_partner(spark):
    """Near and four words are worth as much as the year: the partner of the year stands before, then behind the other."""
    words = ["LONGA", "LONGB", "LONGC", "LONGD"]
    for at in (1, 30):
        rows = [("a", "m", 10, "motor_main", 2025, [], words), ("a", "y", at, "motor_prb", 2025, [], []), ("a", "w", 12, "motor_prb", 2024, [], words)]
        assert paired(spark, rows) == one_after_another(rows)
        assert paired(spark, rows)[0][0][:5] == ("a", "m", "y" if at == 1 else "w", 20, 20)


def test_evidence_reasons(spark):
    rows = [("a", str(i), i, "motor_main" if i % 2 == 0 else "motor_prb", 2025, ["V"] if i < 2 else [], ["TOKEN1"]) for i in range(4)]
    pairs, unmatched = P.pair_by_evidence(spark.createDataFrame(rows, EVIDENCE))
    got = {r.main_id: r for r in pairs.collect()}
    assert got["0"].reasons == ["vin: V", "same year", "next to each other", "shared: TOKEN1"] and got["0"].status == "ready_for_review"
    assert got["2"].reasons == ["same year", "next to each other", "shared: TOKEN1"] and got["2"].prb_id == "3"
    assert sorted(r.doc_id for r in unmatched.collect()) == ["2", "3"]


def test_a_batch_of_200000_files_is_no_single_task(spark):
    """Partners by VIN where it is known, else by place, else the first free one; against a pass that looks only nearby."""
    n = 200_000
    rng = random.Random(23)
    vin = [f"V{i // 2}" if (i // 2) % 10 < 7 else None for i in range(n)]
    rows = [("big", f"d{i:06d}", i * 5 if i // 2 % 10 else i * 5 - i % 2 * 4, "motor_main" if i % 2 == 0 else "motor_prb", None, [vin[i]] if vin[i] else [], []) for i in range(n)]
    rng.shuffle(rows)
    pairs, unmatched = P.pair_by_evidence(spark.createDataFrame(rows, EVIDENCE).repartition(8))
    ordered = sorted(rows, key=lambda r: (r[2], r[1]))
    at = {r[2]: r for r in ordered if r[3] == "motor_prb"}
    by_vin = {r[5][0]: r for r in at.values() if r[5]}
    free, first, want, used = [r for r in ordered if r[3] == "motor_prb"], 0, {}, set()
    for _, main, pos, kind, _, vins, _ in ordered:
        if kind != "motor_main":
            continue
        while first < len(free) and free[first][1] in used:
            first += 1
        near = {at[p][1]: 18 if abs(p - pos) == 1 else 8 for p in range(pos - 3, pos + 4) if p in at}
        if vins and vins[0] in by_vin:
            near[by_vin[vins[0]][1]] = near.get(by_vin[vins[0]][1], 0) + 80
        ranked = sorted((-s, p) for p, s in near.items() if p not in used)
        best = ranked[0] if ranked else (0, free[first][1])
        second = -ranked[1][0] if len(ranked) > 1 else 0
        want[main] = (best[1], -best[0], second)
        if -best[0] >= 80 and -best[0] - second >= 8:
            used |= {main, best[1]}
    assert {r.main_id: (r.prb_id, r.score, r.runner_up) for r in pairs.collect()} == want
    assert {r.doc_id for r in unmatched.collect()} == {r[1] for r in rows} - used


def test_no_window_over_a_whole_batch(spark):
    rows = [("b", str(i), i, "motor_main" if i % 2 else "motor_prb", 2024, [], ["TOKEN1"]) for i in range(20)]
    pairs, unmatched = P.pair_by_evidence(spark.createDataFrame(rows, EVIDENCE))
    for frame, some in ((pairs, True), (unmatched, False)):
        specs = re.findall(r"windowspecdefinition\((.*?)specifiedwindowframe", frame._jdf.queryExecution().optimizedPlan().toString())
        assert bool(specs) == some and all("_part#" in x or re.search(r"\bm#", x) for x in specs)


@pytest.mark.parametrize("before", [False, True])
def test_running_values_over_range_partitions(spark, before):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b"]), i, rng.choice([None, 1, 5, 3])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(5)
    got = {r.i: (r.s, r.m, r.l) for r in WN.keyed_running(df, ["k"], ["i"], {"s": ("sum", "v"), "m": ("max", "v"), "l": ("last", "v")}, before).collect()}
    for key, i, v in rows:
        own = [x for k, j, x in rows if k == key and (j < i or j == i and not before) and x is not None]
        assert got[i] == (sum(own), max(own, default=None), own[-1] if own else None)
