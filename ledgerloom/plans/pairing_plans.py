"""Document pairing over events (batches of papers) and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import dates as D, numbers as N, text as X
from ledgerloom.functions.similarity import closest_of, sequence_ratio
from ledgerloom.operators import pairing as P, windows as WN
from ledgerloom.plans import roles as R
from ledgerloom.plans.registry import query


def documents(spark, sf):
    """events as documents: sign-ups are main, purchases compulsory, errors endorsements, clicks fire; the user is the
    plate, the day of the month the year, the hash of the marker the name."""
    kind = F.expr("case event_type when 'signup' then 'motor_main' when 'purchase' then 'motor_prb' when 'error' then 'endorsement' when 'click' then 'fire' else 'unknown' end")
    none = F.lit(None).cast("string")
    return R.papers(spark, sf).select(
        F.col("file_id").alias("doc_id"), "pos", kind.alias("doc_type"), none.alias("policy_number"), none.alias("vin"), F.col("batch_id").alias("plate"),
        F.dayofmonth("day").alias("year"), F.substring(F.sha2("marker", 256), 1, 12).alias("name"), none.alias("car"), none.alias("file_plate"),
        F.lit(None).cast("int").alias("file_year"), (F.col("amount") < 5).alias("flagged"), "amount",
    )


@query(
    "jn_17_pair_candidates",
    """WITH m AS (SELECT * FROM papers WHERE event_type = 'signup'), p AS (SELECT * FROM papers WHERE event_type = 'purchase'),
       c AS (SELECT CASE WHEN m.marker = p.marker THEN 55 ELSE 45 END AS score FROM m JOIN p ON m.batch_id = p.batch_id AND day(m.day) = day(p.day))
       SELECT score, count(*) AS pairs FROM c GROUP BY 1""",
)
def jn_17(spark, sf):
    return P.candidate_counts(documents(spark, sf))


@query("jn_18_assignment")
def jn_18(spark, sf):
    """One-to-one pairs (checked against a sequential greedy pass in the tests)."""
    return P.pair_documents(documents(spark, sf)).withColumn("reasons", F.array_join("reasons", ","))


@query(
    "jn_18b_assigned_pairs",
    """WITH d AS (SELECT file_id, pos, event_type, batch_id, day(day) AS d, marker FROM papers WHERE event_type IN ('signup', 'purchase')),
       a AS (SELECT *, row_number() OVER (PARTITION BY event_type, batch_id, d, marker ORDER BY pos) AS k FROM d),
       equal AS (SELECT m.file_id AS main_id, p.file_id AS prb_id, 55 AS score FROM a m JOIN a p ON m.event_type = 'signup' AND p.event_type = 'purchase' AND m.batch_id = p.batch_id AND m.d = p.d AND m.marker = p.marker AND m.k = p.k),
       b AS (SELECT *, row_number() OVER (PARTITION BY event_type, batch_id, d ORDER BY pos) AS r FROM a WHERE file_id NOT IN (SELECT main_id FROM equal UNION ALL SELECT prb_id FROM equal))
       SELECT * FROM equal UNION ALL SELECT m.file_id, p.file_id, 45 FROM b m JOIN b p ON m.event_type = 'signup' AND p.event_type = 'purchase' AND m.batch_id = p.batch_id AND m.d = p.d AND m.r = p.r""",
)
def jn_18b(spark, sf):
    """Where only plate, year and equal names count, the greedy answer has a closed form: equal names by rank, then the rest."""
    return P.pair_documents(documents(spark, sf)).select("main_id", "prb_id", "score")


@query(
    "agg_11_outcome_summary",
    """WITH c AS (SELECT batch_id, day(day) AS d, count(*) FILTER (event_type = 'signup') AS m, count(*) FILTER (event_type = 'purchase') AS p FROM papers GROUP BY 1, 2)
       SELECT 'paired' AS outcome, cast(sum(least(m, p)) * 2 as bigint) AS documents FROM c UNION ALL SELECT 'orphan_main', cast(sum(m - least(m, p)) as bigint) FROM c
       UNION ALL SELECT 'orphan_prb', cast(sum(p - least(m, p)) as bigint) FROM c UNION ALL SELECT 'other', count(*) FROM papers WHERE event_type NOT IN ('signup', 'purchase')""",
)
def agg_11b(spark, sf):
    docs = documents(spark, sf)
    return P.outcome_of(docs, P.pair_documents(docs)).groupBy("outcome").agg(F.count("*").alias("documents"))


@query("rte_1_import_plan")
def rte_1(spark, sf):
    docs = WN.mark_duplicates(documents(spark, sf).withColumn("number", F.concat("plate", F.lit("-"), "name")), "number", "doc_type", "amount", "pos", "doc_id")
    return P.import_plan(docs).groupBy("route").agg(F.count("*").alias("documents"))


@query(
    "jn_21_anchor_cascade",
    """WITH a AS (SELECT file_id AS doc_id, batch_id AS plate, day(day) AS year FROM papers WHERE event_type = 'error'), c AS (SELECT file_id AS cand_id, batch_id AS plate, day(day) AS year, marker FROM papers WHERE event_type = 'signup'),
       v AS (SELECT marker, count(*) AS n, min(cand_id) AS c FROM c GROUP BY 1), e AS (SELECT file_id AS doc_id, marker FROM papers WHERE event_type = 'error'),
       p AS (SELECT a.doc_id, count(*) AS n, min(cand_id) AS c FROM a JOIN c ON a.plate = c.plate AND a.year = c.year GROUP BY 1)
       SELECT a.doc_id, CASE WHEN v.n = 1 THEN v.c WHEN v.n > 1 THEN NULL WHEN p.n = 1 THEN p.c END AS parent_id,
         CASE WHEN v.n = 1 THEN 'chassis' WHEN v.n > 1 THEN 'chassis_ambiguous' WHEN p.n = 1 THEN 'plate_year_name' ELSE 'no_unique_evidence' END AS reason
       FROM a JOIN e ON a.doc_id = e.doc_id LEFT JOIN v ON v.marker = concat(e.marker, CASE WHEN a.doc_id > 0 AND year < 20 THEN ' ' ELSE '' END) LEFT JOIN p ON a.doc_id = p.doc_id""",
)
def jn_21(spark, sf):
    p = R.papers(spark, sf)
    year = F.dayofmonth("day")
    mains = p.filter("event_type = 'signup'").select(
        F.col("file_id").alias("cand_id"), F.array().cast("array<string>").alias("numbers"), F.array("marker").alias("vins"), F.array("batch_id").alias("plates"),
        F.array().cast("array<string>").alias("names"), F.array(year).alias("years"),
    )
    wanted = p.filter("event_type = 'error'").select(
        F.col("file_id").alias("doc_id"), F.lit(None).cast("string").alias("number"), F.concat("marker", F.when((F.col("file_id") > 0) & (year < 20), " ").otherwise("")).alias("vin"),
        F.col("batch_id").alias("plate"), F.lit("someone").alias("name"), year.alias("year"),
    )
    return P.attach_by_anchor(wanted, mains).select("doc_id", "parent_id", "reason")


@query("jn_19_evidence_pairs")
def jn_19(spark, sf):
    """Turns of a conversation as a batch: user turns are main, the others compulsory."""
    kind = F.when(F.col("role") == "user", "motor_main").otherwise("motor_prb")
    docs = R.table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("batch_id"), F.concat_ws("-", "conv_id", "turn").alias("doc_id"), F.col("turn").cast("int").alias("pos"),
        kind.alias("doc_type"), (F.length("text") % 3).alias("year"), "text",
    )
    return P.pair_by_evidence(P.evidence_of(docs))[0].withColumn("reasons", F.array_join("reasons", "; "))


def _turn_batches(spark, sf):
    """Turns of a conversation as a batch with evidence: words as tokens, and VINs and years by the length of the text."""
    n = F.length("text")
    return R.table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("batch_id"), F.concat_ws("-", "conv_id", "turn").alias("doc_id"), F.col("turn").cast("int").alias("pos"),
        F.when(F.col("role") == "user", "motor_main").otherwise("motor_prb").alias("doc_type"), F.when(n % 7 > 0, n % 2).cast("int").alias("year"),
        F.when(n % 4 > 0, F.array(F.concat(F.lit("V"), (n % 3).cast("string")))).otherwise(F.array().cast("array<string>")).alias("vins"),
        F.array_distinct(F.regexp_extract_all("text", F.lit("([a-z]{4,9})"), F.lit(1))).alias("tokens"),
    )


#: One main after the other, each against its batch's candidates in order: the used partners are a list carried along.
_TURNS_SQL = """WITH RECURSIVE t AS (SELECT cast(conv_id as string) AS batch_id, concat(conv_id, '-', turn) AS doc_id, turn AS pos, role = 'user' AS is_main,
         CASE WHEN length(text) % 7 > 0 THEN length(text) % 2 END AS year, CASE WHEN length(text) % 4 > 0 THEN ['V' || (length(text) % 3)] ELSE [] END AS vins,
         list_filter(list_distinct(regexp_extract_all(text, '[a-z]{4,9}')), lambda w: length(w) >= 5) AS tokens FROM conversations),
       o AS (SELECT *, row_number() OVER (PARTITION BY batch_id, is_main ORDER BY pos, doc_id) AS k FROM t),
       s AS (SELECT m.batch_id, m.k, m.doc_id AS main, p.doc_id AS prb, p.k AS p_k, abs(m.pos - p.pos) = 1 AND coalesce(m.year = p.year, false) AS beside,
           CASE WHEN len(list_intersect(m.vins, p.vins)) > 0 THEN 80 ELSE 0 END + CASE WHEN m.year = p.year THEN 20 ELSE 0 END
           + CASE WHEN abs(m.pos - p.pos) = 1 THEN 18 WHEN abs(m.pos - p.pos) <= 3 THEN 8 ELSE 0 END + least(22, 3 * len(list_intersect(m.tokens, p.tokens))) AS score
         FROM o m JOIN o p ON m.batch_id = p.batch_id AND m.is_main AND NOT p.is_main),
       c AS (SELECT batch_id, k, main, list({'p': prb, 's': score, 'b': beside} ORDER BY score DESC, p_k) AS cands FROM s GROUP BY 1, 2, 3),
       r AS (SELECT DISTINCT batch_id, cast(0 as bigint) AS k, cast([] AS varchar[]) AS used, cast(NULL as varchar) AS main_id, cast(NULL as varchar) AS prb_id, cast(0 as bigint) AS score, cast(0 as bigint) AS runner_up, false AS ready FROM c
         UNION ALL
         SELECT batch_id, k, CASE WHEN ready THEN list_append(used, f[1].p) ELSE used END, main, f[1].p, f[1].s, coalesce(f[2].s, 0), ready
         FROM (SELECT *, (f[1].s >= 80 OR (f[1].s >= 44 AND f[1].b)) AND f[1].s - coalesce(f[2].s, 0) >= 8 AS ready
           FROM (SELECT c.batch_id, c.k, c.main, r.used, list_filter(c.cands, lambda x: NOT list_contains(r.used, x.p)) AS f FROM r JOIN c ON c.batch_id = r.batch_id AND c.k = r.k + 1)))"""


@query(
    "jn_19b_evidence_answers",
    f"""{_TURNS_SQL} SELECT batch_id, main_id, prb_id, cast(score as int) AS score, cast(runner_up as int) AS runner_up, CASE WHEN ready THEN 'ready_for_review' ELSE 'needs_manual_check' END AS status FROM r WHERE prb_id IS NOT NULL""",
)
def jn_19b(spark, sf):
    """Every main with its answer, best and second score."""
    return P.pair_by_evidence(_turn_batches(spark, sf))[0].drop("reasons")


@query(
    "jn_19c_evidence_unmatched",
    f"""{_TURNS_SQL} SELECT batch_id, doc_id, CASE WHEN is_main THEN 'motor_main' ELSE 'motor_prb' END AS doc_type FROM t
       WHERE doc_id NOT IN (SELECT main_id FROM r WHERE ready UNION ALL SELECT prb_id FROM r WHERE ready)""",
)
def jn_19c(spark, sf):
    """Mains and compulsory documents in no ready pair."""
    return P.pair_by_evidence(_turn_batches(spark, sf))[1]


@query(
    "win_8_neighbour_distance",
    """SELECT apart, count(*) AS pairs FROM (SELECT abs(a.turn - b.turn) AS apart FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.role = 'user' AND b.role = 'assistant') WHERE apart <= 3 GROUP BY 1""",
)
def win_8(spark, sf):
    """Positions at most three apart, as an equi join on listed positions."""
    turns = R.table(spark, sf, "conversations")
    left = turns.filter("role = 'user'").select("conv_id", F.col("turn").alias("a"), F.explode(F.sequence(F.col("turn") - 3, F.col("turn") + 3)).alias("b"))
    right = turns.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("b"))
    return left.join(right, ["conv_id", "b"]).groupBy(F.abs(F.col("a") - F.col("b")).alias("apart")).agg(F.count("*").alias("pairs"))


@query("fn_10_name_similarity")
def fn_10(spark, sf):
    """Distinct part names alike by ratio (no SQL counterpart)."""
    names = R.table(spark, sf, "part").select(F.col("p_name").alias("name")).distinct()
    return P.similar_names(names, names).withColumn("ratio", F.round(sequence_ratio("main_name", "prb_name"), 6))


_MONTHS = "[" + ", ".join(f"'{m}'" for m in D.THAI_MONTHS) + "]"


@query(
    "fn_20_fuzzy_month",
    f"""WITH w AS (SELECT {_MONTHS}[month(coverage_start)] AS month, month(coverage_start) AS m FROM policies)
       SELECT concat(substr(month, 1, m % 3 + 1), substr(month, m % 3 + 3)) AS word, count(*) AS rows, month FROM w GROUP BY ALL""",
)
def fn_20(spark, sf):
    """Month words with one letter lost, put right: the month is the one of the date."""
    p = R.policies(spark, sf)
    word = F.get(F.array(*[F.lit(m) for m in D.THAI_MONTHS]), F.month("coverage_start") - 1)
    broken = F.concat(F.substring(word, F.lit(1), F.month("coverage_start") % 3 + 1), F.substring(word, F.month("coverage_start") % 3 + 3, F.lit(20)))
    words = p.groupBy(broken.alias("word")).agg(F.count("*").alias("rows"))
    return words.withColumn("month", closest_of("word", D.closest_month_candidates("word")))


@query(
    "fn_9_whole_number",
    """SELECT id, regexp_matches(insured_address, concat('(^|[^0-9])', cast(customer_key % 50 + 1 as string), '([^0-9]|$)')) AS hit FROM policies""",
)
def fn_9(spark, sf):
    number = (F.col("customer_key") % 50 + 1).cast("string")
    return R.policies(spark, sf).select("id", X.whole_number_in(number, "insured_address").alias("hit"))


@query(
    "fn_11_common_run",
    """WITH g AS (SELECT p_partkey, substr(p_name, i, 3) AS gram FROM part, range(1, 40) r(i) WHERE i <= length(p_name) - 2)
       SELECT p.p_partkey AS id, EXISTS (SELECT 1 FROM g WHERE g.p_partkey = p.p_partkey AND contains(lower(p.p_type), gram)) AS shares FROM part p""",
)
def fn_11(spark, sf):
    return R.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), X.shares_run("p_name", F.lower("p_type")).alias("shares"))


@query(
    "fn_31_vin_check_digit",
    """WITH d AS (SELECT id, chassis_no AS v, list_sum(list_transform(range(1, 18), lambda i: cast(substr(translate(chassis_no, 'MRH', '498'), cast(i as int), 1) as int) * [8,7,6,5,4,3,2,10,0,9,8,7,6,5,4,3,2][i])) % 11 AS rem FROM policies)
       SELECT id, substr(v, 9, 1) = CASE WHEN rem = 10 THEN 'X' ELSE cast(cast(rem as int) as string) END AS ok FROM d""",
)
def fn_31(spark, sf):
    return R.policies(spark, sf).select("id", N.vin_check_digit_ok("chassis_no").alias("ok"))
