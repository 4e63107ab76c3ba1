"""Classification, extraction, validation, consensus, merging and scalar keys over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import dates as D, numbers as N, text as X
from ledgerloom.functions.filenames import bucket_key, storage_key
from ledgerloom.operators import aggregates as A, extract as E, legacy as LG, older as OL, rules as RU, validate as V
from ledgerloom.plans import roles as R
from ledgerloom.plans.registry import query
from ledgerloom.schemas import LEGACY_COLUMNS

MONEY = ["net_premium", "stamp_duty", "vat", "total_premium"]


def as_double(df, *columns):
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def as_text(df, *columns):
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


# -- rules -----------------------------------------------------------------------------------------------------------
@query(
    "rul_1_document_class",
    """SELECT id, CASE WHEN manually_edited AND policy_type = 'M' THEN 'renewal_notice' WHEN pdf_url IS NOT NULL AND policy_type = 'P' THEN 'motor_prb'
         WHEN pdf_url IS NOT NULL AND policy_type = 'M' THEN 'motor_main' WHEN pdf_url IS NOT NULL AND policy_type = 'FIRE' THEN 'fire'
         WHEN pdf_url IS NOT NULL AND policy_type = 'PA' THEN 'sme_property' WHEN policy_type = 'MISC' THEN 'invoice' WHEN pdf_filename IS NOT NULL THEN 'motor_main'
         WHEN policy_type = 'FIRE' THEN 'fire' ELSE 'unknown' END AS doc_type FROM policies""",
)
def rul_1(spark, sf):
    df = R.policies(spark, sf).selectExpr(
        "id",
        "case when manually_edited and policy_type = 'M' then 'Motor insurance renewal' when policy_type = 'FIRE' then 'Fire Insurance' end AS title",
        "cast(null as string) AS raw_text", "policy_type", "case when pdf_url is not null then policy_number end AS policy_number",
        "case when policy_type = 'MISC' then 'invoice' else 'unknown' end AS doc_type", "pdf_filename AS orig_filename",
    )
    return RU.classify_documents(df).select("id", "doc_type")


@query(
    "rul_2_class_from_text",
    """SELECT origin, CASE WHEN contains(u, 'RENEWAL NOTICE') OR contains(u, 'MOTOR INSURANCE RENEWAL') THEN 'renewal_notice' WHEN contains(u, 'PROTECTION FOR VICTIMS') THEN 'motor_prb'
         WHEN contains(u, 'CREDIT NOTE') OR contains(u, 'CREDIT-NOTE') THEN 'credit_note' WHEN contains(u, 'INVOICE') THEN 'invoice' WHEN contains(u, 'RECEIPT') THEN 'receipt'
         WHEN contains(u, 'FIRE INSURANCE') THEN 'fire' WHEN contains(u, 'SME INSURANCE') THEN 'sme_property' WHEN contains(u, 'PERSONAL ACCIDENT') OR contains(u, 'TRAVEL INSURANCE') THEN 'other_policy'
         WHEN contains(u, 'MOTOR INSURANCE') THEN 'motor_main' ELSE 'unknown' END AS doc_type, count(*) AS texts
       FROM (SELECT 'schedules' AS origin, upper(text) AS u FROM schedules UNION ALL SELECT 'documents', upper(text) FROM documents UNION ALL SELECT 'pages', upper(html) FROM pages) GROUP BY 1, 2""",
)
def rul_2(spark, sf):
    sides = [
        R.schedules(spark, sf).select(F.lit("schedules").alias("origin"), "text"),
        R.table(spark, sf, "documents").select(F.lit("documents").alias("origin"), "text"),
        R.table(spark, sf, "pages").select(F.lit("pages").alias("origin"), F.col("html").alias("text")),
    ]
    texts = sides[0].unionByName(sides[1]).unionByName(sides[2])
    return texts.groupBy("origin", RU.class_by_words(F.col("text"), RU.TEXT_WORDS).alias("doc_type")).agg(F.count("*").alias("texts"))


@query(
    "rul_4_class_alias",
    """SELECT doc_type AS given, CASE doc_type WHEN 'main' THEN 'motor_main' WHEN 'prb' THEN 'motor_prb' WHEN 'other' THEN 'other_policy' WHEN 'photo' THEN NULL ELSE doc_type END AS doc_type, count(*) AS rows
       FROM attachments GROUP BY 1, 2""",
)
def rul_4(spark, sf):
    stated = F.expr("case doc_type when 'main' then ' Motor-Policy' when 'prb' then 'P R B' when 'other' then 'Travel' else upper(doc_type) end")
    return R.attachments(spark, sf).groupBy(F.col("doc_type").alias("given"), RU.stated_class(stated).alias("doc_type")).agg(F.count("*").alias("rows"))


_INSURERS = " ".join(f"WHEN regexp_matches(text, '(?i){p}') THEN '{c}'" for c, p in RU.INSURER_PATTERNS)


@query(
    "rul_5_insurer_code",
    f"""SELECT doc_id, CASE {_INSURERS} ELSE '' END AS company FROM (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, text FROM schedules)""",
)
def rul_5(spark, sf):
    texts = R.table(spark, sf, "documents").select("doc_id", "text").unionByName(R.schedules(spark, sf).select("doc_id", "text"))
    return texts.select("doc_id", RU.insurer_by_pattern(F.col("text")).alias("company"))


# -- extraction ------------------------------------------------------------------------------------------------------
@query(
    "ext_1_schedule_fields",
    """SELECT doc_id, 'motor_main' AS doc_type, truth_number AS policy_number, truth_vin AS chassis_no, truth_plate AS license_plate, truth_name AS insured_name,
       CASE WHEN day_month <> '29-2' THEN truth_start END AS coverage_start, truth_make AS car_make, truth_year AS car_year, truth_net AS net_premium FROM schedules""",
)
def ext_1(spark, sf):
    df = E.read_fields(R.schedules(spark, sf).select("doc_id", "text"))
    return df.select(
        "doc_id", "doc_type", "policy_number", "chassis_no", "license_plate", "insured_name", F.col("coverage_start").cast("string").alias("coverage_start"),
        "car_make", F.col("car_year").cast("long").alias("car_year"), F.col("net_premium").cast("double").alias("net_premium"),
    )


@query(
    "ext_1b_document_fields",
    """SELECT doc_id, list_extract(list_filter(regexp_extract_all(upper(text), '\\b[A-Z0-9]{17}\\b'), lambda v: regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]')), 1) AS whole_vin,
       CASE WHEN contains(upper(text), 'MSIG') THEN 'MSIG' WHEN contains(upper(text), 'AXA') THEN 'AXA' END AS company_code FROM documents""",
)
def ext_1b(spark, sf):
    whole = F.filter(F.regexp_extract_all(F.upper("text"), F.lit(r"\b([A-Z0-9]{17})\b"), F.lit(1)), lambda v: v.rlike("[A-Z]") & v.rlike("[0-9]"))
    return R.table(spark, sf, "documents").select("doc_id", F.get(whole, F.lit(0)).alias("whole_vin"), RU.insurer_by_marker(F.col("text")).alias("company_code"))


@query(
    "ext_1c_older_schedule_fields",
    """SELECT doc_id, truth_number AS policy_number, truth_company AS company_code, truth_name AS insured_name, truth_address AS insured_address, truth_plate AS license_plate,
       truth_chassis AS chassis_no, truth_make AS car_make, truth_model AS car_model, truth_year AS car_year, truth_start AS coverage_start, truth_end AS coverage_end,
       truth_net AS net_premium, truth_stamp AS stamp_duty, truth_vat AS vat, truth_total AS total_premium, truth_broker AS broker_name, truth_license AS broker_license FROM older_schedules""",
)
def ext_1c(spark, sf):
    df = OL.read_older_fields(R.older_schedules(spark, sf).select("doc_id", "text", "filename"), filename="filename").drop("text", "filename")
    return as_text(as_double(df, *MONEY), "coverage_start", "coverage_end").withColumn("car_year", F.col("car_year").cast("long"))


@query(
    "ext_2_label_values",
    """SELECT doc_id, concat_ws('|', trim(regexp_extract(text, 'Stamp Duty ([^\\n]*)', 1)), regexp_extract(text, 'Stamp Duty [^\\n]*\\n([^\\n]*)', 1)) AS "values" FROM schedules""",
)
def ext_2(spark, sf):
    values = E.values_after(F.col("_lines"), ["stamp duty"])
    return R.schedules(spark, sf).select("doc_id", E.lines_of(F.col("text")).alias("_lines")).select("doc_id", F.array_join(values, "|").alias("values"))


@query(
    "ext_3_identifier_candidates",
    """SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(upper(text), '\\b[A-Z0-9]{11,18}\\b'),
         lambda v: regexp_matches(v, '(?:[A-Z][^A-Z]*){3}') AND regexp_matches(v, '[0-9]')))), ',') AS vins,
       array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(upper(text), '\\bD[O0]-\\d{2}-\\d{2}\\s*/\\s*\\d{4,8}\\b'), lambda v: replace(regexp_replace(v, '\\s+', '', 'g'), 'DO-', 'D0-')))), ',') AS numbers
       FROM (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, text FROM schedules)""",
)
def ext_3(spark, sf):
    texts = R.table(spark, sf, "documents").select("doc_id", "text").unionByName(R.schedules(spark, sf).select("doc_id", "text"))
    return texts.select(
        "doc_id", F.array_join(E.vin_candidates(F.col("text")), ",").alias("vins"), F.array_join(E.pair_numbers(F.col("text")), ",").alias("numbers")
    )


@query(
    "ext_4_identity_tokens",
    f"""SELECT doc_id, cast(len(t) as bigint) AS tokens, list_min(t) AS first_token, list_max(t) AS last_token FROM
       (SELECT doc_id, list_filter(list_distinct(regexp_extract_all(upper(replace(text, 'ß', 'SS')), '[A-Z0-9]{{3,}}|[ก-๙]{{3,}}')), lambda v: v NOT IN ({", ".join(repr(w.upper()) for w in X.STOP_WORDS)})) AS t FROM documents)""",
)
def ext_4(spark, sf):
    df = R.table(spark, sf, "documents").select("doc_id", X.identity_tokens("text").alias("t"))
    return df.select("doc_id", F.size("t").cast("long").alias("tokens"), F.array_min("t").alias("first_token"), F.array_max("t").alias("last_token"))


# -- validation ------------------------------------------------------------------------------------------------------
@query(
    "val_1_field_sanity",
    """WITH r AS (SELECT id, CASE WHEN contains(insured_name, 'อิเล็กทรอนิกส์') THEN NULL ELSE insured_name END AS insured_name, CASE WHEN chassis_no LIKE 'Q%' THEN NULL ELSE chassis_no END AS chassis_no,
         nullif(stamp_duty, 0) AS s, nullif(vat, 0) AS v, net_premium, total_premium, stamp_duty, vat, coverage_start, coverage_end FROM ledgers),
       b AS (SELECT *, coalesce(abs(net_premium + s + v - total_premium) > greatest(1, total_premium * 0.02), false) AS bad FROM r)
       SELECT id, insured_name, chassis_no, cast(CASE WHEN NOT bad THEN net_premium END as double) AS net_premium, cast(CASE WHEN NOT bad THEN s END as double) AS stamp_duty,
         CASE WHEN coverage_end > coverage_start THEN cast(coverage_start as string) END AS coverage_start,
         concat_ws(',', CASE WHEN insured_name IS NULL THEN 'name' END, CASE WHEN chassis_no IS NULL THEN 'vin' END, CASE WHEN stamp_duty = 0 OR vat = 0 THEN 'amount' END, CASE WHEN bad THEN 'sum' END,
           CASE WHEN coverage_end <= coverage_start THEN 'period' END) AS warnings FROM b""",
)
def val_1(spark, sf):
    df = V.field_sanity(R.ledgers(spark, sf)).withColumn("warnings", F.array_join("warnings", ","))
    df = df.select("id", "insured_name", "chassis_no", "net_premium", "stamp_duty", "coverage_start", "warnings")
    return as_text(as_double(df, "net_premium", "stamp_duty"), "coverage_start")


@query(
    "val_2_atomic_groups",
    """WITH c AS (SELECT *, coalesce(net_premium > 0 AND total_premium > 0 AND abs(net_premium + stamp_duty + vat - total_premium) <= 0.01, false) AS m,
         date_diff('day', coverage_start, coverage_end) BETWEEN 1 AND 730 AS p FROM ledgers)
       SELECT id, cast(CASE WHEN m THEN net_premium END as double) AS net_premium, cast(CASE WHEN m THEN total_premium END as double) AS total_premium, CASE WHEN p THEN cast(coverage_end as string) END AS coverage_end FROM c""",
)
def val_2(spark, sf):
    df = V.atomic_groups(R.ledgers(spark, sf)).select("id", "net_premium", "total_premium", "coverage_end")
    return as_text(as_double(df, "net_premium", "total_premium"), "coverage_end")


@query(
    "val_3_premium_ledger",
    """WITH c AS (SELECT *, coalesce(commission_baht, cast(round(coalesce(net_premium, 0) * coalesce(commission_pct, 0) * cast('0.01' as decimal(4,2)), 2) as decimal(18,2))) AS cb FROM
           (SELECT * REPLACE (cast(net_premium as decimal(18,2)) AS net_premium) FROM ledgers)),
       w AS (SELECT *, cast(round(cb * cast('0.10' as decimal(4,2)), 2) as decimal(18,2)) AS wh FROM c)
       SELECT id, coalesce(abs(net_premium + stamp_duty + vat - total_premium) > 0.02, false) AS rejected, cast(wh as double) AS wht_10pct,
         cast(total_premium + coalesce(paired_prb_total, 0) - prepaid_tax_1pct - cb + wh as double) AS collected_amount FROM w""",
)
def val_3(spark, sf):
    df = R.ledgers(spark, sf).withColumns(
        {"wht_10pct": F.lit(None).cast("decimal(18,2)"), "rounding": F.lit(None).cast("decimal(18,2)")}
    )
    out = V.premium_ledger(df).select("id", "rejected", "wht_10pct", "collected_amount")
    return as_double(out, "wht_10pct", "collected_amount")


@query(
    "val_4_commit_checks",
    """WITH i AS (SELECT cast(user_id as string) AS batch_id, event_id AS item_id, event_id AS main_file_id, CASE WHEN event_type = 'purchase' THEN event_id + 1 END AS prb_file_id, event_type, ts FROM events),
       u AS (SELECT batch_id, f, count(*) AS n FROM (SELECT batch_id, main_file_id AS f FROM i UNION ALL SELECT batch_id, prb_file_id FROM i WHERE prb_file_id IS NOT NULL) GROUP BY 1, 2),
       s AS (SELECT DISTINCT cast(user_id as string) AS batch_id, event_id AS f FROM events),
       m AS (SELECT i.*, coalesce(um.n > 1, false) OR (prb_file_id IS NOT NULL AND (sp.f IS NULL OR up.n > 1)) AS wrong FROM i LEFT JOIN u um ON um.batch_id = i.batch_id AND um.f = i.main_file_id
         LEFT JOIN u up ON up.batch_id = i.batch_id AND up.f = i.prb_file_id LEFT JOIN s sp ON sp.batch_id = i.batch_id AND sp.f = i.prb_file_id)
       SELECT batch_id, item_id, concat_ws(',', CASE WHEN wrong THEN 'file' END, CASE WHEN event_type = 'view' THEN 'doc_type' END, CASE WHEN event_type = 'error' THEN 'renewal_fields' END,
         CASE WHEN event_type IN ('purchase', 'signup') AND extract(hour FROM ts) < 6 THEN 'required_fields' END) AS errors FROM m""",
)
def val_4(spark, sf):
    ev = R.table(spark, sf, "events")
    items = ev.selectExpr(
        "cast(user_id as string) AS batch_id", "event_id AS item_id", "event_id AS main_file_id", "case when event_type = 'purchase' then event_id + 1 end AS prb_file_id",
        "case event_type when 'view' then cast(null as string) when 'error' then 'renewal_notice' when 'click' then 'receipt' else 'motor_main' end AS doc_type",
        "case when event_type = 'error' then '' else 'N' end AS policy_number", "case when hour(ts) >= 6 then 'name' end AS insured_name",
        "cast(ts as date) AS coverage_start", "date_add(cast(ts as date), 365) AS coverage_end", "'V' AS chassis_no", "cast(null as string) AS prb_chassis_no", "cast(ts as date) AS prb_coverage_start",
    )
    staged = ev.selectExpr("cast(user_id as string) AS batch_id", "event_id AS file_id")
    return V.commit_checks(items, staged).select("batch_id", "item_id", F.array_join("errors", ",").alias("errors"))


# -- consensus and scores --------------------------------------------------------------------------------------------
_READS = """SELECT l_orderkey AS doc_id, 'net_premium' AS field, l_linenumber * 1000 + l_suppkey AS read_no, l_partkey AS p,
    CASE WHEN l_linenumber > 5 THEN cast(l_suppkey as string) ELSE concat(cast(cast(l_quantity as int) as string), '.00') END AS text, 60 + l_linenumber * 5 AS conf FROM lineitem"""


@query(
    "agg_14_read_consensus",
    f"""WITH r AS ({_READS}), g AS (SELECT doc_id, count(*) AS n, count(CASE WHEN text LIKE '%.00' THEN 1 END) AS ok, min(CASE WHEN text LIKE '%.00' THEN text END) AS lo, max(CASE WHEN text LIKE '%.00' THEN text END) AS hi, min(conf) AS mc, count(DISTINCT text) AS alts FROM r GROUP BY 1)
       SELECT doc_id, CASE WHEN n >= 2 AND ok = n AND lo = hi AND mc >= 75 THEN 'candidate' ELSE 'review' END AS status, CASE WHEN n >= 2 AND ok = n AND lo = hi AND mc >= 75 THEN lo END AS value, alts AS alternatives FROM g""",
)
def agg_14(spark, sf):
    reads = R.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS doc_id", "'net_premium' AS field", "l_linenumber * 1000 + l_suppkey AS read_no",
        "CASE WHEN l_linenumber > 5 THEN cast(l_suppkey as string) ELSE concat(cast(cast(l_quantity as int) as string), '.00') END AS text", "60 + l_linenumber * 5 AS min_confidence",
    )
    reads = reads.withColumn("norm", V.normal_read(F.col("field"), F.col("text")))
    out = V.consensus(reads, ["doc_id"], F.col("field"), "norm")
    return out.select("doc_id", "status", "value", F.size("alternatives").cast("long").alias("alternatives"))


@query(
    "agg_15_majority_identifier",
    """WITH r AS (SELECT l_orderkey AS doc_id, concat('MRH', lpad(cast(l_suppkey as string), 14, '0')) AS v, count(*) AS n FROM lineitem GROUP BY 1, 2),
       d AS (SELECT *, list_sum(list_transform(range(1, 18), lambda i: cast(substr(translate(v, 'MRH', '498'), cast(i as int), 1) as int) * [8,7,6,5,4,3,2,10,0,9,8,7,6,5,4,3,2][i])) % 11 AS rem FROM r),
       o AS (SELECT *, substr(v, 9, 1) = CASE WHEN rem = 10 THEN 'X' ELSE cast(cast(rem as int) as string) END AS ok FROM d)
       SELECT doc_id, CASE WHEN count(*) FILTER (ok) = 1 THEN min(v) FILTER (ok) WHEN count(*) FILTER (ok) > 0 OR max(n) >= 2 THEN min_by(v, {'a': -n, 'b': v}) END AS majority FROM o GROUP BY 1""",
)
def agg_15(spark, sf):
    reads = R.table(spark, sf, "lineitem").selectExpr("l_orderkey AS doc_id", "concat('MRH', lpad(cast(l_suppkey as string), 14, '0')) AS v")
    return V.majority_identifier(reads, "doc_id", "v")


@query(
    "agg_12_extraction_score",
    """SELECT status, count(*) AS fields FROM (SELECT CASE WHEN d.lang <> 'en' THEN 'withheld' WHEN (d.n_chars > 1000) = (l.quality = 1) THEN 'correct' ELSE 'incorrect' END AS status
       FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id) GROUP BY 1""",
)
def agg_12(spark, sf):
    docs = R.table(spark, sf, "documents")
    guess = F.when(F.col("lang") == "en", (F.length("text") > 1000).cast("int").cast("string"))
    parsed = docs.select("doc_id", F.lit("quality").alias("field"), guess.alias("value"))
    truth = R.table(spark, sf, "labels").select("doc_id", F.lit("quality").alias("field"), F.col("quality").cast("string").alias("value"))
    return V.score_against_truth(parsed, truth, ["doc_id", "field"]).groupBy("status").agg(F.count("*").alias("fields"))


@query(
    "agg_16_completeness",
    """WITH b AS (SELECT id, doc_type, least(0.95, (7 + CASE WHEN policy_number IS NOT NULL THEN 1 ELSE 0 END - CASE WHEN license_plate IS NULL THEN 1 ELSE 0 END) / 8.0::double) AS base,
         coalesce(abs(net_premium + stamp_duty + vat - total_premium) <= 1, false) AS adds FROM ledgers),
       u AS (SELECT id, adds, CASE WHEN doc_type = 'unknown' THEN greatest(0, base - 0.15) ELSE base END AS c FROM b)
       SELECT id, round(cast(CASE WHEN adds THEN least(0.98, c + 0.10) ELSE c END as double), 2) AS confidence FROM u""",
)
def agg_16(spark, sf):
    evidence = "doc_type policy_number license_plate chassis_no coverage_start coverage_end insured_name total_premium".split()
    return A.completeness(R.ledgers(spark, sf), evidence).select("id", "confidence")


# -- merging ---------------------------------------------------------------------------------------------------------
@query(
    "mrg_1_two_readers",
    """WITH f AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS v FROM orders),
       s AS (SELECT l_orderkey AS doc_id, CASE WHEN max(l_linenumber) > 3 THEN concat(' ', lower(min(o_orderpriority)), '!') ELSE max(l_returnflag) END AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
       SELECT f.doc_id, coalesce(s.v, f.v) AS value, CASE WHEN s.v IS NULL THEN 'kept' WHEN f.v IS NOT NULL AND lower(regexp_replace(f.v, '[^0-9A-Za-z]', '', 'g')) <> lower(regexp_replace(s.v, '[^0-9A-Za-z]', '', 'g')) THEN 'review' ELSE 'candidate' END AS status
       FROM f LEFT JOIN s ON f.doc_id = s.doc_id WHERE coalesce(s.v, f.v) IS NOT NULL""",
)
def mrg_1(spark, sf):
    orders, line = R.table(spark, sf, "orders"), R.table(spark, sf, "lineitem")
    first = orders.selectExpr("o_orderkey AS doc_id", "case when o_orderstatus <> 'P' then o_orderpriority end AS value")
    per = line.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("n"), F.max("l_returnflag").alias("flag"))
    second = per.join(orders, per.l_orderkey == orders.o_orderkey).selectExpr(
        "o_orderkey AS doc_id", "case when n > 3 then concat(' ', lower(o_orderpriority), '!') else flag end AS value"
    )
    return V.merge_readings(first, second, ["doc_id"])


@query(
    "mrg_1b_merge_warnings",
    """WITH l AS (SELECT id, net_premium, stamp_duty, vat, total_premium, l_linenumber AS n FROM (SELECT *, cast(split_part(id, '-', 2) as int) AS l_linenumber FROM ledgers)),
       v AS (SELECT id, 'stamp_duty' AS differs FROM l WHERE stamp_duty IS NOT NULL AND n = 1 UNION ALL SELECT id, 'total_premium' FROM l WHERE n = 3)
       SELECT l.id, coalesce(string_agg(v.differs, ',' ORDER BY v.differs), '') AS review_fields,
         (CASE WHEN any_value(abs(net_premium + coalesce(stamp_duty, 0) + CASE WHEN n = 1 THEN 1 ELSE 0 END + vat - (total_premium + CASE WHEN n = 3 THEN 2 ELSE 0 END)) > 1 AND (stamp_duty IS NOT NULL)) THEN 1 ELSE 0 END) + count(v.differs) AS warnings
       FROM l LEFT JOIN v ON l.id = v.id GROUP BY l.id""",
)
def mrg_1b(spark, sf):
    """Two readings of the four amounts; the second reads the stamp 1 higher on first lines and the total 2 higher on third."""
    df = R.ledgers(spark, sf).select("id", F.split_part("id", F.lit("-"), F.lit(2)).cast("int").alias("n"), *[F.col(a).cast("decimal(18,2)").alias(a) for a in V.AMOUNTS])
    more = {"stamp_duty": F.when(F.col("n") == 1, 1).otherwise(0), "total_premium": F.when(F.col("n") == 3, 2).otherwise(0)}
    second = df.withColumns({a: (F.col(a) + x).cast("decimal(18,2)") for a, x in more.items()})
    out = V.merge_warnings(V.merge_wide_readings(df, second, ["id"], V.AMOUNTS), ["id"])
    return out.select("id", F.array_join("review_fields", ",").alias("review_fields"), F.size("warnings").cast("long").alias("warnings"))


@query(
    "mrg_1c_verified_reading",
    """WITH l AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN 'motor_main' WHEN doc_id % 4 = 1 THEN 'motor_prb' ELSE 'fire' END AS doc_type FROM older_schedules),
       s AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN replace(truth_number, '/', ' / ') END AS n, CASE WHEN doc_id % 5 = 0 THEN 'ใหม่ 1' WHEN doc_id % 5 = 1 THEN truth_plate END AS p, truth_total + doc_id % 2 AS t FROM older_schedules WHERE doc_id % 9 <> 0)
       SELECT l.doc_id, doc_type, CASE WHEN doc_id_type = 'P' THEN 'FIRE' WHEN doc_type = 'motor_main' THEN 'M' WHEN doc_type = 'motor_prb' THEN 'P' END AS policy_type,
         coalesce(s.n, truth_number) AS policy_number, coalesce(s.p, truth_plate) AS license_plate, truth_stamp AS stamp_duty, truth_vat AS vat, coalesce(s.t, truth_total) AS total_premium, truth_net AS net_premium,
         concat_ws(',', CASE WHEN s.p = 'ใหม่ 1' THEN 'license_plate' END, CASE WHEN s.t <> truth_total THEN 'total_premium' END) AS review_fields,
         CASE WHEN s.p = 'ใหม่ 1' THEN 1 ELSE 0 END + CASE WHEN s.t <> truth_total THEN 1 ELSE 0 END + CASE WHEN abs(truth_net + truth_stamp + truth_vat - coalesce(s.t, truth_total)) > 1 THEN 1 ELSE 0 END AS warnings
       FROM (SELECT *, CASE WHEN doc_id % 10 = 0 THEN 'P' END AS doc_id_type FROM l) l LEFT JOIN s ON l.doc_id = s.doc_id""",
)
def mrg_1c(spark, sf):
    """The older reader's fields, and a second reading of some of them: blanks about the slash, other plates, totals 1 higher."""
    docs = R.older_schedules(spark, sf)
    first = OL.read_older_fields(docs.select("doc_id", "text", "filename"), filename="filename").selectExpr(
        "doc_id", "case doc_id % 4 when 0 then 'motor_main' when 1 then 'motor_prb' else 'fire' end AS doc_type",
        "case when doc_id % 10 = 0 then 'FIRE' end AS policy_type", "policy_number", "license_plate", *MONEY,
    )
    second = docs.filter("doc_id % 9 <> 0").selectExpr(
        "doc_id", "case when doc_id % 6 = 0 then replace(truth_number, '/', ' / ') end AS policy_number",
        "case when doc_id % 5 = 0 then 'ใหม่ 1' when doc_id % 5 = 1 then truth_plate end AS license_plate",
        "cast(truth_total + doc_id % 2 as decimal(18,2)) AS total_premium",
    )
    out = as_double(V.verified_reading(first, second, "doc_id", ["license_plate", "policy_number", "total_premium"]), *MONEY)
    return out.select(
        "doc_id", "doc_type", "policy_type", "policy_number", "license_plate", *MONEY,
        F.array_join("review_fields", ",").alias("review_fields"), F.size("warnings").cast("long").alias("warnings"),
    )


@query(
    "mrg_2_fill_missing",
    """SELECT p.id, coalesce(p.pdf_filename, a.id) AS pdf_filename, coalesce(p.pdf_size, a.pdf_size) AS pdf_size FROM policies p
       LEFT JOIN (SELECT policy_id, max(id) AS id, max(pdf_size) AS pdf_size FROM attachments GROUP BY 1) a ON a.policy_id = p.id""",
)
def mrg_2(spark, sf):
    first = R.policies(spark, sf).select("id", "pdf_filename", "pdf_size")
    second = R.attachments(spark, sf).groupBy(F.col("policy_id").alias("id")).agg(F.max("id").alias("pdf_filename"), F.max("pdf_size").alias("pdf_size"))
    return V.fill_missing(first, second, "id", ["pdf_filename", "pdf_size"])


@query("mrg_3_form_over_extract", "SELECT id, coalesce(pdf_filename, policy_number) AS label FROM policies")
def mrg_3(spark, sf):
    return R.policies(spark, sf).select("id", F.coalesce(F.nullif(F.trim("pdf_filename"), F.lit("")), "policy_number").alias("label"))


@query(
    "mrg_3b_form_labels",
    """SELECT o_orderkey AS id, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 'kept' END, CASE WHEN o_orderkey % 2 = 0 THEN 'พ.ร.บ. ปี ' || (year(o_orderdate) + 543) END, CASE WHEN o_orderkey % 2 = 1 THEN 'หนังสือแจ้งเตือนต่ออายุ' END) AS label,
       CASE WHEN o_orderkey % 5 = 0 THEN 'F' ELSE o_orderstatus END AS net FROM orders""",
)
def mrg_3b(spark, sf):
    """A form that gives some labels and sums, over what was read."""
    o = R.table(spark, sf, "orders")
    form = o.selectExpr("o_orderkey AS id", "case when o_orderkey % 3 = 0 then ' kept ' else ' ' end AS label", "case when o_orderkey % 2 = 0 then 'prb' else 'renewal_notice' end AS doc_type", "case when o_orderkey % 5 = 0 then 'F' else '' end AS net", "cast(null as date) AS coverage_start")
    extract = o.selectExpr("o_orderkey AS id", "o_orderstatus AS net", "cast(o_orderdate as date) AS coverage_start")
    return V.form_over_extract(form, extract, "id", ["net", "coverage_start"]).select("id", "label", "net")


@query(
    "mrg_4b_second_pass",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN 'first' ELSE o_orderstatus END AS value, CASE WHEN o_orderkey % 3 > 0 THEN 'candidate' ELSE 'review' END AS status FROM orders""",
)
def mrg_4b(spark, sf):
    """Chassis numbers of a first reading, every third blank or missing, and a second one over the whole page."""
    o = R.table(spark, sf, "orders")
    first = o.filter("o_orderkey % 6 > 0").selectExpr("o_orderkey AS id", "'chassis_no' AS field", "case when o_orderkey % 3 > 0 then 'first' else '' end AS value", "'candidate' AS status")
    return V.supplemented(first, o.selectExpr("o_orderkey AS id", "'chassis_no' AS field", "o_orderstatus AS value"), ["id"]).select("id", "value", "status")


@query(
    "mrg_4_trust_split",
    """WITH a AS (SELECT *, coalesce(abs(net_premium + stamp_duty + vat - total_premium) <= 0.01, false) AS ok FROM ledgers)
       SELECT field, status, count(*) AS rows, count(value) AS kept FROM (
         SELECT 'policy_number' AS field, policy_number AS value, 'candidate' AS status FROM a WHERE policy_number IS NOT NULL
         UNION ALL SELECT 'chassis_no', chassis_no, 'review' FROM a
         UNION ALL SELECT 'doc_type', NULL, 'withheld' FROM a
         UNION ALL SELECT 'net_premium', CASE WHEN ok THEN 'x' END, CASE WHEN ok THEN 'candidate' ELSE 'withheld' END FROM a
         UNION ALL SELECT 'stamp_duty', CASE WHEN ok THEN 'x' END, CASE WHEN ok THEN 'candidate' ELSE 'withheld' END FROM a WHERE stamp_duty IS NOT NULL
         UNION ALL SELECT 'vat', CASE WHEN ok THEN 'x' END, CASE WHEN ok THEN 'candidate' ELSE 'withheld' END FROM a
         UNION ALL SELECT 'total_premium', CASE WHEN ok THEN 'x' END, CASE WHEN ok THEN 'candidate' ELSE 'withheld' END FROM a) GROUP BY 1, 2""",
)
def mrg_4(spark, sf):
    fields = ["policy_number", "chassis_no", "doc_type", *MONEY]
    rows = R.ledgers(spark, sf).select("id", *fields)
    long = V.trust_split(rows, fields)
    return long.groupBy("field", "status").agg(F.count("*").alias("rows"), F.count("value").alias("kept"))


@query(
    "mrg_5_layered_overrides",
    """WITH m AS (SELECT policy_id AS id, max(doc_type) AS v FROM attachments WHERE doc_type <> 'photo' GROUP BY 1), o AS (SELECT policy_id AS id, min(id) AS v FROM attachments WHERE doc_type = 'photo' GROUP BY 1)
       SELECT p.id, coalesce(o.v, m.v, p.policy_type) AS value, CASE WHEN o.v IS NOT NULL THEN 'override' WHEN m.v IS NOT NULL THEN 'manifest' ELSE 'parsed' END AS origin
       FROM policies p LEFT JOIN m ON p.id = m.id LEFT JOIN o ON p.id = o.id UNION ALL SELECT l_orderkey, 'extra', 'by_hand' FROM lineitem WHERE l_quantity = 50""",
)
def mrg_5(spark, sf):
    a = R.attachments(spark, sf)
    parsed = R.policies(spark, sf).select("id", F.col("policy_type").alias("value"))
    manifest = a.filter("doc_type <> 'photo'").groupBy(F.col("policy_id").alias("id")).agg(F.max("doc_type").alias("value"))
    over = a.filter("doc_type = 'photo'").groupBy("policy_id").agg(F.min("id").alias("value")).withColumnRenamed("policy_id", "id")
    hand = R.table(spark, sf, "lineitem").filter("l_quantity = 50").select(F.col("l_orderkey").alias("id"), F.lit("extra").alias("value"))
    return V.exactly(V.layered(parsed, manifest, over, hand, ["id"]), parsed.count() + hand.count())


@query(
    "rte_2_commit_routing",
    """SELECT route, count(*) AS rows FROM (SELECT CASE WHEN a.doc_type NOT IN ('prb', 'receipt', 'invoice', 'endorsement', 'photo') THEN 'policy' WHEN p.id IS NOT NULL AND a.doc_type <> 'photo' THEN 'attachment' ELSE 'inbox' END AS route
       FROM attachments a LEFT JOIN policies p ON a.policy_id = p.id AND p.policy_type IN ('M', 'P')) GROUP BY 1""",
)
def rte_2(spark, sf):
    p = R.policies(spark, sf).filter("policy_type in ('M', 'P')").select(F.col("id").alias("parent_id"))
    kind = F.expr("case doc_type when 'prb' then 'motor_prb' when 'photo' then cast(null as string) else doc_type end")
    items = R.attachments(spark, sf).select("policy_id", kind.alias("doc_type")).join(p, F.col("policy_id") == F.col("parent_id"), "left")
    return V.route_commits(items).groupBy("route").agg(F.count("*").alias("rows"))


# -- scalar keys -----------------------------------------------------------------------------------------------------
@query(
    "fn_keys",
    """SELECT id, lower(replace(license_plate, ' ', '')) AS plate_key, upper(chassis_no) AS vin_key, regexp_replace(upper(policy_number), '[^A-Z0-9]', '', 'g') AS identifier_key,
       lower(replace(replace(insured_name, 'นาย', ''), ' ', '')) AS name_key, replace(regexp_replace(insured_name, '^นาย\\s*', ''), ' ', '') AS name_key_anchored,
       replace(replace(replace(insured_address, '/', ''), '-', ''), ' ', '') AS address_key, regexp_replace(replace(replace(insured_address, '/', ''), ' ', ''), '[0-9]', '', 'g') AS address_words,
       left(replace(replace(insured_address, '/', ''), ' ', ''), 12) AS address_12, lower(regexp_replace(policy_number, '[^0-9A-Za-z]', '', 'g')) AS comparison_key, upper(concat(car_make, 'CITY')) AS car_key,
       year(coverage_start) AS coverage_year, (year(coverage_end) + 543) % 100 AS be_year FROM policies""",
)
def fn_keys(spark, sf):
    return R.policies(spark, sf).select(
        "id",
        X.plate_key("license_plate").alias("plate_key"),
        X.vin_key("chassis_no").alias("vin_key"),
        X.identifier_key("policy_number").alias("identifier_key"),
        X.name_key("insured_name").alias("name_key"),
        X.name_key_anchored("insured_name").alias("name_key_anchored"),
        X.address_key("insured_address").alias("address_key"),
        X.address_words_key("insured_address").alias("address_words"),
        X.address_compact("insured_address", 12).alias("address_12"),
        X.comparison_key("policy_number").alias("comparison_key"),
        X.car_key("car_make", F.lit("City"), F.lit(None)).alias("car_key"),
        D.coverage_year("coverage_start").cast("long").alias("coverage_year"),
        D.be_two_digits("coverage_end", "coverage_start").cast("long").alias("be_year"),
    )


@query(
    "fn_dates",
    """SELECT id, cast(coverage_start as string) AS web, cast(coverage_start as string) AS document, cast(coverage_start as string) AS exported, year(coverage_start) + 543 AS be_start,
       concat_ws(',', cast(coverage_start as string), CASE WHEN coverage_end <> coverage_start THEN cast(coverage_end as string) END) AS in_text FROM policies""",
)
def fn_dates(spark, sf):
    dmy = lambda c: F.concat_ws("/", F.dayofmonth(c), F.month(c), F.year(c) + 543)
    thai = F.concat(F.dayofmonth("coverage_start"), F.lit(" "), F.get(F.array(*[F.lit(m) for m in D.THAI_MONTHS]), F.month("coverage_start") - 1), F.lit(" "), F.year("coverage_start") + 543)
    sentence = F.concat(F.lit("เริ่ม "), thai, F.lit(" ถึง "), dmy("coverage_end"))
    df = R.policies(spark, sf).select("id", dmy("coverage_start").alias("s"), thai.alias("t"), sentence.alias("x"), F.col("coverage_start").cast("string").alias("iso"))
    out = df.select(
        "id", D.date_web_form("s").alias("web"), D.date_document("t").alias("document"), D.date_export("s").alias("exported"),
        D.start_year_be("iso").cast("long").alias("be_start"), F.array_join(D.dates_in_text("x").cast("array<string>"), ",").alias("in_text"),
    )
    return as_text(out, "web", "document", "exported")


@query(
    "fn_numbers",
    """SELECT id, cast(total_premium as double) AS thai_number, cast(floor(total_premium) as bigint) AS via_double, CASE WHEN pdf_size > 0 THEN pdf_size END AS positive,
       CASE WHEN length(policy_number) <= 30 THEN policy_number END AS plausible, CASE WHEN coalesce(pdf_size, 0) <> 0 THEN cast(pdf_size as double) ELSE cast(total_premium as double) END AS first_nonzero FROM policies""",
)
def fn_numbers(spark, sf):
    thai = F.translate(F.format_number("total_premium", 2), "0123456789", X.THAI_DIGITS)
    size = F.coalesce(F.col("pdf_size"), F.lit(0))
    return R.policies(spark, sf).select(
        "id",
        N.to_double(thai).alias("thai_number"),
        N.to_int_via_double(F.col("total_premium").cast("string")).cast("long").alias("via_double"),
        N.legacy_int(size).cast("long").alias("positive"),
        N.plausible_policy_number("policy_number").alias("plausible"),
        N.first_nonzero(size.cast("double"), F.col("total_premium").cast("double")).alias("first_nonzero"),
    )


@query(
    "fn_28_storage_keys",
    """SELECT url, regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*/?', ''), '[?#].*$', '') AS key, CASE WHEN contains(url, '/storage/v1/object/public/docs/') THEN regexp_extract(url, '/storage/v1/object/public/docs/([^?#]*)', 1) END AS bucket_key
       FROM (SELECT url FROM pages UNION ALL SELECT pdf_url FROM policies WHERE pdf_url IS NOT NULL)""",
)
def fn_28(spark, sf):
    urls = R.table(spark, sf, "pages").select("url").unionByName(R.policies(spark, sf).select(F.col("pdf_url").alias("url"))).filter("url is not null")
    return urls.select("url", storage_key("url", "https://none.example").alias("key"), bucket_key("url", "docs").alias("bucket_key"))


_LEGACY = {
    "app": "concat(' ', cast(id as string), ' ')", "policy": "policy_number", "insurance": "company_code", "policytype": "policy_type", "namethai": "insured_name",
    "telephone": "''", "address1": "insured_address", "address2": "' '", "province": "'กรุงเทพ'", "license": "license_plate", "chasis": "chassis_no", "model": "car_make",
    "modelextend": "'x'", "modelyear": "cast(year(coverage_start) + 543 as string)", "damage": "cast(coalesce(pdf_size, 0) as string)",
    "datestart": "concat(cast(day(coverage_start) as string), '/', cast(month(coverage_start) as string), '/', cast(year(coverage_start) + 543 as string))",
    "dateend": "concat(cast(coverage_end as string), ' 00:00:00')", "netpremium": "cast(total_premium as string)", "stamp": "'0'", "agent": "'A1'",
}


@query(
    "fn_33_legacy_rows",
    """SELECT cast(id as string) AS app_number, concat(insured_address, ' กรุงเทพ') AS insured_address, cast(coverage_start as string) AS coverage_start, cast(coverage_end as string) AS coverage_end,
       cast(total_premium as double) AS net_premium, NULL AS stamp_csv, 0.0::double AS stamp_database, concat(car_make, ' x') AS model_csv, year(coverage_start) AS car_year, 'A1' AS broker_name,
       CASE WHEN coalesce(pdf_size, 0) = 0 THEN NULL ELSE cast(pdf_size as double) END AS sum_csv FROM policies""",
)
def fn_33(spark, sf):
    raw = R.policies(spark, sf).selectExpr(*[f"{_LEGACY.get(c, 'cast(null as string)')} AS {c}" for c in LEGACY_COLUMNS])
    csv = LG.map_rows(LG.with_policy_number(raw), "csv").select(
        "app_number", F.col("stamp_duty").alias("stamp_csv"), F.col("car_model").alias("model_csv"), F.col("sum_insured").alias("sum_csv"), F.col("car_year").cast("long").alias("car_year"), "broker_name"
    )
    base = LG.map_rows(raw, "database").select("app_number", "insured_address", "coverage_start", F.col("stamp_duty").alias("stamp_database"))
    export = LG.map_rows(raw, "export").select("app_number", "coverage_end", "net_premium")
    return as_text(csv.join(base, "app_number").join(export, "app_number"), "coverage_start", "coverage_end")


@query(
    "fn_34_typed_rows",
    """SELECT id AS _id, policy_number, NULL AS insured_name, cast(total_premium as double) AS total_premium, cast(floor(total_premium) as bigint) AS pdf_size, cast(coverage_start as string) AS coverage_start, true AS manually_edited FROM policies""",
)
def fn_34(spark, sf):
    raw = R.policies(spark, sf).selectExpr(
        "id AS _id", "concat(' ', policy_number, ' ') AS policy_number", "'test' AS insured_name", "format_number(total_premium, 2) AS total_premium",
        "cast(total_premium as string) AS pdf_size", "concat(cast(year(coverage_start) + 543 as string), substr(cast(coverage_start as string), 5)) AS coverage_start",
    )
    out = LG.typed_rows(raw)
    out = out.select("_id", "policy_number", "insured_name", F.col("total_premium").cast("double").alias("total_premium"), F.col("pdf_size").cast("long").alias("pdf_size"), "coverage_start", "manually_edited")
    return as_text(out, "coverage_start")
