"""Query surface: projections, filters, ordering, paging, counts and set operations."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.functions.filenames import url_class
from ledgerloom.operators import aggregates as A, filters as FL, windows as WN
from ledgerloom.operators.windows import global_positions
from ledgerloom.plans import roles as R
from ledgerloom.plans.registry import query
from ledgerloom.schemas import SUMMARY_COLUMNS
from ledgerloom.session import cut_lineage

TODAY = date(2000, 6, 15)
POLICY_VIEW = "id, policy_number, policy_type, insured_name, license_plate, cast(coverage_end as string) AS coverage_end"


def view(df):
    return df.selectExpr(*[c.strip() for c in POLICY_VIEW.split(", ")])


@query("src_1_table_scan", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def src_1(spark, sf):
    return R.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@query(
    "src_4_date_range_extract",
    f"SELECT {POLICY_VIEW} FROM policies WHERE policy_number IS NOT NULL AND coverage_start >= DATE '1998-01-01' "
    "AND coverage_start < DATE '2000-01-01'",
)
def src_4(spark, sf):
    return view(FL.starts_between(R.policies(spark, sf), "coverage_start", date(1998, 1, 1), date(2000, 1, 1), "id"))


@query(
    "flt_1_projection",
    "SELECT id, cast(created_at as string) AS created_at, policy_number, policy_type, insured_name, license_plate, chassis_no, "
    "cast(coverage_start as string) AS coverage_start, cast(coverage_end as string) AS coverage_end, "
    "cast(total_premium as double) AS total_premium, pdf_url, pdf_filename, pdf_size FROM policies",
)
def flt_1(spark, sf):
    df = FL.project(R.policies(spark, sf), SUMMARY_COLUMNS)
    return df.withColumns(
        {
            **{c: F.col(c).cast("string") for c in ("created_at", "coverage_start", "coverage_end")},
            "total_premium": F.col("total_premium").cast("double"),
        }
    )


@query(
    "flt_2_comparison",
    f"SELECT {POLICY_VIEW} FROM policies WHERE policy_type <> 'P' AND total_premium >= 100000 AND total_premium < 300000 "
    "AND id > 10 AND company_code = 'N3'",
)
def flt_2(spark, sf):
    return view(
        FL.where_all(
            R.policies(spark, sf),
            ("policy_type", "neq", "P"),
            ("total_premium", "gte", 100000),
            ("total_premium", "lt", 300000),
            ("id", "gt", 10),
            ("company_code", "eq", "N3"),
        )
    )


@query("flt_3_like", f"SELECT {POLICY_VIEW} FROM policies WHERE insured_name LIKE '%มั่นคง%' AND lower(policy_number) LIKE 'd0-70-%'")
def flt_3(spark, sf):
    return view(FL.where_all(R.policies(spark, sf), ("insured_name", "like", "%มั่นคง%"), ("policy_number", "ilike", "d0-70-%")))


@query("flt_4_null_tests", f"SELECT {POLICY_VIEW} FROM policies WHERE pdf_filename IS NULL AND NOT (pdf_url IS NULL)")
def flt_4(spark, sf):
    return view(FL.where_all(R.policies(spark, sf), ("pdf_filename", "is", None), ("pdf_url", "is", None, True)))


@query(
    "flt_5_membership",
    f"SELECT {POLICY_VIEW} FROM policies WHERE policy_type IN ('M', 'P') AND id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)",
)
def flt_5(spark, sf):
    keys = R.table(spark, sf, "lineitem").filter("l_quantity >= 49").select("l_orderkey")
    return view(FL.member_of(FL.where_all(R.policies(spark, sf), ("policy_type", "in", ["M", "P"])), "id", keys))


@query(
    "flt_6_disjunction",
    f"SELECT {POLICY_VIEW} FROM policies WHERE company_code = 'N1' OR license_plate LIKE '%77%' OR total_premium > 450000 "
    "OR (pdf_url IS NULL)",
)
def flt_6(spark, sf):
    return view(
        FL.where_any(
            R.policies(spark, sf),
            ("company_code", "eq", "N1"),
            ("license_plate", "ilike", "%77%"),
            ("total_premium", "gt", 450000),
            ("pdf_url", "is", None),
        )
    )


@query(
    "flt_7_search",
    f"SELECT {POLICY_VIEW} FROM policies WHERE contains(lower(replace(replace(license_plate, ' ', ''), '-', '')), '1กก12') "
    "OR contains(lower(insured_name), '1กก-12') OR contains(lower(policy_number), '1กก-12')",
)
def flt_7(spark, sf):
    return view(FL.search(R.policies(spark, sf), "1กก-12"))


def _status(name: str, condition: str):
    @query(f"flt_8_status_{name}", f"SELECT {POLICY_VIEW} FROM policies WHERE {condition}")
    def run(spark, sf):
        return view(FL.coverage_status(R.policies(spark, sf), name, TODAY))


_status("active", "coverage_end > DATE '2000-06-15'")
_status("expiring", "coverage_end >= DATE '2000-06-15' AND coverage_end <= DATE '2000-07-15'")
_status("expired", "coverage_end < DATE '2000-06-15'")


@query(
    "flt_9_date_window",
    f"SELECT {POLICY_VIEW} FROM policies WHERE coverage_end >= DATE '1999-01-01' AND coverage_end <= DATE '1999-12-31'",
)
def flt_9(spark, sf):
    return view(FL.end_window(R.policies(spark, sf), date(1999, 1, 1), date(1999, 12, 31)))


@query("flt_10_has_document", f"SELECT {POLICY_VIEW} FROM policies WHERE pdf_filename IS NOT NULL")
def flt_10(spark, sf):
    return view(FL.has_document(R.policies(spark, sf), True))


@query(
    "flt_11_category",
    f"SELECT {POLICY_VIEW} FROM policies WHERE policy_type IN ('PA','TA','3RD','PUBLIC','MISC','GOLF','MARINE')",
)
def flt_11(spark, sf):
    return view(FL.in_category(R.policies(spark, sf), "pa"))


@query("flt_12_point_lookup", f"SELECT {POLICY_VIEW} FROM policies WHERE id = 77")
def flt_12(spark, sf):
    return view(FL.where_all(R.policies(spark, sf), ("id", "eq", 77)))


@query(
    "flt_13_url_class",
    """SELECT CASE WHEN contains(pdf_url, 'drive.google.com/file/d/') THEN 'drive'
              WHEN contains(pdf_url, '/storage/v1/object/public/') THEN 'legacy_storage'
              WHEN contains(pdf_url, '.r2.dev/') THEN 'object_store' ELSE 'other' END AS url_class,
       count(*) AS rows FROM (SELECT pdf_url FROM policies UNION ALL SELECT url FROM pages) u GROUP BY 1""",
)
def flt_13(spark, sf):
    urls = R.policies(spark, sf).select("pdf_url").unionByName(R.table(spark, sf, "pages").select(F.col("url").alias("pdf_url")))
    return A.group_counts(urls, url_class("pdf_url").alias("url_class"))


@query(
    "flt_15_unprocessed",
    f"SELECT {POLICY_VIEW} FROM policies WHERE pdf_url IS NULL AND id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')",
)
def flt_15(spark, sf):
    done = R.table(spark, sf, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("id"))
    return view(FL.unprocessed(R.policies(spark, sf), done, "id", linked="pdf_url"))


@query(
    "flt_16_outlier_split",
    """SELECT CASE WHEN year(coverage_start) BETWEEN 1996 AND 2000 THEN 'valid' ELSE 'outlier' END AS side,
       year(coverage_start) AS start_year, count(*) AS rows FROM policies GROUP BY 1, 2""",
)
def flt_16(spark, sf):
    valid, outlier = FL.split_years(R.policies(spark, sf), "coverage_start", 1996, 2000)
    both = valid.withColumn("side", F.lit("valid")).unionByName(outlier.withColumn("side", F.lit("outlier")))
    return both.groupBy("side", F.year("coverage_start").cast("long").alias("start_year")).agg(F.count("*").alias("rows"))


@query(
    "flt_17_batch_quota",
    """SELECT policy_id, count(*) AS files, max(pdf_size) AS largest, cast(sum(pdf_size) as bigint) AS total_bytes,
       count(*) <= 5 AND max(pdf_size) <= 90000 AND sum(pdf_size) <= 250000 AS accepted FROM attachments GROUP BY policy_id""",
)
def flt_17(spark, sf):
    return FL.batch_quota(R.attachments(spark, sf), "policy_id", "pdf_size", 5, 90000, 250000)


@query(
    "flt_18_whitelist",
    """SELECT event_id, 1 AS kept, 'event_type' AS dropped, regexp_extract(props, '"k": ([0-9]+)', 1) AS k FROM events""",
)
def flt_18(spark, sf):
    events = R.table(spark, sf, "events").select(
        "event_id", F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("event_type"), F.col("event_type"))).alias("fields")
    )
    kept = FL.whitelist(events, "fields", ["k", "user_id"])
    return kept.select(
        "event_id", F.size("fields").alias("kept"), F.array_join("dropped", ",").alias("dropped"), F.col("fields")["k"].alias("k")
    )


@query(
    "srt_1_order_by",
    "SELECT id, coverage_end_text AS coverage_end, row_number() OVER (ORDER BY coverage_end_text, id) AS place FROM "
    "(SELECT id, cast(coverage_end as string) AS coverage_end_text FROM policies)",
)
def srt_1(spark, sf):
    df = R.policies(spark, sf).select("id", F.col("coverage_end").cast("string").alias("coverage_end"))
    return global_positions(df, ["coverage_end", "id"], "place")


@query(
    "srt_2_page",
    f"SELECT {POLICY_VIEW} FROM policies ORDER BY coverage_start DESC, id LIMIT 50 OFFSET 100",
)
def srt_2(spark, sf):
    return view(FL.page(FL.ordered(R.policies(spark, sf), "coverage_start"), 3, 50))


@query("srt_3_nulls_last", "SELECT id, pdf_size, row_number() OVER (ORDER BY pdf_size DESC NULLS LAST, id) AS position FROM policies")
def srt_3(spark, sf):
    """Every row with its place; the sorted rows are written, and each file's rows are numbered in turn."""
    rows = R.policies(spark, sf).select("id", "pdf_size")
    ranged = FL.newest_first_nulls_last(rows, "pdf_size", "id").withColumn("_part", F.spark_partition_id())
    return WN.number_in_partitions(cut_lineage(ranged), [F.desc_nulls_last("pdf_size"), "id"], "position")


@query(
    "srt_4_top_k",
    "SELECT company_code, count(*) AS rows FROM policies GROUP BY 1 ORDER BY rows DESC, company_code LIMIT 15",
)
def srt_4(spark, sf):
    return A.group_counts(R.policies(spark, sf), F.col("company_code")).orderBy(F.desc("rows"), "company_code").limit(15)


@query("srt_5_sample", "SELECT path, name, length FROM files ORDER BY sha256(concat(path, '|42')), path LIMIT 300")
def srt_5(spark, sf):
    """300 files by keyed hash."""
    return FL.repeatable_sample(R.files(spark, sf).select("path", "name", "length"), ["path"], 300)


@query("agg_1_exact_count", "SELECT count(*) AS total FROM policies WHERE coverage_end > DATE '2000-06-15'")
def agg_1(spark, sf):
    return FL.coverage_status(R.policies(spark, sf), "active", TODAY).agg(F.count("*").alias("total"))


@query(
    "agg_2_latest_per_customer",
    """SELECT id, policy_number, insured_name, coverage_start, history_count FROM (
        SELECT id, policy_number, insured_name, cast(coverage_start as string) AS coverage_start,
          cast(sum(doc) OVER (PARTITION BY lower(trim(insured_name))) - doc as bigint) AS history_count,
          row_number() OVER (PARTITION BY lower(trim(insured_name)) ORDER BY coverage_start DESC, id) AS rn
        FROM (SELECT *, CASE WHEN pdf_url IS NOT NULL OR pdf_filename IS NOT NULL OR coalesce(pdf_size, 0) <> 0 THEN 1 ELSE 0 END AS doc
              FROM policies)) WHERE rn = 1""",
)
def agg_2(spark, sf):
    df = A.latest_per_customer(R.policies(spark, sf), ["id", "policy_number", "insured_name", "coverage_start"])
    return df.withColumn("coverage_start", F.col("coverage_start").cast("string"))


@query(
    "agg_3_status_counters",
    """SELECT count(*) AS total, count(*) FILTER (coverage_end > DATE '2000-06-15') AS active,
       count(*) FILTER (coverage_end > DATE '2000-06-15' AND coverage_end <= DATE '2000-07-15') AS expiring FROM policies""",
)
def agg_3(spark, sf):
    return A.status_counters(R.policies(spark, sf), TODAY)


@query("agg_4_group_counts", "SELECT year(coverage_start) AS start_year, policy_type, count(*) AS rows FROM policies GROUP BY 1, 2")
def agg_4(spark, sf):
    return A.group_counts(R.policies(spark, sf), F.year("coverage_start").cast("long").alias("start_year"), F.col("policy_type"))


@query(
    "agg_5_count_distinct",
    """SELECT count(DISTINCT nullif(trim(license_plate), '')) AS plates,
       count(DISTINCT CASE WHEN year(coverage_start) >= 2000 THEN nullif(trim(license_plate), '') END) AS recent_plates,
       count(DISTINCT nullif(trim(insured_name), '')) AS names FROM policies""",
)
def agg_5(spark, sf):
    recent = F.when(F.year("coverage_start") >= 2000, F.col("license_plate"))
    return R.policies(spark, sf).agg(
        *A.filled_distinct(plates=F.col("license_plate"), recent_plates=recent, names=F.col("insured_name"))
    )


@query(
    "agg_6_duplicate_census",
    """SELECT count(*) AS duplicate_keys, cast(coalesce(sum(n), 0) as bigint) AS duplicate_rows FROM
       (SELECT policy_id, doc_type, count(*) AS n FROM attachments GROUP BY 1, 2 HAVING count(*) > 1)""",
)
def agg_6(spark, sf):
    return A.duplicate_census(R.attachments(spark, sf), "policy_id", "doc_type")


@query(
    "agg_9_format_profile",
    """WITH v AS (SELECT regexp_matches(license_plate, '^[0-9]') AS leading_digit, contains(license_plate, ' ') AS has_blank,
         length(license_plate) AS length, license_plate AS value FROM policies),
       c AS (SELECT leading_digit, has_blank, length, count(*) AS rows FROM v GROUP BY 1, 2, 3 ORDER BY rows DESC, 1, 2, 3 LIMIT 15),
       e AS (SELECT leading_digit, has_blank, length, value, row_number() OVER (PARTITION BY leading_digit, has_blank, length ORDER BY value) AS rn
             FROM (SELECT DISTINCT * FROM v))
       SELECT c.leading_digit, c.has_blank, cast(c.length as bigint) AS length, c.rows, string_agg(e.value, ',' ORDER BY e.value) AS examples
       FROM c JOIN e ON c.leading_digit = e.leading_digit AND c.has_blank = e.has_blank AND c.length = e.length AND e.rn <= 5 GROUP BY 1, 2, 3, 4""",
)
def agg_9(spark, sf):
    df = A.format_profile(R.policies(spark, sf), "license_plate")
    return df.withColumns({"examples": F.array_join("examples", ","), "length": F.col("length").cast("long")})


@query(
    "agg_13_invoice_totals",
    """WITH s AS (SELECT policy_id, cast(sum(net_premium * quantity) as decimal(18,2)) AS net,
         cast(sum(cast(net_premium * tax as decimal(18,2))) as decimal(18,2)) AS stamp,
         cast(sum(cast(quantity * 10 as decimal(18,2))) as decimal(18,2)) AS other_fees,
         cast(sum(cast(net_premium * discount as decimal(18,2))) as decimal(18,2)) AS discount FROM attachments GROUP BY policy_id),
       v AS (SELECT *, cast(round((net + stamp + other_fees) * cast('0.07' as decimal(9,4)), 2) as decimal(18,2)) AS fv,
         cast(round((net + stamp + other_fees - discount) * cast('0.07' as decimal(9,4)), 2) as decimal(18,2)) AS lv FROM s)
       SELECT policy_id, cast(net as double) AS net, cast(fv as double) AS default_vat, cast(net + stamp + other_fees + fv as double) AS default_total,
         cast(fv as double) AS short_vat, cast(net + stamp + fv as double) AS short_total, cast(lv as double) AS long_vat,
         cast(net - discount + stamp + lv as double) AS long_total,
         cast(cast(round(net * cast('0.01' as decimal(9,4)), 2) as decimal(18,2)) as double) AS withholding,
         cast(cast(round(net * cast('0.18' as decimal(9,4)), 2) as decimal(18,2)) as double) AS commission FROM v""",
)
def agg_13(spark, sf):
    items = R.attachments(spark, sf).select(
        "policy_id",
        "quantity",
        F.col("net_premium").alias("unit_price"),
        (F.col("net_premium") * F.col("tax")).cast("decimal(18,2)").alias("stamp"),
        (F.col("quantity") * 10).cast("decimal(18,2)").alias("other_fees"),
        (F.col("net_premium") * F.col("discount")).cast("decimal(18,2)").alias("discount"),
    )
    totals = A.invoice_totals(items, "policy_id")
    names = "net default_vat default_total short_vat short_total long_vat long_total withholding commission".split()
    return totals.select("policy_id", *[F.col(n).cast("double").alias(n) for n in names])


@query(
    "agg_17_batch_history",
    """WITH f AS (SELECT batch_id, count(*) AS files, max(cast(day as string)) AS updated_at,
         bool_or(event_type = 'purchase' AND amount > 40) AS committed, bool_or(event_type = 'signup') AS done FROM papers GROUP BY 1)
       SELECT batch_id, updated_at, files, CASE WHEN committed THEN 'committed' WHEN done THEN 'review' ELSE 'processing' END AS status
       FROM f ORDER BY updated_at DESC, batch_id LIMIT 50""",
)
def agg_17(spark, sf):
    papers = R.papers(spark, sf)
    state = papers.select(
        "batch_id",
        F.col("day").cast("string").alias("updated_at"),
        ((F.col("event_type") == "purchase") & (F.col("amount") > 40)).alias("committed"),
        (F.col("event_type") == "signup").alias("done"),
    )
    return A.batch_history(papers, state)


@query(
    "agg_19_value_range",
    """SELECT cast(min(coverage_start) as string) AS first_start, cast(max(coverage_start) as string) AS last_start,
       cast(min(coverage_end) as string) AS first_end, cast(max(coverage_end) as string) AS last_end FROM policies""",
)
def agg_19(spark, sf):
    return R.policies(spark, sf).agg(
        *[
            f(c).cast("string").alias(n)
            for f, c, n in (
                (F.min, "coverage_start", "first_start"),
                (F.max, "coverage_start", "last_start"),
                (F.min, "coverage_end", "first_end"),
                (F.max, "coverage_end", "last_end"),
            )
        ]
    )


@query(
    "jn_26_active_entities",
    """SELECT license_plate AS entity, count(*) AS rows FROM policies WHERE license_plate IN
       (SELECT license_plate FROM policies WHERE year(coverage_start) BETWEEN 2000 AND 2001) GROUP BY 1""",
)
def jn_26(spark, sf):
    return A.active_entities(R.policies(spark, sf), F.col("license_plate"), 2000, 2001)


@query(
    "set_1_union",
    """SELECT origin, pdf_url FROM (SELECT 'policies' AS origin, pdf_url FROM policies UNION ALL SELECT 'attachments', pdf_url FROM attachments)
       WHERE pdf_url IS NOT NULL""",
)
def set_1(spark, sf):
    both = R.policies(spark, sf).select(F.lit("policies").alias("origin"), "pdf_url").unionByName(
        R.attachments(spark, sf).select(F.lit("attachments").alias("origin"), "pdf_url")
    )
    return both.filter("pdf_url is not null")


@query(
    "set_2_intersect",
    """SELECT 'plate' AS kind, replace(license_plate, ' ', '') AS value FROM policies WHERE year(coverage_start) = 1996
       INTERSECT SELECT 'plate', replace(license_plate, ' ', '') FROM policies WHERE year(coverage_start) = 2000
       UNION ALL (SELECT 'digits', regexp_extract(license_plate, '[0-9]{3,4}$') FROM policies WHERE year(coverage_start) = 1996
       INTERSECT SELECT 'digits', regexp_extract(license_plate, '[0-9]{3,4}$') FROM policies WHERE year(coverage_start) = 2000)""",
)
def set_2(spark, sf):
    def of(year, kind):
        df = R.policies(spark, sf).filter(F.year("coverage_start") == year)
        value = X.no_blanks("license_plate") if kind == "plate" else F.regexp_extract("license_plate", "[0-9]{3,4}$", 0)
        return df.select(F.lit(kind).alias("kind"), value.alias("value"))

    return of(1996, "plate").intersect(of(2000, "plate")).unionByName(of(1996, "digits").intersect(of(2000, "digits")))


@query("set_3_except", "SELECT o_orderkey AS id FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def set_3(spark, sf):
    return R.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")).subtract(
        R.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"))
    )


@query("set_4_distinct", "SELECT DISTINCT license_plate, company_code FROM policies")
def set_4(spark, sf):
    return R.policies(spark, sf).select("license_plate", "company_code").distinct()
