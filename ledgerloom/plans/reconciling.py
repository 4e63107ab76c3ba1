"""Windows, reconciliation and table changes over the driver tables."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.functions.filenames import archive_folder, archive_name, bucket_key, storage_key
from ledgerloom.operators import aggregates as A, changes as C, filters as FL, reconcile as RC, windows as WN
from ledgerloom.plans import roles as R
from ledgerloom.plans.registry import query
from ledgerloom.schemas import ATTACHMENT_TYPES

BASE = "https://pub.r2.dev"


# -- windows ---------------------------------------------------------------------------------------------------------
@query(
    "win_1_document_dedupe",
    """WITH d AS (SELECT policy_id, doc_type, id, row_number() OVER (ORDER BY policy_id, created_at, id) AS pos, pdf_size,
         concat('D', cast(policy_id as string)) AS number FROM attachments)
       SELECT id, CASE WHEN pos > min(pos) OVER w THEN first_value(id) OVER (PARTITION BY number, doc_type, pdf_size > 50000 ORDER BY pos) END AS duplicate_of
       FROM d WINDOW w AS (PARTITION BY number, doc_type, pdf_size > 50000)""",
)
def win_1(spark, sf):
    docs = R.attachments(spark, sf).select(
        "id",
        F.concat(F.lit("D"), F.col("policy_id").cast("string")).alias("number"),
        "doc_type",
        (F.col("pdf_size") > 50000).alias("total"),
        F.struct("policy_id", "created_at", "id").alias("pos"),
    )
    return WN.mark_duplicates(docs, "number", "doc_type", "total", "pos", "id").select("id", "duplicate_of")


@query(
    "win_2_identical_file",
    """SELECT doc_id, sha256(text) AS sha256, CASE WHEN doc_id > min(doc_id) OVER w THEN min(doc_id) OVER w END AS same_file_as
       FROM documents WINDOW w AS (PARTITION BY sha256(text))""",
)
def win_2(spark, sf):
    docs = R.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return WN.first_seen(docs, ["sha256"], "doc_id", "doc_id", "same_file_as").select("doc_id", "sha256", "same_file_as")


@query(
    "win_3_latest_row",
    """SELECT customer_key, id, cast(coverage_start as string) AS coverage_start FROM
       (SELECT *, row_number() OVER (PARTITION BY customer_key ORDER BY coverage_start DESC, id DESC) AS rn FROM policies) WHERE rn = 1""",
)
def win_3(spark, sf):
    df = WN.last_per_key(R.policies(spark, sf), ["customer_key"], F.struct("coverage_start", "id"), ["id", "coverage_start"])
    return df.withColumn("coverage_start", F.col("coverage_start").cast("string"))


@query(
    "win_4_best_and_runner_up",
    """SELECT p.id, p.customer_key, (SELECT max(q.pdf_size) FROM (SELECT id, customer_key, coalesce(pdf_size, 0) AS pdf_size FROM policies) q
         WHERE q.customer_key = p.customer_key AND q.id <> p.id) AS best_other FROM policies p""",
)
def win_4(spark, sf):
    df = R.policies(spark, sf).select("id", "customer_key", F.coalesce("pdf_size", F.lit(0)).alias("pdf_size"))
    return WN.best_other(df, "customer_key", "pdf_size", "best_other").select("id", "customer_key", "best_other")


@query(
    "win_6_name_collisions",
    """SELECT path, CASE WHEN rn = 1 THEN name ELSE concat(left(name, length(name) - 4), '_', lpad(cast(rn - 1 as string), 4, '0'), '.pdf') END AS final_name
       FROM (SELECT path, name, row_number() OVER (PARTITION BY name ORDER BY path) AS rn FROM files)""",
)
def win_6(spark, sf):
    return WN.collision_names(R.files(spark, sf).select("path", "name"), "name", ["path"]).select("path", "final_name")


@query(
    "win_7_newest_n",
    "SELECT path, name, cast(modified as string) AS modified FROM files ORDER BY files.modified DESC, path LIMIT 200",
)
def win_7(spark, sf):
    df = R.files(spark, sf).orderBy(F.desc("modified"), "path").limit(200)
    return df.select("path", "name", F.col("modified").cast("string").alias("modified"))


@query(
    "win_9_ids_and_chunks",
    """SELECT batch_id, file_id, CASE WHEN rn < 10000 THEN lpad(cast(rn as string), 4, '0') ELSE cast(rn as string) END AS position_id,
         cast(floor(rn / 10) + 1 as bigint) AS chunk
       FROM (SELECT batch_id, file_id, row_number() OVER (PARTITION BY batch_id ORDER BY file_id) - 1 AS rn FROM papers)""",
)
def win_9(spark, sf):
    df = WN.position_ids(R.papers(spark, sf).select("batch_id", "file_id"), "batch_id", ["file_id"])
    return df.withColumn("chunk", F.col("chunk").cast("long"))


@query(
    "win_10_last_write_wins",
    """SELECT policy_id, id, pdf_size FROM (SELECT *, row_number() OVER (PARTITION BY policy_id ORDER BY created_at DESC, id DESC) AS rn
       FROM attachments) WHERE rn = 1""",
)
def win_10(spark, sf):
    return WN.last_per_key(R.attachments(spark, sf), ["policy_id"], F.struct("created_at", "id"), ["id", "pdf_size"])


# -- joins -----------------------------------------------------------------------------------------------------------
@query(
    "jn_1_inner_equi",
    """SELECT a.id, a.doc_type, p.policy_number, p.insured_name, p.license_plate FROM attachments a JOIN policies p ON p.id = a.policy_id
       WHERE a.pdf_url IS NOT NULL""",
)
def jn_1(spark, sf):
    a, p = R.attachments(spark, sf).filter("pdf_url is not null"), R.policies(spark, sf)
    return a.join(p, a.policy_id == p.id).select(a.id, a.doc_type, "policy_number", "insured_name", "license_plate")


@query(
    "jn_2_child_list",
    """SELECT id, doc_type, cast(created_at as string) AS created_at FROM attachments WHERE policy_id = 42
       ORDER BY attachments.created_at, id""",
)
def jn_2(spark, sf):
    df = FL.where_all(R.attachments(spark, sf), ("policy_id", "eq", 42)).orderBy("created_at", "id")
    return df.select("id", "doc_type", F.col("created_at").cast("string").alias("created_at"))


@query(
    "jn_3_existing_key_split",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem) THEN 'existing' ELSE 'new' END AS side FROM orders""",
)
def jn_3(spark, sf):
    incoming = R.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    new, old = RC.existing_split(incoming, R.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id")), "id")
    return new.withColumn("side", F.lit("new")).unionByName(old.withColumn("side", F.lit("existing")))


@query(
    "jn_4_reconcile_keys",
    """WITH l AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), r AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT')
       SELECT coalesce(l.k, r.k) AS key, CASE WHEN l.k IS NOT NULL AND r.k IS NOT NULL THEN 'both' WHEN r.k IS NULL THEN 'left_only' ELSE 'right_only' END AS side
       FROM l FULL OUTER JOIN r ON l.k = r.k""",
)
def jn_4(spark, sf):
    p = R.policies(spark, sf).withColumnRenamed("customer_key", "key")
    left = p.filter("manually_edited")
    return RC.key_presence(left, p.filter("policy_type = 'M'"), "key")


_LEGACY_SIDE = """SELECT policy_id AS id, concat('นาย ', doc_type) AS insured_name, min(coverage_start) AS coverage_start,
    cast(sum(net_premium) as decimal(18,2)) AS total_premium FROM attachments GROUP BY policy_id, doc_type"""


@query(
    "jn_5_field_mismatch",
    """WITH l AS (SELECT policy_id AS key, id AS pos, doc_type, coverage_start, net_premium FROM attachments),
       f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos) AS rn FROM l) WHERE rn = 1),
       r AS (SELECT id AS key, policy_type AS doc_type, coverage_start, total_premium AS net_premium FROM policies),
       j AS (SELECT f.key, f.doc_type AS ld, r.doc_type AS rd, f.coverage_start AS ls, r.coverage_start AS rs, f.net_premium AS ln, r.net_premium AS rn FROM f JOIN r ON f.key = r.key)
       SELECT key, 'doc_type' AS field, ld AS left_value, rd AS right_value FROM j WHERE ld <> rd
       UNION ALL SELECT key, 'coverage_start', cast(ls as string), cast(rs as string) FROM j WHERE ls <> rs
       UNION ALL SELECT key, 'net_premium', cast(ln as string), cast(rn as string) FROM j WHERE abs(ln - rn) > 0.01""",
)
def jn_5(spark, sf):
    left = R.attachments(spark, sf).select(F.col("policy_id").alias("key"), F.col("id").alias("pos"), "doc_type", "coverage_start", "net_premium")
    left = left.withColumn("pos", F.row_number().over(WN.W.partitionBy("key").orderBy("pos")))
    right = R.policies(spark, sf).select(
        F.col("id").alias("key"), F.lit(1).alias("pos"), F.col("policy_type").alias("doc_type"), "coverage_start", F.col("total_premium").alias("net_premium")
    )
    return RC.field_mismatch(left, right, "key", "pos", ["doc_type"], ["coverage_start"], ["net_premium"])


@query(
    "jn_6_orphan_objects",
    """SELECT object_key, size FROM objects WHERE modified <= TIMESTAMP '2001-01-01 00:00:00' AND object_key NOT IN
       (SELECT replace(regexp_extract(pdf_url, '^https://pub.r2.dev/([^?#]*)', 1), '%2D', '-') FROM attachments WHERE pdf_url IS NOT NULL)""",
)
def jn_6(spark, sf):
    urls = R.policies(spark, sf).select("pdf_url").unionByName(R.attachments(spark, sf).select("pdf_url")).filter("pdf_url is not null")
    keys = urls.filter(F.col("pdf_url").startswith(BASE)).select(storage_key("pdf_url", BASE).alias("object_key"))
    return RC.orphan_objects(R.objects(spark, sf), keys, datetime(2001, 1, 1)).select("object_key", "size")


@query(
    "jn_7_keep_delete_plan",
    """WITH k AS (SELECT replace(regexp_extract(pdf_url, '^https://pub.r2.dev/([^?#]*)', 1), '%2D', '-') AS object_key FROM attachments
         WHERE pdf_url IS NOT NULL AND doc_type <> 'other'
         UNION SELECT concat('attachments/', cast(id as string), '-1-1.pdf') FROM policies WHERE pdf_filename IS NOT NULL
           AND pdf_filename NOT IN (SELECT name FROM files WHERE name IS NOT NULL))
       SELECT CASE WHEN object_key IN (SELECT object_key FROM k) THEN 'keep' ELSE 'delete' END AS action, count(*) AS objects,
         cast(sum(size) as bigint) AS bytes FROM objects GROUP BY 1""",
)
def jn_7(spark, sf):
    a = R.attachments(spark, sf).filter("pdf_url is not null and doc_type <> 'other'")
    p = R.policies(spark, sf).filter("pdf_filename is not null")
    plan = RC.keep_and_delete(
        R.objects(spark, sf),
        a.select(storage_key("pdf_url", BASE).alias("object_key")),
        p.select(F.concat(F.lit("attachments/"), F.col("id").cast("string"), F.lit("-1-1.pdf")).alias("object_key"), "pdf_filename"),
        R.files(spark, sf).select(F.col("name").alias("pdf_filename")),
    )
    return RC.action_totals(plan)


@query(
    "jn_8b_every_hit",
    """SELECT f.path, h.origin, h.id FROM files f JOIN (SELECT pdf_filename AS name, 'policies' AS origin, cast(id as string) AS id FROM policies
         UNION ALL SELECT concat(p.pdf_filename), 'attachments', a.id FROM attachments a JOIN policies p ON a.policy_id = p.id AND a.doc_type = 'main') h ON f.name = h.name""",
)
def jn_8b(spark, sf):
    """Every record behind every file: policies, and the main attachments under their policy's file name."""
    policies = R.policies(spark, sf)
    own = policies.select(F.col("pdf_filename").alias("name"), F.lit("policies").alias("origin"), F.col("id").cast("string").alias("id"))
    mains = R.attachments(spark, sf).filter("doc_type = 'main'").select("policy_id", F.col("id").alias("att"))
    hung = mains.join(policies, F.col("policy_id") == policies.id).select(F.col("pdf_filename").alias("name"), F.lit("attachments").alias("origin"), F.col("att").alias("id"))
    return RC.file_hits(R.files(spark, sf).select("path", "name"), own.unionByName(hung), "name").select("path", "origin", "id")


@query(
    "jn_8_file_presence",
    """WITH h AS (SELECT pdf_filename AS name, count(*) AS n, min(id) AS first_id FROM policies WHERE pdf_filename IS NOT NULL GROUP BY 1)
       SELECT f.path, coalesce(h.n, 0) AS hits, h.first_id FROM files f LEFT JOIN h ON f.name = h.name""",
)
def jn_8(spark, sf):
    hits = R.policies(spark, sf).select(F.col("pdf_filename").alias("name"), F.lit("policies").alias("origin"), "id")
    df = RC.file_presence(R.files(spark, sf).select("path", "name"), hits, "name")
    return df.select("path", "hits", F.col("first_hit.id").alias("first_id"))


_DOCS = """SELECT a.id AS doc_id, CASE a.doc_type WHEN 'prb' THEN 'motor_prb' ELSE a.doc_type END AS doc_type,
    CASE WHEN a.pdf_size > 30000 THEN p.policy_number END AS policy_number, CASE WHEN a.discount > 0.05 THEN p.company_code END AS company_code,
    CASE WHEN a.tax > 0.02 THEN p.chassis_no END AS chassis_no, p.license_plate, CASE WHEN a.quantity > 10 THEN a.coverage_start END AS coverage_start
    FROM attachments a JOIN policies p ON a.policy_id = p.id"""


def _docs(spark, sf):
    a, p = R.attachments(spark, sf).alias("a"), R.policies(spark, sf).alias("p")
    return a.join(p, F.col("a.policy_id") == F.col("p.id")).selectExpr(
        "a.id AS doc_id",
        "CASE a.doc_type WHEN 'prb' THEN 'motor_prb' ELSE a.doc_type END AS doc_type",
        "CASE WHEN a.pdf_size > 30000 THEN p.policy_number END AS policy_number",
        "CASE WHEN a.discount > 0.05 THEN p.company_code END AS company_code",
        "CASE WHEN a.tax > 0.02 THEN p.chassis_no END AS chassis_no",
        "p.license_plate",
        "CASE WHEN a.quantity > 10 THEN a.coverage_start END AS coverage_start",
    )


@query(
    "jn_20_unique_parent",
    f"""WITH d AS ({_DOCS}),
       v AS (SELECT id, policy_type, chassis_no AS vin, replace(license_plate, ' ', '') AS plate, year(coverage_start) AS y, created_at FROM policies WHERE policy_type IN ('M', 'STY')),
       nv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vin ORDER BY created_at DESC, id) AS rn FROM v) WHERE rn <= 21),
       np AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY plate ORDER BY created_at DESC, id) AS rn FROM v) WHERE rn <= 21),
       c AS (
         SELECT d.doc_id, p.id, 'policy_number_exact' AS r FROM d JOIN policies p ON d.doc_type <> 'motor_prb' AND d.policy_number = p.policy_number AND (d.company_code IS NULL OR d.company_code = p.company_code)
         UNION ALL SELECT d.doc_id, p.id, 'chassis_and_year' FROM d JOIN nv p ON d.doc_type = 'motor_prb' AND d.chassis_no = p.vin AND (d.coverage_start IS NULL OR year(d.coverage_start) = p.y)
         UNION ALL SELECT d.doc_id, p.id, 'plate_and_year' FROM d JOIN np p ON d.doc_type = 'motor_prb' AND d.chassis_no IS NULL AND replace(d.license_plate, ' ', '') = p.plate AND (d.coverage_start IS NULL OR year(d.coverage_start) = p.y)),
       g AS (SELECT doc_id, count(*) AS n, min(id) AS id, min(r) AS r FROM c GROUP BY 1)
       SELECT d.doc_id, CASE WHEN g.n = 1 THEN g.id END AS parent_id,
         CASE WHEN g.n = 1 THEN g.r WHEN d.doc_type <> 'motor_prb' AND d.policy_number IS NULL THEN 'no_reference' ELSE 'not_unique' END AS reason
       FROM d LEFT JOIN g ON d.doc_id = g.doc_id""",
)
def jn_20(spark, sf):
    docs = _docs(spark, sf)
    out = RC.unique_parent(docs, R.policies(spark, sf), F.col, X.vin_key, lambda c: X.plate_key(c, drop_hyphen=True))
    return out.select("doc_id", "parent_id", "reason")


@query(
    "jn_22_exactly_one",
    f"""WITH d AS ({_DOCS}), n AS (SELECT regexp_replace(upper(policy_number), '[^A-Z0-9]', '', 'g') AS k, count(*) AS n, min(id) AS id FROM policies GROUP BY 1)
       SELECT d.doc_id, coalesce(n.n, 0) AS found, CASE WHEN n.n = 1 THEN n.id END AS policy_id
       FROM d LEFT JOIN n ON regexp_replace(upper(d.policy_number), '[^A-Z0-9]', '', 'g') = n.k""",
)
def jn_22(spark, sf):
    hit, miss = RC.exactly_one(_docs(spark, sf), R.policies(spark, sf), X.identifier_key)
    return hit.select("doc_id", "found", "policy_id").unionByName(miss.select("doc_id", "found"), allowMissingColumns=True)


@query(
    "jn_22b_newest_by_number",
    f"""WITH d AS ({_DOCS}), n AS (SELECT upper(replace(policy_number, ' ', '')) AS k, id, row_number() OVER (PARTITION BY upper(replace(policy_number, ' ', '')) ORDER BY created_at DESC, id DESC) AS rn FROM policies)
       SELECT d.doc_id, n.id AS policy_id FROM d LEFT JOIN n ON upper(replace(d.policy_number, ' ', '')) = n.k AND n.rn = 1""",
)
def jn_22b(spark, sf):
    return RC.newest_by_number(_docs(spark, sf), R.policies(spark, sf)).select("doc_id", "policy_id")


@query(
    "jn_23_two_key_fallback",
    f"""WITH d AS ({_DOCS}), n AS (SELECT policy_number, min(id) AS id FROM policies GROUP BY 1), l AS (SELECT license_plate, min(id) AS id FROM policies GROUP BY 1)
       SELECT d.doc_id, coalesce(n.id, l.id) AS policy_id, CASE WHEN n.id IS NOT NULL THEN 'policy_number' WHEN l.id IS NOT NULL THEN 'license_plate' END AS matched_by
       FROM d LEFT JOIN n ON d.policy_number = n.policy_number LEFT JOIN l ON d.license_plate = l.license_plate""",
)
def jn_23(spark, sf):
    return RC.coalesce_by_two_keys(_docs(spark, sf), R.policies(spark, sf)).select("doc_id", "policy_id", "matched_by")


@query(
    "jn_24_side_table_enrich",
    """SELECT p.id, n.n_name AS nation_name FROM policies p LEFT JOIN nation n ON p.company_code = concat('N', cast(n.n_nationkey as string))""",
)
def jn_24(spark, sf):
    side = R.table(spark, sf, "nation").selectExpr("concat(' N', cast(n_nationkey as string), ' ') AS company_code", "n_name AS nation_name", "n_nationkey AS _pos")
    return RC.enrich(R.policies(spark, sf).select("id", "company_code"), side, "company_code", ["nation_name"]).select("id", "nation_name")


@query(
    "jn_25_expected_vs_parsed",
    """SELECT a.id AS file, p.policy_number = concat('D0-70-', substr(p.policy_number, 7)) AS policy_number_exact, a.tax <= 0.02 OR a.discount > 0.03 AS chassis_no_exact,
       p.policy_number = concat('D0-70-', substr(p.policy_number, 7)) AND (a.tax <= 0.02 OR a.discount > 0.03) AS ready
       FROM attachments a JOIN policies p ON a.policy_id = p.id""",
)
def jn_25(spark, sf):
    a, p = R.attachments(spark, sf).alias("a"), R.policies(spark, sf).alias("p")
    j = a.join(p, F.col("a.policy_id") == F.col("p.id"))
    expected = j.selectExpr(
        "a.id AS file", "lower(concat('D0 70 ', substr(p.policy_number, 7))) AS policy_number", "CASE WHEN a.tax > 0.02 THEN p.chassis_no END AS chassis_no"
    )
    parsed = j.selectExpr("a.id AS file", "p.policy_number", "CASE WHEN a.discount > 0.03 THEN p.chassis_no END AS chassis_no")
    return RC.expected_against_parsed(expected, parsed, X.identifier_key_any_script)


@query(
    "agg_10_bytes_and_counts",
    """SELECT count(*) AS objects, cast(coalesce(sum(size), 0) as bigint) AS bytes FROM objects WHERE modified <= TIMESTAMP '2000-01-01 00:00:00'
       AND object_key NOT IN (SELECT replace(regexp_extract(pdf_url, '^https://pub.r2.dev/([^?#]*)', 1), '%2D', '-') FROM attachments WHERE pdf_url IS NOT NULL)""",
)
def agg_10(spark, sf):
    keys = R.attachments(spark, sf).filter("pdf_url is not null").select(storage_key("pdf_url", BASE).alias("object_key"))
    orphans = RC.orphan_objects(R.objects(spark, sf), keys, datetime(2000, 1, 1))
    return orphans.agg(F.count("*").alias("objects"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))


@query(
    "snk_7_copy_plan",
    """WITH t AS (SELECT name, length, modified FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY modified DESC, length DESC) AS rn FROM
         (SELECT pdf_filename AS name, pdf_size AS length, created_at AS modified FROM policies WHERE pdf_filename IS NOT NULL)) WHERE rn = 1)
       SELECT f.path, CASE WHEN t.name IS NULL THEN 'write' WHEN f.length = t.length THEN 'skip' ELSE 'overwrite' END AS action
       FROM files f LEFT JOIN t ON f.name = t.name""",
)
def snk_7(spark, sf):
    target = R.policies(spark, sf).filter("pdf_filename is not null").selectExpr("pdf_filename AS name", "pdf_size AS length", "created_at AS modified")
    return RC.copy_plan(R.files(spark, sf), target).select("path", "action")


# -- table changes ---------------------------------------------------------------------------------------------------
@query(
    "dml_1_insert",
    """SELECT o_orderkey AS id, o_orderstatus AS status, o_custkey AS customer FROM orders UNION ALL SELECT l_orderkey, l_linestatus, NULL FROM lineitem WHERE l_quantity > 45""",
)
def dml_1(spark, sf):
    base = R.table(spark, sf, "orders").selectExpr("o_orderkey AS id", "o_orderstatus AS status", "o_custkey AS customer")
    rows = R.table(spark, sf, "lineitem").filter("l_quantity > 45").selectExpr("l_orderkey AS id", "l_linestatus AS status", "l_tax AS unknown_column")
    return C.insert_rows(base, rows)


@query(
    "dml_2_update",
    "SELECT id, CASE WHEN policy_type = 'M' AND pdf_url IS NULL THEN 'needs_document' ELSE policy_type END AS policy_type FROM policies",
)
def dml_2(spark, sf):
    p = R.policies(spark, sf).select("id", "policy_type", "pdf_url")
    cond = (F.col("policy_type") == "M") & F.col("pdf_url").isNull()
    return C.update_rows(p, cond, policy_type=F.lit("needs_document")).select("id", "policy_type")


@query(
    "dml_3_delete_cascade",
    """SELECT 'policies' AS origin, count(*) AS rows FROM policies WHERE policy_type <> 'P'
       UNION ALL SELECT 'attachments', count(*) FROM attachments WHERE policy_id NOT IN (SELECT id FROM policies WHERE policy_type = 'P')""",
)
def dml_3(spark, sf):
    p = R.policies(spark, sf)
    parents, children = C.delete_with_children(p, R.attachments(spark, sf), p.filter("policy_type = 'P'"))
    count = lambda df, n: df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("origin"), "rows")
    return count(parents, "policies").unionByName(count(children, "attachments"))


_INCOMING = "SELECT l_orderkey AS id, l_quantity, l_shipdate, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'"


@query(
    "dml_4_protected_upsert",
    """WITH t AS (SELECT id, manually_edited FROM policies WHERE policy_type <> 'FIRE'), n AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R')
       SELECT CASE WHEN n.id IS NULL THEN 'kept' WHEN t.id IS NULL THEN 'insert' WHEN t.manually_edited THEN 'protected' ELSE 'update' END AS action, count(*) AS rows
       FROM t FULL OUTER JOIN n ON t.id = n.id GROUP BY 1""",
)
def dml_4(spark, sf):
    target = R.policies(spark, sf).filter("policy_type <> 'FIRE'").select("id", "manually_edited", "total_premium")
    incoming = R.attachments(spark, sf).filter("pdf_url is null").select(
        F.col("policy_id").alias("id"), F.col("net_premium").alias("total_premium"), F.struct("created_at", F.col("id").alias("i")).alias("pos")
    )
    return C.action_counts(C.protected_upsert(target, incoming, "id", "pos"))


@query(
    "dml_4b_upsert_result",
    """WITH t AS (SELECT id, manually_edited, total_premium FROM policies WHERE policy_type <> 'FIRE'),
       n AS (SELECT policy_id AS id, net_premium FROM (SELECT *, row_number() OVER (PARTITION BY policy_id ORDER BY created_at DESC, id DESC) AS rn FROM attachments WHERE pdf_url IS NULL) WHERE rn = 1)
       SELECT coalesce(t.id, n.id) AS id, coalesce(t.manually_edited, false) AS manually_edited,
         cast(CASE WHEN t.id IS NULL THEN n.net_premium WHEN n.id IS NULL OR t.manually_edited THEN t.total_premium ELSE n.net_premium END as double) AS total_premium
       FROM t FULL OUTER JOIN n ON t.id = n.id""",
)
def dml_4b(spark, sf):
    target = R.policies(spark, sf).filter("policy_type <> 'FIRE'").select("id", "manually_edited", "total_premium")
    incoming = R.attachments(spark, sf).filter("pdf_url is null").select(
        F.col("policy_id").alias("id"), F.col("net_premium").alias("total_premium"), F.struct("created_at", F.col("id").alias("i")).alias("pos")
    )
    out = C.apply_upsert(target, C.protected_upsert(target, incoming, "id", "pos"), "id")
    return out.withColumn("total_premium", F.col("total_premium").cast("double"))


@query(
    "dml_5_insert_pair_if_absent",
    """WITH i AS (SELECT id AS pair_id, concat(car_make, '-', cast(year(coverage_start) as string), '-', cast(customer_key as string)) AS policy_number, company_code, policy_type FROM policies),
       e AS (SELECT DISTINCT policy_number, company_code FROM i WHERE policy_type = 'FIRE'),
       m AS (SELECT i.*, CASE WHEN e.policy_number IS NOT NULL THEN 'exists' WHEN i.pair_id <> min(i.pair_id) OVER (PARTITION BY i.policy_number, i.company_code) THEN 'repeated' END AS reason
             FROM (SELECT * FROM i WHERE policy_type <> 'FIRE') i LEFT JOIN e ON i.policy_number = e.policy_number AND i.company_code = e.company_code)
       SELECT coalesce(reason, 'added') AS outcome, count(*) AS policies, cast(coalesce(sum(a.n), 0) as bigint) AS attachments
       FROM m LEFT JOIN (SELECT policy_id, count(*) AS n FROM attachments GROUP BY 1) a ON a.policy_id = m.pair_id AND m.reason IS NULL GROUP BY 1""",
)
def dml_5(spark, sf):
    rows = R.policies(spark, sf).selectExpr(
        "id AS pair_id", "concat(car_make, '-', cast(year(coverage_start) as string), '-', cast(customer_key as string)) AS policy_number", "company_code", "policy_type"
    )
    atts = R.attachments(spark, sf).select(F.col("policy_id").alias("pair_id"), "id")
    added, kids, rejected = C.insert_pairs(rows.filter("policy_type <> 'FIRE'"), atts, rows.filter("policy_type = 'FIRE'"), "pair_id")
    per_pair = kids.groupBy("pair_id").agg(F.count("*").alias("n"))
    every = added.withColumn("outcome", F.lit("added")).select("pair_id", "outcome").unionByName(rejected.select("pair_id", F.col("reason").alias("outcome")))
    return every.join(per_pair, "pair_id", "left").groupBy("outcome").agg(
        F.count("*").alias("policies"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("attachments")
    )


@query(
    "dml_6_sparse_patch",
    """WITH v AS (SELECT policy_id AS id, max_by(CASE WHEN doc_type <> 'other' THEN doc_type END, CASE WHEN doc_type <> 'other' THEN concat(cast(created_at as string), id) END) AS doc FROM attachments GROUP BY 1)
       SELECT p.id, coalesce(v.doc, p.policy_type) AS policy_type, v.doc IS NOT NULL AS patched FROM policies p LEFT JOIN v ON p.id = v.id""",
)
def dml_6(spark, sf):
    patch = R.attachments(spark, sf).select(
        F.col("policy_id").alias("id"),
        F.when(F.col("doc_type") == "other", F.lit("  ")).otherwise(F.col("doc_type")).alias("policy_type"),
        F.concat(F.col("created_at").cast("string"), "id").alias("pos"),
    )
    return C.sparse_patch(R.policies(spark, sf).select("id", "policy_type"), patch, "id", "pos", ["policy_type"])


@query(
    "dml_7_exact_corrections",
    """WITH c AS (SELECT policy_id AS id, max(pdf_size) AS new_value FROM attachments WHERE doc_type = 'photo' GROUP BY 1)
       SELECT c.id, count(p.id) AS hits, min(p.pdf_size) AS before, c.new_value AS after FROM c LEFT JOIN policies p ON p.id = c.id AND p.policy_type <> 'P' GROUP BY c.id, c.new_value""",
)
def dml_7(spark, sf):
    fixes = R.attachments(spark, sf).filter("doc_type = 'photo'").groupBy(F.col("policy_id").alias("id")).agg(F.max("pdf_size").alias("new_value"))
    report, _ = C.exact_corrections(R.policies(spark, sf).filter("policy_type <> 'P'").select("id", "pdf_size"), fixes, "id", "pdf_size")
    return report


@query(
    "dml_8_stub_parents",
    """WITH h AS (SELECT regexp_replace(upper(policy_number), '[^A-Z0-9]', '', 'g') AS k FROM policies WHERE policy_type = 'M')
       SELECT sha256(k) AS id, min(n) AS policy_number FROM (SELECT regexp_replace(upper(policy_number), '[^A-Z0-9]', '', 'g') AS k, policy_number AS n FROM policies
         WHERE policy_type <> 'FIRE') WHERE k NOT IN (SELECT k FROM h) GROUP BY k""",
)
def dml_8(spark, sf):
    p = R.policies(spark, sf)
    return C.stub_parents(p.filter("policy_type <> 'FIRE'"), p.filter("policy_type = 'M'"), X.identifier_key, "reference only").select("id", "policy_number")


@query(
    "dml_9_clear_links",
    """SELECT id, CASE WHEN pdf_filename IN (SELECT name FROM files) THEN NULL ELSE pdf_url END AS pdf_url,
       coalesce(pdf_filename IN (SELECT name FROM files), false) AS cleared FROM policies""",
)
def dml_9(spark, sf):
    p = R.policies(spark, sf).select("id", "pdf_url", "pdf_filename", "pdf_size")
    names = R.files(spark, sf).select(F.col("name").alias("pdf_filename"))
    return C.clear_links(p, names, ["pdf_url", "pdf_filename", "pdf_size"]).select("id", "pdf_url", "cleared")


@query(
    "dml_10_drop_unlinked",
    """SELECT count(*) AS before, count(*) FILTER (pdf_url IS NULL) AS deleted, count(*) FILTER (pdf_url IS NOT NULL) AS after FROM policies""",
)
def dml_10(spark, sf):
    return C.drop_unlinked(R.policies(spark, sf))[1]


@query(
    "dml_11_relocate_urls",
    """SELECT id, concat('https://pub.r2.dev/', regexp_extract(pdf_url, '/storage/v1/object/public/[^/?#]+/([^?#]+)', 1)) AS pdf_url, pdf_url AS old_url
       FROM policies WHERE contains(pdf_url, '/storage/v1/object/public/')""",
)
def dml_11(spark, sf):
    both = R.policies(spark, sf).select(F.col("id").cast("string").alias("id"), "pdf_url").unionByName(R.attachments(spark, sf).select("id", "pdf_url"))
    moved = C.relocate(both, "/storage/v1/object/public/", BASE)
    return moved.select(F.col("id").cast("long").alias("id"), "pdf_url", "old_url")


@query(
    "dml_12_retention",
    "SELECT path, cast(cast(modified as date) as string) AS backup_day FROM files WHERE date_diff('day', cast(modified as date), DATE '2001-06-01') > 60",
)
def dml_12(spark, sf):
    df = C.expired_backups(R.files(spark, sf), date(2001, 6, 1), 60)
    return df.select("path", F.col("backup_day").cast("string").alias("backup_day"))


@query(
    "dml_13_existence_check",
    "SELECT DISTINCT o_orderkey AS id, o_orderkey IN (SELECT l_orderkey FROM lineitem) AS found FROM orders",
)
def dml_13(spark, sf):
    ids = R.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return C.presence(ids, R.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id")))


@query(
    "dml_14_ledger_edit",
    """SELECT batch_id, state FROM (SELECT batch_id, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'removed' END AS state,
       row_number() OVER (PARTITION BY batch_id ORDER BY file_id DESC) AS rn FROM papers) WHERE rn = 1 AND state <> 'removed'""",
)
def dml_14(spark, sf):
    events = R.papers(spark, sf).selectExpr(
        "batch_id", "CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'removed' END AS state", "file_id"
    )
    return C.ledger_state(events, "batch_id", "file_id")


@query(
    "dml_15_delete_with_objects",
    """SELECT i.id, CASE WHEN p.id IS NULL THEN 'not_found' ELSE 'delete' END AS plan, nullif(regexp_extract(p.pdf_url, '/storage/v1/object/public/docs/([^?#]*)', 1), '') AS object_key
       FROM (SELECT DISTINCT policy_id AS id FROM attachments WHERE doc_type = 'photo') i LEFT JOIN policies p ON p.id = i.id AND p.policy_type <> 'M'""",
)
def dml_15(spark, sf):
    ids = R.attachments(spark, sf).filter("doc_type = 'photo'").select(F.col("policy_id").alias("id"))
    df = C.delete_with_objects(ids, R.policies(spark, sf).filter("policy_type <> 'M'"), lambda c: bucket_key(c, "docs"), [])
    return df.select("id", "plan", "object_key")


@query(
    "val_5_type_and_reference",
    """SELECT id, policy_id, 'doc_type' AS errors FROM attachments WHERE doc_type NOT IN
       ('main','prb','renewal_notice','endorsement','credit_note','invoice','receipt','other')""",
)
def val_5(spark, sf):
    df = C.bad_references(R.attachments(spark, sf), R.policies(spark, sf).select("id"), ATTACHMENT_TYPES)
    return df.select("id", "policy_id", F.array_join("errors", ",").alias("errors"))


@query(
    "fn_27c_upload_names",
    """WITH p AS (SELECT *, CASE WHEN customer_key % 5 = 0 THEN 'BURGLAR' WHEN customer_key % 5 = 1 THEN '3rd' WHEN customer_key % 5 = 2 THEN ' public ' ELSE policy_type END AS kind FROM policies)
       SELECT id, concat(CASE upper(trim(kind)) WHEN 'M' THEN concat(replace(license_plate, ' ', ''), ' กธ') WHEN 'P' THEN concat(replace(license_plate, ' ', ''), ' พรบ')
         WHEN 'FIRE' THEN concat(replace(insured_address, '/', ''), ' กธ') WHEN 'BURGLAR' THEN concat(replace(insured_address, '/', ''), ' กธ')
         WHEN 'PA' THEN concat(replace(insured_address, '/', ''), ' PA') WHEN '3RD' THEN concat(replace(insured_address, '/', ''), ' PA') WHEN 'PUBLIC' THEN concat(replace(insured_address, '/', ''), ' PA')
         ELSE concat(insured_name, ' กธ') END, '.', lpad(cast((year(coverage_end) + 543) % 100 as string), 2, '0'), '.pdf') AS file_name FROM p""",
)
def fn_27c(spark, sf):
    kind = F.expr("case customer_key % 5 when 0 then 'BURGLAR' when 1 then '3rd' when 2 then ' public ' else policy_type end")
    df = R.policies(spark, sf).withColumn("kind", kind)
    return df.select("id", archive_name("kind", "license_plate", "insured_address", "insured_name", "policy_number", "coverage_end", "coverage_start", uploads=True).alias("file_name"))


@query(
    "fn_27_archive_name_and_folder",
    """SELECT id, CASE policy_type WHEN 'M' THEN 'motor' WHEN 'P' THEN 'prb' WHEN 'FIRE' THEN 'fire' WHEN 'PA' THEN 'pa_ta' ELSE 'other' END AS folder,
         concat(CASE policy_type WHEN 'M' THEN concat(replace(license_plate, ' ', ''), ' กธ') WHEN 'P' THEN concat(replace(license_plate, ' ', ''), ' พรบ')
           WHEN 'FIRE' THEN concat(replace(insured_address, '/', ''), ' กธ') WHEN 'PA' THEN concat(replace(insured_address, '/', ''), ' PA') ELSE concat(insured_name, ' กธ') END,
           '.', lpad(cast((year(coverage_end) + 543) % 100 as string), 2, '0'), '.pdf') AS file_name FROM policies""",
)
def fn_27(spark, sf):
    name = archive_name("policy_type", "license_plate", "insured_address", "insured_name", "policy_number", "coverage_end", "coverage_start")
    return R.policies(spark, sf).select("id", archive_folder("policy_type").alias("folder"), name.alias("file_name"))
