"""Sources, sinks and streams over the driver tables. Files go to a new scratch folder beside the checkpoints."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerloom.plans import roles as R
from ledgerloom.plans.registry import query
from ledgerloom.schemas import LEGACY
from ledgerloom.session import ensure_checkpoint_dir
from ledgerloom.sources import readers as RD, writers as WR
from ledgerloom.streaming import intake as IN


def scratch(spark) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/work-{uuid.uuid4().hex}"


@query(
    "src_6_object_listing",
    "SELECT event_id AS object_key, coalesce(try_cast(regexp_extract(props, '\"k\": ([0-9]+)', 1) as bigint), 0) AS size FROM events",
)
def src_6(spark, sf):
    raw = R.table(spark, sf, "events").select(F.col("event_id").alias("object_key"), F.regexp_replace("props", '"k"', '"size"').alias("metadata"), F.col("ts").alias("modified"))
    return RD.object_listing(raw).select("object_key", "size")


@query(
    "src_8_manifest_expand",
    """SELECT role, count(*) AS files FROM (SELECT 'main' AS role FROM policies WHERE policy_type = 'M' UNION ALL SELECT 'prb' FROM policies WHERE policy_type = 'M' UNION ALL SELECT 'standalone' FROM policies WHERE policy_type <> 'M') GROUP BY 1""",
)
def src_8(spark, sf):
    """One manifest per policy, with a pair or a standalone entry."""
    p = R.policies(spark, sf)
    pair = F.struct(
        F.col("id").cast("string").alias("pair_id"), F.lit("m.pdf").alias("main_file"), F.col("policy_number").alias("main_policy_number"),
        F.lit("p.pdf").alias("prb_file"), F.col("policy_number").alias("prb_policy_number"), "chassis_no",
    )
    alone = F.struct(F.lit("s.pdf").alias("file"), "policy_number", F.col("policy_type").alias("doc_type"), F.lit(None).cast("string").alias("note"))
    is_pair = F.col("policy_type") == "M"
    manifest = p.select(F.when(is_pair, F.array(pair)).alias("exact_pairs"), F.when(~is_pair, F.array(alone)).alias("standalone_policies"))
    return RD.expand_manifest(manifest).groupBy("role").agg(F.count("*").alias("files"))


@query("src_9_content_hash", "SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text)) AS length FROM documents")
def src_9(spark, sf):
    return R.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("length"))


@query("src_10_full_export", "SELECT cast(doc_id as string) AS doc_id, replace(replace(text, chr(10), ' '), chr(13), ' ') AS text FROM documents")
def src_10(spark, sf):
    return WR.clean_export(R.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


@query("snk_1_backup_lines", "SELECT 'orders' AS table_name, count(*) AS rows FROM orders UNION ALL SELECT 'customer', count(*) FROM customer")
def snk_1(spark, sf):
    counts = WR.write_backup({"orders": R.table(spark, sf, "orders"), "customer": R.table(spark, sf, "customer")}, f"{scratch(spark)}/backup")
    return counts.select(F.col("_table").alias("table_name"), "rows")


@query("snk_2_restore", "SELECT o_orderkey AS id, o_custkey, o_orderstatus FROM orders")
def snk_2(spark, sf):
    """Back up all orders, then append the backup to the open ones."""
    orders = R.table(spark, sf, "orders").selectExpr("o_orderkey AS id", "o_custkey", "o_orderstatus")
    path = f"{scratch(spark)}/backup"
    WR.write_backup({"orders": orders}, path)
    return WR.restored(orders.filter("o_orderstatus = 'O'"), RD.read_backup(spark, path, "orders", orders.schema), append=True)


@query(
    "snk_2b_restore_inferred",
    """SELECT 'orders' AS source, o_orderkey AS id, o_orderstatus AS text, o_custkey AS number FROM orders UNION ALL SELECT 'customer', c_custkey, c_name, c_nationkey FROM customer""",
)
def snk_2b(spark, sf):
    """Two tables of different shape backed up together and read back without a schema, as the line about the backup lists them."""
    tables = {"orders": R.table(spark, sf, "orders").selectExpr("o_orderkey", "o_orderstatus", "o_custkey"), "customer": R.table(spark, sf, "customer").selectExpr("c_custkey", "c_name", "c_nationkey")}
    path = f"{scratch(spark)}/backup"
    WR.write_backup(tables, path)
    names = RD.read_backup_meta(spark, path).first()["tables"]
    sides = [RD.read_backup_inferred(spark, path, n).toDF("id", "text", "number").selectExpr(f"'{n}' AS source", "cast(id as bigint) AS id", "text", "cast(number as bigint) AS number") for n in names]
    return sides[0].unionByName(sides[1])


@query("snk_3_snapshot", "SELECT id, policy_number, policy_type FROM policies")
def snk_3(spark, sf):
    path = WR.write_snapshot(R.policies(spark, sf).select("id", "policy_number", "policy_type"), scratch(spark), "v1")
    return RD.read_table(spark, path)


@query("snk_4_append_split", "SELECT CASE WHEN pdf_size IS NOT NULL THEN 'good' ELSE 'reject' END AS side, count(*) AS rows FROM policies GROUP BY 1")
def snk_4(spark, sf):
    base = scratch(spark)
    WR.append_valid(R.policies(spark, sf).select("id", "pdf_size"), F.col("pdf_size") > 0, f"{base}/good", f"{base}/reject")
    sides = [RD.read_table(spark, f"{base}/{s}").agg(F.count("*").alias("rows")).select(F.lit(s).alias("side"), "rows") for s in ("good", "reject")]
    return sides[0].unionByName(sides[1])


@query("snk_5_json_report", "SELECT o_orderstatus AS status, count(*) AS rows FROM orders GROUP BY 1")
def snk_5(spark, sf):
    path = f"{scratch(spark)}/report"
    WR.write_json_report(R.table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("rows")), path)
    return spark.read.schema("status string, rows long").json(path)


@query("snk_6_csv_report", "SELECT id, policy_number, insured_name FROM policies")
def snk_6(spark, sf):
    path = f"{scratch(spark)}/report"
    WR.write_csv_report(R.policies(spark, sf).select("id", "policy_number", "insured_name"), path, "id")
    return spark.read.schema("id long, policy_number string, insured_name string").option("header", True).csv(path)


def _arrivals(spark, sf):
    """events staged as arriving files; a batch expects five more files than it has when its user id is even."""
    events = R.papers(spark, sf).select("batch_id", F.col("file_id").cast("string").alias("file_id"), F.sha2("marker", 256).alias("sha256"))
    sizes = events.groupBy("batch_id").agg(F.count("*").alias("n"))
    expected = (F.col("n") + F.when(F.col("batch_id").cast("long") % 2 == 0, 5).otherwise(0)).cast("int")
    folder = f"{scratch(spark)}/in"
    events.join(sizes, "batch_id").select("batch_id", "file_id", "sha256", expected.alias("expected")).write.parquet(folder)
    return folder, spark.read.parquet(folder).schema


ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@query("str_1_incremental_intake", "SELECT batch_id, count(*) AS files FROM papers GROUP BY 1")
def str_1(spark, sf):
    folder, schema = _arrivals(spark, sf)
    base = scratch(spark)
    IN.process_new(IN.read_arrivals(spark, folder, schema), lambda b: b.select("batch_id", "file_id"), f"{base}/out", f"{base}/cp").awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("batch_id").agg(F.count("*").alias("files"))


@query("str_2_complete_batches", "SELECT batch_id, count(*) AS files FROM papers WHERE cast(batch_id as bigint) % 2 = 1 GROUP BY 1")
def str_2(spark, sf):
    folder, schema = _arrivals(spark, sf)
    base = scratch(spark)
    spark.conf.set(*ROCKSDB)
    done = IN.complete_batches(IN.read_arrivals(spark, folder, schema)).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp")
    done.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(IN.COMPLETE_BATCH).parquet(f"{base}/out").select("batch_id", F.col("files").cast("long").alias("files"))


@query("str_3_progress", "SELECT batch_id, count(*) AS done, CAST(count(*) + CASE WHEN cast(batch_id as bigint) % 2 = 0 THEN 5 ELSE 0 END AS bigint) AS total FROM papers GROUP BY batch_id")
def str_3(spark, sf):
    folder, schema = _arrivals(spark, sf)
    base = scratch(spark)
    IN.progress(IN.read_arrivals(spark, folder, schema), f"{base}/out", f"{base}/cp").awaitTermination()
    return IN.read_progress(spark, f"{base}/out").select("batch_id", "done", F.col("total").cast("long").alias("total"))


@query("str_4_first_seen", "SELECT sha256(marker) AS sha256, count(*) AS files FROM papers GROUP BY 1")
def str_4(spark, sf):
    """Distinct contents from the stream, then the files behind each."""
    folder, schema = _arrivals(spark, sf)
    base = scratch(spark)
    first = IN.first_arrivals(IN.read_arrivals(spark, folder, schema)).select("sha256")
    first.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start().awaitTermination()
    files = RD.read_table(spark, folder, schema).groupBy("sha256").agg(F.count("*").alias("files"))
    return spark.read.schema("sha256 string").parquet(f"{base}/out").join(files, "sha256")


@query(
    "str_4b_pointers",
    """SELECT file_id, CASE WHEN file_id > min(file_id) OVER (PARTITION BY marker) THEN min(file_id) OVER (PARTITION BY marker) END AS same_file_as FROM papers""",
)
def str_4b(spark, sf):
    """Files arrive in order of file_id, two files of rows to a micro-batch; each points at the first with its content."""
    base = scratch(spark)
    papers = R.papers(spark, sf).select("file_id", F.sha2("marker", 256).alias("sha256"))
    spark.conf.set(*ROCKSDB)
    early = papers.agg(F.percentile_approx("file_id", 0.5)).head()[0]
    for part in (F.col("file_id") <= F.lit(early), F.col("file_id") > F.lit(early)):
        papers.filter(F.coalesce(part, F.lit(True))).write.mode("append").parquet(f"{base}/in")
        IN.process_pointers(IN.read_arrivals(spark, f"{base}/in", papers.schema), f"{base}/out", f"{base}/cp").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("file_id", "same_file_as")


def _legacy_rows(spark, sf):
    """Policies as rows of the legacy export, with quotes, blanks and a row without number for each cancelled one."""
    p = R.policies(spark, sf)
    given = {"policy": F.when(~F.col("manually_edited"), F.col("policy_number")), "namethai": F.concat(F.lit('"'), "insured_name", F.lit('", x')), "address1": F.col("insured_address"), "license": F.col("license_plate"), "app": F.when(F.col("customer_key") % 2 == 0, F.col("customer_key").cast("string"))}
    return p.select(*[given.get(f.name, F.lit(None).cast("string")).alias(f.name) for f in LEGACY.fields])


_SHOWN = ["policy", "app", "namethai", "address1", "license"]
_LEGACY_ROWS = """SELECT CASE WHEN NOT manually_edited THEN policy_number END AS policy, CASE WHEN customer_key % 2 = 0 THEN cast(customer_key as string) END AS app,
    concat('"', insured_name, '", x') AS namethai, insured_address AS address1, license_plate AS license FROM policies"""


@query("src_2_legacy_utf16", f"SELECT * FROM ({_LEGACY_ROWS}) WHERE policy IS NOT NULL")
def src_2(spark, sf):
    """Written in UTF-16 and read back: rows with a policy number."""
    path = f"{scratch(spark)}/utf16"
    _legacy_rows(spark, sf).write.option("header", True).option("encoding", "UTF-16").option("quote", '"').option("escape", '"').csv(path)
    return RD.read_legacy_utf16(spark, path).select(*_SHOWN)


@query("src_3_legacy_bom", f"SELECT * FROM ({_LEGACY_ROWS}) WHERE policy IS NOT NULL OR app IS NOT NULL")
def src_3(spark, sf):
    """Written in UTF-8 and read back: rows with a policy or an application number."""
    path = f"{scratch(spark)}/utf8"
    WR.write_export(_legacy_rows(spark, sf), path, "policy", "app")
    return RD.read_legacy_bom(spark, path).select(*_SHOWN)


def _customer_files(spark, sf):
    """Customers of a nation, sorted, as one text file in the nation's folder."""
    path = f"{scratch(spark)}/files"
    lines = R.table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("value"))
    lines.repartition("nation").sortWithinPartitions("nation", "value").write.partitionBy("nation").text(path)
    return path


def _nation():
    return F.regexp_extract("path", r"nation=(\d+)", 1).cast("long").alias("nation")


@query("src_5_folder_listing", "SELECT cast(c_nationkey as bigint) AS nation, cast(sum(octet_length(encode(c_name)) + 1) as bigint) AS length FROM customer GROUP BY 1")
def src_5(spark, sf):
    return RD.list_files(spark, _customer_files(spark, sf), "*.txt").select(_nation(), "length")


@query("src_9b_file_hashes", "SELECT cast(c_nationkey as bigint) AS nation, sha256(concat(string_agg(c_name, chr(10) ORDER BY c_name), chr(10))) AS sha256 FROM customer GROUP BY 1")
def src_9b(spark, sf):
    """Hash of each whole file."""
    return RD.hash_files(spark, _customer_files(spark, sf), "*.txt").select(_nation(), "sha256")


@query("src_7_review_map", "SELECT concat(cast(o_orderkey as string), '.pdf') AS filename, CASE WHEN o_orderstatus = 'O' THEN 'main' ELSE 'unknown' END AS doc_type, o_orderpriority AS text FROM orders")
def src_7(spark, sf):
    """A review map per clerk and priority, written as JSON, read back and flattened."""
    parsed = F.map_filter(F.create_map(F.lit("doc_type"), F.when(F.col("o_orderstatus") == "O", "main"), F.lit("raw_text"), F.col("o_orderpriority")), lambda k, v: v.isNotNull())
    entry = F.struct(F.concat(F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("key"), F.struct(parsed.alias("parsed")).alias("value"))
    maps = R.table(spark, sf, "orders").groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(entry)).alias("records")).select("records")
    path = f"{scratch(spark)}/review"
    maps.write.json(path)
    return RD.read_review_lines(spark, path).select("filename", "doc_type", "text")
