"""Reading legacy exports, listings, manifests and backups. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ledgerloom.operators.legacy import with_any_number, with_policy_number
from ledgerloom.schemas import LEGACY


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_table_jdbc(spark: SparkSession, url: str, table: str, column: str, low, high, parts: int, **options) -> DataFrame:
    """A database table in ``parts`` ranges of one column, so no single task reads it all."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.options(**options).load()


def _text_csv(spark: SparkSession, path: str, schema: T.StructType, encoding: str, whole_file: bool) -> DataFrame:
    header_named = T.StructType([T.StructField(f.name, T.StringType(), True) for f in schema.fields])
    return (
        spark.read.schema(header_named)
        .option("header", True)
        .option("enforceSchema", False)
        .option("encoding", encoding)
        .option("multiLine", whole_file)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )


def read_legacy_utf16(spark: SparkSession, path: str, schema: T.StructType = LEGACY) -> DataFrame:
    """UTF-16 export; rows with a policy number. Such a file is read by one task: convert a big one with
    ``to_utf8_parts`` once and read that."""
    return with_policy_number(_text_csv(spark, path, schema, "UTF-16", True))


def read_legacy_bom(spark: SparkSession, path: str, schema: T.StructType = LEGACY) -> DataFrame:
    """UTF-8 export with a byte order mark; rows with a policy or an application number."""
    return with_any_number(_text_csv(spark, path, schema, "UTF-8", False))


def to_utf8_parts(spark: SparkSession, source: str, target: str, schema: T.StructType = LEGACY, parts: int = 64) -> None:
    df = _text_csv(spark, source, schema, "UTF-16", True)
    df.repartition(parts).write.option("header", True).csv(target)


def list_files(spark: SparkSession, folder: str, pattern: str = "*.pdf", recursive: bool = True) -> DataFrame:
    """path, name, length, modified; one row per path. File contents are not read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern).load(folder)
    name = F.try_url_decode(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\+", "%2B"))
    return raw.select("path", F.coalesce(name, F.element_at(F.split("path", "/"), -1)).alias("name"), "length", F.col("modificationTime").alias("modified")).dropDuplicates(["path"])


def hash_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """path, name, length and sha256 of the whole content."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return raw.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def object_listing(df: DataFrame) -> DataFrame:
    """object_key, size, modified; a size kept in JSON metadata is read from there, else 0."""
    size = F.get_json_object("metadata", "$.size").try_cast("long") if "metadata" in df.columns else F.lit(None).cast("long")
    own = F.col("size").cast("long") if "size" in df.columns else F.lit(None).cast("long")
    return df.select("object_key", F.coalesce(own, size, F.lit(0)).alias("size"), "modified")


REVIEW = "records map<string, struct<parsed: map<string, string>>>"
MANIFEST = (
    "exact_pairs array<struct<pair_id: string, main_file: string, main_policy_number: string, prb_file: string, "
    "prb_policy_number: string, chassis_no: string>>, "
    "standalone_policies array<struct<file: string, policy_number: string, doc_type: string, note: string>>"
)


def read_review(spark: SparkSession, path: str) -> DataFrame:
    """A file-to-record map flattened: position, filename and the parsed fields. A pretty-printed map is one value, so one
    task reads a file; split a large one into lines of smaller maps and use ``read_review_lines``."""
    return _flat_review(spark.read.schema(REVIEW).option("multiLine", True).json(path))


def read_review_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same from JSON lines, each with a map of its own; files split at line ends."""
    return _flat_review(spark.read.schema(REVIEW).json(path))


def _flat_review(maps: DataFrame) -> DataFrame:
    entries = maps.select(F.posexplode(F.map_entries("records")).alias("position", "e"))
    field = lambda n: F.try_element_at(F.col("e.value.parsed"), F.lit(n))
    return entries.select(
        "position", F.col("e.key").alias("filename"), F.coalesce(field("doc_type"), F.lit("unknown")).alias("doc_type"),
        *[field(n).alias(n) for n in ("coverage_start", "coverage_end", "policy_number", "company_code")],
        F.coalesce(field("raw_text"), F.lit("")).alias("text"),
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return expand_manifest(spark.read.schema(MANIFEST).option("multiLine", True).json(path))


def expand_manifest(manifest: DataFrame) -> DataFrame:
    """One row per expected file: role (main, prb, standalone), file, policy_number, chassis_no, doc_type, pair_id, note."""
    pairs = manifest.select(F.explode("exact_pairs").alias("p"))
    none = F.lit(None).cast("string")

    def side(role: str) -> DataFrame:
        return pairs.select(
            F.lit(role).alias("role"), F.col(f"p.{role}_file").alias("file"), F.col(f"p.{role}_policy_number").alias("policy_number"),
            F.col("p.chassis_no").alias("chassis_no"), none.alias("doc_type"), F.col("p.pair_id").alias("pair_id"), none.alias("note"),
        )

    alone = manifest.select(F.explode("standalone_policies").alias("s")).select(
        F.lit("standalone").alias("role"), "s.file", "s.policy_number", none.alias("chassis_no"), "s.doc_type", none.alias("pair_id"), "s.note"
    )
    return side("main").unionByName(side("prb")).unionByName(alone)


def read_backup(spark: SparkSession, path: str, table: str, schema: T.StructType) -> DataFrame:
    """Rows of one table of a backup written by ``write_backup``. Only that table's partition is read."""
    lines = spark.read.text(path).filter(F.col("_table") == table)
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def read_backup_inferred(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Rows of one table without a declared schema: types are those of all its rows as variants, columns those of its first
    row in their order. JSON has no dates, so these come back as text; a table without rows has no columns."""
    lines = spark.read.text(path).filter(F.col("_table") == table)
    found = lines.agg(F.schema_of_variant_agg(F.parse_json("value")).alias("kind"), F.first(F.json_object_keys("value")).alias("columns")).first()
    if found["columns"] is None:
        return spark.createDataFrame([], T.StructType([]))
    row = F.from_json("value", found["kind"].replace("OBJECT<", "STRUCT<")).alias("r")
    return lines.select(row).select(*[F.col("r").getField(c).alias(c) for c in found["columns"]])


def read_backup_meta(spark: SparkSession, path: str) -> DataFrame:
    """(backup_at, tables, format_version) of a backup."""
    lines = spark.read.text(path).filter("_table = '_meta'")
    return lines.select(F.from_json("value", "backup_at timestamp, tables array<string>, format_version int").alias("r")).select("r.*")
