"""Comparing two holdings of the same records, and listings with the records that refer to them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerloom.operators.windows import last_per_key


def existing_split(incoming: DataFrame, existing: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(new rows, rows whose key exists)."""
    keys = existing.select(key).distinct()
    return incoming.join(keys, key, "left_anti"), incoming.join(keys, key, "left_semi")


def key_presence(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Every key of either side with ``side`` both / left_only / right_only.

    One aggregate over the union: keys collapse on the map side, so repeats of a key cost nothing in the shuffle.
    """
    both = left.select(key, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(key, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    flags = both.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    side = F.when((F.col("_l") == 1) & (F.col("_r") == 1), "both").when(F.col("_l") == 1, "left_only").otherwise("right_only")
    return flags.select(key, side.alias("side"))


def field_mismatch(
    left: DataFrame,
    right: DataFrame,
    key: str,
    position: str,
    text: list[str],
    dates: list[str],
    amounts: list[str],
    tolerance: float = 0.01,
) -> DataFrame:
    """Long form (key, field, left_value, right_value) of the fields that differ on keys held by both sides.

    Left takes the first row of a key by ``position``, right the last. Text is trimmed and exact; a date is compared
    as its first 10 characters and skipped when the left one is null; amounts differ beyond ``tolerance``, null is 0.
    """
    columns = [*text, *dates, *amounts]
    first = last_per_key(left, [key], -F.col(position), columns)
    last = last_per_key(right, [key], F.col(position), columns)
    pairs = first.select(key, F.struct(*columns).alias("l")).join(last.select(key, F.struct(*columns).alias("r")), key)

    def entry(field: str, differs: Column, l: Column, r: Column) -> Column:
        return F.when(
            differs,
            F.struct(F.lit(field).alias("field"), l.cast("string").alias("left_value"), r.cast("string").alias("right_value")),
        )

    entries = []
    for c in text:
        l, r = (F.trim(F.coalesce(F.col(f"{s}.{c}").cast("string"), F.lit(""))) for s in "lr")
        entries.append(entry(c, l != r, l, r))
    for c in dates:
        l, r = (F.substring(F.col(f"{s}.{c}").cast("string"), 1, 10) for s in "lr")
        entries.append(entry(c, l.isNotNull() & (l != F.coalesce(r, F.lit(""))), l, r))
    for c in amounts:
        l, r = (F.coalesce(F.col(f"{s}.{c}"), F.lit(0)) for s in "lr")
        entries.append(entry(c, F.abs(l - r) > F.lit(tolerance).cast("decimal(9,4)"), l, r))
    return pairs.select(key, F.explode(F.array_compact(F.array(*entries))).alias("d")).select(key, "d.*")


def orphan_objects(objects: DataFrame, references: DataFrame, cutoff, key: str = "object_key") -> DataFrame:
    """Objects no reference names and not newer than ``cutoff`` (strictly newer ones are kept)."""
    keys = references.select(F.col(references.columns[0]).alias(key)).filter(F.col(key).isNotNull()).distinct()
    return objects.filter(F.col("modified") <= F.lit(cutoff)).join(keys, key, "left_anti")


def keep_and_delete(
    objects: DataFrame, attachment_keys: DataFrame, policy_keys: DataFrame, done_names: DataFrame, key: str = "object_key"
) -> DataFrame:
    """Each object with ``action`` keep / delete. Kept: attachment keys, and policy keys whose file name is not done.

    ``policy_keys``: object_key, pdf_filename; ``done_names``: pdf_filename.
    """
    fresh = policy_keys.join(done_names.select("pdf_filename").distinct(), "pdf_filename", "left_anti").select(key)
    keep = attachment_keys.select(key).unionByName(fresh).filter(F.col(key).isNotNull()).distinct()
    kept = keep.withColumn("_keep", F.lit(True))
    action = F.when(F.col("_keep"), "keep").otherwise("delete")
    return objects.join(kept, key, "left").withColumn("action", action).drop("_keep")


def action_totals(plan: DataFrame, size: str = "size") -> DataFrame:
    return plan.groupBy("action").agg(F.count("*").alias("objects"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"))


def file_presence(files: DataFrame, hits: DataFrame, name: str) -> DataFrame:
    """Each file with its number of hits, tables hit and smallest hit id per table.

    ``hits``: name, origin, id. Hits collapse to one row per name before the join, so neither side fans out.
    """
    per_name = hits.filter(F.col(name).isNotNull()).groupBy(name).agg(
        F.count("*").alias("_hits"),
        F.array_sort(F.collect_set("origin")).alias("origins"),
        F.min(F.struct("origin", "id")).alias("first_hit"),
    )
    return files.join(per_name, name, "left").withColumn("hits", F.coalesce("_hits", F.lit(0))).drop("_hits")


def file_hits(files: DataFrame, hits: DataFrame, name: str) -> DataFrame:
    """Every hit of every file, one row each: the files' columns, origin and id. Files without a hit give none.

    The rows are the answer itself, so their number is that of the hits; a join splits a name that very many share.
    """
    return files.filter(F.col(name).isNotNull()).join(hits.select(name, "origin", "id"), name)


def copy_plan(source: DataFrame, target: DataFrame, by_time: bool = False, tolerance_seconds: int = 2) -> DataFrame:
    """``action`` write / skip / overwrite per source name from a target listing of the same names.

    Skip when the size is equal and, with ``by_time``, the times lie within the tolerance.
    """
    there = last_per_key(target, ["name"], F.col("modified"), ["length", "modified"]).select(
        "name", F.col("length").alias("_length"), F.col("modified").alias("_modified")
    )
    same = F.col("length") == F.col("_length")
    if by_time:
        seconds = F.abs(F.unix_timestamp(F.col("modified").cast("timestamp")) - F.unix_timestamp(F.col("_modified").cast("timestamp")))
        same = same & (seconds < tolerance_seconds)
    action = F.when(F.col("_length").isNull(), "write").when(same, "skip").otherwise("overwrite")
    return source.join(there, "name", "left").withColumn("action", action).drop("_length", "_modified")


def _looked_up(rows: DataFrame, side: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which rows without a key, which find nothing, are dealt by where they come from: they else meet in one task.

    Rows of one task stay together, four ways, so that they still compress; a row with a key carries only its length.
    """
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    by_key = F.length(F.concat(*[F.col(k).cast("string") for k in keys]))
    elsewhere = -1 - F.spark_partition_id() * 4 - F.pmod(F.hash(*rows.columns), F.lit(4))
    dealt = rows.withColumn("_deal", F.when(whole, by_key).otherwise(elsewhere))
    return dealt.join(side.withColumn("_deal", by_key), [*keys, "_deal"], "left").drop("_deal")


def coalesce_by_two_keys(docs: DataFrame, policies: DataFrame, position: str = "pos") -> DataFrame:
    """Record by policy number, else by exact plate. First record per key by id."""
    by_number = policies.filter("policy_number is not null").groupBy("policy_number").agg(F.min("id").alias("_by_number"))
    by_plate = policies.filter("license_plate is not null").groupBy("license_plate").agg(F.min("id").alias("_by_plate"))
    return (
        _looked_up(_looked_up(docs, by_number, ["policy_number"]), by_plate, ["license_plate"])
        .withColumn("policy_id", F.coalesce("_by_number", "_by_plate"))
        .withColumn("matched_by", F.when(F.col("_by_number").isNotNull(), "policy_number").when(F.col("_by_plate").isNotNull(), "license_plate"))
        .drop("_by_number", "_by_plate")
    )


def enrich(df: DataFrame, side: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Left join on a trimmed key with a side table; the last side row of a key wins. The join type is left to Spark."""
    side = last_per_key(side.withColumn("_key", F.trim(key)), ["_key"], F.col("_pos") if "_pos" in side.columns else F.col(columns[0]), columns)
    return df.withColumn("_key", F.trim(key)).join(side, "_key", "left").drop("_key")


def expected_against_parsed(expected: DataFrame, parsed: DataFrame, norm) -> DataFrame:
    """Checks of a parsed file against its manifest entry, and whether it is ready.

    A missing expected chassis number passes. Columns: file, policy_number, chassis_no on both sides.
    """
    e = expected.select("file", F.col("policy_number").alias("_en"), F.col("chassis_no").alias("_ec"))
    joined = e.join(parsed.select("file", "policy_number", "chassis_no"), "file", "left")
    number_ok = norm("policy_number") == norm("_en")
    chassis_ok = (norm("_ec") == "") | (norm("chassis_no") == norm("_ec"))
    return joined.select("file", number_ok.alias("policy_number_exact"), chassis_ok.alias("chassis_no_exact"), (number_ok & chassis_ok).alias("ready"))


def exactly_one(docs: DataFrame, policies: DataFrame, norm) -> tuple[DataFrame, DataFrame]:
    """(docs with the one policy under the same normalised number, docs with none or several and the count)."""
    sizes = policies.select(norm("policy_number").alias("_key"), "id").filter("_key <> ''").groupBy("_key").agg(
        F.count("*").alias("found"), F.min("id").alias("policy_id")
    )
    joined = docs.withColumn("_key", norm("policy_number")).join(sizes, "_key", "left").drop("_key")
    joined = joined.withColumn("found", F.coalesce("found", F.lit(0)))
    return joined.filter("found = 1"), joined.filter("found <> 1").drop("policy_id")


def newest_by_number(docs: DataFrame, policies: DataFrame) -> DataFrame:
    """Loose variant: upper case without blanks; the newest policy, else null."""
    key = F.upper(F.replace(F.col("policy_number"), F.lit(" "), F.lit("")))
    newest = policies.withColumn("_key", key).groupBy("_key").agg(
        F.max_by("id", F.struct("created_at", "id")).alias("policy_id")
    )
    return docs.withColumn("_key", key).join(newest, "_key", "left").drop("_key")


def year_of_text(column: str) -> Column:
    text = F.col(column).cast("string")
    return F.when(text.rlike(r"^\d{4}"), F.substring(text, 1, 4))


def unique_parent(docs: DataFrame, policies: DataFrame, number_key, vin_key, plate_key, newest: int = 21) -> DataFrame:
    """One safe parent per document, else none with a reason.

    Any class but motor_prb: by policy number, and company when given, exactly one. motor_prb: policies of type M or
    STY by VIN, else plate; of the newest ``newest`` per key those of the document's start year (all when unknown)
    must be exactly one. Policies collapse per (key, year) to a count and one id first, so a busy key costs one row.
    Documents: doc_id, doc_type, policy_number, company_code, chassis_no, license_plate, coverage_start.
    """
    p = policies.withColumns({"_year": year_of_text("coverage_start")})

    def anchors(kind: str, key: Column, rows: DataFrame) -> DataFrame:
        keyed = rows.select(key.alias("_key"), "_year", "company_code", "id", "created_at").filter("_key is not null and _key <> ''")
        return keyed.withColumn("_kind", F.lit(kind))

    vehicles = p.filter(F.col("policy_type").isin("M", "STY"))
    v = anchors("chassis", vin_key("chassis_no"), vehicles).unionByName(anchors("plate", plate_key("license_plate"), vehicles))
    v = _newest(v, ["_kind", "_key"], newest)
    n = anchors("number", number_key("policy_number"), p)

    def counted(rows: DataFrame, detail: str | None) -> DataFrame:
        """Policies and their least id per key, and per year or company if asked."""
        told = F.lit("") if detail is None else F.col(detail).cast("string")
        rows = rows.select("_kind", "_key", F.lit(detail is None).alias("_any"), told.alias("_detail"), "id").filter("_detail is not null")
        return rows.groupBy("_kind", "_key", "_any", "_detail").agg(F.count("*").alias("_n"), F.min("id").alias("_id"))

    known = reduce(DataFrame.unionByName, [counted(v, "_year"), counted(v, None), counted(n, "company_code"), counted(n, None)])

    prb = F.col("doc_type") == "motor_prb"
    vin, plate = vin_key("chassis_no"), plate_key("license_plate")
    number, year, company = number_key("policy_number"), year_of_text("coverage_start"), F.nullif(F.col("company_code"), F.lit(""))
    detail = F.when(prb, year).otherwise(company).cast("string")
    asked = {  # a document asks one thing, so it is looked up once
        "_kind": F.when(prb & (vin != ""), "chassis").when(prb & (plate != ""), "plate").when(~prb & (number != ""), "number"),
        "_key": F.when(prb & (vin != ""), vin).when(prb & (plate != ""), plate).when(~prb & (number != ""), number),
        "_any": detail.isNull(),
        "_detail": F.coalesce(detail, F.lit("")),
    }
    d = _looked_up(docs.withColumns(asked), known, ["_kind", "_key", "_any", "_detail"])
    one, parent = F.coalesce("_n", F.lit(0)) == 1, F.col("_id")
    reason = (
        F.when(F.col("_kind") == "number", F.when(one, "policy_number_exact").otherwise("not_unique"))
        .when(~prb, "no_reference")
        .when(F.col("_kind").isNull(), "missing_vehicle_identity")
        .when(~one, "not_unique")
        .otherwise(F.concat("_kind", F.lit("_and_year")))
    )
    return d.select(*docs.columns, F.when(one, parent).alias("parent_id"), reason.alias("reason"))


def _newest(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The newest n rows per key. Ranked per (key, salt) first, so a hot key is cut to n rows per salt in parallel."""
    order = [F.desc("created_at"), F.col("id")]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    near = salted.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_salt").orderBy(*order))).filter(F.col("_r") <= n)
    return near.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= n).drop("_salt", "_r")
