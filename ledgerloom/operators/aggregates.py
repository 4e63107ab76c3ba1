"""Counts, sums and summaries. Each is a hash aggregate with map-side partial sums unless it says otherwise."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def customer_key(name: str = "insured_name", row_id: str = "id") -> Column:
    """Trimmed lower-case name, else the row's own id."""
    return F.coalesce(F.nullif(F.lower(F.trim(name)), F.lit("")), F.concat(F.lit("__id__"), F.col(row_id).cast("string")))


def latest_per_customer(df: DataFrame, columns: list[str]) -> DataFrame:
    """Latest row per customer and a count of the other rows with a document.

    One aggregate with partial max and sum per partition, so a customer holding a third of all rows shuffles one
    partial row per task. Latest is by start, else end, else creation time, as text; ties go to the smaller id.
    """
    moment = F.coalesce(
        F.col("coverage_start").cast("string"), F.col("coverage_end").cast("string"), F.col("created_at").cast("string"), F.lit("")
    )
    documented = F.coalesce(F.nullif("pdf_url", F.lit("")), F.nullif("pdf_filename", F.lit("")), F.nullif(F.col("pdf_size"), F.lit(0)).cast("string")).isNotNull()
    rows = df.select(
        customer_key().alias("_key"),
        F.struct(moment.alias("moment"), (-F.col("id")).alias("tie")).alias("_order"),
        documented.cast("long").alias("_doc"),
        F.struct(*columns).alias("_row"),
    )
    return (
        rows.groupBy("_key")
        .agg(F.max_by(F.struct("_row", "_doc"), "_order").alias("_best"), F.sum("_doc").alias("_docs"))
        .select("_best._row.*", (F.col("_docs") - F.col("_best._doc")).alias("history_count"))
    )


def status_counters(df: DataFrame, today: date, days: int = 30) -> DataFrame:
    """active: end after today; expiring: after today and up to today + days. Rows, not customers."""
    end = F.col("coverage_end")
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(end > F.lit(today)).alias("active"),
        F.count_if((end > F.lit(today)) & (end <= F.lit(today + timedelta(days=days)))).alias("expiring"),
    )


def group_counts(df: DataFrame, *keys: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows"))


def filled_distinct(**columns: Column) -> list[Column]:
    """Exact distinct counts with blanks left out."""
    return [F.count_distinct(F.nullif(F.trim(c), F.lit(""))).alias(n) for n, c in columns.items()]


def duplicate_census(df: DataFrame, *keys: str) -> DataFrame:
    """Keys with more than one row, and the rows in them."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    return sizes.agg(F.count("*").alias("duplicate_keys"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("duplicate_rows"))


def format_profile(df: DataFrame, column: str, top: int = 15, examples: int = 5) -> DataFrame:
    """Value shapes by (leading digit, has blank, length), most frequent first, with the smallest examples.

    Examples come from distinct values cut to the five smallest per shape before they are collected.
    """
    value = F.col(column)
    shaped = df.filter(value.isNotNull() & ~value.isin("", "OTHER", "NULL", "null")).select(
        value.rlike(r"^\d").alias("leading_digit"), value.contains(" ").alias("has_blank"), F.length(value).alias("length"), value.alias("value")
    )
    shape = ["leading_digit", "has_blank", "length"]
    per_value = shaped.groupBy(*shape, "value").agg(F.count("*").alias("n"))
    counts = per_value.groupBy(*shape).agg(F.sum("n").alias("rows"))
    chosen = counts.orderBy(F.desc("rows"), *shape).limit(top)
    smallest = _smallest(per_value, shape, "value", examples)
    return chosen.join(smallest, shape, "left")


def _smallest(df: DataFrame, keys: list[str], column: str, n: int) -> DataFrame:
    """The n smallest distinct values per key. Rank within (key, hash bucket) first, so no task sorts a whole hot key."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(column), F.lit(64)))
    per_salt = salted.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_salt").orderBy(column))).filter(F.col("_r") <= n)
    final = per_salt.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(column))).filter(F.col("_r") <= n)
    return final.groupBy(*keys).agg(F.sort_array(F.collect_list(column)).alias("examples"))


def match_rate(df: DataFrame, kind: str, links: str) -> DataFrame:
    """Per kind: files, files with a link, rate and links."""
    return df.groupBy(kind).agg(
        F.count("*").alias("files"),
        F.count_if(F.col(links) > 0).alias("matched"),
        F.round(F.avg((F.col(links) > 0).cast("double")), 6).alias("rate"),
        F.sum(links).cast("long").alias("links"),
    )


def file_census(df: DataFrame, count: str | None = None) -> DataFrame:
    """Files and bytes by document kind and outcome. With ``count`` a row stands for so many files, ``length`` being their sum."""
    files = F.count("*") if count is None else F.sum(count)
    return df.groupBy("doc_kind", "outcome").agg(files.alias("files"), F.sum("length").cast("long").alias("bytes"))


def invoice_totals(items: DataFrame, key: str, rate: str = "0.07") -> DataFrame:
    """Item lines summed per invoice, then the three note layouts. Money is decimal and rounds half up.

    Columns in: key, quantity, unit_price, stamp, other_fees, discount (the last three per line, summed).
    """
    vat_rate = F.lit(rate).cast("decimal(9,4)")
    sums = items.groupBy(key).agg(
        F.sum(F.col("quantity") * F.col("unit_price")).cast("decimal(18,2)").alias("net"),
        *[F.sum(c).cast("decimal(18,2)").alias(c) for c in ("stamp", "other_fees", "discount")],
    )
    net, stamp, other, discount = (F.col(c) for c in ("net", "stamp", "other_fees", "discount"))

    def money(c: Column) -> Column:
        return F.round(c, 2).cast("decimal(18,2)")

    fees = stamp + other
    return (
        sums.withColumn("default_vat", money((net + fees) * vat_rate))
        .withColumn("default_total", money(net + fees + F.col("default_vat")))
        .withColumn("short_vat", money((net + other + stamp) * vat_rate))
        .withColumn("short_total", money(net + stamp + F.col("short_vat")))
        .withColumn("long_vat", money((net + other + stamp - discount) * vat_rate))
        .withColumn("long_total", money(net - discount + stamp + F.col("long_vat")))
        .withColumn("withholding", money(net * F.lit("0.01").cast("decimal(9,4)")))
        .withColumn("commission", money(net * F.lit("0.18").cast("decimal(9,4)")))
    )


def batch_history(files: DataFrame, state: DataFrame, newest: int = 50) -> DataFrame:
    """Newest batches with their file count and the furthest status reached.

    ``state``: batch_id, updated_at, done, committed (booleans).
    """
    sizes = files.groupBy("batch_id").agg(F.count("*").alias("files"))
    latest = state.groupBy("batch_id").agg(
        F.max("updated_at").alias("updated_at"), F.bool_or("committed").alias("committed"), F.bool_or("done").alias("done")
    )
    status = F.when(F.col("committed"), "committed").when(F.col("done"), "review").otherwise("processing")
    return (
        latest.join(sizes, "batch_id", "left")
        .select("batch_id", "updated_at", F.coalesce("files", F.lit(0)).alias("files"), status.alias("status"))
        .orderBy(F.desc("updated_at"), "batch_id")
        .limit(newest)
    )


def active_entities(df: DataFrame, entity: Column, first_year: int, last_year: int) -> DataFrame:
    """Entities with a row in the year span, and their rows of all years. One aggregate, no self join."""
    year = F.year("coverage_start")
    return (
        df.select(F.nullif(F.trim(entity), F.lit("")).alias("entity"), year.between(first_year, last_year).alias("_in"))
        .filter("entity is not null")
        .groupBy("entity")
        .agg(F.count("*").alias("rows"), F.bool_or(F.coalesce("_in", F.lit(False))).alias("_active"))
        .filter("_active")
        .drop("_active")
    )


def completeness(df: DataFrame, evidence: list[str]) -> DataFrame:
    """Filled evidence fields over their number (at most 0.95), less 0.15 for an unknown class, plus 0.10 when the
    premium adds up within 1 (at most 0.98)."""
    filled = sum(
        (F.length(F.coalesce(F.col(c).cast("string"), F.lit(""))) > 0).cast("double") for c in evidence
    ) / F.lit(float(len(evidence)))
    base = F.least(F.lit(0.95), filled)
    base = F.when(F.col("doc_type") == "unknown", F.greatest(F.lit(0.0), base - 0.15)).otherwise(base)
    money = [F.col(c) for c in ("net_premium", "stamp_duty", "vat", "total_premium")]
    adds_up = F.coalesce(F.abs(money[0] + money[1] + money[2] - money[3]) <= 1, F.lit(False))
    return df.withColumn("confidence", F.round(F.when(adds_up, F.least(F.lit(0.98), base + 0.10)).otherwise(base), 2))

