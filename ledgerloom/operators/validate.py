"""Checks that null a doubtful value, split off bad rows, or decide between readings. Money is decimal, half up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions import dates as D, text as X
from ledgerloom.functions.numbers import VIN_SHAPE, vin_check_digit_ok
from ledgerloom.schemas import SUPPORT_TYPES
from ledgerloom.session import once

AMOUNTS = ["net_premium", "stamp_duty", "vat", "total_premium"]
# Least confidence by field for a value to be taken.
CONFIDENCE = {"policy_number": 95, "license_plate": 95, "chassis_no": 95, "coverage_start": 70, "coverage_end": 70}
# Fields a second look may fill for review, and boilerplate that is no name.
REVIEW_FIELDS = [
    "policy_number", "insured_name", "insured_address", "license_plate", "license_province", "chassis_no",
    "car_make", "car_model", "car_year", "coverage_start", "coverage_end",
]
BOILERPLATE = ["กรมธรรม์ประกันภัยนี้", "อิเล็กทรอนิกส์", "สำนักงาน คปภ"]
CENT = "decimal(18,2)"


def _money(c: Column) -> Column:
    return F.round(c, 2).cast(CENT)


def field_sanity(df: DataFrame) -> DataFrame:
    """Doubtful name, VIN, amounts and dates become null; ``warnings`` says which (name, vin, amount, sum, period)."""
    name, vin = F.col("insured_name"), F.upper(F.replace("chassis_no", F.lit(" "), F.lit("")))
    bad_name = (F.length(name) > 120) | F.coalesce(F.regexp_like(name, F.lit("|".join(BOILERPLATE))), F.lit(False))
    bad_vin = (F.length(vin) > 0) & ((F.length(vin) != 17) | vin.rlike("[IOQ]"))
    in_range = {a: F.when((F.col(a) > 0) & (F.col(a) <= 100_000_000), F.col(a)) for a in AMOUNTS}
    out_of_range = [F.col(a).isNotNull() & in_range[a].isNull() for a in AMOUNTS]
    staged = df.withColumns(
        {
            "_bad_name": F.coalesce(bad_name, F.lit(False)),
            "_bad_vin": F.coalesce(bad_vin, F.lit(False)),
            "_bad_amount": F.greatest(*out_of_range),
            **{f"_{a}": c for a, c in in_range.items()},
        }
    )
    net, stamp, vat, total = (F.col(f"_{a}") for a in AMOUNTS)
    bad_sum = F.coalesce(F.abs(net + stamp + vat - total) > F.greatest(F.lit(1).cast(CENT), total * F.lit("0.02").cast("decimal(4,2)")), F.lit(False))
    bad_period = F.coalesce(F.col("coverage_end") <= F.col("coverage_start"), F.lit(False))
    staged = staged.withColumns({"_bad_sum": bad_sum, "_bad_period": bad_period})
    province = F.when(F.trim("license_province").isin("กท", "กทม", "กทม."), "กรุงเทพมหานคร").otherwise(F.col("license_province"))
    flags = {"name": "_bad_name", "vin": "_bad_vin", "amount": "_bad_amount", "sum": "_bad_sum", "period": "_bad_period"}
    fixed = {
        "insured_name": F.when(~F.col("_bad_name"), name),
        "chassis_no": F.when(~F.col("_bad_vin"), F.col("chassis_no")),
        **{a: F.when(~F.col("_bad_sum"), F.col(f"_{a}")) for a in AMOUNTS},
        **{c: F.when(~F.col("_bad_period"), F.col(c)) for c in ("coverage_start", "coverage_end")},
    }
    if "license_province" in df.columns:
        fixed["license_province"] = province
    warnings = F.array_compact(F.array(*[F.when(F.col(c), F.lit(w)) for w, c in flags.items()]))
    return staged.withColumn("warnings", warnings).withColumns(fixed).select(*df.columns, "warnings")


def atomic_groups(df: DataFrame) -> DataFrame:
    """The four amounts stand or fall together (present, in range, exact to 0.01), and so do the two dates (0 to 730 days)."""
    net, stamp, vat, total = (F.col(a) for a in AMOUNTS)
    present = F.least(*[(F.col(a) >= 0) & (F.col(a) < 100_000_000) for a in AMOUNTS])
    money_ok = present & (net > 0) & (total > 0) & (F.abs(net + stamp + vat - total) <= F.lit("0.01").cast(CENT))
    complete = F.coalesce(net + stamp + vat + total, F.lit(None).cast(CENT)).isNotNull()
    days = F.datediff("coverage_end", "coverage_start")
    staged = df.withColumns(
        {"money_ok": F.coalesce(complete & money_ok, F.lit(False)), "period_ok": F.coalesce((days > 0) & (days <= 730), F.lit(False))}
    )
    return staged.withColumns(
        {
            **{a: F.when(F.col("money_ok"), F.col(a)) for a in AMOUNTS},
            **{c: F.when(F.col("period_ok"), F.col(c)) for c in ("coverage_start", "coverage_end")},
        }
    )


def premium_ledger(df: DataFrame, paired: str = "paired_prb_total") -> DataFrame:
    """Commission, withholding and the amount to collect; ``rejected`` where the parts miss the total by over 0.02."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast(CENT)
    off = F.abs(F.col("net_premium") + F.col("stamp_duty") + F.col("vat") - F.col("total_premium")) > F.lit("0.02").cast(CENT)
    commission = F.coalesce(F.col("commission_baht"), _money(zero("net_premium") * F.coalesce(F.col("commission_pct"), F.lit(0)).cast("decimal(9,4)") / 100))
    staged = df.withColumn("rejected", F.coalesce(off, F.lit(False))).withColumn("commission_baht", commission)
    staged = staged.withColumn("wht_10pct", F.coalesce(F.col("wht_10pct"), _money(F.col("commission_baht") * F.lit("0.10").cast("decimal(4,2)"))))
    collected = (
        F.col("total_premium") + zero(paired) - zero("prepaid_tax_1pct") - F.col("commission_baht") + F.col("wht_10pct") + zero("rounding")
    )
    return staged.withColumn("collected_amount", F.when(F.col("total_premium").isNotNull(), _money(collected)))


def normal_read(field: Column, text: Column) -> Column:
    """A reading in canonical form, or null. Prose fields are never canonical."""
    compact = X.no_blanks(text)
    number = F.nullif(F.regexp_extract(compact, r"D[0O](-\d{2}-\d{2}/\d{6,8})", 1), F.lit(""))
    plate = F.nullif(F.regexp_extract(compact, r"^([0-9]?[ก-ฮ]{2}\d{1,4})(?:กท|กทม\.?|กรุงเทพมหานคร)$", 1), F.lit(""))
    money = F.when(compact.rlike(r"^(?:\d{1,3}(?:,\d{3})+|\d+)\.\d{2}$"), F.replace(compact, F.lit(","), F.lit("")))
    return (
        F.when(field.isin(*AMOUNTS, "sum_insured"), money)
        .when(field.isin("coverage_start", "coverage_end"), D.date_document(compact).cast("string"))
        .when(field == "policy_number", F.concat(F.lit("D0"), number))
        .when(field == "chassis_no", F.when(compact.rlike(VIN_SHAPE), compact))
        .when(field == "license_plate", plate)
        .when(field == "car_year", F.when(compact.rlike(r"^(?:19|20)\d{2}$"), compact))
    )


def consensus(reads: DataFrame, keys: list[str], field: Column, norm: str, read_no: str = "read_no") -> DataFrame:
    """Per key: ``status`` candidate / review, ``value``, first text, alternatives and the least confidence.

    Candidate when at least two readings agree on one canonical value and the least confidence reaches the field's
    threshold (95 identifiers, 70 dates, 75 others). Everything is an aggregate with map-side partials.
    """
    threshold = F.lit(75)
    for name, level in CONFIDENCE.items():
        threshold = F.when(field == name, level).otherwise(threshold)
    grouped = reads.withColumn("_threshold", threshold).groupBy(*keys).agg(
        F.count("*").alias("reads"),
        F.count(norm).alias("_normal"),
        F.min(norm).alias("_low"),
        F.max(norm).alias("_high"),
        F.min("min_confidence").alias("min_confidence"),
        F.max("_threshold").alias("_threshold"),
        F.min_by("text", read_no).alias("text"),
        F.array_sort(F.collect_set("text")).alias("alternatives"),
    )
    agreed = (F.col("reads") >= 2) & (F.col("_normal") == F.col("reads")) & (F.col("_low") == F.col("_high"))
    accepted = agreed & (F.col("min_confidence") >= F.col("_threshold"))
    return grouped.select(
        *keys,
        F.when(accepted, "candidate").otherwise("review").alias("status"),
        F.when(accepted, F.col("_low")).alias("value"),
        "text",
        "alternatives",
        "min_confidence",
        "reads",
    )


def majority_identifier(reads: DataFrame, key: str, value: str) -> DataFrame:
    """The one reading with a right check digit, else the most frequent if seen twice (smallest on ties)."""
    sizes = reads.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    marked = once(sizes, _ok=vin_check_digit_ok(value))
    grouped = marked.groupBy(key).agg(
        F.count_if("_ok").alias("_valid"),
        F.min(F.when(F.col("_ok"), F.col(value))).alias("_checked"),
        F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))).alias("_top"),
    )
    top = F.when((F.col("_valid") > 0) | (F.col("_top.n") <= -2), F.col("_top.v"))
    return grouped.select(key, F.when(F.col("_valid") == 1, F.col("_checked")).otherwise(top).alias("majority"))


def score_against_truth(parsed: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Per expected field: withheld, correct or incorrect. Both sides long: keys..., value."""
    joined = expected.select(*keys, F.col("value").alias("expected")).join(parsed.select(*keys, F.col("value").alias("actual")), keys, "left")
    blank = F.coalesce(F.col("actual").cast("string"), F.lit("")) == ""
    return joined.withColumn("status", F.when(blank, "withheld").when(F.col("actual") == F.col("expected"), "correct").otherwise("incorrect"))


def commit_checks(items: DataFrame, staged: DataFrame) -> DataFrame:
    """``errors`` per selected item: file not in the batch or selected twice, required fields by class, dates in order,
    a pair that contradicts itself (VIN or start year).

    Items: batch_id, item_id, main_file_id, prb_file_id, doc_type, policy_number, insured_name, coverage_start,
    coverage_end, chassis_no, prb_chassis_no, prb_coverage_start. Staged: batch_id, file_id.
    """
    both = items.select("batch_id", "item_id", F.explode(F.array_compact(F.array("main_file_id", "prb_file_id"))).alias("file_id"))
    uses = both.groupBy("batch_id", "file_id").agg(F.count("*").alias("_uses"))
    have = staged.select("batch_id", "file_id").distinct().withColumn("_have", F.lit(True))
    files = both.join(uses, ["batch_id", "file_id"]).join(have, ["batch_id", "file_id"], "left")
    wrong = F.col("_have").isNull() | (F.col("_uses") > 1)
    per_item = files.groupBy("batch_id", "item_id").agg(F.bool_or(wrong).alias("_wrong"))
    doc = F.coalesce("doc_type", F.lit("unknown"))
    support = doc.isin(SUPPORT_TYPES)
    lacks = lambda *cs: F.greatest(*[F.coalesce(F.col(c).cast("string"), F.lit("")) == "" for c in cs])
    late = F.coalesce(F.col("coverage_start") >= F.col("coverage_end"), F.lit(False))
    vin, other = X.vin_key("chassis_no"), X.vin_key("prb_chassis_no")
    clash = ((vin != "") & (other != "") & (vin != other)) | F.coalesce(
        F.year("coverage_start") != F.year("prb_coverage_start"), F.lit(False)
    )
    errors = F.array_compact(
        F.array(
            F.when(F.coalesce("_wrong", F.lit(True)) | F.col("main_file_id").isNull(), F.lit("file")),
            F.when(F.col("doc_type").isNull(), F.lit("doc_type")),
            F.when((doc == "renewal_notice") & lacks("policy_number", "coverage_start", "coverage_end"), F.lit("renewal_fields")),
            F.when(~support & lacks("policy_number", "insured_name", "coverage_start", "coverage_end"), F.lit("required_fields")),
            F.when(late, F.lit("period")),
            F.when(~support & clash, F.lit("pair")),
        )
    )
    return items.join(per_item, ["batch_id", "item_id"], "left").withColumn("errors", errors).drop("_wrong")


# -- merging ---------------------------------------------------------------------------------------------------------
def merge_readings(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """The second reader's non-empty value wins; a differing comparison key means review.

    Long form: keys..., value. Adds ``status`` candidate / review / kept (first reader only).
    """
    f = first.select(*keys, F.col("value").alias("first_value"))
    s = second.select(*keys, F.col("value").alias("second_value"))
    return _merged(f.join(s, keys, "full_outer"), keys)


def merge_wide_readings(first: DataFrame, second: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """``merge_readings`` of two tables with a column per field, as keys..., field, value, status. The tables are joined by
    ``keys`` before their fields become rows: one row a document is shuffled and compared, not one a field."""
    pack = lambda df, name: df.select(*keys, F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias(name))
    joined = pack(first, "_first").join(pack(second, "_second"), keys, "full_outer")
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col("_first")[f].alias("first_value"), F.col("_second")[f].alias("second_value")) for f in fields])
    return _merged(joined.select(*keys, F.inline(pairs)), [*keys, "field"])


def _merged(joined: DataFrame, keys: list[str]) -> DataFrame:
    one, two = F.nullif(F.col("first_value"), F.lit("")), F.nullif(F.col("second_value"), F.lit(""))
    differ = one.isNotNull() & (one != two) & (X.comparison_key(one) != X.comparison_key(two))
    status = F.when(two.isNull(), "kept").when(differ, "review").otherwise("candidate")
    return joined.select(*keys, F.coalesce(two, one).alias("value"), status.alias("status")).filter("value is not null")


def merge_warnings(merged: DataFrame, keys: list[str]) -> DataFrame:
    """Per document: ``review_fields`` whose two readings differ, and ``warnings``, one for each of them, and one where net,
    stamp and VAT miss the total by more than 1. ``merged``: keys, field, value, status, as ``merge_readings`` gives."""
    amount = lambda f: F.max(F.when(F.col("field") == f, F.col("value").try_cast("decimal(18,2)")))
    rows = merged.groupBy(*keys).agg(F.sort_array(F.collect_set(F.when(F.col("status") == "review", F.col("field")))).alias("review_fields"), *[amount(a).alias(f"_{a}") for a in AMOUNTS])
    net, stamp, vat, total = (F.col(f"_{a}") for a in AMOUNTS)
    off = F.coalesce(F.abs(net + stamp + vat - total) > 1, F.lit(False))
    return rows.select(*keys, "review_fields", _merge_messages(F.col("review_fields"), off).alias("warnings"))


def verified_reading(first: DataFrame, second: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``first`` with the values of a second, structured reading, one row per document, in one join.

    A non-empty value of the second reading wins. Where the comparison keys of both differ, the field goes into ``review_fields``
    and gives a warning; so do amounts whose sum misses the total by more than 1. A missing ``policy_type`` comes from
    ``doc_type``. Documents that only the first reader saw stay as they are, documents that only the second saw are left out.
    Null and blank text count as not read; ``columns`` a reading lacks count as blank. ``second`` has one row per key.
    """
    mine = {c.lower(): c for c in first.columns}
    other = second.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns if c in second.columns])
    rows = first.select("*", *[F.lit(None).cast("string").alias(c) for c in columns if c.lower() not in mine])
    joined = rows.join(other, F.col(key) == F.col("_key"), "left")
    blank = lambda c: F.nullif(c.cast("string"), F.lit(""))
    values, differ = {}, []
    for c in (c for c in columns if c in second.columns):
        one, two = F.col(c), F.col(f"_{c}")
        values[c] = F.when(blank(two).isNotNull(), two.cast(rows.schema[c].dataType)).otherwise(one)
        clash = blank(one).isNotNull() & blank(two).isNotNull() & (X.comparison_key(one) != X.comparison_key(two))
        differ.append(F.when(clash, F.lit(c)))
    review = F.array_sort(F.array_compact(F.array(*differ))) if differ else F.array().cast("array<string>")
    merged = infer_policy_type(joined.withColumn("review_fields", review).withColumns(values))
    amounts = [F.col(a).try_cast("decimal(18,2)") if a in merged.columns else F.lit(None).cast("decimal(18,2)") for a in AMOUNTS]
    off = F.coalesce(F.abs(amounts[0] + amounts[1] + amounts[2] - amounts[3]) > 1, F.lit(False))
    return merged.select(*rows.columns, "review_fields", _merge_messages(F.col("review_fields"), off).alias("warnings"))


def _merge_messages(review_fields: Column, off: Column) -> Column:
    messages = F.transform(review_fields, lambda f: F.concat(f, F.lit(": the two readings differ")))
    return F.concat(messages, F.when(off, F.array(F.lit("amounts: net + stamp + vat is not the total"))).otherwise(F.array().cast("array<string>")))


def infer_policy_type(df: DataFrame) -> DataFrame:
    guess = F.when(F.col("doc_type") == "motor_main", "M").when(F.col("doc_type") == "motor_prb", "P")
    return df.withColumn("policy_type", F.coalesce(F.nullif("policy_type", F.lit("")), guess))


def fill_missing(first: DataFrame, second: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """First reader kept, gaps filled from the second."""
    s = second.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = first.join(s, key, "left")
    filled = {c: F.coalesce(F.nullif(F.col(c), F.lit("").cast(first.schema[c].dataType)), F.col(f"_{c}")) if first.schema[c].dataType.simpleString() == "string" else F.coalesce(c, f"_{c}") for c in columns}
    return joined.withColumns(filled).select(*first.columns)


def form_over_extract(form: DataFrame, extract: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """What a form gives wins, what was read from the document fills its gaps; ``label`` is made where the form has none.

    Blank text counts as not given. A compulsory policy with a start or an end is labelled by the Buddhist year of the first
    known, a renewal notice by its kind. ``form``: key, label, doc_type, columns; ``extract``: key, columns.
    """
    merged = fill_missing(form, extract, key, columns)
    begun = F.coalesce(*[F.year(F.col(c).try_cast("date")) for c in ("coverage_start", "coverage_end") if c in columns])
    made = F.when((F.col("doc_type") == "prb") & begun.isNotNull(), F.concat(F.lit("พ.ร.บ. ปี "), (begun + 543).cast("string")))
    made = F.coalesce(made, F.when(F.col("doc_type") == "renewal_notice", F.lit("หนังสือแจ้งเตือนต่ออายุ")))
    return merged.withColumn("label", F.coalesce(F.nullif(F.trim("label"), F.lit("")), made))


def supplemented(readings: DataFrame, supplement: DataFrame, keys: list[str]) -> DataFrame:
    """The second pass over a whole page: review fields that the first left blank take its value, for review.

    Long form: keys, field, value, status; ``supplement``: keys, field, value."""
    more = supplement.filter(F.col("field").isin(REVIEW_FIELDS) & (F.col("value") != "")).select(*keys, "field", F.col("value").alias("_more"))
    rows = readings.join(more, [*keys, "field"], "full_outer")
    value = F.nullif(F.col("value"), F.lit(""))
    status = F.when(value.isNull() & F.col("_more").isNotNull(), "review").otherwise(F.col("status"))
    return rows.select(*keys, "field", F.coalesce(value, "_more").alias("value"), status.alias("status"))


def exactly(rows: DataFrame, expected: int) -> DataFrame:
    """``rows``, or an error at run time if they are not ``expected`` many: nothing built on them is written then."""
    total = rows.agg(F.count("*").alias("_total"))
    message = F.concat(F.lit(f"expected {expected} rows, found "), F.col("_total").cast("string"))
    alarm = total.filter(F.when(F.col("_total") == expected, False).otherwise(F.raise_error(message).cast("boolean")))  # no row, or the error
    return rows.unionByName(alarm.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields]))


def trust_split(df: DataFrame, fields: list[str]) -> DataFrame:
    """Long form: each field's value with its trust.

    Policy number and dates are candidates, the amounts too when they add up to 0.01; review fields keep their value
    for review; the rest is withheld.
    """
    net, stamp, vat, total = (F.col(a) for a in AMOUNTS)
    adds_up = F.coalesce(F.abs(net + stamp + vat - total) <= F.lit("0.01").cast(CENT), F.lit(False))
    keys = [c for c in df.columns if c not in fields]
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    long = df.select(*keys, adds_up.alias("_adds_up"), F.explode(rows).alias("r")).select(*keys, "_adds_up", "r.*").filter("value is not null")
    f = F.col("field")
    safe = f.isin("policy_number", "coverage_start", "coverage_end") | (f.isin(AMOUNTS) & F.col("_adds_up"))
    status = F.when(safe, "candidate").when(f.isin(REVIEW_FIELDS), "review").otherwise("withheld")
    return long.select(*keys, "field", F.when(status != "withheld", F.col("value")).alias("value"), status.alias("status"))


def layered(parsed: DataFrame, manifest: DataFrame, overrides: DataFrame, by_hand: DataFrame, keys: list[str]) -> DataFrame:
    """Long form layers: override, else manifest, else parsed; plus rows made by hand."""
    sides = [d.select(*keys, F.col("value").alias(f"v{i}")) for i, d in enumerate((parsed, manifest, overrides))]
    joined = sides[0].join(sides[1], keys, "full_outer").join(sides[2], keys, "full_outer")
    origin = F.when(F.col("v2").isNotNull(), "override").when(F.col("v1").isNotNull(), "manifest").otherwise("parsed")
    merged = joined.select(*keys, F.coalesce("v2", "v1", "v0").alias("value"), origin.alias("origin"))
    return merged.unionByName(by_hand.select(*keys, "value", F.lit("by_hand").alias("origin")))


def route_commits(items: DataFrame) -> DataFrame:
    """``route``: attachment (support class with a parent), inbox (without one, or unknown), policy (all others)."""
    doc = F.coalesce("doc_type", F.lit("unknown"))
    route = F.when(~doc.isin(SUPPORT_TYPES), "policy").when(F.col("parent_id").isNotNull() & (doc != "unknown"), "attachment").otherwise("inbox")
    return items.withColumn("route", route)
