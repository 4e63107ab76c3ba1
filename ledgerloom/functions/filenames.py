"""Reading facts out of file names, and building names for documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.dates import be_two_digits, start_year_be
from ledgerloom.functions.text import (
    THAI_CONSONANTS,
    address_compact,
    no_blanks,
    safe_component,
    safe_file_text,
    squeeze,
)
from ledgerloom.session import once

# Patterns of the archive's naming convention.
PLATE_THEN_LABEL = rf"^(\d?[{THAI_CONSONANTS}]{{1,2}}\s?\d{{1,4}})(?=\s|พรบ|กธ|PA|สลักหลัง|ยกเลิก|\.pdf)"
OLD_PLATE_THEN_LABEL = r"^(\d{6,7})(?=\s|พรบ|กธ|\.pdf)"
YEAR_AFTER_LABEL = r"(?:กธ|พรบ|PA|สลักหลัง|ยกเลิก)\s*\.?\s*(\d{2})|(?<!\d)(\d{2})\s*\.\s*pdf"
HOUSE_THEN_PLACE = rf"^(\d+(?:[-/]\d+)?(?:[-/]\d+)?)\s*([{THAI_CONSONANTS}][^\s]*?)(?:\s|$)"
NAME_THEN_LABEL = rf"^([{THAI_CONSONANTS}].+?)\s*(?:กธ|พรบ|PA|\d{{2}}\.|\.pdf|$)"
SCAN_PLATE = r"^((?:\d{1,2})?[ก-ฮ]{1,2}\d{1,5})"
SCAN_YEAR = r"(?:กธ|พรบ|พรล|PA|พ\.ร\.บ|ภ\.ค)\.?\s*(\d{2})(?:\D|$)"
SCAN_YEAR_ALONE = r"\s(\d{2})(?:\.|\s|$|_|\))"
SCAN_COMPULSORY = r"พรบ|พรล|พ\.ร\.บ"
SCAN_SPECIAL = "ยกเลิก|สลักหลัง|แนบ|บัตรเครดิต|บัตรประชาชน|ทะเบียน|ใบขับขี่|ใบเตือน|เคลม"
SCAN_TAIL_ADDRESS = r"\s*(?:กธ|พรบ|พรล|PA|พ\.ร\.บ|ภ\.ค)\..*$|\s*\(.*$|\s+\d{2}.*$"
SCAN_TAIL_STRICT = r"\s+(?:กธ|พรบ|พรล|PA)\..*$|\s+\d{2}.*$|\s+\(.*$"
SCAN_TAIL_PREFIX = (
    r"\s*(?:กธ|พรบ|พรล|พ\.ร\.บ|PA|ภ\.ค|ภค|ทอพ|FF|PL|HF)\.?\s*\d{0,2}.*$"
    r"|\s*\(?(?:ยกเลิก|สลักหลัง|แนบ|ใหม่|แก้ไข)[^)]*\)?.*$"
    r"|\s+\d{2}(?:[\s.\(_].*)?$"
)
NEEDS_REVIEW_NAME = "รอตรวจข้อมูล.pdf"


def _found(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def stem_of(name) -> Column:
    """File name without its last suffix. The pattern is only needed for names with line breaks, where it ends at lines."""
    text = F.col(name) if isinstance(name, str) else name
    at = F.length(text) - F.length(F.substring_index(text, ".", -1))  # of the last dot; 0 without one
    plain = F.when(at > 1, F.substring(text, F.lit(1), at - 1)).otherwise(text)
    return F.when(text.rlike(r"[\n\r\u0085\u2028\u2029]"), F.regexp_replace(text, r"(?<=.)\.[^.]*$", "")).otherwise(plain)


def with_archive_name(df: DataFrame, name: str = "name", suffix_length: int = 25) -> DataFrame:
    """Adds kind, key, number, suffix and year_be. Kinds in order of test: plate, address, name, unknown.

    Staged so that each pattern runs once per row, and only on rows that no earlier kind took.
    """
    stem = F.col("_stem")
    counted = F.when(stem.contains("_"), F.regexp_replace(stem, r"_\d{4}$", "")).otherwise(stem)
    cleaned = F.trim(F.when(stem.contains("("), F.regexp_replace(counted, r"(?U)\s*\(.*?\)\s*", " ")).otherwise(counted))
    year = F.coalesce(_found(F.col(name), YEAR_AFTER_LABEL, 1), _found(F.col(name), YEAR_AFTER_LABEL, 2)).try_cast("int") + 2500
    staged = once(once(df, _stem=stem_of(name)), _cleaned=cleaned, year_be=year)
    text, plate, house, place, person = (F.col(c) for c in ("_cleaned", "_plate", "_house", "_place", "_person"))
    staged = once(staged, _plate=F.replace(F.coalesce(_found(text, PLATE_THEN_LABEL, 1), _found(text, OLD_PLATE_THEN_LABEL, 1)), F.lit(" "), F.lit("")))
    staged = once(
        staged,
        _house=F.when(plate.isNull(), _found(text, HOUSE_THEN_PLACE, 1)),
        _place=F.when(plate.isNull(), F.substring(_found(text, HOUSE_THEN_PLACE, 2), 1, suffix_length)),
    )
    staged = once(staged, _person=F.when(plate.isNull() & house.isNull(), F.trim(_found(text, NAME_THEN_LABEL, 1))))
    is_address, is_name = plate.isNull() & house.isNotNull(), F.length(person) >= 3
    return staged.select(
        *df.columns,
        F.when(plate.isNotNull(), "plate").when(house.isNotNull(), "address").when(is_name, "name").otherwise("unknown").alias("kind"),
        F.when(plate.isNotNull(), plate)
        .when(house.isNotNull(), F.trim(F.concat(house, F.lit(" "), place)))
        .when(is_name, person)
        .otherwise(text)
        .alias("key"),
        F.when(is_address, house).alias("number"),
        F.when(is_address, place).alias("suffix"),
        "year_be",
    )


# The signs of a loose name. A word sign is a letter, a digit or an underscore; Thai marks are none.
_WORD = r"[\p{L}\p{N}_]"
LOOSE_LABEL = r"(?:กธ|พรบ|ก\.ธ|พ\.ร\.บ)"
LOOSE_PLATE = r"(?:^|\s)(\d?[ก-ฮ]{1,2})\s*(\d{2,4})(?:\s|$)"
LOOSE_PLATE_INSIDE = rf"^([\s\S]*?)(?<!{_WORD})([ก-ฮ]{{1,2}})\s*(\d{{2,4}})(?!{_WORD})"
LOOSE_YEAR = rf"{LOOSE_LABEL}[\s\.]*(\d{{2}})(?!{_WORD})"
LOOSE_DATE = r"(?i)(\d{1,2})\.(\d{1,2})\.(\d{2,4})(?:\s|$|\.pdf)"
LOOSE_YEARS, LOOSE_DATE_YEARS = (2000, 2030), (1990, 2035)
PLATE_ANYWHERE = r"\d*[ก-ฮ]{1,2}\s*\d{2,4}"


def parse_loose_name(name) -> Column:
    """struct(license_plate, year_be, coverage_end, insured_address, insured_name) read from a name without a fixed form.

    The plate stands between blanks, else anywhere but right after a label. A label's year means 31 December of it; a d.m.y
    date in range replaces that. Without label, date, brackets, counter, plate and leading numbers, what is left is an
    address (the name up to a label) if it has four Thai signs among six, or a person if it is all Latin capitals.
    """
    base = F.trim(F.regexp_replace(F.col(name) if isinstance(name, str) else name, r"\.(pdf|PDF)$", ""))
    part = lambda pattern, k: F.regexp_extract(base, pattern, k)
    refused = part(LOOSE_PLATE_INSIDE, 1).rlike(rf"{LOOSE_LABEL}\s*$")
    plate = F.when(base.rlike(LOOSE_PLATE), F.concat_ws(" ", part(LOOSE_PLATE, 1), part(LOOSE_PLATE, 2))).when(
        base.rlike(LOOSE_PLATE_INSIDE) & ~refused, F.concat_ws(" ", part(LOOSE_PLATE_INSIDE, 2), part(LOOSE_PLATE_INSIDE, 3))
    )
    year = part(LOOSE_YEAR, 1).try_cast("int") + 2500 - 543
    year = F.when(year.between(*LOOSE_YEARS), year)
    day, month, y = (part(LOOSE_DATE, k).try_cast("int") for k in (1, 2, 3))
    y = F.when(y < 100, y + 2000).when(y >= 2500, y - 543).otherwise(y)
    dated = y.between(*LOOSE_DATE_YEARS) & month.between(1, 12) & day.between(1, 31)
    end = F.when(dated, F.concat_ws("-", y, month, day)).otherwise(F.concat(year.cast("string"), F.lit("-12-31")))

    def without(text: Column, *patterns: str) -> Column:
        for pattern in patterns:
            text = F.regexp_replace(text, pattern, "")
        return F.trim(F.regexp_replace(text, r"[\s_]+", " "))

    brackets = r"\(.*?\)"
    clean = without(base, rf"{LOOSE_LABEL}[\s\.]*\d{{2}}(?!{_WORD}).*", r"\d{1,2}\.\d{1,2}\.\d{2,4}.*", brackets, r"_\d{4}$")
    clean = F.trim(F.regexp_replace(F.trim(F.regexp_replace(clean, PLATE_ANYWHERE, "")), r"^[\d\-/\.]+\s*", ""))
    thai = F.length(F.regexp_replace(clean, r"[^\u0E01-\u0E7F]", ""))
    is_place = clean.rlike(r"[\u0E01-\u0E5B]") & (thai >= 4) & (F.length(clean) >= 6)
    address = without(F.regexp_replace(base, r"^(\d+)-(\d+)", "$1/$2"), r"(?:กธ|พรบ)[\s\.]*\d{2}.*", brackets, r"_\d{4}")
    long_enough = F.length(F.trim(F.regexp_replace(address, PLATE_ANYWHERE, ""))) >= 5
    person = F.when(~is_place & clean.rlike(r"^[A-Z][A-Z\s]+$") & (F.length(clean) >= 4), F.initcap(F.lower(clean)))
    return F.struct(
        plate.alias("license_plate"), F.when(year.isNotNull(), year + 543).alias("year_be"), end.try_cast("date").alias("coverage_end"),
        F.when(is_place & long_enough, F.substring(address, 1, 200)).alias("insured_address"), person.alias("insured_name"),
    )


def scan_year(stem: Column) -> Column:
    return F.coalesce(_found(stem, SCAN_YEAR, 1), _found(stem, SCAN_YEAR_ALONE, 1)).try_cast("int")


def with_scan_facts(df: DataFrame) -> DataFrame:
    """Adds plate, year, compulsory, special, plain, address_key, strict_key, prefix_key and first_token of a scan."""
    stem = F.col("_stem")

    def key(text: Column) -> Column:
        return F.nullif(address_compact(text), F.lit(""))

    facts = once(df, _stem=stem_of("name")).select(
        *df.columns,
        _found(stem, SCAN_PLATE, 1).alias("plate"),
        scan_year(stem).alias("year"),
        stem.rlike(SCAN_COMPULSORY).alias("compulsory"),
        stem.rlike(SCAN_SPECIAL).alias("special"),
        F.trim(F.regexp_replace(stem, SCAN_TAIL_ADDRESS, "")).alias("plain"),
        key(F.trim(F.regexp_replace(stem, SCAN_TAIL_STRICT, ""))).alias("strict_key"),
        key(F.trim(F.regexp_replace(stem, SCAN_TAIL_PREFIX, ""))).alias("prefix_key"),
        F.substring(F.split_part(stem, F.lit(" "), F.lit(1)), 1, 40).alias("first_token"),
    )
    return facts.withColumn("address_key", key(F.col("plain")))


def display_name(plate, doc_type, coverage_start, policy_type, risk_address, insured_name) -> Column:
    """Name shown for a stored document. Start year only; the end date and the contact address never stand in."""
    kind = F.upper(F.trim(F.coalesce(F.col(policy_type), F.lit(""))))
    doc = F.col(doc_type)
    compulsory = doc.isin("prb", "motor_prb") | ((doc == "main") & (kind == "P"))
    fire = ~compulsory & (kind.isin("FIRE", "ASSET", "IAR", "BURGLAR") | (doc == "fire"))
    person = ~compulsory & kind.isin("PA", "TA", "3RD", "PUBLIC", "MISC", "GOLF", "MARINE")
    year = start_year_be(coverage_start).cast("string")
    ident = F.nullif(
        F.when(fire, safe_component(risk_address)).when(person, safe_component(insured_name)).otherwise(
            safe_component(no_blanks(plate))
        ),
        F.lit(""),
    )
    label = F.when(doc == "renewal_notice", F.lit("แจ้งเตือนต่ออายุ")).when(compulsory, F.lit("พรบ.")).otherwise(F.lit("กธ"))
    stem = F.when(fire | person, ident).otherwise(F.concat(ident, F.lit("-"), label, F.lit("-"), year))
    ending = F.when(doc == "endorsement", F.lit("-สลักหลัง.pdf")).otherwise(F.lit(".pdf"))
    return F.coalesce(F.concat(stem, ending), F.lit(NEEDS_REVIEW_NAME))


def archive_name(policy_type, plate, address, name, number, end, start, is_compulsory: Column | None = None, uploads: bool = False) -> Column:
    """Name in the archive folders, with the Buddhist year of the end date. ``uploads`` names as the upload jobs do: burglary
    like fire, third party and public liability like personal accident, and never a policy number."""
    kind = F.upper(F.trim(F.coalesce(F.col(policy_type), F.lit(""))))
    compulsory = (kind == "P") if is_compulsory is None else (is_compulsory | (kind == "P"))
    tail = F.coalesce(F.concat(F.lit("."), F.lpad(be_two_digits(end, start).cast("string"), 2, "0")), F.lit(""))

    def label(*columns: str, fallback: str) -> Column:
        return F.coalesce(*[F.nullif(safe_file_text(c), F.lit("")) for c in columns], F.lit(fallback))

    fire, person = ["FIRE", "IAR", "ASSET"], ["PA", "TA", "GOLF"]
    if uploads:
        fire, person = [*fire, "BURGLAR"], [*person, "3RD", "PUBLIC"]
    last = [name, plate] if uploads else [name, plate, number]
    plate_text = F.coalesce(F.nullif(safe_file_text(no_blanks(plate), 40), F.lit("")), F.lit("ไม่ระบุทะเบียน"))
    return F.concat(
        F.when(compulsory, F.concat(plate_text, F.lit(" พรบ")))
        .when(kind == "M", F.concat(plate_text, F.lit(" กธ")))
        .when(kind.isin(*fire), F.concat(label(address, fallback="ไม่ระบุที่อยู่"), F.lit(" กธ")))
        .when(kind.isin(*person), F.concat(label(address, name, fallback="ไม่ระบุ"), F.lit(" PA")))
        .otherwise(F.concat(label(*last, fallback="unknown"), F.lit(" กธ"))),
        tail,
        F.lit(".pdf"),
    )


def archive_folder(policy_type) -> Column:
    """One of eight folders."""
    kind = F.upper(F.trim(F.coalesce(F.col(policy_type), F.lit(""))))
    return (
        F.when(kind == "M", "motor")
        .when(kind == "P", "prb")
        .when(kind == "FIRE", "fire")
        .when(kind.isin("PA", "TA", "GOLF"), "pa_ta")
        .when(kind.isin("IAR", "ASSET"), "asset")
        .when(kind == "MARINE", "marine")
        .when(kind == "โจรกรรม", "theft")
        .otherwise("other")
    )


def review_copy_name(document_type, policy_type, plate, address, name, start, end) -> Column:
    """Review copy: identity falls back across plate, name and address."""
    kind = F.upper(F.trim(F.coalesce(F.col(policy_type), F.lit(""))))
    first_line = F.substring(F.trim(F.split_part(F.coalesce(F.col(address), F.lit("")), F.lit("\n"), F.lit(1))), 1, 40)
    p, a, n = (F.nullif(x, F.lit("")) for x in (no_blanks(plate), first_line, F.trim(F.coalesce(F.col(name), F.lit("")))))
    doc = F.col(document_type)
    fire = kind.isin("FIRE", "ASSET", "IAR", "BURGLAR")
    person = kind.isin("PA", "TA", "3RD", "PUBLIC", "MISC", "GOLF", "MARINE")
    ident = F.when(doc == "prb", p).when(fire, F.coalesce(a, p, n)).when(person, F.coalesce(n, p, a)).otherwise(F.coalesce(p, n, a))
    label = (
        F.when(doc == "prb", "พรบ")
        .when(~(fire | person) & (doc == "endorsement"), "สลักหลัง")
        .otherwise("กธ")
    )
    chosen = F.coalesce(F.col(start).cast("string"), F.col(end).cast("string"))
    year = F.when(chosen.rlike(r"^\d{4}-"), F.lpad(((F.substring(chosen, 1, 4).try_cast("int") + 543) % 100).cast("string"), 2, "0"))
    return F.concat(F.coalesce(ident, F.lit("ไม่ทราบ")), F.lit(" "), label, F.coalesce(F.concat(F.lit("."), year), F.lit("")), F.lit(".pdf"))


def url_class(url) -> Column:
    """legacy_storage / object_store / drive / other."""
    u = F.col(url) if isinstance(url, str) else url
    return (
        F.when(u.contains("drive.google.com/file/d/"), "drive")
        .when(u.contains("/storage/v1/object/public/"), "legacy_storage")
        .when(u.contains(".r2.dev/"), "object_store")
        .otherwise("other")
    )


def storage_key(url, public_base: str) -> Column:
    """Object key of a public URL: base, query and fragment cut, percent-encoding undone once."""
    u = F.col(url) if isinstance(url, str) else url
    base = public_base.rstrip("/") + "/"
    path = F.when(u.startswith(base), F.substring(u, F.lit(len(base) + 1), F.length(u))).otherwise(
        F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?/?([^?#]*)", 1)
    )
    path = F.regexp_replace(path, r"[?#].*$", "")
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)


def bucket_key(url, bucket: str, marker: str = "/storage/v1/object/public/") -> Column:
    """Object name in ``bucket`` of a legacy public URL; null for any other URL."""
    u = F.col(url) if isinstance(url, str) else url
    rest = F.regexp_replace(F.nullif(F.regexp_extract(u, r"\Q" + marker + r"\E(.*)$", 1), F.lit("")), r"[?#].*$", "")
    return F.nullif(F.regexp_extract(rest, rf"^\Q{bucket}\E/(.*)$", 1), F.lit(""))
