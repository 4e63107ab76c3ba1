"""Dates from text. Two-digit years and the Buddhist era differ by loader, so each profile is its own function."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerloom.functions.text import no_blanks, western_digits

# Month names, January to December.
THAI_MONTHS = [
    "มกราคม", "กุมภาพันธ์", "มีนาคม", "เมษายน", "พฤษภาคม", "มิถุนายน", "กรกฎาคม", "สิงหาคม", "กันยายน", "ตุลาคม",
    "พฤศจิกายน", "ธันวาคม",
]
THAI_MONTHS_SHORT = [
    "ม.ค.", "ก.พ.", "มี.ค.", "เม.ย.", "พ.ค.", "มิ.ย.", "ก.ค.", "ส.ค.", "ก.ย.", "ต.ค.", "พ.ย.", "ธ.ค.",
]
ENGLISH_MONTHS = [
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november",
    "december",
]

_MONTH_ALTERNATIVES = "|".join(m.replace(".", r"\.") for m in THAI_MONTHS_SHORT + THAI_MONTHS)
THAI_DATE = rf"(\d{{1,2}})\s*({_MONTH_ALTERNATIVES})\s*(\d{{2,4}})"
ANY_DATE = rf"(\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}|\d{{1,2}}\s*(?:{_MONTH_ALTERNATIVES})\s*\d{{2,4}})"


def _int(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def _date(year: Column, month: Column, day: Column) -> Column:
    """Null for impossible dates."""
    return F.concat_ws(
        "-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")
    ).try_cast("date")


def _western(year: Column, era: int) -> Column:
    return F.when(year >= era, year - 543).otherwise(year)


def thai_month_number(word: Column) -> Column:
    table = F.create_map(
        *[F.lit(x) for names in (THAI_MONTHS, THAI_MONTHS_SHORT) for i, n in enumerate(names, 1) for x in (n, i)]
    )
    return F.try_element_at(table, word)


def date_web_form(value, prefix_ok: bool = False) -> Column:
    """ISO or d/m/y; two-digit years are 20yy; 2500 and later lose 543."""
    text = F.trim(F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit("")))
    iso = r"^(\d{4})-(\d{2})-(\d{2})" + ("" if prefix_ok else "$")
    dmy = r"^(\d{1,2})/(\d{1,2})/(\d{2,4})$"
    y_iso, y_dmy = _int(text, iso, 1), _int(text, dmy, 3)
    y_dmy = F.when(y_dmy < 100, y_dmy + 2000).otherwise(y_dmy)
    return F.when(text.rlike(iso), _date(_western(y_iso, 2500), _int(text, iso, 2), _int(text, iso, 3))).when(
        text.rlike(dmy), _date(_western(y_dmy, 2500), _int(text, dmy, 2), _int(text, dmy, 1))
    )


def date_document(value) -> Column:
    """d/m/y or a Thai month; two-digit years from 40 are 25yy, below 20yy; real dates only."""
    text = F.trim(western_digits(value))
    num = r"(?<!\d)(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})(?!\d)"
    tha = r"(?<!\d)" + THAI_DATE + r"(?!\d)"
    is_num = text.rlike(num)
    day = F.when(is_num, _int(text, num, 1)).otherwise(_int(text, tha, 1))
    month = F.when(is_num, _int(text, num, 2)).otherwise(thai_month_number(F.regexp_extract(text, tha, 2)))
    year = F.when(is_num, _int(text, num, 3)).otherwise(_int(text, tha, 3))
    year = F.when(year < 40, year + 2000).when(year < 100, year + 2500).otherwise(year)
    return _date(_western(year, 2500), month, day)


def dates_in_text(value) -> Column:
    """All dates of 1990..2035 in reading order, distinct: Thai months (yy is 25yy), d/m/y and English months (20yy)."""
    text = F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(""))
    english = "|".join(sorted({m for m in ENGLISH_MONTHS} | {m[:3] for m in ENGLISH_MONTHS}, key=len, reverse=True))
    pattern = (
        rf"(\d{{1,2}}\s*(?:{_MONTH_ALTERNATIVES})\s*\d{{2,4}}|\d{{1,2}}/\d{{1,2}}/\d{{2,4}}"
        rf"|(?i:\d{{1,2}}\s+(?:{english})\s+\d{{2,4}}))"
    )
    months = F.create_map(*[F.lit(x) for i, m in enumerate(ENGLISH_MONTHS, 1) for x in (m[:3], i)])

    def one(piece: Column) -> Column:
        eng = r"^(\d{1,2})\s+([A-Za-z]+)\s+(\d{2,4})$"
        num = r"^(\d{1,2})/(\d{1,2})/(\d{2,4})$"
        thai = piece.rlike(THAI_DATE)
        year = F.regexp_extract(piece, r"(\d{2,4})$", 1).try_cast("int")
        year = F.when(year < 100, year + F.when(thai, 2500).otherwise(2000)).otherwise(year)
        year = _western(year, 2500)
        month = (
            F.when(thai, thai_month_number(F.regexp_extract(piece, THAI_DATE, 2)))
            .when(piece.rlike(num), _int(piece, num, 2))
            .otherwise(F.try_element_at(months, F.substring(F.lower(F.regexp_extract(piece, eng, 2)), 1, 3)))
        )
        return F.when(year.between(1990, 2035), _date(year, month, _int(piece, r"^(\d{1,2})", 1)))

    return F.array_distinct(F.array_compact(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), one)))


def date_export(value) -> Column:
    """ISO (as is) or d/m/y; 2400 and later lose 543; 1900..2100."""
    text = F.trim(F.coalesce((F.col(value) if isinstance(value, str) else value).cast("string"), F.lit("")))
    dmy = r"^(\d{1,2})/(\d{1,2})/(\d{2,4})"
    year = _int(text, dmy, 3)
    year = F.when(year >= 2400, year - 543).when(year < 100, year + 2000).otherwise(year)
    iso = F.substring(text, 1, 10)
    return F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}$"), iso.try_cast("date")).when(
        year.between(1900, 2100), _date(year, _int(text, dmy, 2), _int(text, dmy, 1))
    )


def start_year_be(value) -> Column:
    """Buddhist year of a real ISO or d/m/yyyy date (2400 and later are Buddhist already), else null."""
    text = western_digits(value)
    iso, dmy = r"^(\d{4})-(\d{2})-(\d{2})$", r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
    found = F.when(
        text.rlike(iso), _date(_western(_int(text, iso, 1), 2400), _int(text, iso, 2), _int(text, iso, 3))
    ).when(text.rlike(dmy), _date(_western(_int(text, dmy, 3), 2400), _int(text, dmy, 2), _int(text, dmy, 1)))
    return F.year(found) + 543


def coverage_year(value) -> Column:
    """First four characters as a western year."""
    return _western(F.substring((F.col(value) if isinstance(value, str) else value).cast("string"), 1, 4).try_cast("int"), 2500)


def year_distance(policy_year: Column, file_year_be: Column) -> Column:
    return F.when(file_year_be.isNull(), 0).when(policy_year.isNull(), 999).otherwise(
        F.abs(policy_year - (file_year_be - 543))
    )


def be_two_digits(end, start) -> Column:
    """Last two digits of the Buddhist year, from the end date, else the start."""
    chosen = F.coalesce(*[(F.col(c) if isinstance(c, str) else c).cast("string") for c in (end, start)])
    return (F.substring(chosen, 1, 4).try_cast("int") + 543) % 100


def closest_month_candidates(value) -> Column:
    """Month names a 0.78 ratio could reach: with at most 26 characters in all, no more than 6 edits apart."""
    word = no_blanks(value)
    return F.filter(F.array(*[F.lit(m) for m in THAI_MONTHS]), lambda m: F.levenshtein(m, word) <= 6)
