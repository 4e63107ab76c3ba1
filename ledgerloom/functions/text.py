"""Comparison keys. Each takes and returns a Column; null in, empty string out unless stated."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Thai letters and digits.
THAI_CONSONANTS = "กขฃคฅฆงจฉชซฌญฎฏฐฑฒณดตถทธนบปผฝพฟภมยรลวศษสหฬอฮ"
THAI_DIGITS = "๐๑๒๓๔๕๖๗๘๙"

# Courtesy titles and company forms dropped from names, in this order.
NAME_TITLES = ["บริษัท", "หจก.", "ห้างหุ้นส่วนจำกัด", "นางสาว", "นาง", "นาย", "คุณ", "นพ.", "พญ.", "ดร."]
LEADING_TITLES = ["นางสาว", "นาง", "นาย", "น.ส.", "ด.ช.", "ด.ญ.", "บจก.", "บมจ.", "หจก.", "บริษัท", "ห้างหุ้นส่วน"]

# Address abbreviations and what they stand for.
ADDRESS_WORDS = [
    (r"ซ\.\s*", "ซอย"),
    (r"ถ\.\s*", "ถนน"),
    (r"ม\.\s*(?=\d)", "หมู่"),
    (r"ต\.\s*", "ตำบล"),
    (r"อ\.\s*", "อำเภอ"),
    (r"จ\.\s*", "จังหวัด"),
]

# Words common to every schedule, useless as identity tokens.
STOP_WORDS = [
    "tokio", "marine", "safety", "insurance", "thailand", "policy", "schedule", "the", "and", "for", "from", "with",
    "item", "company", "code", "motor", "vehicle", "insured", "coverage", "premium", "baht", "direct", "agent",
]


def _text(value) -> Column:
    return F.coalesce(F.col(value).cast("string") if isinstance(value, str) else value.cast("string"), F.lit(""))


def western_digits(value) -> Column:
    return F.translate(_text(value), THAI_DIGITS, "0123456789")


def squeeze(value) -> Column:
    """Runs of white space become one blank, ends trimmed."""
    return F.trim(F.regexp_replace(_text(value), r"(?U)\s+", " "))


def no_blanks(value) -> Column:
    return F.regexp_replace(_text(value), r"(?U)\s+", "")


def blank_to_null(value) -> Column:
    return F.nullif(F.trim(_text(value)), F.lit(""))


def plate_key(value, drop_hyphen: bool = False) -> Column:
    return F.lower(F.regexp_replace(_text(value), r"(?U)[\s\-]+" if drop_hyphen else r"(?U)\s+", ""))


def vin_key(value) -> Column:
    return F.upper(F.regexp_replace(_text(value), r"(?U)[\s\-]", ""))


def identifier_key(value) -> Column:
    return F.regexp_replace(F.upper(_text(value)), "[^A-Z0-9]", "")


def identifier_key_any_script(value) -> Column:
    return F.regexp_replace(F.upper(_text(value)), r"[^\p{L}\p{Nd}]", "")


def name_key(value) -> Column:
    """Titles removed wherever they stand, then blanks, then lower case."""
    return F.lower(no_blanks(reduce(lambda c, t: F.replace(c, F.lit(t), F.lit("")), NAME_TITLES, _text(value))))


def name_key_anchored(value) -> Column:
    """A title at the start only, longest first; punctuation out."""
    titles = "|".join(t.replace(".", r"\.") for t in sorted(LEADING_TITLES, key=len, reverse=True))
    return F.regexp_replace(F.regexp_replace(_text(value), rf"(?U)^({titles})\s*", ""), r"(?U)[\s\-/.,()]+", "")


def loose_key(value) -> Column:
    """Abbreviations expanded, blanks out, lower case; separators stay."""
    return F.lower(no_blanks(expand_address(value)))


def expand_address(value) -> Column:
    return reduce(lambda c, rule: F.regexp_replace(c, "(?U)" + rule[0], rule[1]), ADDRESS_WORDS, _text(value))


def address_key(value) -> Column:
    return F.lower(no_blanks(F.regexp_replace(expand_address(value), r"[/\-]", "")))


def address_words_key(value) -> Column:
    return F.regexp_replace(address_key(value), r"(?U)\d+", "")


def address_compact(value, length: int | None = None) -> Column:
    key = F.regexp_replace(_text(value), r"(?U)[\s\-/.,()]+", "")
    return key if length is None else F.substring(key, 1, length)


def comparison_key(value) -> Column:
    return F.lower(F.regexp_replace(_text(value), "[^0-9A-Za-zก-๙]", ""))


def whole_number_in(number, text) -> Column:
    """True when ``number`` stands in ``text`` with no digit on either side, at any occurrence."""
    runs = F.regexp_extract_all(_text(text), F.lit(r"([^\d]*)(\d+)"), F.lit(2))
    digits_only = _text(number).rlike(r"^\d+$")
    pattern = F.concat(F.lit(r"(?<!\d)\Q"), _text(number), F.lit(r"\E(?!\d)"))
    found = F.when(digits_only, F.array_contains(runs, _text(number))).otherwise(F.regexp_like(_text(text), pattern))
    return (F.length(_text(number)) > 0) & found


def grams(value, size: int) -> Column:
    """Distinct substrings of ``size`` characters; empty when the text is shorter."""
    text = _text(value)
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (size - 1), F.lit(1)))
    pieces = F.transform(starts, lambda at: F.substring(text, at, F.lit(size)))
    return F.when(F.length(text) >= size, F.array_distinct(pieces)).otherwise(F.array().cast("array<string>"))


def shares_run(a, b, size: int = 3) -> Column:
    """A common substring of at least ``size`` characters."""
    return F.arrays_overlap(grams(a, size), grams(b, size))


def car_key(make, model, car) -> Column:
    return F.upper(no_blanks(F.concat_ws(" ", _text(make), _text(model), _text(car))))


def contains_either_way(a: Column, b: Column) -> Column:
    return (F.length(a) > 0) & (F.length(b) > 0) & (a.contains(b) | b.contains(a))


def identity_tokens(value) -> Column:
    """Latin / digit or Thai runs of three or more, upper case, common words out."""
    runs = F.regexp_extract_all(F.upper(_text(value)), F.lit("([A-Z0-9]{3,}|[ก-๙]{3,})"), F.lit(1))
    return F.array_except(F.array_distinct(runs), F.array(*[F.lit(w.upper()) for w in STOP_WORDS]))


def safe_component(value) -> Column:
    """Illegal file name characters to hyphens, blanks squeezed, blanks / dots / hyphens off both ends."""
    swapped = F.regexp_replace(_text(value), r'[<>:"/\\|?*\x00-\x1f]', "-")
    return F.regexp_replace(F.regexp_replace(swapped, r"(?U)\s+", " "), r"^[ .\-]+|[ .\-]+$", "")


def safe_file_text(value, length: int = 80) -> Column:
    dropped = F.regexp_replace(_text(value), r'[<>:"/\\|?*\x00-\x1f]', "")
    return F.substring(F.trim(F.regexp_replace(dropped, r"(?U)\s+", " ")), 1, length)


def joined_address(*parts) -> Column:
    return F.nullif(F.concat_ws(" ", *[blank_to_null(p) for p in parts]), F.lit(""))


def escape_like(text: str) -> str:
    """User text as a literal LIKE fragment."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
