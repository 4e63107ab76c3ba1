"""Fields of older schedules, whose text comes garbled from scans: labels in several spellings, digits read as letters, amounts
on lines of their own. Everything is a Column expression inside one row, so nothing here shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions import text as X
from ledgerloom.functions.dates import dates_in_text
from ledgerloom.functions.filenames import parse_loose_name
from ledgerloom.operators.extract import NO_WORD_AFTER as END, NO_WORD_BEFORE as START
from ledgerloom.operators.rules import insurer_by_pattern

# Possessive repeats keep long runs of blanks and digits linear.
# Spellings of the labels, makes and models in order of test, province codes behind a plate.
NUMBERS = [
    r"(?:policy\s*num(?:ber|hcr|bcr)|กรมธรรม(?:ประกันภัย)?เลขที่)[:\s]*([A-Z0-9][A-Z0-9/\-]{5,25})",
    rf"{START}(D[O0]-?\d{{2}}-[0-9sc]{{2}}[/r][0-9co]{{4,8}}){END}",
    rf"{START}([A-Z]{{0,2}}\d{{1,2}}-\d{{2}}-\d{{2,4}}[/r]\d{{4,8}}){END}",
    r"policy\s*(?:no|number)[.\s:]*([A-Z0-9][A-Z0-9/\-.]{5,25})",
]
NAMES = [
    r"([ก-๙][ก-๙\s.]{3,50}?)(?<!\s)\s{2,}+insured\s+name",
    r"(?:ผู้[ก-๙]{1,4}ประกัน[ก-๙]{0,6}(?:ชื่อ)?|insured\s*name)[:\s]*([ก-๙][ก-๙\s.]{3,60})",
    r"((?:คุณ|นาย|นาง(?:สาว)?|น\.ส\.|บริษัท)\s*[ก-๙][ก-๙\s./]{2,60}(?:จำกัด|จํากัด)?)",
]
NAME_ENDS = r"\s{2,}|\n|insured|address|ที่อยู|อาชีพ|occupation|driver"
ADDRESSES = [
    r"ที่(?:กยู่?|อยู่?)\s*(\d+[^\n\r]{10,200}?\d{5})",
    r"address\s+([ก-๙\d][^\n\r]{10,200}?\d{5})",
    r"(?<![^\n\r])[^\d\n\r]*+(\d[^\n\r]*(?:ซอย|ถนน|แขวง|ซ\.|ถ\.)[^\n\r]*\d{5})",
]
ADDRESS_ENDS = r"\s+(?:อาชีพ|occupation|driver|ผู้ขับ|lthe)"
PROVINCE_CODES = (
    "กท กร กบ กข กค กง กจ กช นบ นค นฉ นม บจ บร บษ ปข ปน ผข พก พน พร พล มก มด มน รก รน ลจ วก วน สก สข สง สน สย สร สว สส อก อด อน"
).split()
PLATES = [
    (rf"{START}([ก-ฮ]{{1,2}})\s*(\d{{3,4}})\s*({'|'.join(PROVINCE_CODES)}){END}", 3),
    (rf"{START}([ก-ฮ]{{1,2}})\s*(\d{{3,4}}){END}", 2),
    (rf"{START}(\d[ก-ฮ]{{2}})\s*(\d{{3,4}}){END}", 2),
]
CHASSIS = [
    r"(?:chassis\s*no|เลขตัวถัง)[:\s]*([A-Z0-9$#@]{10,20})",
    r"[ก-ฮ]{1,2}\s*\d{3,4}(?:\s*+[ก-ฮ]{2,3})?+\s++([A-Z0-9$#]{10,20})\s++\d{4}",
]
OLDER_MAKES = (
    "TOYOTA HONDA ISUZU NISSAN MITSUBISHI SUZUKI FORD CHEVROLET BMW MERCEDES BENZ MAZDA HYUNDAI KIA SUBARU VOLVO MG LEXUS MINI PORSCHE "
    "AUDI TESLA HINO FUSO JAC FOTON BYD HAVAL GWM"
).split()
MODELS = {
    "MITSUBISHI": ["LANCER", "PAJERO SPORT", "PAJERO", "TRITON", "OUTLANDER", "ATTRAGE", "MIRAGE", "ECLIPSE CROSS"],
    "TOYOTA": [
        "CAMRY", "COROLLA CROSS", "COROLLA", "FORTUNER", "HILUX REVO", "HILUX", "VIOS", "YARIS ATIV", "YARIS", "CHR", "RAV4", "ALPHARD",
        "VELLFIRE", "INNOVA",
    ],
    "HONDA": ["CIVIC", "ACCORD", "CR-V", "HR-V", "CITY HATCHBACK", "CITY", "JAZZ", "BR-V", "WR-V"],
    "ISUZU": ["MU-7", "MU-X", "D-MAX", "DMAX", "TROOPER"],
    "NISSAN": ["NAVARA", "ALMERA", "TEANA", "X-TRAIL", "MARCH", "NOTE", "KICKS", "TERRA"],
    "FORD": ["RANGER RAPTOR", "RANGER", "EVEREST", "TERRITORY", "MUSTANG"],
    "MAZDA": ["CX-30", "CX-3", "CX-5", "CX-8", "MAZDA2", "MAZDA3"],
    "MG": ["ZS EV", "ZS", "HS", "EP", "VS", "MG3", "MG5"],
    "SUZUKI": ["SWIFT", "CIAZ", "VITARA", "ERTIGA", "JIMNY", "CARRY"],
}
#: Behind four digits: they are not a plate's, which stand behind one or two consonants that are a word of their own.
NOT_A_PLATE = r"(?<!(?<![\p{L}\p{M}\p{N}_])\d?[ก-ฮ]{1,2}[\s\-]{0,5}\d{4})"
YEARS = [
    r"[A-Z0-9]{10,17}\s++(\d{4})\s++(?:sedan|wagon|suv|pickup|hatchback|van|saloon|truck)",
    r"(?:model\s*yr|ปีที่ผลิต|ปีรถ|year\s*of)[:\s]*(\d{4})",
    rf"{START}(199\d|20[0-2]\d){END}{NOT_A_PLATE}",
]
_SUM = r"([\d',o ]+(?:\.\d{1,2})?)"
SUMS = {
    "net_premium": [r"(?:net\s*pre[mr][ei]ium|เบี้ยประกันภัยสุทธิ|เบี้ยสุทธิ)[:\s(Baht)]*" + _SUM, r"net\s+p[a-z]*\s*\(baht\)\s*([\d',o ]+)"],
    "stamp_duty": [r"(?:stamp\s*du(?:ty|e)|อากรแสตมป์)[:\s(Baht)]*" + _SUM],
    "vat": [r"(?:vat|ภาษีมูลค่าเพิ่ม|ภาษี\s*7%)[:\s(Baht)]*" + _SUM],
    "total_premium": [r"(?:total|รวม(?:เบี้ย)?(?:ประกันภัย)?(?:ทั้งสิ้น)?|grand\s*total|total\s*\(bah?[lt]\))[:\s]*" + _SUM],
}
#: Sign of a line whose amount stands in for a missing sum, and whether its last amount counts or its first.
SUM_LINES = {"net_premium": (["NET"], False), "total_premium": (["TOTAL", "GRAND"], True), "stamp_duty": (["STAMP"], False), "vat": (["VAT"], False)}
BROKER = r"(?:นายหน้า|ตัวแทน|broker|agent)\s*(?:ชื่อ)?[:\s]*([ก-๙A-Z][ก-๙A-Z\s.]{3,50})"
NOT_A_BROKER = r"(?i)ประกันวินาศภัย|insurance|บริษัท|จำกัด|pcl"
LICENSE = r"(?:ใบอนุญาต|license\s*no)[:\s]*([A-Z]?\d{7,12})"
FIELDS = [
    "policy_number", "company_code", "insured_name", "insured_address", "license_plate", "chassis_no", "car_make", "car_model", "car_year",
    "coverage_start", "coverage_end", "net_premium", "stamp_duty", "vat", "total_premium", "broker_name", "broker_license",
]


def _first(text: Column, pattern: str, group: int = 1, flags: str = "(?iU)") -> Column:
    """Blanks, digits and letter case of any script; empty when nothing is found."""
    return F.regexp_extract(text, flags + pattern, group)


def _first_kept(values: list[Column], keep) -> Column:
    """The first value that ``keep`` takes. Each value is computed once, whatever ``keep`` does with it."""
    return F.get(F.filter(F.array(*values), lambda v: F.coalesce(keep(v), F.lit(False))), F.lit(0))


def older_number(text: Column) -> Column:
    """Each pattern's first match; O is read as 0 and R as a slash; eight characters or more."""
    found = [F.translate(F.upper(X.no_blanks(_first(text, p))), "OR", "0/") for p in NUMBERS]
    return _first_kept(found, lambda v: F.length(v) >= 8)


def older_name(text: Column) -> Column:
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit("(?iU)" + p), F.lit(1)) for p in NAMES]))
    cut = F.transform(found, lambda v: X.squeeze(F.get(F.split(v, "(?iU)" + NAME_ENDS), F.lit(0))))
    thai = lambda v: F.length(F.regexp_replace(v, r"[^ก-๿]", ""))
    return F.get(F.filter(cut, lambda v: (thai(v) >= 2) & F.length(v).between(4, 80)), F.lit(0))


def older_address(text: Column) -> Column:
    found = F.array(*[_first(text, p) for p in ADDRESSES])
    cut = F.transform(found, lambda v: F.get(F.split(v, "(?iU)" + ADDRESS_ENDS), F.lit(0)))
    tidy = F.transform(cut, lambda v: X.squeeze(F.regexp_replace(v, f"(?iU){START}address{END}", "")))
    return F.substring(F.get(F.filter(tidy, lambda v: F.length(v) >= 10), F.lit(0)), 1, 250)


def older_plate(text: Column) -> Column:
    # The match is found once; its parts come out of the match.
    def parts(p: str, n: int) -> Column:
        return F.transform(F.array(_first(text, p, 0, "(?U)")), lambda v: F.concat_ws(" ", *[F.nullif(_first(v, p, g, "(?U)"), F.lit("")) for g in range(1, n + 1)]))

    return F.get(F.filter(F.concat(*[parts(p, n) for p, n in PLATES]), lambda v: F.length(v) > 0), F.lit(0))


def older_chassis(text: Column) -> Column:
    return _first_kept([X.identifier_key(_first(text, p)) for p in CHASSIS], lambda v: F.length(v) >= 10)


def older_make(upper: Column) -> Column:
    return F.coalesce(*[F.when(upper.contains(m), F.lit(m)) for m in OLDER_MAKES])


def older_model(upper: Column, make: Column) -> Column:
    """A known model of the make anywhere in the text, else the word behind the make."""
    known = F.coalesce(*[F.when(make == m, F.coalesce(*[F.when(upper.contains(w), F.lit(w)) for w in words])) for m, words in MODELS.items()])
    behind = F.call_function("regexp_extract", upper, F.concat(F.lit("(?U)"), make, F.lit(r"\s+([A-Z][A-Z0-9\-]{2,15})")), F.lit(1))
    return F.coalesce(known, F.nullif(behind, F.lit("")))


def older_year(text: Column) -> Column:
    """1990 to 2030; 2500 to 2580 is Buddhist. Without a label the first such number counts that isn't a plate's."""
    found = F.transform(F.array(*[_first(text, p) for p in YEARS]), lambda v: X.western_digits(v).try_cast("int"))
    western = F.transform(found, lambda y: F.when(y.between(2500, 2580), y - 543).otherwise(y))
    return F.get(F.filter(western, lambda y: F.coalesce(y.between(1990, 2030), F.lit(False))), F.lit(0))


def older_amount(value: Column) -> Column:
    """An amount as old fonts print it: an apostrophe parts thousands, an o between digits is a zero."""
    text = F.regexp_replace(F.replace(X.western_digits(value), F.lit("'"), F.lit("")), r"(?i)(?<=\d)o(?=\d|$)", "0")
    text = F.regexp_replace(text, rf"(?U)(\d)\s(\d{{2}}){END}", "$1$2")
    return F.trim(F.replace(text, F.lit(","), F.lit(""))).try_cast("decimal(18,2)")


def first_amount(values: list[Column]) -> Column:
    """The first positive one."""
    return F.get(F.filter(F.transform(F.array(*values), older_amount), lambda v: F.coalesce(v > 0, F.lit(False))), F.lit(0))


def with_older_sums(df: DataFrame, text: str) -> DataFrame:
    """Adds the four sums: behind their labels; if net or total is missing there, missing ones come from the first line that
    bears the sign and an amount over 100 and under 500,000."""
    t = F.col(text)
    staged = df.withColumns({f"_{f}": first_amount([_first(t, p) for p in ps]) for f, ps in SUMS.items()})
    # A run of digits is tried from its start or from behind an amount only, which keeps long runs linear.
    amounts = lambda line: F.regexp_extract_all(line, F.lit(r"(?U)(?:\G|(?<![\d',]))([\d',]++\.\d{2})"), F.lit(1))
    lines = F.transform(
        F.filter(F.split(t, "\n"), lambda line: line.rlike(r"(?i)NET|TOTAL|GRAND|STAMP|VAT")),
        lambda line: F.struct(
            F.upper(line).alias("line"),
            F.filter(F.transform(amounts(line), older_amount), lambda v: F.coalesce((v > 100) & (v < 500000), F.lit(False))).alias("sums"),
        ),
    )
    short = F.col("_net_premium").isNull() | F.col("_total_premium").isNull()
    staged = staged.withColumn("_lines", F.when(short, F.filter(lines, lambda x: F.size(x["sums"]) > 0)))

    def stand_in(signs: list[str], last: bool) -> Column:
        there = F.filter("_lines", lambda x: x["line"].rlike("|".join(signs)))
        return F.try_element_at(F.get(there, F.lit(0))["sums"], F.lit(-1 if last else 1))

    sums = {f: F.coalesce(f"_{f}", stand_in(*SUM_LINES[f])) for f in SUMS}
    return staged.withColumns(sums).drop("_lines", *[f"_{f}" for f in SUMS])


def older_broker(text: Column) -> Column:
    name = F.trim(F.get(F.split(_first(text, BROKER), r"(?U)\s{2,}|\n"), F.lit(0)))
    return F.when((F.length(name) > 0) & ~name.rlike(NOT_A_BROKER), name)


def read_older_fields(docs: DataFrame, text: str = "text", filename: str | None = None) -> DataFrame:
    """Adds ``FIELDS``, read from whole texts of the older kind. What a file name says of name, address and plate goes first;
    its end date stands in when the text holds fewer than two dates.

    Nothing found, a null or an empty text: null. Rows are kept as they are, repeated ones too. Columns that bear the name of a
    field raise an error here; ``older_fields`` gives a struct for those.
    """
    clash = {c.lower() for c in docs.columns} & set(FIELDS)
    if clash:
        raise ValueError(f"columns already there: {sorted(clash)}")
    return older_fields(docs, "_older_fields", text, filename).select(*docs.columns, "_older_fields.*")


def older_fields(docs: DataFrame, into: str, text: str = "text", filename: str | None = None) -> DataFrame:
    """``docs`` with ``FIELDS`` as one struct column ``into``; other columns may have any names."""
    name = F.col(filename) if filename else F.lit(None).cast("string")
    staged = docs.select(F.struct("*").alias("_row"), F.col(text).cast("string").alias("_t"), parse_loose_name(name).alias("_file"))
    staged = staged.select("*", F.upper("_t").alias("_upper"), dates_in_text("_t").alias("_dates"))
    staged = with_older_sums(staged.withColumn("car_make", older_make(F.col("_upper"))), "_t")
    t, from_name = F.col("_t"), F.col("_file")
    read = {
        "policy_number": older_number(t),
        "company_code": F.nullif(insurer_by_pattern(t), F.lit("")),
        "insured_name": F.coalesce(from_name["insured_name"], older_name(t)),
        "insured_address": F.coalesce(from_name["insured_address"], older_address(t)),
        "license_plate": F.coalesce(from_name["license_plate"], older_plate(t)),
        "chassis_no": older_chassis(t),
        "car_model": older_model(F.col("_upper"), F.col("car_make")),
        "car_year": older_year(t),
        "coverage_start": F.get("_dates", F.lit(0)),
        "coverage_end": F.coalesce(F.get("_dates", F.lit(1)), from_name["coverage_end"]),
        "broker_name": older_broker(t),
        "broker_license": F.nullif(_first(t, LICENSE), F.lit("")),
    }
    fields = staged.select("_row", F.struct(*[read[f].alias(f) if f in read else F.col(f) for f in FIELDS]).alias("_fields"))
    return fields.select("_row.*", F.col("_fields").alias(into))
