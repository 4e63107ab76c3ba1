"""Legacy export rows to policy rows. Four loaders share most rules and differ in the options below."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions import dates as D, numbers as N, text as X
from ledgerloom.schemas import DATE_COLUMNS, INT_COLUMNS, MONEY_COLUMNS, RATE_COLUMNS, TEXT_COLUMNS

# Target column to source column where only the name changes.
TEXT_SOURCES = {
    "app_number": "app",
    "policy_number": "policy",
    "company_code": "insurance",
    "policy_type": "policytype",
    "new_renew": "newrenew",
    "insured_name": "namethai",
    "phone": "telephone",
    "license_plate": "license",
    "license_province": "licenseprovince",
    "chassis_no": "chasis",
    "agent_code": "agent",
}
EXTRA_TEXT_SOURCES = {
    "email": "email",
    "prefix": "prefix",
    "keyby": "keyby",
    "equipment": "equipment",
    "car_code": "carcodeprb",
    "app_prb": "appprb",
    "app_next": "appnext",
    "driver1_name": "namethai1",
    "driver2_name": "namethai2",
}
EXTRA_DATE_SOURCES = {
    "date_insurance": "dateinsurance",
    "date_car_tax": "datecartax",
    "date_sent": "datesent",
    "driver1_birth": "datebirth1",
    "driver2_birth": "datebirth2",
}
EXTRA_INT_SOURCES = {"seat": "seat", "cc": "cc", "weight": "weight"}
MAX_LENGTHS = {
    "app_number": 50, "policy_number": 100, "company_code": 50, "policy_type": 50, "new_renew": 5, "insured_name": 255,
    "phone": 50, "license_plate": 50, "license_province": 100, "chassis_no": 100, "car_model": 100, "agent_code": 50,
    "notes": 1000,
}


def _car_year() -> Column:
    year = N.legacy_int("modelyear")
    return F.when(year >= 2500, year - 543).otherwise(year)


def map_rows(df: DataFrame, loader: str) -> DataFrame:
    """``loader``: csv (zero amounts null), database (zeros kept, extra fields), export (lengths capped, own dates)."""
    text = {t: X.blank_to_null(s) for t, s in TEXT_SOURCES.items()}
    date = D.date_export if loader == "export" else (lambda c: D.date_web_form(c, prefix_ok=True))
    number = lambda c: N.legacy_double(c, zero_is_null=loader == "csv")
    notified, received = ("datereceive", "datepolicyreceive") if loader == "csv" else ("datenotify", "datereceive")
    model = X.blank_to_null("model")
    if loader == "csv":
        model = F.nullif(F.concat_ws(" ", X.blank_to_null("model"), X.blank_to_null("modelextend")), F.lit(""))
    columns: dict[str, Column] = {
        **text,
        "insured_address": X.joined_address("address1", "address2", "province", "postcode"),
        "car_make": F.lit(None).cast("string"),
        "car_model": model,
        "car_year": F.lit(None).cast("int") if loader == "export" else _car_year(),
        "coverage_start": date("datestart"),
        "coverage_end": date("dateend"),
        "date_notify": date(notified),
        "date_policy_receive": date(received),
        "date_cancel": date("datecancel"),
        "net_premium": number("netpremium"),
        "stamp_duty": number("stamp"),
        "vat": number("vat"),
        "total_premium": number("totalpremium"),
        "sum_insured": number("damage"),
        "broker_name": F.coalesce(X.blank_to_null("kpp"), X.blank_to_null("agent")),
        "manually_edited": F.lit(False),
    }
    if loader != "csv":
        columns["notes"] = X.blank_to_null("remark1")
    if loader == "export":
        columns["broker_name"] = F.lit(None).cast("string")
        columns["sum_insured"] = F.coalesce(F.nullif(number("damage"), F.lit(0.0)), number("totalpremium"))
        columns.update({c: F.substring(columns[c], 1, n) for c, n in MAX_LENGTHS.items()})
    if loader == "database":
        columns.update(
            prepaid_tax_1pct=number("onepercent"),
            commission_pct=number("discountper"),
            commission_baht=F.coalesce(F.nullif(number("comm"), F.lit(0.0)), number("agentcomm")),
            theft=number("theft"),
            deductible=number("deduct"),
            **{t: X.blank_to_null(s) for t, s in EXTRA_TEXT_SOURCES.items()},
            **{t: date(s) for t, s in EXTRA_DATE_SOURCES.items()},
            **{t: N.legacy_int(s) for t, s in EXTRA_INT_SOURCES.items()},
        )
    return df.select(*[c.alias(n) for n, c in columns.items()])


def with_policy_number(df: DataFrame) -> DataFrame:
    return df.filter(X.blank_to_null("policy").isNotNull())


def with_any_number(df: DataFrame) -> DataFrame:
    return df.filter(F.coalesce(X.blank_to_null("policy"), X.blank_to_null("app")).isNotNull())


def note_patches(df: DataFrame) -> DataFrame:
    """app_number, notes (both remarks joined by " | ") and phone of rows that have either."""
    notes = F.nullif(F.concat_ws(" | ", X.blank_to_null("remark1"), X.blank_to_null("remarkyok")), F.lit(""))
    out = df.select(X.blank_to_null("app").alias("app_number"), notes.alias("notes"), X.blank_to_null("telephone").alias("phone"))
    return out.filter("app_number is not null and (notes is not null or phone is not null)")


def typed_rows(df: DataFrame, null_words: tuple[str, ...] = ("", "null", "test"), manually_edited: bool = True) -> DataFrame:
    """Text columns coerced by group: int, money, rate, date, text. Never raises; what does not fit is null."""
    have = set(df.columns)

    def text(c: str) -> Column:
        value = F.col(c).cast("string")
        return F.when(~value.isin(*null_words), X.blank_to_null(value))

    columns = {
        **{c: text(c) for c in TEXT_COLUMNS},
        **{c: N.to_int_via_double(c) for c in INT_COLUMNS},
        **{c: N.to_decimal(c) for c in MONEY_COLUMNS},
        **{c: N.to_decimal(c, "decimal(9,4)") for c in RATE_COLUMNS},
        **{c: D.date_web_form(c) for c in DATE_COLUMNS},
    }
    keys = [c for c in df.columns if c not in columns and c.startswith("_")]
    return df.select(*keys, *[e.alias(c) for c, e in columns.items() if c in have], F.lit(manually_edited).alias("manually_edited"))
