"""Column lists and types of the core tables."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
RATE = T.DecimalType(9, 4)

# Columns of the policy table by type group.
TEXT_COLUMNS = (
    "policy_number company_code app_number policy_type new_renew agent_code insured_name insured_address risk_address "
    "original_filename phone license_plate license_province chassis_no car_make car_model broker_name broker_license "
    "pdf_url pdf_filename notes"
).split()
INT_COLUMNS = ["car_year", "pdf_size"]
MONEY_COLUMNS = (
    "sum_insured net_premium stamp_duty vat total_premium third_party_per_person third_party_per_accident own_damage "
    "prepaid_tax_1pct commission_baht wht_10pct rounding collected_amount"
).split()
RATE_COLUMNS = ["commission_pct"]
DATE_COLUMNS = "coverage_start coverage_end date_notify date_cancel date_policy_receive".split()
WRITABLE_COLUMNS = TEXT_COLUMNS + INT_COLUMNS + MONEY_COLUMNS + RATE_COLUMNS + DATE_COLUMNS + ["manually_edited"]

# Column lists of the list, summary and detail views.
SUMMARY_COLUMNS = (
    "id created_at policy_number policy_type new_renew insured_name phone license_plate chassis_no coverage_start "
    "coverage_end total_premium pdf_url pdf_filename pdf_size"
).split()
LIST_COLUMNS = (
    "id created_at app_number policy_number company_code policy_type new_renew insured_name phone insured_address "
    "license_plate license_province chassis_no car_make car_model car_year sum_insured coverage_start coverage_end "
    "date_notify date_cancel date_policy_receive net_premium stamp_duty vat total_premium third_party_per_person "
    "third_party_per_accident own_damage prepaid_tax_1pct commission_pct commission_baht wht_10pct rounding "
    "collected_amount agent_code broker_name broker_license notes manually_edited pdf_url pdf_filename pdf_size"
).split()
SORTABLE = (
    "policy_number insured_name license_plate coverage_start coverage_end total_premium created_at company_code policy_type"
).split()

# Closed sets.
CATEGORY_TYPES = {
    "motor": ["M"],
    "prb": ["P"],
    "fire": ["FIRE", "ASSET", "IAR", "BURGLAR"],
    "pa": ["PA", "TA", "3RD", "PUBLIC", "MISC", "GOLF", "MARINE"],
}
KEY_KIND_TYPES = {
    "plate": ["M", "P"],
    "address": ["FIRE", "ASSET", "IAR", "BURGLAR", "MISC", "3RD", "PUBLIC"],
    "name": ["PA", "TA", "MARINE", "GOLF"],
}
ATTACHMENT_TYPES = "main prb renewal_notice endorsement credit_note invoice receipt other".split()
DOCUMENT_TYPES = (
    "motor_main motor_prb renewal_notice endorsement credit_note invoice receipt fire sme_property other_policy unknown"
).split()
SUPPORT_TYPES = "motor_prb renewal_notice endorsement credit_note invoice receipt unknown".split()

# Columns of the legacy export.
LEGACY_COLUMNS = [
    "app", "policy", "insurance", "policytype", "newrenew", "namethai", "telephone", "address1", "address2",
    "province", "postcode", "license", "licenseprovince", "chasis", "model", "modelextend", "modelyear", "damage",
    "datestart", "dateend", "datenotify", "datereceive", "datecancel", "datepolicyreceive", "netpremium", "stamp",
    "vat", "totalpremium", "agent", "kpp", "remark1", "remarkyok", "onepercent", "discountper", "comm", "agentcomm",
    "email", "prefix", "keyby", "seat", "cc", "weight", "equipment", "carcodeprb", "appprb", "appnext",
    "dateinsurance", "datecartax", "datesent", "namethai1", "datebirth1", "namethai2", "datebirth2", "theft",
    "deduct",
]


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in columns.items()])


def _of(names: list[str], kind: T.DataType) -> dict[str, T.DataType]:
    return {n: kind for n in names}


POLICIES = _struct(
    id=T.StringType(),
    **_of(TEXT_COLUMNS, T.StringType()),
    **_of(INT_COLUMNS, T.IntegerType()),
    **_of(MONEY_COLUMNS, MONEY),
    **_of(RATE_COLUMNS, RATE),
    **_of(DATE_COLUMNS, T.DateType()),
    manually_edited=T.BooleanType(),
    created_at=T.TimestampType(),
)
ATTACHMENTS = _struct(
    **_of("id policy_id doc_type label note pdf_url pdf_filename".split(), T.StringType()),
    pdf_size=T.IntegerType(),
    **_of("net_premium stamp_duty vat total_premium".split(), MONEY),
    coverage_start=T.DateType(),
    coverage_end=T.DateType(),
    created_at=T.TimestampType(),
)
INBOX = _struct(
    **_of(
        "id document_type status reference_policy_number matched_policy_id insured_name license_plate extracted_data "
        "pdf_url pdf_filename original_filename note".split(),
        T.StringType(),
    ),
    pdf_size=T.IntegerType(),
    coverage_start=T.DateType(),
    coverage_end=T.DateType(),
    created_at=T.TimestampType(),
)
BATCH_DOCUMENTS = T.StructType(
    _struct(
        **_of("batch_id file_id orig_filename sha256 same_file_as".split(), T.StringType()),
        pos=T.LongType(),
        **_of(
            "doc_type title raw_text policy_type policy_number company_code chassis_no license_plate insured_name "
            "car_make car_model car".split(),
            T.StringType(),
        ),
        coverage_start=T.DateType(),
        coverage_end=T.DateType(),
        total_premium=MONEY,
        requires_review=T.BooleanType(),
        parse_error=T.StringType(),
    ).fields
    + [T.StructField("review_fields", T.ArrayType(T.StringType()), True)]
)
LEGACY = _struct(**_of(LEGACY_COLUMNS, T.StringType()))
FILES = _struct(name=T.StringType(), path=T.StringType(), length=T.LongType(), modified=T.TimestampType())
