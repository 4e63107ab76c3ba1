"""Numbers from text, and the check digit rule."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F

from ledgerloom.functions.text import blank_to_null, western_digits

# ISO 3779 weights by position and letter values.
VIN_WEIGHTS = [8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2]
VIN_LETTERS = "ABCDEFGHJKLMNPRSTUVWXYZ"
VIN_VALUES = "12345678123457923456789"
VIN_SHAPE = "^[A-HJ-NPR-Z0-9]{17}$"


def number_text(value) -> Column:
    """Thai digits to western, commas out, blank and the words None / null to null."""
    text = F.trim(F.replace(western_digits(value), F.lit(","), F.lit("")))
    return F.when(~text.isin("", "None", "null"), text)


def to_double(value) -> Column:
    return number_text(value).try_cast("double")


def to_decimal(value, kind: str = "decimal(18,2)") -> Column:
    return number_text(value).try_cast(kind)


def to_int_via_double(value) -> Column:
    """"12.7" gives 12; a plain cast of that text gives null."""
    return number_text(value).try_cast("double").try_cast("int")


def legacy_int(value, via_double: bool = True) -> Column:
    text = blank_to_null(value)
    number = text.try_cast("double").try_cast("int") if via_double else text.try_cast("int")
    return F.when(number > 0, number)


def legacy_double(value, zero_is_null: bool = False) -> Column:
    number = F.trim(F.replace(blank_to_null(value), F.lit(","), F.lit(""))).try_cast("double")
    return F.nullif(number, F.lit(0.0)) if zero_is_null else number


def first_nonzero(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(v, F.lit(0).cast("double")) for v in values])


def vin_check_digit_ok(value) -> Column:
    vin = F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(""))
    digits = F.translate(vin, VIN_LETTERS, VIN_VALUES)
    terms = [F.coalesce(F.substring(digits, at, 1).try_cast("int") * weight, F.lit(0)) for at, weight in enumerate(VIN_WEIGHTS, 1)]
    expected = F.substring(F.lit("0123456789X"), reduce(add, terms) % 11 + 1, F.lit(1))
    return vin.rlike(VIN_SHAPE) & (F.substring(vin, 9, 1) == expected)


def plausible_policy_number(value) -> Column:
    """Null for 14 or more bare digits (a bar code) and for over 30 characters."""
    text = blank_to_null(value)
    bare = F.replace(text, F.lit(" "), F.lit(""))
    return F.when(~(bare.rlike(r"^\d{14,}$") | (F.length(text) > 30)), text)
