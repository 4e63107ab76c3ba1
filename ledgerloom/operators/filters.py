"""Projections, filters, ordering and paging."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.text import escape_like, plate_key
from ledgerloom.schemas import CATEGORY_TYPES, SORTABLE

_OPS = {
    "eq": lambda c, v: c == v,
    "neq": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "like": lambda c, v: c.like(v),
    "ilike": lambda c, v: c.ilike(v),
    "is": lambda c, v: c.isNull() if v in (None, "null") else c == v,
    "in": lambda c, v: c.isin(list(v)),
}


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    """The listed columns that the table has, in list order."""
    return df.select(*[c for c in columns if c in df.columns])


def term(column: str, op: str, value, negate: bool = False) -> Column:
    if op not in _OPS:
        raise ValueError(f"unknown comparison {op!r}")
    condition = _OPS[op](F.col(column), value)
    return ~condition if negate else condition


def where_all(df: DataFrame, *terms: tuple) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, [term(*t) for t in terms]))


def where_any(df: DataFrame, *terms: tuple) -> DataFrame:
    return df.filter(reduce(lambda a, b: a | b, [term(*t) for t in terms]))


def containing(column: str, text: str) -> Column:
    """Case-insensitive containment of user text, with % and _ taken literally."""
    return F.col(column).ilike("%" + escape_like(text) + "%")


def member_of(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows whose key stands in a list too long for IN. Spark picks the join; nothing is broadcast by hand."""
    return df.join(keys.select(F.col(keys.columns[0]).alias(column)).distinct(), column, "left_semi")


def search(df: DataFrame, text: str) -> DataFrame:
    """Plate without blanks and hyphens on both sides, or insured name, or policy number."""
    bare = "".join(text.split()).replace("-", "").lower()
    return df.filter(
        plate_key("license_plate", drop_hyphen=True).contains(bare)
        | containing("insured_name", text.strip())
        | containing("policy_number", text.strip())
    )


def coverage_status(df: DataFrame, status: str, today: date, days: int = 30) -> DataFrame:
    """active: end after today; expiring: end from today to today + days; expired: end before today."""
    end = F.col("coverage_end")
    conditions = {
        "active": end > F.lit(today),
        "expiring": end.between(F.lit(today), F.lit(today + timedelta(days=days))),
        "expired": end < F.lit(today),
    }
    return df.filter(conditions[status])


def end_window(df: DataFrame, start: date | None, end: date | None) -> DataFrame:
    if start is not None:
        df = df.filter(F.col("coverage_end") >= F.lit(start))
    return df if end is None else df.filter(F.col("coverage_end") <= F.lit(end))


def has_document(df: DataFrame, wanted: bool) -> DataFrame:
    c = F.col("pdf_filename")
    return df.filter(c.isNotNull() if wanted else c.isNull())


def in_category(df: DataFrame, category: str) -> DataFrame:
    """Types of the category; an unknown category filters nothing."""
    types = CATEGORY_TYPES.get(category.strip().lower())
    return df if types is None else df.filter(F.col("policy_type").isin(types))


def starts_between(df: DataFrame, column: str, first: date, before: date, *order: str) -> DataFrame:
    """Half-open date range of rows with a policy number, in extract order."""
    return df.filter(
        F.col("policy_number").isNotNull() & (F.col(column) >= F.lit(first)) & (F.col(column) < F.lit(before))
    ).orderBy(column, *order)


def unprocessed(
    df: DataFrame, done: DataFrame, key: str, linked: str | None = None, limit: int | None = None, order: list[str] | None = None
) -> DataFrame:
    """Rows not in the done ledger and, when ``linked`` is given, without a link yet."""
    left = df.join(done.select(key).distinct(), key, "left_anti")
    if linked is not None:
        left = left.filter(F.col(linked).isNull())
    return left if limit is None else left.orderBy(*(order or [key])).limit(limit)


def split_years(df: DataFrame, column: str, low: int = 2000, high: int = 2030) -> tuple[DataFrame, DataFrame]:
    """(rows with a year in range, the rest with null years too)."""
    ok = F.coalesce(F.year(column).between(low, high), F.lit(False))
    return df.filter(ok), df.filter(~ok)


def batch_quota(
    df: DataFrame, batch: str, size: str, max_files: int = 20, max_bytes: int = 12 << 20, max_total: int = 100 << 20
) -> DataFrame:
    """Per batch: files, largest, total and whether it is within quota."""
    return (
        df.groupBy(batch)
        .agg(F.count("*").alias("files"), F.max(size).alias("largest"), F.sum(size).alias("total_bytes"))
        .withColumn(
            "accepted",
            (F.col("files") <= max_files) & (F.col("largest") <= max_bytes) & (F.col("total_bytes") <= max_total),
        )
    )


def whitelist(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """A map column cut to the allowed keys, and the sorted list of keys dropped."""
    names = F.array(*[F.lit(a) for a in allowed])
    return df.withColumn("dropped", F.array_sort(F.array_except(F.map_keys(column), names))).withColumn(
        column, F.map_filter(column, lambda k, v: F.array_contains(names, k))
    )


def ordered(df: DataFrame, column: str = "created_at", descending: bool = True) -> DataFrame:
    """Order by a whitelisted column, newest first by default, id to break ties."""
    column = column if column in SORTABLE else "created_at"
    c = F.col(column)
    return df.orderBy(c.desc_nulls_first() if descending else c.asc_nulls_last(), F.col("id"))


def page(df: DataFrame, number: int, size: int) -> DataFrame:
    """One page of an ordered table."""
    return df.offset((number - 1) * size).limit(size)


def newest_first_nulls_last(df: DataFrame, column: str, *tie: str) -> DataFrame:
    return df.orderBy(F.col(column).desc_nulls_last(), *tie)


def repeatable_sample(df: DataFrame, keys: list[str], size: int, seed: int = 42) -> DataFrame:
    """The ``size`` rows with the smallest keyed hash (SHA-256 of the keys and the seed): the same rows on every run."""
    mixed = F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))), 256)
    return df.orderBy(mixed, *keys).limit(size)
