"""Writing exports, backups, snapshots and reports. A path that is being read is never written."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def clean_export(df: DataFrame, *order: str) -> DataFrame:
    """All columns as text in order, line breaks turned to blanks."""
    return df.select(*[F.regexp_replace(F.col(c).cast("string"), r"[\r\n]", " ").alias(c) for c in df.columns]).orderBy(*order)


def write_export(df: DataFrame, path: str, *order: str) -> None:
    """Full legacy export: quotes doubled by the writer."""
    clean_export(df, *order).write.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def backup_lines(tables: dict[str, DataFrame]) -> DataFrame:
    """One JSON line per row of every table, with its table name."""
    sides = [df.select(F.lit(n).alias("_table"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")) for n, df in tables.items()]
    return reduce(DataFrame.unionByName, sides)


def write_backup(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Compressed JSON lines partitioned by table, with a line about the backup as table ``_meta``; returns the counts of
    the tables read back from what was written."""
    spark = next(iter(tables.values())).sparkSession
    about = F.struct(F.lit(True).alias("_meta"), F.current_timestamp().alias("backup_at"), F.array(*[F.lit(t) for t in sorted(tables)]).alias("tables"), F.lit(1).alias("format_version"))
    meta = spark.range(1).select(F.lit("_meta").alias("_table"), F.to_json(about).alias("value"))
    backup_lines(tables).unionByName(meta).write.partitionBy("_table").option("compression", "gzip").text(path)
    return spark.read.text(path).filter("_table <> '_meta'").groupBy("_table").agg(F.count("*").alias("rows"))


def one_per_id(df: DataFrame, *position: str) -> DataFrame:
    """One row per id: the first by ``position``, or by all columns as JSON where none is given. Rows without id all stay."""
    order = F.struct(*position, F.to_json(F.struct("*"))) if position else F.to_json(F.struct("*"))
    kept = df.filter("id is not null").groupBy("id").agg(F.min_by(F.struct("*"), order).alias("_row")).select("_row.*")
    return kept.unionByName(df.filter("id is null"))


def surplus_rows(df: DataFrame) -> DataFrame:
    """(id, dropped): how many rows of an id ``one_per_id`` leaves out, for ids that have several."""
    return df.filter("id is not null").groupBy("id").agg((F.count("*") - 1).alias("dropped")).filter("dropped > 0")


def restored(current: DataFrame, rows: DataFrame, append: bool, *position: str) -> DataFrame:
    """The table after a restore: the backup alone, or the table plus the backup rows whose id it lacks (the first of an
    id by ``position``; ``surplus_rows`` tells what that leaves out)."""
    if not append:
        return rows
    fresh = one_per_id(rows, *position).join(current.select("id"), "id", "left_anti")
    return current.unionByName(fresh, allowMissingColumns=True)


def write_snapshot(df: DataFrame, root: str, version: str, *position: str) -> str:
    """A new snapshot folder; one row per id, the first by ``position``. The caller switches its pointer to the returned
    path."""
    path = f"{root.rstrip('/')}/{version}"
    one_per_id(df, *position).write.mode("errorifexists").parquet(path)
    return path


def append_valid(df: DataFrame, valid, path: str, reject_path: str) -> None:
    """Good rows appended in one write, the rest to a reject table."""
    ok = F.coalesce(valid, F.lit(False))
    df.filter(ok).write.mode("append").parquet(path)
    df.filter(~ok).write.mode("append").parquet(reject_path)


def write_json_report(totals: DataFrame, path: str) -> None:
    """Totals are one small aggregate; the key lists of a report go through ``write_key_list``."""
    totals.write.json(path)


def write_key_list(keys: DataFrame, path: str) -> None:
    """Sorted keys as JSON lines, range-partitioned so that no task holds them all."""
    keys.orderBy(*keys.columns).write.json(path)


def write_csv_report(df: DataFrame, path: str, *order: str) -> None:
    (df.orderBy(*order) if order else df).write.option("header", True).csv(path)
