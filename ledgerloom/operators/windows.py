"""Order-dependent operators. Order is always an explicit column; hot keys are ranked in two steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerloom.session import cut_lineage


def number_in_partitions(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """1-based global positions over a range-partitioned frame with a ``_part`` column.

    The frame must be written out: sizes and ranks read it separately and have to see the same partitions. Each partition ranks its own rows; the small table of partition sizes gives every partition its offset.
    """
    sizes = df.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = sizes.withColumn(
        "_offset", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ).drop("_n")
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
    return ranked.join(offsets, "_part").withColumn(name, F.col("_rank") + F.col("_offset")).drop("_part", "_rank", "_offset")


def global_positions(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """1-based positions in ``order`` (a unique key) with no single-task sort."""
    ranged = cut_lineage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    return number_in_partitions(ranged, order, name)


def keyed_positions(df: DataFrame, keys: list[str], order: list[str], name: str = "position") -> DataFrame:
    """1-based positions per key. Rows are range-partitioned by (key, order), so one key may span many tasks."""
    ranged = cut_lineage(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    ranked = ranged.withColumn("_rank", F.row_number().over(W.partitionBy(*keys, "_part").orderBy(*order)))
    joined = ranked.join(offsets, [*keys, "_part"])
    return joined.withColumn(name, (F.col("_rank") + F.col("_offset")).cast("long")).drop("_part", "_rank", "_offset")


def keyed_running(df: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[str, str]], before: bool = False) -> DataFrame:
    """Running values per key: ``values`` maps a new column to (sum, max or last; column), over the rows up to this one, or
    with ``before`` up to the one before. ``last`` is the last value that is not null; a sum of no rows is 0.

    A segmented scan: rows are range-partitioned by (key, order), each partition runs over its own rows, and the totals of a
    key's earlier partitions are carried in, so one key may span many tasks.
    """
    ranged = cut_lineage(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    at = F.struct(*order)
    total = {
        "sum": lambda c: F.sum(c),
        "max": lambda c: F.max(c),
        "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at)),
    }
    over = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carried = ranged.groupBy(*keys, "_part").agg(*[total[kind](c).alias(f"_t_{name}") for name, (kind, c) in values.items()])
    carried = carried.select(*keys, "_part", *[over[kind](f"_t_{name}").over(earlier).alias(f"_c_{name}") for name, (kind, _) in values.items()])
    here = W.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1 if before else 0)
    rows = ranged.withColumns({f"_l_{name}": over[kind](c).over(here) for name, (kind, c) in values.items()}).join(carried, [*keys, "_part"])
    merged = {
        "sum": lambda own, carry: F.coalesce(own, F.lit(0)) + F.coalesce(carry, F.lit(0)),
        "max": lambda own, carry: F.greatest(own, carry),
        "last": lambda own, carry: F.coalesce(own, carry),
    }
    rows = rows.withColumns({name: merged[kind](F.col(f"_l_{name}"), F.col(f"_c_{name}")) for name, (kind, _) in values.items()})
    return rows.drop("_part", *[f"_{x}_{name}" for x in "lc" for name in values])


def first_seen(df: DataFrame, keys: list[str], position: str, value: str, name: str) -> DataFrame:
    """Adds the ``value`` of the first row of each key by ``position``; null on that row and where a key part is null.

    The first row per key is a partial aggregate, so a hot key costs one partial row per task; the lookup back is a
    join that adaptive execution splits when a key is skewed.
    """
    filled = None
    for k in keys:
        filled = F.col(k).isNotNull() if filled is None else filled & F.col(k).isNotNull()
    heads = df.filter(filled).groupBy(*keys).agg(F.min_by(value, position).alias("_head"), F.min(position).alias("_first"))
    joined = df.join(heads, keys, "left")
    return joined.withColumn(name, F.when(F.col(position) > F.col("_first"), F.col("_head"))).drop("_head", "_first")


def mark_duplicates(df: DataFrame, number: str, doc_class: str, total: str, position: str, file_id: str) -> DataFrame:
    """Same policy number, class and total: the first stays, later ones point at it. A blank number never repeats."""
    keyed = df.withColumns(
        {
            "_number": F.nullif(F.trim(F.coalesce(F.col(number), F.lit(""))), F.lit("")),
            "_class": F.coalesce(F.col(doc_class), F.lit("")),
            "_total": F.coalesce(F.col(total).cast("string"), F.lit("")),
        }
    )
    return first_seen(keyed, ["_number", "_class", "_total"], position, file_id, "duplicate_of").drop("_number", "_class", "_total")


def best_other(df: DataFrame, group: str, score: str, name: str) -> DataFrame:
    """For each row the best score among the other rows of its group: the top score, or the runner-up for the top row.

    Top and runner-up come from one aggregate (max, its count, and the max below it).
    """
    top = df.groupBy(group).agg(F.max(score).alias("_top"))
    sizes = df.join(top, group).groupBy(group).agg(
        F.max("_top").alias("_top"),
        F.count_if(F.col(score) == F.col("_top")).alias("_ties"),
        F.max(F.when(F.col(score) < F.col("_top"), F.col(score))).alias("_second"),
    )
    joined = df.join(sizes, group)
    other = F.when((F.col(score) == F.col("_top")) & (F.col("_ties") == 1), F.col("_second")).otherwise(F.col("_top"))
    return joined.withColumn(name, other).drop("_top", "_ties", "_second")


def collision_names(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Repeats of a name get _0001, _0002, ... before the extension, in order."""
    placed = keyed_positions(df, [name], order, "_place")
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    repeat = F.concat(stem, F.lit("_"), F.lpad((F.col("_place") - 1).cast("string"), 4, "0"), ext)
    return placed.withColumn("final_name", F.when(F.col("_place") == 1, F.col(name)).otherwise(repeat)).drop("_place")


def position_ids(df: DataFrame, batch: str, order: list[str], chunk: int = 10) -> DataFrame:
    """0-based four-digit position per batch and its 1-based chunk."""
    placed = keyed_positions(df, [batch], order, "_place")
    at = F.col("_place") - 1
    return placed.withColumns(
        {"position_id": F.when(at < 10000, F.lpad(at.cast("string"), 4, "0")).otherwise(at.cast("string")), "chunk": F.floor(at / chunk) + 1}
    ).drop("_place")


def last_per_key(df: DataFrame, keys: list[str], order: Column, columns: list[str]) -> DataFrame:
    """Last write wins, as a partial max aggregate."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("_row")).select(*keys, "_row.*")
