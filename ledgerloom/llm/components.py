"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.shared import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def star_roots(edges: DataFrame) -> DataFrame:
    """(u, v) with v the least node of u's component, for every node u but the least ones; ``edges`` has longs u, v.

    Each round writes its edges to the shared folder. Nodes without an edge are not returned; no edges, no rows.
    """
    state = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
    current = materialize(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    before = current.select(state.alias("s")).head().s
    while before.n:
        current = materialize(_small_star(_large_star(current)), "edges")
        after = current.select(state.alias("s")).head().s
        if after == before:
            break
        before = after
    return current
