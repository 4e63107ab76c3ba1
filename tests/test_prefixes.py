"""Prefix pairs by a walk over sorted ranges, against a double loop."""

import random

import pytest

from ledgerloom.operators import linkage as L


def frames(spark, shorts, longs, parts=5):
    one = lambda values, name: spark.createDataFrame([(v,) for v in values], f"{name} string").repartition(parts)
    return one(shorts, "short"), one(longs, "long")


@pytest.mark.parametrize("seed", [1, 2])
def test_prefix_pairs_equal_a_double_loop(spark, seed):
    rng = random.Random(seed)
    texts = {"".join(rng.choice("abก") for _ in range(rng.randint(0, 6))) for _ in range(300)} | {"\U0001f600a", "￿a"}
    shorts, longs = set(rng.sample(sorted(texts), 120)), set(rng.sample(sorted(texts), 120))
    got = sorted(tuple(r) for r in L.prefix_pairs(*frames(spark, [*shorts, None], [*longs, None])).collect())
    assert got == sorted((s, t) for s in shorts for t in longs if t.startswith(s))


def test_prefixes_carry_over_many_ranges(spark):
    """One prefix of everything, and keys of 2,000 characters that are prefixes of each other."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        long_key = "x" * 2000
        longs = [long_key + str(i) for i in range(400)]
        shorts = ["x", "xx", long_key, long_key + "1", "y"]
        got = L.prefix_pairs(*frames(spark, shorts, longs))
        assert got.count() == sum(t.startswith(s) for s in shorts for t in longs)
        assert sorted(tuple(r) for r in got.collect()) == sorted((s, t) for s in shorts for t in longs if t.startswith(s))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)


def test_no_rows(spark):
    assert L.prefix_pairs(*frames(spark, [], ["a"])).collect() == [] and L.prefix_pairs(*frames(spark, ["a"], [])).collect() == []
