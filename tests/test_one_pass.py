"""Links are made once: what follows them neither joins them with themselves nor looks them up twice."""

import re

from pyspark.sql import functions as F

from ledgerloom.operators import linkage as L


def joins(df):
    return len(re.findall(r"\bJoin\b", df._jdf.queryExecution().optimizedPlan().toString()))


def test_actions_read_the_links_once(spark):
    links = spark.createDataFrame([("a", "prb", 1, 1), ("a", "prb", 2, 2), ("b", "prb", 3, 1), ("c", "main", 3, 1), ("d", "other", 2, 2)], "path string, doc_kind string, policy_id int, place int")
    policies = spark.createDataFrame([(1, "M"), (2, "P"), (3, "FIRE")], "id int, policy_type string")
    out = L.link_actions(links, policies)
    assert joins(out) == 1
    assert {tuple(r) for r in out.collect()} == {("a", 1, "attach", "prb"), ("a", 2, "link", "prb"), ("b", 3, "attach", "prb"), ("c", 3, "link", "main")}


def test_linked_already_looks_a_link_up_once(spark):
    links = spark.createDataFrame([("a", "x", "main", 1), ("a", "x", "main", 2), ("b", "y", "prb", 1), ("c", "", "main", 2), ("d", None, "prb", 1), ("e", "x", "main", 1)], "path string, name string, doc_kind string, policy_id int")
    policies = spark.createDataFrame([(1, "u"), (2, None)], "id int, pdf_url string")
    named = spark.createDataFrame([(1, "y"), (1, "y"), (2, ""), (1, None)], "policy_id int, pdf_filename string")
    out = L.already_linked(links, policies, named)
    assert joins(out) == 1
    assert {r.path: r.linked for r in out.collect()} == {"a": False, "b": True, "c": False, "d": False, "e": True}


def test_texts_are_cut_to_the_lengths_of_keys_only(spark):
    keys = spark.createDataFrame([("abcdefgh",), ("xyzxyzxyz",)], "key string")
    texts = spark.range(50).select(F.concat(F.lit("..abcdefgh"), F.col("id").cast("string")).alias("text"))
    out = L.contained_pairs(keys, texts)
    assert out.count() == 50
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 3  # no pieces of 1 to 7 characters
