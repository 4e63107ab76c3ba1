"""Nodes of the prefix trie, against a dictionary of whole rebuilt conversations."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import conversation_trie as T, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).digest()
            turns[conv].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in turns.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        path = tuple(own.get(base, [])[:h] + ts[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out, leaves, saved = [], {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = sum(saved[k] for k in children[node]) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        ids = ",".join(map(str, sorted(ends[node])))
        out.append((
            min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(children[node]), leaves[node], saved[node],
            hashlib.sha256(ids.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def rows_of(df):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def many(rng, convs, texts):
    rows = []
    for c in convs:
        for t in range(rng.randint(1, 9)):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", None, "assistant"]), rng.choice(texts)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_nodes_equal_a_dictionary_of_rebuilt_conversations(spark, seed):
    rng = random.Random(seed)
    convs = rng.sample(range(-250, 700), 150) + [0, 100, 300]
    rows = many(rng, convs, ["a", "b", None, "", "naïve \U0001f600"]) + [(None, 1, "user", "x"), (100, 1, "user", "a"), (100, 1, "user", "a")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"f1": F.lit(1), "depth": F.lit("x"), "conv": F.lit(2)}).repartition(5)
    assert rows_of(T.prefix_trie(df)) == brute(rows)


def test_one_conversation_and_one_turn_hold_most_rows(spark):
    rng = random.Random(9)
    long = [(207, t, "user", rng.choice("ab")) for t in range(3000)] + [(208, t, r, x) for (_, t, r, x) in []]
    same = [(c, t, "user", "same") for c in range(1000, 1400) for t in range(4)]
    again = [(55, None, "user", "again")] * 2000
    rows = long + [(231, t, r, x) for _, t, r, x in long[:2500]] + same + again
    assert rows_of(T.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(7))) == brute(rows)


def test_long_texts_turnless_conversations_and_no_rows(spark):
    short = [c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 >= 2][:3]  # one turn, heads of two and more, no base
    rows = [(c, 0, "user", "only") for c in short] + [(400, 0, "user", "x" * 300_000), (401, 0, "user", "x" * 300_000)]
    assert rows_of(T.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert rows_of(T.prefix_trie(spark.createDataFrame([], SCHEMA))) == []
    assert rows_of(T.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA))) == []


def test_products_compose():
    base, power = T.base_of(0), T.Powers(T.base_of(0))
    digests = [hashlib.sha256(b"%d" % k).digest() for k in range(40)]
    products = [0]
    for d in digests:
        products.append((products[-1] * base + T.element(d)) % T.PRIME)
    for i in range(41):
        stretch = 0
        for d in digests[i:]:
            stretch = (stretch * base + T.element(d)) % T.PRIME
        assert (products[i] * power[40 - i] + stretch) % T.PRIME == products[40]
    assert power[20_000] == pow(base, 20_000, T.PRIME)


def test_prefixes_that_clash_are_told_apart_by_another_base(spark, monkeypatch):
    rng = random.Random(2)
    rows = many(rng, range(0, 130), ["a", "b"])
    real = T.base_of
    monkeypatch.setattr(T, "base_of", lambda seed: 1 if seed == 0 else real(seed))  # sums: any order of turns clashes
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(T.prefix_trie(df)) == brute(rows)
    with pytest.raises(RuntimeError):
        T.prefix_trie(df, range(1))


def test_pieces_of_many_ids_keep_their_order(spark, monkeypatch):
    monkeypatch.setattr(T, "JOINED", 8)
    rows = [(c, t, "user", "s") for c in range(300) for t in range(7)]
    assert rows_of(T.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_query_equals_a_dictionary(spark):
    sf = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"select conv_id, turn, role, text from '{sf}/conversations.parquet'").fetchall()
    assert rows_of(queries.QUERIES["op13_conversation_trie"](spark, sf)) == brute(rows)
