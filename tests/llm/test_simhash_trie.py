import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import simhash_trie as T


def plain_fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    size = min(size, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(items, linked):
    """items: (key, id); the least id reachable, by a plain search."""
    keys = sorted({k for k, _ in items})
    seen, name = set(), {}
    for k in keys:
        if k in seen:
            continue
        group, todo = {k}, [k]
        while todo:
            x = todo.pop()
            for y in keys:
                if y not in group and linked(x, y):
                    group.add(y)
                    todo.append(y)
        seen |= group
        ids = [i for q, i in items if q in group and i is not None]
        name.update(dict.fromkeys(group, min(ids) if ids else None))
    return name


def test_fingerprint_is_the_plain_one():
    rng = random.Random(1)
    texts = ["", " \t\n", "A", "a b", "A b\x0bC", "é É a", "x " * 700, " ".join(rng.choice("abcdefg") for _ in range(400)), "a b c d e"]
    for t in texts:
        assert T.text_fingerprint(t.encode()) == plain_fingerprint(t)


def test_descend_finds_every_near_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    near = [w ^ np.uint64(1 << int(rng.integers(64))) ^ np.uint64(1 << int(rng.integers(64))) for w in base for _ in range(4)]
    a = np.sort(np.concatenate((base, np.array(near, np.uint64), base[:5])))
    want = {(i, j) for i in range(len(a)) for j in range(i + 1, len(a)) if int(a[i] ^ a[j]).bit_count() <= 2}
    got = [(int(i), int(j)) for x, y in T.descend(a, a, 0, 0, 2, True) for i, j in zip(x, y)]
    assert len(got) == len(set(got)) and set(got) == want
    b = np.sort(np.array(near[:100], np.uint64))
    want = {(i, j) for i in range(len(a)) for j in range(len(b)) if int(a[i] ^ b[j]).bit_count() <= 2}
    assert {(int(i), int(j)) for x, y in T.descend(a, b, 0, 0, 2, False) for i, j in zip(x, y)} == want


def test_components_match_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(24):
        words = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 40, 900]))]
        for _ in range(3):
            texts.append(" ".join(words))
            words = list(words)
            words[rng.randrange(len(words))] = rng.choice(vocab)
    texts += [None, "", "  ", texts[0].upper()]
    items = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[7]), (None, "only one of it")]
    df = spark.createDataFrame([(t, "x", i, "y") for i, t in items], "text string, word string, doc_id long, id string")
    prints = [(plain_fingerprint(t), i) for i, t in items]
    name = components(prints, lambda x, y: (x ^ y).bit_count() <= 2)
    want = sorted(((-1 if i is None else i), f, -1 if name[f] is None else name[f]) for f, i in prints)
    for leaf in (12, 1 << 15):
        rows = T.simhash_components(df, leaf=leaf).collect()
        assert sorted(((-1 if r.id is None else r.id), r.word % 2**64, -1 if r.component_id is None else r.component_id) for r in rows) == want
    assert T.simhash_components(df.limit(0)).collect() == []


def test_equal_words_over_the_leaf_size_are_compared_in_blocks(spark):
    rows = [(0, 7, i, bytes([i % 3])) for i in range(40)]
    words = spark.createDataFrame(rows, "tree int, word long, id long, sig binary").withColumn("sig", F.expr("unhex(repeat(hex(sig), 8))"))
    links = T.hamming_links(words, 2, 8, 0).collect()
    root = list(range(40))
    for r in links:
        a, b = root[r.u], root[r.v]
        root = [min(a, b) if x in (a, b) else x for x in root]
    assert root == [i % 3 for i in range(40)]


def test_near_copies(spark):
    rng = random.Random(9)
    vocab = [f"term{i}" for i in range(3000)]
    base = [rng.choice(vocab) for _ in range(400)]
    edited = list(base)
    for at in (17, 203):
        edited[at] = "changed"
    other = [rng.choice(vocab) for _ in range(400)]
    rows = [(5, " ".join(base)), (9, " ".join(edited)), (2, " ".join(other)), (11, " ".join(base)), (12, " ".join(base).upper() + "!"), (20, None), (21, ""), (None, " ".join(base))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.id, r.keep) for r in T.near_copies(df).collect()} == {(9, 5), (11, 5), (12, 5), (21, 20)}
    assert T.near_copies(df.limit(0)).collect() == []


def altered(rng, n, kind, least):
    """Shingle hashes of a text of n new words and of a copy whose similarity is just over ``least``."""
    from ledgerloom.llm.shared import shingle_hashes

    fresh = lambda k: rng.integers(0, 2**64, k, dtype=np.uint64)
    sets = lambda words: set(shingle_hashes(words, T.NEAR_SHINGLE).tolist())
    base, k, best = fresh(n), 1, None
    while True:
        if kind == "appended":
            copy = np.concatenate((base, fresh(k)))
        elif kind == "truncated":
            copy = base[: n - k]
        elif kind == "block":
            copy = np.concatenate((base[: n // 3], fresh(k), base[n // 3 + k :]))
        else:
            copy = base.copy()
            copy[np.linspace(0, n - 1, k, dtype=int)] = fresh(k)
        a, b = sets(base), sets(copy)
        if len(a & b) / len(a | b) < least:
            return best
        best = np.array(sorted(a), np.uint64), np.array(sorted(b), np.uint64)
        k += 1


def test_candidates_of_appended_truncated_and_block_edited_copies():
    rng = np.random.default_rng(12)
    worst = 1.0
    for kind in ("appended", "truncated", "block", "scattered"):
        for least in (0.80, 0.85, 0.90, 0.95):
            pairs = [altered(rng, 300, kind, least) for _ in range(25)]
            met = sum(bool((T.near_bands(a) == T.near_bands(b)).any()) for a, b in pairs)
            worst = min(worst, met / len(pairs))
    assert worst >= 0.99


def test_links_are_those_of_the_exact_similarity(spark):
    rng = random.Random(4)
    vocab = [f"term{i}" for i in range(5000)]
    fresh = lambda n: [rng.choice(vocab) for _ in range(n)]
    texts = []
    for _ in range(12):
        base = fresh(rng.choice([9, 30, 104, 300]))
        n = len(base)
        texts += [base, base + fresh(n // 5), base + fresh(n // 4), base[: n - n // 6], base[: n // 2] + fresh(n // 10) + base[n // 2 + n // 10 :]]
        for edits in (1, 2, 3, 5):
            copy = list(base)
            for at in rng.sample(range(n), min(edits * n // 100 + edits, n)):
                copy[at] = rng.choice(vocab)
            texts.append(copy)
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for w in texts]
    near = lambda x, y: 10 * len(x & y) >= 8 * len(x | y)
    name = components([(k, k) for k in range(len(sets))], lambda x, y: near(sets[x], sets[y]))
    want = {(k, v) for k, v in name.items() if k != v}
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    assert {(r.id, r.keep) for r in T.near_copies(df).collect()} == want
    pairs = [(k, np.array(sorted({hash(x) for x in s}), np.int64).tobytes()) for k, s in enumerate(sets)]
    runs = spark.createDataFrame([(k, 0, r) for k, r in pairs], "id long, comp long, runs binary")
    assert {(r.u, r.v) for r in T.star_roots(T.verified_links(runs, 1500)).collect()} == want
