"""Candidates of near copies come from the SimHash trie join with bits to spare, not from equal words."""

import numpy as np
from test_simhash_trie import altered

from ledgerloom.llm import simhash_trie as T


def test_the_trie_join_meets_pairs_of_similarity_four_fifths():
    rng = np.random.default_rng(5)
    for kind in ("appended", "truncated", "block", "scattered"):
        for n in (60, 300):
            pairs = [altered(rng, n, kind, 0.8) for _ in range(60)]
            met = far = 0
            for a, b in pairs:
                x, y = T.near_signature(a), T.near_signature(b)
                apart = T.near_prints(x) ^ T.near_prints(y)
                met += bool(((apart >> np.uint64(T.NEAR_REST) == 0) & (np.bitwise_count(apart) <= T.NEAR_BUDGET)).any())
                far += int(np.bitwise_count(x[: T.FAR_WORDS] ^ y[: T.FAR_WORDS]).sum()) > T.NEAR_FAR
            assert met >= 59 and far == 0, (kind, n, met, far)


def test_a_pair_that_no_tree_holds_equal_is_still_found(spark):
    rng = np.random.default_rng(8)
    while True:  # similar texts without an equal word in any tree: only the budget of the descent joins them
        words = [f"w{k}" for k in rng.integers(0, 100_000, 60)]
        copy = words[:30] + [f"x{k}" for k in range(2)] + words[32:]
        runs = [np.unique(T.shingle_hashes(T.WordHashes().of(t), T.NEAR_SHINGLE)) for t in (words, copy)]
        x, y = (T.near_prints(T.near_signature(r)) for r in runs)
        if not (x == y).any():
            break
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(copy)), (3, "other words altogether here and now")], "doc_id long, text string")
    assert [(r.id, r.keep) for r in T.near_copies(docs).collect()] == [(2, 1)]
