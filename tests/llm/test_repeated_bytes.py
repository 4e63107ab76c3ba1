import random

import numpy as np
import pytest

from ledgerloom.llm import repeated_bytes as R


def plain(rows, length, keep_first):
    """rows: (id, text) in order of id; the removed places of each, by a dictionary of all windows."""
    seen = {}
    for at, (_, t) in enumerate(rows):
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            seen.setdefault(b[i : i + length], []).append((at, i))
    out = []
    for at, (_, t) in enumerate(rows):
        b = (t or "").encode()
        gone = set()
        for i in range(len(b) - length + 1):
            places = seen[b[i : i + length]]
            if len(places) > 1 and not (keep_first and places[0] == (at, i)):
                gone.update(range(i, i + length))
        out.append((b, gone))
    return out


def test_window_minima_are_the_leftmost():
    rng = np.random.default_rng(1)
    for n, width in ((5, 5), (40, 7), (41, 1), (100, 33)):
        v = rng.integers(0, 6, n).astype(np.uint64)
        assert R.window_minima(v, width).tolist() == [i + int(v[i : i + width].argmin()) for i in range(n - width + 1)]


def test_previous_factors_match_a_double_loop():
    rng = random.Random(2)
    for _ in range(40):
        t = "".join(rng.choice("ab") for _ in range(rng.randint(1, 60)))
        order = sorted(range(len(t)), key=lambda i: t[i:])
        lcp = lambda i, j: next((k for k in range(len(t)) if i + k >= len(t) or j + k >= len(t) or t[i + k] != t[j + k]), len(t))
        common = np.array([0] + [lcp(a, b) for a, b in zip(order, order[1:])])
        got = R.previous_factors(common, np.array(order), 3)
        want = [max([lcp(i, j) for j in range(i)], default=0) for i in order]
        assert got.tolist() == [w if w >= 3 else 0 for w in want]


@pytest.mark.parametrize("most", [2, 512])
def test_removal_matches_brute_force(spark, most):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, other = text(30), text(40)
    rows = [text(12) + passage + text(12) for _ in range(7)] + [passage, other, other + other, "x" * 200, "ab" * 90, "", None, text(60)]
    rows += [rows[0], other[:70] + text(9) + passage[20:], "y" * 45, "short"]
    rows = list(enumerate(rows)) + [(3, rows[3])]
    rows.sort(key=lambda r: r[0])
    df = spark.createDataFrame([(t, i, "k", "b") for i, t in rows], "text string, doc_id long, key string, body string")
    for keep_first in (False, True):
        got = {}
        for r in R.without_repeats(df, length=50, gram=12, most=most, keep_first=keep_first).collect():
            got.setdefault(r.id, []).append((r.n_bytes, sorted(p for s in r.spans for p in range(s.start, s.end)), bytes(r.kept)))
            assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))
        want = {}
        for (i, _), (b, gone) in zip(rows, plain(rows, 50, keep_first)):
            if keep_first and i == 3:
                continue  # of two equal rows either may be the first
            want.setdefault(i, []).append((len(b), sorted(gone), bytes(c for p, c in enumerate(b) if p not in gone)))
        if keep_first:
            got.pop(3)
        assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, v in want.items()}


def test_empty_table(spark):
    assert R.without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
