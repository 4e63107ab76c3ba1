import random
import re

from ledgerloom.llm import containment as C


def grams(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def test_matches_brute_force(spark):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(500)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([6, 7, 9, 12, 20, 30, 33, 60, 130, 400] * 4)]
    items += [(100, "Two words"), (101, ""), (102, None), (103, items[3][1]), (None, text(20)), (4, text(25)), (5, items[5][1])]
    docs = []
    for i, (_, t) in enumerate(items):
        w = (t or "").split()
        for share in (1.0, 0.9, 0.82, 0.7):
            kept = list(w)
            for at in rng.sample(range(len(w)), round(len(w) * (1 - share) / 5)) if w else []:
                kept[at] = "other"
            docs.append((len(docs), text(rng.choice([0, 40, 3000])) + " " + " ".join(kept).upper() + ", " + text(rng.choice([0, 700]))))
    docs += [(900, None), (901, ""), (902, "two WORDS!"), (903, "two words more"), (None, items[9][1]), (0, docs[0][1])]
    d = spark.createDataFrame([(t, i, "a", 1.0) for i, t in docs], "text string, doc_id long, item_id string, containment double")
    b = spark.createDataFrame([(t, i, "a") for i, t in items], "text string, item_id long, doc_id string")
    want = []
    for i, t in docs:
        own = grams(t)
        for k, x in sorted({(k, x) for k, x in items if k is not None}, key=repr):
            s = grams(x)
            if s and len(s & own) >= 0.8 * len(s):
                want.append((i, k, len(s & own) / len(s), len(s & own)))
    for block in (7, C.BLOCK_ITEMS):
        got = [tuple(r) for r in C.contained_items(d, b, block=block).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert C.contained_items(d, b.limit(0)).collect() == [] and C.contained_items(d.limit(0), b).collect() == []


def test_an_item_of_one_shingle_is_found_wherever_it_stands():
    """Every run of five words of a text of 20,000 words is an item: none is hidden by a lesser hash of its slot."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(20_000)]
    index = C.Index([(i, " ".join(words[i : i + 5])) for i in range(len(words) - 4)])
    assert {m[0] for m in index.matches(words, C.WordHashes(), 0.8)} == set(range(len(words) - 4))
