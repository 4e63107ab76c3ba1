import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import chroma as C, neighbour_votes as N, weak_labels as W
from ledgerloom.llm.shared import in_fold


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(12)
    vocab = [a + b for a in ("ba", "de", "ki", "lo", "mu", "na", "po", "ri") for b in ("ba", "de", "ki", "lo", "mu", "na", "ster", "ton")]
    bad = ["vexword", "grumble", "snarled", "oafish", "crudely"]
    rows, labels = [], []
    for i in range(500):
        words = [rng.choice(vocab) for _ in range(rng.randint(30, 200))]
        toxic, quality = int(i % 6 == 0), int(i % 4 != 1)
        if toxic:
            for at in rng.sample(range(len(words)), 6):
                words[at] = rng.choice(bad)
        text = " ".join(words) if quality else "!! ".join(w.upper() + "$$" for w in words)
        rows.append((i, text))
        labels.append((i, quality, toxic))
    rows += [(1000, None), (1001, ""), (None, "no id"), (3, rows[3][1])]
    labels += [(None, 1, 1), (7, None, None), (2000, 1, 0)]
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, score string, y int")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: (q, t) for i, q, t in labels if q is not None}


def test_folds(spark):
    rows = spark.range(40).select("id", in_fold(F.col("id"), 5, 0).alias("x")).collect()
    assert all(r.x == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)


def held_out(scored, truth, modulus, remainder, at, threshold):
    held = [r for r in scored if r.doc_id in truth and (r.doc_id or 0) < 500 and zlib.crc32(str(r.doc_id).encode()) % modulus == remainder]
    return np.mean([(r.score >= threshold) == truth[r.doc_id][at] for r in held])


def test_toxicity_held_out(spark, corpus):
    docs, labels, truth = corpus
    sample = W.labelled_sample(docs, labels, "toxic", lambda k: ~in_fold(k, 5, 0))
    model = W.fit_toxicity(sample)
    scored = W.toxicity_scores(docs, model).collect()
    assert len(scored) == docs.count() and scored[0].__fields__ == ["doc_id", "text", "y", "score"]
    assert all(0 <= r.score <= 1 for r in scored)
    assert held_out(scored, truth, 5, 0, 1, 0.5) >= 0.97
    again = W.fit_toxicity(sample.repartition(5))
    assert np.allclose(model.weights, again.weights, atol=1e-8)
    none = W.fit_toxicity(sample.limit(0))
    assert {r.score for r in W.toxicity_scores(docs, none).collect()} == {0.0}
    assert W.toxicity_scores(docs.limit(0), model).collect() == []


def test_label_model_finds_accuracies_and_ties():
    rng = np.random.default_rng(3)
    y = rng.random(6000) < 0.3
    flip = lambda p: np.where(rng.random(len(y)) < p, y, ~y).astype(int)
    a, b, c, d = flip(0.9), flip(0.8), flip(0.75), flip(0.85)
    copy_of_b = np.where(rng.random(len(y)) < 0.95, b, 1 - b)
    votes = np.stack([a, b, copy_of_b, c, d], 1)
    model, q = W.fit_label_model(votes, flip(0.8).astype(float), hold=0.2)
    assert model.parents[2] == 1 or model.parents[1] == 2
    assert abs(model.prior - 0.3) < 0.06
    assert ((q > 0.5) == y).mean() > 0.9
    apart, _ = W.fit_label_model(votes[:, [0, 1, 3, 4]], flip(0.8).astype(float), hold=0.2)
    for j, right in enumerate((0.9, 0.8, 0.75, 0.85)):
        if apart.parents[j] < 0:
            assert abs(apart.tables[j][1, 1, 2] - right) < 0.06 or abs(apart.tables[j][1, 0, 2] - right) < 0.06


def test_quality_held_out_and_exact_neighbours(spark, corpus):
    docs, labels, truth = corpus
    sample = W.labelled_sample(docs, labels, "quality", lambda k: ~in_fold(k, 4, 2), N.SAMPLE)
    model = N.fit_quality(sample)
    scored = N.quality_scores(docs, model).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored)
    assert held_out(scored, truth, 4, 2, 0, 0.7) >= 0.97
    v = model.vectors[:20]
    cos = v @ model.vectors.T
    for i in range(20):
        near = np.argsort(-cos[i], kind="stable")[:5]
        w = np.exp(N.SHARPNESS * (cos[i][near] - cos[i][near].max()))
        want = (w @ model.labels[near] + model.base) / (w.sum() + 1)
        assert abs(model.votes(v[i : i + 1], 5)[0] - want) < 1e-5
    none = N.fit_quality(sample.limit(0))
    assert {r.score for r in N.quality_scores(docs, none).collect()} == {0.5}


def test_sample_is_bounded_and_leaves_folds_out(corpus):
    docs, labels, _ = corpus
    rows = W.labelled_sample(docs, labels, "toxic", lambda k: ~in_fold(k, 5, 0), 50).collect()
    assert len({r.id for r in rows}) == 50 and not any(zlib.crc32(str(r.id).encode()) % 5 == 0 for r in rows)


def tune(notes, seed=0, noise=0.0):
    t = np.arange(int(0.25 * C.RATE)) / C.RATE
    x = np.concatenate([0.4 * np.sin(2 * np.pi * 220 * 2 ** (n / 12) * t) for n in notes])
    return x + noise * np.random.default_rng(seed).normal(size=len(x))


def test_image_sums_and_decoding():
    image = np.random.default_rng(1).random((40, 12))
    sums = np.zeros((41, 13))
    sums[1:, 1:] = image.cumsum(0).cumsum(1)
    assert np.allclose(C._area(sums, np.arange(30), 2, 7, 3, 8), [image[t + 2 : t + 7, 3:8].sum() for t in range(30)])
    x, rate = C.decode_wave(C.encode_wave(tune([1, 5])))
    assert rate == C.RATE and np.allclose(x, tune([1, 5]), atol=1e-4)
    for bad in (None, b"", b"RIFFjunk", C.encode_wave(np.zeros(0))):
        assert len(C.fingerprint(bad)) == 0


def test_alignment_finds_offset(spark):
    rng = random.Random(2)
    notes = [rng.randrange(24) for _ in range(60)]
    other = [rng.randrange(24) for _ in range(60)]
    step = int(0.25 * C.RATE)
    rows = [
        (100, C.encode_wave(tune(notes))), (3, C.encode_wave(tune(notes, noise=0.003))), (4, C.encode_wave(tune(notes)[8 * step :])), (5, C.encode_wave(tune(other))),
        (6, C.encode_wave(tune(notes))), (7, None), (8, C.encode_wave(np.zeros(50))), (None, C.encode_wave(tune(other))), (200, C.encode_wave(np.zeros(0))),
    ]
    df = spark.createDataFrame([(m, i, "q") for i, m in rows], "media binary, id long, items string")
    for block in (1, 4000):
        got = {r.id: r for r in C.aligned(df, block=block).collect()}
        assert len(got) == len(rows)
        assert got[3].match_id == 6 and abs(got[3].offset) <= 1 and got[3].bit_errors < 0.1
        assert got[4].match_id == 6 and abs(got[4].offset - round(8 * step / C.HOP)) <= 1
        assert got[5].match_id is None and got[6].class_id == got[100].class_id == 6 and got[100].n_links == 0
        assert got[7].class_id == 7 and got[8].class_id == 8 and got[7].n_items == 0 and got[None].class_id == 5
    assert C.aligned(df.limit(0)).collect() == []
    vectors = spark.createDataFrame([(100, [0.1, -0.5, None, 0.9] * 16), (1, [0.1, -0.5, 0.0, 0.9] * 16), (2, None), (3, [float("nan")] * 3)], "id long, media array<double>")
    got = {r.id: r for r in C.aligned(vectors, C.melody).collect()}
    assert got[100].class_id == got[1].class_id == 1 and got[2].n_items == got[3].n_items == 0


def test_sample_holds_one_row_of_an_id(spark):
    docs = spark.createDataFrame([(i % 10 if i < 300 else i, f"text {i:03d}") for i in range(400)] + [(3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    got = W.labelled_sample(docs, labels, "toxic", lambda key: key.isNotNull(), limit=50).collect()
    assert len(got) <= 50 and len({r.id for r in got}) == len(got)
    every = {r.id: (r.text, r.y) for r in W.labelled_sample(docs, labels, "toxic", lambda key: key.isNotNull()).collect()}
    assert len(every) == 110 and every[4] == ("text 004", 0) and every[3] == ("", 1)
