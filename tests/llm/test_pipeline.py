import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from ledgerloom.llm import containment, surrogates
from ledgerloom.llm.shared import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(31)
    vocab = [a + b + c for a in ("ba", "de", "ki", "lo", "mu", "na", "po") for b in ("ra", "le", "si", "to") for c in ("n", "s", "t", "m", "x")]
    bad = ["vexword", "grumble", "snarled", "oafish"]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    docs, labels, kinds = {}, [], {}
    for i in range(240):
        words = text(rng.randint(60, 160))
        if i % 6 == 0:
            for at in rng.sample(range(len(words)), 6):
                words[at] = rng.choice(bad)
        docs[i] = words
        kinds[i] = "toxic" if i % 6 == 0 else "clean"
        labels.append((i, 1, int(i % 6 == 0)))
    items = [(k, " ".join(text(30))) for k in range(4)]
    for i in (301, 302):
        docs[i] = text(40) + items[i % 4][1].split() + text(40)
        kinds[i] = "leak"
    for i, of in ((310, 1), (311, 1), (312, 2)):
        docs[i] = list(docs[of])
        if i != 310:
            docs[i][7] = "edited"
        kinds[i] = "copy"
    docs[320] = text(50) + ["mail", "anna.k@host.example.com", "end"] + text(20)
    kinds[320] = "private"
    rows = [(i, " ".join(w), "en", "s", None) for i, w in docs.items()] + [(5, " ".join(docs[5]), "en", "s", None), (400, None, None, None, None), (401, "", "x", "y", 0), (None, " ".join(text(80)), "en", "s", 3)]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, kinds


def test_stages(spark, corpus):
    folder, kinds = corpus
    docs = table(spark, folder, "documents")
    seen = docs
    steps = {}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, seen, folder)
        assert out.columns == COLUMNS and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        steps[name] = sorted(((r.doc_id if r.doc_id is not None else -1), r.text or "", r.n_chars) for r in out.collect())
        seen = spark.createDataFrame(out.collect(), docs.schema)
    ids = {name: [r[0] for r in rows] for name, rows in steps.items()}
    gone = {i for i, k in kinds.items() if k == "toxic"}
    assert sorted(ids["toxicity"]) == sorted([i for i in [*kinds, 5, 400, 401, -1] if i not in gone])
    # 310 and 311 copy 1, 312 copies 2; 400 and 401 both are empty; 5 comes once
    copies = {310, 311, 312, 401}
    assert sorted(ids["near_copies"]) == sorted(set(ids["toxicity"]) - copies)
    assert sorted(ids["decontamination"]) == sorted(set(ids["near_copies"]) - {301, 302})
    assert ids["personal_data"] == ids["decontamination"]
    before, after = {r[0]: r[1] for r in steps["decontamination"]}, {r[0]: r for r in steps["personal_data"]}
    changed = {i for i in before if before[i] != after[i][1]}
    assert changed == {320} and "anna.k@" not in after[320][1] and after[320][2] == len(after[320][1])
    assert [e[2] for e in surrogates.find_entities(after[320][1])] == ["email"]
    packed = P.run(spark, folder)
    assert {("doc_id", "bigint"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("doc_tokens", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")} == set(packed.dtypes)
    rows = packed.collect()
    assert {(-1 if r.doc_id is None else r.doc_id) for r in rows} == set(ids["personal_data"])
    held = {}
    for r in rows:
        held[r.doc_id] = held.get(r.doc_id, 0) + r.length
    assert all(held[r.doc_id] == r.doc_tokens for r in rows)


def test_empty_table(spark, corpus):
    folder, _ = corpus
    docs = table(spark, folder, "documents").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, folder).collect() == []


def test_training_rows_of_the_toxicity_stage_are_the_learnable_ones(spark, corpus):
    folder, _ = corpus
    docs = table(spark, folder, "documents")
    kept = P.weak_labels.labelled_sample(docs, table(spark, folder, "labels"), "toxic", lambda key: ~P.in_fold(key, 5, 0))
    assert not any(zlib.crc32(str(r.id).encode()) % 5 == 0 for r in kept.select("id").distinct().collect())
    assert containment.LEAST == 0.8 and docs.filter(F.col("doc_id") == 5).count() == 2
