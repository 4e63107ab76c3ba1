"""A corpus pipeline of five stages: toxicity, near copies, benchmark leaks, personal data, packing.

Every stage works on all rows that its predecessor kept, and its decisions take effect. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm import containment, harmonic, simhash_trie, surrogates, tokens, weak_labels
from ledgerloom.llm.shared import in_fold, materialize, shared_folder, table

REJECTED = 0.5


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under one half stay. The model learns from labelled rows of ``docs``."""
    sample = weak_labels.labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", lambda key: ~in_fold(key, 5, 0))
    scored = weak_labels.toxicity_scores(docs, weak_labels.fit_toxicity(sample), score_col="__score")
    return scored.filter(F.col("__score") < REJECTED).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the document of the smallest doc_id stays, once; a row without doc_id stays.

    Rows of one doc_id with different texts are one document: both stay or both go. Only rows of a repeated doc_id are
    grouped by their text; all others pass one join with the ids that go or repeat.
    """
    gone = materialize(simhash_trie.near_copies(docs).select(F.col("id").alias("doc_id")), "copies")
    repeated = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1")
    repeated = materialize(repeated.join(gone, "doc_id", "left_anti").select("doc_id"), "repeated")
    if repeated.isEmpty():  # no row to group: texts pass one join only
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    mark, name = F.lit(True), "__repeated"
    while name in docs.columns:
        name += "_"
    marks = materialize(gone.select("doc_id", (~mark).alias(name)).unionByName(repeated.select("doc_id", mark.alias(name))), "marks")
    kept = docs.join(marks, "doc_id", "left")
    alone = kept.filter(F.col(name).isNull()).select(*docs.columns)
    rest = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    row = F.struct(*rest, F.lit(0).alias(name)).alias(name)  # of equal texts of an id the least row by its other columns
    least = kept.filter(F.col(name)).groupBy("doc_id", "text").agg(F.min_by(row, F.to_json(row)).alias(name))
    return alone.unionByName(least.select(*(c if c in ("doc_id", "text") else F.col(name)[c].alias(c) for c in docs.columns)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; so do repeated rows of their doc_id. A row without doc_id stays."""
    found = containment.contained_items(docs, table(spark, sf_dir, "benchmark"))
    leaks = materialize(found.select(F.col("id").alias("doc_id")).distinct(), "leaks")
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced; n_chars follows the text."""
    out = surrogates.replaced(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 ids."""
    packed = harmonic.pack(docs, tokens.public_path(tokens.BYTE_BPE), added=True)
    return packed.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", toxicity),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Trained models, tokenizers and keyed draws are beyond SQL; the tests follow the pipeline with plain code instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; between stages the rows are written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
