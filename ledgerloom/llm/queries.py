"""The operators as named queries over the given tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm import chroma, containment, conversation_trie, harmonic, neighbour_votes, pfor, repeated_bytes, simhash_trie, surrogates, token_alignment, tokens, warc, weak_labels, word_table
from ledgerloom.llm.shared import in_fold, shared_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


@query("op1_chroma_alignment")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a short recording, fingerprinted and aligned with those of ids divisible by 100."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("media"))
    return chroma.aligned(rows, chroma.melody).withColumnRenamed("id", "vec_id")


@query("op2_neighbour_votes")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; rows of fold 2 of 4 are never learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = in_fold(F.col("doc_id"), 4, 2)
    sample = weak_labels.labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", lambda key: ~in_fold(key, 4, 2), neighbour_votes.SAMPLE)
    scored = neighbour_votes.quality_scores(docs, neighbour_votes.fit_quality(sample))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query(
    "op3_warc_ranges",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
         d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
         r AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
    SELECT page_id, cast(payload_bytes AS bigint) AS payload_bytes, payload_digest,
           CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN first <> page_id THEN first END AS refers_to
    FROM r
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as WARC records, read the archives back by byte ranges."""
    read = warc.warc_round_trip(spark, table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op4_simhash_trie")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the components of those within two bits."""
    found = simhash_trie.simhash_components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("word"), 16, "0")).alias("fingerprint"), "component_id")


@query("op5_longest_previous_factor")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their repeated strings of 400 bytes."""
    found = repeated_bytes.without_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.end - s.start)
    return found.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


@query("op6_patched_blocks")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of all documents as patched frame-of-reference files, read them back."""
    files = pfor.write_token_files(table(spark, sf_dir, "documents"), shared_folder(spark, "tokens"), tokens.public_path(tokens.WORD_BPE), added=True)
    read = pfor.read_token_files(spark, files)
    return read.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query(
    "op7_minhash_containment",
    """
    WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark),
         d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
         si AS (SELECT DISTINCT item_id, array_to_string(w[k : k + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
         sd AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
         n AS (SELECT item_id, count(*) AS n FROM si GROUP BY 1),
         c AS (SELECT doc_id, item_id, count(*) AS common FROM sd JOIN si USING (s) GROUP BY 1, 2)
    SELECT doc_id, item_id, common / n AS containment FROM c JOIN n USING (item_id) WHERE common >= 0.8 * n
    """,
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item."""
    found = containment.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "containment")


@query("op8_harmonic_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids."""
    packed = harmonic.pack(table(spark, sf_dir, "documents"), tokens.public_path(tokens.BYTE_BPE), cached=500_000, added=True)
    return packed.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op9_surrogates")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replaced(docs, count_col="n_entities")


@query("op10_weak_labels")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; rows of fold 0 of 5 are never learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = in_fold(F.col("doc_id"), 5, 0)
    sample = weak_labels.labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", lambda key: ~in_fold(key, 5, 0))
    scored = weak_labels.toxicity_scores(docs, weak_labels.fit_toxicity(sample))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op12_word_table")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents by their distinct words, and the texts that these ids give."""
    path = tokens.public_path(tokens.BYTE_BPE)
    read = word_table.encoded(table(spark, sf_dir, "documents"), path, pieces=word_table.piece_table(spark, path))
    count = (F.octet_length("ids") / 4).cast("long")
    return read.select(F.col("id").alias("doc_id"), count.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


@query("op11_token_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two vocabularies aligned in every document, with the corpus-wide counts of linked pairs."""
    paths = tokens.public_path(tokens.BYTE_BPE), tokens.public_path(tokens.PIECE_BPE)
    return token_alignment.alignment(table(spark, sf_dir, "documents"), *paths).withColumnRenamed("id", "doc_id")


@query("op13_conversation_trie")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations."""
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"))
