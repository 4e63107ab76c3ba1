"""Ids through the table of distinct words, against the library's own encode and decode of whole texts."""

import hashlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import queries, tokens, word_table

PATH = tokens.public_path(tokens.BYTE_BPE)


def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


TEXTS = [
    None,
    "",
    " ",
    "\n\n  \t x",
    "It's the the  THE end , don't",
    "a <|endoftext|> b<|endoftext|><|endoftext|>",
    "<|endoftext|>",
    "naïve 你好 \U0001f600\U0001f1e9 é வண \x00 \x1c\x85 z",
    "1234567 12.50% --- ...!?",
    "word " * 40_000,
    "x" * 30_000,
]


@pytest.mark.parametrize("block_chars", [1, 50, 10_000_000])
def test_ids_and_texts_equal_the_library(spark, block_chars):
    rows = [(k, t, 7) for k, t in enumerate(TEXTS)] + [(3, "again", 7), (3, "again", 7), (None, "no id", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(3)
    pieces = word_table.piece_table(spark, PATH)
    got = word_table.decoded(word_table.encoded(docs, PATH, block_chars=block_chars), pieces).collect()
    tokenizer = library()
    want = []
    for key, text, _ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        want.append((key, ids, tokenizer.decode(ids, skip_special_tokens=False)))
    order = lambda rows: sorted(rows, key=repr)
    assert order((r.id, np.frombuffer(r.ids, "<u4").tolist(), r.text) for r in got) == order(want)
    assert [t for _, _, t in want][:11] == [t or "" for t in TEXTS]
    both = word_table.encoded(docs, PATH, block_chars=block_chars, pieces=pieces).collect()
    assert order((r.id, np.frombuffer(r.ids, "<u4").tolist(), r.text) for r in both) == order(want)


def test_no_rows_and_no_words(spark):
    pieces = word_table.piece_table(spark, PATH)
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert word_table.decoded(word_table.encoded(empty, PATH), pieces).collect() == []
    blank = spark.createDataFrame([("a", None), ("b", "")], "doc_id string, text string")
    assert sorted(word_table.encoded(blank, PATH).collect()) == [("a", b""), ("b", b"")]


def test_each_distinct_word_is_encoded_once_a_bucket(spark):
    docs = spark.createDataFrame([(k, "one two two three") for k in range(20)], "doc_id long, text string").repartition(4)
    blocks = word_table.split_words(docs, PATH, block_chars=40)
    assert blocks.select("block").distinct().count() > 4
    words = [w for r in blocks.collect() for w in word_table._slices(*word_table._unpacked(r.words))]
    assert len(words) == 3 * blocks.select("block").distinct().count()


def test_ids_beyond_the_pieces_and_broken_bytes(spark):
    rows = spark.createDataFrame([(1, bytearray(np.array([0, 60_000, 1], "<u4").tobytes())), (2, None), (3, bytearray(np.array([2, 2], "<u4").tobytes()))], "id int, ids binary")
    pieces = spark.createDataFrame([(0, bytearray(b"a")), (1, bytearray(b"b")), (2, bytearray(b"\xe4"))], "piece_id int, piece binary")
    assert sorted((r.id, r.text) for r in word_table.decoded(rows, pieces).collect()) == [(1, "ab"), (2, ""), (3, "��")]


def test_query_equals_the_library(spark, tmp_path):
    import duckdb

    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.QUERIES["op12_word_table"](spark, sf).collect()}
    tokenizer = library()
    for key, text in duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        assert got.pop(key) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    assert not got
