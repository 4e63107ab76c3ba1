"""Alignment of two vocabularies, against loops over the libraries' own tokens of whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from ledgerloom.llm import queries, token_alignment as A, tokens
from ledgerloom.llm.word_table import byte_piece

PATHS = tokens.public_path(tokens.BYTE_BPE), tokens.public_path(tokens.PIECE_BPE)


def brute(rows):
    """Rows as the contract says them, with sets and double loops."""
    a_model, b_model = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
    a_model.encode_special_tokens = True
    piece = lambda k: bytes([int(b_model.id_to_piece(k)[3:5], 16)]) if b_model.is_byte(k) else b_model.id_to_piece(k).replace("▁", " ").encode()
    docs = []
    for key, text in rows:
        a, b, groups = [], [], []
        if text:
            a, b = a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)
            bytes_a, bytes_b = [byte_piece(a_model.id_to_token(k)) for k in a], [piece(k) for k in b]
            if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
                a, b = [], []
            else:
                ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
                cuts = sorted(set(ends_a) & set(ends_b))
                at_a = {e: k for k, e in enumerate(ends_a)}
                at_b = {e: k for k, e in enumerate(ends_b)}
                i = j = 0
                for cut in cuts:
                    groups.append((a[i : at_a[cut] + 1], b[j : at_b[cut] + 1]))
                    i, j = at_a[cut] + 1, at_b[cut] + 1
        docs.append((key, a, b, groups, Counter((x, y) for g, h in groups for x in g for y in h)))
    held = Counter(p for d in docs for p in d[4])
    most = {}
    for (x, _), n in held.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for key, a, b, groups, links in docs:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((
            key, len(a), len(b), len(groups), sum(links.values()), sum(n for p, n in links.items() if held[p] == most[p[0]]),
            sum(n * held[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if a else "",
        ))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()), key=repr)


RNG = random.Random(4)
SIGNS = ["a", "the", " ", " ", "  ", "\n", " \n ", "é", "你好", "\U0001f600", "'s", "12", "-", "▁", "<s>", "<0x41>", "<|endoftext|>", "\t", "\x00", "　", "\x1c", "ing", "Straße"]
MIXED = ["".join(RNG.choice(SIGNS) for _ in range(RNG.randint(1, 60))) for _ in range(300)]
TEXTS = [None, "", " ", "   ", "x", " lead", "end ", "a ▁ b", "<unk></s> x", "<|endoftext|>", "é", "a\r\n b"] + MIXED


@pytest.mark.parametrize("stretch, block", [(A.STRETCH, A.BLOCK_LINKS), (7, 40), (40, 1)])
def test_alignment_equals_double_loops(spark, stretch, block):
    rows = list(enumerate(TEXTS)) + [(3, "x"), (3, "x"), (None, "x y z")]
    docs = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id long, text string, pairs int, block int").repartition(3)
    assert rows_of(A.alignment(docs, *PATHS, stretch=stretch, block_links=block)) == brute(rows)


def test_long_texts_wide_groups_and_no_rows(spark):
    wide = "".join(chr(0x1F600 + k % 60) for k in range(300))  # groups of many tokens a side
    rows = [("long", "naïve words, 你好 and so on\n" * 9000), ("wide", wide), ("signs", "▁" * 500), ("blank", " " * 3000 + "x")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert rows_of(A.alignment(docs, *PATHS, stretch=5000)) == brute(rows)
    assert rows_of(A.alignment(docs.limit(0), *PATHS)) == []


@pytest.mark.parametrize("seed", range(20))
def test_dividing_finds_every_shared_end(seed):
    rng = np.random.default_rng(seed)
    a_parts, b_parts, last_a, last_b, base = [], [], [], [], 0
    for _ in range(rng.integers(1, 6)):
        total = int(rng.integers(1, 400))
        share = rng.random()
        for parts, last in ((a_parts, last_a), (b_parts, last_b)):
            own = np.flatnonzero(rng.random(total) < share * rng.random()) + 1
            parts.append(base + np.union1d(own, [total]))
            last.append(sum(map(len, parts)) - 1)
        base += total
    a, b = np.concatenate(a_parts), np.concatenate(b_parts)
    at_a, at_b = A.shared_ends(a, b, np.array(last_a), np.array(last_b))
    assert a[at_a].tolist() == b[at_b].tolist() == np.intersect1d(a, b).tolist()


def test_wide_groups_count_like_narrow_ones(monkeypatch):
    v = A.both(*PATHS)
    text = " " + "".join(chr(0x1F600 + k % 7) for k in range(60)) + " the end"
    one = A.Aligned(v, [(v.a(text), v.b.of(text)[0])])
    monkeypatch.setattr(A, "WIDE", 1)
    two = A.Aligned(v, [(v.a(text), v.b.of(text)[0])])
    assert one.pair.tolist() == two.pair.tolist() and one.links.tolist() == two.links.tolist()


def test_query_equals_double_loops(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    assert rows_of(queries.QUERIES["op11_token_alignment"](spark, sf).withColumnRenamed("doc_id", "id")) == brute(rows)
