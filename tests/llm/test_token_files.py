import io
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import harmonic as H, pfor as P, shared, tokens as T
from ledgerloom.llm.queries import QUERIES

TEXTS = [
    "", " ", "\n\n a", "a  b", " a\n\nb \n c  ", "It's we'll 'tis ' s", "ÉCOLE Straße İ ΑΣ ΑΣ. é ́x", "a b  c　　d", "x\x1cy\x1f z\x85w", "<|endoftext|> <|startoftext|>x", "12 345\t6",
    "日本語 テキスト 🎉🎉 ok", "end ", "  lead", "tab\t\ttab", "\r\n\r\n",
]


@pytest.mark.parametrize("name", [T.WORD_BPE, T.BYTE_BPE])
def test_pieces_give_the_ids_of_the_whole_text(name):
    encode, plain = T.Encoder(T.public_path(name)), Tokenizer.from_file(T.public_path(name))
    plain.encode_special_tokens = True
    rng = random.Random(6)
    alphabet = ["a", "B", " ", "  ", "\n", "é", "'", "s", "7", "-", " ", " ", "́", "the", "\x1c"]
    for t in TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(800)]:
        assert np.frombuffer(encode(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


MARKED = ["end of a <|endoftext|> mark", "<|endoftext|>", "A<|startoftext|>B", " <|endoftext|> <|endoftext|>\n\n<|EndOfText|>  x", "<|endoftext|", "É<|endoftext|> É", "'s<|endoftext|>'s"]


@pytest.mark.parametrize("name", [T.WORD_BPE, T.BYTE_BPE])
def test_added_tokens_get_the_ids_of_an_untouched_tokenizer(name):
    encode, untouched = T.Encoder(T.public_path(name), added=True), Tokenizer.from_file(T.public_path(name))
    rng = random.Random(7)
    parts = ["<|endoftext|>", "<|startoftext|>", " ", "\n", "  ", "a", "B", "É", "'s", "7", "<|", "|>", "the"]
    for t in TEXTS + MARKED + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 20))) for _ in range(800)]:
        assert np.frombuffer(encode(t), "<u4").tolist() == untouched.encode(t, add_special_tokens=False).ids, repr(t)


def test_queries_give_added_tokens_their_ids(spark, tmp_path):
    rows_of(spark, list(enumerate(MARKED))).write.parquet(f"{tmp_path}/documents.parquet")
    for query, name, crc in (("op6_patched_blocks", T.WORD_BPE, "ids_crc32"), ("op8_harmonic_packing", T.BYTE_BPE, "ids_crc32")):
        untouched = Tokenizer.from_file(T.public_path(name))
        want = {i: zlib.crc32(np.array(untouched.encode(t, add_special_tokens=False).ids + [T.END_ID], "<u4").tobytes()) for i, t in enumerate(MARKED)}
        rows = QUERIES[query](spark, str(tmp_path)).collect()
        whole = {r.doc_id: r[crc] for r in rows if query.startswith("op6") or r.length == r.doc_tokens}
        assert whole and all(want[i] == c for i, c in whole.items())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 2**32 - 1), st.integers(0, 50)), min_size=1, max_size=1024), st.integers(1, 100))
def test_block_round_trip(ids, percentile):
    ids = np.array(ids, "<u4")
    assert P.unpack_block(b"pre" + P.pack_block(ids, percentile), 3).tolist() == ids.tolist()


def test_file_round_trip_and_places():
    rng = np.random.default_rng(2)
    docs = [(None, rng.integers(0, 9, 3).astype("<u4"))] + [(i, rng.integers(0, 50_000, int(n)).astype("<u4")) for i, n in enumerate([1, 5000, 1, 1024, 700_000, 2])]
    out = io.BytesIO()
    w = P.Writer(out)
    for i, ids in docs:
        w.add(i, ids)
    w.finish()
    reader = P.Reader(out, len(out.getvalue()))
    assert [(i, x.tolist()) for i, x in reader.documents()] == [(i, x.tolist()) for i, x in docs]
    whole = np.concatenate([x for _, x in docs])
    assert P.Reader(out, len(out.getvalue())).ids(4000, 3000).tolist() == whole[4000:7000].tolist()


def rows_of(spark, texts):
    return spark.createDataFrame([(t, i, "x", 0) for i, t in texts], "text string, doc_id long, ids string, start int").repartition(3)


def test_token_files(spark):
    texts = [(i * 3 % 17, t) for i, t in enumerate(TEXTS)] + [(5, None), (5, "again"), (None, "no id"), (40, "long " * 5000)]
    encode, end = T.Encoder(T.public_path(T.WORD_BPE)), np.array([T.END_ID], "<u4").tobytes()
    files = P.write_token_files(rows_of(spark, texts), shared.shared_folder(spark, "tokens"), T.public_path(T.WORD_BPE))
    got = sorted(((-1 if r.id is None else r.id), r.start, r.n_tokens, bytes(r.ids)) for r in P.read_token_files(spark, files).collect())
    want, at = [], 0
    for i, t in sorted(((-1 if i is None else i), t or "") for i, t in texts):
        ids = encode(t) + end
        want.append((i, at, len(ids) // 4, ids))
        at += len(ids) // 4
    assert sorted(got, key=lambda r: r[1]) == want
    empty = P.write_token_files(rows_of(spark, texts).limit(0), shared.shared_folder(spark, "tokens"), T.public_path(T.WORD_BPE))
    assert P.read_token_files(spark, empty).collect() == []


def test_cuts_cover_and_fill():
    for n in list(range(1, 2100)) + [5000, 4096]:
        parts = H.cuts(n)
        assert sum(parts) == n and all(0 < p <= 2048 for p in parts)
        assert all(2048 - 2048 // p * p <= 0.02 * 2048 for p in parts)


def test_packing(spark):
    rng = random.Random(8)
    texts = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.choice([0, 3, 200, 900, 5000])))) for i in range(150)]
    texts += [(7, None), (None, "no id"), (3, texts[3][1])]
    rows = H.pack(rows_of(spark, texts), T.public_path(T.BYTE_BPE)).withColumn("crc", F.crc32("ids")).collect()
    encode, end = T.Encoder(T.public_path(T.BYTE_BPE)), np.array([T.END_ID], "<u4").tobytes()
    assert all(zlib.crc32(r.ids) == r.crc and len(r.ids) == 4 * r.length for r in rows)
    pieces = sorted(((-1 if r.id is None else r.id), r.doc_tokens, r.start, bytes(r.ids)) for r in rows)
    want = {}
    for i, t in texts:
        want.setdefault((-1 if i is None else i), []).append(encode(t or "") + end)
    by_doc = {}
    for i, n, start, ids in pieces:
        by_doc.setdefault((i, n), []).append((start, ids))
    for i, all_ids in want.items():
        for n in {len(x) // 4 for x in all_ids}:
            copies = [x for x in all_ids if len(x) // 4 == n]
            starts = by_doc[i, n]
            assert sorted(p for s, x in starts for p in range(s, s + len(x) // 4)) == sorted(list(range(n)) * len(copies))
            assert all(copies[0][4 * s : 4 * s + len(x)] == x for s, x in starts)
    padded = total = 0
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        total += at
        padded += 0 if at & (at - 1) == 0 else 2048 - at
    assert padded <= 0.02 * total
    assert H.pack(rows_of(spark, texts).limit(0), T.public_path(T.BYTE_BPE)).collect() == []
