"""Byte-pair ids of whole texts from a table of distinct words, and texts from ids.

Encoding: tasks split their texts into words and number each block's distinct words. A block leaves a file of word numbers
and, per bucket of a word hash, one row of words. Rows of a bucket meet in one task, which encodes each distinct word once
and answers every row with ids by position; answers come back to their block by its name and the file's numbers become
ids. So a word crosses the cluster once per block that holds it, not once per occurrence, and no text is shuffled.

Decoding: ids join the table of pieces by their position in it. That table has one row per entry of the vocabulary, which
bounds it, so it is broadcast.

A null text counts as empty; an empty text has no ids. Rows are kept as they are: repeated ids, null ids and repeated texts
stay rows of their own. Columns other than id and text are not carried, so their names can't clash. A text of any length
is one row of one block, as it is one row of its table; a block ends with the text that fills it.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm import tokens
from ledgerloom.llm.files import NewFile, open_input
from ledgerloom.llm.shared import arrow_map, materialize, shared_folder

BLOCK_CHARS, BUCKETS, OUT_BYTES = 12_000_000, 2048, 4 << 20


class _Numbers(dict):
    """Word -> number in order of first sight."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _narrow(values: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes each as the largest needs (told by the first byte), a plane per byte."""
    width = next(w for w in (1, 2, 4) if w == 4 or values.max(initial=0) < 1 << 8 * w)
    planes = values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return bytes([width]) + np.ascontiguousarray(planes).tobytes()


def _widened(raw: bytes, n: int) -> tuple[np.ndarray, int]:
    """The first ``n`` numbers that ``_narrow`` wrote, and the bytes they took."""
    width = raw[0]
    planes = np.frombuffer(raw, np.uint8, n * width, 1).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.uint32), 1 + n * width


def _packed(lengths: list[int], data: bytes | np.ndarray) -> bytes:
    """Lengths and what they cut: bytes, or 32-bit numbers."""
    body = data if isinstance(data, bytes) else _narrow(data)
    return zstandard.ZstdCompressor(level=3).compress(len(lengths).to_bytes(4, "little") + _narrow(np.array(lengths, np.uint32)) + body)


def _unpacked(packed: bytes) -> tuple[np.ndarray, bytes]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n = int.from_bytes(raw[:4], "little")
    lengths, taken = _widened(raw[4:], n)
    return lengths, raw[4 + taken :]


def _unpacked_ids(packed: bytes) -> tuple[np.ndarray, bytes]:
    lengths, body = _unpacked(packed)
    return lengths * 4, _widened(body, int(lengths.sum(dtype=np.int64)))[0].astype("<u4").tobytes()


def _slices(lengths: np.ndarray, data: bytes) -> list[bytes]:
    ends = np.cumsum(lengths, dtype=np.int64)
    return [data[a:b] for a, b in zip((ends - lengths).tolist(), ends.tolist())]


def _write_table(sink, table: pa.Table) -> None:
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)


def _block_rows(folder: str, ids: list[pa.Array], sizes: list[int], codes: list[np.ndarray], words: _Numbers) -> pa.RecordBatch:
    """Writes one block's file and gives its words, a row per bucket. The most frequent words have the least numbers, and
    numbers are written a byte at a time, so that most of the second and third bytes are zero."""
    number = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
    spelled = [w.encode() for w in words]
    bucket = np.fromiter((xxhash.xxh32_intdigest(w) % BUCKETS for w in spelled), np.int32, len(spelled))
    rank = np.empty(len(spelled), np.uint32)
    rank[np.argsort(-np.bincount(number, minlength=len(spelled)), kind="stable")] = np.arange(len(spelled), dtype=np.uint32)
    by_name = np.array(sorted(range(len(spelled)), key=spelled.__getitem__), np.int64)
    by_bucket = by_name[np.argsort(bucket[by_name], kind="stable")]  # like words side by side pack better
    octets = rank[number].astype("<u4").view(np.uint8).reshape(-1, 4)
    file = NewFile(folder, "block", ".words")
    _write_table(file.stream, pa.table({"id": pa.chunked_array(ids), "n_words": pa.array(sizes, pa.int64())}))
    _write_table(file.stream, pa.table({str(k): np.ascontiguousarray(octets[:, k]) for k in range(4)}))
    _write_table(file.stream, pa.table({"rank": rank[by_bucket]}))
    file.close()
    held, first = np.unique(bucket[by_bucket], return_index=True)
    rows = []
    for group in np.split(by_bucket, first[1:]) if len(held) else []:
        own = [spelled[k] for k in group.tolist()]
        rows.append(_packed([len(w) for w in own], b"".join(own)))
    if not rows:  # a block of empty texts still has an answer to wait for
        held, rows = np.zeros(1, np.int32), [_packed([], b"")]
    return pa.record_batch({"block": pa.array([file.path] * len(rows)), "bucket": pa.array(held, pa.int32()), "words": pa.array(rows, pa.binary())})


def split_words(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Texts as blocks of word numbers in files: block (the file), bucket, words. Written to the shared folder."""
    folder = shared_folder(docs.sparkSession, "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts_of = tokens.encoder(path, added=True).parts
        ids, sizes, codes, words, chars = [], [], [], _Numbers(), 0
        for batch in batches:
            at = 0
            for k, text in enumerate(batch["text"]):
                text = text.as_py() or ""
                parts = parts_of(text)
                sizes.append(len(parts))
                codes.append(np.fromiter(map(words.__getitem__, parts), np.uint32, len(parts)))
                chars += len(text)
                if chars >= block_chars:
                    yield _block_rows(folder, [*ids, batch["id"][at : k + 1]], sizes, codes, words)
                    ids, sizes, codes, words, chars, at = [], [], [], _Numbers(), 0, k + 1
            if at < batch.num_rows:
                ids.append(batch["id"][at:])
        if sizes:
            yield _block_rows(folder, ids, sizes, codes, words)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return materialize(rows.mapInArrow(run, "block string, bucket int, words binary"), "word-blocks")


def word_ids(words: DataFrame, path: str) -> DataFrame:
    """Each distinct word of a bucket encoded once: block, bucket, ids (in the order of the row's words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokens.encoder(path, added=True).untouched()
        known, current = {}, None
        for batch in batches:
            out = []
            for bucket, packed in zip(batch["bucket"].to_pylist(), batch["words"].to_pylist()):
                if bucket != current:
                    known, current = {}, bucket
                own = [w.decode() for w in _slices(*_unpacked(packed))]
                fresh = [w for w in own if w not in known]
                for word, found in zip(fresh, tokenizer.encode_batch_fast(fresh, add_special_tokens=False)):
                    known[word] = np.array(found.ids, "<u4").tobytes()
                found = [known[w] for w in own]
                out.append(_packed([len(x) // 4 for x in found], np.frombuffer(b"".join(found), "<u4")))
            yield pa.record_batch({"block": batch["block"], "bucket": batch["bucket"], "ids": pa.array(out, pa.binary())})

    dealt = words.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "block string, bucket int, ids binary")


def _documents(block: str, answers: list[bytes], pieces: list[bytes] | None) -> Iterator[pa.RecordBatch]:
    with open_input(block) as source:
        docs, planes, order = (pa.ipc.open_stream(source).read_all() for _ in range(3))
    found = [ids for packed in answers for ids in _slices(*_unpacked_ids(packed))]
    of_rank = [b""] * len(found)
    for rank, ids in zip(order["rank"].to_pylist(), found):
        of_rank[rank] = ids
    octets = np.stack([planes[str(k)].to_numpy() for k in range(4)], axis=1)
    number = np.ascontiguousarray(octets).view("<u4").ravel()
    at, first, held, size = 0, 0, [], 0
    for k, n in enumerate(docs["n_words"].to_pylist()):
        held.append(b"".join(map(of_rank.__getitem__, number[at : at + n].tolist())))
        at, size = at + n, size + len(held[-1])
        if size >= OUT_BYTES or k + 1 == docs.num_rows:
            texts = {} if pieces is None else {"text": pa.array([_spelled(x, pieces) for x in held], pa.string())}
            yield pa.record_batch({"id": docs["id"].slice(first, len(held)).combine_chunks(), "ids": pa.array(held, pa.binary()), **texts})
            first, held, size = k + 1, [], 0


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, pieces: DataFrame | None = None) -> DataFrame:
    """id, ids (little-endian unsigned 32-bit integers) of every row, as the library's own encode gives them for the
    whole text, added tokens included. With ``pieces`` also the text that the ids give, as ``decoded`` does, in the same
    tasks."""
    kind = docs.select(F.col(id_col)).dtypes[0][1]
    answers = word_ids(split_words(docs, path, id_col, text_col, block_chars), path)
    blocks = answers.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "ids"))).alias("answers"))
    table = None if pieces is None else _by_position(pieces)

    def make() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        piece = table and table.value

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for block, parts in zip(batch["block"], batch["answers"]):
                yield from _documents(block.as_py(), [x["ids"].as_py() for x in parts], piece)

        return run

    return arrow_map(blocks, make, f"id {kind}, ids binary" + (", text string" if pieces is not None else ""))


@functools.cache
def _byte_of_sign() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printing Latin-1 signs are themselves, the other
    bytes in order are the signs from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def byte_piece(sign: str) -> bytes:
    """Bytes of a vocabulary entry; an entry with other signs (an added token) is its own UTF-8."""
    of = _byte_of_sign()
    return bytes(of[c] for c in sign) if all(c in of for c in sign) else sign.encode()


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """piece_id, piece: one row per entry of the vocabulary."""
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    return spark.createDataFrame([(n, bytearray(byte_piece(s))) for s, n in vocabulary.items()], "piece_id int, piece binary")


def _by_position(pieces: DataFrame):
    """The table of pieces, bounded by its vocabulary, as a broadcast list whose positions are the ids."""
    known = {r.piece_id: bytes(r.piece) for r in pieces.collect()}
    return pieces.sparkSession.sparkContext.broadcast([known.get(k, b"") for k in range(max(known, default=-1) + 1)])


def _spelled(ids: bytes | None, piece: list[bytes]) -> str:
    own = np.frombuffer(ids or b"", "<u4")
    if len(own) and own.max() >= len(piece):
        own = own[own < len(piece)]
    return b"".join(map(piece.__getitem__, own.tolist())).decode("utf-8", "replace")


def decoded(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """id, ids, text: ``rows`` (id, ids) with each id's piece looked up in ``pieces``, joined in order, as UTF-8 with
    replacement characters where bytes are none. An id without a piece gives nothing."""
    table = _by_position(pieces)

    def make() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        piece = table.value

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [_spelled(x, piece) for x in part["ids"].to_pylist()]
                yield pa.record_batch({"id": part["id"], "ids": part["ids"], "text": pa.array(texts, pa.string())})

        return run

    return arrow_map(rows.select("id", "ids"), make, f"id {rows.select('id').dtypes[0][1]}, ids binary, text string")
