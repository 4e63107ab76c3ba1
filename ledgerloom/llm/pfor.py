"""Token files of patched frame-of-reference blocks.

A block holds 1024 ids (the last of a file fewer). Its minimum is subtracted, the differences are packed at the width
that the given percentile of them fits, and the high bits of the others are an exception list. A file is

    magic b"PFOR1\\0" | blocks | block starts (u64 each) | documents: id i64, flag u8 (0: null id), tokens u32, each as a
    column | footer: blocks u32, documents u32, ids u64, place of the block starts u64

and a block is: count u16, width u8, exceptions u16, minimum u32, packed words (u8), exception places (u16), exception
values (u32). All numbers are little-endian.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ledgerloom.llm.files import NewFile, open_input
from ledgerloom.llm.shared import materialize
from ledgerloom.llm.tokens import END_ID, encoder

MAGIC = b"PFOR1\0"
BLOCK = 1024
PERCENTILE = 95
CACHED = 500_000  # pieces of either generation that a worker keeps
_HEAD, _FOOT = struct.Struct("<HBHI"), struct.Struct("<IIQQ")


def pack_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    low = int(ids.min())
    rest = (ids - np.uint32(low)).astype(np.uint64)
    wide = np.frexp(rest.astype(np.float64))[1]  # bits of each difference
    within = np.cumsum(np.bincount(wide, minlength=33))
    width = int(np.searchsorted(within, math.ceil(percentile / 100 * (len(ids) - 1)) + 1))
    over = np.flatnonzero(wide > width)
    size = 2 if width <= 16 else 4
    shown = (rest & np.uint64((1 << width) - 1)).astype(f"<u{size}")
    bits = np.unpackbits(shown.view(np.uint8).reshape(-1, size), axis=1, bitorder="little")[:, :width]
    packed = np.packbits(bits.ravel(), bitorder="little").tobytes()
    high = (rest[over] >> np.uint64(width)).astype("<u4")
    return _HEAD.pack(len(ids), width, len(over), low) + packed + over.astype("<u2").tobytes() + high.tobytes()


def unpack_block(data: bytes, at: int = 0) -> np.ndarray:
    count, width, exceptions, low = _HEAD.unpack_from(data, at)
    at += _HEAD.size
    n = (count * width + 7) // 8
    size = 2 if width <= 16 else 4
    bits = np.zeros((count, 8 * size), np.uint8)
    if width:
        bits[:, :width] = np.unpackbits(np.frombuffer(data, np.uint8, n, at), bitorder="little")[: count * width].reshape(count, width)
    out = np.packbits(bits, axis=1, bitorder="little").view(f"<u{size}").ravel().astype(np.uint64)
    at += n
    places = np.frombuffer(data, "<u2", exceptions, at)
    out[places] |= np.frombuffer(data, "<u4", exceptions, at + 2 * exceptions).astype(np.uint64) << np.uint64(width)
    return (out + np.uint64(low)).astype("<u4")


class Writer:
    """Blocks go out as they fill; what is kept is the rest of a block, the block starts and the documents' lengths."""

    def __init__(self, file):
        self.file, self.at, self.total = file, len(MAGIC), 0
        self.starts, self.doc_ids, self.counts = [], [], []
        self.held = np.zeros(0, "<u4")
        file.write(MAGIC)

    def _put(self, ids: np.ndarray) -> None:
        data = pack_block(ids)
        self.starts.append(self.at)
        self.file.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids))
        self.total += len(ids)
        self.held = np.concatenate((self.held, ids)) if len(self.held) else ids
        whole = len(self.held) // BLOCK * BLOCK
        for i in range(0, whole, BLOCK):
            self._put(self.held[i : i + BLOCK])
        self.held = self.held[whole:]

    def finish(self) -> None:
        if len(self.held):
            self._put(self.held)
        ids = np.array([x or 0 for x in self.doc_ids], "<i8")
        known = np.array([x is not None for x in self.doc_ids], np.uint8)
        for part in (np.array(self.starts, "<u8"), ids, known, np.array(self.counts, "<u4")):
            self.file.write(part.tobytes())
        self.file.write(_FOOT.pack(len(self.starts), len(self.doc_ids), self.total, self.at))


class Reader:
    """Documents of a file; ``ids(first, n)`` reads only the blocks that hold them."""

    def __init__(self, file, size: int):
        self.file = file
        file.seek(size - _FOOT.size)
        self.blocks, n, self.total, place = _FOOT.unpack(file.read(_FOOT.size))
        file.seek(place)
        table = file.read(size - _FOOT.size - place)
        self.starts = np.append(np.frombuffer(table, "<u8", self.blocks), place).astype(np.int64)
        at = 8 * self.blocks
        self.doc_ids = np.frombuffer(table, "<i8", n, at)
        self.known = np.frombuffer(table, np.uint8, n, at + 8 * n).astype(bool)
        self.counts = np.frombuffer(table, "<u4", n, at + 9 * n).astype(np.int64)
        self._span: tuple[int, int, np.ndarray] = (0, 0, np.zeros(0, "<u4"))

    def ids(self, first: int, n: int) -> np.ndarray:
        lo, hi = first // BLOCK, -(-(first + n) // BLOCK)
        if not (self._span[0] <= lo and hi <= self._span[1]):
            hi = max(hi, min(self.blocks, lo + 256))
            self.file.seek(int(self.starts[lo]))
            data = self.file.read(int(self.starts[hi] - self.starts[lo]))
            self._span = lo, hi, np.concatenate([unpack_block(data, int(s - self.starts[lo])) for s in self.starts[lo:hi]])
        off = first - self._span[0] * BLOCK
        return self._span[2][off : off + n]

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        at = 0
        for doc_id, known, n in zip(self.doc_ids.tolist(), self.known.tolist(), self.counts.tolist()):
            yield doc_id if known else None, self.ids(at, n)
            at += n


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", added: bool = False) -> DataFrame:
    """Write all documents in ascending id order (null ids first; equal ids by text); returns the manifest.

    Each partition of the id range makes one file. The manifest (part int, path, bytes, documents, ids, start) has a row per
    file; ``start`` is the number of ids in the files before it. A null text is empty; every document gets the end id.
    With ``added`` the tokenizer's added tokens get their own ids where a text holds them.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer_path, CACHED, added), np.array([END_ID], "<u4").tobytes()
        part, out = TaskContext.get().partitionId(), None
        for b in batches:
            for doc_id, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                if out is None:
                    out = NewFile(folder, f"part-{part:06d}", ".pfor")
                    writer = Writer(out)
                writer.add(doc_id, np.frombuffer(encode(text) + end, "<u4"))
        if out:
            writer.finish()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [out.path], "bytes": [out.size], "documents": [len(writer.counts)], "ids": [writer.total]})

    files = materialize(rows.mapInArrow(run, "part int, path string, bytes long, documents long, ids long"), "manifest")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per file, not per document
    return files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids binary) per document, one task per file; ids are little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "start", "n_tokens", "ids"]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names)
        for b in batches:
            for path, size, start in zip(*(b.column(c).to_pylist() for c in ("path", "bytes", "start"))):
                with open_input(path) as file:
                    rows, held = [], 0
                    for doc_id, ids in Reader(file, size).documents():
                        rows.append((doc_id, start, len(ids), ids.tobytes()))
                        start += len(ids)
                        held += ids.nbytes
                        if held > 8 << 20:
                            yield pack(rows)
                            rows, held = [], 0
                    if rows:
                        yield pack(rows)

    files = manifest.select("path", "bytes", "start")
    return files.repartition(max(1, manifest.count()), "path").mapInArrow(run, "id long, start long, n_tokens long, ids binary")
