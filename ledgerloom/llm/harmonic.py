"""Harmonic packing of token sequences, independently in every task.

A capacity of C is shared out by classes: class k holds pieces longer than C/(k+1) and at most C/k, and a sequence of
the class takes k of them. Pieces that would leave over ``slack`` of a sequence empty are cut to the class below first,
and the rest of the cut is classed again. What is left in unfilled sequences of a task is laid end to end, cut at C, and
its last stretch is cut into powers of two, so that only class slack is ever padded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.tokens import END_ID, MAX_CACHED, encoder

CAPACITY = 2048
SLACK = 0.02
SCHEMA = "id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def cuts(n: int, capacity: int = CAPACITY, slack: float = SLACK) -> list[int]:
    """Piece lengths for n tokens: whole capacities first, then class by class."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if capacity - k * rest <= slack * capacity:
            out.append(rest)
            break
        piece = max(1, capacity // (k + 1))
        out.append(min(piece, rest))
        rest -= out[-1]
    return out


class Packer:
    """Open sequences, one per class. A piece is (id, start, ids as bytes, tokens of its document)."""

    def __init__(self, first: int, capacity: int = CAPACITY, slack: float = SLACK):
        self.capacity, self.slack, self.next = capacity, slack, first
        self.open: dict[int, list[tuple]] = {}

    def _close(self, pieces: list[tuple]) -> list[tuple]:
        rows, offset = [], 0
        for doc, start, ids, total in pieces:
            rows.append((doc, start, len(ids) // 4, total, self.next, offset, ids))
            offset += len(ids) // 4
        self.next += 1
        return rows

    def add(self, doc: int | None, ids: bytes) -> list[tuple]:
        rows, at, total = [], 0, len(ids) // 4
        for n in cuts(total, self.capacity, self.slack):
            k = self.capacity // n
            bin_ = self.open.setdefault(k, [])
            bin_.append((doc, at, ids[4 * at : 4 * (at + n)], total))
            at += n
            if len(bin_) == k:
                rows += self._close(self.open.pop(k))
        return rows

    def finish(self) -> list[tuple]:
        rows, held, room = [], [], self.capacity
        pieces = [p for k in sorted(self.open) for p in self.open[k]]
        left = sum(len(p[2]) // 4 for p in pieces)
        self.open = {}
        sizes = [self.capacity] * (left // self.capacity) + [1 << b for b in reversed(range(self.capacity.bit_length())) if left % self.capacity >> b & 1]
        sizes.reverse()
        room = sizes.pop() if sizes else 0
        for doc, start, ids, total in pieces:
            while ids:
                part = ids[: 4 * room]
                held.append((doc, start, part, total))
                start, ids, room = start + len(part) // 4, ids[len(part) :], room - len(part) // 4
                if room == 0:
                    rows += self._close(held)
                    held, room = [], sizes.pop() if sizes else 0
        return rows


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, slack: float = SLACK, cached: int = MAX_CACHED, added: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and place (columns of SCHEMA), without a shuffle.

    Every task numbers its own sequences (partition number in the high bits). A null text is empty and is its end id
    alone; rows that repeat an id are packed as often as they come; a null id is kept. ids are little-endian u32.
    With ``added`` the tokenizer's added tokens get their own ids where a text holds them.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        batch = lambda out: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)
        encode, end = encoder(tokenizer_path, cached, added), np.array([END_ID], "<u4").tobytes()
        packer = Packer(TaskContext.get().partitionId() << 36, capacity, slack)
        out, held = [], 0
        for b in batches:
            for doc, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                found = packer.add(doc, encode(text) + end)
                out += found
                held += sum(len(r[-1]) + 64 for r in found)
                if held > 8 << 20:
                    yield batch(out)
                    out, held = [], 0
        if out := out + packer.finish():
            yield batch(out)

    return rows.mapInArrow(run, SCHEMA)
