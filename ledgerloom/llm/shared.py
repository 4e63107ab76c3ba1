"""Helpers of the operators: tables, shared folders, row-wise Python stages, word hashes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.session import ensure_checkpoint_dir

MAX_CACHED = 200_000
PIECE = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors all see."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, kind: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, a lost executor loses nothing."""
    path = shared_folder(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_fold(key: Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the key's text leaves this remainder (false for a null key)."""
    return F.coalesce(F.crc32(key.cast("string")) % modulus == remainder, F.lit(False))


def pieces_of(batch: pa.RecordBatch, size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``size`` bytes, a row at least."""
    start, taken = 0, 0
    share = batch.nbytes / max(batch.num_rows, 1)
    texts = [c.cast(pa.large_binary()) for c in batch.columns if pa.types.is_string(c.type)]
    lengths = sum((np.diff(np.frombuffer(c.buffers()[1], np.int64, len(c) + 1, 8 * c.offset)) for c in texts), np.full(batch.num_rows, 0 if texts else share))
    for at, n in enumerate(lengths.tolist()):
        if at > start and taken + n > size:
            yield batch.slice(start, at - start)
            start, taken = at, 0
        taken += n
    if batch.num_rows > start:
        yield batch.slice(start)


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch] | None]], schema: str, by_row: bool = False) -> DataFrame:
    """Apply a batch function, built once per task, to every Arrow batch of ``df``. It gives one batch or several.

    ``by_row`` says that its rows don't depend on each other: it then gets pieces of a batch, so that the Python copies of
    texts and what is made of them, and the batches that go back, stay small however many texts a batch holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for whole in batches:
            for batch in pieces_of(whole) if by_row else [whole] if whole.num_rows else []:
                out = fn(batch)
                for part in [out] if isinstance(out, pa.RecordBatch) else out or []:
                    if part.num_rows:
                        yield part
        pa.default_memory_pool().release_unused()  # workers are kept for the next task

    return df.mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the finalizer of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word -> 64-bit hash, computed once per distinct word; emptied when large."""

    def __missing__(self, word: bytes | str) -> int:
        if len(self) >= MAX_CACHED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 7)
        return value

    def of(self, words: list[bytes] | list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """One 64-bit hash per run of ``size`` words; fewer words make one run, none makes none."""
    size = min(size, len(words))
    if size == 0:
        return words
    n = len(words) - size + 1
    acc = words[:n].copy()
    for j in range(1, size):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
    return mix64(acc)


_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set in each row of ``hashes`` (rows x n), lowest bit first."""
    rows, n = hashes.shape
    total = np.zeros((rows * 8, 256), np.int64)
    slot = np.arange(rows)[:, None, None] * 2048 + np.arange(0, 2048, 256)
    step = max(1, (1 << 18) // rows)
    for at in range(0, n, step):
        part = np.ascontiguousarray(hashes[:, at : at + step], "<u8")
        octets = part.view(np.uint8).reshape(rows, -1, 8) + slot
        total += np.bincount(octets.ravel(), minlength=rows * 2048).reshape(rows * 8, 256)
    return (total @ _BITS).reshape(rows, 64)


def majority_words(hashes: np.ndarray) -> np.ndarray:
    """For each row of hashes the 64-bit word whose bits are those set in over half of them; 0 for empty rows."""
    bits = (bit_counts(hashes) * 2 > hashes.shape[1]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def majority_word(hashes: np.ndarray) -> int:
    return int(majority_words(hashes[None, :])[0])
