"""Benchmark decontamination by size-partitioned MinHash containment search.

Items fall into classes by their number of shingles (up to 8, 16, 32, ...). For each class that has items, a document is
cut into stretches of twice the class size, so that an item and the stretch that holds it are of like size. Both get a
one-permutation MinHash signature: the hash of a shingle names one of 4096 slots, and a slot keeps its least hash. An
item meets a document if one slot agrees; every meeting is then verified on the exact sets of shingles.

Items are taken in blocks of bounded size, in order of a key, so what is sent to the tasks has a proven bound however
many items there are; all documents are searched for every block.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.shared import WordHashes, arrow_map, shingle_hashes

SHINGLE = 5
LEAST = 0.8
SLOT_BITS = 12
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 64 << 20
_WORD = re.compile(r"[^\W_]+")


#: The exponent of the smallest class.
SMALLEST = 3


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return _WORD.findall((text or "").lower())


def size_class(n: int) -> int:
    """The exponent of the class: 8 shingles or fewer are class 3, 9 to 16 class 4, and so on."""
    return max(SMALLEST, (n - 1).bit_length())


def signature(hashes: np.ndarray, exponent: int | None) -> np.ndarray:
    """Keys of a MinHash signature: slot in the high bits, then the least hash of the slot's shingles. Stretches of
    2 ** (exponent + 1) shingles have signatures of their own (None: the whole is one); their keys are merged. In the
    smallest class every shingle is a key, so an item of one shingle is never hidden by a lesser hash in its slot."""
    if exponent == SMALLEST or exponent is None and len(hashes) <= 1 << SMALLEST:
        return np.unique(hashes)
    slot_and_hash = hashes
    n = len(hashes)
    if exponent is None or n <= 2 << exponent:
        ordered = np.sort(slot_and_hash)
        first = np.ones(len(ordered), bool)
        slots = ordered >> np.uint64(64 - SLOT_BITS)
        first[1:] = slots[1:] != slots[:-1]
        return ordered[first]
    rows = -(-n // (2 << exponent))
    grid = np.full(rows * (2 << exponent), np.uint64(2**64 - 1))
    grid[:n] = slot_and_hash
    grid = np.sort(grid.reshape(rows, -1), axis=1)
    slots = grid >> np.uint64(64 - SLOT_BITS)
    first = np.ones(grid.shape, bool)
    first[:, 1:] = slots[:, 1:] != slots[:, :-1]
    return grid[first]


class Index:
    """Signatures and shingle sets of one block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        hashes = WordHashes()
        self.ids, self.sets, keys, owners, classes = [], [], [], [], []
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            shingles = np.unique(shingle_hashes(hashes.of(words), SHINGLE))
            size = min(SHINGLE, len(words))
            grams = frozenset(" ".join(words[i : i + size]) for i in range(len(words) - size + 1))
            sig = signature(shingles, None)
            keys.append(sig)
            owners.append(np.full(len(sig), len(self.ids)))
            classes.append(np.full(len(sig), size_class(len(shingles))))
            self.ids.append(item)
            self.sets.append(grams)
        self.by_class = {}
        if self.ids:
            keys, owners, classes = map(np.concatenate, (keys, owners, classes))
            for c in np.unique(classes).tolist():
                own = classes == c
                order = np.argsort(keys[own], kind="stable")
                self.by_class[c] = keys[own][order], owners[own][order]

    def matches(self, words: list[str], hashes: WordHashes, least: float) -> list[tuple[int, float, int]]:
        """(item, containment, common shingles) of the items that these words contain."""
        if not words:
            return []
        shingles = shingle_hashes(hashes.of(words), SHINGLE)
        met: set[int] = set()
        for exponent, (keys, owners) in self.by_class.items():
            sig = signature(shingles, exponent)
            lo, hi = np.searchsorted(keys, sig, "left"), np.searchsorted(keys, sig, "right")
            for a, b in zip(lo[lo < hi].tolist(), hi[lo < hi].tolist()):
                met.update(owners[a:b].tolist())
        if not met:
            return []
        size = min(SHINGLE, len(words))
        own = {" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}
        found = []
        for at in sorted(met):
            common = len(self.sets[at] & own)
            if common >= least * len(self.sets[at]):
                found.append((self.ids[at], common / len(self.sets[at]), common))
        return found


def item_blocks(items: DataFrame, id_col: str, text_col: str, most: int = BLOCK_ITEMS, most_bytes: int = BLOCK_BYTES):
    """Distinct items as lists of at most ``most`` items and about ``most_bytes`` of text, in id order. Null ids are skipped."""
    rows = items.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).filter("id is not null").distinct()
    block, held = [], 0
    for r in rows.orderBy("id", "text").toLocalIterator():
        block.append((r.id, r.text))
        held += len(r.text)
        if len(block) >= most or held >= most_bytes:
            yield block
            block, held = [], 0
    if block:
        yield block


def contained_items(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = LEAST, block: int = BLOCK_ITEMS
) -> DataFrame:
    """(id, item_id, containment double, common int): documents holding at least ``least`` of an item's five-word shingles.

    An item or document of fewer than five words is one shingle, its whole sequence. Null and wordless texts match nothing;
    a null document id is kept, items without id are not searched for. Rows that repeat an id give repeated results, an
    item id with several texts is matched by each.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    schema = "id long, item_id long, containment double, common int"
    spark, found = docs.sparkSession, None
    for items_of in item_blocks(items, item_id, item_text, block):
        shared = spark.sparkContext.broadcast(items_of)

        def make(shared=shared):
            index, hashes = Index(shared.value), WordHashes()

            def batch(b: pa.RecordBatch) -> pa.RecordBatch:
                out = [(i, *m) for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist()) for m in index.matches(words_of(t), hashes, least)]
                types = (pa.int64(), pa.int64(), pa.float64(), pa.int32())
                columns = list(zip(*out)) if out else [[]] * 4
                return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], ["id", "item_id", "containment", "common"])

            return batch

        part = arrow_map(rows, make, schema, by_row=True)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], schema)
