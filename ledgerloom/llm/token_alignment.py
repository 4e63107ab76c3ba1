"""Alignment of two tokenizers' tokens over the same bytes, and corpus-wide counts of linked id pairs.

A text is encoded by a byte-level vocabulary A (as a blank and the text) and a piece vocabulary B (which adds the blank).
Where tokens of both end at one byte, the text is cut. Cuts are found by dividing: of a stretch of tokens the end nearest
the middle that the other side shares is located by bisection, and both halves go on; a stretch without a shared end is a
group. All stretches of a chunk of documents divide at the same time, a level a round.

Within a group every A token is linked to every B token. A pair of ids counts the documents that hold it linked. Documents
go in blocks that number their distinct pairs, so that pairs are counted, and their counts brought back, once per block
that holds them; documents keep only numbers.

A text is not aligned, and has neither tokens nor links, if it is null or empty or if the tokens of a side don't spell it
(vocabulary B writes a blank for U+2581). Repeated rows are documents of their own, null ids are kept. Only id and text are
read, so other columns can't clash. A text over ``STRETCH`` characters is aligned stretch by stretch between blanks, where
both sides cut, so memory follows the stretch (a stretch without any blank is as long as it is).
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm import tokens
from ledgerloom.llm.shared import materialize
from ledgerloom.llm.word_table import byte_piece

STRETCH, BLOCK_LINKS, WIDE, CACHED, CACHED_CHARS = 1 << 19, 2_000_000, 1 << 12, 300_000, 64
#: A blank and what follows it up to the next blank after a non-blank. No piece of B reaches over such a place.
_SEGMENT = re.compile(r" +[^ ]*")
#: Places where both vocabularies end a token: a blank after a sign that is no white space at all.
_CUT = re.compile(r"(?<=\S)(?= )")


class PieceIds(dict):
    """Segment -> ids of vocabulary B as 32-bit integers. Segments begin with their blanks; the first blank is the one
    that the vocabulary adds."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        names = [self.model.id_to_piece(k) for k in range(size)]
        if any("▁" in name.lstrip("▁") for name in names):
            raise ValueError("a piece holds a blank after a letter, so segments can't be encoded apart")
        self.pieces = [bytes([int(n[3:5], 16)]) if self.model.is_byte(k) else n.replace("▁", " ").encode() for k, n in enumerate(names)]
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)
        self.unlike: set[str] = set()  # segments that their pieces don't spell

    def __missing__(self, segment: str) -> bytes:
        ids = self.model.encode(segment[1:], num_threads=1) if segment != " " else self.blank()
        found = array("I", ids).tobytes()
        if b"".join(map(self.pieces.__getitem__, ids)) != segment.encode():
            self.unlike.add(segment)
        if len(segment) <= CACHED_CHARS:
            if len(self) >= CACHED:
                self.clear()
                self.unlike &= {segment}
            self[segment] = found
        return found

    def blank(self) -> list[int]:
        """Ids of a lone blank, which is what a text of no words but the added blank leaves."""
        return [self.model.piece_to_id("▁")]

    def of(self, stretch: str) -> tuple[bytes, bool]:
        """Ids of a stretch that begins with a blank, and whether they spell it."""
        parts = _SEGMENT.findall(stretch)
        found = [self[p] for p in parts]
        if self.unlike and not self.unlike.isdisjoint(parts):
            ids = np.frombuffer(b"".join(found), "<u4").tolist()
            return b"".join(found), b"".join(map(self.pieces.__getitem__, ids)) == stretch.encode()
        return b"".join(found), True


class Tokens:
    """Both vocabularies of a worker."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b = tokens.encoder(path_a), PieceIds(path_b)
        vocabulary = self.a.tokenizer.get_vocab(with_added_tokens=True)
        size_a, size_b = max(vocabulary.values()) + 1, len(self.b.pieces)
        self.lengths_a = np.zeros(size_a, np.int64)
        for sign, k in vocabulary.items():
            self.lengths_a[k] = len(byte_piece(sign))
        if size_a * size_b >= 1 << 31:
            raise ValueError("vocabularies too large for pairs of 31 bits")
        numbers = [b"%d" % k for k in range(max(size_a, size_b))]
        # what a token writes: its id and a comma within its side, else the sign that ends its side
        self.written = [n + s for side, ends in ((numbers[:size_a], b",|"), (numbers[:size_b], b",;")) for s in (ends[:1], ends[1:]) for n in side]
        self.size_a, self.size_b = size_a, size_b


_TOKENS: dict[tuple[str, str], Tokens] = {}


def both(path_a: str, path_b: str) -> Tokens:
    if (path_a, path_b) not in _TOKENS:
        _TOKENS[path_a, path_b] = Tokens(path_a, path_b)
    return _TOKENS[path_a, path_b]


def shared_ends(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the ascending arrays ``a`` and ``b`` (byte ends of tokens) of all ends they share, by dividing.

    ``last_a`` and ``last_b`` are the positions of the documents' last tokens, whose ends are equal. A stretch is the
    tokens between two shared ends: the positions lo..hi - 1 are its inner ends.
    """
    lo_a, lo_b = np.append(0, last_a[:-1] + 1), np.append(0, last_b[:-1] + 1)
    hi_a, hi_b = last_a, last_b
    found_a, found_b = [last_a], [last_b]
    while True:
        open_ = (lo_a < hi_a) & (lo_b < hi_b)
        lo_a, hi_a, lo_b, hi_b = lo_a[open_], hi_a[open_], lo_b[open_], hi_b[open_]
        if not len(lo_a):
            break
        cut_a, cut_b = _nearest_shared(a, b, lo_a, hi_a, lo_b, hi_b)
        cut = cut_a >= 0
        lo_a, hi_a, lo_b, hi_b, cut_a, cut_b = lo_a[cut], hi_a[cut], lo_b[cut], hi_b[cut], cut_a[cut], cut_b[cut]
        found_a.append(cut_a)
        found_b.append(cut_b)
        lo_a, hi_a = np.concatenate([lo_a, cut_a + 1]), np.concatenate([cut_a, hi_a])
        lo_b, hi_b = np.concatenate([lo_b, cut_b + 1]), np.concatenate([cut_b, hi_b])
    return np.sort(np.concatenate(found_a)), np.sort(np.concatenate(found_b))


def _nearest_shared(a, b, lo_a, hi_a, lo_b, hi_b) -> tuple[np.ndarray, np.ndarray]:
    """Of each stretch the shared end nearest its middle (position in a, in b); -1 where there is none."""
    cut_a, cut_b = np.full(len(lo_a), -1), np.full(len(lo_a), -1)
    left = np.arange(len(lo_a))
    middle = (lo_a + hi_a) >> 1
    for step in (0, 1, -1, 2, -2):
        at = middle[left] + step
        inside = (at >= lo_a[left]) & (at < hi_a[left])
        at = np.where(inside, at, lo_a[left])
        place = np.searchsorted(b, a[at])
        hit = inside & (b[place] == a[at]) & (place < hi_b[left])
        cut_a[left[hit]], cut_b[left[hit]] = at[hit], place[hit]
        left = left[~hit]
        if not len(left):
            return cut_a, cut_b
    # the rest look at all their ends at once
    left = left[hi_a[left] - lo_a[left] > 1]
    sizes = hi_a[left] - lo_a[left]
    owner = np.repeat(left, sizes)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(lo_a[left], sizes)
    place = np.searchsorted(b, a[at])
    hit = (b[place] == a[at]) & (place < hi_b[owner])
    owner, at, place = owner[hit], at[hit], place[hit]
    order = np.lexsort((np.abs(at - middle[owner]), owner))
    owner, at, place = owner[order], at[order], place[order]
    first = np.append(True, owner[1:] != owner[:-1]) if len(owner) else np.zeros(0, bool)
    cut_a[owner[first]], cut_b[owner[first]] = at[first], place[first]
    return cut_a, cut_b


def _links(a, b, lo_a, end_a, lo_b, end_b, group_a, owner, size_b):
    """Owner, pair and number of links of every pair of tokens in a group (once per distinct pair in wide groups)."""
    n_a, n_b = end_a - lo_a, end_b - lo_b
    wide = n_a * n_b > WIDE
    times = np.where(wide, 0, n_b)[group_a]
    left = np.repeat(np.arange(len(a)), times)
    group = group_a[left]
    right = lo_b[group] + np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
    parts = [(owner[group], a[left] * size_b + b[right], np.ones(len(left), np.int64))]
    for g in np.flatnonzero(wide).tolist():
        ids_a, count_a = np.unique(a[lo_a[g] : end_a[g]], return_counts=True)
        ids_b, count_b = np.unique(b[lo_b[g] : end_b[g]], return_counts=True)
        pairs = (ids_a[:, None] * size_b + ids_b).ravel()
        parts.append((np.full(len(pairs), owner[g]), pairs, (count_a[:, None] * count_b).ravel()))
    return tuple(np.concatenate(x) for x in zip(*parts))


class Aligned:
    """Alignment of some stretches at once. Per stretch: n_a, n_b, n_groups, n_links, written; and the distinct pairs of
    all stretches with their links, ordered by stretch."""

    def __init__(self, vocabularies: Tokens, stretches: list[tuple[bytes, bytes]]):
        v, n = vocabularies, len(stretches)
        a = np.frombuffer(b"".join(s[0] for s in stretches), "<u4").astype(np.int64)
        b = np.frombuffer(b"".join(s[1] for s in stretches), "<u4").astype(np.int64)
        self.n_a = np.array([len(s[0]) // 4 for s in stretches], np.int64)
        self.n_b = np.array([len(s[1]) // 4 for s in stretches], np.int64)
        last_a, last_b = np.cumsum(self.n_a) - 1, np.cumsum(self.n_b) - 1
        cut_a, cut_b = shared_ends(np.cumsum(v.lengths_a[a]), np.cumsum(v.b.lengths[b]), last_a, last_b)
        end_a, end_b = cut_a + 1, cut_b + 1
        lo_a, lo_b = np.append(0, end_a[:-1]), np.append(0, end_b[:-1])
        owner = np.searchsorted(last_a, cut_a)
        self.n_groups = np.bincount(owner, minlength=n)
        self.n_links = np.bincount(owner, (end_a - lo_a) * (end_b - lo_b), n).astype(np.int64)
        group_a = np.repeat(np.arange(len(cut_a)), end_a - lo_a)
        group_b = np.repeat(np.arange(len(cut_b)), end_b - lo_b)
        self.written = self._written(v, a, b, lo_b, end_a, cut_a, cut_b, group_a, group_b, last_b)
        place, pair, links = _links(a, b, lo_a, end_a, lo_b, end_b, group_a, owner, v.size_b)
        key, where = np.unique((place << 31) | pair, return_inverse=True)
        self.place, self.pair = key >> 31, key & ((1 << 31) - 1)
        self.links = np.bincount(where, links, len(key)).astype(np.int64)

    def _written(self, v, a, b, lo_b, end_a, cut_a, cut_b, group_a, group_b, last_b) -> list[bytes]:
        """Groups of each stretch as ids, without the last sign."""
        signs = np.empty(len(a) + len(b), np.int64)
        ends_a, ends_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        ends_a[cut_a], ends_b[cut_b] = True, True
        signs[np.arange(len(a)) + lo_b[group_a]] = a + v.size_a * ends_a
        signs[np.arange(len(b)) + end_a[group_b]] = b + v.size_b * ends_b + 2 * v.size_a
        names, out, at = v.written, [], 0
        for size in (self.n_a + self.n_b).tolist():
            out.append(b"".join(map(names.__getitem__, signs[at : at + size].tolist()))[:-1])
            at += size
        return out


def _stretches(text: str, most: int) -> Iterator[str]:
    """A text as stretches of about ``most`` characters, each but the first beginning where both vocabularies cut."""
    at = 0
    while len(text) - at > most:
        if (cut := _CUT.search(text, at + most)) is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


class _Block:
    """Documents of one block: counts, digests, and pairs by their number in the block."""

    def __init__(self):
        self.ids, self.rows, self.pairs, self.links, self.sizes, self.held = [], [], [], [], [], 0

    def add(self, key, counts: tuple, digest: str, pairs: np.ndarray, links: np.ndarray) -> None:
        self.ids.append(key)
        self.rows.append((*counts, digest))
        self.pairs.append(pairs)
        self.links.append(links)
        self.sizes.append(len(pairs))
        self.held += len(pairs) + 64

    def batch(self, id_type: pa.DataType) -> pa.RecordBatch:
        pairs, number = np.unique(np.concatenate(self.pairs), return_inverse=True)
        docs = np.bincount(number, minlength=len(pairs))
        links = np.concatenate(self.links)
        narrow = lambda x: np.ascontiguousarray(x.astype(next(t for t in ("<u1", "<u2", "<u4", "<u8") if x.max(initial=0) <= np.iinfo(t).max)))
        number, links = narrow(number), narrow(links)
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        n_a, n_b, n_groups, n_links, digest = zip(*self.rows)
        return pa.record_batch(
            {
                "ids": one(self.ids, id_type), "n_a": one(n_a, pa.int64()), "n_b": one(n_b, pa.int64()), "n_groups": one(n_groups, pa.int64()),
                "n_links": one(n_links, pa.int64()), "groups_sha256": one(digest, pa.string()), "n_pairs": one(self.sizes, pa.int64()),
                "number": pa.array([number.tobytes()], pa.binary()), "links": pa.array([links.tobytes()], pa.binary()),
                "number_width": pa.array([number.itemsize], pa.int32()), "links_width": pa.array([links.itemsize], pa.int32()),
                "pairs": one(pairs, pa.int64()), "pair_docs": one(docs, pa.int64()),
            }
        )


def aligned_blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", stretch: int = STRETCH, block_links: int = BLOCK_LINKS) -> DataFrame:
    """Documents aligned, a row per block of them, with the block's distinct pairs and how many of its documents hold each."""
    kind = docs.select(F.col(id_col)).dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, block, waiting, chars = both(path_a, path_b), _Block(), [], 0
        none = np.zeros(0, np.int64)

        def align() -> None:
            found = Aligned(v, [x[1:] for x in waiting]) if waiting else None
            ends = np.searchsorted(found.place, np.arange(len(waiting) + 1)) if waiting else []
            for k, (key, *_) in enumerate(waiting):
                counts = tuple(int(x[k]) for x in (found.n_a, found.n_b, found.n_groups, found.n_links))
                own = slice(ends[k], ends[k + 1])
                block.add(key, counts, hashlib.sha256(found.written[k]).hexdigest(), found.pair[own], found.links[own])

        def align_long(key, text: str) -> None:
            counts, digest, pairs, links = np.zeros(4, np.int64), hashlib.sha256(), none, none
            for k, part in enumerate(_stretches(text, stretch)):
                b, same = v.b.of(part)
                if not same:
                    block.add(key, (0, 0, 0, 0), "", none, none)
                    return
                found = Aligned(v, [(v.a(part), b)])
                counts += [found.n_a[0], found.n_b[0], found.n_groups[0], found.n_links[0]]
                digest.update((b";" if k else b"") + found.written[0])
                pairs, where = np.unique(np.concatenate([pairs, found.pair]), return_inverse=True)
                links = np.bincount(where, np.concatenate([links, found.links]), len(pairs)).astype(np.int64)
            block.add(key, tuple(counts.tolist()), digest.hexdigest(), pairs, links)

        for batch in batches:
            id_type = batch.schema.field("id").type
            for key, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist()):
                if text and len(text) > stretch:
                    align_long(key, " " + text)
                elif text:
                    b, same = v.b.of(" " + text)
                    if same:
                        waiting.append((key, v.a(" " + text), b))
                        chars += len(text)
                    else:
                        block.add(key, (0, 0, 0, 0), "", none, none)
                else:
                    block.add(key, (0, 0, 0, 0), "", none, none)
                if chars >= stretch:
                    align()
                    waiting, chars = [], 0
                if block.held >= block_links:
                    yield block.batch(id_type)
                    block = _Block()
        align()
        if block.ids:
            yield block.batch(id_type)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = (
        f"ids array<{kind}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, n_pairs array<long>, "
        "number binary, links binary, number_width int, links_width int, pairs array<long>, pair_docs array<long>"
    )
    return rows.mapInArrow(run, schema)


def pair_counts(blocks: DataFrame, size_b: int) -> DataFrame:
    """pair, docs (documents that hold it linked), best (no other pair of its A id is held by more)."""
    pairs = blocks.select(F.explode(F.arrays_zip("pairs", "pair_docs")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.pair_docs").alias("docs"))
    pairs = materialize(pairs, "pairs")
    id_a = F.floor(F.col("pair") / size_b)
    most = pairs.groupBy(id_a.alias("id_a")).agg(F.max("docs").alias("most"))
    return pairs.withColumn("id_a", id_a).join(most, "id_a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", stretch: int = STRETCH, block_links: int = BLOCK_LINKS) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 per row of ``docs``."""
    blocks = aligned_blocks(docs, path_a, path_b, id_col, text_col, stretch, block_links)
    blocks = materialize(blocks.withColumn("block", F.expr("uuid()")), "aligned")
    size_b = len(both(path_a, path_b).b.pieces)
    counts = pair_counts(blocks, size_b)
    numbered = blocks.select("block", F.posexplode("pairs").alias("k", "pair"))
    answers = numbered.join(counts, "pair").groupBy("block").agg(F.collect_list(F.struct("k", "docs", "best")).alias("answers"))
    kept = [c for c in blocks.columns if c not in ("pairs", "pair_docs")]
    kind = blocks.select(F.explode("ids")).dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield _answered({name: batch[name].slice(i, 1) for name in batch.schema.names})

    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return blocks.select(kept).join(answers, "block", "left").mapInArrow(run, schema)


def _answered(row: dict[str, pa.Array]) -> pa.RecordBatch:
    """Sums of a block's documents over their pairs' counts."""
    sizes = row["n_pairs"].flatten().to_numpy()
    number = np.frombuffer(row["number"][0].as_py(), f"<u{row['number_width'][0].as_py()}").astype(np.int64)
    links = np.frombuffer(row["links"][0].as_py(), f"<u{row['links_width'][0].as_py()}").astype(np.int64)
    docs, best = np.zeros(number.max(initial=-1) + 1, np.int64), np.zeros(number.max(initial=-1) + 1, np.int64)
    answers = row["answers"].flatten()
    if len(answers):
        k, n, b = (answers.field(j).to_numpy(zero_copy_only=False) for j in range(3))
        docs[k], best[k] = n, b
    ends = np.cumsum(sizes)
    totals = [np.append(0, np.cumsum(value)) for value in (best[number] * links, docs[number] * links)]
    sums = [total[ends] - total[ends - sizes] for total in totals]
    same = {name: row[name].flatten() for name in ("n_a", "n_b", "n_groups", "n_links")}
    return pa.record_batch({"id": row["ids"].flatten(), **same, "n_best": sums[0], "count_sum": sums[1], "groups_sha256": row["groups_sha256"].flatten()})
