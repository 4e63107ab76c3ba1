"""Removal of repeated byte strings by longest-previous-factor arrays over a partitioned suffix space.

A string of ``length`` bytes is repeated if it starts at another place of the corpus too. The suffixes are split by
content: within every window of ``length`` bytes the leftmost least hash of its 64-byte grams is the window's anchor, so
equal windows have equal anchors, and an anchor that occurs once has no repeated window. Neighbouring windows of one
anchor form a run. Runs whose whole context (from their first window to the end of their last) is equal are one class.

An anchor with one class of several runs needs no more work: all its windows repeat. Where an anchor has several
classes, their contexts, one per class, form a bucket: its suffixes are sorted, previous and next smaller positions in
suffix order give the longest previous factor of each, and those that reach ``length`` have an earlier match; the
greater of the two neighbouring common prefixes tells of a match anywhere. Buckets of over ``most`` classes are not
gathered; there the windows themselves are grouped by a 128-bit digest, which spreads over the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.shared import arrow_map, materialize, mix64

LENGTH = 400
GRAM = 64
CHUNK = 1 << 19
MOST = 512  # classes of a bucket that is gathered
AT_ONCE = 20_000  # windows sorted together, or digested between two output batches
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS[size] = tuple(np.concatenate((np.ones(1, np.uint64), np.multiply.accumulate(np.full(size - 1, f)))) for f in (_FACTOR, _INVERSE))
    return _POWERS[size]


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every run of ``gram`` bytes, by a rolling polynomial."""
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    n = len(raw) - gram + 1
    return mix64((sums[gram:] - sums[:n]) * down[:n])


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values, the place of its leftmost least one."""
    n = len(values) - width + 1
    rows = -(-len(values) // width)
    grid = np.full(rows * width, np.uint64(2**64 - 1))
    grid[: len(values)] = values
    grid = grid.reshape(rows, width)
    place = np.arange(width)

    def best(part: np.ndarray, take_equal: bool) -> tuple[np.ndarray, np.ndarray]:
        low = np.minimum.accumulate(part, axis=1)
        new = np.ones(part.shape, bool)
        new[:, 1:] = part[:, 1:] <= low[:, :-1] if take_equal else part[:, 1:] < low[:, :-1]
        return low.ravel(), np.maximum.accumulate(np.where(new, place, 0), axis=1).ravel()

    base = np.repeat(np.arange(0, rows * width, width), width)
    head, head_at = best(grid, False)
    tail, tail_at = best(grid[:, ::-1], True)
    tail = tail.reshape(rows, width)[:, ::-1].ravel()
    tail_at = base + (width - 1 - tail_at.reshape(rows, width)[:, ::-1].ravel())
    head_at = base + head_at
    ends = slice(width - 1, width - 1 + n)
    return np.where(tail[:n] <= head[ends], tail_at[:n], head_at[ends])


def anchor_runs(raw: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, last window) of all runs of windows of a text."""
    hashes, firsts, lasts = [], [], []
    windows = len(raw) - length + 1
    for at in range(0, max(windows, 0), CHUNK):
        part = raw[at : min(at + CHUNK, windows) + length - 1]
        values = gram_hashes(part, gram)
        places = window_minima(values, length - gram + 1)
        cut = np.flatnonzero(places[1:] != places[:-1]) + 1
        start = np.concatenate(([0], cut))
        hashes.append(values[places[start]])
        firsts.append(start + at)
        lasts.append(np.concatenate((cut, [len(places)])) - 1 + at)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(firsts), np.concatenate(lasts)


def previous_factors(common: np.ndarray, position: np.ndarray, least: int) -> np.ndarray:
    """Longest previous factors, given in suffix order the text position of each suffix and ``common``, the length of the
    common prefix with the suffix before. Only lengths from ``least`` on are told; others are 0.

    The previous (next) smaller position in suffix order is found by following skips until an earlier text position
    comes up; the common prefix with it is the least one passed, and a skip ends when that falls under ``least``.
    """

    def one_way(common: np.ndarray, position: np.ndarray) -> np.ndarray:
        n = len(position)
        skip, reach = np.arange(n) - 1, common.copy()
        reach[:1] = 0
        open_ = np.flatnonzero((reach >= least) & (position[np.maximum(skip, 0)] > position))
        while len(open_):
            to = skip[open_]
            reach[open_] = np.minimum(reach[open_], reach[to])
            skip[open_] = skip[to]
            going = (reach[open_] >= least) & (skip[open_] >= 0)
            reach[open_[~going]] = 0
            open_ = open_[going]
            open_ = open_[position[skip[open_]] > position[open_]]
        return np.where(reach >= least, reach, 0)

    back = one_way(common, position)
    ahead = one_way(np.concatenate(([0], common[:0:-1])), position[::-1])[::-1]
    return np.maximum(back, ahead)


def bucket_matches(contexts: list[bytes], buckets: np.ndarray, order: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, window, has earlier match) of every window of the contexts that also is in its bucket elsewhere.

    ``order`` are the text positions of the contexts' first windows as ranks that leave room for their lengths.
    """
    windows = np.array([len(c) - length + 1 for c in contexts])
    owner = np.repeat(np.arange(len(contexts)), windows)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    text = np.frombuffer(b"".join(contexts), np.uint8)
    begin = np.cumsum([0] + [len(c) for c in contexts[:-1]])
    keyed = np.empty((len(owner), 4 + length), np.uint8)
    keyed[:, :4] = buckets[owner].astype(">u4").view(np.uint8).reshape(-1, 4)
    keyed[:, 4:] = np.lib.stride_tricks.sliding_window_view(text, length)[begin[owner] + within]
    suffix = np.argsort(keyed.view(f"S{4 + length}").ravel(), kind="stable")
    keyed = keyed[suffix]
    differs = keyed[1:] != keyed[:-1]
    common = np.zeros(len(owner), np.int64)
    some = differs.any(1)
    common[1:] = np.where(some, np.maximum(differs.argmax(1) - 4, 0), length)
    common[1:][differs[:, :4].any(1)] = 0
    place = (order[owner] + within)[suffix]
    earlier = previous_factors(common, np.argsort(np.argsort(place, kind="stable"), kind="stable"), length) >= length
    anywhere = (common >= length) | (np.append(common[1:], 0) >= length)
    return owner[suffix][anywhere], within[suffix][anywhere], earlier[anywhere]


def _intervals(marks: np.ndarray) -> list[dict]:
    """Ascending numbers as closed intervals."""
    if not len(marks):
        return []
    cut = np.flatnonzero(np.diff(marks) > 1)
    return [{"a": int(a), "b": int(b)} for a, b in zip(marks[np.concatenate(([0], cut + 1))], marks[np.concatenate((cut, [len(marks) - 1]))])]


_SPANS = "array<struct<a:int,b:int>>"
_ARROW_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
_CLASS = ["h", "d1", "d2"]


def _runs(texts: DataFrame, length: int, gram: int) -> DataFrame:
    def make():
        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            out = [[] for _ in range(3)]
            digests, owners = [], []
            for at, body in enumerate(b.column("body").to_pylist()):
                found = anchor_runs(np.frombuffer(body, np.uint8), length, gram)
                for column, part in zip(out, found):
                    column.append(part)
                owners.append(np.full(len(found[0]), at))
                digests += [xxhash.xxh3_128_digest(body[s : e + length]) for s, e in zip(found[1].tolist(), found[2].tolist())]
            h, s, e = map(np.concatenate, out)
            d = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            owners = pa.array(np.concatenate(owners))
            arrays = [b.column("id").take(owners), b.column("key").take(owners), pa.array(h.view(np.int64)), pa.array(np.ascontiguousarray(d[:, 0])), pa.array(np.ascontiguousarray(d[:, 1])), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))]
            return pa.RecordBatch.from_arrays(arrays, ["id", "key", "h", "d1", "d2", "s", "e"])

        return batch

    return arrow_map(texts, make, "id long, key long, h long, d1 long, d2 long, s int, e int")


def _contexts(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The context of the first run of each wanted class."""
    lists = wanted.groupBy("id", "key").agg(F.collect_list(F.struct(*_CLASS, "s", "e", "crowded")).alias("items"))
    joined = texts.join(lists.withColumnRenamed("id", "id2"), (F.col("id").eqNullSafe(F.col("id2"))) & (texts.key == lists.key)).select("id", texts.key.alias("key"), "body", "items")

    def make():
        def told(rows: list[tuple]) -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], ["h", "d1", "d2", "id", "key", "s", "crowded", "context"])

        def batch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            rows = []
            for doc, key, body, items in zip(*(b.column(c) for c in ("id", "key", "body", "items"))):
                doc, key, body = doc.as_py(), key.as_py(), body.as_py()
                for i in items.as_py():
                    rows.append((i["h"], i["d1"], i["d2"], doc, key, i["s"], i["crowded"], body[i["s"] : i["e"] + length]))
                    if len(rows) >= AT_ONCE // 2:
                        yield told(rows)
                        rows = []
            if rows:
                yield told(rows)

        return batch

    return arrow_map(joined, make, "h long, d1 long, d2 long, id long, key long, s int, crowded boolean, context binary")


def _sorted_buckets(contexts: DataFrame, length: int) -> DataFrame:
    """(class, anywhere, earlier): the repeated windows of each class, of buckets that fit in a task."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        names = {h: i for i, h in enumerate(sorted({r[0] for r in rows}))}
        rows.sort(key=lambda r: (r[3] is not None, r[3] or 0, r[4], r[5]))
        sizes = np.array([len(r[6]) for r in rows])
        order = np.zeros(len(rows), np.int64)
        for i in range(1, len(rows)):  # windows of overlapping runs of a text keep their order, texts stay apart
            same = rows[i][3:5] == rows[i - 1][3:5]
            order[i] = order[i - 1] + (rows[i][5] - rows[i - 1][5] if same else sizes[i - 1])
        owner, within, earlier = bucket_matches([r[6] for r in rows], np.array([names[r[0]] for r in rows]), order, length)
        by = np.lexsort((within, owner))
        owner, within, earlier = owner[by], within[by], earlier[by]
        ends = np.searchsorted(owner, np.arange(len(rows) + 1))
        anywhere = [_intervals(within[a:b]) for a, b in zip(ends, ends[1:])]
        before = [_intervals(within[a:b][earlier[a:b]]) for a, b in zip(ends, ends[1:])]
        return pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], pa.int64()) for k in range(3)), pa.array(anywhere, _ARROW_SPANS), pa.array(before, _ARROW_SPANS)], [*_CLASS, "anywhere", "earlier"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, windows = [], 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in (*_CLASS, "id", "key", "s")), b.column("context")):
                row = (*row[:6], row[6].as_py())
                if windows > AT_ONCE and row[0] != held[-1][0]:
                    yield solve(held)
                    held, windows = [], 0
                held.append(row)
                windows += len(row[6]) - length + 1
        if held:
            yield solve(held)

    rows = contexts.filter("not crowded").drop("crowded").repartition("h").sortWithinPartitions("h")
    return rows.mapInArrow(run, f"h long, d1 long, d2 long, anywhere {_SPANS}, earlier {_SPANS}")


def _digested_buckets(contexts: DataFrame, length: int) -> DataFrame:
    """The same for buckets that don't: windows are grouped by their digest."""

    def make():
        def told(b: pa.RecordBatch, owners: list, within: list, digests: list) -> pa.RecordBatch:
            w = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            owner, place = pa.array(np.concatenate(owners)), pa.array(np.concatenate(within))
            kept = [b.column(c).take(owner) for c in (*_CLASS, "id", "key", "s")]
            return pa.RecordBatch.from_arrays([*kept, place, pa.array(np.ascontiguousarray(w[:, 0])), pa.array(np.ascontiguousarray(w[:, 1]))], [*_CLASS, "id", "key", "s", "w", "w1", "w2"])

        def batch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            owners, within, digests = [], [], []
            for at, c in enumerate(b.column("context")):
                c = c.as_py()
                n = len(c) - length + 1
                owners.append(np.full(n, at))
                within.append(np.arange(n, dtype=np.int32))
                digests += [xxhash.xxh3_128_digest(c[i : i + length]) for i in range(n)]
                if len(digests) > AT_ONCE:
                    yield told(b, owners, within, digests)
                    owners, within, digests = [], [], []
            if owners:
                yield told(b, owners, within, digests)

        return batch

    windows = arrow_map(contexts.filter("crowded").drop("crowded"), make, "h long, d1 long, d2 long, id long, key long, s int, w int, w1 long, w2 long")
    place = F.struct("id", "key", (F.col("s") + F.col("w")).alias("at"))
    windows = windows.withColumn("place", place)
    counted = materialize(windows.groupBy("w1", "w2").agg(F.count("*").alias("n"), F.min("place").alias("least")).filter("n > 1"), "windows")
    found = windows.join(counted, ["w1", "w2"]).groupBy(*_CLASS)
    lists = found.agg(F.sort_array(F.collect_list("w")).alias("anywhere"), F.sort_array(F.collect_list(F.when(F.col("place") > F.col("least"), F.col("w")))).alias("earlier"))
    single = lambda c: F.transform(c, lambda w: F.struct(w.alias("a"), w.alias("b")))
    return lists.select(*_CLASS, single("anywhere").alias("anywhere"), single("earlier").alias("earlier"))


def repeated_windows(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST, keep_first: bool = False) -> DataFrame:
    """(id, key, a, b): closed intervals of places in ``texts`` (id, key, body) where a repeated string starts.

    With ``keep_first`` the first occurrence, in order of id, key and place, is left out.
    """
    runs = materialize(_runs(texts.filter(F.octet_length("body") >= length), length, gram), "runs")
    repeated = materialize(runs.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "anchors")
    hits = materialize(runs.join(repeated, "h"), "hits")
    classes = hits.groupBy(*_CLASS).agg(F.count("*").alias("n"), F.min(F.struct("id", "key", "s", "e")).alias("first"))
    classes = materialize(classes, "classes")
    kinds = classes.groupBy("h").agg(F.count("*").alias("k")).filter("k > 1")
    mixed = materialize(classes.join(kinds, "h").select(*_CLASS, "first.*", (F.col("k") > most).alias("crowded")), "mixed")
    contexts = materialize(_contexts(texts, mixed, length), "contexts")
    solved = _sorted_buckets(contexts, length).unionByName(_digested_buckets(contexts, length))
    known = materialize(classes.join(solved, _CLASS, "left"), "solved")

    whole = F.array(F.struct(F.lit(0).alias("a"), (F.col("e") - F.col("s")).alias("b")))
    joined = hits.join(known, _CLASS)
    if keep_first:
        is_first = F.struct("id", "key", "s", "e").eqNullSafe(F.col("first"))
        spans = F.when(~is_first, whole).otherwise(F.col("earlier"))
    else:
        spans = F.when(F.col("n") > 1, whole).otherwise(F.col("anywhere"))
    return joined.select("id", "key", "s", F.explode(spans).alias("x")).select("id", "key", (F.col("s") + F.col("x.a")).alias("a"), (F.col("s") + F.col("x.b")).alias("b"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep_first: bool = False, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """(id, n_bytes long, spans array of (start, end), kept binary) per document; ``spans`` are the removed byte runs.

    Removed is each byte of a ``length``-byte string that also starts at another place; with ``keep_first`` only copies after
    the first are removed. Texts are UTF-8 bytes, null is empty; equal rows are copies of each other; a null id is kept.
    """
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), body.alias("body"))
    texts = texts.withColumn("key", F.xxhash64("body")).withColumn("n_bytes", F.octet_length("body").cast("long"))
    found = repeated_windows(texts.select("id", "key", "body"), length, gram, most, keep_first)
    lists = materialize(found.groupBy("id", "key").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("starts")), "starts")
    lists = lists.select(F.col("id").alias("id2"), F.col("key").alias("key2"), "starts")
    joined = texts.join(lists, F.col("id").eqNullSafe(F.col("id2")) & (F.col("key") == F.col("key2")), "left")

    def make():
        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            spans, kept = [], []
            for body, starts in zip(b.column("body").to_pylist(), b.column("starts").to_pylist()):
                runs: list[list[int]] = []
                for x in starts or []:
                    if runs and x["a"] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], x["b"] + length)
                    else:
                        runs.append([x["a"], x["b"] + length])
                parts, end = [], 0
                for a, z in runs:
                    parts.append(body[end:a])
                    end = z
                kept.append(b"".join(parts) + body[end:])
                spans.append([{"start": a, "end": z} for a, z in runs])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            return pa.RecordBatch.from_arrays([b.column("id"), b.column("n_bytes"), pa.array(spans, kind), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])

        return batch

    return arrow_map(joined.select("id", "n_bytes", "body", "starts"), make, "id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")
