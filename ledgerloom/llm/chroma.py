"""Chroma fingerprints of audio, and their alignment.

A recording is decoded (RIFF/WAVE, 16-bit PCM), cut into overlapping frames, and the spectrum of each is summed by pitch
class. Filters of six shapes compare rectangles of the time by pitch-class image through its integral image; every answer
is quantized to two bits (Gray code), and sixteen answers make one packed 32-bit item per frame. Recordings align where
many equal items have one offset; at that offset the share of differing bits decides.
"""

from __future__ import annotations

import io
import math
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.shared import arrow_map, materialize

RATE, FRAME, HOP = 5512, 2048, 683
LOWEST, HIGHEST = 55.0, 2200.0  # Hz
_SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
LEAST_VOTES, MOST_ERROR, LEAST_OVERLAP = 5, 0.15, 12
BLOCK_QUERIES = 4_000
#: (shape, lowest pitch class, height, width): shapes in turn, heights and widths growing, spread over the pitch classes.
FILTERS = [(k % 6, (5 * k) % 9, 3 + k % 2, (2, 3, 4, 6, 8, 10, 12, 15)[k // 2]) for k in range(16)]
WIDEST = max(f[3] for f in FILTERS)
EDGES = (-0.12, 0.0, 0.12)
_GRAY = np.array([0, 1, 3, 2], np.uint32)


def decode_wave(media: bytes | None) -> tuple[np.ndarray, int]:
    """Mono samples in [-1, 1] and their rate; nothing for null, empty or undecodable media."""
    try:
        with wave.open(io.BytesIO(media or b"")) as w:
            if w.getsampwidth() != 2:
                return np.zeros(0), RATE
            data = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float64) / 32768
            return data[: len(data) // w.getnchannels() * w.getnchannels()].reshape(-1, w.getnchannels()).mean(1), w.getframerate()
    except (wave.Error, EOFError):
        return np.zeros(0), RATE


def encode_wave(samples: np.ndarray, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def resample(samples: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    if rate == to or not len(samples):
        return samples
    at = np.arange(int(len(samples) * to / rate)) * (rate / to)
    return np.interp(at, np.arange(len(samples)), samples)


def _classes() -> np.ndarray:
    freq = np.arange(FRAME // 2 + 1) * RATE / FRAME
    out = np.zeros((len(freq), 12))
    for i, f in enumerate(freq):
        if LOWEST <= f <= HIGHEST:
            out[i, round(12 * math.log2(f / 440.0)) % 12] = 1
    return out


_TO_CLASS, _WINDOW = _classes(), np.hamming(FRAME)


def chroma_image(samples: np.ndarray) -> np.ndarray:
    """Smoothed, unit-length pitch-class energies, one row per frame; silent frames are zero."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    rows = []
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    for at in range(0, len(frames), 256):
        rows.append(np.abs(np.fft.rfft(frames[at : at + 256] * _WINDOW, axis=1)) ** 2 @ _TO_CLASS)
    image = np.concatenate(rows)
    if len(image) >= len(_SMOOTH):
        image = np.lib.stride_tricks.sliding_window_view(image, len(_SMOOTH), axis=0) @ _SMOOTH
    size = np.linalg.norm(image, axis=1, keepdims=True)
    return np.where(size > 0.01, image / np.maximum(size, 1e-9), 0)


def _area(sums: np.ndarray, t: np.ndarray, a: int, b: int, lo: int, hi: int) -> np.ndarray:
    """The image summed over frames [t + a, t + b) and pitch classes [lo, hi)."""
    return sums[t + b, hi] - sums[t + a, hi] - sums[t + b, lo] + sums[t + a, lo]


def packed_items(image: np.ndarray) -> np.ndarray:
    """One 32-bit item per frame that has WIDEST frames from it on."""
    n = len(image) - WIDEST + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    sums = np.zeros((len(image) + 1, 13))
    sums[1:, 1:] = image.cumsum(0).cumsum(1)
    t = np.arange(n)
    items = np.zeros(n, np.uint32)
    for shape, y, h, w in FILTERS:
        all_ = _area(sums, t, 0, w, y, y + h)
        mid, third, high = w // 2, max(1, w // 3), max(1, h // 2)
        if shape == 0:  # the whole against the rest of the frames' energy
            part, rest = all_ * (12 - h) / h, _area(sums, t, 0, w, 0, 12) - all_
        elif shape == 1:  # upper half
            part = _area(sums, t, 0, w, y + h - high, y + h)
            rest = (all_ - part) * high / max(1, h - high)
        elif shape == 2:  # later half
            part = _area(sums, t, mid, w, y, y + h)
            rest = (all_ - part) * (w - mid) / max(1, mid)
        elif shape == 3:  # two opposite quarters
            part = _area(sums, t, 0, mid, y, y + high) + _area(sums, t, mid, w, y + high, y + h)
            rest = all_ - part
        elif shape == 4:  # middle third of the pitches
            inner = max(1, h // 3)
            part = _area(sums, t, 0, w, y + (h - inner) // 2, y + (h - inner) // 2 + inner)
            rest = (all_ - part) * inner / max(1, h - inner)
        else:  # middle third of the time
            at = (w - third) // 2
            part = _area(sums, t, at, at + third, y, y + h)
            rest = (all_ - part) * third / max(1, w - third)
        answer = np.log((0.1 + np.maximum(part, 0)) / (0.1 + np.maximum(rest, 0)))
        items = (items << np.uint32(2)) | _GRAY[np.searchsorted(EDGES, answer)]
    return items


def fingerprint(media: bytes | None) -> np.ndarray:
    samples, rate = decode_wave(media)
    return packed_items(chroma_image(resample(samples, rate)))


def melody(vector: list[float] | None) -> bytes:
    """A recording of a vector: one tone per component, an eighth of a second long, its pitch by the component's size.

    Components that are null or not finite count as 0; a null vector is an empty recording.
    """
    v = np.array([x if x is not None and math.isfinite(x) else 0.0 for x in vector or []])
    if not len(v):
        return encode_wave(np.zeros(0))
    pitch = 36 + np.clip(np.round(12 + 12 * np.tanh(v / (np.abs(v).mean() + 1e-12))), 0, 24)
    step = RATE // 8
    t = np.arange(step) / RATE
    freq = 440.0 * 2 ** ((pitch - 57) / 12)
    return encode_wave((0.5 * np.sin(2 * np.pi * freq[:, None] * t)).ravel())


def recording_fingerprints(rows: DataFrame, to_media=None) -> DataFrame:
    """(id, items binary) of ``rows`` (id, media); ``to_media`` makes the media of a row in the task, one row at a time."""

    def make():
        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            found = [fingerprint(to_media(m) if to_media else m).astype("<u4").tobytes() for m in b.column("media").to_pylist()]
            return pa.RecordBatch.from_arrays([b.column("id"), pa.array(found, pa.binary())], ["id", "items"])

        return batch

    return arrow_map(rows.select("id", "media"), make, "id long, items binary")


class Aligner:
    """A block of query recordings; aligns others with them."""

    def __init__(self, queries: list[tuple[int, bytes]]):
        self.ids = [q for q, _ in queries]
        self.items = [np.frombuffer(x, "<u4") for _, x in queries]
        keys = np.concatenate(self.items) if queries else np.zeros(0, np.uint32)
        owner = np.repeat(np.arange(len(queries)), [len(x) for x in self.items])
        place = np.concatenate([np.arange(len(x)) for x in self.items]) if queries else np.zeros(0, int)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner, self.place = keys[order], owner[order], place[order]

    def __call__(self, own: int, items: np.ndarray) -> list[tuple[int, int, float, int]]:
        """(query, offset, bit error rate, frames in common) for each query that aligns; not ``own``.

        Offsets are of the query against this recording, chosen by votes, then by the lower error, then by the lower offset.
        """
        lo, hi = np.searchsorted(self.keys, items, "left"), np.searchsorted(self.keys, items, "right")
        n = hi - lo
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        offset = self.place[at] - np.repeat(np.arange(len(items)), n)
        code, votes = np.unique(self.owner[at] * (1 << 32) + (offset + (1 << 31)), return_counts=True)
        best: dict[int, tuple] = {}
        for c, v in zip(code[votes >= LEAST_VOTES].tolist(), votes[votes >= LEAST_VOTES].tolist()):
            q, off = c >> 32, (c & 0xFFFFFFFF) - (1 << 31)
            if self.ids[q] == own:
                continue
            a = self.items[q][max(0, off) : len(items) + off]
            b = items[max(0, -off) :][: len(a)]
            if len(a) < LEAST_OVERLAP:
                continue
            error = float(np.bitwise_count(a ^ b).sum()) / (32 * len(a))
            if error <= MOST_ERROR:
                rank = (-v, error, off)
                if q not in best or rank < best[q][0]:
                    best[q] = rank, (self.ids[q], off, error, len(a))
        return [x for _, x in best.values()]


def aligned(rows: DataFrame, to_media=None, step: int = 100, block: int = BLOCK_QUERIES) -> DataFrame:
    """One row per recording of ``rows`` (id, media): id, n_items, fingerprint (SHA-256 hex), class_id, n_links, and the best
    link: match_id, offset, bit_errors (share of differing bits), overlap (frames).

    Recordings with equal items are a class, named by its smallest id; a recording too short for an item is a class of its
    own. Queries are the classes that hold an id divisible by ``step``, compared in bounded blocks with every other
    class. Links are between classes and hold for all members. A null id is returned but is no query.
    """
    prints = materialize(recording_fingerprints(rows.select(F.col("id").cast("long").alias("id"), "media"), to_media), "prints")
    spark = rows.sparkSession
    empty = F.octet_length("items") == 0
    keyed = prints.withColumn("fingerprint", F.sha2("items", 256))
    classes = keyed.filter(~empty).groupBy("fingerprint").agg(F.min("id").alias("class_id"), F.max((F.coalesce(F.col("id") % step, F.lit(1)) == 0)).alias("asked"), F.first("items").alias("items"))
    classes = materialize(classes, "classes")
    best = F.struct("error", "query", "offset", "overlap")
    found, held, asked = None, [], classes.filter("asked").select("class_id", "items").orderBy("class_id")

    def search(queries: list[tuple[int, bytes]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(queries)

        def make():
            align = Aligner(shared.value)

            def batch(b: pa.RecordBatch) -> pa.RecordBatch:
                out = [(f, *m) for f, own, x in zip(*(b.column(c).to_pylist() for c in ("fingerprint", "class_id", "items"))) for m in align(own, np.frombuffer(x, "<u4"))]
                types = (pa.string(), pa.int64(), pa.int32(), pa.float64(), pa.int32())
                return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*out)) if out else [[]] * 5, types)], ["fingerprint", "query", "offset", "error", "overlap"])

            return batch

        return arrow_map(classes.select("fingerprint", "class_id", "items"), make, "fingerprint string, query long, offset int, error double, overlap int")

    for r in asked.toLocalIterator():
        held.append((r.class_id, bytes(r.items)))
        if len(held) == block:
            found, held = search(held) if found is None else found.unionByName(search(held)), []
    if held or found is None:
        found = search(held) if found is None else found.unionByName(search(held))
    links = found.groupBy("fingerprint").agg(F.count("*").alias("n_links"), F.min(best).alias("best"))
    named = classes.select("fingerprint", "class_id").join(links, "fingerprint", "left")
    named = materialize(named.select(F.col("fingerprint").alias("f"), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "best"), "named")
    joined = keyed.join(named, F.when(~empty, F.col("fingerprint")) == F.col("f"), "left")
    return joined.select(
        "id", (F.octet_length("items") / 4).cast("int").alias("n_items"), "fingerprint", F.when(empty, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("best.query").alias("match_id"), F.col("best.offset").alias("offset"), F.col("best.error").alias("bit_errors"), F.col("best.overlap").alias("overlap"),
    )
