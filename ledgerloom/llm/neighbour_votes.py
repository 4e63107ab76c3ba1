"""Quality by nearest-neighbour voting in a latent semantic space.

A text becomes counts of runs of three character classes, and of a few properties cut into grades (repeated words, lines
and line ends, word lengths). Log counts, weighted by inverse document frequency, are projected on the leading singular
vectors of a bounded labelled sample. The sample's unit vectors and labels, whose size the sample bounds, are broadcast;
every document is compared with all of them in blocks, exactly, and the nearest vote with a weight that grows with the
cosine.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.shared import arrow_map

SAMPLE = 5_000  # labelled documents that are neighbours, at most
COLUMNS = 1_600  # columns that the singular vectors are fitted on, those in most documents
RANK = 48
NEIGHBOURS = 25
SHARPNESS = 12.0
_BLOCK = 256

_CLASSES = np.zeros(256, np.int64)  # 0: other bytes
for _at, _set in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\r\n", b".", b",", b"!?", b"|", b"#$%&*@^~", b"'\"`", b"-_=+/\\<>", b"()[]{}:;"), 1):
    _CLASSES[list(_set)] = _at
_CLASSES[128:] = 14
_N = 15
_GRADES = 12
SIZE = _N**3 + 6 * _GRADES


def _graded(value: float) -> int:
    return int(min(_GRADES - 1, max(0, value * _GRADES)))


def counts_of(text: str) -> np.ndarray:
    """Counts of class trigrams, then one mark per graded property. An empty text has only marks."""
    raw = np.frombuffer(text.encode(), np.uint8)
    out = np.zeros(SIZE, np.float32)
    for at in range(0, max(len(raw) - 2, 0), 1 << 20):
        c = _CLASSES[raw[at : at + (1 << 20) + 2]]
        out[: _N**3] += np.bincount(c[:-2] * (_N * _N) + c[1:-1] * _N + c[2:], minlength=_N**3)
    words, lines = text.split(), text.split("\n")
    n = max(len(words), 1)
    distinct = len(set(words)) / n
    pairs = len(set(zip(words, words[1:]))) / max(len(words) - 1, 1)
    same_line = len(set(lines)) / max(len(lines), 1)
    ends = sum(w[-1:] in ".!?" for w in words) / n
    long_words = sum(map(len, words)) / n
    for k, v in enumerate((distinct, pairs, same_line, 4 * ends, long_words / 16, np.log1p(len(words)) / 11)):
        out[_N**3 + k * _GRADES + _graded(v)] = 1 + (len(raw) ** 0.5) / 4  # of a weight like that of the runs
    return out


@dataclass
class QualityModel:
    idf: np.ndarray
    basis: np.ndarray  # SIZE x rank
    vectors: np.ndarray  # sample x rank, unit length
    labels: np.ndarray
    base: float

    def embed(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
        v = x @ self.basis
        return v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-9)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), self.base)
        return self.votes(self.embed(counts), NEIGHBOURS)

    def votes(self, vectors: np.ndarray, k: int) -> np.ndarray:
        """Exact: all cosine products of a block of rows, then the k greatest; weights exp(SHARPNESS * (cos - best))."""
        k = min(k, len(self.labels))
        cos = vectors @ self.vectors.T
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        top = np.take_along_axis(cos, near, 1)
        w = np.exp(SHARPNESS * (top - top.max(1, keepdims=True)))
        return ((w * self.labels[near]).sum(1) + self.base) / (w.sum(1) + 1)


def fit_quality(sample: DataFrame, rank: int = RANK) -> QualityModel:
    """Fit on ``sample`` (id, text, y), which the caller has bounded: its counts come to the driver, its texts do not.

    An empty sample gives a constant score of 0.5, one of a single class that class's label.
    """

    def make():
        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            found = []
            for t in b.column("text").to_pylist():
                c = counts_of(t)
                at = np.flatnonzero(c)
                found.append(at.astype("<i4").tobytes() + c[at].astype("<f4").tobytes())
            return pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.array(found, pa.binary())], ["id", "y", "counts"])

        return batch

    rows = sorted(arrow_map(sample.select(F.col("id").cast("long").alias("id"), "text", "y"), make, "id long, y int, counts binary").collect())
    y = np.array([r.y for r in rows], np.float32)
    if not len(y) or y.min() == y.max():
        return QualityModel(np.zeros(0), np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0), float(y.mean()) if len(y) else 0.5)
    sparse = [(np.frombuffer(r.counts, "<i4", len(r.counts) // 8), np.frombuffer(r.counts, "<f4", offset=len(r.counts) // 2)) for r in rows]
    held = np.bincount(np.concatenate([at for at, _ in sparse]), minlength=SIZE)
    idf = np.log((1 + len(y)) / (1 + held)).astype(np.float32) + np.float32(0.3)
    used = np.sort(np.argsort(-held, kind="stable")[: min(COLUMNS, int((held > 0).sum()))])
    x = np.zeros((len(y), len(used)), np.float32)
    place = np.full(SIZE, -1)
    place[used] = np.arange(len(used))
    for i, (at, n) in enumerate(sparse):
        known = place[at] >= 0
        x[i, place[at[known]]] = np.log1p(n[known]) * idf[at[known]]
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
    _, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
    basis = np.zeros((SIZE, min(rank, len(used))), np.float32)
    basis[used] = vectors[:, ::-1][:, : basis.shape[1]]
    v = x @ basis[used]
    return QualityModel(idf, basis, (v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-9)).astype(np.float32), y, float(y.mean()))


def quality_scores(docs: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with all columns and ``score_col`` double (replaced if it exists). A null text counts as empty."""
    docs = docs.drop(score_col)
    names = [*docs.columns, score_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            texts, out = b.column(text_col).to_pylist(), []
            for at in range(0, len(texts), _BLOCK):
                out.append(own.scores(np.stack([counts_of(t or "") for t in texts[at : at + _BLOCK]])))
            return pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(out).astype(np.float64))], names)

        return batch

    return arrow_map(docs, make, docs.withColumn(score_col, F.lit(0.0)).schema)
