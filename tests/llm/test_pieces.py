"""Row-wise functions get bounded pieces of a batch, in order, and each row once."""

import pyarrow as pa

from ledgerloom.llm import shared


def test_pieces_hold_every_row_once_and_are_bounded():
    texts = ["x" * (i % 7 * 100) for i in range(500)] + ["y" * 5000, None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["id", "text"])
    for cut in (batch, batch.slice(13, 300), batch.slice(0, 0)):
        parts = list(shared.pieces_of(cut, 2000))
        assert [r for p in parts for r in p.to_pylist()] == cut.to_pylist()
        assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column("text").to_pylist()) <= 2000 for p in parts)


def test_a_worker_never_takes_a_large_batch_at_once(spark):
    def make():
        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            size = sum(len(t) for t in b.column("text").to_pylist())
            return pa.RecordBatch.from_arrays([b.column("id"), pa.array([size] * b.num_rows, pa.int64())], ["id", "size"])

        return batch

    rows = spark.range(0, 9000, 1, 1).selectExpr("id", "repeat('ab', 1000) AS text")
    got = shared.arrow_map(rows, make, "id long, size long", by_row=True)
    assert got.agg({"size": "max"}).head()[0] <= shared.PIECE and got.distinct().count() == 9000
