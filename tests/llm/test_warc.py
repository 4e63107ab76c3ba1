import gzip
import hashlib
import io
import random

import pytest

from ledgerloom.llm import shared, warc as W


def plain(rows, least=100):
    first = {}
    for page, _, html in rows:
        body = (html or "").encode()
        if len(body) >= least and page is not None:
            first[body] = min(first.get(body, page), page)
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        to = first.get(body)
        to = None if to == page else to
        out.append((page, len(body), hashlib.sha256(body).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=repr)


def test_round_trip_by_small_ranges(spark):
    rng = random.Random(4)
    page = lambda n: "<p>" + "".join(rng.choice("abc é\n\r\x1f") for _ in range(n)) + "</p>"
    same = page(300)
    rows = [(i, f"http://h/{i}\r\nX: y", page(rng.choice([0, 5, 80, 400, 3000]))) for i in range(60)]
    rows += [(100 + i, None, same) for i in range(5)] + [(90, "u", same), (90, "u", same), (70, "u", None), (71, "u", ""), (None, "u", same), (72, "u", "a" * 99), (73, "u", "a" * 99), (74, "u", "b" * 200_000)]
    df = spark.createDataFrame([(u, "x", p, h, 1) for p, u, h in rows], "url string, first string, page_id long, html string, records int")
    manifest = W.write_warc(df, shared.shared_folder(spark, "warc"))
    assert manifest.agg({"records": "sum"}).head()[0] == len(rows)
    for size in (700, 8 << 20):
        got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in W.read_warc(spark, manifest, size).collect()]
        assert sorted(got, key=repr) == plain(rows)
    payloads = {r.page_id: bytes(r.payload) for r in W.read_warc(spark, manifest).filter("record_type = 'response'").collect()}
    assert payloads[74] == b"b" * 200_000 and payloads[70] == b""


def test_every_split_owns_each_record_once():
    parts = [W._record(i, f"u{i}", random.Random(i).randbytes(i * 7), i * 7, "d", None) for i in range(40)]
    data = b"".join(parts)
    for step in (1, 13, 97, 1000, len(data)):
        got = [r["fields"]["warc-record-id"] for a in range(0, len(data), step) for r in W.records_in_range(io.BytesIO(data), a, min(a + step, len(data)), len(data))]
        assert got == [f"<urn:page:{i}>" for i in range(40)]


def test_magic_inside_a_payload_is_no_record():
    inner = gzip.compress(b"not a record") + W._record(98, "u", b"in", 2, "d", None) + W._record(99, "u", b"inside", 6, "d", None)
    stored = W._record(1, "u", inner + random.Random(1).randbytes(3000) + inner, 1, "d", None)
    data = stored + W._record(2, "u", b"x", 1, "d", None)
    for step in (50, 333, len(data)):
        got = [r["fields"]["warc-record-id"] for a in range(0, len(data), step) for r in W.records_in_range(io.BytesIO(data), a, min(a + step, len(data)), len(data))]
        assert got == ["<urn:page:1>", "<urn:page:2>"]


@pytest.mark.parametrize("step", [40, 300, 5000])
def test_damage_is_reported(step):
    parts = [W._record(i, "u", random.Random(i).randbytes(150), 150, "d", None) for i in range(6)]
    parts[3] = parts[3][:-9] + b"damage!!!"
    data = b"".join(parts)
    with pytest.raises(ValueError):
        for a in range(0, len(data), step):
            list(W.records_in_range(io.BytesIO(data), a, min(a + step, len(data)), len(data)))


def test_empty_table(spark):
    assert W.warc_round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
