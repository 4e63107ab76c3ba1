"""WARC archives: a deduplicating writer and a splittable reader of gzip members."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm.files import NewFile, open_input
from ledgerloom.llm.shared import materialize, shared_folder

MAGIC = b"\x1f\x8b\x08"
LEAST_REVISIT = 100
CHUNK = 1 << 18
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# ---------------------------------------------------------------- writer


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, refers_to): refers_to is the smallest page_id with the same payload.

    It is null for that page itself, for unique payloads and for payloads under ``least`` bytes. A null html is empty. Equal
    rows of the smallest page_id are all responses; a page without id never is referred to unless all have none.
    """
    body = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha2(body, 256))
    large = rows.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    repeated = materialize(large.filter("n > 1").select("payload_digest", "first"), "repeated")
    joined = rows.join(repeated, "payload_digest", "left")
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", F.when(~other, F.col("html")).alias("html"), "payload_bytes", "payload_digest", F.when(other, F.col("first")).alias("refers_to"))


def _record(page_id, url, html, size, digest, refers_to) -> bytes:
    """One gzip member. Both kinds carry the HTTP head, whose Content-Length is that of the whole payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if refers_to is not None else head + html
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Write every row of ``pages`` (page_id, url, html) as a record; returns (path, bytes, records), one row per file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, records = None, 0
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("page_id", "url", "html", "payload_bytes", "payload_digest", "refers_to")]
            for row in zip(*columns):
                out = out or NewFile(folder, f"part-{TaskContext.get().partitionId():06d}", ".warc.gz")
                out.write(_record(*row))
                records += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [out.path], "bytes": [out.size], "records": [records]})

    rows = with_revisits(pages).withColumn("html", F.col("html").cast("binary"))
    return materialize(rows.mapInArrow(run, "path string, bytes long, records long"), "manifest")


# ---------------------------------------------------------------- reader


class _Member:
    """A gzip member at a place of a file, inflated piece by piece."""

    def __init__(self, file, at: int):
        self.file, self.next = file, at
        self.inflate = zlib.decompressobj(31)

    def pieces(self) -> Iterator[bytes]:
        while not self.inflate.eof:
            self.file.seek(self.next)
            raw = self.file.read(CHUNK)
            if not raw:
                raise zlib.error("the member is cut off")
            out = self.inflate.decompress(raw)
            self.next += len(raw) - len(self.inflate.unused_data)
            if out:
                yield out


def _head_of(pieces: Iterator[bytes]) -> tuple[dict[str, str], bytearray] | None:
    """The WARC header fields and what was inflated beyond them; None if this is no WARC record."""
    data = bytearray()
    for piece in pieces:
        data += piece
        if not data.startswith(b"WARC/1."[: len(data)]):
            return None
        end = data.find(b"\r\n\r\n")
        if end >= 0:
            fields = {}
            for line in bytes(data[:end]).split(b"\r\n")[1:]:
                name, _, value = line.partition(b":")
                fields[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
            return (fields, data[end + 4 :]) if fields.get("content-length", "").isdigit() else None
        if len(data) > 1 << 20:
            return None
    return None


def _record_at(file, at: int) -> tuple[dict, int] | None:
    """The record whose member starts here and the place after it; None unless its whole member is sound."""
    member = _Member(file, at)
    pieces = member.pieces()
    try:
        if (head := _head_of(pieces)) is None:
            return None
        fields, rest = head
        length = int(fields["content-length"])
        for piece in pieces:
            rest += piece
    except zlib.error:
        return None
    if len(rest) != length + 4 or not rest.endswith(b"\r\n\r\n"):
        return None
    return {"fields": fields, "block": bytes(rest[:length])}, member.next


def _candidates(file, start: int, end: int, size: int) -> Iterator[int]:
    """Places of gzip magic in [start, end)."""
    at = start
    while at < end:
        file.seek(at)
        stop = min(end, at + CHUNK)
        data = file.read(min(stop + len(MAGIC) - 1, size) - at)
        found = data.find(MAGIC)
        while found >= 0:
            yield at + found
            found = data.find(MAGIC, found + 1)
        at = stop


def _walk(file, at: int, stop: int, size: int) -> int:
    """The first member place from ``stop`` on, following members from ``at``; ValueError where one is unsound."""
    while at < min(stop, size):
        if (found := _record_at(file, at)) is None:
            raise ValueError(f"no sound WARC record at byte {at}")
        at = found[1]
    return at


def _first_in_range(file, start: int, end: int, size: int) -> int | None:
    """Where the first member that starts in [start, end) does, None if none does.

    A candidate is gzip magic whose member decodes as a record, as do all members that follow it up to the first beyond
    the range, and that one. If some candidate decodes but its followers don't, it is a record stored inside another or
    the archive is damaged: then members are followed from the file's start, which tells the two apart.
    """
    if start == 0:
        return 0 if size else None
    for at in _candidates(file, start, end, size):
        if _record_at(file, at) is None:
            continue
        try:
            _walk(file, _walk(file, at, end, size), size if end >= size else end + 1, size)
            return at
        except ValueError:
            at = _walk(file, 0, start, size)
            return at if at < end else None
    return None


def records_in_range(file, start: int, end: int, size: int) -> Iterator[dict]:
    """The records whose members start in [start, end), in order; see ``_first_in_range`` for how the first is found.

    A record that is followed by damage is reported by ValueError, not skipped. Only an archive stored uncompressed within
    a record, and longer than a whole range, could be taken for the file's own members.
    """
    at = _first_in_range(file, start, end, size)
    while at is not None and at < min(end, size):
        if (found := _record_at(file, at)) is None:
            raise ValueError(f"no sound WARC record at byte {at}")
        yield found[0]
        at = found[1]
    if at is not None and at < size and _record_at(file, at) is None:
        raise ValueError(f"no sound WARC record at byte {at}")


def _page(record: dict) -> tuple:
    fields, block = record["fields"], record["block"]
    head, _, payload = block.partition(b"\r\n\r\n")
    lengths = [int(x.partition(b":")[2]) for x in head.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
    number = lambda name: int(v) if (v := fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")) else None
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
    if kind == "response":
        if len(payload) != lengths[0] or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"the payload of {fields['warc-record-id']} isn't the one that was written")
    return number("warc-record-id"), fields.get("warc-target-uri"), kind, lengths[0], digest, number("warc-refers-to"), payload if kind == "response" else None


READ_SCHEMA = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read_warc(spark: SparkSession, manifest: DataFrame, split_bytes: int = 8 << 20) -> DataFrame:
    """Read the archives of a manifest (path, bytes) by byte ranges of ``split_bytes``; see ``records_in_range``.

    payload is null for revisits, whose page is the response that refers_to names. Memory is bounded by one record.
    """
    ranges = manifest.select("path", F.col("bytes").alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))
    names = [c.split()[0] for c in READ_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        for b in batches:
            for path, size, start in zip(*(b.column(c).to_pylist() for c in ("path", "size", "start"))):
                with open_input(path) as file:
                    rows, held = [], 0
                    for record in records_in_range(file, start, min(start + split_bytes, size), size):
                        rows.append(_page(record))
                        held += len(record["block"]) + 200
                        if held > 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

    return ranges.repartition("path", "start").mapInArrow(run, READ_SCHEMA)


def warc_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages`` and read the archives back."""
    return read_warc(spark, write_warc(pages, shared_folder(spark, "warc")))
