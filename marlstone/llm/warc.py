"""WARC archives: writing pages as segmented records with chunked framing, and reassembling them.

Archives are written by Spark's text sink: a record is a row, and the blank lines between records are the sink's line
separator. They are read by Spark's text source with the version line as separator, so any store that Spark reads will
do and no archive is ever whole in memory; a record that holds that line itself is put together again by its length.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import shared, table

VERSION = b"WARC/1.1\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Bytes of a record's block before it continues in a further record, and of a chunk of the transfer framing.
SEGMENT_BYTES, CHUNK_BYTES = 32 << 10, 4 << 10

#: Bytes of records that a Python worker gathers before it hands them on.
HELD_BYTES = 4 << 20


def rows_of(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """The rows of a batch, a few at a time as Python values."""
    for i in range(0, batch.num_rows, 64):
        part = batch.slice(i, 64)
        yield from zip(*(part.column(k).to_pylist() for k in names))


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(payload: bytes, size: int) -> bytes:
    """payload in HTTP's chunked transfer framing."""
    parts = []
    for i in range(0, len(payload), size):
        part = payload[i : i + size]
        parts.append(b"%x\r\n%s\r\n" % (len(part), part))
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a body in chunked framing; ValueError if the framing is broken or incomplete."""
    parts, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("a chunk's size is missing")
        size = int(body[at:line].split(b";")[0], 16)
        if size == 0:
            return b"".join(parts)
        if body[line + 2 + size : line + 4 + size] != b"\r\n":
            raise ValueError("a chunk is shorter than its size")
        parts.append(body[line + 2 : line + 2 + size])
        at = line + 4 + size


def _header(fields: list[tuple[str, object]]) -> bytes:
    return VERSION + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields if v is not None) + b"\r\n"


def _line(value: str | None) -> str | None:
    return None if value is None else value.replace("\r", "%0D").replace("\n", "%0A")


def records(key: str, page: int | None, url: str | None, payload: bytes, digest: str, first: int | None, segment: int, chunk: int) -> Iterator[bytes]:
    """The records of a page, each without the blank lines behind it. first: the page that this one revisits, if any."""
    name = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}>"
    about = [("WARC-Date", DATE), ("WARC-Target-URI", _line(url)), ("WARC-Page-ID", page), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html;charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if first is not None:
        more = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Page-ID", first), ("WARC-Payload-Length", len(payload))]
        yield _header([("WARC-Type", "revisit"), ("WARC-Record-ID", name), *about, *more, ("Content-Length", len(http))]) + http
        return
    block = http + chunked(payload, chunk)
    if len(block) <= segment:
        yield _header([("WARC-Type", "response"), ("WARC-Record-ID", name), *about, ("Content-Length", len(block))]) + block
        return
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    for k, part in enumerate(parts, 1):
        own = name if k == 1 else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key}#{k}')}>"
        kind = about if k == 1 else [("WARC-Date", DATE), ("WARC-Segment-Origin-ID", name)]
        total = len(block) if k == len(parts) else None
        yield _header([("WARC-Type", "response" if k == 1 else "continuation"), ("WARC-Record-ID", own), *kind, ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", total), ("Content-Length", len(part))]) + part


def write_warc(pages: DataFrame, path: str, id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Gzipped WARC files below path, a record per row, longer blocks in segments.

    Of rows with equal payloads of at least least_bytes, that with the smallest id is the response and the others are
    revisits of it; smaller ones are all responses. A null payload is empty. Rows that repeat the smallest id are
    responses too, so none is lost; a row with a null id revisits the smallest id of its payload, or is a response if
    there is none. An empty table gives no record. Very long payloads are records in segments; columns besides the three
    aren't read. Payloads are equal when their SHA-256 is. The join is split by adaptive execution where one payload is
    hot, and each of its tasks writes an archive, so their number follows the bytes shuffled.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    own = F.sha2(body, 256)  # the header's SHA-1 can be forged
    rows = pages.select(F.col(id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), body.alias("body"), own.alias("own"))
    keys = pages.select(F.col(id).cast("long").alias("id"), own.alias("own"), F.octet_length(body).alias("n"))
    firsts = keys.where(F.col("n") >= least_bytes).groupBy("own").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1 and first is not null").drop("copies")
    planned = rows.join(table(firsts, "firsts"), "own", "left").withColumn("refers", F.when(~F.col("first").eqNullSafe(F.col("id")), F.col("first"))).select("id", "url", "body", "refers")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            out, held = [], 0
            for page, target, data, first in rows_of(batch, "id", "url", "body", "refers"):
                n += 1
                out += records(f"{part}-{n}-{page}", page, target, data, sha1_base32(data), first, segment_bytes, chunk_bytes)
                held += len(data)
                if held > HELD_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    archives = planned.mapInArrow(encode, "record binary").select(F.col("record").cast("string").alias("value"))
    archives.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


PARSED = "page_id long, url string, record_type string, refers_to long, payload_digest string, origin string, segment int, total long, block binary"
PAGES = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"
ARROW = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, ARROW[t]) for c, (_, t) in zip(columns, fields)], names=[k for k, _ in fields])


def page_of(head: dict, block: bytes) -> tuple:
    """A row of PAGES from a whole record: framing decoded, digest verified against the header."""
    digest, length, data = head.get("warc-payload-digest"), head.get("warc-payload-length"), None
    digest = digest and digest.removeprefix("sha1:")
    if head["warc-type"] == "response":
        http, _, body = block.partition(b"\r\n\r\n")
        data = unchunked(body) if b"transfer-encoding: chunked" in http.lower() else body
        length, own = len(data), sha1_base32(data)
        if digest not in (None, own):
            raise ValueError("a payload doesn't have the digest of its record")
        digest = own
    return (_number(head, "warc-page-id"), head.get("warc-target-uri"), head["warc-type"], _number(head, "warc-refers-to-page-id"), data, None if length is None else int(length), digest)


def _number(head: dict, key: str) -> int | None:
    return int(head[key]) if key in head else None


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n"))}


def _raw(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record, from the pieces of an archive between version lines."""
    held, need = bytearray(), -1
    head: dict[str, str] = {}
    for piece in pieces:
        if need < 0:
            if not piece:  # before the first version line of an archive
                continue
            held = bytearray(piece)
        else:
            held += VERSION + piece
        if need < 0:
            end = held.find(b"\r\n\r\n")
            if end < 0:
                raise ValueError("a record's header has no end")
            head = _fields(bytes(held[:end]))
            need = int(head["content-length"])
            del held[: end + 4]
        if len(held) >= need:
            yield head, bytes(held[:need])
            need = -1
    if need >= 0:
        raise ValueError("an archive ends inside a record")


def parse(spark: SparkSession, path: str, segmented: bool) -> DataFrame:
    """The records below path that are segments of a longer one, as PARSED, or the pages of the whole ones, as PAGES."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            for (x,) in rows_of(batch, "value"):
                yield x

    def segment(head: dict, block: bytes) -> tuple:
        origin = head.get("warc-segment-origin-id", head["warc-record-id"])
        return (_number(head, "warc-page-id"), head.get("warc-target-uri"), head["warc-type"], _number(head, "warc-refers-to-page-id"), head.get("warc-payload-digest"), origin, _number(head, "warc-segment-number"), _number(head, "warc-segment-total-length"), block)

    schema, row = (PARSED, segment) if segmented else (PAGES, page_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for head, block in _raw(pieces(batches)):
            if head.get("warc-type") in ("response", "revisit", "continuation") and ("warc-segment-number" in head) == segmented:
                rows.append(row(head, block))
                held += len(block)
            if held > HELD_BYTES:
                yield _batch(rows, schema)
                rows, held = [], 0
        yield _batch(rows, schema)

    lines = spark.read.option("lineSep", VERSION.decode()).text(path).select(F.col("value").cast("binary").alias("value"))
    return lines.mapInArrow(run, schema)


def reassemble(segments: DataFrame) -> DataFrame:
    """The pages of segmented records: blocks in the order of their segment numbers, with the total length verified.

    A gap in the numbers, a repeated number, a missing first or last record or a wrong length raises. A record in
    segments is gathered in one task, as its payload is one value in the end.
    """
    names = ("segment", "block", "page_id", "url", "record_type", "refers_to", "payload_digest", "total")
    grouped = segments.groupBy("origin").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("parts"))
    numbers = F.transform("parts", lambda p: p["segment"])
    first, last = F.element_at("parts", 1), F.element_at("parts", -1)
    flat = grouped.select(*(first[k].alias(k) for k in names[2:7]), last["total"].alias("total"), F.transform("parts", lambda p: p["block"]).alias("blocks"), (numbers == F.sequence(F.lit(1), F.size("parts"))).alias("good"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for page, url, kind, refers, digest, total, blocks, good in rows_of(batch, *names[2:8], "blocks", "good"):
                block = b"".join(blocks)
                if not good or kind == "continuation" or len(block) != total:
                    raise ValueError("a segmented record is incomplete or has a wrong length")
                head = {"warc-page-id": page, "warc-target-uri": url, "warc-type": kind, "warc-refers-to-page-id": refers, "warc-payload-digest": digest}
                rows.append(page_of({k: v for k, v in head.items() if v is not None}, block))
                held += len(block)
                if held > HELD_BYTES:
                    yield _batch(rows, PAGES)
                    rows, held = [], 0
            yield _batch(rows, PAGES)

    return flat.mapInArrow(join, PAGES)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The pages of the archives below path, as PAGES; a revisit's payload is null.

    Only segments are shuffled, to meet at their origin; whole records are decoded where they are read. Each
    payload's digest is verified against its header.
    """
    return parse(spark, path, False).unionByName(reassemble(parse(spark, path, True)))


def archive_round_trip(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """pages written by write_warc() to path, or a new folder among the shared ones, and read back."""
    import uuid as names

    path = path or f"{shared(pages.sparkSession)}/warc-{names.uuid4().hex}"
    write_warc(pages, path, **options)
    return read_warc(pages.sparkSession, path)
