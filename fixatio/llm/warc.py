"""WARC archives: writing pages as records, and reading archives back.

Long records are written in segments. Reading groups continuation records by the identifier of
the record they continue, orders them by segment number, verifies the total length, and decodes
chunked transfer framing. Only segments are shuffled; whole records are decoded where they are
read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values of the format.
VERSION, RECORD_END = b"WARC/1.1", "\r\n\r\n"
LEAST_REVISIT, CHUNK, SEGMENT = 100, 8192, 32768
RECORDS_PER_FILE = 20_000
DATE = "2020-01-01T00:00:00Z"


def _record_id(key: str, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{key}|{digest}|{copy}')}>"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(payload[at:at + size]), payload[at:at + size]) for at in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def _record(kind: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))]
    clean = (f"{k}: {' '.join(str(v).split())}\r\n" for k, v in lines if v is not None)
    return VERSION + b"\r\n" + "".join(clean).encode() + b"\r\n" + block


def records_of(row: dict, segment: int) -> Iterator[bytes]:
    """The WARC records of a page: one, or a response in segments."""
    own = _record_id(row["key"], row["digest"], row["copy"])
    common = [
        ("WARC-Date", DATE), ("WARC-Target-URI", row["url"]), ("WARC-Page-ID", row["key"] or None),
        ("WARC-Payload-Digest", f"sha256:{row['digest']}"), ("Content-Type", "application/http; msgtype=response"),
    ]
    if row["refers_key"] is not None:
        yield _record("revisit", [
            ("WARC-Record-ID", own), *common, ("WARC-Refers-To", _record_id(row["refers_key"], row["digest"], 0)),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ], b"HTTP/1.1 200 OK\r\n\r\n")
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(row["payload"])
    if len(block) <= segment:
        yield _record("response", [("WARC-Record-ID", own), *common], block)
        return
    for n, at in enumerate(range(0, len(block), segment), 1):
        total = [("WARC-Segment-Total-Length", str(len(block)))] if at + segment >= len(block) else []
        number = ("WARC-Segment-Number", str(n))
        if n == 1:
            yield _record("response", [("WARC-Record-ID", own), *common, number], block[:segment])
        else:
            yield _record("continuation", [
                ("WARC-Record-ID", _record_id(row["key"], row["digest"], -n - (row["copy"] << 20))), ("WARC-Date", DATE),
                ("WARC-Segment-Origin-ID", own), number, *total,
            ], block[at:at + segment])


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT) -> None:
    """Write (page_id, url, html) as gzipped WARC files.

    Of pages with equal payloads of ``LEAST_REVISIT`` bytes or more, the one with the smallest
    page_id is a response (one of them, if rows repeat; null ids come last) and the others revisit
    it. A null html is an empty payload. Digests alone decide, so the first shuffle is narrow;
    pages are shuffled once, by id and digest, which no frequent payload makes uneven.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select(
        F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("key"), "page_id",
        F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"),
    )
    narrow = keyed.filter(F.octet_length("payload") >= LEAST_REVISIT).select("key", "digest", "page_id")
    firsts = narrow.groupBy("digest").agg(
        F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "key")).alias("first"), F.count("*").alias("n")
    ).filter("n > 1")
    revisits = narrow.join(firsts, "digest").select("key", "digest", F.col("first.key").alias("first_key")).distinct()
    copy = F.row_number().over(Window.partitionBy("key", "digest").orderBy(F.lit(1))) - 1
    rows = keyed.join(revisits, ["key", "digest"], "left").withColumn("copy", copy).select(
        "key", "url", "payload", "digest", "copy",
        F.when((F.col("first_key") != F.col("key")) | (F.col("copy") > 0), F.col("first_key")).alias("refers_key"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                out = [r for row in batch.slice(lo, 256).to_pylist() for r in records_of(row, segment)]
                yield pa.record_batch({"value": pa.array(out, pa.binary())})

    # Text files write a string's bytes as they are; the separator is the end of a record.
    lines = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    lines.write.option("lineSep", RECORD_END).option("compression", "gzip").option(
        "maxRecordsPerFile", RECORDS_PER_FILE
    ).text(path)


def inflated(content: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a file, gzipped (in any number of members) or plain, a part at a time."""
    view = memoryview(content)
    if content[:2] != b"\x1f\x8b":
        for at in range(0, len(view), size):
            yield bytes(view[at:at + size])
        return
    at, stream = 0, zlib.decompressobj(31)
    while at < len(view):
        part = view[at:at + size]
        at += len(part)
        data = stream.decompress(part)
        yield data
        while stream.eof:  # the next member
            rest = stream.unused_data
            stream = zlib.decompressobj(31)
            if not rest:
                break
            yield stream.decompress(rest)


def parse(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record, by Content-Length."""
    held = bytearray()

    def fill(n: int) -> bool:
        while len(held) < n:
            part = next(parts, None)
            if part is None:
                return False
            held.extend(part)
        return True

    while True:
        while fill(1) and held[0] in b"\r\n":
            del held[:1]
        end = held.find(b"\r\n\r\n")
        while end < 0:
            n = len(held)
            if not fill(n + 1):
                return  # the end, or a record that was cut off
            end = held.find(b"\r\n\r\n", max(0, n - 3))
        lines = bytes(held[:end]).decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(headers.get("content-length", 0))
        if not fill(end + 4 + length):
            return
        block = bytes(held[end + 4:end + 4 + length])
        del held[:end + 4 + length]
        yield headers, block


def http_payload(block: bytes) -> bytes | None:
    """The body of an HTTP message, without its chunks; null if their framing is broken."""
    head, _, body = block.partition(b"\r\n\r\n")
    if not any(
        x.partition(b":")[0].strip().lower() == b"transfer-encoding" and b"chunked" in x.lower() for x in head.split(b"\r\n")[1:]
    ):
        return body
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2:end + 2 + size])
        if len(out[-1]) < size or body[end + 2 + size:end + 4 + size] != b"\r\n":
            return None
        at = end + 4 + size


_FIELDS = "record_id string, kind string, page_id string, url string, digest string, refers_to string"
_NAMES = {
    "record_id": "warc-record-id", "kind": "warc-type", "page_id": "warc-page-id", "url": "warc-target-uri",
    "digest": "warc-payload-digest", "refers_to": "warc-refers-to",
}


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        types = {"number": pa.int32(), "total": pa.int64(), "data": pa.binary()}
        names = [*_NAMES, "origin", "number", "total", "data"]
        return pa.record_batch({c: pa.array([r[c] for r in rows], types.get(c, pa.string())) for c in names})

    for batch in batches:
        for content in batch.column("content"):
            rows, held = [], 0
            for headers, block in parse(inflated(content.as_py())):
                row = {c: headers.get(name) for c, name in _NAMES.items()}
                number, total = headers.get("warc-segment-number"), headers.get("warc-segment-total-length")
                row["number"], row["total"] = number and int(number), total and int(total)
                row["origin"] = number and (headers.get("warc-segment-origin-id") or row["record_id"])
                row["data"] = block if number else http_payload(block) if row["kind"] == "response" else None
                rows.append(row)
                held += len(block)
                if held > 4 << 20:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            parts = {}
            for part in row.column("parts")[0].as_py():
                parts.setdefault(part["number"], part["data"])
            block = b"".join(parts[n] for n in sorted(parts))
            whole = sorted(parts) == [*range(1, len(parts) + 1)] and len(block) == row.column("total")[0].as_py()
            payload = http_payload(block) if whole else None
            yield pa.record_batch([
                *(row.column(c) for c in _NAMES), pa.array([payload], pa.binary()), pa.array([whole]),
            ], names=[*_NAMES, "payload", "complete"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per record that is no continuation: record_id, kind, page_id, url, digest, refers_to,
    payload (null for revisits) and complete.

    A segmented record whose segments are missing, or differ from the total length, is not
    complete and has a null payload; so has broken chunk framing. A record that ends with the
    file before its Content-Length is left out.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    found = files.mapInArrow(_read, f"{_FIELDS}, origin string, number int, total long, data binary")
    whole = found.filter("number is null").select(
        *_NAMES, F.col("data").alias("payload"), (F.col("data").isNotNull() | (F.col("kind") != "response")).alias("complete")
    )
    # A group holds the segments of one record.
    split = found.filter("number is not null").groupBy("origin").agg(
        *[F.max(F.when(F.col("kind") != "continuation", F.col(c))).alias(c) for c in _NAMES],
        F.max("total").alias("total"), F.collect_list(F.struct("number", "data")).alias("parts"),
    )
    joined = split.mapInArrow(_assemble, f"{_FIELDS}, payload binary, complete boolean")
    return whole.union(joined)
