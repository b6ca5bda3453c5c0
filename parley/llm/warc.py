"""Conversion of legacy ARC archives to WARC, and reading of WARC archives.

An ARC file is a version block followed by records. The version block names the header fields
of its version; a record is one header line, whose last field declares the length of what
follows. Conversion synthesises the WARC identifiers, timestamps, types and digests. Of
records with equal payloads one becomes a response and the others revisit it.

Archives are written by Spark's text writer (a record is a value, the record separator its
line separator) and read by its binary file reader, so they may lie in any store that Spark
knows. A file has a bounded number of records and is decompressed as a stream.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import table
from parley.session import scratch_path

# Records in one archive file, its version or info record included.
FILE_RECORDS = 4096
# Payloads from this size on are stored once.
REVISIT_BYTES = 100
# Payload bytes that a task holds before it hands them on.
BATCH_BYTES = 8 << 20

# Fixed by the formats: header fields of both ARC versions, and the revisit profile.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename "
       "Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def _write(df: DataFrame, path: str, separator: str) -> None:
    (
        df.select(F.col("value").cast("string"))
        .write.option("lineSep", separator).option("compression", "gzip")
        .option("zlib.compress.level", "BEST_SPEED")
        .option("maxRecordsPerFile", FILE_RECORDS).text(path)
    )


def _opened(content: bytes) -> io.BufferedIOBase:
    raw = io.BytesIO(content)
    return gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw


def _exactly(stream: io.BufferedIOBase, n: int) -> bytes:
    data = stream.read(n)
    if len(data) != n:
        raise ValueError(f"archive ends {n - len(data)} bytes before its record does")
    return data


def _batches(rows: Iterable[dict], schema: pa.Schema, size: Callable[[dict], int]):
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += size(row) + 200
        if n >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def arc_version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 parley\n{ARC_FIELDS[version]}\n".encode()
    rest = f" 0.0.0.0 20000101000000 text/plain {len(body)}\n"
    if version == 2:
        rest = f" 0.0.0.0 20000101000000 text/plain 200 - - 0 {name} {len(body)}\n"
    return f"filedesc://{name}{rest}".encode() + body


def arc_header(version: int, url: str, date: str, kind: str, length: int, name: str) -> bytes:
    url = re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url)
    extra = f" 200 - - 0 {name}" if version == 2 else ""
    return f"{url} 0.0.0.0 {date} {kind}{extra} {length}\n".encode()


def arc_records(
    content: bytes, bad: list[tuple[int, str]] | None = None
) -> Iterator[tuple[dict[str, str], int, bytes]]:
    """Header fields, position and block of each record; version blocks change the fields.

    A malformed header or a record that ends early is an error. Given a list for them, they are
    told there by position instead, and reading goes on at the next line that is a header.
    """
    stream = _opened(content)
    fields = ARC_FIELDS[1].split()
    lost = False
    while True:
        position = stream.tell()
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue  # the line feed after a record
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        version = text.startswith("filedesc://")
        values = text.rsplit(" ", 1 if version else len(fields) - 1)
        whole = values[-1].isdigit() and (version or len(values) == len(fields))
        if lost and whole and not version:  # a line of text may end with a number
            date = dict(zip(fields, values))["Archive-date"]
            whole = date.isdigit() and len(date) in (8, 12, 14)
        if not whole:
            if bad is None:
                raise ValueError(f"no ARC header at byte {position}: {text[:100]}")
            if not lost:
                bad.append((position, f"no ARC header: {text[:100]}"))
            lost = True
            continue
        try:
            block = _exactly(stream, int(values[-1]))
        except ValueError as problem:
            if bad is None:
                raise
            bad.append((position, str(problem)))
            return
        lost = False
        if version:
            fields = block.decode("utf-8", "replace").splitlines()[1].split()
        else:
            yield dict(zip(fields, values)), position, block


def bad_arc_records(spark: SparkSession, path: str) -> DataFrame:
    """``(archive, position, problem)`` of what a conversion that is not strict leaves out."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                bad: list[tuple[int, str]] = []
                for _ in arc_records(content.as_py(), bad):
                    pass
                yield pa.RecordBatch.from_pydict({
                    "archive": pa.array([archive.rsplit("/", 1)[1]] * len(bad), pa.string()),
                    "position": pa.array([p for p, _ in bad], pa.int64()),
                    "problem": pa.array([p for _, p in bad], pa.string())})

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInArrow(find, "archive string, position long, problem string")


def write_pages_as_arc(pages: DataFrame, key: str, url: str, html: str, path: str) -> None:
    """One ARC record per row: an HTTP response with the key in a header of its own."""
    fields = pages.select(
        F.col(key).cast("string").alias("key"), F.col(url).alias("url"),
        F.coalesce(F.col(html), F.lit("")).cast("binary").alias("html"),
    )

    def records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version = 1 + part % 2
        name = f"{part:06d}.arc"

        def values() -> Iterator[dict]:
            written = 0
            for batch in batches:
                for row in batch.to_pylist():
                    if written % FILE_RECORDS == 0:
                        yield {"value": arc_version_block(version, name)}
                        written += 1
                    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                    if row["key"] is not None:
                        head += f"X-Page-Id: {row['key']}\r\n".encode()
                    head += f"Content-Length: {len(row['html'])}\r\n\r\n".encode()
                    block = head + row["html"]
                    line = arc_header(version, row["url"] or "urn:unknown", "20240101000000",
                                      "text/html", len(block), name)
                    yield {"value": line + block}
                    written += 1

        yield from _batches(values(), pa.schema([("value", pa.binary())]),
                            lambda r: len(r["value"]))

    _write(fields.mapInArrow(records, "value binary"), path, "\n")


_RECORD = (
    "archive string, position long, record_id string, url string, ip string, date string, "
    "kind string, content_type string, key string, payload_bytes long, payload_digest string"
)


def _split_http(block: bytes) -> tuple[bytes, bytes]:
    if not block.startswith(b"HTTP/"):
        return b"", block
    head, mark, payload = block.partition(b"\r\n\r\n")
    return head + mark, payload


def _http_field(head: bytes, name: bytes) -> str | None:
    found = re.search(rb"\r\n" + name + rb":[ \t]*([^\r\n]*)", head, re.IGNORECASE)
    return found[1].decode("utf-8", "replace").strip() if found else None


def read_arc(spark: SparkSession, path: str, blocks: bool, strict: bool = True) -> DataFrame:
    """One row per ARC record with the WARC fields synthesised; ``head`` and ``payload`` too
    if ``blocks`` is set. Parts of a date that an archive leaves out are zeros."""
    names = _RECORD + (", head binary, payload binary" if blocks else "")

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for archive, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                    archive = archive.rsplit("/", 1)[1]
                    for fields, position, block in arc_records(content.as_py(), None if strict else []):
                        head, payload = _split_http(block)
                        d = fields["Archive-date"].ljust(14, "0")
                        row = {
                            "archive": archive, "position": position,
                            "record_id": str(uuid.uuid5(uuid.NAMESPACE_URL,
                                                        f"{archive}/{position}")),
                            "url": fields["URL"], "ip": fields["IP-address"],
                            "date": f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
                            "kind": "response" if head else "resource",
                            "content_type": fields["Content-type"],
                            "key": _http_field(head, b"X-Page-Id"),
                            "payload_bytes": len(payload),
                            "payload_digest": hashlib.sha256(payload).hexdigest(),
                        }
                        if blocks:
                            row |= {"head": head, "payload": payload}
                        yield row

        types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([(n, types[t]) for n, t in (x.split() for x in names.split(", "))])
        yield from _batches(rows(), schema, lambda r: r["payload_bytes"] if blocks else 200)

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInArrow(parse, names)


def revisits(records: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Records that revisit another: ``(archive, position, to_id, to_url, to_date)``.

    Per payload of at least ``least`` bytes the record with the smallest number as key stays
    (keys that are no number after all others, then by place). The first is found by partial
    aggregation; payloads that occur once are gone before the join.
    """
    order = F.col("key").try_cast("long")
    first = F.struct(
        order.isNull().alias("none"), order.alias("order"), "archive", "position", "record_id",
        "url", "date",
    )
    large = records.filter((F.col("payload_bytes") >= least) & (F.col("kind") == "response"))
    groups = (
        large.groupBy("payload_digest")
        .agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    )
    return (
        large.select("payload_digest", "archive", "position").join(groups, "payload_digest")
        .filter((F.col("archive") != F.col("first.archive"))
                | (F.col("position") != F.col("first.position")))
        .select("archive", "position", F.col("first.record_id").alias("to_id"),
                F.col("first.url").alias("to_url"), F.col("first.date").alias("to_date"))
    )


def warc_record(row: dict) -> bytes:
    """A WARC record without the separator that ends it."""
    revisit = row.get("to_id") is not None
    block = row["head"] + (b"" if revisit else row["payload"])
    lines = [
        "WARC/1.0",
        f"WARC-Type: {'revisit' if revisit else row['kind']}",
        f"WARC-Record-ID: <urn:uuid:{row['record_id']}>",
        f"WARC-Target-URI: {row['url']}",
        f"WARC-Date: {row['date']}",
        f"WARC-IP-Address: {row['ip']}",
        f"WARC-Payload-Digest: sha256:{row['payload_digest']}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if revisit:
        lines += [
            f"WARC-Profile: {REVISIT_PROFILE}",
            f"WARC-Refers-To: <urn:uuid:{row['to_id']}>",
            f"WARC-Refers-To-Target-URI: {row['to_url']}",
            f"WARC-Refers-To-Date: {row['to_date']}",
        ]
    http = row["head"] or row["kind"] == "response"
    kind = "application/http; msgtype=response" if http else row["content_type"]
    lines += [f"Content-Type: {kind}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block


def warc_info(name: str) -> bytes:
    body = b"software: parley\r\nformat: WARC File Format 1.0\r\n"
    lines = [
        "WARC/1.0", "WARC-Type: warcinfo", "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>",
        "Content-Type: application/warc-fields", f"Content-Length: {len(body)}", "", "",
    ]
    return "\r\n".join(lines).encode() + body


def convert_arc(spark: SparkSession, arc: str, warc: str, least: int = REVISIT_BYTES,
                strict: bool = True) -> None:
    """Write the WARC archives of a folder of ARC archives.

    A record that is no HTTP message becomes a resource of its own content type, never a revisit.
    Empty payloads, equal records and records without a key are kept. A malformed header or a
    record shorter than declared ends the conversion with an error, or is left out if it is not
    ``strict`` (``bad_arc_records`` lists them).
    """
    records = read_arc(spark, arc, blocks=True, strict=strict)
    joined = records.join(
        revisits(read_arc(spark, arc, blocks=False, strict=strict), least), ["archive", "position"], "left")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{TaskContext.get().partitionId():06d}.warc"

        def values() -> Iterator[dict]:
            written = 0
            for batch in batches:
                for row in batch.to_pylist():
                    if written % FILE_RECORDS == 0:
                        yield {"value": warc_info(f"{name}/{written}")}
                        written += 1
                    yield {"value": warc_record(row)}
                    written += 1

        yield from _batches(values(), pa.schema([("value", pa.binary())]),
                            lambda r: len(r["value"]))

    _write(joined.mapInArrow(write, "value binary"), warc, "\r\n\r\n")


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    stream = _opened(content)
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:60]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, _exactly(stream, int(fields["content-length"]))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Responses, resources and revisits with their digests checked.

    A response's digest and size are computed from its payload and must agree with its
    header; a revisit has them from its headers.
    """

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for content in batch.column(0):
                    for fields, block in warc_records(content.as_py()):
                        if fields["warc-type"] == "warcinfo":
                            continue
                        head, payload = _split_http(block)
                        digest = fields["warc-payload-digest"].removeprefix("sha256:")
                        size = len(payload)
                        if fields["warc-type"] == "revisit":
                            size = int(_http_field(head, b"Content-Length"))
                        elif hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"wrong digest: {fields['warc-record-id']}")
                        yield {
                            "record_id": fields["warc-record-id"],
                            "record_type": fields["warc-type"],
                            "url": fields["warc-target-uri"],
                            "key": _http_field(head, b"X-Page-Id"),
                            "payload_bytes": size, "payload_digest": digest,
                            "refers_to_id": fields.get("warc-refers-to"),
                        }

        schema = pa.schema(
            [(n, pa.int64() if n == "payload_bytes" else pa.string()) for n in names])
        yield from _batches(rows(), schema, lambda r: 200)

    names = ("record_id", "record_type", "url", "key", "payload_bytes", "payload_digest",
             "refers_to_id")
    kinds = ", ".join(f"{n} {'long' if n == 'payload_bytes' else 'string'}" for n in names)
    files = spark.read.format("binaryFile").load(path)
    return files.select("content").mapInArrow(parse, kinds)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as ARC archives, converted to WARC and read back.

    A null html is an empty payload; a null page_id has no response before any other.
    """
    folder = scratch_path(spark, "llm-warc")
    write_pages_as_arc(table(spark, sf_dir, "pages"), "page_id", "url", "html", f"{folder}/arc")
    convert_arc(spark, f"{folder}/arc", f"{folder}/warc")
    records = read_warc(spark, f"{folder}/warc")
    # Only responses that a revisit names are looked up.
    named = records.filter("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_id"), F.col("key").cast("long").alias("refers_to"))
    wanted = records.filter("refers_to_id IS NOT NULL").select("refers_to_id").distinct()
    named = named.join(wanted, "refers_to_id", "left_semi")
    return records.join(named, "refers_to_id", "left").select(
        F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest",
        "record_type", "refers_to",
    )


QUERIES = {"op3_warc": op3_warc}
ORACLE = {
    "op3_warc": f"""
    SELECT page_id, payload_bytes, payload_digest,
        CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id <> first THEN 'revisit'
            ELSE 'response' END AS record_type,
        CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id <> first THEN first END AS refers_to
    FROM (
        SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM (
            SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
                sha256(coalesce(html, '')) AS payload_digest
            FROM pages))"""
}
