"""WARC derivatives: response records become linked metadata and plain-text conversion records.

A response gives two records.  The conversion holds its text and refers to the response
(WARC-Refers-To); the metadata holds, as JSON, the response's envelope, HTTP headers, title and
links, refers to the response too, and names the conversion as its companion
(WARC-Concurrent-To).  Both keep the target URI, the date, the source's headers and the payload
digest that the source bears; each has a digest of its own block.  Digests are SHA-1 in base 32,
as WARC tools write them.  Identifiers are made from the source's and the kind, so a second run
or a retried task writes the same ones.  The text, title and links of an HTML page are read off its
tree (``html_layout``); other payloads are text as they are.

Rows are independent and nothing is shuffled.  Edge cases: a null payload counts as empty and
still gives both records; null headers, URI or date are left out of the record's headers; bytes
that are not UTF-8 are read by the charset that the headers or the page name, else replaced; a
very long payload is read whole; repeated responses give repeated records; an empty table gives an
empty result; other columns, whatever their names, are ignored.  In record files a record without a
usable Content-Length reaches to the next record, and one that the file's end cuts off has what is there.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clarispark.llm import html_layout
from clarispark.llm.common import arrow_map, batch_of, slices

DATE = "2024-01-01T00:00:00Z"
RECORDS = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("concurrent_to", pa.string()), ("target_uri", pa.string()),
    ("warc_date", pa.string()), ("content_type", pa.string()), ("source_headers", pa.string()), ("source_payload_digest", pa.string()),
    ("block_digest", pa.string()), ("content_length", pa.int64()), ("block", pa.string()),
])
RECORDS_SQL = ", ".join(f"{f.name} {'long' if f.name == 'content_length' else 'string'}" for f in RECORDS)

# Attributes of HTML elements that hold links.
LINKS = {"a": "href", "area": "href", "link": "href", "img": "src", "script": "src", "iframe": "src", "source": "src", "form": "action"}
_CHUNK = re.compile(rb"([0-9a-fA-F]{1,15})[^\r\n]*\r\n")
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?([\w.-]+)", re.I)


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(kind: str, *parts: str | None) -> str:
    name = "\x00".join([kind, *("" if p is None else p for p in parts)])
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(name.encode('utf-8', 'surrogatepass')).digest()[:16], version=5)}>"


def read_page(page: str, is_html: bool) -> tuple[str, str | None, list[dict[str, str]]]:
    """Text, title and links, in the order of the page."""
    if not is_html:
        return page, None, []
    root = html_layout.build(page)
    title, links, todo = None, [], [root]
    while todo:
        node = todo.pop()
        if node.tag == "title" and title is None:
            title = " ".join("".join(k for k in node.kids if isinstance(k, str)).split())
        if node.tag in LINKS and node.attrs and (url := html_layout.attributes(node.attrs).get(LINKS[node.tag])) is not None:
            links.append({"path": f"{node.tag.upper()}@/{LINKS[node.tag]}", "url": url})
        todo += [k for k in reversed(node.kids) if not isinstance(k, str)]
    return html_layout.render(root), title, links


def is_html(headers: list[tuple[str, str]], payload: bytes) -> bool:
    """By the content type; without one, by what the payload begins with."""
    named = next((v.lower() for k, v in headers if k.lower() == "content-type"), "")
    return "html" in named if named else payload.lstrip()[:1] == b"<"


def parse_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers in order, and payload of an HTTP response."""
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("latin-1").split("\r\n")
    return status, [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines)], payload


def plain(payload: bytes, headers: list[tuple[str, str]]) -> bytes:
    """The payload without its transfer and content encodings; one that can't be undone stays."""
    named = {k.lower(): v.lower() for k, v in headers}
    if "chunked" in named.get("transfer-encoding", ""):
        at, chunks = 0, []
        while m := _CHUNK.match(payload, at):
            size = int(m[1], 16)
            chunks.append(payload[m.end() : m.end() + size])
            at = m.end() + size + 2
            if not size:
                break
        payload = b"".join(chunks) if chunks else payload
    if named.get("content-encoding", "").strip() in ("gzip", "x-gzip", "deflate"):
        try:
            payload = zlib.decompressobj(47).decompress(payload)
        except zlib.error:
            pass
    return payload


def decoded(payload: bytes, headers: list[tuple[str, str]]) -> str:
    named = next((m[1] for v in [*(v.encode() for k, v in headers if k.lower() == "content-type"), payload[:1024]] if (m := _CHARSET.search(v))), b"utf-8")
    try:
        return payload.decode(named.decode(), "replace")
    except (LookupError, UnicodeError):
        return payload.decode("utf-8", "replace")


def derive(source_id: str | None, uri: str | None, date: str | None, block: bytes, source_digest: str | None) -> list[tuple]:
    """The metadata and conversion records of one response, as rows of RECORDS."""
    status, headers, payload = parse_http(block)
    own = source_digest or digest(payload)
    body = plain(payload, headers)
    text, title, links = read_page(decoded(body, headers), is_html(headers, body))
    source = json.dumps({"status": status, "headers": headers}, ensure_ascii=False)
    ids = {kind: record_id(kind, source_id, uri, own) for kind in ("metadata", "conversion")}
    meta = json.dumps({
        "Envelope": {
            "WARC-Header-Metadata": {"WARC-Record-ID": source_id, "WARC-Target-URI": uri, "WARC-Date": date, "WARC-Payload-Digest": own, "Content-Length": len(block)},
            "Payload-Metadata": {"HTTP-Response-Metadata": {
                "Response-Message": status, "Headers": headers, "Entity-Length": len(payload), "Entity-Digest": digest(payload),
                "HTML-Metadata": {"Title": title, "Links": links},
            }},
        }
    }, ensure_ascii=False)
    out = []
    for kind, mime, body in (("metadata", "application/json", meta), ("conversion", "text/plain", text)):
        raw = body.encode("utf-8", "surrogatepass")
        other = ids["conversion" if kind == "metadata" else "metadata"]
        out.append((ids[kind], kind, source_id, other, uri, date, mime, source, own, digest(raw), len(raw), body))
    return out


def responses_of(pages: DataFrame, date: str = DATE) -> DataFrame:
    """(page_id, record_id, target_uri, warc_date, block) for rows of (page_id, url, html): each page as a crawler stored it."""
    schema = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()), ("block", pa.binary()), ("payload_digest", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for page, url, raw in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), b.column("html").cast(pa.binary()).to_pylist(), strict=True):
                payload = raw or b""
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                own = digest(payload)
                rows.append((page, record_id("response", None if page is None else str(page), url, own), url, date, head + payload, own))
            yield batch_of(schema, [list(x) for x in zip(*rows, strict=True)])

    return arrow_map(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), run, "page_id long, record_id string, target_uri string, warc_date string, block binary, payload_digest string")


def derivatives(responses: DataFrame, key: str = "page_id") -> DataFrame:
    """Two rows per response: its key and the columns of RECORDS."""
    schema = pa.schema([("key", pa.int64()), *RECORDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 128):
            cols = [b.column(c).to_pylist() for c in (key, "record_id", "target_uri", "warc_date", "block", "payload_digest")]
            rows = [(k, *r) for k, i, u, d, block, own in zip(*cols, strict=True) for r in derive(i, u, d, block or b"", own)]
            yield batch_of(schema, [list(x) for x in zip(*rows, strict=True)])

    named = responses.select(F.col(key).cast("long").alias(key), "record_id", "target_uri", "warc_date", "block", "payload_digest")
    return arrow_map(named, run, f"key long, {RECORDS_SQL}").withColumnRenamed("key", key)


# --- Record files ---------------------------------------------------------------------------------


def to_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC/1.1 record."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def serialized(row: dict) -> bytes:
    """The record of a row of RECORDS."""
    names = (("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Concurrent-To", "concurrent_to"), ("WARC-Target-URI", "target_uri"),
             ("WARC-Date", "warc_date"), ("WARC-Block-Digest", "block_digest"), ("WARC-Source-Payload-Digest", "source_payload_digest"), ("WARC-Source-Headers", "source_headers"), ("Content-Type", "content_type"))
    return to_bytes([(k, row[c]) for k, c in names if row[c] is not None], row["block"].encode("utf-8", "surrogatepass"))


_LENGTH = re.compile(rb"^Content-Length[ \t]*:[ \t]*([0-9]{1,15})[ \t]*\r?$", re.I | re.M)
_MARK = b"WARC/1."
_CUT = b"\r\n" + _MARK
#: Bytes up to which a block that holds records itself is put together.
LONGEST = 256 << 20


def _due(part: bytes) -> int:
    """Bytes of the record that begins this part, by its Content-Length; 0 if it names none."""
    end = part.find(b"\r\n\r\n")
    m = _LENGTH.search(part, 0, end + 2) if end >= 0 else None
    return end + 4 + int(m[1]) if m else 0


def joined_records(parts: Iterator[bytes | None]) -> Iterator[bytes]:
    """Whole records, from files that were cut before each ``WARC/1.`` which begins a line; None ends a file.

    Where a block holds such a line itself, its Content-Length tells that more of it follows.  The
    parts are joined only if the record then ends where a record may; else it was cut off, and the
    parts are records each.  So is one that claims more than LONGEST bytes beyond its part.
    """
    def alone(part: bytes) -> bytes:
        due = _due(part)
        return part[:due] if due else part.rstrip(b"\r\n")

    held: list[bytes] = []
    size = due = 0
    queue: list[bytes | None] = []
    parts = chain(parts, [None])
    while True:
        part = queue.pop() if queue else next(parts, parts)
        if part is parts:
            return
        if part is not None:
            if not held:
                due = _due(part)
                if due <= len(part) or due > LONGEST:
                    yield alone(part)
                    continue
            size += len(part) + (len(_CUT) if held else 0)
            held.append(part)
            if size < due:
                continue
            whole = _CUT.join(held)
            if whole[due:] in (b"", b"\r\n", b"\r\n\r\n"):
                yield whole[:due]
                held, size = [], 0
                continue
        if held:  # it ends elsewhere, or its file does
            yield alone(held[0])
            queue += [part] if part is None else []
            queue += held[:0:-1]
            held, size = [], 0


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; the first line is its version, with or without its mark."""
    head, _, block = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, block


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed WARC file."""
    _, *parts = (b"\r\n" + data).split(_CUT)
    return map(parse_record, joined_records(iter(parts)))


def serialize(records: DataFrame) -> DataFrame:
    """(record_id, record binary) for rows of RECORDS, to be written by any sink."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("record", pa.binary())])
        for b in batches:
            rows = b.to_pylist()
            yield batch_of(schema, [[r["record_id"] for r in rows], [serialized(r) for r in rows]])

    return arrow_map(records.select(*[f.name for f in RECORDS]), run, "record_id string, record binary")


def read_responses(spark, path: str) -> DataFrame:
    """Response records of uncompressed or gzipped WARC files, in the columns that ``derivatives`` takes; page_id numbers them.

    Spark reads the files as lines that end before a record's first line, so a task holds one
    record at a time and uncompressed files are split.  A block that holds whole records itself is
    put together again by its length, unless a split of an uncompressed file begins inside it.
    """
    schema = pa.schema([("record_id", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()), ("block", pa.binary()), ("payload_digest", pa.string())])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes | None]:
        split = None
        for b in slices(batches, 64):
            for own, part in zip(zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True), b.column("part").to_pylist(), strict=True):
                if own != split:
                    split = own
                    yield None
                    if own[1] == 0:  # a file's first part has its mark, or stands before the first mark
                        part = part[len(_MARK) :] if part.startswith(_MARK) else b""
                if part:
                    yield part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in joined_records(parts(batches)):
            headers, block = parse_record(record)
            h = {k.lower(): v for k, v in headers.items()}
            if h.get("warc-type") == "response":
                yield batch_of(schema, [[h.get(k)] for k in ("warc-record-id", "warc-target-uri", "warc-date")] + [[block], [h.get("warc-payload-digest")]])

    lines = spark.read.option("lineSep", "\r\nWARC/1.").text(path)
    named = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("part"))
    return arrow_map(named, run, "record_id string, target_uri string, warc_date string, block binary, payload_digest string").withColumn("page_id", F.monotonically_increasing_id())


def op4_warc_derivatives(spark, sf_dir: str) -> DataFrame:
    return derivatives(responses_of(spark.read.parquet(f"{sf_dir}/pages.parquet")))
