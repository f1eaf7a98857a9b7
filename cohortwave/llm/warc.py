"""WARC archives: written with deduplicated payloads, read back with segments reassembled.

Writing: each task streams its rows into archives of its own in a folder that all executors share, a gzip member per
record. A response's block is an HTTP message in chunked transfer framing; a block above ``segment_bytes`` is cut
into a first record and continuation records. A task names its archives at random and returns their paths, so the manifest lists
the files of successful attempts only.

Reading: tasks stream the archives of the manifest. Records that are whole are decoded where they are read; segments are
grouped by origin identifier, put in order of segment number and checked against the stated total length before the chunked
framing is decoded.

Defined cases: a null html is an empty payload; a null url leaves the target header out; control
characters in a url are percent-encoded; a null page_id is written as ``null`` and refers to the response of its payload; identical
rows have one record identifier and come back as often as they were written; an empty table gives no archive and no rows.
A record that cannot be put together comes back with null payload and the reason in ``problem``.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scale import shared_dir
from .tables import attach, settle

REVISIT_BYTES = 1000
SEGMENT_BYTES = 32 * 1024
CHUNK_BYTES = 8 * 1024
ARCHIVE_BYTES = 256 * 1024 * 1024
BATCH_BYTES = 8 * 1024 * 1024
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "path string, records long"
PIECE = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("headers", pa.string()),
                   ("block", pa.binary())])
RECORD = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()),
                    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()),
                    ("problem", pa.string())])
PIECE_SQL = "origin string, number int, total long, headers string, block binary"
RECORD_SQL = ("record_id string, record_type string, refers_to string, payload_digest string, payload_bytes long, "
              "payload binary, problem string")


# --- framing

def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    out = []
    for at in range(0, len(body), size):
        part = body[at : at + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(data: bytes) -> bytes:
    out, at = [], 0
    while True:
        line = data.find(b"\r\n", at)
        if line < 0:
            raise ValueError("chunk size is missing")
        size = data[at:line].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            raise ValueError("chunk size is no number")
        n, at = int(size, 16), line + 2
        if n == 0:
            return b"".join(out)
        if data[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunk is cut short")
        out.append(data[at : at + n])
        at += n + 2


def http_payload(block: bytes) -> bytes:
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("HTTP header has no end")
    if re.search(rb"(?im)^transfer-encoding:[^\r\n]*\bchunked\b", head):
        return unchunked(body)
    return body


def record(kind: str, record_id: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {DATE}",
             *[f"{k}: {v}" for k, v in fields], f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}:{digest}>"


def page_of(identifier: str) -> str:
    return identifier.split(":")[2]


def records_of(page_id, url, payload: bytes, refers_to, segment_bytes: int) -> Iterator[bytes]:
    digest = hashlib.sha1(payload).digest()
    name = record_id(page_id, digest.hex())
    fields = [("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()),
              ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="%!#$&'()*+,/:;=?@[]~")))
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        fields += [("WARC-Refers-To", record_id(refers_to, digest.hex())), ("WARC-Profile", PROFILE)]
        yield record("revisit", name, fields, head + b"Content-Length: %d\r\n\r\n" % len(payload))
        return
    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment_bytes:
        yield record("response", name, fields, block)
        return
    count = -(-len(block) // segment_bytes)
    for k in range(count):
        part = block[k * segment_bytes : (k + 1) * segment_bytes]
        if k == 0:
            yield record("response", name, [*fields, ("WARC-Segment-Number", "1")], part)
            continue
        own = [("WARC-Segment-Number", str(k + 1)), ("WARC-Segment-Origin-ID", name)]
        if k == count - 1:
            own.append(("WARC-Segment-Total-Length", str(len(block))))
        yield record("continuation", f"{name[:-1]}:{k + 1}>", own, part)


# --- writing

def _folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _writer(folder: str, segment_bytes: int, archive_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _folder(folder)
        paths, counts, out = [], [], None
        for batch in batches:
            for page_id, url, html, refers_to in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if out is None or out.tell() > archive_bytes:
                    if out is not None:
                        out.close()
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                    paths.append(f"{folder}/{name}")
                    counts.append(0)
                for data in records_of(page_id, url, html or b"", refers_to, segment_bytes):
                    out.write(gzip.compress(data, 3, mtime=0))
                    counts[-1] += 1
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "records": pa.array(counts, pa.int64())})

    return write


def with_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
                  least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html as bytes, refers_to): which rows revisit the response with their payload.

    Only payloads that occur twice enter the table that is joined.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("html"))
    digest = F.when(F.octet_length("html") >= least, F.sha1("html"))
    twice = (rows.select("page_id", digest.alias("__digest")).where("__digest is not null")
             .groupBy("__digest").agg(F.max("page_id").alias("__last"), F.count(F.lit(1)).alias("__n"))
             .where("__n > 1 and __last is not null").drop("__n"))
    joined = attach(rows.withColumn("__digest", digest), twice, ["__digest"], "left", salts=8)
    revisits = F.col("__last").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("__last")))
    return joined.select("page_id", "url", "html", F.when(revisits, F.col("__last")).alias("refers_to"))


def write_archives(rows: DataFrame, folder: str, segment_bytes: int = SEGMENT_BYTES,
                   archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write (page_id, url, html, refers_to) and return the manifest: a written table of (path, records)."""
    store, base = _folder(folder)
    store.create_dir(base, recursive=True)
    return settle(rows.select("page_id", "url", "html", "refers_to")
                  .mapInArrow(_writer(folder, segment_bytes, archive_bytes), MANIFEST))


# --- reading

def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a decompressed archive."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            headers[k.strip().lower()] = v.strip()
        n = int(headers["content-length"])
        block = stream.read(n)
        if len(block) != n:
            raise ValueError("archive ends inside a record")
        yield headers, block


def _open(path: str) -> io.BufferedIOBase:
    store, base = _folder(path)
    raw = store.open_input_stream(base, compression=None, buffer_size=1 << 20)
    return gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else io.BufferedReader(raw)


def _decoded(headers: dict[str, str], block: bytes) -> list:
    digest = headers.get("warc-payload-digest", "")
    stated = base64.b32decode(digest[5:]).hex() if digest.startswith("sha1:") else None
    own = [headers["warc-record-id"], headers["warc-type"], headers.get("warc-refers-to")]
    if headers["warc-type"] == "revisit":
        size = re.search(rb"(?im)^content-length:\s*(\d+)", block)
        return [*own, stated, int(size[1]) if size else None, None, None]
    try:
        payload = http_payload(block)
    except ValueError as e:
        return [*own, stated, None, None, str(e)]
    found = hashlib.sha1(payload).hexdigest()
    if stated not in (None, found):
        return [*own, stated, None, None, "payload digest differs"]
    return [*own, found, len(payload), payload, None]


def _flow(rows: Iterator[list], schema: pa.Schema, weigh: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[weigh] or b"") + 200
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[str]:
    for batch in batches:
        yield from batch.column(0).to_pylist()


def _read_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for path in _paths(batches):
            with _open(path) as stream:
                for headers, block in parse(stream):
                    if headers["warc-type"] in ("response", "revisit") and "warc-segment-number" not in headers:
                        yield _decoded(headers, block)

    yield from _flow(rows(), RECORD, 5)


def _read_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for path in _paths(batches):
            with _open(path) as stream:
                for headers, block in parse(stream):
                    if "warc-segment-number" in headers:
                        total = headers.get("warc-segment-total-length")
                        yield [headers.get("warc-segment-origin-id") or headers["warc-record-id"],
                               int(headers["warc-segment-number"]), int(total) if total else None,
                               "\n".join(f"{k}: {v}" for k, v in headers.items()), block]

    yield from _flow(rows(), PIECE, 4)


def reassemble(pieces: pa.Table) -> pa.Table:
    """The record of one origin identifier, as often as its first segment occurs."""
    rows = sorted(pieces.select(PIECE.names).to_pylist(), key=lambda r: r["number"])
    first = [r for r in rows if r["number"] == 1]
    blocks = {r["number"]: r["block"] for r in rows}
    total = max((r["total"] for r in rows if r["total"] is not None), default=None)
    text = first[0]["headers"] if first else f"warc-record-id: {rows[0]['origin']}\nwarc-type: response"
    headers = dict(line.split(": ", 1) for line in text.split("\n"))
    problem = None
    if sorted(blocks) != list(range(1, len(blocks) + 1)) or total is None:
        problem = "segments are missing"
    elif sum(map(len, blocks.values())) != total:
        problem = "segments differ from the stated total length"
    if problem:
        row = [headers["warc-record-id"], headers["warc-type"], None, None, None, None, problem]
    else:
        row = _decoded(headers, b"".join(blocks[k] for k in sorted(blocks)))
    out = [row] * max(1, len(first))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), RECORD, strict=True)], schema=RECORD)


def read_archives(manifest: DataFrame) -> DataFrame:
    """A row per record of the archives: RECORD_SQL.

    The archives are streamed twice, once for whole records and once for segments, so that whole ones never move.
    """
    paths = manifest.select("path")
    files = max(1, paths.count())
    spread = paths.repartition(files)
    whole = spread.mapInArrow(_read_whole, RECORD_SQL)
    pieces = spread.mapInArrow(_read_pieces, PIECE_SQL).groupBy("origin").applyInArrow(reassemble, RECORD_SQL)
    return whole.unionByName(pieces)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write the pages as archives, read them back, and tell what each record holds."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    records = read_archives(write_archives(with_revisits(pages), folder, **options))
    page = lambda c: F.expr(f"try_cast(split({c}, ':')[2] as bigint)")
    return records.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                          F.when(F.col("record_type") == "revisit", page("refers_to")).alias("refers_to"), "problem")
