"""WARC archives: written by tasks with an index of every record, read back by coalesced byte ranges.

Each task writes gzipped records (one member a record) to a file of its own under a fresh name in the
shared folder and returns an index row per record: file, offset, length, URL and digest. Only the index
of tasks that succeeded is kept, so a file left by a lost task is never read; a task that fails deletes its own. The archive belongs to the
caller, ``remove_archive`` deletes it. Reading takes any selection of
index rows, deals them out by file and stretch, sorts by offset, joins neighbouring ranges into one read,
and checks each payload against its digest.

Defined results: a null html is an empty payload; a null URL has no WARC-Target-URI; a null id is written as
``null`` and read back as null; repeated rows each get a record, and those that repeat the response's id and payload
are responses as well; an empty table gives an empty index. Line ends in a URL are percent-encoded.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.common import filesystem
from tidewire.session import checkpoint_dir, cut

FILE_BYTES, STRETCH, GAP, READ_BYTES = 256 << 20, 8 << 20, 64 << 10, 4 << 20
DATE = "1970-01-01T00:00:00Z"
INDEX = "page_id long, url string, file string, offset long, length long, payload_digest string, record_type string"
INDEX_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string())])
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
RECORD_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _payload(v: pa.Scalar) -> bytes:
    return v.as_buffer().to_pybytes() if v.is_valid else b""


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data = [_payload(x) for x in b.column("html")]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array([hashlib.sha256(x).digest() for x in data], pa.binary()), pa.array([len(x) for x in data], pa.int64())], names=["page_id", "sha", "size"])


def _with_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([hashlib.sha256(_payload(x)).digest() for x in b.column("html")], pa.binary())], names=["page_id", "url", "html", "sha"])


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(raw: bytes) -> bytes:
    c = zlib.compressobj(4, wbits=31)
    return c.compress(raw) + c.flush()


def _writer(base: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(base)
        out, name, at, written = None, "", 0, []
        try:
            for b in batches:
                rows = []
                for i, url, html, keep in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), b.column("html"), b.column("keep").to_pylist(), strict=True):
                    payload = _payload(html)
                    revisit = keep is not None and keep != i
                    digest = sha1_base32(payload)
                    member = gzip_member(record(i, url, payload, digest, keep, revisit))
                    if out is None or at > FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                        written.append(f"{root}/{name}")
                    out.write(member)
                    rows.append((i, url, f"{base}/{name}", at, len(member), digest, "revisit" if revisit else "response"))
                    at += len(member)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), INDEX_ARROW.types, strict=True)] if rows else [pa.array([], t) for t in INDEX_ARROW.types], schema=INDEX_ARROW)
        except BaseException:
            if out is not None:
                out.close()
                out = None
            for path in written:  # no index will speak of them
                fs.delete_file(path)
            raise
        finally:
            if out is not None:
                out.close()

    return write


def write_archive(pages: DataFrame, min_revisit_bytes: int = 0, base: str | None = None) -> DataFrame:
    """Write a record per page and return the index. Of equal payloads of at least ``min_revisit_bytes`` the one with the largest id is the response."""
    spark = pages.sparkSession
    base = base or f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    fs, root = filesystem(base)
    fs.create_dir(root, recursive=True)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    seen = pages.select("page_id", "html").mapInArrow(_digests, "page_id long, sha binary, size long").filter(F.col("size") >= min_revisit_bytes)
    groups = seen.groupBy("sha").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).filter("n > 1").select("sha", "keep").repartition("sha")  # a shuffle below both sides, so that skew handling can split a frequent payload
    kept = seen.join(groups, "sha").select(F.col("page_id").alias("k_id"), F.col("sha").alias("k_sha"), "keep").distinct()
    full = pages.mapInArrow(_with_digest, "page_id long, url string, html string, sha binary")
    joined = full.join(kept, full["page_id"].eqNullSafe(kept["k_id"]) & (full["sha"] == kept["k_sha"]), "left").select("page_id", "url", "html", "keep")
    return cut(joined.mapInArrow(_writer(base), INDEX))


def parse(raw: bytes) -> tuple:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    number = lambda v: None if v is None or "null" in v else int(v.rpartition(":")[2].rstrip(">"))
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or sha1_base32(payload) != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']}: the payload doesn't match its digest")
    return number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), size, digest, kind, number(fields.get("WARC-Refers-To")), payload


def ranges(rows: list[tuple[str, int, int]], gap: int = GAP, most: int = READ_BYTES) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Join sorted (file, offset, length) into (file, start, end, members) with holes of at most ``gap`` bytes."""
    file, start, end, members = None, 0, 0, []
    for f, o, n in rows:
        if f != file or o - end > gap or o + n - start > most:
            if members:
                yield file, start, end, members
            file, start, end, members = f, o, o, []
        members.append((o, n))
        end = max(end, o + n)
    if members:
        yield file, start, end, members


def _reader(payloads: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))
            for file, start, end, members in ranges(rows):
                fs, path = filesystem(file)
                with fs.open_input_file(path) as f:
                    data = f.read_at(end - start, start)
                got = [parse(zlib.decompress(data[o - start : o - start + n], wbits=31)) for o, n in members]
                if not payloads:
                    got = [(*r[:6], None) for r in got]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), RECORD_ARROW.types, strict=True)], schema=RECORD_ARROW)

    return read


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that the rows of ``index`` point to."""
    dealt = index.select("file", "offset", "length").repartition("file", F.floor(F.col("offset") / STRETCH)).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(_reader(payloads), RECORD)


def remove_archive(base: str) -> None:
    fs, root = filesystem(base)
    fs.delete_dir(root)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    try:
        index = write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), base=base)
        return cut(read_records(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    finally:
        remove_archive(base)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS s, h, max(page_id) OVER (PARTITION BY h) AS keep FROM p),
b AS (SELECT *, array_to_string([substr('0000000100100011010001010110011110001001101010111100110111101111',
        1 + 4 * (strpos('0123456789abcdef', substr(s, i + 1, 1)) - 1), 4) FOR i IN range(40)], '') AS bits FROM d)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT)
     + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT) AS BIGINT), 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM b
"""
