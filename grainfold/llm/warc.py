"""WARC archives: one gzip member per record, written in parts and read sequentially.

The reader takes an archive as a stream, decompresses member by member in small
steps, frames each record by its Content-Length, and checks the payload digest.
Archives are files in a folder that all executors share; a task writes each
under a name of its own attempt and returns the names, and only archives whose
names were committed are read, so attempts that died or ran twice leave nothing
that counts.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainfold.plans.workspace import Workspace

VERSION = b"WARC/1.1"
#: Fixed values of the format: the profile of revisits by equal payload, and the type of a stored HTTP response.
PROFILE, HTTP = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "application/http; msgtype=response"
_STEP = 1 << 16
#: Tasks that read archives, at most; each reads its archives one after another.
READERS = 10_000


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    head = b"".join([VERSION, b"\r\n", *(f"{k}: {v}\r\n".encode() for k, v in headers), f"Content-Length: {len(block)}\r\n\r\n".encode()])
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def http_response(payload: bytes) -> bytes:
    """A payload as the body of an HTTP response, the block of a response record."""
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload


def members(stream: BinaryIO) -> Iterator[bytes]:
    """The content of each gzip member of a stream, in order; read and decompressed in steps, one member held at a time."""
    rest = stream.read(_STEP)
    while rest:
        z, out = zlib.decompressobj(31), []
        while True:
            try:
                out.append(z.decompress(rest))
            except zlib.error as e:
                raise ValueError(f"no gzip member: {e}") from e
            if z.eof:
                break
            if not (rest := stream.read(_STEP)):
                raise ValueError("a gzip member is cut short")
        rest = z.unused_data or stream.read(_STEP)
        yield b"".join(out)


def records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, payload) of each record; ValueError where framing or digest is wrong.

    The payload of an HTTP response record is the response's body; of any other
    record, its whole block.
    """
    for m in members(stream):
        head, sep, rest = m.partition(b"\r\n\r\n")
        lines = head.split(b"\r\n")
        if not sep or not lines[0].startswith(b"WARC/"):
            raise ValueError("no WARC header")
        headers = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines[1:])}
        size = int(headers.get("content-length", "-1"))
        if size < 0 or rest[size:] != b"\r\n\r\n":
            raise ValueError("content length does not frame the record")
        block = rest[:size]
        if headers.get("content-type", "").startswith("application/http") and block:
            _, sep, block = block.partition(b"\r\n\r\n")
            if not sep:
                raise ValueError("no HTTP header")
        said = headers.get("warc-payload-digest", "").rpartition(":")[2]
        if headers.get("warc-type") == "response" and said and said != digest(block):
            raise ValueError("payload digest differs")
        yield headers, block


def plan_records(pages: DataFrame, ws: Workspace, min_bytes: int = 0, key: str = "page_id", payload: str = "html", url: str = "url") -> DataFrame:
    """page_id, url, body, refers_to, sha1, n: body is null for revisits.

    Of rows with equal payloads of at least ``min_bytes`` bytes, the one with
    the largest page_id is the response and the others revisit it.  A null
    payload is empty; a null page_id is a response of its own; repeated rows
    that hold the largest page_id are all responses, and smaller ones all
    revisit it.  Other columns are not read.  Revisits are found among ids and
    digests alone: largest ids by partial aggregation, then written, so that the
    rows of one digest may be split where they meet it.  Payloads are dealt by
    page_id and digest together, never by digest.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    link = F.col(url) if url in pages.columns else F.lit(None).cast("string")
    src = pages.select(F.col(key).alias("page_id"), link.alias("url"), body.alias("body"), F.sha2(body, 256).alias("h"))
    ids = pages.where(F.col(key).isNotNull() & (F.octet_length(body) >= min_bytes)).select(F.col(key).alias("id"), F.sha2(body, 256).alias("d"))
    first = ws.write(ids.groupBy(F.col("d").alias("f")).agg(F.max("id").alias("first"), F.min("id").alias("least")).where("least < first").select("f", "first"), "first")
    again = ids.join(first, F.col("d") == F.col("f")).where("id < first").select("id", "d", "first").distinct()
    both = src.join(again, (F.col("page_id") == F.col("id")) & (F.col("h") == F.col("d")), "left")
    return both.select("page_id", "url", F.when(F.col("first").isNull(), F.col("body")).alias("body"), F.col("first").alias("refers_to"), F.sha1("body").alias("sha1"), F.octet_length("body").cast("long").alias("n"))


def write_archives(plan: DataFrame, folder: str, most_bytes: int = 8 << 20) -> DataFrame:
    """Writes the planned records as ``*.warc.gz`` below ``folder`` (a URI); returns name, n_records per archive (lazy).

    Write the result to a table: the names in it are those of tasks that were
    committed, and only they name whole archives.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = pafs.FileSystem.from_uri(folder)
        ctx = TaskContext.get()
        now = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        buf, size, n, k = [], 0, 0, 0

        def close() -> pa.RecordBatch:
            name = f"part-{ctx.partitionId():06d}-{ctx.taskAttemptId()}-{k:05d}.warc.gz"
            with fs.open_output_stream(f"{root}/{name}", compression=None) as f:
                for x in buf:
                    f.write(x)
            return pa.RecordBatch.from_pydict({"name": [name], "n_records": pa.array([n], pa.int64())})

        for b in batches:
            for row in b.to_pylist():
                page = "" if row["page_id"] is None else str(row["page_id"])
                said = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
                link = f"urn:page:{page}" if row["url"] is None else row["url"].replace("\r", "%0D").replace("\n", "%0A")
                heads = [("WARC-Type", "revisit" if row["body"] is None else "response"), ("WARC-Record-ID", f"<urn:page:{page}>"), ("WARC-Date", now), ("WARC-Target-URI", link), ("Content-Type", HTTP)]
                heads += [("WARC-Payload-Digest", f"sha1:{said}"), ("WARC-Payload-Length", str(row["n"]))]
                if row["body"] is None:
                    heads += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{row['refers_to']}>")]
                x = record(heads, b"" if row["body"] is None else http_response(row["body"].encode()))
                buf.append(x)
                size, n = size + len(x), n + 1
                if size >= most_bytes:
                    yield close()
                    buf, size, n, k = [], 0, 0, k + 1
        if buf:
            yield close()

    at, root = pafs.FileSystem.from_uri(folder)
    at.create_dir(root)
    return plan.mapInArrow(run, "name string, n_records long")


def read_archives(names: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record of the archives ``name`` below ``folder``; no names, no rows."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ident = lambda s: int(s[10:-1]) if s and s[10:-1] else None
        fs, root = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    for h, payload in records(f):
                        kind = h["warc-type"]
                        size = len(payload) if kind == "response" else int(h["warc-payload-length"])
                        rows.append((ident(h["warc-record-id"]), size, h["warc-payload-digest"].rpartition(":")[2], kind, ident(h.get("warc-refers-to"))))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    dealt = names.select("name").repartition(max(1, min(names.count(), READERS)))
    return dealt.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(spark, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes every page as a record, reads the archives back and returns one row per record; an empty table gives none."""
    ws = Workspace(spark, "warc")
    folder = f"{ws.path}/archives"
    names = ws.write(write_archives(plan_records(pages, ws, min_bytes), folder), "names")
    return read_archives(names, folder)


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, strlen(body) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(h, 1 + (i // 4) * 5, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31), 1)), '') AS payload_digest,
       CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < first THEN first END AS refers_to
FROM m
"""
