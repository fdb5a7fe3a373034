"""WARC archives: written with an index of their records, read back by coalesced byte ranges.

Method: index first. Every record is its own gzip member; while it is written, file, offset, length,
URL and digest go to the index. A reader selects index rows, brings those of one stretch of a file
together in order of offset, and reads neighbours with one ranged request.

Archives go to the shared folder through pyarrow's file systems. A retried task writes files of its
own, and only the index rows of the attempt that succeeded name a file, so lost executors leave
unused files at worst.

Defined results: a null html is an empty payload. Payloads under ``least`` bytes are responses. Among
equal longer payloads, rows with the largest page_id are responses, also if that id is repeated; if no
copy has an id, all are responses; a row without id is otherwise a revisit. A null url is left out of
the record; control characters in a url are percent-encoded there. An empty table gives no rows; other
columns of the input are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from ruletrace.llm.common import settled, shared_path, table, utf8

LEAST_BYTES = 1000
FILE_BYTES = 256 << 20   # an archive is closed when it has so many bytes
STRETCH = 8 << 20       # index rows of one stretch of a file are read by one task
GAP, READ_BYTES = 64 << 10, 8 << 20
DATE = "1970-01-01T00:00:00Z"
INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    path = re.sub(r"^file:/+", "file:///", path)
    path = re.sub(r"^s3[an]://", "s3://", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def with_keepers(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload, digest and keeper: the page_id that equal payloads refer to, null without copies."""
    payload = utf8(F.col("html"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        payload.alias("payload"), F.sha1(payload).alias("digest"))
    keepers = settled(rows.where(F.octet_length("payload") >= least)
                      .groupBy(F.col("digest").alias("of")).agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
                      .where("n > 1").drop("n"), "warc-keepers")
    # Equal payloads may be a third of all rows: both sides are shuffled as they are, so the join can be split.
    return rows.join(keepers, rows["digest"] == keepers["of"], "left").drop("of")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, keeper: int | None) -> tuple[bytes, str]:
    """The bytes of one record before compression, and its type."""
    revisit = keeper is not None and keeper != page_id
    kind = "revisit" if revisit else "response"
    labelled = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}",
            f"WARC-Payload-Digest: {labelled}", "Content-Type: application/http; msgtype=response",
            f"Content-Length: {len(block)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:page:{keeper}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", kind


def write(pages: DataFrame, folder: str, least: int = LEAST_BYTES) -> DataFrame:
    """Write one record per row of ``pages`` (page_id, url, html) below ``folder``; the index of the records."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, top = opened(folder)
        out, name, at, rows = None, "", 0, []

        def index() -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                              ["file", "offset", "length", "url", "digest", "page_id", "record_type"])

        for batch in batches:
            for page_id, url, payload, digest, keeper in zip(*(batch.column(i) for i in range(5)), strict=True):
                if out is None:
                    where.create_dir(top, recursive=True)
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = where.open_output_stream(f"{top}/{name}", compression=None)
                raw, kind = record(page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), keeper.as_py())
                member = gzip.compress(raw, 6, mtime=0)
                out.write(member)
                rows.append((f"{folder}/{name}", at, len(member), url.as_py(), digest.as_py(), page_id.as_py(), kind))
                at += len(member)
                if at >= FILE_BYTES:
                    out.close()
                    yield index()
                    out, rows = None, []
        if out is not None:
            out.close()
            yield index()

    return settled(with_keepers(pages, least).mapInArrow(run, INDEX), "warc-index")


def parsed(member: bytes) -> tuple[int | None, int, str, str, int | None, str | None, bytes]:
    """page_id, payload length, digest, type, refers_to, uri and payload of one record; its digest is checked."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")

    def page(name: str) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(name, ""))
        return int(found[1]) if found else None

    return page("WARC-Record-ID"), n, digest, kind, page("WARC-Refers-To"), fields.get("WARC-Target-URI"), payload


def ranges(rows: list[tuple[str, int, int]], gap: int = GAP, most: int = READ_BYTES) -> Iterator[tuple[str, int, int, list[int]]]:
    """(file, start, stop, row numbers): sorted neighbours of a file joined over gaps of at most ``gap`` bytes."""
    now: tuple[str, int, int, list[int]] | None = None
    for i, (file, offset, length) in enumerate(rows):
        if now and now[0] == file and offset - now[2] <= gap and offset + length - now[1] <= most:
            now = (file, now[1], max(now[2], offset + length), [*now[3], i])
        else:
            if now:
                yield now
            now = (file, offset, offset + length, [i])
    if now:
        yield now


READ = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
        "target_uri string, payload binary")


def read(selected: DataFrame, payload: bool = True) -> DataFrame:
    """The records that index rows (file, offset, length) name. Without ``payload`` that column is null."""
    names = [c.split(" ")[0] for c in READ.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, source = None, None
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            for name, start, stop, members in ranges(rows):
                if name != file:
                    where, path = opened(name)
                    file, source = name, where.open_input_file(path)
                source.seek(start)
                stretch = source.read(stop - start)
                found = [parsed(stretch[rows[i][1] - start:rows[i][1] - start + rows[i][2]]) for i in members]
                found = found if payload else [(*f[:6], None) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)

    # Index rows are few bytes for what they make a task read, so the number of tasks comes from the lengths.
    size = selected.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    return (selected.select("file", "offset", "length")
            .repartition(1 + 2 * int(size) // STRETCH, F.col("file"), F.floor(F.col("offset") / STRETCH))
            .sortWithinPartitions("file", "offset").mapInArrow(run, READ))


def op1_warc(spark, sf_dir):
    index = write(table(spark, sf_dir, "pages"), shared_path(spark, "warc"))
    return read(index, payload=False).drop("payload")


ORACLE = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, url, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
k AS (SELECT payload_digest, max(page_id) AS keeper FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to,
       url AS target_uri
FROM d LEFT JOIN k USING (payload_digest)
"""
