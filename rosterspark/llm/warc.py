"""WARC archives as a chunked record table.

Writing: a task streams its records into archive files in the shared folder, each record a gzip member, payloads slice by
slice. A file's name is new in every attempt and only the manifest of tasks that succeeded is kept, so a repeated task
leaves no trace. Reading: a task streams a file and gives a row per chunk: record, chunk number, bytes, and the digest
and length of the payload so far. No record is held whole, and a record's last chunk carries its digest.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, new_path

#: Payloads of at least so many bytes may be revisits; bytes in a chunk; bytes after which a new archive begins.
REVISIT_BYTES, CHUNK_BYTES, ARCHIVE_BYTES = 100, 1 << 20, 256 << 20
#: Tasks that read archives; beyond so many, a task reads several.
MOST_READERS = 20_000
#: All records carry one date, so that equal inputs give equal archives.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK_SCHEMA = "record_id string, record_type string, refers_to string, target_uri string, payload_digest string, chunk long, last boolean, data binary, digest_so_far string, bytes_so_far long"


def record_plan(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, refers_to): ``refers_to`` is set on revisits.

    Of equal payloads of ``REVISIT_BYTES`` or more the smallest ``page_id`` is the response (rows that repeat it are
    responses too; a null id never is one if another id is there). Only digests and ids are grouped.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    first = rows.where(F.octet_length("html") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").drop("n")
    first = materialize(first, "first")
    return rows.join(first, "digest", "left").select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def _record_id(page_id: object) -> str:
    """A record's name: percent-encoded, as an id may be any text; ``<urn:page>`` for a null id."""
    return "<urn:page>" if page_id is None else f"<urn:page:{quote(str(page_id), safe='')}>"


def _header(page_id: object, url: str | None, digest: str, refers_to: object, size: int) -> tuple[bytes, bytes]:
    """The record's header and the head of its block."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or _record_id(page_id)[1:-1]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines.append(f"Content-Length: {len(head) + (size if refers_to is None else 0)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n", head


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record for each row of ``pages(page_id, url, html)`` below ``folder``; returns (path, records), a row per archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        out, name, count, written = None, "", 0, 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.record_batch([pa.array([name]), pa.array([count], pa.int64())], names=["path", "records"])

        for b in batches:
            for page_id, url, html, digest, refers_to in zip(*b.columns, strict=True):
                if out is None:
                    name, count, written = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(f"{root}/{name.rpartition('/')[2]}", compression=None)
                payload = memoryview(html.as_buffer())
                header, head = _header(page_id.as_py(), url.as_py(), digest.as_py(), refers_to.as_py(), len(payload))
                member = zlib.compressobj(wbits=31)
                out.write(member.compress(header + head))
                if refers_to.as_py() is None:
                    for at in range(0, len(payload), CHUNK_BYTES):
                        out.write(member.compress(payload[at : at + CHUNK_BYTES]))
                out.write(member.compress(b"\r\n\r\n") + member.flush())
                count, written = count + 1, written + len(payload)
                if written >= ARCHIVE_BYTES:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return materialize(record_plan(pages).mapInArrow(run, "path string, records long"), "manifest")


def _fields(stream: io.BufferedReader) -> dict[str, str] | None:
    """The header fields up to the blank line, by lower-case name; None at the end of the stream."""
    first = stream.readline()
    if not first:
        return None
    found = {"": first.decode().strip()}
    while line := stream.readline().decode().strip():
        name, _, value = line.partition(":")
        found[name.lower()] = value.strip()
    return found


def read_chunks(stream: io.BufferedReader, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple]:
    """Rows of ``CHUNK_SCHEMA`` from an uncompressed record stream; an empty payload has one empty chunk."""
    while (fields := _fields(stream)) is not None:
        if not fields[""].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {fields['']!r}")
        left = int(fields["content-length"])
        if fields.get("content-type", "").startswith("application/http"):
            while (line := stream.readline()).strip():
                left -= len(line)
            left -= len(line)
        digest, size, chunk = hashlib.sha256(), 0, 0
        while True:
            data = stream.read(min(chunk_bytes, left))
            if len(data) < min(chunk_bytes, left):
                raise ValueError(f"record {fields['warc-record-id']} is cut short")
            digest.update(data)
            size, left = size + len(data), left - len(data)
            yield (fields["warc-record-id"], fields["warc-type"], fields.get("warc-refers-to"), fields.get("warc-target-uri"), fields.get("warc-payload-digest", "").removeprefix("sha256:"), chunk, not left, data, digest.hexdigest(), size)
            chunk += 1
            if not left:
                break
        stream.read(4)


def read_archives(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """The chunk table of the archives in ``manifest(path)``, a file per task up to ``MOST_READERS``.

    Archives are written and read by pyarrow's file systems, so the shared folder must be one that they open (a mounted
    path, hdfs, s3, gs, abfs).
    """
    paths = manifest.select("path")
    names = [x.split(":")[0].split(" ")[0] for x in CHUNK_SCHEMA.split(", ")]
    types = [pa.string()] * 5 + [pa.int64(), pa.bool_(), pa.binary(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for b in batches:
            for path in b.column(0):
                files, at = fs.FileSystem.from_uri(path.as_py())
                rows, size = [], 0
                with files.open_input_stream(at, compression=None) as raw, io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 16) as stream:
                    for row in read_chunks(stream):
                        rows.append(row)
                        size += len(row[7]) + 256
                        if size >= 4 * CHUNK_BYTES:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    return paths.repartition(min(max(1, paths.count()), MOST_READERS)).mapInArrow(run, CHUNK_SCHEMA)


def records(chunks: DataFrame) -> DataFrame:
    """A row per record: its id, type, what it refers to, the full payload's length and digest, and the chunks it has.

    A revisit has the length and digest of the response that it refers to.
    """
    own = chunks.where("last").select("record_id", "record_type", "refers_to", "payload_digest", F.col("digest_so_far").alias("digest"), F.col("bytes_so_far").alias("size"), (F.col("chunk") + 1).alias("chunks"))
    own = materialize(own, "records")
    there = own.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to"), F.col("digest").alias("payload_digest")).agg(F.max("size").alias("full"))
    there = materialize(there, "responses")  # so that a join can split the revisits of a hot payload
    full = own.join(there, ["refers_to", "payload_digest"], "left")
    is_response = F.col("record_type") == "response"
    return full.select("record_id", "record_type", "refers_to", F.when(is_response, F.col("size")).otherwise(F.col("full")).alias("payload_bytes"), F.when(is_response, F.col("digest")).otherwise(F.col("payload_digest")).alias("payload_digest"), "chunks")


def warc_round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as archives, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, chunks.

    A null html is empty, a null url becomes a name made of the id, a null id a name without one. Ids may be of any type
    that Spark casts from text. Repeated rows are a record each. Other columns are ignored. An empty table gives an empty result.
    """
    spark, kind = pages.sparkSession, pages.schema["page_id"].dataType.simpleString()
    manifest = write_archives(pages, folder or new_path(spark, "archives"))
    page = lambda c: F.when(F.col(c).startswith("<urn:page:"), F.try_url_decode(F.expr(f"substring({c}, 11, length({c}) - 11)"))).try_cast(kind)
    return records(read_archives(spark, manifest)).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), "chunks")
