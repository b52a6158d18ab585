"""WARC archives: whole-file gzip streams rewritten as one gzip member per record, with an offset index.

``write_monolithic`` writes page records into archives that are one gzip stream each. ``normalise`` inflates such a stream once, from
front to end, and rewrites every record as a member of its own; records whose payload an earlier page has become revisits. Beside each archive lies
a sidecar index (offset, length, type, record id, digest by line), and the same index is returned as a table. ``read_back`` fetches every record by
its offset alone and checks payload digests.

Files live under the shared folder and are opened through Arrow's file systems (local, HDFS, S3, GCS). A task writes names of its own; only
files named in the committed table count, so a lost executor or a second attempt leaves at most unused files.

Defined results: null html is an empty payload; a null url leaves out the target header; a row with a null id is a response; repeated rows
repeat as records, and a repeat of the smallest id is a response too.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callstrata.llm.text import batches_of_bytes, staged
from callstrata.session import shared_dir

LEAST_BYTES = 100
#: An archive is closed beyond so many payload bytes or records.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 64 << 20, 50_000
LEVEL = 3
MOST_TASKS = 20_000
CHUNK = 1 << 18
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def record_id(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def header(kind: str, page_id, url: str | None, size: int, digest: str, content: int, refers_to=None) -> bytes:
    """Header of a record with a block of ``content`` bytes."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}", "Content-Type: application/http;msgtype=response", f"Content-Length: {content}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def http_head(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def fields(head: bytes) -> dict[str, str]:
    """Fields of a record's header."""
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)


class Archive:
    """A file that is one gzip stream."""

    def __init__(self, folder: str, level: int):
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        system, name = opened(self.path)
        self.out, self.deflate = system.open_output_stream(name, compression=None), zlib.compressobj(level, zlib.DEFLATED, 31)
        self.bytes = self.records = 0

    def add(self, *parts: bytes) -> None:
        for part in parts:
            self.out.write(self.deflate.compress(part))
            self.bytes += len(part)
        self.records += 1

    def close(self) -> None:
        self.out.write(self.deflate.flush())
        self.out.close()


RECORDS = "archive string, seq int, page string, payload_bytes long, payload_digest string"


def write_monolithic(pages: DataFrame, folder: str, level: int = LEVEL) -> DataFrame:
    """(archive, seq, page, payload_bytes, payload_digest): a row per record written. No page leaves its partition."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, name = opened(folder)
        system.create_dir(name, recursive=True)
        archive = None
        for batch in batches:
            rows = []
            for page, url, html in zip(batch.column("page").to_pylist(), batch.column("url").to_pylist(), batches_of_bytes(batch.column("html")), strict=True):
                if archive is None or archive.bytes > ARCHIVE_BYTES or archive.records >= ARCHIVE_RECORDS:
                    if archive is not None:
                        archive.close()
                    archive = Archive(folder, level)
                body = html or b""
                digest = hashlib.sha256(body).hexdigest()
                head = http_head(len(body))
                rows.append((archive.path, archive.records, page, len(body), digest))
                archive.add(header("response", page, url, len(body), digest, len(head) + len(body)), head, body, b"\r\n\r\n")
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string()), strict=True)],
                ["archive", "seq", "page", "payload_bytes", "payload_digest"])
        if archive is not None:
            archive.close()

    return pages.select(F.col("page_id").cast("string").alias("page"), F.col("url").cast("string").alias("url"), "html").mapInArrow(write, RECORDS)


def inflated(path: str) -> Iterator[tuple[bytes, bytes]]:
    """(header, block) of the records of a gzip file, which is read once as a stream. Several members in a row are read as one."""
    system, name = opened(path)
    buffer, inflate = bytearray(), zlib.decompressobj(31)
    with system.open_input_stream(name, compression=None) as source:
        def more() -> bool:
            nonlocal inflate
            raw = source.read(CHUNK)
            if not raw:
                return False
            while raw:
                if inflate.eof:
                    inflate = zlib.decompressobj(31)
                buffer.extend(inflate.decompress(raw))
                raw = inflate.unused_data
            return True

        while True:
            end = buffer.find(b"\r\n\r\n") + 4
            if end < 4:
                if more():
                    continue
                if buffer:
                    raise ValueError(f"{path}: the last header is cut")
                return
            need = end + int(fields(bytes(buffer[:end]))["Content-Length"]) + 4
            while len(buffer) < need:
                if not more():
                    raise ValueError(f"{path}: the last record is cut")
            yield bytes(buffer[:end]), bytes(buffer[end:need - 4])
            del buffer[:need]


INDEX = "archive string, position long, length long, seq int"


def normalise(archives: DataFrame, level: int = LEVEL) -> DataFrame:
    """archives: (archive, again: array of (seq, first)), the records that repeat the payload of page ``first``. Returns the offset index."""
    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, again in zip(batch.column("archive").to_pylist(), batch.column("again").to_pylist(), strict=True):
                first = {x["seq"]: x["first"] for x in again or []}
                target = source.removesuffix(".warc.gz") + f"-{uuid.uuid4().hex[:8]}.members.warc.gz"
                system, name = opened(target)
                rows, lines, at = [], [], 0
                with system.open_output_stream(name, compression=None) as out:
                    for seq, (head, block) in enumerate(inflated(source)):
                        f = fields(head)
                        kind = "response"
                        if seq in first:
                            kind, page = "revisit", f["WARC-Record-ID"].removeprefix("<urn:page:").removesuffix(">")
                            block = block[:block.index(b"\r\n\r\n") + 4]
                            head = header(kind, page, None, int(f["X-Payload-Length"]), f["WARC-Payload-Digest"].removeprefix("sha256:"), len(block), first[seq])
                            if "WARC-Target-URI" in f:
                                head = head.replace(b"WARC-Profile:", b"WARC-Target-URI: " + f["WARC-Target-URI"].encode() + b"\r\nWARC-Profile:", 1)
                        deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = deflate.compress(head) + deflate.compress(block) + deflate.compress(b"\r\n\r\n") + deflate.flush()
                        out.write(member)
                        rows.append((target, at, len(member), seq))
                        lines.append(f"{at} {len(member)} {kind} {f['WARC-Record-ID']} {f['WARC-Payload-Digest']}\n")
                        at += len(member)
                with system.open_output_stream(name + ".idx", compression=None) as out:
                    out.write("".join(lines).encode())
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["archive", "position", "length", "seq"])

    return archives.select("archive", "again").mapInArrow(rewrite, INDEX)


def by_archive(rows: DataFrame) -> DataFrame:
    """Rows with those of an archive together, in about as many partitions as there are archives: the rows are few bytes, the work is in the files."""
    n = rows.select("archive").distinct().count()
    return rows.repartition(max(1, min(n, MOST_TASKS)), "archive")


READ = "page string, payload_bytes long, payload_digest string, record_type string, refers string"


def read_back(index: DataFrame) -> DataFrame:
    """Every record of the index, fetched by its offset. A payload that differs from its digest is an error."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, source = None, None
        for batch in batches:
            rows = []
            for archive, at, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "position", "length")), strict=True):
                if archive != path:
                    if source is not None:
                        source.close()
                    system, name = opened(archive)
                    path, source = archive, system.open_input_file(name)
                source.seek(at)
                whole = zlib.decompress(source.read(length), 31)
                end = whole.index(b"\r\n\r\n") + 4
                f = fields(whole[:end])
                block = whole[end:end + int(f["Content-Length"])]
                digest = f["WARC-Payload-Digest"].removeprefix("sha256:")
                size = int(f["X-Payload-Length"])
                if f["WARC-Type"] == "response":
                    body = block[block.index(b"\r\n\r\n") + 4:]
                    if len(body) != size or hashlib.sha256(body).hexdigest() != digest:
                        raise ValueError(f"{archive}: the payload at {at} differs from its digest")
                bare = lambda x: x.removeprefix("<urn:page:").removesuffix(">") or None
                rows.append((bare(f["WARC-Record-ID"]), size, digest, f["WARC-Type"], bare(f.get("WARC-Refers-To", ""))))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)],
                ["page", "payload_bytes", "payload_digest", "record_type", "refers"])
        if source is not None:
            source.close()

    return by_archive(index).sortWithinPartitions("archive", "position").mapInArrow(read, READ)


def archive_pages(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes the pages, normalises the archives under ``folder`` and returns the offset index as a table."""
    kind = pages.schema["page_id"].dataType
    written = staged(write_monolithic(pages, folder))
    large = written.filter((F.col("payload_bytes") >= least_bytes) & F.col("page").isNotNull())
    firsts = large.groupBy("payload_digest").agg(F.min(F.col("page").cast(kind)).cast("string").alias("first"))
    again = large.join(firsts, "payload_digest").filter("page <> first").groupBy("archive").agg(F.collect_list(F.struct("seq", "first")).alias("again"))
    # an archive holds at most ARCHIVE_RECORDS records, which bounds its list
    archives = staged(written.select("archive").distinct().join(again, "archive", "left"))
    return staged(normalise(by_archive(archives)))


def op7_warc_members(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    kind = pages.schema["page_id"].dataType
    got = read_back(archive_pages(pages, shared_dir(spark, "warc")))
    return got.select(
        F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers").cast(kind).alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p WHERE payload_bytes >= 100 AND page_id IS NOT NULL GROUP BY h)
SELECT page_id, payload_bytes, sha256(p.h) AS payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.h = f.h
"""
