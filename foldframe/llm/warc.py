"""WARC archives: writing, normalising monolithic gzip streams, and reading by a sidecar offset index.

``write_archives`` puts one record per page into gzip streams that hold a whole file each ("monolithic": no record
can be reached without inflating all before it).  ``normalize_archives`` inflates each stream once, from front to
back, writes every record as a gzip member of its own, and beside the archive an index of (record, type, offset,
length, digest).  ``read_archives`` then reads single members by that index.

A page whose payload has at least ``least`` bytes and equals that of a page with a smaller id is a revisit of the
smallest; shorter payloads are always responses.

Files go to a folder that driver and executors share, under names of their own for each attempt of a task; only
attempts that ended are in the returned manifest, so a lost executor leaves nothing that is read.  Memory is bounded
by one record and one block of a stream.

Cases: a null payload is empty; a null address becomes the record's own name; rows without an id are left out; an
id with several rows has a record for each, decided by that row's payload; rows that repeat the smallest id of a
payload are responses too; an empty table gives no archive and an empty result; other columns are ignored.
"""

from __future__ import annotations

import csv
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, parallelism, shared_folder

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
BLOCK = 1 << 20


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI as Hadoop writes it (file:/x, hdfs://h/x, s3://b/x) and the path in it."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no payload but the length and digest of the one it stands for."""
    target = quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else f"urn:page:{page_id}"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    block = HTTP + payload
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        block = HTTP
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(raw: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in raw.decode().split("\r\n")[1:] if ": " in line)


def inflate(source) -> Iterator[bytes]:
    """Blocks of a gzip stream of any number of members."""
    unzip = zlib.decompressobj(31)
    while block := source.read(BLOCK):
        while block:
            out = unzip.decompress(block, 4 * BLOCK)
            if out:
                yield out
            if unzip.eof:
                block, unzip = unzip.unused_data, zlib.decompressobj(31)
            else:
                block = unzip.unconsumed_tail


def records(blocks: Iterator[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """(head, block) of each record of an inflated stream."""
    buffer = bytearray()
    more = iter(blocks)

    def fill(n: int) -> bool:
        while len(buffer) < n:
            block = next(more, None)
            if block is None:
                return False
            buffer.extend(block)
        return True

    while True:
        end = buffer.find(b"\r\n\r\n")
        while end < 0:
            if not fill(len(buffer) + 1):
                if buffer.strip():
                    raise ValueError("an archive ends within a record's head")
                return
            end = buffer.find(b"\r\n\r\n")
        head = bytes(buffer[:end])
        size = int(headers(head)["Content-Length"])
        if not fill(end + 4 + size + 4):
            raise ValueError("an archive ends within a record")
        yield head, bytes(buffer[end + 4 : end + 4 + size])
        del buffer[: end + 4 + size + 4]


def page_decisions(pages: DataFrame, least: int = 100, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """page_id, url, payload, digest and, for revisits, refers_to.

    Only ids and digests are grouped; a group of any size is a partial minimum per task.  What is joined to the
    payloads, on id and digest, has the rows of revisits alone; payloads move once, and only where it is too large to
    be sent to all.
    """
    rows = pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(text_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    long = rows.where(F.octet_length("payload") >= least)
    same = checkpointed(long.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("digest", "first"))
    revisits = checkpointed(long.select("page_id", "digest").join(same, "digest").where("page_id <> first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct())
    return rows.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")


def write_archives(decided: DataFrame, folder: str, level: int = 3, roll: int = 256 << 20) -> DataFrame:
    """Write monolithic archives; the manifest (path, records).  A file is closed after ``roll`` bytes of records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(folder)
        store.create_dir(base, recursive=True)
        out, path, zipped, size, count, done = None, "", None, 0, 0, []

        def close() -> None:
            out.write(zipped.flush())
            out.close()
            done.append((path, count))

        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(batch.column(c) for c in range(5)), strict=True):
                if out is None:
                    path, zipped, size, count = f"{base}/{uuid.uuid4().hex}.warc.gz", zlib.compressobj(level, zlib.DEFLATED, 31), 0, 0
                    out = store.open_output_stream(path, compression=None)
                whole = record(page_id.as_py(), url.as_py(), payload.as_buffer().to_pybytes(), digest.as_py(), refers_to.as_py())
                out.write(zipped.compress(whole))
                size, count = size + len(whole), count + 1
                if size > roll:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([c for _, c in done], pa.int64())], names=["path", "records"])

    return checkpointed(decided.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "path string, records long"))


def normalize_archives(archives: DataFrame, folder: str, level: int = 3, remove: bool = False) -> DataFrame:
    """Rewrite every archive with a gzip member for each record and write ``<archive>.idx`` beside it.

    The manifest: path, index, records.  ``remove`` deletes an archive once it has been rewritten.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(folder)
        store.create_dir(base, recursive=True)
        done = []
        for batch in batches:
            for source in batch.column(0).to_pylist():
                target, offset, lines = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, io.StringIO()
                index = csv.writer(lines)
                with store.open_input_stream(source, compression=None) as raw, store.open_output_stream(target, compression=None) as out:
                    count = 0
                    for head, block in records(inflate(raw)):
                        own = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = own.compress(head + b"\r\n\r\n" + block + b"\r\n\r\n") + own.flush()
                        out.write(member)
                        known = headers(head)
                        index.writerow([known["WARC-Record-ID"], known["WARC-Type"], offset, len(member), known.get("WARC-Payload-Digest", "")])
                        offset, count = offset + len(member), count + 1
                with store.open_output_stream(target + ".idx", compression=None) as out:
                    out.write(lines.getvalue().encode())
                done.append((source, target, target + ".idx", count))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*done, strict=True)) or [()] * 4, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["source", "path", "index", "records"])

    found = checkpointed(_one_each(archives.select("path")).mapInArrow(run, "source string, path string, index string, records long"))
    if remove:

        def clear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, _ = filesystem(folder)
            for batch in batches:
                for path in batch.column(0).to_pylist():
                    if store.get_file_info(path).type == fs.FileType.File:
                        store.delete_file(path)
                yield batch

        found.select("source").mapInArrow(clear, "source string").count()
    return found.select("path", "index", "records")


def _one_each(archives: DataFrame) -> DataFrame:
    """Deal a manifest out so that tasks have equally many archives."""
    spark = archives.sparkSession
    return archives.repartition(max(1, min(archives.count(), 4 * parallelism(spark))))


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Read every record by its index entry: page_id, payload_bytes, payload_digest, record_type, refers_to.

    The digest of a response is computed from the bytes read and must equal the record's own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(folder)
        for batch in batches:
            for path, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_stream(index, compression=None) as f:
                    entries = list(csv.reader(io.StringIO(f.read().decode())))
                rows = []
                with store.open_input_file(path) as f:
                    for _, kind, offset, length, _ in entries:
                        f.seek(int(offset))
                        rows.append(_parsed(zlib.decompress(f.read(int(length)), 31), kind))
                for a in range(0, len(rows), 10_000):
                    cols = list(zip(*rows[a : a + 10_000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return _one_each(archives.select("path", "index")).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _parsed(member: bytes, kind: str) -> tuple:
    end = member.index(b"\r\n\r\n")
    known = headers(member[:end])
    block = member[end + 4 : end + 4 + int(known["Content-Length"])]
    digest, size = known["WARC-Payload-Digest"].removeprefix("sha256:"), int(known["X-Payload-Length"])
    if known["WARC-Type"] != kind:
        raise ValueError(f"the index calls {known['WARC-Record-ID']} a {kind}")
    name = lambda v: int(v.removeprefix("<urn:page:").removesuffix(">"))
    if kind == "response":
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
        if known["WARC-Payload-Digest"] != f"sha256:{digest}":
            raise ValueError(f"{known['WARC-Record-ID']} does not have the payload that its digest names")
    return name(known["WARC-Record-ID"]), size, digest, kind, name(known["WARC-Refers-To"]) if kind == "revisit" else None


def archive_round_trip(pages: DataFrame, least: int = 100) -> DataFrame:
    """Write, normalise and read back: one row for each page."""
    folder = shared_folder(pages.sparkSession, "warc")
    whole = write_archives(page_decisions(pages, least), f"{folder}/whole")
    return read_archives(normalize_archives(whole, f"{folder}/members", remove=True), folder)
