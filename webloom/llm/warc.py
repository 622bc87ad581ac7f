"""WARC archives as chunked record tables.

``write`` stores one record per row (response, or revisit of an earlier response with the same payload) in
gzip archives, a member per record, and returns the table of archives. ``read`` streams archives back as a
table of chunks: record identifier, chunk number, bytes, and the payload's incremental SHA-1 after this
chunk, so that a record of any size passes through in pieces of ``chunk_bytes`` and its last row carries
its size and digest. No record is held as a whole by the reader; the writer compresses in such pieces too.

Archives lie in the shared folder the session names (any file system that ``pyarrow.fs`` opens by URI);
a failed task's file is not in the table of archives, so it is never read.

Cases: null payload is empty; rows with a null identifier are always responses; of rows that share both
identifier and payload all are kept as written, the ones with the group's smallest identifier being
responses (and sharing a record name). Payloads shorter than ``least_bytes`` are never revisits. A null or odd URL is written
percent-encoded. Other columns are ignored. An empty table gives no archives and an empty chunk table.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

_CHUNKS = (
    "archive string, record long, page_id long, record_type string, refers_to long, chunk long, is_last boolean, "
    "payload_bytes long, payload_digest string, declared_digest string, data binary"
)
_EPOCH = "1970-01-01T00:00:00Z"


def _open(uri: str, mode: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        path = uri[5:] if not uri.startswith("file://") else uri[7:]
        system = fs.LocalFileSystem()
    else:
        system, path = fs.FileSystem.from_uri(uri)
    if mode == "w":
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        return system.open_output_stream(path, compression=None)
    return system.open_input_stream(path, compression=None)


def with_revisits(pages: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url", least_bytes: int = 0) -> DataFrame:
    """key, url, payload, digest (hex SHA-1) and refers_to: the group's smallest key, null for a response.

    Payloads move once, by key; groups of equal payloads, however large, only as (key, digest) pairs."""
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"))
    raw = F.col("payload").cast("binary")
    marks = rows.filter("page_id is not null").filter(F.octet_length("payload") >= least_bytes).select("page_id", F.sha1(raw).alias("digest"))
    first = marks.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).filter("first < last").select("digest", "first")
    later = marks.distinct().join(first, "digest").filter("page_id > first").select("page_id", "digest", F.col("first").alias("refers_to"))
    return rows.withColumn("digest", F.sha1(raw)).join(later, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")


def _record_id(page_id, digest: str, place: str) -> str:
    """A record's name by its page and payload; records without a page are named by their place."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}' if page_id is not None else place)}>"


def write(records: DataFrame, folder: str, archive_bytes: int = 1 << 30, chunk_bytes: int = 1 << 20, level: int = 6) -> DataFrame:
    """Write with_revisits() rows as WARC files below folder; a row per archive: path, records, bytes."""
    shared.tune(records.sparkSession)

    def run(batches):
        out, path, size, count = None, "", 0, 0

        def emit(pieces):
            nonlocal size
            codec = zlib.compressobj(level, zlib.DEFLATED, 31)
            for piece in pieces:
                for at in range(0, len(piece), chunk_bytes):
                    got = codec.compress(piece[at : at + chunk_bytes])
                    size += len(got)
                    out.write(got)
            got = codec.flush()
            size += len(got)
            out.write(got)

        def closed():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])

        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("page_id", "url", "digest", "refers_to")]
            at, data = shared.offsets_of(batch["payload"])
            view = memoryview(data)
            for i, (page, url, digest, refers) in enumerate(zip(*columns)):
                if out is None:
                    path, size, count = f"{folder}/part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = _open(path, "w")
                    info = b"software: webloom\r\nformat: WARC File Format 1.1\r\n"
                    emit([b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:%s>\r\nWARC-Date: %s\r\nContent-Type: application/warc-fields\r\nContent-Length: %d\r\n\r\n" % (str(uuid.uuid4()).encode(), _EPOCH.encode(), len(info)), info, b"\r\n\r\n"])
                payload = view[int(at[i]) : int(at[i + 1])]
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
                kind = "response" if refers is None else "revisit"
                body = len(http) + (len(payload) if refers is None else 0)
                head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(page, digest, f'{path}:{count}')}", f"WARC-Date: {_EPOCH}", f"WARC-Target-URI: {quote(url or 'about:blank', safe=':/?#[]@!$&()*+,;=%~-._')}"]
                head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
                if page is not None:
                    head.append(f"X-Page-Id: {page}")
                if refers is not None:
                    head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers, digest, path)}", f"X-Refers-To-Page-Id: {refers}"]
                head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {body}", "", ""]
                emit(["\r\n".join(head).encode(), http, *([payload] if refers is None else []), b"\r\n\r\n"])
                count += 1
                if size >= archive_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return records.mapInArrow(run, "path string, records long, bytes long")


class _Stream:
    """Bytes of a gzip file with many members, by line or by count."""

    def __init__(self, raw, chunk: int):
        self.raw, self.chunk, self.buffer, self.codec, self.rest = raw, chunk, b"", zlib.decompressobj(31), b""

    def more(self) -> bool:
        while True:
            if self.codec.eof:
                rest = self.codec.unused_data
                self.codec = zlib.decompressobj(31)
            else:
                rest = self.codec.unconsumed_tail
            if not rest:
                rest = self.raw.read(1 << 16)
                if not rest:
                    return False
            got = self.codec.decompress(rest, self.chunk)
            if got:
                self.buffer += got
                return True

    def line(self) -> bytes | None:
        while b"\n" not in self.buffer:
            if not self.more():
                return None
        line, _, self.buffer = self.buffer.partition(b"\n")
        return line.rstrip(b"\r")

    def pieces(self, size: int, chunk: int):
        """`size` bytes in pieces of `chunk` (the last may be shorter)."""
        while size:
            want = min(size, chunk)
            while len(self.buffer) < want:
                if not self.more():
                    raise EOFError("truncated archive")
            yield self.buffer[:want]
            self.buffer = self.buffer[want:]
            size -= want


def chunks_of(raw, chunk_bytes: int):
    """(headers, http headers, chunk number, bytes, last?, bytes so far, sha1 so far) of each record but warcinfo."""
    stream = _Stream(raw, chunk_bytes)
    while True:
        line = stream.line()
        while line == b"":
            line = stream.line()
        if line is None:
            return
        head: dict[str, str] = {}
        while line := stream.line():
            name, _, value = line.partition(b":")
            head[name.decode().lower()] = value.strip().decode()
        left = int(head["content-length"])
        if head["warc-type"] not in ("response", "revisit", "resource"):
            for _ in stream.pieces(left, chunk_bytes):
                pass
            continue
        http: dict[str, str] = {}
        if head.get("content-type", "").startswith("application/http"):
            while line := stream.line():
                left -= len(line) + 2
                name, _, value = line.partition(b":")
                http[name.decode().lower()] = value.strip().decode()
            left -= 2
        digest, done, number = hashlib.sha1(), 0, 0
        if not left:
            yield head, http, 0, b"", True, 0, digest.digest()
        for piece in stream.pieces(left, chunk_bytes):
            digest.update(piece)
            done += len(piece)
            yield head, http, number, piece, done == left, done, digest.digest()
            number += 1


def read(archives: DataFrame, chunk_bytes: int = 1 << 20, with_data: bool = True, batch_bytes: int = 8 << 20) -> DataFrame:
    """The chunk table of archives(path): rows of a record are numbered from 0, in file order.

    payload_bytes and payload_digest are those of the payload up to and with this chunk; a revisit's one
    chunk has no data and carries the full payload's size and digest, as its record declares them."""

    def run(batches):
        for batch in batches:
            for path in batch["path"].to_pylist():
                rows, size, record = [], 0, -1
                with _open(path, "r") as raw:
                    for head, http, number, piece, last, done, digest in chunks_of(raw, chunk_bytes):
                        record += number == 0
                        revisit = head["warc-type"] == "revisit"
                        told = head.get("warc-payload-digest", "").removeprefix("sha1:")
                        page, refers = head.get("x-page-id"), head.get("x-refers-to-page-id")
                        total = int(http.get("content-length", 0)) if revisit else done
                        mark = told if revisit else base64.b32encode(digest).decode()
                        rows.append((path, record, page and int(page), head["warc-type"], refers and int(refers), number, last, total, mark, told, piece if with_data else None))
                        size += len(piece) if with_data else 64
                        if size >= batch_bytes or len(rows) >= 4096:
                            yield shared_rows(rows)
                            rows, size = [], 0
                if rows:
                    yield shared_rows(rows)

    return archives.mapInArrow(run, _CHUNKS)


def shared_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [f.split() for f in _CHUNKS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


def round_trip(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, chunk_bytes: int = 1 << 20, with_data: bool = True) -> DataFrame:
    """Write pages(page_id, url, html) as archives, and the chunk table read back from them."""
    spark: SparkSession = pages.sparkSession
    folder = folder or shared.fresh_path(spark, "warc")
    archives = shared.materialize(write(with_revisits(pages, least_bytes=least_bytes), folder), "archives")
    return read(archives.repartition(shared.shuffle_partitions(spark)), chunk_bytes, with_data)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record, from its last chunk: no shuffle, as digests and sizes are incremental. digest_ok tells
    whether a response's bytes have the digest its record declares; a revisit has no bytes, and digest_ok is null."""
    return chunks.filter("is_last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.when(F.col("record_type") != "revisit", F.col("payload_digest") == F.col("declared_digest")).alias("digest_ok"))
