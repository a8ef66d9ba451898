"""Operator 10: WARC as a chunked record table.

A payload never stands in memory as a whole: read_chunks() and write_chunks() hold one chunk and a running
digest. A record becomes rows of (record_id, chunk_no, payload piece, digest of the payload so far), and
such rows become a record. Only write_warc(), which starts from whole pages in cells, has what Spark hands it.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of payload in a row.
CHUNK = 64 * 1024
#: Payload bytes that one Arrow batch of rows may gather.
BATCH = 4 << 20
_FIELDS = (
    ("path", pa.string()), ("record_no", pa.int64()), ("record_id", pa.string()), ("warc_type", pa.string()),
    ("target_uri", pa.string()), ("content_type", pa.string()), ("content_length", pa.int64()), ("chunk_no", pa.int64()),
    ("byte_offset", pa.int64()), ("n_bytes", pa.int64()), ("is_last", pa.bool_()), ("sha256", pa.string()),
    ("digest_ok", pa.bool_()), ("error", pa.string()), ("payload", pa.binary()),
)
_SQL = {pa.string(): "string", pa.int64(): "bigint", pa.bool_(): "boolean", pa.binary(): "binary"}
CHUNK_SCHEMA = ", ".join(f"{n} {_SQL[t]}" for n, t in _FIELDS)


class _Members:
    """Reads a file, gunzipping member after member if it is compressed, a bounded piece at a time."""

    def __init__(self, raw: BinaryIO) -> None:
        self.raw, self.pending, self.gz = raw, b"", None
        head = raw.read(2)
        self.back = head
        if head == b"\x1f\x8b":
            self.gz = zlib.decompressobj(31)

    def _more(self, n: int) -> bytes:
        x, self.back = self.back, b""
        return x + self.raw.read(n)

    def read(self, n: int) -> bytes:
        """At most n bytes; empty at the end only."""
        if self.gz is None:
            return self._more(n)
        while True:
            if self.gz.eof:
                self.pending = self.gz.unused_data or self._more(n)
                if not self.pending:
                    return b""
                self.gz = zlib.decompressobj(31)
            source = self.pending or self.gz.unconsumed_tail or self._more(n)
            self.pending = b""
            if not source:
                raise EOFError("the compressed file is cut off")
            if out := self.gz.decompress(source, n):
                return out


class _Buffered:
    """Lines and pieces of a stream, over a small buffer."""

    def __init__(self, stream: _Members, step: int = 1 << 18) -> None:
        self.stream, self.step, self.buf, self.at = stream, step, b"", 0

    def _fill(self) -> bool:
        more = self.stream.read(self.step)
        self.buf, self.at = self.buf[self.at :] + more, 0
        return bool(more)

    def line(self) -> bytes:
        """Through the next line feed, whatever its length; the rest at the end."""
        parts = []
        while True:
            end = self.buf.find(b"\n", self.at)
            parts.append(self.buf[self.at : end + 1] if end >= 0 else self.buf[self.at :])
            self.at = end + 1 if end >= 0 else len(self.buf)
            if end >= 0 or not self._fill():
                return b"".join(parts)

    def skip_line(self) -> None:
        """Past the next line feed, without keeping what is before it."""
        while (end := self.buf.find(b"\n", self.at)) < 0:
            self.at = len(self.buf)
            if not self._fill():
                return
        self.at = end + 1

    def starts(self, mark: bytes) -> bool:
        """Whether mark comes next."""
        while len(self.buf) - self.at < len(mark) and self._fill():
            pass
        return self.buf.startswith(mark, self.at)

    def ended(self) -> bool:
        return self.at == len(self.buf) and not self._fill()

    def piece(self, n: int) -> bytes:
        """n bytes, or fewer at the end of the stream."""
        while len(self.buf) - self.at < n and self._fill():
            pass
        out = self.buf[self.at : self.at + n]
        self.at += len(out)
        return out


#: Bytes of the digests that records state.
_DIGESTS = {"md5": 16, "sha1": 20, "sha256": 32, "sha512": 64}


def _claimed(header: dict[str, str]) -> tuple[str, str] | None:
    """(algorithm, hex digest) that the record states for its block, in hex or base 32; None if there is none to compare."""
    name, _, value = header.get("warc-block-digest", "").partition(":")
    name, value = name.strip().lower().replace("-", ""), value.strip()
    size = _DIGESTS.get(name)
    if size is None:
        return None
    raw = value.rstrip("=").upper()
    for text, whole, decode in ((value, 2 * size, bytes.fromhex), (raw, -(-8 * size // 5), lambda x: base64.b32decode(x + "=" * (-len(x) % 8)))):
        try:
            if len(text) == whole:
                return name, decode(text).hex()
        except ValueError:
            continue
    return None


def records(raw: BinaryIO, chunk_bytes: int = CHUNK) -> Iterator[dict]:
    """Chunk rows of a WARC stream, plain or gzipped.

    A record without payload has one row of no bytes. A faulty record has a row whose `error` says why;
    reading goes on at the next line that begins with WARC/. What is cut off, or can't be decompressed,
    ends the stream with such a row; what came before it stays.
    """
    number, row = -1, {}
    try:
        stream = _Buffered(_Members(raw))
        while True:
            while stream.starts(b"\r\n") or stream.starts(b"\n"):
                stream.line()
            if stream.ended():
                return
            number += 1
            row = {"record_no": number, "chunk_no": 0, "byte_offset": 0, "n_bytes": 0, "is_last": True}
            try:
                yield from _record(stream, row, chunk_bytes)
            except ValueError as e:
                yield row | {"error": str(e), "n_bytes": 0, "is_last": True}
                while not stream.starts(b"WARC/"):
                    stream.skip_line()
                    if stream.ended():
                        return
    except (EOFError, zlib.error) as e:
        yield row | {"error": str(e), "n_bytes": 0, "is_last": True}


def _record(stream: _Buffered, row: dict, chunk_bytes: int) -> Iterator[dict]:
    """Chunk rows of the record that comes next; row is filled with what its header says."""
    if not stream.starts(b"WARC/"):
        raise ValueError("no WARC version where a record should begin")
    stream.line()
    header: dict[str, list[str]] = {}
    last = None
    while (line := stream.line()) not in (b"\r\n", b"\n"):
        if not line:
            raise EOFError("the header is cut off")
        if line[:1] in b" \t" and last:
            header[last].append(line.decode("utf-8", "replace").strip())
            continue
        name, _, value = line.decode("utf-8", "replace").partition(":")
        last = name.strip().lower()
        header[last] = [value.strip()]
    fields = {k: " ".join(v) for k, v in header.items()}
    row |= {
        "record_id": fields.get("warc-record-id", "").strip("<>") or None, "warc_type": fields.get("warc-type"),
        "target_uri": fields.get("warc-target-uri"), "content_type": fields.get("content-type"),
    }
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise ValueError("no length of content in the header")
    row["content_length"] = size = int(length)
    sums, claimed, at, k = hashlib.sha256(), _claimed(fields), 0, 0
    other = hashlib.new(claimed[0], usedforsecurity=False) if claimed and claimed[0] != "sha256" else None
    while True:
        piece = stream.piece(min(chunk_bytes, size - at))
        if len(piece) < min(chunk_bytes, size - at):
            row |= {"chunk_no": k, "byte_offset": at}
            raise EOFError("the payload is cut off")
        sums.update(piece)
        if other:
            other.update(piece)
        end = at + len(piece) == size
        digest = sums.hexdigest()
        ok = None if not (end and claimed) else (other.hexdigest() if other else digest) == claimed[1]
        yield row | {"chunk_no": k, "byte_offset": at, "n_bytes": len(piece), "is_last": end, "sha256": digest, "digest_ok": ok, "payload": piece}
        at, k = at + len(piece), k + 1
        if end:
            break
    if not stream.starts(b"\r\n\r\n"):
        row |= {"chunk_no": k, "byte_offset": at}
        raise ValueError("no end of record after the payload")
    stream.piece(4)


def read_chunks(paths: DataFrame, *, chunk_bytes: int = CHUNK) -> DataFrame:
    """The chunked record table of the WARC files named in the column `path`, a file to a task at a time.

    Columns: CHUNK_SCHEMA. Null paths are passed over, a path listed twice is read twice, no files give
    no rows. Unreadable files have one row with `error`. Other columns of paths are unused.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        held = 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for row in _of_file(path, chunk_bytes):
                    rows.append(row)
                    held += row["n_bytes"] + 200
                    if held >= BATCH:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)

    return paths.select("path").where("path is not null").mapInArrow(run, CHUNK_SCHEMA)


def _of_file(path: str, chunk_bytes: int) -> Iterator[dict]:
    """The file's rows; what keeps it from being opened or read on is a row with `error`, not an exception."""
    fault = {"path": path, "record_no": 0, "chunk_no": 0, "byte_offset": 0, "n_bytes": 0, "is_last": True}
    try:
        fs, at = pafs.FileSystem.from_uri(path)
        stream = fs.open_input_stream(at, compression=None)
    except (OSError, ValueError) as e:  # ValueError: no URI, or a scheme that is unknown
        yield fault | {"error": f"unreadable: {type(e).__name__}"}
        return
    with stream:
        try:
            for row in records(stream, chunk_bytes):
                fault["record_no"] = row["record_no"] + 1
                yield {"path": path} | row
        except OSError as e:
            yield fault | {"error": f"reading broke off: {type(e).__name__}"}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in _FIELDS], names=[n for n, _ in _FIELDS])


def record_name(key: object) -> str:
    """The record id of a row's key: percent-encoded, so that no key can end a header line or the id."""
    return "urn:norow" if key is None else "urn:row:" + quote(str(key), safe="")


def _head(record_id: str, uri: str | None, content_type: str, size: int, sha256: str | None) -> bytes:
    clean = lambda x: " ".join(x.split())
    lines = [
        "WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <{quote(record_id, safe=':/?#[]@!$&()*+,;=%-._~')}>", *([f"WARC-Target-URI: {clean(uri)}"] if uri is not None else []),
        "WARC-Date: 1970-01-01T00:00:00Z", f"Content-Type: {clean(content_type)}", *([f"WARC-Block-Digest: sha256:{sha256}"] if sha256 else []), f"Content-Length: {size}",
    ]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def write_record(out: BinaryIO, record_id: str, uri: str | None, payload: bytes, content_type: str) -> int:
    """One resource record; returns its bytes. Blanks and line ends within header values become single blanks."""
    head = _head(record_id, uri, content_type, len(payload), hashlib.sha256(payload).hexdigest())
    for x in (head, payload, b"\r\n\r\n"):
        out.write(x)
    return len(head) + len(payload) + 4


def write_chunks(chunks: DataFrame, folder: str) -> DataFrame:
    """Write chunk rows, as read_chunks() gives them, as WARC files; rows are (path, records, bytes), as of write_warc().

    Chunks of a record come together by shuffle and sort and are written one by one: no record stands in
    memory. Rows with an error and rows of records without their last chunk are passed over; rows that
    repeat a chunk are written once. Other columns are unused.
    """
    record = ["path", "record_no"]
    sound = chunks.where("error is null and payload is not null").select(*record, "record_id", "target_uri", "content_type", "content_length", "chunk_no", "byte_offset", "payload", "is_last", "sha256")
    whole = sound.where("is_last").groupBy(*record).agg(F.max("sha256").alias("whole"))
    rows = sound.drop("is_last", "sha256").join(whole, record).repartition(*record).sortWithinPartitions(*record, "chunk_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _NewFile(folder) as file:
            now, left = None, 0
            for batch in batches:
                for path, number, key, uri, kind, size, _, offset, payload, digest in zip(*batch.columns, strict=True):
                    if now != (path.as_py(), number.as_py()):
                        if left:
                            raise ValueError(f"chunks are missing of record {now}")
                        now, left = (path.as_py(), number.as_py()), size.as_py()
                        file.write(_head(key.as_py() or f"urn:uuid:{uuid.uuid4()}", uri.as_py(), kind.as_py() or "application/octet-stream", left, digest.as_py()), 1)
                        if not left:
                            file.write(b"\r\n\r\n", 0)
                    if left and offset.as_py() == size.as_py() - left:
                        raw = payload.as_buffer()
                        file.write(raw, 0)
                        left -= raw.size
                        if not left:
                            file.write(b"\r\n\r\n", 0)
            if left:
                raise ValueError(f"chunks are missing of record {now}")
        yield from file.row()

    columns = [*record, "record_id", "target_uri", "content_type", "content_length", "chunk_no", "byte_offset", "payload", "whole"]
    return rows.select(*columns).mapInArrow(run, _FILES)


_FILES = "path string, records bigint, bytes bigint"


class _NewFile:
    """A file of a task's own in folder, which appears under its name when it is whole."""

    def __init__(self, folder: str) -> None:
        self.folder, self.records, self.size = folder.rstrip("/"), 0, 0
        self.fs, self.base = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.base, recursive=True)
        self.name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc"
        self.out = self.fs.open_output_stream(os.path.join(self.base, self.name + ".tmp"))

    def __enter__(self) -> _NewFile:
        return self

    def write(self, raw: bytes | pa.Buffer, records: int) -> None:
        self.out.write(raw)
        self.records += records
        self.size += len(raw)

    def __exit__(self, kind: object, *_: object) -> None:
        self.out.close()
        at = os.path.join(self.base, self.name)
        if kind is None and self.records:
            self.fs.move(at + ".tmp", at)
        else:
            self.fs.delete_file(at + ".tmp")

    def row(self) -> Iterator[pa.RecordBatch]:
        if self.records:
            yield pa.RecordBatch.from_pydict({"path": [f"{self.folder}/{self.name}"], "records": [self.records], "bytes": [self.size]})


def write_warc(pages: DataFrame, folder: str, *, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", content_type: str = "text/html") -> DataFrame:
    """Write each partition as a WARC file in folder, which all executors must share; rows are (path, records, bytes).

    The folder is a URI. A file appears under its name when it is whole, and a repeated task makes its
    own file, so lost executors and speculative tasks can't mix up files: only the files that the
    returned rows name count, and the rows must be written out once, not computed twice. A null payload
    is a record of no bytes; the record id is record_name() of the id, whatever its type.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _NewFile(folder) as file:
            for batch in batches:
                for key, uri, payload in zip(*batch.columns, strict=True):
                    raw = memoryview(payload.as_buffer()) if payload.is_valid else b""
                    file.size += write_record(file.out, record_name(key.as_py()), uri.as_py(), raw, content_type)
                    file.records += 1
        yield from file.row()

    columns = [F.col(f"`{id_col}`").alias("i"), F.col(f"`{uri_col}`").cast("string").alias("u"), F.col(f"`{payload_col}`").alias("p")]
    return pages.select(*columns).mapInArrow(run, _FILES)


def round_trip(spark: SparkSession, pages: DataFrame, *, chunk_bytes: int = CHUNK, id_col: str = "page_id") -> DataFrame:
    """pages (page_id, url, html) written as WARC files in the shared folder and read as chunk rows with the page's id."""
    from graphloom.llm.shared import fresh_path, written

    files = written(write_warc(pages, fresh_path(spark, "warc"), id_col=id_col), "warc-files")
    chunks = read_chunks(files.repartition(max(1, spark.sparkContext.defaultParallelism * 2), "path"), chunk_bytes=chunk_bytes)
    key = F.when(F.col("record_id").startswith("urn:row:"), F.expr("url_decode(substring(record_id, 9))"))
    return chunks.withColumn(id_col, key.cast(pages.schema[id_col].dataType)).drop("path", "record_no")
