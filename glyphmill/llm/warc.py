"""Normaliser for WARC files that were compressed as one gzip stream.

A monolithic ``.warc.gz`` has no entry points: to read one record, all before it must be inflated.
The normaliser inflates each file once, as a stream, cuts it into records by their lengths, writes
every record as a gzip member of its own, and writes a sidecar index with each member's offset
and length. Any record is then one ranged read away, and the concatenated members inflate to
the bytes of the original stream: blank bytes between records, however many, belong to the
record before them, those before the first record to the first.

One task handles one file, in memory bounded by the largest record. A task writes under a name of
its own and renames the result when it is whole, so a lost executor or a second attempt does no harm.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, small_batches, stored

CHUNK = 1 << 20
LEVEL = 6
INDEX = "path string, output string, record int, offset long, length long, type string, record_id string, uri string, payload_length long, payload_sha1 string, error string"
_FIELDS = [x.split()[0] for x in INDEX.split(", ")]


class BadRecord(ValueError):
    pass


class _Stream:
    """The inflated bytes of a gzip file; members may follow one another."""

    def __init__(self, source: BinaryIO) -> None:
        self.source, self.engine, self.held, self.at, self.inner, self.seen = source, zlib.decompressobj(31), bytearray(), 0, False, False

    def more(self) -> bool:
        """Inflate another chunk; false at the end."""
        rest = self.engine.unused_data or self.engine.unconsumed_tail
        if self.engine.eof:
            while rest.startswith(b"\0"):
                rest = rest.lstrip(b"\0")  # padding between members
            if not rest:
                rest = self.source.read(CHUNK)
                if not rest.strip(b"\0"):
                    return bool(rest) and self.more()
            self.engine, self.inner = zlib.decompressobj(31), False
        elif not rest:
            rest = self.source.read(CHUNK)
            if not rest:
                if self.inner:
                    raise BadRecord("the gzip stream ends early")
                return False
        self.inner = self.seen = True
        try:
            data = self.engine.decompress(rest, 4 * CHUNK)
        except zlib.error as e:
            raise BadRecord(f"not a valid gzip stream: {e}") from e
        if self.engine.eof:
            self.inner = False
        if self.at > CHUNK:
            del self.held[: self.at]
            self.at = 0
        self.held += data
        return True

    def line_end(self, skip: int) -> int:
        """Index in ``held`` after the blank line that ends a header which begins ``skip`` bytes on, or -1
        at the end of the stream."""
        begin = self.at + skip
        while True:
            found = self.held.find(b"\r\n\r\n", begin)
            if found >= 0:
                return found + 4
            before = self.at
            begin = max(self.at + skip, len(self.held) - 3)
            if not self.more():
                return -1
            begin -= before - self.at

    def ensure(self, size: int) -> bool:
        while len(self.held) - self.at < size:
            if not self.more():
                return False
        return True


def records(source: BinaryIO) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(header fields in lower case, whole record with the blank bytes around it, payload)."""
    stream = _Stream(source)

    def blanks(size: int) -> int:
        """``size``, and the number of blank bytes from there on."""
        while stream.ensure(size + 1) and stream.held[stream.at + size] in (10, 13):
            size += 1
        return size

    lead = blanks(0)
    while stream.ensure(lead + 1):
        head_end = stream.line_end(lead)
        if head_end < 0:
            raise BadRecord("a record's header has no end")
        head = bytes(stream.held[stream.at + lead : head_end])
        if not head.startswith(b"WARC/"):
            raise BadRecord("a record does not begin with WARC/")
        fields: dict[str, str] = {}
        for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
            name, colon, value = line.partition(":")
            if colon:
                fields.setdefault(name.strip().lower(), value.strip())
        try:
            size = int(fields["content-length"])
        except (KeyError, ValueError):
            raise BadRecord("a record has no valid Content-Length") from None
        end = lead + len(head) + size
        if size < 0 or not stream.ensure(end):
            raise BadRecord("a record is cut short")
        tail = blanks(end)
        begin = stream.at  # after the last call that may inflate, which may move the held bytes
        yield fields, bytes(stream.held[begin : begin + tail]), bytes(stream.held[begin + lead + len(head) : begin + end])
        stream.at, lead = begin + tail, 0


def member(record: bytes, level: int = LEVEL) -> bytes:
    """A gzip member without a time stamp, so that the same record gives the same bytes."""
    engine = zlib.compressobj(level, zlib.DEFLATED, 31)
    return engine.compress(record) + engine.flush()


def normalise_file(path: str, folder: str, level: int = LEVEL) -> list[tuple]:
    """Rewrite one file into ``folder``, with its index beside it; the index rows.

    A file that breaks off is rewritten as far as its records are whole, and its last row has the
    reason in ``error`` and no record. An empty file has no rows and an empty output.
    """
    source_fs, source = pafs.FileSystem.from_uri(path)
    target_fs, target = pafs.FileSystem.from_uri(folder)
    name = hashlib.sha1(path.encode()).hexdigest()[:12] + "-" + source.rsplit("/", 1)[-1]
    output, attempt = f"{target}/{name}", f"{target}/_{uuid.uuid4().hex}-{name}"
    rows: list[tuple] = []
    offset = 0
    with source_fs.open_input_stream(source, compression=None) as data, target_fs.open_output_stream(attempt, compression=None) as out:
        try:
            for i, (fields, record, payload) in enumerate(records(data)):
                packed = member(record, level)
                out.write(packed)
                rows.append((path, name, i, offset, len(packed), fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-target-uri"), len(payload), hashlib.sha1(payload).hexdigest(), None))
                offset += len(packed)
        except BadRecord as e:
            rows.append((path, name, None, offset, None, None, None, None, None, None, str(e)))
    with target_fs.open_output_stream(attempt + ".idx", compression=None) as index:
        for row in rows:
            index.write((json.dumps(dict(zip(_FIELDS, row, strict=True)), ensure_ascii=False) + "\n").encode())
    for end in ("", ".idx"):
        target_fs.move(attempt + end, output + end)
    return rows


def read_member(folder: str, output: str, offset: int, length: int) -> bytes:
    """One record by its index entry: a ranged read and an inflation of that member alone."""
    fs, root = pafs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{root}/{output}") as f:
        f.seek(offset)
        return zlib.decompress(f.read(length), 31)


def normalise(paths: DataFrame, folder: str, level: int = LEVEL) -> DataFrame:
    """The index of all records of the files in ``paths`` (path), rewritten into ``folder``.

    ``folder`` is a URI that all executors reach. Defined cases: a null path gives no row; a path
    given twice is rewritten once; a broken file gives the rows before the break and one with
    ``error``; an empty table gives an empty index.
    """
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = normalise_file(path, folder, level)
                columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _FIELDS]
                kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _FIELDS)

    wanted = paths.where("path is not null").select("path").distinct()
    files = wanted.count()
    spread = wanted.repartitionByRange(max(1, files), "path")  # one file a task
    return stored(spread.mapInArrow(run, INDEX), "warc-index")


def page_record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """A page as a WARC response record; null html is an empty body."""
    body = (html or "").encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:{page_id}>\r\nWARC-Target-URI: {(url or '').replace(chr(13), '').replace(chr(10), '')}\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: {len(http)}\r\n\r\n"
    return head.encode() + http + b"\r\n\r\n"


def write_monolithic(pages: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """(path): the pages as WARC files of one gzip stream each, one file a partition.

    This makes the input that the normaliser is for. Null ids, urls and html are written as such
    empty values; repeated rows give repeated records; an empty partition gives no file.
    """
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        attempt, name = f"{root}/_{uuid.uuid4().hex}", f"part-{part:06d}.warc.gz"
        target, _ = pafs.FileSystem.from_uri(folder)
        engine, out = zlib.compressobj(level, zlib.DEFLATED, 31), None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                out = out or target.open_output_stream(attempt, compression=None)
                out.write(engine.compress(page_record(*row)))
        if out:
            out.write(engine.flush())
            out.close()
            target.move(attempt, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"])], ["path"])

    small_batches(pages.sparkSession, 500)
    return stored(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "path string"), "warc-paths")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI in the shared folder."""
    where = shared_dir(spark)
    return f"{where if '://' in where else 'file://' + where}/glyphmill/{name}-{uuid.uuid4().hex}"


def normalise_pages(pages: DataFrame) -> DataFrame:
    """Write the pages as monolithic files, normalise them, and return the index without paths.

    (page_id, record, offset, length, type, uri, payload_length, payload_sha1, output, error)
    """
    spark = pages.sparkSession
    index = normalise(write_monolithic(pages, new_folder(spark, "warc-in")), new_folder(spark, "warc-out"))
    page = F.expr("try_cast(regexp_extract(record_id, 'x-page:([0-9-]+)', 1) as bigint)").alias("page_id")
    return index.select(page, "record", "offset", "length", "type", "uri", "payload_length", "payload_sha1", "output", "error")
