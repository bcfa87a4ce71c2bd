"""WARC archives: writing, normalising and reading back.

``write_archives`` writes each task's records as archives that are one gzip stream each, as many crawlers and tools leave
them. ``normalise`` inflates such a stream once, front to back, rewrites every record as its own gzip member and writes a
sidecar index (``.idx``: offset, length and record id of each member). ``read_back`` opens members by their offsets.

Files carry random names and only those named by a finished task are read, so a lost or repeated task leaves nothing but an
unused file. Records pass one at a time; an archive is closed at ``ARCHIVE_BYTES`` of payload.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairline.llm.common import mapped, stage
from fairline.session import shared_folder

ARCHIVE_BYTES = 32 << 20
_CHUNK = 1 << 16
_HELD_BYTES = 8 << 20  # payload that the reader holds before it hands it on
_LEVEL = 4
_DATE = "2024-01-01T00:00:00Z"  # capture time; the pages carry none


def _record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None, revisit: bool) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if page_id is not None:
        head.append(f"X-Page-ID: {quote(page_id)}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            head.append(f"X-Refers-To-Page-ID: {quote(refers_to)}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        out, names, size = None, [], 0
        for batch in batches:
            for page_id, url, payload, refers_to, revisit in zip(*(batch.column(c) for c in ("id", "url", "payload", "refers_to", "revisit")), strict=True):
                if out is None:
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, press, size = store.open_output_stream(f"{path}/{names[-1]}", compression=None), zlib.compressobj(_LEVEL, zlib.DEFLATED, 31), 0
                data = _record(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py(), revisit.as_py())
                out.write(press.compress(data))
                size += len(data)
                if size >= ARCHIVE_BYTES:
                    out.write(press.flush())
                    out.close()
                    out = None
        if out is not None:
            out.write(press.flush())
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["file"])

    return run


class _Stream:
    """The inflated bytes of a gzip file of any number of members, read in chunks."""

    def __init__(self, source) -> None:
        self.source, self.inflate, self.buffer, self.rest = source, zlib.decompressobj(31), bytearray(), b""

    def fill(self) -> bool:
        data = self.rest or self.source.read(_CHUNK)
        if not data:
            return False
        if self.inflate.eof:
            self.inflate = zlib.decompressobj(31)
        self.buffer += self.inflate.decompress(data)
        self.rest = self.inflate.unused_data
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Up to and with ``mark``; None at the end of the file."""
        at = self.buffer.find(mark)
        while at < 0:
            seen = max(0, len(self.buffer) - len(mark) + 1)
            if not self.fill():
                return None
            at = self.buffer.find(mark, seen)
        out = bytes(self.buffer[: at + len(mark)])
        del self.buffer[: at + len(mark)]
        return out

    def take(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.buffer and not self.fill():
                raise ValueError("archive ends inside a record")
            part = bytes(self.buffer[:size])
            del self.buffer[:size]
            size -= len(part)
            if part:
                yield part


def _normaliser(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                new = f"{uuid.uuid4().hex}-members.warc.gz"
                with store.open_input_stream(f"{path}/{name}", compression=None) as source, store.open_output_stream(f"{path}/{new}", compression=None) as out, store.open_output_stream(f"{path}/{new}.idx", compression=None) as index:
                    stream, offset, offsets, lengths = _Stream(source), 0, [], []
                    while (head := stream.until(b"\r\n\r\n")) is not None:
                        fields = _headers(head[:-4])
                        press = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
                        out.write(press.compress(head))
                        for part in stream.take(int(fields["Content-Length"]) + 4):
                            out.write(press.compress(part))
                        out.write(press.flush())
                        written = out.tell()
                        index.write(f"{offset} {written - offset} {fields['WARC-Record-ID']}\n".encode())
                        offsets.append(offset)
                        lengths.append(written - offset)
                        offset = written
                yield pa.RecordBatch.from_arrays([pa.array([new] * len(offsets), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], ["file", "offset", "length"])

    return run


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        names = ["id", "url", "refers_to", "record_type", "payload_digest", "payload_bytes", "payload"]
        kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

        for batch in batches:
            rows, held = [], 0
            opened, source = None, None
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if file != opened:
                    source = store.open_input_file(f"{path}/{file}")
                    opened = file
                head, _, rest = zlib.decompress(source.read_at(length, offset), 31).partition(b"\r\n\r\n")
                fields = _headers(head)
                block = rest[: int(fields["Content-Length"])]
                http, _, payload = block.partition(b"\r\n\r\n")
                kind = fields["WARC-Type"]
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                size = int(_headers(http)["Content-Length"])
                if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                    raise ValueError(f"record at {offset} of {file} doesn't hold its payload")
                known = [None if (v := fields.get(k)) is None else unquote(v) for k in ("X-Page-ID", "WARC-Target-URI", "X-Refers-To-Page-ID")]
                rows.append((*known, kind, digest, size, payload if kind == "response" else None))
                held += len(payload)
                if held >= _HELD_BYTES:
                    yield table(rows)
                    rows, held = [], 0
            yield table(rows)

    return run


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """What to write for each row: ``id``, ``url``, ``payload``, ``refers_to`` and ``revisit``."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).cast("string").alias("url"), payload.alias("payload")).select("*", F.sha2("payload", 256).alias("same"), F.length("payload").alias("size"))
    firsts = rows.where(F.col("size") >= min_bytes).groupBy("same").agg(F.min("id").alias("first"))
    joined = rows.join(firsts, "same", "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return joined.select(F.col("id").cast("string").alias("id"), "url", "payload", F.when(revisit, F.col("first")).cast("string").alias("refers_to"), revisit.alias("revisit"))


def write_archives(written: DataFrame, folder: str) -> DataFrame:
    """Writes the rows of ``records`` to archives of one gzip stream in ``folder``; returns their names as ``file``."""
    return stage(mapped(written, _writer(folder), "file string"), "archives")


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """Rewrites archives (``file``, in ``folder``) with a gzip member for each record and a sidecar index beside each new
    archive. Returns the index: ``file``, ``offset``, ``length``."""
    spread = files.repartition(max(1, files.count()), "file")
    return stage(mapped(spread, _normaliser(folder), "file string, offset long, length long"), "members")


def read_back(index: DataFrame, folder: str) -> DataFrame:
    """The records named by an index: ``id``, ``url``, ``refers_to``, ``record_type``, ``payload_digest``,
    ``payload_bytes``, ``payload`` (null for a revisit). A response's payload is checked against its digest."""
    return mapped(index, _reader(folder), "id string, url string, refers_to string, record_type string, payload_digest string, payload_bytes long, payload binary")


def archive(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes, normalises and reads back a record for each row of ``pages``.

    Of rows with equal payloads (UTF-8; null: empty) of at least ``min_bytes`` bytes, those with the smallest id are
    responses and the others revisits of it. Null ids never are the smallest; where all are null, all are responses. Rows that
    repeat with the smallest id are responses each. Other columns are not archived. An empty table gives no record.
    """
    folder = f"{shared_folder(pages.sparkSession)}/fairline-warc-{uuid.uuid4().hex}"
    files = write_archives(records(pages, page_id, url, html, min_bytes), folder)
    return read_back(normalise(files, folder), folder)
