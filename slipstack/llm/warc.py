"""WARC archives: one gzip member per record, written by tasks and read back as a stream.

Writing: pages with equal payloads are stored once. The one with the largest id is the response, the
others are revisits without payload, so payloads are shuffled once, by id, and never meet a hot key.
Each task writes its rows to archives of its own in the shared folder under names no other attempt
uses; only archives that a finished task reports are read, so a lost executor leaves no half-read file.

Reading: archives are dealt to tasks, each opens its files through Arrow's file systems and reads them
in small chunks with incremental zlib. The content length frames each block, the digests are verified,
and every record must end with its gzip member.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipstack.llm.common import lookup, stored
from slipstack.session import scratch_path

ROLL = 256 << 20
CHUNK = 1 << 16
VERSION = b"WARC/1."
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "path string, offset long, record_type string, record_id string, target_uri string, payload_bytes long, payload_digest string, refers_to string, payload binary, error string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, ident: str, uri: str, size: int, digest: str, payload: bytes, refers_to: str | None = None) -> bytes:
    """One record, uncompressed; a revisit holds the HTTP head only."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    if kind == "response":
        block += payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{ident}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Member:
    """The bytes of one gzip member, inflated as they are asked for."""

    def __init__(self, source: BinaryIO, ahead: bytes):
        self.source, self.packed = source, ahead
        self.inflater = zlib.decompressobj(31)
        self.ready = bytearray()

    def _more(self) -> bool:
        while not self.inflater.eof:
            data = self.packed or self.source.read(CHUNK)
            if not data:
                raise ValueError("archive ends inside a record")
            got = self.inflater.decompress(data, CHUNK)
            self.packed = self.inflater.unconsumed_tail
            if got:
                self.ready += got
                return True
        return False

    def until(self, mark: bytes, begins: bytes = b"") -> bytes:
        """Everything before the mark, which is taken as well. Other beginnings than the one given are refused at once."""
        start = 0
        while (at := self.ready.find(mark, start)) < 0:
            if not self.ready.startswith(begins[: len(self.ready)]):
                raise ValueError("not a record")
            start = max(0, len(self.ready) - len(mark) + 1)
            if not self._more():
                raise ValueError("record head without end")
        out = bytes(self.ready[:at])
        del self.ready[: at + len(mark)]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes in pieces."""
        while n:
            if not self.ready and not self._more():
                raise ValueError("block shorter than its content length")
            piece = bytes(self.ready[:n])
            del self.ready[: len(piece)]
            n -= len(piece)
            yield piece

    def close(self) -> bytes:
        """Check the end of the record; gives what was read of the next member."""
        if b"".join(self.take(4)) != b"\r\n\r\n":
            raise ValueError("no line ends after the block")
        if self.ready or self._more():
            raise ValueError("more than one record in a member")
        return self.inflater.unused_data


def fields_of(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def read_archive(source: BinaryIO, with_payload: bool = True) -> Iterator[dict]:
    """All records of one archive in order.

    A record whose digests do not match has its error named. A break in the framing or in the
    compression ends the archive with one row that holds only the error, because nothing after it can
    be trusted. Heads may be as long as their record; what does not begin as a record is refused before more
    of it is read.
    """
    ahead, offset = b"", 0
    while True:
        ahead = ahead or source.read(CHUNK)
        if not ahead:
            return
        row: dict = {"offset": offset, "error": None}
        start = source.tell() - len(ahead)
        row["offset"] = start
        try:
            reader = Member(source, ahead)
            head = reader.until(b"\r\n\r\n", VERSION)
            if not head.startswith(VERSION):
                raise ValueError("not a record")
            fields = fields_of(head)
            length = int(fields["content-length"])
            block, payload, kept = hashlib.sha1(), hashlib.sha1(), []
            front, size = bytearray(), None
            inner = 0
            for piece in reader.take(length):
                block.update(piece)
                if size is None:
                    front += piece
                    at = front.find(b"\r\n\r\n")
                    if at < 0:
                        continue
                    size = int(fields_of(bytes(front[:at])).get("content-length", -1))
                    piece = bytes(front[at + 4 :])
                payload.update(piece)
                inner += len(piece)
                if with_payload:
                    kept.append(piece)
            ahead = reader.close()
        except (ValueError, KeyError, zlib.error) as broken:
            yield {"offset": start, "error": f"{type(broken).__name__}: {broken}"}
            return
        kind = fields.get("warc-type")
        told = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        if fields.get("warc-block-digest", "").removeprefix("sha1:") != base64.b32encode(block.digest()).decode():
            row["error"] = "block digest does not match"
        elif kind == "response" and (told != base64.b32encode(payload.digest()).decode() or size != inner):
            row["error"] = "payload digest or length does not match"
        yield row | {
            "record_type": kind,
            "record_id": fields.get("warc-record-id", "").strip("<>"),
            "target_uri": fields.get("warc-target-uri"),
            "payload_bytes": size,
            "payload_digest": told,
            "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
            "payload": b"".join(kept) if with_payload and kind == "response" else None,
        }


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", folder) if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def with_roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, digest, size, payload (null for revisits), response_id (null for responses).

    Of equal payloads of at least ``least_bytes`` the largest page_id is the response; rows that
    repeat this id are responses too. A null page_id never revisits nor is revisited.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns(
        {"digest": F.sha1("payload"), "size": F.length("payload").cast("long")}
    )
    light = rows.select("page_id", "url", "digest", "size")
    leaders = stored(
        light.where((F.col("size") >= least_bytes) & F.col("page_id").isNotNull())
        .groupBy("digest")
        .agg(F.max("page_id").alias("response_id"), F.count("*").alias("n"))
        .where("n > 1")
    )
    copies = (
        lookup(light.where((F.col("size") >= least_bytes) & F.col("page_id").isNotNull()), leaders, "digest", how="inner")
        .where("page_id < response_id")
        .select("page_id", "url", "digest", "size", F.lit(None).cast("binary").alias("payload"), "response_id")
    )
    gone = copies.select("page_id", "digest").distinct()
    originals = rows.join(gone, ["page_id", "digest"], "left_anti").withColumn("response_id", F.lit(None).cast("long"))
    return originals.select(copies.columns).unionByName(copies)


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, roll: int = ROLL) -> DataFrame:
    """Write all pages; gives the archives (path, records). Control characters of a url are escaped."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = opened(folder)
        files.create_dir(base, recursive=True)
        out, path, size, records = None, "", 0, 0

        def done():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records], pa.int64())], ["path", "records"])

        for batch in batches:
            for page_id, url, digest, length, payload, response_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path, size, records = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(path, compression=None)  # else the name decides
                uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
                told = base64.b32encode(bytes.fromhex(digest)).decode()
                kind = "response" if response_id is None else "revisit"
                packed = member(record(kind, f"urn:page:{page_id}", uri, length, told, payload or b"", f"urn:page:{response_id}"))
                out.write(packed)
                size, records = size + len(packed), records + 1
                if size >= roll:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return stored(with_roles(pages, least_bytes).mapInArrow(write, "path string, records long"))


def read_archives(archives: DataFrame, folder: str, with_payload: bool = True, strict: bool = False) -> DataFrame:
    """All records of ``archives(path, records)``; see ``read_archive`` for damaged ones.

    With ``strict`` the task that meets an error, or another number of records than was written, fails, so
    damage ends the job whichever columns are asked for.
    """
    names = [x.split()[0] for x in RECORD.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = opened(folder)
        kinds = [pa.string(), pa.int64(), *[pa.string()] * 3, pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]
        schema = pa.schema(list(zip(names, kinds, strict=True)))
        for batch in batches:
            for path, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, size, met = [], 0, 0
                with files.open_input_file(path) as source:
                    for row in read_archive(source, with_payload):
                        if strict and row["error"]:
                            raise ValueError(f"{path} at {row['offset']}: {row['error']}")
                        met += 1
                        rows.append({"path": path} | row)
                        size += len(row.get("payload") or b"")
                        if len(rows) >= 5000 or size > 16 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if strict and met != records:
                    raise ValueError(f"{path}: {met} records read, {records} written")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    n = max(1, archives.count())
    return archives.select("path", "records").repartition(min(n, 10_000)).mapInArrow(read, RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    One row per page, repeated rows included. A damaged archive fails the job: every page must return.
    """
    folder = scratch_path(pages.sparkSession, "warc")
    archives = write_archives(pages, folder)
    ident = lambda name: F.regexp_extract(name, r"^urn:page:(-?\d+)$", 1)
    number = lambda name: F.when(ident(name) != "", ident(name).cast("long"))
    return read_archives(archives, folder, with_payload=False, strict=True).select(
        number("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        number("refers_to").alias("refers_to"),
    )
