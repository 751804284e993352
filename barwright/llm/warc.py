"""WARC archives: records written by tasks with an index of their byte ranges, and read back by sorted, coalesced ranges.

Each record is a gzip member of its own, so any record can be read alone. Tasks write files in the cluster's shared folder
through pyarrow's file systems; a file's name holds a random part, and only files that the stored index names are ever read,
so a task that runs twice leaves at most an unused file.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import new_path, slices, small_join, stored

#: Ranges whose gap is at most this many bytes are read at once, up to the size of a read.
GAP, READ = 64 << 10, 4 << 20
#: A file is closed at this size.
FILE_BYTES = 512 << 20

INDEX = "file string, offset long, length long, page_id {0}, url string, payload_digest string, record_type string"
RECORDS = "page_id {0}, url string, record_type string, payload_digest string, payload_bytes long, refers_to {0}, payload binary"


def _filesystem(path: str):
    """The file system and path behind a URI; Hadoop's names for S3 stand for pyarrow's own."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(re.sub("^s3[an]://", "s3://", path))


def _clean(value: str) -> str:
    """A header value on one line; percent signs and control characters are percent-encoded, reversibly."""
    return "".join(f"%{ord(c):02X}" if c == "%" or ord(c) < 32 or ord(c) == 127 else c for c in value)


def _member(data: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def _record(kind: str, page: str, url: str, digest: str, refers: str | None, payload: bytes) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{_clean(page)}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers is not None:
        head += [f"WARC-Refers-To: <urn:page:{_clean(refers)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return ("\r\n".join([*head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def originals(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """pages with __digest and __refers: the largest page_id of equal payloads of at least `least_bytes`, if it is another one."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("__payload"))
    rows = rows.withColumn("__digest", F.sha1("__payload"))
    # Digests are counted before any payload moves; only those that repeat take part in the join, which AQE may split.
    counted = rows.where(F.length("__payload") >= least_bytes).groupBy("__digest")
    repeated = counted.agg(F.max("page_id").alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    repeated = stored(repeated, "payloads")
    joined = small_join(rows, repeated, ["__digest"], "left")
    return joined.withColumn("__refers", F.when(F.col("__first") != F.col("page_id"), F.col("__first"))).drop("__first")


def write_warc(pages: DataFrame, folder: str | None = None, least_bytes: int = 1000) -> tuple[DataFrame, str]:
    """Archives of all pages (page_id, url, html) and their index; returns the stored index and the folder.

    The payload is the html in UTF-8, null as empty. Among equal payloads (by SHA-1) of at least `least_bytes` bytes the row
    with the largest page_id is a response and rows with other page_ids are revisits of it; rows that repeat its page_id too
    are responses, as are null page_ids' rows and all smaller payloads. Null urls are written empty. An empty table writes
    no file and an empty index.
    """
    folder = folder or new_path(pages.sparkSession, "warc")
    kind = pages.schema["page_id"].dataType.simpleString()

    def write(batches):
        system, base = _filesystem(folder)
        system.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in slices(batches, 256):
                rows = []
                for row in batch.to_pylist():
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{base}/{name}", compression=None)
                    refers = row["__refers"]
                    what = "response" if refers is None else "revisit"
                    page = "" if row["page_id"] is None else str(row["page_id"])
                    data = _member(_record(what, page, row["url"] or "", row["__digest"], None if refers is None else str(refers), row["__payload"]))
                    out.write(data)
                    rows.append({"file": name, "offset": at, "length": len(data), "url": row["url"], "payload_digest": row["__digest"], "record_type": what})
                    at += len(data)
                listed = pa.Table.from_pylist(rows, pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("record_type", pa.string())])).to_batches()
                for part in listed:
                    yield pa.record_batch([*(part.column(c) for c in ("file", "offset", "length")), batch.column("page_id"), *(part.column(c) for c in ("url", "payload_digest", "record_type"))], names=["file", "offset", "length", "page_id", "url", "payload_digest", "record_type"])
        finally:
            if out is not None:
                out.close()

    return stored(originals(pages, least_bytes).mapInArrow(write, INDEX.format(kind)), "warc-index"), folder


def coalesced(ranges: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(start, stop, the ranges within) for ascending (offset, length) ranges, joined over gaps of up to GAP bytes."""
    held: list[tuple[int, int]] = []
    for offset, length in ranges:
        if held and (offset - sum(held[-1]) > GAP or offset + length - held[0][0] > READ):
            yield held[0][0], sum(held[-1]), held
            held = []
        held.append((offset, length))
    if held:
        yield held[0][0], sum(held[-1]), held


def _parsed(member: bytes) -> dict:
    data = zlib.decompress(member, 31)
    head, rest = data.split(b"\r\n\r\n", 1)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not match its digest and length")
    refers = fields.get("WARC-Refers-To")
    return {"record_type": kind, "payload_digest": digest, "payload_bytes": size, "refers_to": refers and refers[len("<urn:page:") : -1], "payload": payload}


def read_warc(index: DataFrame, folder: str) -> DataFrame:
    """The records of the index rows given (all, or those that a filter selects), with their payloads; a revisit has an empty one.

    Index rows are dealt out by file and stretch of the file and sorted by offset; neighbouring ranges are read at once.
    A response's payload is checked against its digest. payload_bytes is the full payload's length, for revisits too.
    Selecting no rows gives no records.
    """
    kind = index.schema["page_id"].dataType.simpleString()
    stretch = F.floor(F.col("offset") / F.lit(4 * READ))
    placed = index.withColumn("__stretch", stretch).repartition("file", "__stretch").sortWithinPartitions("file", "offset").drop("__stretch")

    def read(batches):
        system, base = _filesystem(folder)
        for batch in slices(batches, 512):
            files, offsets, lengths = (batch.column(c).to_pylist() for c in ("file", "offset", "length"))
            first = 0
            while first < len(files):
                last = first
                while last + 1 < len(files) and files[last + 1] == files[first]:
                    last += 1
                with system.open_input_file(f"{base}/{files[first]}") as source:
                    row = first
                    for start, stop, within in coalesced(list(zip(offsets[first : last + 1], lengths[first : last + 1], strict=True))):
                        data = source.read_at(stop - start, start)
                        found = [_parsed(data[offset - start : offset - start + length]) for offset, length in within]
                        own = batch.slice(row, len(within))
                        row += len(within)
                        refers = pa.array([x["refers_to"] for x in found], pa.string()).cast(batch.schema.field("page_id").type)
                        yield pa.record_batch(
                            [own.column("page_id"), own.column("url"), *(pa.array([x[c] for x in found], t) for c, t in (("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()))), refers, pa.array([x["payload"] for x in found], pa.binary())],
                            names=["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"],
                        )
                first = last + 1

    return placed.mapInArrow(read, RECORDS.format(kind))
