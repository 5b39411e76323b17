"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with whole WARC records, and a last
skippable frame with the seek table: compressed and plain size of every frame.  Any Zstandard reader
gives the plain WARC file; one that knows the table starts at any frame.  An index table maps record
ids to bundle, frame and offset within the plain frame, so that one record costs one frame.

Writing: only narrow rows (page id, digest, size) are grouped by digest to find the page that keeps
each payload; pages are then dealt by id, and a task writes its bundles frame by frame, holding one
frame.  Bundles go straight to the shared folder, under a name of the task attempt; only the index
rows of attempts that Spark commits name them, so a lost executor leaves at most unnamed files.
Reading: bundles are listed in the index, and whole frames are dealt to the tasks.

Defined results: a null payload is empty.  Of the pages with equal payloads (of ``least_bytes`` or
more) the smallest page_id is the response and the others are revisits of it; rows that share both
payload and that page_id are all responses.  Pages without id come after all others: they are
responses only where no page with an id has the payload.  A null url is written as an empty target.
An empty table gives an archive without bundles.  Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 256 << 20
INDEX = (
    "record_id string, page_id long, bundle string, frame int, frame_at long, frame_bytes int, at int, record_bytes int"
)
RECORD = (
    "record_id string, page_id long, url string, record_type string, payload_bytes long,"
    " payload_digest string, refers_to long, payload binary"
)


def payload(html: Column) -> Column:
    return F.coalesce(html, F.lit("")).cast("binary")


def with_first_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds ``first_id``: the page that keeps the payload, null for that page itself."""
    plain = pages.select("page_id", "url", payload(F.col("html")).alias("body"))
    plain = plain.withColumns({"digest": F.sha1("body"), "size": F.octet_length("body")})
    narrow = plain.select("page_id", "digest", "size").where(F.col("size") >= least_bytes)
    first = narrow.groupBy("digest", "size").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    first = first.where("n > 1 and first_id is not null").drop("n")
    revisits = narrow.join(first, ["digest", "size"]).where(~F.col("page_id").eqNullSafe(F.col("first_id")))
    revisits = revisits.groupBy(F.col("page_id").alias("to_id"), F.col("digest").alias("to_digest")).agg(
        F.first("first_id").alias("first_id")
    )
    same = plain["page_id"].eqNullSafe(revisits["to_id"]) & (plain["digest"] == revisits["to_digest"])
    return plain.join(revisits, same, "left").select("page_id", "url", "body", "first_id")


def write_archive(pages: DataFrame, folder: str, least_bytes: int = 0) -> str:
    """Write ``page_id, url, html`` to bundles in ``folder``; returns ``folder``."""
    index = with_first_pages(pages, least_bytes).mapInArrow(_bundled(f"{folder}/bundles"), INDEX)
    index.write.parquet(f"{folder}/index")
    return folder


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """All records of the archive, read from its bundles."""
    index = spark.read.parquet(f"{folder}/index")
    frames = index.groupBy("bundle", "frame").agg(
        F.first("frame_at").alias("frame_at"), F.first("frame_bytes").alias("frame_bytes")
    )
    return frames.mapInArrow(_frame_records, RECORD)


def lookup(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """The records with the ``record_id`` of ``wanted``: one frame is read for each, by its place."""
    index = spark.read.parquet(f"{folder}/index")
    return index.join(wanted.select("record_id").distinct(), "record_id").mapInArrow(_one_record, RECORD)


def base32_sha1(body: bytes) -> str:
    return base64.b32encode(hashlib.sha1(body).digest()).decode()


def record_bytes(page_id: int | None, url: str, body: bytes, first_id: int | None) -> tuple[str, bytes]:
    """Record id, and the record as written."""
    digest = base32_sha1(body)
    record_id = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}"
    kind = "response" if first_id is None else "revisit"
    # Line breaks would end a header line.
    target = url.replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(body)}",
    ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if first_id is None:
        block = http + body
    else:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"X-Refers-To-Page-ID: {first_id}",
        ]
        block = http
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return record_id, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed_record(frame: bytes, at: int) -> tuple[dict, int]:
    """The record at a place of a plain frame, and the place after it."""
    end = frame.index(b"\r\n\r\n", at)
    lines = frame[at:end].decode().split("\r\n")[1:]
    head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    stop = end + 4 + int(head["Content-Length"])
    block = frame[end + 4 : stop]
    kind = head["WARC-Type"]
    page_id, first = head["X-Page-ID"], head.get("X-Refers-To-Page-ID")
    return {
        "record_id": head["WARC-Record-ID"][1:-1],
        "page_id": int(page_id) if page_id else None,
        "url": head["WARC-Target-URI"],
        "record_type": kind,
        "payload_bytes": int(head["X-Payload-Length"]),
        "payload_digest": head["WARC-Payload-Digest"].removeprefix("sha1:"),
        "refers_to": int(first) if first else None,
        "payload": block[block.index(b"\r\n\r\n") + 4 :] if kind == "response" else None,
    }, stop + 4


class Bundle:
    """A bundle being written: frames as they fill, at the end the seek table."""

    def __init__(self, path: str):
        self.path = path
        system, plain = fs.FileSystem.from_uri(path)
        system.create_dir(plain.rpartition("/")[0], recursive=True)
        self.out = system.open_output_stream(plain, compression=None)
        self.frames: list[tuple[int, int]] = []
        self.size = 0

    def add(self, frame: bytes) -> tuple[int, int, int]:
        """Number, place and compressed size of the new frame."""
        packed = zstandard.ZstdCompressor(level=3, write_checksum=True).compress(frame)
        self.out.write(packed)
        place = len(self.frames), self.size, len(packed)
        self.frames.append((len(packed), len(frame)))
        self.size += len(packed)
        return place

    def close(self) -> None:
        table = b"".join(struct.pack("<II", *sizes) for sizes in self.frames)
        table += struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


def seek_table(tail: bytes) -> list[tuple[int, int]]:
    """Compressed and plain size of each frame, from the end of a bundle."""
    count, flags, magic = struct.unpack("<IBI", tail[-9:])
    if magic != SEEKABLE or flags:
        raise ValueError("no seek table")
    return [struct.unpack_from("<II", tail, len(tail) - 9 - 8 * (count - n)) for n in range(count)]


def _bundled(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}"
        bundle, number, plain, waiting = None, 0, io.BytesIO(), []

        def flushed() -> pa.RecordBatch:
            nonlocal bundle, number, plain, waiting
            if bundle is None:
                bundle = Bundle(f"{name}-{number:04d}.warc.zst")
            frame, place, size = bundle.add(plain.getvalue())
            rows = [
                {"record_id": i, "page_id": p, "bundle": bundle.path, "frame": frame, "frame_at": place,
                 "frame_bytes": size, "at": at, "record_bytes": n}
                for i, p, at, n in waiting
            ]
            if bundle.size >= BUNDLE_BYTES:
                bundle.close()
                bundle, number = None, number + 1
            plain, waiting = io.BytesIO(), []
            return pa.RecordBatch.from_pylist(rows, schema=_INDEX)

        for batch in batches:
            for page_id, url, body, first_id in zip(*batch.columns, strict=True):
                page_id = page_id.as_py()
                record_id, record = record_bytes(page_id, url.as_py() or "", body.as_py(), first_id.as_py())
                waiting.append((record_id, page_id, plain.tell(), len(record)))
                plain.write(record)
                if plain.tell() >= FRAME_BYTES:
                    yield flushed()
        if waiting:
            yield flushed()
        if bundle is not None:
            bundle.close()

    return run


_INDEX = pa.schema(
    [("record_id", pa.string()), ("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()),
     ("frame_at", pa.int64()), ("frame_bytes", pa.int32()), ("at", pa.int32()), ("record_bytes", pa.int32())]
)
_RECORD = pa.schema(
    [("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
     ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
)


def plain_frame(bundle: str, at: int, size: int) -> bytes:
    system, path = fs.FileSystem.from_uri(bundle)
    with system.open_input_file(path) as f:
        f.seek(at)
        return zstandard.ZstdDecompressor().decompress(f.read(size))


def _frame_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            frame = plain_frame(row["bundle"], row["frame_at"], row["frame_bytes"])
            at, records = 0, []
            while at < len(frame):
                record, at = parsed_record(frame, at)
                records.append(record)
            yield pa.RecordBatch.from_pylist(records, schema=_RECORD)


def _one_record(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            frame = plain_frame(row["bundle"], row["frame_at"], row["frame_bytes"])
            yield pa.RecordBatch.from_pylist([parsed_record(frame, row["at"])[0]], schema=_RECORD)
