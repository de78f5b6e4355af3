"""Seekable archives of responses: WARC records in independent Zstandard frames.

A bundle is one file: frames of whole records, then a seek table in a skippable frame (the public
Zstandard seekable format). Any Zstandard reader sees the plain WARC; with the index, which maps
a record to (bundle, frame, offset in the frame), one frame is enough to read one record.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from assayline.llm.common import Batches, quoted, whole_text
from assayline.session import materialise

# Fixed values of the seekable format: skippable frame, footer and their magic numbers.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
# The last byte of every bundle is the top byte of SEEKABLE; the writer adds it as the line end.
LAST = bytes([SEEKABLE >> 24])

# Names of records in the archive.
PREFIX, NO_ID = "urn:request:", "urn:unnumbered"

RECORD = pa.schema(
    [
        ("request_id", pa.string()),
        ("bundle", pa.string()),
        ("frame", pa.int32()),
        ("offset", pa.int64()),
        ("length", pa.int64()),
        ("record_type", pa.string()),
        ("uri", pa.string()),
        ("refers_to", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("payload", pa.binary()),
    ]
)
RECORD_SQL = (
    "request_id string, bundle string, frame int, offset long, length long, record_type string, uri string, "
    "refers_to string, payload_bytes long, payload_digest string, payload binary"
)


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def one_line(value: str) -> str:
    """A header value: no line end may split it."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def urn(request_id: str | None) -> str:
    """The record's name: the id in percent code, so that any text may be one."""
    return f"<{NO_ID}>" if request_id is None else f"<{PREFIX}{quote(request_id, safe='', errors='replace')}>"


def urn_id(value: str | None) -> str | None:
    name = (value or f"<{NO_ID}>")[1:-1]
    return None if name == NO_ID else unquote(name.removeprefix(PREFIX))


def record_bytes(request_id: str | None, uri: str | None, payload: bytes, first_id: str | None) -> bytes:
    """A response with its payload, or a revisit of ``first_id`` without."""
    revisit = first_id is not None and first_id != request_id
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block = f"{head}Content-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn(request_id)}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {one_line(uri)}")
    if revisit:
        lines += [f"WARC-Refers-To: {urn(first_id)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def seal(frames: list[tuple[bytes, int]]) -> bytes:
    """Compressed frames with their plain sizes, and the seek table."""
    table = b"".join(struct.pack("<II", len(data), plain) for data, plain in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return b"".join(data for data, _ in frames) + struct.pack("<II", SKIPPABLE, len(table)) + table


def seek_table(bundle: bytes) -> list[tuple[int, int]]:
    """(start, length) of every frame, read from the footer."""
    count, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    entry = 12 if flags & 0x80 else 8
    at, found = 0, []
    for i in range(count):
        (length,) = struct.unpack_from("<I", bundle, len(bundle) - 9 - entry * (count - i))
        found.append((at, length))
        at += length
    return found


def read_frame(bundle: bytes, place: tuple[int, int]) -> bytes:
    return zstandard.ZstdDecompressor().decompressobj().decompress(bundle[place[0] : place[0] + place[1]])


def records_of(plain: bytes) -> Iterator[dict]:
    """The records of one frame: offset, length and fields."""
    at = 0
    while at < len(plain):
        end = plain.index(b"\r\n\r\n", at)
        head = dict(line.split(": ", 1) for line in plain[at:end].decode().split("\r\n")[1:])
        size = int(head["Content-Length"])
        http, _, payload = plain[end + 4 : end + 4 + size].partition(b"\r\n\r\n")
        stop = end + 4 + size + 4
        yield {
            "request_id": urn_id(head["WARC-Record-ID"]),
            "offset": at,
            "length": stop - at,
            "record_type": head["WARC-Type"],
            "uri": head.get("WARC-Target-URI"),
            "refers_to": urn_id(head.get("WARC-Refers-To")),
            "payload_bytes": int(http.rpartition(b"Content-Length: ")[2]),
            "payload_digest": head["WARC-Payload-Digest"].removeprefix("sha1:"),
            "payload": payload if head["WARC-Type"] == "response" else None,
        }
        at = stop


def mark_revisits(responses: DataFrame, *, key: str, raw: str, uri: str, least_bytes: int) -> DataFrame:
    """(request_id, uri, payload, first_id): the smallest id among equal payloads, null where none is shared.

    Ids are compared in their own type and come back as text. Only ids and digests are grouped and joined by payload; the texts move once, by id.
    """
    rows = responses.select(
        quoted(key).alias("request_id"), quoted(uri).cast("string").alias("uri"), whole_text(raw).cast("binary").alias("payload")
    ).withColumn("sha", F.sha2("payload", 256))
    slim = rows.filter(F.octet_length("payload") >= least_bytes).select("request_id", "sha")
    # Written, so that the join below is one of two plain tables, whose large partitions Spark can split.
    shared = materialise(slim.groupBy("sha").agg(F.min("request_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").select("sha", "first_id"))
    firsts = slim.distinct().join(shared, "sha").select("request_id", "sha", "first_id")
    return (
        rows.join(firsts.withColumnsRenamed({"request_id": "r", "sha": "s"}), F.col("request_id").eqNullSafe(F.col("r")) & (F.col("sha") == F.col("s")), "left")
        .select(F.col("request_id").cast("string"), "uri", "payload", F.col("first_id").cast("string"))
    )


def write_bundles(
    responses: DataFrame,
    folder: str,
    *,
    key: str = "request_id",
    raw: str = "raw",
    uri: str = "uri",
    least_bytes: int = 0,
    frame_bytes: int = 262_144,
    bundle_bytes: int = 33_554_432,
    level: int = 3,
) -> None:
    """Write every response as a WARC record into bundle files under ``folder``.

    Of rows with equal payloads of at least ``least_bytes`` bytes that with the smallest ``key`` (of any
    type that has an order and a text form) is a response; the others are revisits that refer to it. A null text is an empty payload, rows
    repeated under one id stay responses, a row with a null id revisits any row with an id. A frame
    holds whole records up to ``frame_bytes`` and a bundle frames up to ``bundle_bytes`` (plain sizes;
    one larger record gets a frame or bundle of its own), so a task holds one bundle. Files are
    committed by Spark's writer: a task run again leaves no second copy. An empty table writes no record.
    """

    def bundles(batches: Batches) -> Batches:
        coder = zstandard.ZstdCompressor(level=level)
        frames, held, size = [], [], 0

        def close_frame() -> None:
            if held:
                plain = b"".join(held)
                frames.append((coder.compress(plain), len(plain)))
                held.clear()

        def close_bundle() -> Iterator[pa.RecordBatch]:
            close_frame()
            if frames:
                yield pa.record_batch({"content": pa.array([seal(frames)[: -len(LAST)]], pa.binary())})
                frames.clear()

        in_frame = 0
        for batch in batches:
            for r in batch.to_pylist():
                record = record_bytes(r["request_id"], r["uri"], r["payload"], r["first_id"])
                if held and in_frame + len(record) > frame_bytes:
                    close_frame()
                    in_frame = 0
                if size and size + len(record) > bundle_bytes:
                    yield from close_bundle()
                    size = in_frame = 0
                held.append(record)
                in_frame += len(record)
                size += len(record)
        yield from close_bundle()

    made = mark_revisits(responses, key=key, raw=raw, uri=uri, least_bytes=least_bytes).mapInArrow(bundles, "content binary")
    # One row per file: its bytes as they are, closed by the last byte of the footer.
    as_text = made.select(F.col("content").cast("string").alias("value"))
    as_text.write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", LAST.decode("latin-1")).text(folder)


def read_bundles(spark: SparkSession, folder: str, *, payloads: bool = True, key_type: str = "long") -> DataFrame:
    """Every record of the bundles with its place: request_id, bundle, frame, offset, length and fields.

    The archive holds ids as text; ``key_type`` is the type of the key that was written. ``payloads=False`` leaves the payload null: the index alone. A revisit has no payload here.
    """

    def parse(batches: Batches) -> Batches:
        for batch in batches:
            for file in batch.to_pylist():
                for number, place in enumerate(seek_table(file["content"])):
                    found = [r | {"bundle": file["path"], "frame": number} for r in records_of(read_frame(file["content"], place))]
                    for r in found:
                        if not payloads:
                            r["payload"] = None
                    yield pa.RecordBatch.from_pylist(found, schema=RECORD)

    return _typed(_files(spark, folder).mapInArrow(parse, RECORD_SQL), key_type)


def fetch_records(spark: SparkSession, folder: str, index: DataFrame, wanted: Column) -> DataFrame:
    """The records of ``index`` rows that satisfy ``wanted``: only their frames are decompressed.

    A bundle that holds one of them is read whole, by Spark's reader, which opens any path that Spark can.
    """
    places = index.filter(wanted).groupBy(F.col("bundle").alias("path")).agg(F.collect_set(F.struct("frame", "offset")).alias("places"))

    def fetch(batches: Batches) -> Batches:
        for batch in batches:
            for file in batch.to_pylist():
                table, by_frame = seek_table(file["content"]), {}
                for p in file["places"]:
                    by_frame.setdefault(p["frame"], set()).add(p["offset"])
                for frame, offsets in sorted(by_frame.items()):
                    plain = read_frame(file["content"], table[frame])
                    for offset in sorted(offsets):
                        record = next(records_of(plain[offset:]))
                        row = record | {"bundle": file["path"], "frame": frame, "offset": offset}
                        yield pa.RecordBatch.from_pylist([row], schema=RECORD)

    return _typed(_files(spark, folder).join(places, "path").mapInArrow(fetch, RECORD_SQL), index.schema["request_id"].dataType)


def _typed(records: DataFrame, key_type: str | DataType) -> DataFrame:
    return records.withColumns({c: F.col(c).cast(key_type) for c in ("request_id", "refers_to")})


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).filter(F.col("length") > 0).select("path", "content")
