"""Dictionary-compressed WARC archives.

A Zstandard dictionary is built from a bounded sample of the records. Every archive starts with a
skippable frame that holds it, and each record is a frame of its own, compressed with it, so that a
record can be read by its place alone. Archives are written through Spark's text writer, which commits
them as a whole and on any file system: each frame is a "line", and the line separator is an empty
skippable frame, which every Zstandard reader passes over.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import reduce_by
from ..session import shared_path
from .common import ENCODED, lowest

#: Frame magics of Zstandard and of its dictionary frame in WARC files; an empty skippable frame; the revisit profile.
FRAME, SKIPPABLE, DICTIONARY = 0xFD2FB528, 0x184D2A50, 0x184D2A5D
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
UNDATED = "1970-01-01T00:00:00Z"


class Writing(NamedTuple):
    """Bounds of the dictionary and of an archive; none depends on the input."""

    sample_records: int = 1000
    sample_bytes: int = 16 << 10
    dictionary_bytes: int = 32 << 10
    archive_bytes: int = 64 << 20
    level: int = 3
    date: str = UNDATED


def record_id(page_id: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page_id}')}>"


def record(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object, date: str) -> bytes:
    """A response with its payload, or a revisit that has the response's head alone."""
    uri = (url or f"urn:page:{page_id}").replace("\r", "%0D").replace("\n", "%0A")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = head if revisit else head + payload
    fields = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", f"Page-Id: {'' if page_id is None else page_id}",
    ]
    if revisit:
        fields += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"Refers-To-Page-Id: {refers_to}"]
    fields += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    return fields, rest[:int(fields["Content-Length"])]


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def dictionary_of(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; where there are too few samples to train on, their own bytes are one."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:] or b"WARC/1.1\r\n"


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame at a place ends, from its headers alone."""
    magic, size = struct.unpack_from("<II", data, at)
    if magic & ~0xF == SKIPPABLE:
        return at + 8 + size
    if magic != FRAME:
        raise ValueError(f"no frame at byte {at}")
    head = data[at:at + 18]
    checksum = zstandard.get_frame_parameters(head).has_checksum
    at += zstandard.frame_header_size(head)
    while True:
        block = int.from_bytes(data[at:at + 3], "little")
        at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            return at + 4 * checksum


def records_of(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of every record of an archive."""
    data, at, reader = memoryview(archive), 0, zstandard.ZstdDecompressor()
    while at < len(data):
        end = frame_end(data, at)
        magic, = struct.unpack_from("<I", data, at)
        if magic == DICTIONARY:
            reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(data[at + 8:end])))
        elif magic == FRAME:
            yield parsed(reader.decompress(data[at:end]))
        at = end


def with_first(pages: DataFrame, least_bytes: int, key: str, html: str, url: str) -> DataFrame:
    """(key, url, payload, hex, refers_to): for pages whose payload another page of smaller key has, that page's key.

    Payloads are equal where their SHA-1 and length are. Only digests and keys are grouped, and partly
    combined before the shuffle; the join may be split where one payload is very common.
    """
    read = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.coalesce(html, F.lit("")).cast("binary").alias(ENCODED))
    read = read.withColumn("hex", F.sha1(ENCODED)).withColumn("bytes", F.octet_length(ENCODED))
    named = read.where((F.col("bytes") >= least_bytes) & F.col("key").isNotNull()).select("hex", "bytes", "key")
    firsts = reduce_by(named, ["hex", "bytes"], F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    both = read.join(firsts, ["hex", "bytes"], "left")
    return both.select("key", "url", ENCODED, "hex", F.when(F.col("first") < F.col("key"), F.col("first")).alias("refers_to"))


def sampled(pages: DataFrame, writing: Writing, key: str, html: str, url: str) -> list[bytes]:
    """A bounded sample of records, each cut to a bounded length at a hashed place of its payload."""
    keys = pages.where(F.col(key).isNotNull()).select(F.col(key).alias("key"))
    low = keys.where(lowest(F.xxhash64("key"), writing.sample_records, keys.count()))
    ids = low.orderBy(F.xxhash64("key"), "key").limit(writing.sample_records)
    payload = F.coalesce(html, F.lit("")).cast("binary")
    read = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), payload.alias("p")).join(F.broadcast(ids.distinct()), "key", "left_semi")
    at = F.pmod(F.xxhash64("key"), F.greatest(F.octet_length("p") - writing.sample_bytes + 1, F.lit(1))).cast("int") + 1
    rows = read.select("key", F.substring("url", 1, 1000).alias("url"), F.substr("p", at, F.lit(writing.sample_bytes)).alias("p"))
    rows = rows.orderBy("key", "p").limit(writing.sample_records).collect()
    return [record(r.key, r.url, bytes(r.p), base32(hashlib.sha1(bytes(r.p)).digest()), None, writing.date) for r in rows]


def write(pages: DataFrame, path: str, writing: Writing = Writing(), least_bytes: int = 0, key: str = "page_id", html: str = "html", url: str = "url") -> None:
    """Archive every row of pages below path, as <path>/archive=<n>/part-*.

    Of rows with equal payloads of at least `least_bytes` bytes the one with the smallest key is a
    response, the others revisits of it; smaller payloads are all responses. A null html is empty, a
    null url becomes a name made of the key. Rows without a key are responses and never referred to;
    of repeated rows with the smallest key each is a response. An empty table gives no archive.
    """
    trained = dictionary_of(sampled(pages, writing, key, html, url), writing.dictionary_bytes)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(trained)
        packer = zstandard.ZstdCompressor(level=writing.level, dict_data=shared, write_checksum=True)
        opening = struct.pack("<II", DICTIONARY, len(trained)) + trained
        archive, number, filled = 0, 0, 0
        for batch in batches:
            out: list[tuple[int, int, bytes]] = []
            for page_id, address, payload, hexed, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if filled >= writing.archive_bytes:
                    archive, filled = archive + 1, 0
                if not filled:
                    out.append((archive, number, opening))
                    number += 1
                frame = packer.compress(record(page_id, address, payload, base32(bytes.fromhex(hexed)), refers_to, writing.date))
                out.append((archive, number, frame))
                number, filled = number + 1, filled + len(frame)
            columns = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())],
                                             ["archive", "number", "frame"])

    frames = with_first(pages, least_bytes, key, html, url).mapInArrow(rows, "archive int, number long, frame binary")
    lines = frames.sortWithinPartitions("archive", "number").select("archive", F.col("frame").cast("string").alias("value"))
    lines.write.partitionBy("archive").option("lineSep", SEPARATOR).text(path)


def read(spark: SparkSession, path: str, key_type: str = "bigint", with_payload: bool = False) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of every record, and its payload if asked for.

    Size and digest of a response are those of the payload that was read; a payload that doesn't
    match its recorded digest is an error. A revisit has them from its headers, and a null payload.
    """
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * with_payload]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                out = []
                for fields, block in records_of(content.as_py()):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and base32(hashlib.sha1(payload).digest()) != digest:
                        raise ValueError(f"payload of page {fields['Page-Id']} is not what was archived")
                    size = len(payload) if kind == "response" else int(head.rpartition(b"Content-Length: ")[2])
                    row = (fields["Page-Id"] or None, fields["WARC-Target-URI"], size, digest, kind, fields.get("Refers-To-Page-Id"))
                    out.append((*row, payload if kind == "response" else None) if with_payload else row)
                    if len(out) >= 1000:
                        yield batch_of(out)
                        out = []
                if out:
                    yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=False)], names)

    schema = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path).select("content")
    made = files.mapInArrow(rows, schema + ", payload binary" * with_payload)
    return made.withColumns({c: F.col(c).cast(key_type) for c in ("page_id", "refers_to")})


def archived(pages: DataFrame, writing: Writing = Writing(), least_bytes: int = 0, key: str = "page_id") -> DataFrame:
    """Write pages to archives below the shared folder and read them back."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write(pages, path, writing, least_bytes, key)
    if pages.isEmpty():
        return spark.createDataFrame([], "page_id bigint, url string, payload_bytes long, payload_digest string, record_type string, refers_to bigint")
    return read(spark, path, pages.schema[key].dataType.simpleString())
