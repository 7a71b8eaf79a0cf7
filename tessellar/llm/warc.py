"""WARC archives compressed with a Zstandard dictionary: a writer, a reader, and revisits resolved to what they repeat.

An archive holds records up to a set number of raw bytes (a longer record has one of its own). Its dictionary is built from all of
them and stands first, in a skippable frame; a warcinfo record follows; each record is a frame of its own, so that one can be read
at its offset with the dictionary alone. Spark's text writer puts an archive's bytes down as they are, one file each, on any
file system that Spark writes to, and commits them as it commits any table. An empty skippable frame ends each file: it is the
writer's line end, which readers of Zstandard pass over.

Of rows with equal payloads (length, SHA-1 and a further 64-bit hash) of at least a given number of bytes the one with the largest page_id is
a response, the others are revisits that name it. A revisit's block is the HTTP head alone. Null page_ids come first in this order,
repeated page_ids go by their text; each row is a record of its own. A null text is an empty payload, a null url leaves the target URI out; control
characters and spaces in it are written as percent signs and hexadecimals. An empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keyed, record_batch, shared_dir, ship

#: Raw bytes of an archive's records; bytes of its dictionary; level of compression.
ARCHIVE, DICTIONARY, LEVEL = 16 << 20, 112 << 10, 3
# Fixed values of the formats: frame marks, line end made of an empty skippable frame, profile of revisits.
_FRAME, _SKIPPABLE, _DICTIONARY_FRAME = 0xFD2FB528, 0x184D2A50, 0x184D2A5D
_LINE_END = "P*M\x18\0\0\0\0"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_RECORD = pa.schema([("warc_type", pa.string()), ("record_id", pa.string()), ("page_id", pa.int64()), ("target_uri", pa.string()), ("date", pa.string()), ("refers_to_id", pa.string()), ("stated_digest", pa.string()), ("stated_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def digest32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _uri(url: str | None) -> str | None:
    return None if url is None else "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def _record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _http(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def _dictionary(records: list[bytes], size: int) -> zstandard.ZstdCompressionDict:
    """Trained on all records of an archive; on fewer than training takes, the records themselves are the dictionary."""
    try:
        return zstandard.train_dictionary(size, records, k=1024, d=8, f=20, accel=5)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(records)[-size:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes], date: str, size: int = DICTIONARY, level: int = LEVEL) -> bytes:
    """One file: the dictionary in a skippable frame, a warcinfo record, and the records, each a frame of its own."""
    about = b"software: tessellar\r\nformat: WARC File Format 1.1\r\n"
    name = uuid.UUID(bytes=hashlib.sha256(b"".join(hashlib.sha1(r).digest() for r in records)).digest()[:16], version=5)
    info = _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], about)
    shared = _dictionary(records, size)
    body = shared.as_bytes()
    press = zstandard.ZstdCompressor(level=level, dict_data=shared, write_checksum=True, write_content_size=True)
    return b"".join([struct.pack("<II", _DICTIONARY_FRAME, len(body)), body, *(press.compress(r) for r in [info, *records])])


def write_archives(pages: DataFrame, path: str, least: int = 0, date: str = "1970-01-01T00:00:00Z", collection: str = "pages", raw_bytes: int = ARCHIVE) -> str:
    """Write pages (page_id, url, html) to a new folder of archives; least is the number of bytes from which equal payloads are revisits."""
    ship(pages.sparkSession)
    named = pages.select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"), F.col("url").cast("string").alias("url"))
    payload = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = keyed(named, rest=("url",)).select(F.col("_k"), F.col("doc_id").alias("page_id"), F.col("_rest.url").alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("sha"), F.xxhash64("payload").alias("hash"))
    same = ["size", "sha", "hash"]
    # one row for each payload that several rows have; the payloads themselves don't travel for it
    last = F.max(F.struct("_k", "url")).alias("last")
    heads = rows.where(F.col("size") >= least).groupBy(*same).agg(last, F.count(F.lit(1)).alias("n")).where("n > 1").select(*same, F.col("last._k").alias("of"), F.col("last.url").alias("of_url"))
    marked = rows.join(heads, same, "left").select("_k", "page_id", "url", "payload", "sha", F.when(F.col("of") != F.col("_k"), F.col("of")).alias("of"), "of_url")

    def name_of(key: int) -> str:
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{collection}/{key}')}>"

    def run(batches: Iterator[pa.RecordBatch]):
        held, size = [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([archive(held, date)], pa.binary())], names=["archive"])

        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(7))):
                key, page_id, url, body, sha, of, of_url = (v.as_py() for v in row)
                fields = [("WARC-Type", "response" if of is None else "revisit"), ("WARC-Record-ID", name_of(key)), ("WARC-Target-URI", _uri(url)), ("WARC-Date", date), ("WARC-Payload-Digest", "sha1:" + digest32(bytes.fromhex(sha))), ("X-Page-Id", None if page_id is None else str(page_id)), ("Content-Type", "application/http;msgtype=response")]
                if of is not None:
                    fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", name_of(of)), ("WARC-Refers-To-Target-URI", _uri(of_url)), ("WARC-Refers-To-Date", date)]
                record = _record(fields, _http(len(body)) + (body if of is None else b""))
                if held and size + len(record) > raw_bytes:
                    yield out()
                    held, size = [], 0
                held.append(record)
                size += len(record)
        if held:
            yield out()

    # cast leaves the bytes as they are; a row is a file
    files = marked.mapInArrow(run, "archive binary").select(F.col("archive").cast("string").alias("value"))
    files.write.options(lineSep=_LINE_END, maxRecordsPerFile=1, compression="none").text(path)
    return path


def _frame_end(raw: bytes, at: int) -> int:
    """Where the frame that begins at this offset ends, by the sizes of its blocks."""
    flags = raw[at + 4]
    single, checksum = flags >> 5 & 1, flags >> 2 & 1
    end = at + 5 + (0 if single else 1) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
    while True:
        block = int.from_bytes(raw[end : end + 3], "little")
        end += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            return end + 4 * checksum


def records_of(raw: bytes) -> Iterator[bytes]:
    """The records of one archive, with the dictionary of its leading frame."""
    at, press = 0, zstandard.ZstdDecompressor()
    while at < len(raw):
        mark, size = struct.unpack_from("<II", raw, at)
        if mark & 0xFFFFFFF0 == _SKIPPABLE:
            if mark == _DICTIONARY_FRAME and at == 0:
                body = raw[8 : 8 + size]
                if body[:4] == struct.pack("<I", _FRAME):  # a dictionary may be compressed itself
                    body = zstandard.ZstdDecompressor().decompress(body)
                press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
            at += 8 + size
            continue
        if mark != _FRAME:
            raise ValueError(f"no Zstandard frame at byte {at}")
        end = _frame_end(raw, at)
        yield press.decompress(raw[at:end])
        at = end


def _fields(head: bytes) -> dict[str, str]:
    return dict((k.lower(), v.strip()) for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:]))


def _parsed(record: bytes, payloads: bool) -> tuple:
    head, _, rest = record.partition(b"\r\n\r\n")
    f = _fields(head)
    block = rest[: int(f["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record is not as long as it says")
    body = size = digest = stated = None
    if f.get("content-type", "").startswith("application/http"):
        http, _, body = block.partition(b"\r\n\r\n")
        stated = int(_fields(http)["content-length"])
        if f["warc-type"] == "response":
            size, digest = len(body), digest32(hashlib.sha1(body).digest())
            if f["warc-payload-digest"] != "sha1:" + digest or size != stated:
                raise ValueError(f"a payload is not what its record {f['warc-record-id']} says")
    page = f.get("x-page-id")
    return f["warc-type"], f["warc-record-id"], None if page is None else int(page), f.get("warc-target-uri"), f["warc-date"], f.get("warc-refers-to"), f.get("warc-payload-digest", "").removeprefix("sha1:") or None, stated, size, digest, body if payloads and size is not None else None


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of a folder's archives: type, ids, target, what the record states, and length, digest and bytes of a response's payload.

    Each payload is held against its record's digest and length; one that differs is an error. Only responses have a payload here.
    """
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                for record in records_of(content.as_py()):
                    held.append(_parsed(record, payloads))
                    size += len(record)
                    if size > ARCHIVE:
                        yield record_batch(_RECORD, *zip(*held))
                        held, size = [], 0
                if held:
                    yield record_batch(_RECORD, *zip(*held))

    kinds = {pa.string(): T.StringType(), pa.int64(): T.LongType(), pa.binary(): T.BinaryType()}
    schema = T.StructType([T.StructField(f.name, kinds[f.type]) for f in _RECORD])
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def resolved(records: DataFrame) -> DataFrame:
    """Responses and revisits (page_id, warc_type, target_uri, ...), revisits with length, digest and page_id of the response they name.

    A revisit whose response isn't among the records, or has another digest than it states, is an error.
    """
    from .common import materialize

    small = materialize(records.where("warc_type IN ('response', 'revisit')").drop("payload"))
    response = small.where("warc_type = 'response'")
    of = response.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("of_bytes"), F.col("payload_digest").alias("of_digest"))
    met = small.where("warc_type = 'revisit'").drop("payload_bytes", "payload_digest").join(of, "refers_to_id", "left")
    right = F.coalesce((F.col("of_digest") == F.col("stated_digest")) & (F.col("of_bytes") == F.col("stated_bytes")), F.lit(False))
    met = met.withColumn("payload_digest", F.when(right, F.col("of_digest")).otherwise(F.raise_error(F.concat(F.lit("no response for the revisit "), "record_id"))))
    out = ["page_id", "warc_type", "record_id", "target_uri", "date", "payload_bytes", "payload_digest", "refers_to"]
    return response.withColumn("refers_to", F.lit(None).cast("long")).select(out).unionByName(met.withColumnRenamed("of_bytes", "payload_bytes").select(out))


def archived(pages: DataFrame, path: str | None = None, least: int = 0) -> DataFrame:
    """Pages written to archives and read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = write_archives(pages, path or shared_dir(spark), least)
    back = resolved(read_archives(spark, path, payloads=False))
    return back.select("page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), "refers_to")
