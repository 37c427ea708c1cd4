"""Dictionary-compressed WARC archives.

Every archive begins with a skippable frame that holds a Zstandard dictionary,
trained on the archive's own first records; then each record follows as a
frame of its own, compressed with that dictionary. A payload that occurs again
is written as a revisit of the record with the smallest page id.

Archives are written by the tasks through Arrow's file systems to the shared
folder, under names of their attempt; the manifest, which Spark commits with the
task, lists those of the attempts that counted, and only they are read. They are
bounded in size, and so are the records kept for the dictionary.

Edge cases: null html is an empty payload; empty payloads are deduplicated like
others; a null page id is written without its header field, never revisited if
another id has the payload, and read back as null; repeated rows (same id and
payload) are one page written twice, with the same record type; with too few
records to train on an archive has no dictionary frame; other columns are
ignored, whatever their names; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_ROWS, arrow_schema, prepare_python, shared_dir, table, to_batch

#: Fixed values of the formats: magic number of the dictionary's skippable
#: frame, and the revisit profile.
DICTIONARY_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of a dictionary, of the records that it is trained on, of an archive
#: before compression, and the least count of records to train on.
DICTIONARY_BYTES, TRAINING_BYTES, ARCHIVE_BYTES, LEAST_RECORDS = 32 << 10, 2 << 20, 256 << 20, 16
DATE = "1970-01-01T00:00:00Z"
LEVEL = 3


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>"


def write_record(page: dict) -> bytes:
    """A WARC record of ``page_id, url, payload, first_id, first_url``; with a
    first page it is a revisit, which has the headers but not the payload."""
    payload, url = page["payload"], page["url"] or ""
    digest = payload_digest(payload)
    revisit = page["first_id"] is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page['page_id'], page['url'], digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join(url.split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if page["page_id"] is not None:
        lines.append(f"X-Page-ID: {page['page_id']}")
    if revisit:
        lines += [
            f"WARC-Profile: {PROFILE}",
            f"WARC-Refers-To: {record_id(page['first_id'], page['first_url'], digest)}",
            f"WARC-Refers-To-Target-URI: {' '.join((page['first_url'] or '').split())}",
            f"X-Refers-To-Page-ID: {page['first_id']}",
        ]
    lines.append(f"Content-Length: {len(body)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields (both with lower-case names) and payload."""

    def fields(block: bytes) -> dict[str, str]:
        pairs = (x.split(": ", 1) for x in block.decode().split("\r\n")[1:])
        return {k.lower(): v for k, v in pairs}

    head, rest = data.split(b"\r\n\r\n", 1)
    warc = fields(head)
    http, payload = rest[: int(warc["content-length"])].split(b"\r\n\r\n", 1)
    return warc, fields(http), payload


def train(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    if len(records) < LEAST_RECORDS:
        return None
    size = min(DICTIONARY_BYTES, sum(map(len, records)) // 8)
    try:
        return zstandard.train_dictionary(size, records, k=256, d=8, level=LEVEL)
    except zstandard.ZstdError:  # too little to learn from
        return None


def compress(records: Iterator[bytes]) -> Iterator[bytes]:
    """The frames of one archive; records are held back until the dictionary
    is trained."""
    held: list[bytes] = []
    size = 0
    for r in records:
        held.append(r)
        size += len(r)
        if size >= TRAINING_BYTES:
            break
    dictionary = train(held)
    if dictionary:
        raw = dictionary.as_bytes()
        yield struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw
    squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True).compress
    for r in held:
        yield squeeze(r)
    for r in records:
        yield squeeze(r)


def decompress(stream) -> Iterator[bytes]:
    """The records of an archive, read as a stream."""
    head, dictionary = stream.read(8), None
    if len(head) == 8 and struct.unpack("<II", head)[0] == DICTIONARY_MAGIC:
        dictionary = zstandard.ZstdCompressionDict(stream.read(struct.unpack("<II", head)[1]))
        head = b""
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    rest = head
    while True:
        frame, out = reader.decompressobj(), b""
        while not frame.eof:
            if not rest:
                rest = stream.read(1 << 16)
                if not rest:
                    if out:
                        raise ValueError("the archive ends within a record")
                    return
            out += frame.decompress(rest)
            rest = frame.unused_data if frame.eof else b""
        yield out


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``page_id, url, html`` to archives in ``folder``; returns the
    manifest (path, records, bytes), which is stored there as well."""
    spark = pages.sparkSession
    prepare_python(spark)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    # a null id would be the least of a struct; it comes last instead
    least = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url"))
    firsts = rows.groupBy("digest").agg(least.alias("first"), F.count("*").alias("n")).filter("n > 1")
    firsts = firsts.select("digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    rows = rows.join(firsts, "digest", "left")
    own = F.col("page_id") == F.col("first_id")
    rows = rows.withColumns({c: F.when(own, None).otherwise(F.col(c)) for c in ("first_id", "first_url")})
    rows = rows.select("page_id", "url", "payload", "first_id", "first_url")
    fields = arrow_schema(spark, "path string, records long, bytes long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        task, attempt, number = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), 0
        records = (write_record(r) for b in batches for r in b.to_pylist())
        ahead = next(records, None)
        while ahead is not None:
            count, size = 0, 0

            def part() -> Iterator[bytes]:
                nonlocal ahead, count, size
                while ahead is not None and size < ARCHIVE_BYTES:
                    count, size = count + 1, size + len(ahead)
                    yield ahead
                    ahead = next(records, None)

            # named by the attempt, so that only a manifest of the same attempt names it
            name, written = f"{base}/part-{task:06d}-{attempt}-{number:04d}.warc.zst", 0
            system.create_dir(base)
            with system.open_output_stream(name, compression=None) as out:
                for frame in compress(part()):
                    out.write(frame)
                    written += len(frame)
            yield to_batch([(name, count, written)], fields)
            number += 1

    manifest = f"{folder}/manifest.parquet"
    rows.mapInArrow(run, "path string, records long, bytes long").write.parquet(manifest)
    return spark.read.schema("path string, records long, bytes long").parquet(manifest)


def read_archives(manifest: DataFrame, folder: str, id_type: str = "long") -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type,
    refers_to, url. Payload digests of responses are computed again."""
    spark = manifest.sparkSession
    schema = (
        f"page_id {id_type}, payload_bytes long, payload_digest string, record_type string, "
        f"refers_to {id_type}, url string"
    )
    fields = arrow_schema(spark, schema)
    number = lambda x: None if x is None else int(x)

    def rows(path: str, system: fs.FileSystem) -> Iterator[tuple]:
        with system.open_input_stream(path, compression=None) as stream:
            for data in decompress(stream):
                warc, http, payload = parse_record(data)
                digest, kind = warc["warc-payload-digest"].removeprefix("sha1:"), warc["warc-type"]
                if kind == "response" and (len(payload) != int(http["content-length"]) or payload_digest(payload) != digest):
                    raise ValueError(f"{path}: a payload differs from its digest")
                refers = number(warc.get("x-refers-to-page-id"))
                yield number(warc.get("x-page-id")), int(http["content-length"]), digest, kind, refers, warc["warc-target-uri"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _open(folder)
        held: list[tuple] = []
        for b in batches:
            for path in b.column(0).to_pylist():
                for r in rows(path, system):
                    held.append(r)
                    if len(held) >= BATCH_ROWS:
                        yield to_batch(held, fields)
                        held = []
        yield to_batch(held, fields)

    archives = max(1, manifest.count())
    return manifest.select("path").repartition(archives).mapInArrow(run, schema)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    manifest = write_archives(pages, folder)
    return read_archives(manifest, folder, pages.schema["page_id"].dataType.simpleString()).drop("url")


#: Five hex digits of the SHA-1 make four base32 letters.
OP1_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
  FROM pages
), v AS (
  SELECT *, list_transform(range(8), lambda g: ('0x' || substr(h, 5 * g + 1, 5))::BIGINT) AS groups FROM p
)
SELECT page_id,
       octet_length(encode(html)) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((groups[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31)::INTEGER + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM v
"""
