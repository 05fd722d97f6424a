"""WARC archives: index first, then coalesced byte-range reads.

Writing tasks append one gzip member per record to an archive of their own in the shared folder and
return one index row per record (archive, offset, length, url, digest).  Spark commits the index, so
a lost task leaves at most an archive that no index row names.  Readers range-partition the index by
archive and offset and fetch neighbouring records with one read each.
"""

from __future__ import annotations

import gzip
import hashlib
import math
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, lean, scratch, written

INDEX = "page_id long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long, archive string, offset long, length long"
READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Written on every record; the pages carry no fetch time.
DATE = "1970-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a string or binary column, five hex digits (20 bits) at a time."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), HEX32, BASE32)


def with_revisits(pages: DataFrame, key: str = "page_id", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """Add payload_digest, payload_bytes, record_type and refers_to.

    Of rows with equal payloads of at least min_bytes bytes, those with the largest key are
    responses and the others revisits of it; smaller payloads are all responses.  Null payloads
    count as empty.  A null key never is the largest: it revisits, unless no row of the group has one.
    Rows that repeat the largest key are all responses.  Only digests and keys are shuffled; payloads
    are where the repeated digests are too many to broadcast.
    """
    rows = pages.withColumn(payload, F.coalesce(F.col(payload), F.lit("")))
    rows = rows.withColumn("payload_digest", base32_sha1(F.col(payload))).withColumn("payload_bytes", F.octet_length(payload).cast("long"))
    groups = rows.filter(F.col("payload_bytes") >= min_bytes).groupBy(F.col("payload_digest").alias("_digest")).agg(F.max(key).alias("_newest"), F.count("*").alias("_n"))
    newest = bounded(written(groups.filter("_n > 1").drop("_n"), "repeated"))
    joined = rows.join(newest, (rows.payload_digest == newest._digest) & (rows.payload_bytes >= min_bytes), "left")
    revisit = F.col("_newest").isNotNull() & ~F.col(key).eqNullSafe(F.col("_newest"))
    return (
        joined.withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(revisit, F.col("_newest")))
        .drop("_digest", "_newest")
    )


def header_lines(page_id: int | None, url: str | None, kind: str, refers_to: int | None, digest: str, size: int, block: int) -> bytes:
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {block}",
    ]
    if kind == "revisit":
        lines[2:2] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def write_archives(records: DataFrame, folder: str, key: str = "page_id", payload: str = "html", level: int = 4) -> DataFrame:
    """Write one archive per task into folder (any URI that pyarrow.fs opens); gives the index rows, lazily.

    Evaluate the result once, by writing it: that is the archive's index.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = fs.FileSystem.from_uri(folder)
        store.create_dir(place, recursive=True)
        name, offset, sink = f"{uuid.uuid4().hex}.warc.gz", 0, None
        try:
            for batch in batches:
                rows = []
                for page_id, url, kind, refers_to, digest, size, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    body = b"" if kind == "revisit" else body.encode()
                    record = header_lines(page_id, url, kind, refers_to, digest, size, len(body)) + body + b"\r\n\r\n"
                    packed = gzip.compress(record, level, mtime=0)
                    sink = sink or store.open_output_stream(f"{place}/{name}", compression=None)
                    sink.write(packed)
                    rows.append((page_id, url, digest, size, kind, refers_to, name, offset, len(packed)))
                    offset += len(packed)
                if rows:
                    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in INDEX.split(", ")])
        finally:
            if sink:
                sink.close()

    columns = [F.col(key).cast("long").alias("page_id"), F.col("url"), F.col("record_type"), F.col("refers_to").cast("long"), F.col("payload_digest"), F.col("payload_bytes"), F.col(payload)]
    return records.select(*columns).mapInArrow(lean(run), INDEX)


def coalesced(ranges: Iterable[tuple[str, int, int]], gap: int, most: int) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Join sorted (archive, offset, length) ranges that are at most gap apart into reads of up to most bytes."""
    held: list = []
    for archive, offset, length in ranges:
        if held and held[0] == archive and 0 <= offset - held[2] <= gap and offset + length - held[1] <= most:
            held[2] = max(held[2], offset + length)
            held[3].append((offset, length))
            continue
        if held:
            yield held[0], held[1], held[2], held[3]
        held = [archive, offset, offset + length, [(offset, length)]]
    if held:
        yield held[0], held[1], held[2], held[3]


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    size = int(fields["Content-Length"])
    if not version.startswith("WARC/") or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"damaged WARC record {fields.get('WARC-Record-ID')}")
    return fields, rest[:size]


def read_records(index: DataFrame, folder: str, partitions: int | None = None, gap: int = 1 << 16, most: int = 1 << 23) -> DataFrame:
    """Read the records that the index rows name; payload digests of responses are verified.

    A revisit has an empty payload column; its payload_bytes and digest are those of the response.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = fs.FileSystem.from_uri(folder)
        for batch in batches:
            source, opened, rows = None, None, []
            for archive, start, stop, parts in coalesced(zip(*(c.to_pylist() for c in batch.columns), strict=True), gap, most):
                if archive != opened:
                    if source:
                        source.close()
                    source, opened = store.open_input_file(f"{place}/{archive}"), archive
                data = source.read_at(stop - start, start)
                for offset, length in parts:
                    fields, body = parse_record(zlib.decompress(data[offset - start : offset - start + length], wbits=31))
                    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                    if kind == "response" and b32encode(hashlib.sha1(body).digest()).decode() != digest:
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
                    page = fields["WARC-Record-ID"][10:-1]
                    other = fields.get("WARC-Refers-To", "")[10:-1]
                    size = len(body) if kind == "response" else int(fields["X-Payload-Length"])
                    rows.append((int(page) if page else None, fields["WARC-Target-URI"], kind, int(other) if other else None, size, digest, body))
            if source:
                source.close()
            if rows:
                types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in READ.split(", ")])

    places = index.select("archive", "offset", "length")
    places = places.repartitionByRange(partitions, "archive", "offset") if partitions else places.repartitionByRange("archive", "offset")
    return places.sortWithinPartitions("archive", "offset").mapInArrow(lean(run), READ)


def archive_round_trip(pages: DataFrame, key: str = "page_id", payload: str = "html", min_bytes: int = 0, read_bytes: int = 4 << 20) -> DataFrame:
    """Write every page as a WARC record in the shared folder and read all of them back through the index."""
    spark = pages.sparkSession
    folder, index_path = scratch(spark, "warc"), scratch(spark, "warc-index")
    records = with_revisits(pages.select(key, "url", payload), key, payload, min_bytes)
    write_archives(records, folder, key, payload).write.parquet(index_path)
    index = spark.read.schema(INDEX).parquet(index_path)
    # Index rows are narrow: deal the reads out by the bytes of the archives that they name.
    stored = index.agg(F.sum("length")).first()[0] or 0
    return read_records(index, folder, partitions=max(1, math.ceil(stored / read_bytes)))
