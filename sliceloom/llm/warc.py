"""WARC archives with revisit records: duplicates by payload digest refer to one original response."""

from __future__ import annotations

import hashlib
import io
import re
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

from sliceloom.llm.store import save, shared_path

#: Fixed values of the archive format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_END = "\r\n\r\n"

#: Payload bytes that one file holds by expectation; files of any size are read as streams.
FILE_BYTES = 64 << 20
#: Bytes that the reader holds before it returns a batch.
READ_BYTES = 4 << 20


def resolve(headers: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """headers (page_id, url, payload_bytes, payload_digest) + refers_to and refers_url: the largest page_id of equal payloads, null for responses, and its address.

    Headers meet by digest after a partial aggregate; only digests that occur twice return to the headers, so a hot
    payload is pre-aggregated and its headers may be dealt out by the engine's skew join. Repeated rows of the
    largest page_id are all responses; rows without a page_id are never referred to, and are responses where no
    other row has their payload.
    """
    large = F.col("payload_bytes") >= least_bytes
    originals = headers.where(large).groupBy("payload_digest", "payload_bytes").agg(F.max(F.struct("page_id", "url")).alias("_o"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes"), F.col("_o.page_id").alias("_original"), F.col("_o.url").alias("_url"))
    joined = headers.join(originals, (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_bytes") == F.col("_bytes")), "left")
    refers = F.when(large & ~F.col("_original").eqNullSafe(F.col("page_id")), F.col("_original"))
    return joined.withColumn("refers_to", refers).withColumn("refers_url", F.when(F.col("refers_to").isNotNull(), F.col("_url"))).drop("_digest", "_bytes", "_original", "_url")


def _header_value(c: Column) -> Column:
    """One line: control characters become percent signs and digits, so that a value cannot end a header."""
    out = c
    for code in (0x0D, 0x0A, 0x00):
        out = F.replace(out, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return out


def record(page_id: Column, url: Column, payload: Column, n: Column, digest: Column, refers_to: Column, date: Column, copy: Column, refers_url: Column, several: Column) -> Column:
    """A record's text without its end: version, fresh headers, an empty line, and the block.

    A page's record is named by its page_id; where rows share one or have none (copy is not null), also by copy, a
    number of its own, since no two records may have one name. A revisit names its original's record unless several
    have that page_id (several), and always its page and address.
    """
    block = F.when(refers_to.isNull(), payload).otherwise("")
    length = F.when(refers_to.isNull(), n).otherwise(0)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    optional = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    named = F.concat(F.lit("<urn:page:"), F.concat_ws(":", page_id.cast("string"), F.concat(F.lit("row:"), copy.cast("string"))), F.lit(">"))
    return F.concat(
        F.lit(f"{VERSION}\r\n"),
        line("WARC-Type", F.when(refers_to.isNull(), "response").otherwise("revisit")),
        line("WARC-Record-ID", named),
        line("WARC-Date", date),
        optional("WARC-Target-URI", _header_value(url)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        line("WARC-Payload-Bytes", n.cast("string")),
        optional("WARC-Refers-To", F.when(~several, F.concat(F.lit("<urn:page:"), refers_to.cast("string"), F.lit(">")))),
        optional("WARC-Refers-To-Target-URI", _header_value(refers_url)),
        optional("Page-ID", page_id.cast("string")),
        optional("Page-Refers-To", refers_to.cast("string")),
        F.when(refers_to.isNull(), "").otherwise(f"WARC-Profile: {REVISIT_PROFILE}\r\n"),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
        block,
    )


def _dates(pages: DataFrame, date_column: str | None, run_date: datetime | None) -> Column:
    """Dates of the records: date_column where it has one, else one date for the whole run."""
    stamp = (run_date or datetime.now(UTC)).astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    if date_column is None:
        return F.lit(stamp)
    kind = pages.schema[date_column].dataType
    if not isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
        raise ValueError(f"column {date_column} dates no records: it is {kind.simpleString()}, not a date or timestamp")
    return F.coalesce(F.date_format(F.col(f"`{date_column}`").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(stamp))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 1000, date_column: str | None = None, run_date: datetime | None = None) -> None:
    """Write pages (page_id long, url, html) as gzipped archives of deduplicated records to a new path.

    A null html is an empty payload, a null url has no header; repeated rows, and rows of one page_id, are records of
    their own with names of their own, and so are rows without page_id. Very long pages stand in files of their size.
    Records are dated by date_column (a date or timestamp, in the session's time zone; null: the run's date) or by the
    date of the run, run_date or now; other columns, whatever their names, play no part. An empty table writes no record.
    The engine's own text writer puts the files out, with the record end as its line end, so a lost executor's files
    are written again and commits are whole. Only headers are shuffled by digest; the table of revisits, without
    payloads, joins the pages, and each payload stays with its reading task unless that table is large. A file closes
    after as many records as hold about FILE_BYTES on average.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), _dates(pages, date_column, run_date).alias("date"))
    described = rows.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha1(F.encode("html", "UTF-8")))
    headers = save(described.select("page_id", "url", "payload_bytes", "payload_digest"), "headers")
    repeated = headers.where("page_id is not null").groupBy("page_id").count().where("count > 1").select(F.col("page_id").alias("_again"))
    several = repeated.withColumnRenamed("_again", "_several")
    resolved = resolve(headers, least_bytes).join(repeated, F.col("page_id") == F.col("_again"), "left").where("refers_to is not null or _again is not null")
    resolved = resolved.select("page_id", "payload_digest", "refers_to", "refers_url", "_again").distinct().join(several, F.col("refers_to") == F.col("_several"), "left")
    notes = resolved.select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"), "refers_to", "refers_url", "_again", F.col("_several").isNotNull().alias("several"))
    joined = described.join(notes, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left")  # the one join that payloads take part in
    copy = F.when(F.col("_again").isNotNull() | F.col("page_id").isNull(), F.monotonically_increasing_id())
    named = [F.col(c) for c in ("page_id", "url", "html", "payload_bytes", "payload_digest", "refers_to", "date")]
    lines = joined.select(record(*named, copy, F.col("refers_url"), F.coalesce("several", F.lit(False))).alias("value"))
    mean = headers.agg(F.avg("payload_bytes")).first()[0] or 0
    records = max(1, int(FILE_BYTES / (mean + 500)))
    lines.write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", records).text(path)


_FIELD = re.compile(rb"([!-9;-~]+):[ \t]*([^\r\n]*)\r\n")
READ_SCHEMA = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def parse(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record, by Content-Length, holding one record; a stream that breaks the format raises ValueError."""
    number = 0
    while start := stream.readline(1 << 16):
        number += 1
        if start != VERSION.encode() + b"\r\n":
            raise ValueError(f"record {number} does not start with its version")
        fields: dict[str, str] = {}
        while (header := stream.readline(1 << 20)) != b"\r\n":
            m = _FIELD.fullmatch(header)
            if not m:
                raise ValueError(f"record {number} has a broken header")
            fields[m[1].decode().lower()] = m[2].decode()
        n = int(fields["content-length"])
        block = stream.read(n)
        if len(block) != n or stream.read(4) != RECORD_END.encode():
            raise ValueError(f"record {number} does not end where it should")
        yield fields, block


class _Stream(io.RawIOBase):
    """The bytes of lines, each with the line end that the reader took off."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.parts = (part for batch in batches for line in batch.column(0) for part in (memoryview(line.as_buffer()).cast("B"), RECORD_END.encode()))
        self.left = memoryview(b"")

    def readable(self) -> bool:
        return True

    def readinto(self, into: memoryview) -> int:
        while not len(self.left):
            part = next(self.parts, None)
            if part is None:
                return 0
            self.left = memoryview(part)
        n = min(len(into), len(self.left))
        into[:n], self.left = self.left[:n], self.left[n:]
        return n


def read_archives(spark, path: str, with_payload: bool = True) -> DataFrame:
    """Records of archives at path. Bytes and digest of a response come from its payload as read, those of a revisit from its headers.

    Files are read as streams of lines that end like records, put together again by Content-Length, so neither a file
    nor more than one record is held, and payloads may hold record ends. Broken archives raise ValueError in the task.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda v: int(v) if v else None
        rows, held = [], 0
        for fields, block in parse(io.BufferedReader(_Stream(batches), 1 << 20)):
            response = fields["warc-type"] == "response"
            digest = hashlib.sha1(block).hexdigest() if response else fields["warc-payload-digest"].removeprefix("sha1:")
            n = len(block) if response else int(fields["warc-payload-bytes"])
            rows.append((number(fields.get("page-id")), fields.get("warc-target-uri"), fields["warc-type"], n, digest, number(fields.get("page-refers-to")), block if response and with_payload else None))
            held += len(block) if with_payload else 200
            if held > READ_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    lines = spark.read.option("lineSep", RECORD_END).option("pathGlobFilter", "part-*").text(path)
    return lines.select(F.col("value").cast("binary").alias("value")).mapInArrow(records, READ_SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def round_trip(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Archives written to the shared folder and read again: page_id, payload_bytes, payload_digest, record_type, refers_to, a row for each row of pages.

    Null html counts as empty; repeated rows are records of their own; other columns may have any name and play no
    part; an empty table gives an empty table.
    """
    path = shared_path(pages.sparkSession, "warc")
    write_archives(pages, path, least_bytes)
    return read_archives(pages.sparkSession, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
