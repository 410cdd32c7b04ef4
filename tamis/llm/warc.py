"""WARC archives with revisit records for repeated payloads.

Headers (id, digest, length) are shuffled by payload digest and reduced to the original of each digest; pages join
their original; a page that is not the original becomes a revisit record without payload.  Archives are written by
Spark's text sink: a row is one record, and the line separator is the end of a record, so files appear in the shared
folder through Spark's own committer and a lost executor only repeats its task.  Reading takes each archive as a binary
file (their size is bounded by `archive_bytes`, or one longer record) and walks its records by Content-Length.

Record ids follow from the page id and the row's place in its input file, so rows that repeat a page id have records of
their own and a repeated task writes the same ones.  Dates are those of the run.

A null payload is empty.  Payloads under `least` bytes are never revisits.  Of equal payloads the row with the largest
page id is the response; rows that repeat that id are all responses; rows without an id never are the original, and are
responses where no row of their digest has an id.  Null urls become `urn:none`; control characters and spaces in urls
are percent-encoded.  An empty table gives no records.  Other columns are ignored.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm.common import new_path

LEAST_BYTES = 1000
ARCHIVE_BYTES = 32 << 20
#: Fixed values of the WARC format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SCHEMA = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def with_digest(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), body.alias("payload"), F.monotonically_increasing_id().alias("row"))
    return rows.withColumns({"payload_digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})


def resolve(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Rows of with_digest plus refers_to, refers_row and refers_url: the original that a revisit repeats, else null.

    Of rows that share the largest page id the first one is referred to.
    """
    latest = F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", (-F.col("row")).alias("place"), "url"))).alias("latest")
    heads = pages.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(latest, F.count("*").alias("n"))
    heads = heads.where((F.col("n") > 1) & F.col("latest").isNotNull()).select(F.col("payload_digest").alias("of_digest"), F.col("payload_bytes").alias("of_bytes"), "latest")
    joined = pages.join(heads, (F.col("payload_digest") == F.col("of_digest")) & (F.col("payload_bytes") == F.col("of_bytes")), "left")
    again = F.col("latest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("latest.page_id"))
    of = lambda c: F.when(again, c)
    return joined.select("page_id", "url", "row", "payload_digest", "payload_bytes", of(F.col("latest.page_id")).alias("refers_to"), of(-F.col("latest.place")).alias("refers_row"), of(F.col("latest.url")).alias("refers_url"), F.when(~again, F.col("payload")).alias("payload"))


def _record_id(page_id: Column, row: Column) -> Column:
    """A uuid urn that follows from the page id and the row, so that a repeated task writes the same record."""
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("none")), row.cast("string")).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _target(url: Column) -> Column:
    return F.coalesce(F.regexp_replace(url, r"[\x00-\x20\x7F]", "%20"), F.lit("urn:none"))


def records(resolved: DataFrame, date: str) -> DataFrame:
    """One column, value: the bytes of each record up to its closing blank lines, as text."""
    revisit = F.col("refers_to").isNotNull()
    payload = F.coalesce(F.col("payload"), F.lit("").cast("binary"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))
    original = F.concat(
        line("WARC-Profile", F.lit(REVISIT_PROFILE)),
        line("WARC-Refers-To", _record_id(F.col("refers_to"), F.col("refers_row"))),
        line("WARC-Refers-To-Target-URI", _target(F.col("refers_url"))),
        line("WARC-Refers-To-Date", F.lit(date)),
        line("X-Refers-To-Page-Id", F.col("refers_to")),
    )
    head = F.concat(
        F.lit(f"{VERSION}\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("row"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", _target(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("X-Page-Id", F.coalesce(F.col("page_id").cast("string"), F.lit("-"))),
        line("X-Payload-Length", F.col("payload_bytes")),
        F.when(revisit, original).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.octet_length(payload)),
        F.lit("\r\n"),
    )
    return resolved.select(F.concat(head, payload.cast("string")).alias("value"))


def write_archives(pages: DataFrame, path: str, least: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES, date: str | None = None) -> None:
    """gzip archives under path for rows of with_digest; each is closed after about archive_bytes before compression; date: the present one where none is given.

    Records are written where the join by digest leaves them, so payloads are shuffled once.
    """
    mean = pages.select(F.coalesce(F.avg("payload_bytes"), F.lit(0.0))).first()[0] + 600
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = records(resolve(pages, least), date)
    rows.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", max(1, int(archive_bytes / mean))).text(path)


def parse_archive(data: bytes) -> Iterator[dict]:
    """The records of one gzip or plain archive: headers by name and payload."""
    with gzip.open(io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data) as f:
        while line := f.readline():
            if line in (b"\r\n", b"\n"):
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"not the start of a record: {line[:80]!r}")
            head = {}
            while (line := f.readline()) not in (b"\r\n", b"\n", b""):
                name, _, value = line.decode("utf-8").partition(":")
                head[name.strip().lower()] = value.strip()
            payload = f.read(n := int(head["content-length"]))
            if len(payload) != n:
                raise ValueError("an archive ends inside a record")
            yield {"head": head, "payload": payload}


def _read(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    for batch in batches:
        for data in batch.column("content"):
            rows, held = [], 0
            for r in parse_archive(data.as_py()):
                h = r["head"]
                page, ref = h["x-page-id"], h.get("x-refers-to-page-id")
                rows.append((None if page == "-" else int(page), h["warc-target-uri"], h["warc-type"], h["warc-payload-digest"].removeprefix("sha1:"), int(h["x-payload-length"]), ref and int(ref), r["payload"] if payloads else None))
                held += len(r["payload"]) * payloads
                if held > 8 << 20 or len(rows) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path).select("content")
    return files.mapInArrow(lambda batches: _read(batches, payloads), _SCHEMA)


def archive(pages: DataFrame, path: str | None = None, least: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES, payloads: bool = False, **cols: str) -> DataFrame:
    """Writes pages as deduplicated archives under path and returns what reading them gives."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_archives(with_digest(pages, **cols), path, least, archive_bytes)
    return read_archives(spark, path, payloads)
