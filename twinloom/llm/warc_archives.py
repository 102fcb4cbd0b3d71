"""WARC archives without repeated payloads.

Every page becomes a WARC record. Headers (page, length, digest) are shuffled by payload digest;
where a payload of LEAST_BYTES or more occurs again, the page of smallest page_id stays a
response and the others are revisits that refer to it. Revisits carry no payload, so a payload
found in a third of all pages is written and moved once.

The archives are written by Spark's text sink: a record's header and block are one text, and
the line separator is the empty lines that end a record. Tasks commit their files as in any
other write, so lost executors leave no half archives, and any file system that Spark writes to
will do. An archive is one gzip stream. Reading walks an archive by Content-Length, since a payload may hold empty lines of
its own, and checks every digest; it holds one archive, of less than about ARCHIVE_BYTES, per task.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinloom.llm.common import partitions, shared_folder, stored, tidy

LEAST_BYTES = 100  # of a payload that may be replaced by a revisit
ARCHIVE_BYTES = 64 << 20
WRITTEN = "2000-01-01T00:00:00Z"  # date in the headers where the caller gives none

# Names of the WARC 1.1 format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"


# ---- headers -----------------------------------------------------------------------


def page_headers(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, html, payload_bytes, payload_digest); a null html is empty."""
    body = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        body.alias("html"),
        F.octet_length(body).cast("long").alias("payload_bytes"),
        F.sha2(body.cast("binary"), 256).alias("payload_digest"),
    )


def originals(headers: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Rows (payload_digest, original): the smallest page_id of each payload that occurs more than once."""
    return (
        headers.where(F.col("payload_bytes") >= least)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("original"), F.count("*").alias("n"))
        .where("n > 1 and original is not null")
        .select("payload_digest", "original")
    )


def resolved(headers: DataFrame, firsts: DataFrame) -> DataFrame:
    """Add record_type and refers_to. ``firsts`` has one row per repeated payload."""
    again = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return (
        headers.join(firsts, "payload_digest", "left")
        .withColumn("record_type", F.when(again, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(again, F.col("original")))
        .drop("original")
    )


# ---- writing -----------------------------------------------------------------------


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _page_uri(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def record_text(written: str = WRITTEN) -> Column:
    """A whole record but for the lines that end it."""
    revisit = F.col("record_type") == "revisit"
    # a header field is one line of visible characters
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "%20")
    uri = F.when(uri == "", F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")))).otherwise(uri)
    answer = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        _field("Content-Length", F.col("payload_bytes").cast("string")),
        F.lit("\r\n"),
    )
    block = F.concat(answer, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    length = F.octet_length(answer) + F.when(revisit, F.lit(0).cast("long")).otherwise(F.col("payload_bytes"))
    nothing = F.lit("")
    return F.concat(
        F.lit(f"{VERSION}\r\n"),
        _field("WARC-Type", F.col("record_type")),
        _field("WARC-Record-ID", _page_uri(F.col("page_id"))),
        _field("WARC-Date", F.lit(written)),
        _field("WARC-Target-URI", uri),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        _field("Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(revisit, _field("WARC-Profile", F.lit(PROFILE))).otherwise(nothing),
        F.when(revisit, _field("WARC-Refers-To", _page_uri(F.col("refers_to")))).otherwise(nothing),
        _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", length.cast("string")),
        F.lit("\r\n"),
        block,
    )


def write_archives(
    pages: DataFrame,
    folder: str,
    least: int = LEAST_BYTES,
    archive_bytes: int = ARCHIVE_BYTES,
    written: str = WRITTEN,
) -> None:
    """Write pages (page_id, url, html) as WARC files of about ``archive_bytes`` into a new folder.

    Payloads of at least ``least`` bytes are written once. Rows that repeat a page_id together with its payload
    have the same type; one with a null page_id is a revisit where its payload has a page_id, else a response.
    Null texts and urls count as empty (an empty url becomes ``urn:page:<page_id>``, control characters in one %20).
    """
    headers = page_headers(pages)
    firsts = stored(originals(headers.drop("html"), least))
    size = headers.agg(F.coalesce(F.sum(F.col("payload_bytes") + 512), F.lit(0)).alias("n")).first()["n"]
    files = max(1, math.ceil(size / archive_bytes), min(partitions(pages.sparkSession), math.ceil(size / (1 << 20))))
    whole = resolved(headers, firsts)
    lean = whole.withColumn("html", F.when(F.col("record_type") == "response", F.col("html")))
    spread = F.xxhash64("page_id", "payload_digest", "url", F.monotonically_increasing_id())
    text = lean.withColumn("spread", spread).repartition(files, "spread").select(record_text(written).alias("value"))
    text.write.option("lineSep", END).option("compression", "gzip").text(folder)


# ---- reading -----------------------------------------------------------------------

_RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
_RECORD_SCHEMA = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("payload", pa.binary()),
    ]
)


def parsed(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of an archive, compressed or not."""
    stream = io.BytesIO(archive)
    if archive[:2] == b"\x1f\x8b":
        stream = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 16)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            fields[name.lower()] = value
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) < size or stream.read(4) != END.encode():
            raise ValueError(f"{fields['warc-record-id']}: another length than its header says")
        yield fields, block


def _page(uri: str | None) -> int | None:
    name = uri[len("<urn:page:") : -1] if uri else "none"
    return None if name == "none" else int(name)


def _read(with_payload: bool):
    names = [n for n in _RECORD_SCHEMA.names if with_payload or n != "payload"]
    schema = pa.schema([_RECORD_SCHEMA.field(n) for n in names])

    def record(fields: dict[str, str], block: bytes) -> dict:
        kind = fields["warc-type"]
        payload = None
        if kind == "response":
            payload = block[block.index(END.encode()) + 4 :]
            if fields["warc-payload-digest"] != "sha256:" + hashlib.sha256(payload).hexdigest():
                raise ValueError(f"{fields['warc-record-id']}: the payload has another digest")
        return {
            "page_id": _page(fields["warc-record-id"]),
            "url": fields["warc-target-uri"],
            "record_type": kind,
            "refers_to": _page(fields.get("warc-refers-to")),
            "payload_bytes": len(payload) if payload is not None else int(fields["payload-length"]),
            "payload_digest": fields["warc-payload-digest"].removeprefix("sha256:"),
            "payload": payload if with_payload else None,
        }

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows: list[dict] = []
                size = 0
                for fields, block in parsed(content.as_py()):
                    rows.append({n: v for n, v in record(fields, block).items() if n in names})
                    size += len(block)
                    if size > 4 << 20 or len(rows) >= 4096:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives of a folder.

    Columns: page_id, url (as written), record_type, refers_to, payload_bytes and payload_digest (of the
    full payload, also of revisits), payload (null for revisits; left out unless asked for). A digest or length
    that does not hold raises an error.
    """
    files = spark.read.format("binaryFile").load(folder).select("content")
    names = _RECORD if with_payload else _RECORD.removesuffix(", payload binary")
    # an archive is large: a batch holds one
    return files.mapInArrow(_one_by_one(_read(with_payload)), names)


def _one_by_one(read):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return read(batch.slice(k, 1) for batch in batches for k in range(batch.num_rows))

    return run


def revisited(records: DataFrame) -> DataFrame:
    """Records with their payload: revisits get that of the response with their digest."""
    found = records.where("record_type = 'revisit'").select("payload_digest").distinct()
    full = (
        records.where("record_type = 'response'")
        .join(found, "payload_digest", "left_semi")
        .groupBy("payload_digest")
        .agg(F.first("payload").alias("first_payload"))
    )
    return (
        records.join(full, "payload_digest", "left")
        .withColumn("payload", F.coalesce("payload", "first_payload"))
        .select(*records.columns)
    )


def op12_warc_archives(spark, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(spark, folder, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


OP12_SQL = """
WITH p AS (
  SELECT page_id::BIGINT AS page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
),
f AS (SELECT payload_digest, min(page_id) AS original FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN original <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN original <> page_id THEN original END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
