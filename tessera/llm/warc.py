"""WARC as a content-addressed archive.

An archive is two tables. ``payloads`` holds every distinct payload once, under
its SHA-256 (with its length beside it, and the SHA-1 that WARC headers print);
``headers`` holds the exact header block of each record and the digest that its
payload has. A record is rebuilt by a join on the digest, and its payload is
hashed again on the way out, by SHA-256 against its address and by SHA-1 against its
header, so a damaged store fails instead of answering.

Defined cases: a null payload is an empty one; a null url is written as an empty
target; each repeated row is a record of its own, and of rows with equal page_id
and payload exactly one can be the response (the one with the smallest row
number given at writing time); a null page_id sorts before all others; further
columns of the input are ignored; an empty table makes an empty archive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, new_path

CRLF = "\r\n"
RESPONSE, REVISIT = "response", "revisit"
DATE = "1970-01-01T00:00:00Z"  # of pages that come without one
#: Digits of Java's base 32 and of RFC 4648, in order.
JAVA32, RFC32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 of a binary column in upper-case base32: 8 groups of 20 bits, each 5 hex digits in and 4 letters out."""
    hex_ = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hex_, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), JAVA32, RFC32)


@dataclass(frozen=True)
class Archive:
    headers: DataFrame
    payloads: DataFrame


def write_archive(rows: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", date: str = DATE, content_type: str = "text/html") -> Archive:
    """Write one WARC record per row. The payload bytes are shuffled once, already reduced to one copy per map task and digest. ``date`` and ``content_type`` stand in every header."""
    spark = rows.sparkSession
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    given = rows.select(F.col(key).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), body.alias("payload"))
    hashed = given.withColumn("sha256", F.unhex(F.sha2("payload", 256))).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    index = materialize(
        hashed.select("page_id", "url", "sha256", "n_bytes", base32_sha1(F.col("payload")).alias("digest"), F.monotonically_increasing_id().alias("row_no")),
        "index",
    )
    stored = new_path(spark, "payloads")
    hashed.groupBy("sha256", "n_bytes").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(stored)
    payloads = spark.read.parquet(stored)

    first = index.groupBy("sha256", "n_bytes").agg(F.min(F.struct("page_id", "row_no")).alias("first"))
    linked = index.join(first, ["sha256", "n_bytes"])
    is_first = F.col("row_no") == F.col("first.row_no")
    typed = linked.select("page_id", "url", "sha256", "n_bytes", "digest", F.when(is_first, RESPONSE).otherwise(REVISIT).alias("kind"), F.when(~is_first, F.col("first.page_id")).alias("origin"))
    return Archive(materialize(typed.select("sha256", "n_bytes", header_block(date, content_type).alias("header")), "headers"), payloads)


def header_block(date: str = DATE, content_type: str = "text/html") -> Column:
    """The exact header of a record, to the empty line that ends it. A revisit's own block is empty; its payload is found by digest."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    again = F.concat(
        line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("origin").cast("string"), F.lit("")), F.lit(">"))),
    )
    return F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.col("kind")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), page, F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(F.col("kind") == REVISIT, again).otherwise(line("Content-Type", F.lit(content_type))),
        line("Content-Length", F.when(F.col("kind") == RESPONSE, F.col("n_bytes")).otherwise(F.lit(0)).cast("string")),
        F.lit(CRLF),
    )


def field(header: Column, name: str) -> Column:
    return F.regexp_extract(header, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)


def read_records(archive: Archive) -> DataFrame:
    """Original records: header, full payload (of revisits too), and the header's fields, checked against the payload."""
    joined = archive.headers.join(archive.payloads, ["sha256", "n_bytes"])
    page = lambda name: F.regexp_extract(field(F.col("header"), name), "<urn:page:(-?[0-9]+)>", 1)
    number = lambda c: F.when(c != "", c).cast("long")
    read = joined.select(
        number(page("WARC-Record-ID")).alias("page_id"),
        field(F.col("header"), "WARC-Target-URI").alias("url"),
        field(F.col("header"), "WARC-Type").alias("record_type"),
        number(page("WARC-Refers-To")).alias("refers_to"),
        F.substring(field(F.col("header"), "WARC-Payload-Digest"), 6, 32).alias("stated"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        (F.unhex(F.sha2("payload", 256)) == F.col("sha256")).alias("at_its_address"),
        "header",
        "payload",
    )
    wrong = F.raise_error(F.concat(F.lit("payload of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(" does not have its digest")))
    return read.withColumn("payload_digest", F.when((F.col("stated") == F.col("payload_digest")) & F.col("at_its_address"), F.col("payload_digest")).otherwise(wrong)).drop("stated", "at_its_address")


def record_bytes(records: DataFrame) -> Column:
    """The record as it stands in a WARC file, without the two line ends after it."""
    own = F.when(F.col("record_type") == RESPONSE, F.col("payload")).otherwise(F.lit(b""))
    return F.concat(F.col("header").cast("binary"), own)


def export_warc(records: DataFrame, path: str, compression: str = "none") -> None:
    """Write plain WARC files through Spark's own writer: the line separator is what ends a record. Payloads must be UTF-8."""
    records.select(record_bytes(records).cast("string").alias("value")).write.option("lineSep", CRLF * 2).option("compression", compression).text(path)


def parse_warc(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """Records of one WARC file: header fields and block."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split(CRLF)
        fields = dict(line.split(": ", 1) for line in lines[1:])
        n = int(fields["Content-Length"])
        out.append((fields, data[end + 4 : end + 4 + n]))
        at = end + 4 + n + 4
    return out


def import_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files: record_id, record_type, payload_digest, refers_to, block, and payload, which for a revisit is the block of the response that it refers to (null if that is in none of the files). One file at a time per task."""

    def parsed(batches):
        import pyarrow as pa

        for batch in batches:
            for data in batch.column("content"):
                got = parse_warc(data.as_py())
                yield pa.RecordBatch.from_pydict(
                    {
                        "record_id": [f.get("WARC-Record-ID") for f, _ in got],
                        "record_type": [f.get("WARC-Type") for f, _ in got],
                        "payload_digest": [f.get("WARC-Payload-Digest") for f, _ in got],
                        "refers_to": [f.get("WARC-Refers-To") for f, _ in got],
                        "block": [b for _, b in got],
                    },
                    schema=pa.schema([(k, pa.string()) for k in ("record_id", "record_type", "payload_digest", "refers_to")] + [("block", pa.binary())]),
                )

    bounded_batches(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    records = files.mapInArrow(parsed, "record_id string, record_type string, payload_digest string, refers_to string, block binary")
    records = materialize(records, "records", compression="zstd")
    # a row that is written twice has one response and revisits of it, so (record, digest) names one response
    found = records.where(F.col("record_type") == RESPONSE).select(F.col("record_id").alias("refers_to"), "payload_digest", F.col("block").alias("found"))
    own = F.when(F.col("record_type") == RESPONSE, F.col("block")).otherwise(F.col("found"))
    return records.join(found, ["refers_to", "payload_digest"], "left").select("record_id", "record_type", "payload_digest", "refers_to", "block", own.alias("payload"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_records(write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH d AS (
  SELECT page_id, coalesce(html, '') AS body, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS head FROM pages
), h AS (
  SELECT *, list_transform(range(1, 41, 5), lambda i: ('0x' || sha1(body)[i:i+4])::INTEGER) AS five FROM d
)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((five[1 + i // 4] >> (15 - 5 * (i % 4)::INTEGER)) & 31)::INTEGER, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> head THEN head END AS refers_to
FROM h
"""
