"""Content-addressed WARC archive: payloads once by digest, record headers apart."""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DATE = datetime(2020, 1, 1, tzinfo=timezone.utc)  # the pages have no fetch time
# Fixed value: the profile of the WARC 1.1 standard for revisits of an equal payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _digests(pages: DataFrame) -> DataFrame:
    """(page_id, url, strong, sha1, bytes): digests of each row's payload, taken where it is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [(x or "").encode("utf-8") for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1),
                pa.array([hashlib.sha256(b).digest() for b in bodies], pa.binary()),
                pa.array([base64.b32encode(hashlib.sha1(b).digest()).decode() for b in bodies]),
                pa.array([len(b) for b in bodies], pa.int64()),
            ], ["page_id", "url", "strong", "sha1", "bytes"])

    return pages.mapInArrow(run, "page_id long, url string, strong binary, sha1 string, bytes long")


def record_id(page_id: int | None, url: str | None, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {copy} {url}')}>"


def _line(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.splitlines()) if value.splitlines() != [value] else value


def header(row: dict) -> bytes:
    """The exact header block of a record."""
    lines = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: {record_id(row['page_id'], row['url'], row['copy'])}",
        f"WARC-Date: {DATE:%Y-%m-%dT%H:%M:%SZ}",
    ]
    if row["url"] is not None:
        lines.append(f"WARC-Target-URI: {_line(row['url'])}")
    lines += [f"WARC-Payload-Digest: sha1:{row['sha1']}", f"X-Payload-Length: {row['bytes']}"]
    if row["page_id"] is not None:
        lines.append(f"X-Page-ID: {row['page_id']}")
    if row["record_type"] == "revisit":
        lines.append(f"WARC-Profile: {PROFILE}")
        if row["refers_to"] is not None:
            lines.append(f"X-Refers-To-Page: {row['refers_to']}")
        lines.append(f"WARC-Refers-To: {record_id(row['refers_to'], row['first_url'], 0)}")
    lines += ["Content-Type: text/html; charset=utf-8",
              f"Content-Length: {row['bytes'] if row['record_type'] == 'response' else 0}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def parse_header(block: bytes) -> dict[str, str]:
    first, *rest = block.decode().rstrip("\r\n").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    return dict(line.split(": ", 1) for line in rest)


def write_archive(pages: DataFrame, path: str, least: int = 0, id_col: str = "page_id",
                  url_col: str = "url", html_col: str = "html") -> None:
    """Write one WARC record per row of ``pages`` as two tables under ``path``.

    ``payloads`` (strong, body): every different payload once, under its SHA-256. ``headers`` (strong,
    header, response): the exact header block of each record. Of the records whose payloads are equal
    and have ``least`` bytes or more, the one with the smallest page_id (nulls last, then by url) is
    the response and all others are revisits of it; records with smaller payloads are all responses.
    Null html is an empty payload. Rows that repeat page_id, url and payload are records of their own.

    Only ids and digests are shuffled to find the first of each payload. Then the payloads of the
    firsts, and no others, are written.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).alias("html"))
    spark = pages.sparkSession
    _digests(rows).write.parquet(f"{path}/digests")
    digests = spark.read.parquet(f"{path}/digests")
    once = digests.groupBy("page_id", "url", "strong", "sha1", "bytes").agg(F.count("*").alias("times"))
    place = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "url")
    firsts = digests.groupBy("strong").agg(F.min(place).alias("first"))
    records = (
        once.join(firsts, "strong")
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
        .withColumn("is_first", (place == F.col("first")) & (F.col("copy") == 0))
        .select("page_id", "url", "strong", "sha1", "bytes", "copy", "is_first",
                F.when(F.col("is_first") | (F.col("bytes") < least), "response").otherwise("revisit").alias("record_type"),
                F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("first_url"))
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = [header(row) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("strong"), pa.array(blocks, pa.binary()),
                 pa.array([b == "response" for b in batch.column("record_type").to_pylist()])],
                ["strong", "header", "response"])

    records.mapInArrow(build, "strong binary, header binary, response boolean").write.parquet(f"{path}/headers")
    # The payload of each first row, found again by page_id and url; the digest is verified on reading.
    wanted = firsts.select("strong", "first.page_id", "first.url")
    same = rows["page_id"].eqNullSafe(wanted["page_id"]) & rows["url"].eqNullSafe(wanted["url"])
    bodies = rows.join(wanted, same).select(
        "strong", F.coalesce("html", F.lit("")).cast("binary").alias("body")
    ).where(F.unhex(F.sha2("body", 256)) == F.col("strong"))
    if not once.where("times > 1").isEmpty():
        bodies = bodies.dropDuplicates(["strong"])
    bodies.write.parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(header, body): the original records of an archive: each header with its whole payload.

    The payload of a revisit is that of its response. A stored payload whose bytes don't have the
    digest they are stored under, or that is missing, raises an error.
    """
    return spark.read.parquet(f"{path}/headers").join(
        _verified(spark, path), "strong", "left").select(
        "header", F.coalesce("body", F.raise_error(F.lit("a payload is missing"))).alias("body"))


def _verified(spark: SparkSession, path: str) -> DataFrame:
    broken = F.raise_error(F.concat(F.lit("a payload was changed: "), F.hex("strong")))
    return spark.read.parquet(f"{path}/payloads").withColumn("body", F.when(
        F.unhex(F.sha2("body", 256)) == F.col("strong"), F.col("body")).otherwise(broken))


def warc_records(spark: SparkSession, path: str) -> DataFrame:
    """(record): the bytes of each record as they stand in a WARC file: header, block, two line ends.

    The block of a revisit is empty, as its profile says.
    """
    bodies = spark.read.parquet(f"{path}/headers").where("response").join(_verified(spark, path), "strong")
    revisits = spark.read.parquet(f"{path}/headers").where("NOT response")
    end = F.lit("\r\n\r\n").cast("binary")
    return bodies.select(F.concat("header", "body", end).alias("record")).union(
        revisits.select(F.concat("header", end)))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), read back from an archive.

    Lengths and digests are taken anew from the stored payloads, once each; headers are parsed and
    joined with them by strong digest, and a header that doesn't agree raises an error.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strong, bodies = batch.column("strong").to_pylist(), batch.column("body").to_pylist()
            for s, b in zip(strong, bodies):
                if hashlib.sha256(b).digest() != s:
                    raise ValueError(f"a payload was changed: {s.hex()}")
            yield pa.RecordBatch.from_arrays([
                batch.column("strong"), pa.array([len(b) for b in bodies], pa.int64()),
                pa.array([base64.b32encode(hashlib.sha1(b).digest()).decode() for b in bodies])],
                ["strong", "bytes", "sha1"])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = lambda x: None if x is None else int(x)
        for batch in batches:
            out = []
            for block, size, sha1 in zip(*(batch.column(c).to_pylist() for c in ("header", "bytes", "sha1"))):
                h = parse_header(block)
                if h["WARC-Payload-Digest"] != f"sha1:{sha1}" or int(h["X-Payload-Length"]) != size:
                    raise ValueError(f"{h['WARC-Record-ID']} has another payload")
                out.append((whole(h.get("X-Page-ID")), size, sha1, h["WARC-Type"], whole(h.get("X-Refers-To-Page"))))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)],
                ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    measured = spark.read.parquet(f"{path}/payloads").mapInArrow(measure, "strong binary, bytes long, sha1 string")
    headers = spark.read.parquet(f"{path}/headers").select("strong", "header")
    return headers.join(measured, "strong", "left").mapInArrow(
        parse, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
