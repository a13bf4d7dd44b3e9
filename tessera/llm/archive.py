"""Content-addressed WARC archive.

Payload bytes are stored once under their SHA-256 digest; the exact header
block of every record is stored apart, and records come back by joining the two
on the digest. Digests are computed again from the bytes read, and a record
whose payload does not verify raises.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_keys, join_many, stage, tidy, utf8

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # RFC 4648
CRLF = "\r\n"


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of a SHA-1 hex digest (160 bits, 32 digits, no padding)."""
    padded = F.concat(digest, F.lit("0"))
    digits = []
    for j in range(32):
        two = F.conv(F.substring(padded, 5 * j // 4 + 1, 2), 16, 10).cast("int")
        value = F.shiftright(two, 3 - 5 * j % 4).bitwiseAND(F.lit(31))
        digits.append(F.substring(F.lit(BASE32), 1, 32).substr(value + 1, F.lit(1)))
    return F.concat(*digits)


def describe(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Slim record table: page_id, url, digests, record type and what it refers to.

    Null html is an empty payload, as long as any; payloads of every length are
    digested whole. Of rows that repeat page_id and payload each is a response or
    refers to the smaller page_id. Other columns are ignored; an empty table gives
    an empty result.
    """
    body = utf8(pages["html"])
    slim = pages.select(pages["page_id"].alias("page_id"), pages["url"].alias("url"), F.octet_length(body).cast("long").alias("payload_bytes"), F.sha2(body, 256).alias("sha256"), F.sha1(body).alias("sha1"))
    first = stage(slim.where(F.col("payload_bytes") >= min_bytes).groupBy("sha256").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")))
    # Very many pages may have one payload, the empty one for a start.
    slim = join_many(slim, first.drop("n"), hot_keys(first.select("sha256", "n"), "sha256"), "sha256")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return slim.select("page_id", "url", "payload_bytes", "sha256", base32_of_hex(F.col("sha1")).alias("payload_digest"), F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first_id")).alias("refers_to"))


def header_block(r: DataFrame) -> Column:
    """The record's header lines, CRLF-ended, with the empty line that closes them."""
    number = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    clean = F.replace(F.replace(F.coalesce(r["url"], F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = r["record_type"] == "revisit"
    lines = [
        F.concat(F.lit("WARC/1.1"), F.lit(CRLF), F.lit("WARC-Type: "), r["record_type"]),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), number(r["page_id"]), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), clean),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), r["payload_digest"]),
        F.concat(F.lit("WARC-Block-Digest: sha256:"), r["sha256"]),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), F.lit(CRLF), F.lit("WARC-Refers-To: <urn:page:"), number(r["refers_to"]), F.lit(">"))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(r["payload_bytes"].cast("string"))),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF))


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write ``path``/headers (one row per page) and ``path``/payloads (one per digest).

    Null html is an empty payload. Pages with equal page_id and html keep one
    record each. A null page_id gets a record without a number in its name. The
    headers' table keeps the url as it was given; in the header line itself line
    ends are percent-encoded. Other columns are ignored.
    """
    records = describe(pages, min_bytes)
    records.select("page_id", "url", "sha256", header_block(records).alias("header")).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/headers")
    stored = utf8(pages["html"])
    pages.select(F.sha2(stored, 256).alias("sha256"), stored.alias("payload")).dropDuplicates(["sha256"]).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/payloads")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Payload digests from the stored bytes themselves."""
    import base64
    import hashlib

    for batch in batches:
        sha256, size, sha1 = [], [], []
        for name, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if hashlib.sha256(payload).hexdigest() != name:
                raise ValueError(f"payload {name} does not match its digest")
            sha256.append(name)
            size.append(len(payload))
            sha1.append(base64.b32encode(hashlib.sha1(payload).digest()).decode())
        yield pa.RecordBatch.from_arrays([pa.array(sha256, pa.string()), pa.array(size, pa.int64()), pa.array(sha1, pa.string())], names=["sha256", "payload_bytes", "payload_digest"])


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """Header blocks parsed back into columns."""
    h = spark.read.parquet(f"{path}/headers")
    field = lambda name: F.regexp_extract("header", f"(?:^|\r\n){name}: ([^\r]*)\r\n", 1)
    kind = dict(h.dtypes)["page_id"]
    return h.select(
        "page_id", "url", "sha256", "header",
        field("WARC-Type").alias("record_type"), field("WARC-Target-URI").alias("target_uri"),
        F.regexp_extract(field("WARC-Payload-Digest"), "^sha1:(.*)$", 1).alias("header_digest"),
        F.nullif(F.nullif(F.regexp_extract(field("WARC-Refers-To"), "^<urn:page:(.*)>$", 1), F.lit("")), F.lit("none")).cast(kind).alias("refers_to"),
        field("Content-Length").cast("long").alias("content_length"),
    )


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Sizes and digests are those of the stored payload bytes, verified. An empty
    archive gives an empty result.
    """
    checked = spark.read.parquet(f"{path}/payloads").select("sha256", "payload").mapInArrow(tidy(_verify), "sha256 string, payload_bytes long, payload_digest string")
    headers = read_headers(spark, path)
    joined = join_many(headers, checked, hot_keys(headers.groupBy("sha256").agg(F.count(F.lit(1)).alias("n")), "sha256"), "sha256")
    broken = F.col("payload_digest").isNull() | (F.col("payload_digest") != F.col("header_digest"))
    good = F.when(broken, F.raise_error(F.concat(F.lit("no verified payload for "), F.col("sha256")))).otherwise(F.col("payload_digest"))
    return joined.select("page_id", "payload_bytes", good.alias("payload_digest"), "record_type", "refers_to", "url", "sha256", "header")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Original records: page_id, record (header block, content, two line ends), payload."""
    h = read_headers(spark, path)
    p = spark.read.parquet(f"{path}/payloads")
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return h.join(p, "sha256").select("page_id", F.concat(F.col("header").cast("binary"), body, F.lit(b"\r\n\r\n")).alias("record"), "payload", "record_type", "refers_to")


def export_warc(spark: SparkSession, path: str, to: str) -> None:
    """Plain WARC files: the text writer adds the last line feed of each record.

    Records of every length are written whole; an empty archive gives files
    without records. Payloads must be UTF-8, as those of ``write_archive`` are.
    """
    r = read_records(spark, path)
    text = F.decode(r["record"], "UTF-8")
    r.select(text.substr(F.lit(1), F.length(text) - 1).alias("value")).write.mode("overwrite").text(to)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a WARC file's bytes, by their Content-Length."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        lines = data[at:end].decode().split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:] if x)
        size = int(fields["Content-Length"])
        yield fields, data[end : end + size]
        if data[end + size : end + size + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is not closed")
        at = end + size + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of exported WARC files: record_id, record_type, payload."""

    def scan(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                found = list(parse_warc(content))
                yield pa.RecordBatch.from_arrays([pa.array([f["WARC-Record-ID"] for f, _ in found], pa.string()), pa.array([f["WARC-Type"] for f, _ in found], pa.string()), pa.array([p for _, p in found], pa.binary())], names=["record_id", "record_type", "payload"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(scan, "record_id string, record_type string, payload binary")
