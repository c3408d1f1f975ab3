"""Content-addressed WARC archive.

Payload bytes are stored once under their SHA-256 (table ``blobs``); the exact header of
every record is kept apart (table ``records``) with the address of its payload. Reading
recomputes each stored payload's digest, fails on one that does not match its address,
and rebuilds the records by a join on the address.

Of records with equal payloads of at least ``min_revisit_bytes`` bytes, those with the
smallest id are responses and the others revisit them; shorter payloads are always
responses.

Cases: a null payload is empty; a null url becomes ``urn:x-none``; line breaks in a url
are percent-encoded, so they cannot forge header fields; rows that share the smallest id
are all responses; a null id is never the smallest unless every id is null; an empty
table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medoidlab.llm.common import table
from medoidlab.session import scratch_path

DATE = "2024-01-01T00:00:00Z"
# Fixed values of the format: the revisit profile and the base32 alphabet.
PROFILE = "http://netpreservefoundation.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1: each ten hex digits are eight base32 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), DIGITS32, BASE32)


def _record_uri(page: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def write_archive(pages: DataFrame, path: str, min_revisit_bytes: int = 0, date: str = DATE) -> None:
    """Archive rows (page_id, url, html). Payloads travel once (one partial aggregation
    by address, so copies of a hot payload merge before the shuffle); everything else is
    narrow."""
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url"), F.lit("urn:x-none")).alias("url"),
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"),
    )
    address = F.unhex(F.sha2("payload", 256))
    base.withColumn("address", address).dropDuplicates(["address"]).select("address", "payload").write.parquet(
        f"{path}/blobs"
    )
    narrow = base.select(
        "page_id",
        "url",
        address.alias("address"),
        F.octet_length("payload").cast("long").alias("bytes"),
        base32_sha1(F.col("payload")).alias("sha1"),
    )
    first = narrow.groupBy("address").agg(F.min("page_id").alias("first_id"))
    linked = narrow.join(first, "address").withColumn(
        "revisit", (F.col("bytes") >= min_revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    )
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("bytes").cast("string"),
        F.lit("\r\n\r\n"),
    )
    body = F.length(F.col("http")) + F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("bytes"))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "),
        _record_uri(F.col("page_id")),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        url,
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("sha1"),
        F.when(
            F.col("revisit"),
            F.concat(
                F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "),
                _record_uri(F.col("first_id")),
            ),
        ).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        body.cast("string"),
        F.lit("\r\n\r\n"),
    )
    linked.withColumn("http", http).select("address", header.alias("header"), "http").write.parquet(f"{path}/records")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records of an archive: page_id, url, record_type, refers_to, payload (full, also of
    revisits), payload_bytes, payload_digest, and ``record``, the record's exact bytes.

    The digests and lengths are recomputed from the stored payload, whatever the headers
    say; a payload that does not match its address stops the job.
    """
    blobs = spark.read.schema("address binary, payload binary").parquet(f"{path}/blobs")
    records = spark.read.schema("address binary, header string, http string").parquet(f"{path}/records")
    intact = F.unhex(F.sha2("payload", 256)) == F.col("address")
    blobs = blobs.select(
        F.when(intact, F.col("address")).otherwise(F.raise_error(F.lit("a stored payload does not match its address")).cast("binary")).alias("address"),
        "payload",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
    )

    def field(name: str) -> Column:
        return F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)", 1)

    def page(name: str) -> Column:
        return F.expr(f"try_cast(regexp_extract(header, '\\r\\n{name}: <urn:x-page:(-?[0-9]+)>', 1) as bigint)")

    kind = field("WARC-Type")
    tail = F.when(kind == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload"))
    return records.join(blobs, "address").select(
        page("WARC-Record-ID").alias("page_id"),
        field("WARC-Target-URI").alias("url"),
        kind.alias("record_type"),
        page("WARC-Refers-To").alias("refers_to"),
        "payload",
        "payload_bytes",
        "payload_digest",
        F.concat(F.col("header").cast("binary"), F.col("http").cast("binary"), tail, F.lit("\r\n\r\n").cast("binary")).alias(
            "record"
        ),
    )


def op8_warc_archive(spark, sf_dir):
    path = scratch_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_DIGIT = (
    "substr('" + BASE32 + "', 1 + cast((('0x' || substr(sha1(payload), 1 + 10 * (i // 8), 10))::bigint "
    ">> (35 - 5 * (i % 8))) & 31 as integer), 1)"
)
OP8_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, cast(octet_length(payload) AS bigint) AS payload_bytes,
             list_aggregate(list_transform(range(32), lambda i: {_DIGIT}), 'string_agg', '') AS payload_digest,
             min(page_id) OVER (PARTITION BY payload) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM d
"""
