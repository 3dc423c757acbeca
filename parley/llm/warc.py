"""Operator 4, content-addressed WARC archive.

An archive is two tables: ``payloads`` holds every distinct payload once under its SHA-256, ``headers`` holds the exact header
bytes of every record with the digest of its payload. A record is rebuilt by joining the two; the digest of every payload
is verified when it is read. Of records with equal payloads of at least 100 bytes, the one with the smallest id is a
``response`` and the others are ``revisit`` records, which name it and have no block; smaller payloads are always responses.

Edge cases: a null payload counts as empty. Rows that repeat the smallest id of their payload are all responses. A row with
null id is never chosen while another row has the payload; its record is named ``null``. Line ends in a URL are
percent-encoded, a null URL is empty. Other columns are not archived. An empty table gives an empty archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_REVISIT_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
ID_PREFIX = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _classified(pages: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    """Per row: id, url, digest, payload_bytes, record_type and refers_to. Payloads themselves are not shuffled."""
    data = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), F.sha2(data, 256).alias("digest"),
                        F.octet_length(data).cast("long").alias("payload_bytes"))
    owners = rows.groupBy("digest").agg(F.min("id").alias("owner"))
    joined = rows.join(owners, "digest")
    revisits = (F.col("payload_bytes") >= MIN_REVISIT_BYTES) & ~F.col("id").eqNullSafe(F.col("owner"))
    return joined.select("id", "url", "digest", "payload_bytes",
                         F.when(revisits, "revisit").otherwise("response").alias("record_type"),
                         F.when(revisits, F.col("owner")).alias("refers_to"))


def _header() -> Column:
    """Exact header bytes of a record, with the blank line that ends them."""

    def urn(column: str) -> Column:
        return F.concat(F.lit(f"<{ID_PREFIX}"), F.coalesce(F.col(column).cast("string"), F.lit("null")), F.lit(">"))

    def field(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))

    uri = F.replace(F.replace(F.coalesce(F.col("url"), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    is_revisit = F.col("record_type") == "revisit"
    text = F.concat(
        F.lit("WARC/1.1" + CRLF),
        field("WARC-Type", F.col("record_type")),
        field("WARC-Record-ID", urn("id")),
        F.lit(f"WARC-Date: {DATE}{CRLF}"),
        field("WARC-Target-URI", uri),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(is_revisit, F.concat(field("WARC-Refers-To", urn("refers_to")), F.lit(f"WARC-Profile: {PROFILE}{CRLF}")))
        .otherwise(""),
        F.lit(f"Content-Type: text/html; charset=utf-8{CRLF}"),
        field("Content-Length", F.when(is_revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit(CRLF))
    return text.cast("binary")


def write_archive(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Write the two tables of an archive; the folder must be new."""
    data = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    payloads = (pages.select(F.sha2(data, 256).alias("digest"), data.alias("payload"))
                .groupBy("digest").agg(F.first("payload").alias("payload")))
    payloads.write.parquet(f"{folder}/payloads")
    _classified(pages, key, url, payload).select("digest", _header().alias("header")).write.parquet(f"{folder}/headers")


def header_field(header: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(header.cast("string"), rf"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of an archive as it stands in a WARC file: header, block, blank lines.

    A payload that does not have the digest it is stored under fails the read.
    """
    stored = spark.read.parquet(f"{folder}/payloads")
    verified = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("payload does not match its digest "), F.col("digest"))).cast("binary"))
    payloads = stored.select(F.col("digest").alias("block_digest"), verified.alias("block"))
    headers = spark.read.parquet(f"{folder}/headers")
    # a revisit has no block, so it takes part in the join without a key
    block_of = F.when(header_field(F.col("header"), "WARC-Type") == "response", F.col("digest"))
    joined = headers.withColumn("block_of", block_of).join(payloads, F.col("block_of") == F.col("block_digest"), "left")
    block = F.when(F.col("block_of").isNull(), F.lit(b"")).otherwise(F.coalesce(
        F.col("block"), F.raise_error(F.concat(F.lit("no payload "), F.col("digest"))).cast("binary")))
    return joined.select(F.concat("header", block, F.lit((CRLF * 2).encode())).alias("record"))


def parsed(found: DataFrame) -> DataFrame:
    """Fields of records: id, record_type, url, digest as stated, refers_to, and payload by the stated length."""
    header = F.concat(F.substring_index(F.col("record").cast("string"), CRLF * 2, 1), F.lit(CRLF))

    def number(name: str) -> Column:
        return F.regexp_extract(header_field(F.col("header"), name), rf"{ID_PREFIX}(-?[0-9]+)>", 1).try_cast("long")

    rows = found.select("record", header.alias("header"))
    length = header_field(F.col("header"), "Content-Length").cast("int")
    payload = F.substring(F.col("record"), F.octet_length("header") + 3, length)
    return rows.select(number("WARC-Record-ID").alias("id"),
                       header_field(F.col("header"), "WARC-Type").alias("record_type"),
                       F.coalesce(header_field(F.col("header"), "WARC-Target-URI"), F.lit("")).alias("url"),
                       F.regexp_extract("header", r"WARC-Payload-Digest: sha256:([0-9a-f]{64})", 1).alias("digest"),
                       number("WARC-Refers-To").alias("refers_to"), payload.alias("payload"))


def facts(found: DataFrame) -> DataFrame:
    """Parsed records with payload_digest and payload_bytes, counted from the payload, in place of it."""
    return found.select("id", "record_type", "refers_to", "digest", F.sha2("payload", 256).alias("payload_digest"),
                        F.octet_length("payload").cast("long").alias("payload_bytes"))


def resolved(found: DataFrame) -> DataFrame:
    """Per record of a table of ``facts``: id, payload_bytes and payload_digest of the full payload (a revisit's is that of
    the record it names), record_type and refers_to."""
    responses = found.filter("record_type = 'response'")
    revisits = found.filter("record_type = 'revisit'").drop("payload_digest", "payload_bytes")
    # only digests of revisit size can be named, and each of them has one payload
    targets = (responses.filter(F.col("payload_bytes") >= MIN_REVISIT_BYTES)
               .groupBy(F.col("payload_digest").alias("digest")).agg(F.max("payload_bytes").alias("payload_bytes")))
    named = revisits.join(targets, "digest").withColumn("payload_digest", F.col("digest"))
    columns = ["id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.select(columns).unionByName(named.select(columns))


def export_files(spark: SparkSession, folder: str, out: str, compression: str = "none") -> None:
    """Write the records of an archive as WARC files, one per partition of the records.

    The text writer ends every record with the two blank lines that WARC asks for; payloads must be UTF-8.
    """
    text = records(spark, folder).select(F.col("record").cast("string").alias("value"))
    body = text.select(F.expr("left(value, char_length(value) - 4)").alias("value"))
    body.write.option("lineSep", CRLF * 2).option("compression", compression).text(out)


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT page_id, octet_length(encode(h)) AS n, sha256(h) AS d, min(page_id) OVER (PARTITION BY h) AS owner FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= {MIN_REVISIT_BYTES} AND page_id IS DISTINCT FROM owner THEN 'revisit' ELSE 'response' END
           AS record_type,
       CASE WHEN n >= {MIN_REVISIT_BYTES} AND page_id IS DISTINCT FROM owner THEN owner END AS refers_to
FROM f
"""
