"""Content-addressed WARC archive.

``write_archive`` keeps two tables: payloads, each distinct payload's bytes once under its SHA-256, and headers, the
exact header bytes of every record with the digest of its payload. ``read_archive`` verifies each stored payload
against its digest and rebuilds the records by a join on it. ``parse_records`` reads the fields back out of the records' bytes.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intentdeck.llm._common import discard, hot_keys, join_spread, materialize, read_table, shared_dir

#: Payloads of at least so many bytes are written once, later records with the same bytes revisit them.
REVISIT_BYTES = 1000
#: The date of every record: an archive of the same rows has the same bytes.
DATE = "2024-01-01T00:00:00Z"


@dataclass(frozen=True)
class Archive:
    headers: str
    payloads: str


def write_archive(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_bytes: int = REVISIT_BYTES) -> Archive:
    """Write one record per row. payload_col is a string (UTF-8) or binary column; null is the empty payload.

    Among rows of equal payload of revisit_bytes or more those with the largest id are responses and the others
    revisit it (rows that repeat this id too are responses; null ids are smaller than any). A null url is left out of the header; CR and LF in
    a url are written as %0D and %0A. Other columns are not archived.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    body = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("payload"))
    keyed = rows.withColumn("sha256", F.unhex(F.sha2("payload", 256)))
    keyed.select("sha256", "payload").dropDuplicates(["sha256"]).write.option("compression", "zstd").parquet(f"{path}/payloads")
    small = keyed.select("id", "url", "sha256", F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("n"))
    # only payloads that occur twice have anything to refer to
    again = small.where(F.col("n") >= revisit_bytes).groupBy("sha256").agg(F.max("id").alias("top"), F.count("*").alias("records")).where("records > 1")
    again = materialize(again, "warc-again")
    small = join_spread(small, again.select("sha256", "top"), hot_keys(again, ["sha256"], pages.count()), ["id", "url"], "left")
    revisits = F.col("top").isNotNull() & ~F.col("id").eqNullSafe(F.col("top"))
    safe = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisits, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("none")), F.lit(">"))),
        F.coalesce(line("WARC-Target-URI", safe), F.lit("")),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        F.when(revisits, line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("top").cast("string"), F.lit(">")))).otherwise(F.lit("")),
        F.when(revisits, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisits, "0").otherwise(F.col("n").cast("string"))),
        F.lit("\r\n"),
    ).cast("binary")
    small.select("id", "sha256", head.alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")
    discard(again)
    return Archive(f"{path}/headers", f"{path}/payloads")


def read_archive(spark: SparkSession, archive: Archive) -> DataFrame:
    """(id, header, payload, record): each record's exact bytes, and the full payload also of revisits.

    A stored payload that does not match its digest raises.
    """
    stored = spark.read.parquet(archive.payloads)
    good = F.unhex(F.sha2("payload", 256)) == F.col("sha256")
    stored = stored.select("sha256", F.when(good, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload does not match its digest "), F.hex("sha256")))).alias("payload"))
    headers = spark.read.parquet(archive.headers)
    hot = hot_keys(headers.groupBy("sha256").agg(F.count("*").alias("records")), ["sha256"], headers.count())
    both = join_spread(headers, stored, hot, ["id", "header"], "inner")
    held = F.when(F.decode("header", "UTF-8").contains("\r\nWARC-Type: revisit\r\n"), F.lit(b"")).otherwise(F.col("payload"))
    return both.select("id", "header", "payload", F.concat("header", held, F.lit(b"\r\n\r\n")).alias("record"))


def parse_records(records: DataFrame) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) from rebuilt records.

    The payload of a response is cut from the record by Content-Length; both it and that of a revisit must have the digest
    that the header declares, else it raises.
    """
    head = F.decode(F.substring(F.col("record"), F.lit(1), F.octet_length("header")), "UTF-8")
    field = lambda name: F.regexp_extract("head", rf"\r\n{name}: ([^\r]*)\r\n", 1)
    df = records.select("id", "payload", "record", F.octet_length("header").alias("cut"), head.alias("head"))
    df = df.select("id", "payload", "record", "cut", field("WARC-Type").alias("record_type"), field("Content-Length").cast("int").alias("n"), F.substring(field("WARC-Payload-Digest"), 6, 40).alias("declared"), F.regexp_extract(field("WARC-Refers-To"), r"^<urn:page:(.*)>$", 1).alias("to"))
    body = F.when(F.col("record_type") == "revisit", F.col("payload")).otherwise(F.substring(F.col("record"), F.col("cut") + 1, F.col("n")))
    df = df.select("id", "record_type", "declared", "to", F.octet_length(body).cast("long").alias("payload_bytes"), F.sha1(body).alias("sha1"))
    digest = F.when(F.col("sha1") == F.col("declared"), F.col("sha1")).otherwise(F.raise_error(F.concat(F.lit("record does not match its digest "), "declared")))
    return df.select("id", "payload_bytes", digest.alias("payload_digest"), "record_type", F.when(F.col("to") != "", F.col("to")).alias("refers_to"))


def op5_warc(spark, sf_dir) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = parse_records(read_archive(spark, write_archive(pages)))
    return out.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(encode(html), ''::BLOB) AS body FROM pages),
d AS (SELECT page_id, octet_length(body)::BIGINT AS n, sha1(body) AS digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY digest, n) AS top FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM m
"""
