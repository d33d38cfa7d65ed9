"""A content-addressed WARC archive: each payload stored once, record headers apart."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.shared import new_path

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of data: forty bits at a time, no padding."""
    digest = F.sha1(data)
    letters = []
    for k in range(4):
        bits = F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 10).cast("long")
        letters += [F.substr(F.lit(BASE32), F.shiftright(bits, 35 - 5 * i).bitwiseAND(31).cast("int") + 1, F.lit(1)) for i in range(8)]
    return F.concat(*letters)


def _uri(page: Column, digest: Column, copy: Column) -> Column:
    """A record's identifier: a name made from its page, its payload and its number among rows that are alike in both."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(":"), digest, F.lit(":"), copy.cast("string"), F.lit(">"))


def write_archive(pages: DataFrame, least: int = 0, date: str | None = None) -> str:
    """Write the archive of pages(page_id, url, html) and return its folder.

    payloads/ has each distinct payload once under its SHA-256; headers/ has the exact header block
    and HTTP head of each record and the address of its payload. Among records with equal payloads
    of at least least bytes, that with the largest page_id is the response and the others revisit
    it; below least all are responses. A null html is an empty payload. A null page_id sorts below
    all others; rows that repeat a page_id with the same payload are each a response if it is the
    largest. Each record has an identifier of its own, and the date of the writing, or that given
    (UTC, as 2024-01-31T00:00:00Z).
    """
    spark = pages.sparkSession
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    folder = new_path(spark, "warc")
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"address": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    first = rows.groupBy("address").agg(F.max("page_id").alias("holder"))
    first.write.option("compression", "zstd").parquet(f"{folder}/holders")
    first = spark.read.schema(first.schema).parquet(f"{folder}/holders")
    narrow = rows.select("page_id", "url", "address", "size", base32_sha1(F.col("payload")).alias("digest"))
    known = narrow.join(first, "address")
    revisit = (F.col("size") >= least) & F.col("holder").isNotNull() & ~F.col("holder").eqNullSafe(F.col("page_id"))
    known = known.withColumn("revisit", revisit)
    # rows that repeat page and payload are numbered; where no page repeats nothing is sorted
    alike = rows.groupBy("page_id").count().where("count > 1").isEmpty()
    copy = F.lit(0) if alike else F.row_number().over(Window.partitionBy("page_id", "address").orderBy("url")) - 1
    known = known.withColumn("copy", copy)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    kind = F.when(F.col("revisit"), "revisit").otherwise("response")
    length = F.octet_length(http) + F.when(F.col("revisit"), 0).otherwise(F.col("size"))
    extra = F.when(
        F.col("revisit"),
        F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", _uri(F.col("holder"), F.col("digest"), F.lit(0)))),
    ).otherwise("")
    header = F.concat(
        F.lit(f"{VERSION}\r\n"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", _uri(F.col("page_id"), F.col("digest"), F.col("copy"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n]", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        extra,
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
    )
    heads = known.select("page_id", header.alias("header"), http.alias("http"), "address", "revisit")
    heads.write.option("compression", "zstd").parquet(f"{folder}/headers")
    # the row of the largest page_id holds the payload; only where rows repeat it need payloads be compared
    held = F.col("holder").eqNullSafe(F.col("page_id"))
    once = rows.join(first, "address").where(held).select("address", "payload")
    heads = spark.read.schema(heads.schema).parquet(f"{folder}/headers")
    repeated = heads.where("NOT revisit").groupBy("address").count().where("count > 1")
    once = once if repeated.isEmpty() else once.dropDuplicates(["address"])
    once.write.option("compression", "zstd").parquet(f"{folder}/payloads")
    return folder


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """The records as they were: header, http (head), payload (whole, for revisits too), block (as stored in a WARC file), size and sha1 of the payload.

    A payload that doesn't match its address, or the SHA-1 in a header, stops the read. size and sha1
    are taken where the payload is read: who wants no more than these moves no payloads.
    """
    heads = spark.read.schema("page_id long, header string, http string, address string, revisit boolean").parquet(f"{folder}/headers")
    held = spark.read.schema("address string, payload binary").parquet(f"{folder}/payloads")
    fault = F.raise_error(F.concat(F.lit("a payload doesn't match its address "), F.col("address"))).cast("binary")
    held = held.select("address", F.when(F.sha2("payload", 256) == F.col("address"), F.col("payload")).otherwise(fault).alias("payload"))
    held = held.select("address", "payload", F.octet_length("payload").cast("long").alias("size"), base32_sha1(F.col("payload")).alias("sha1"))
    block = F.concat(F.col("http").cast("binary"), F.when(F.col("revisit"), F.lit(b"")).otherwise(F.col("payload")))
    said = F.regexp_extract("header", "(?m)^WARC-Payload-Digest: sha1:(\\w+)", 1)
    fault = F.raise_error(F.concat(F.lit("a payload doesn't match its header: "), said)).cast("binary")
    same = F.col("sha1") == said
    both = heads.join(held, "address").withColumns({"payload": F.when(same, F.col("payload")).otherwise(fault), "sha1": F.when(same, F.col("sha1")).otherwise(fault.cast("string"))})
    return both.select("header", "http", "payload", block.alias("block"), F.when(F.col("sha1").isNotNull(), F.col("size")).alias("size"), "sha1")


def record_bytes(records: DataFrame) -> DataFrame:
    """Add record: the bytes of each WARC record, ready to be laid end to end in a .warc file."""
    return records.withColumn("record", F.concat(F.col("header").cast("binary"), "block", F.lit(b"\r\n\r\n")))


def fields(records: DataFrame) -> DataFrame:
    """What the headers say: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    field = lambda pattern: F.nullif(F.regexp_extract("header", pattern, 1), F.lit(""))
    return records.select(
        F.nullif(field("(?m)^WARC-Record-ID: <urn:page:([^:>]*):"), F.lit("null")).cast("long").alias("page_id"),
        F.col("size").alias("payload_bytes"),
        F.col("sha1").alias("payload_digest"),
        field("(?m)^WARC-Type: (\\w+)").alias("record_type"),
        field("(?m)^WARC-Refers-To: <urn:page:([^:>]*):").cast("long").alias("refers_to"),
    )


def op8_content_addressed_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return fields(read_archive(spark, folder))
