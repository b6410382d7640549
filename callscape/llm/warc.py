"""Content-addressed archive of WARC records, in DataFrame operations.

An archive is a folder with two tables. ``payloads`` holds every distinct payload once, under its
SHA-256; ``headers`` holds, for every record, the exact bytes that come before its payload (the
WARC head and the HTTP head) and the digest of the payload. A record is rebuilt by joining both.

- Of the records with equal payloads the one with the largest page_id is a ``response``; among
  equal page_ids, one row chosen by its position. The others are ``revisit`` records, which carry
  heads only. A null page_id counts as the smallest.
- A null payload is an empty one; a null URL leaves WARC-Target-URI out. Only page_id, url and
  payload columns are read, so other columns cannot clash.
- Equal digests with unequal payloads stop the write, and a payload that does not match its
  digest stops the read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callscape.llm.common import stored
from callscape.scale import scratch_path

# Fixed values of the format.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE32_HEX = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NL = "\r\n"


def base32_sha1(data: Column) -> Column:
    """SHA-1 as bare upper-case base32: each 5 hexadecimal digits make 4 base32 digits."""
    digits = F.sha1(data)
    parts = [
        F.lpad(F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)
    ]
    return F.translate(F.concat(*parts), BASE32_HEX, BASE32)


def _record_id(row: Column) -> Column:
    """A name-based UUID of the record's key."""
    h = F.md5(F.concat(F.lit("record:"), row.cast("string")).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _heads(date: str) -> Column:
    """The bytes before the payload."""
    response = F.col("record_type") == "response"
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{NL}Content-Type: text/html; charset=utf-8{NL}Content-Length: "),
        F.col("size").cast("string"), F.lit(NL + NL))
    block = F.length(http) + F.when(response, F.col("size")).otherwise(0)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(NL))
    lines = [
        F.lit(VERSION + NL),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _record_id(F.col("row_key"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(response, F.lit("")).otherwise(F.concat(
            line("WARC-Refers-To", _record_id(F.col("first_key"))),
            line("WARC-Profile", F.lit(REVISIT_PROFILE)))),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", block.cast("string")),
        F.lit(NL), http,
    ]
    return F.concat(*lines).cast("binary")


def write_archive(pages: DataFrame, path: str, payload: str = "html",
                  date: str = "2024-01-01T00:00:00Z") -> None:
    """Write one record per row of ``pages`` to the archive at ``path``.

    Payloads move once, keyed by digest and combined inside each task first, so a page copied to
    a third of all rows crosses the network once per task. Heads are found from digests alone.
    """
    data = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", data.alias("data"))
    facts = stored(rows.select(
        "page_id", "url", F.unhex(F.sha2("data", 256)).alias("digest"),
        base32_sha1(F.col("data")).alias("sha1"), F.octet_length("data").alias("size"),
        F.monotonically_increasing_id().alias("row_key"),
    ), "records")
    firsts = facts.groupBy("digest").agg(F.max(F.struct(
        F.col("page_id").isNotNull().alias("known"), "page_id", "row_key")).alias("first"))
    headers = facts.join(firsts, "digest").select(
        "page_id", "url", "digest", "sha1", "size", "row_key",
        F.col("first.row_key").alias("first_key"), F.col("first.page_id").alias("first_page"),
        F.when(F.col("row_key") == F.col("first.row_key"), "response").otherwise("revisit")
        .alias("record_type"),
    )
    headers.select(
        "page_id", "row_key", "digest", _heads(date).alias("head"),
        F.when(F.col("record_type") == "revisit", F.col("first_page")).alias("refers_to"),
    ).write.parquet(f"{path}/headers")
    prints = F.struct(F.octet_length("data"), F.xxhash64("data"), F.sha1("data"))
    kinds = (
        rows.select(F.unhex(F.sha2("data", 256)).alias("digest"), "data", prints.alias("print"))
        .groupBy("digest")
        .agg(F.first("data").alias("data"), F.min("print").alias("low"),
             F.max("print").alias("high"))
    )
    clash = F.raise_error(F.lit("two payloads share a SHA-256 digest")).cast("binary")
    kinds.select("digest", F.when(F.col("low") == F.col("high"), F.col("data")).otherwise(clash)
                 .alias("data")).write.parquet(f"{path}/payloads")


def _verified(spark: SparkSession, path: str) -> DataFrame:
    broken = F.raise_error(F.lit("a stored payload does not match its digest")).cast("binary")
    good = F.unhex(F.sha2("data", 256)) == F.col("digest")
    return spark.read.parquet(f"{path}/payloads").select(
        "digest", F.when(good, F.col("data")).otherwise(broken).alias("data"))


def _field(name: str) -> Column:
    return F.regexp_extract(F.decode("head", "utf-8"), rf"\r\n{name}: ([^\r\n]*)", 1)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record from the written tables: the type and digest that its head states, and
    the size of the stored payload, whose SHA-1 must be the stated one.

    Payloads are reduced to their facts before the join, which moves only digests and heads.
    """
    facts = _verified(spark, path).select(
        "digest", F.octet_length("data").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("data")).alias("sha1"))
    heads = spark.read.parquet(f"{path}/headers").select(
        "page_id", "digest", "refers_to", _field("WARC-Type").alias("record_type"),
        _field("WARC-Payload-Digest").alias("stated"))
    wrong = F.raise_error(F.lit("a record states another digest than its payload has"))
    return heads.join(facts, "digest").select(
        "page_id", "payload_bytes",
        F.when(F.col("stated") == F.concat(F.lit("sha1:"), "sha1"), F.col("sha1"))
        .otherwise(wrong.cast("string")).alias("payload_digest"),
        "record_type", "refers_to",
    )


def rebuild_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, row_key and the exact bytes of every record, ready for a WARC file. Only
    responses meet a payload, each digest once, so no payload is copied to many rows."""
    heads = spark.read.parquet(f"{path}/headers").withColumn("record_type", _field("WARC-Type"))
    end = F.lit((NL + NL).encode())
    whole = heads.where("record_type = 'response'").join(_verified(spark, path), "digest").select(
        "page_id", "row_key", F.concat("head", "data", end).alias("record"))
    bare = heads.where("record_type = 'revisit'").select(
        "page_id", "row_key", F.concat("head", end).alias("record"))
    return whole.unionByName(bare)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to a fresh archive in the shared folder and read it back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archive(pages, path)
    return read_archive(pages.sparkSession, path)
