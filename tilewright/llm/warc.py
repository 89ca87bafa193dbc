"""A content-addressed WARC archive as two tables in a shared folder.

`records` keeps one row per record with its exact header block; `payloads` keeps each distinct payload once under its
SHA-256.  Equal digests are verified: two payloads under one SHA-256 must agree in length and in SHA-1, or writing fails.
read() joins the two and gives back every record's bytes; parse() reads those bytes as a WARC reader would.  Payloads are
compressed one by one before they are shuffled or stored, as WARC files keep one compressed member a record.

Of records with equal payloads of at least `least` bytes the one with the largest key is the response and the others are
revisits that name it; smaller payloads are all responses.  Defined cases: a null payload is empty; a null url leaves out the
target header; line ends inside a url are percent-encoded; rows that repeat the largest key are all responses; a null key is
never the largest unless all keys of its payload are null; an empty table writes an empty archive.
"""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path

LEVEL = 6

CRLF = "\r\n"
DATE = "2020-01-01T00:00:00Z"
B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CONV32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def sha1_base32(data: Column) -> Column:
    """Bare upper-case base32 of SHA-1: five hex digits are 20 bits, which are four base32 digits."""
    h = F.sha1(data)
    return F.concat(*[F.translate(F.lpad(F.conv(F.substring(h, 1 + 5 * i, 5), 16, 32), 4, "0"), CONV32, B32) for i in range(8)])


def _header(kind: Column) -> Column:
    one = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise("")
    urn = lambda k: F.concat(F.lit("<urn:page:"), k.cast("string"), F.lit(">"))
    target = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = kind == "revisit"
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        one("WARC-Type", kind),
        one("WARC-Record-ID", F.coalesce(urn(F.col("key")), F.lit("<urn:page:none>"))),
        one("WARC-Date", F.lit(DATE)),
        one("WARC-Target-URI", target),
        one("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        one("WARC-Refers-To", F.when(revisit, urn(F.col("largest")))),
        one("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        one("Content-Type", F.lit("text/html")),
        one("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n").cast("string"))),
        F.lit(CRLF),
    )


def _each(df: DataFrame, column: str, work) -> DataFrame:
    """df with work() applied to every value of a binary column, batch by batch."""

    def run(batches):
        own = work()
        for b in batches:
            i = b.schema.get_field_index(column)
            yield b.set_column(i, column, pa.array([own(v.as_py()) for v in b.column(i)], pa.binary()))

    return df.mapInArrow(run, df.schema)


def _compressed(df: DataFrame) -> DataFrame:
    return _each(df, "payload", lambda: zstandard.ZstdCompressor(level=LEVEL).compress)


def _opened(df: DataFrame) -> DataFrame:
    return _each(df, "payload", lambda: zstandard.ZstdDecompressor().decompress)


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> None:
    """Write the archive.  Only digests are grouped; payloads are shuffled once, and one row a digest is kept."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    given = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), payload.alias("payload"))
    digested = given.withColumns({"sha256": F.sha2("payload", 256), "sha1": sha1_base32(F.col("payload")), "n": F.octet_length("payload").cast("long")})
    digests = digested.drop("payload", "url").groupBy("sha256", "key").agg(F.count("*").alias("times"), F.min("sha1").alias("sha1"), F.max("sha1").alias("other"), F.min("n").alias("n"), F.max("n").alias("most"))
    groups = digests.groupBy("sha256").agg(F.max("key").alias("largest"), F.max_by("times", "key").alias("times"), F.min("sha1").alias("sha1"), F.max("other").alias("other"), F.min("n").alias("n"), F.max("most").alias("most"))
    same = (F.col("sha1") == F.col("other")) & (F.col("n") == F.col("most"))
    groups = groups.withColumn("sha1", F.when(same, F.col("sha1")).otherwise(F.raise_error(F.lit("two payloads share a SHA-256"))))
    rows = digested.drop("payload", "sha1", "n").join(groups.select("sha256", "largest", "sha1", "n"), "sha256")
    kind = F.when((F.col("n") >= least) & F.col("largest").isNotNull() & ~F.col("key").eqNullSafe(F.col("largest")), F.lit("revisit")).otherwise(F.lit("response"))
    rows.select("sha256", kind.alias("kind"), _header(kind).cast("binary").alias("header")).write.option("compression", "zstd").parquet(f"{path}/records")
    # The payload of a digest comes from its response, so copies never travel.
    first = _compressed(digested.select("key", "sha256", "payload")).join(groups.select("sha256", "largest", F.coalesce("times", F.lit(2)).alias("times")), "sha256")
    first = first.where(F.col("key").eqNullSafe(F.col("largest"))).select("sha256", "payload", "times")
    # Only rows that repeat a key and a payload need a second shuffle to be one.
    once = first.where("times = 1").drop("times").unionByName(first.where("times > 1").drop("times").dropDuplicates(["sha256"]))
    once.write.parquet(f"{path}/payloads")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(record, payload): the bytes of every record, and the full payload that a revisit stands for."""
    records, payloads = spark.read.parquet(f"{path}/records"), spark.read.parquet(f"{path}/payloads")
    both = _opened(records.join(payloads, "sha256").select("kind", "header", "payload"))
    end = F.lit(CRLF * 2).cast("binary")
    return both.select(F.when(F.col("kind") == "revisit", F.concat("header", end)).otherwise(F.concat("header", "payload", end)).alias("record"), "payload")


def parse(archive: DataFrame, key: str = "page_id", key_type: str = "long") -> DataFrame:
    """What the records' own headers say, checked against the payload; a record that disagrees raises an error."""
    head = F.split_part(F.decode("record", "ISO-8859-1"), F.lit(CRLF * 2), F.lit(1))
    field = lambda name: F.regexp_extract("head", f"\\r\\n{name}: ([^\\r\\n]*)", 1)
    urn = lambda text: F.when(text.rlike("^<urn:page:.*>$") & (text != "<urn:page:none>"), F.regexp_extract(text, "^<urn:page:(.*)>$", 1)).cast(key_type)
    seen = archive.select(head.alias("head"), "payload", F.octet_length("record").alias("whole"))
    got = seen.select(urn(field("WARC-Record-ID")).alias(key), F.octet_length("payload").cast("long").alias("payload_bytes"), F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"), field("WARC-Type").alias("record_type"), urn(field("WARC-Refers-To")).alias("refers_to"), field("Content-Length").cast("long").alias("length"), F.length("head").alias("head_length"), "whole", sha1_base32(F.col("payload")).alias("digest"))
    right = (F.col("digest") == F.col("payload_digest")) & (F.col("whole") == F.col("head_length") + 8 + F.col("length")) & ((F.col("record_type") == "revisit") | (F.col("length") == F.col("payload_bytes")))
    return got.select(key, "payload_bytes", F.when(right, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a record does not match its payload"))).alias("payload_digest"), "record_type", "refers_to")


def round_trip(pages: DataFrame, key: str = "page_id", **how) -> DataFrame:
    """Write an archive into the shared folder, read it back and parse it."""
    path = new_path(pages.sparkSession, "warc")
    write(pages, path, key=key, **how)
    return parse(read(pages.sparkSession, path), key, dict(pages.dtypes)[key])
