"""Content-addressed WARC archive: payloads once by SHA-256, record headers apart, joined to read back.

``payloads`` holds each distinct payload under its SHA-256; ``headers`` holds, for each record, the
exact header bytes of a WARC/1.1 record (and of the HTTP response in it) with the address of its
payload. Reading joins the two, recomputes every payload's address and fails on a mismatch, and gives
whole records: header bytes, payload, end mark. Records whose payload repeats (``min_bytes`` or more)
are revisits of the one with the largest page id; smaller payloads are always responses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stagecast.llm.common import shared_folder, table

MIN_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
END = "\r\n\r\n"


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def _header(h: str = "header") -> Column:
    return F.decode(F.col(h), "UTF-8")


def _field(name: str, pattern: str) -> Column:
    """A header field of a record, or null: the first line of that name."""
    found = F.regexp_extract(_header(), f"\\r\\n{name}: {pattern}\\r\\n", 1)
    return F.when(found != "", found)


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html", min_bytes: int = MIN_BYTES) -> None:
    """Write the archive of ``pages`` below ``path`` (a folder that all machines see).

    A null payload is empty, a null URL an empty target; line breaks in a URL are written as blanks,
    so that a header keeps one field a line. Rows that repeat a page id get a record each, and with
    the same payload the same type. A null id is never the largest; where all ids of a payload are
    null, all its records are responses. Payloads are kept whole, however long; other columns are not read. Payloads are shuffled once,
    after equal ones have met within each task; headers carry only addresses.
    """
    data = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page"),
                        F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), "[\\r\\n]", " ").alias("url"),
                        data.alias("payload")).withColumn("address", F.sha2("payload", 256))
    (rows.groupBy("address").agg(F.max("page").alias("last"), F.count(F.lit(1)).alias("copies"),
                                 F.first("payload").alias("payload"))
     .write.option("compression", "zstd").parquet(f"{path}/payloads"))
    last = pages.sparkSession.read.parquet(f"{path}/payloads").where(
        (F.col("copies") > 1) & (F.octet_length("payload") >= min_bytes)).select("address", "last")
    meta = rows.select("page", "url", "address", F.sha1("payload").alias("sha1"),
                       F.octet_length("payload").alias("size"))
    joined = meta.join(last, "address", "left")
    revisit = F.col("last").isNotNull() & ~F.col("page").eqNullSafe(F.col("last"))
    kind = F.when(revisit, "revisit").otherwise("response")
    header = F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", kind), _line("WARC-Record-ID", _record_id(F.col("page"))),
        _line("WARC-Date", F.lit(DATE)), _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(_line("WARC-Profile", F.lit(PROFILE)),
                                 _line("WARC-Refers-To", _record_id(F.col("last"))))).otherwise(""),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", (F.when(revisit, 0).otherwise(F.col("size")) + len(HTTP)).cast("string")),
        F.lit("\r\n" + HTTP))
    joined.select(F.encode(header, "UTF-8").alias("header"), "address").write.option(
        "compression", "zstd").parquet(f"{path}/headers")


def _payloads(spark: SparkSession, path: str) -> DataFrame:
    """Payloads with their address, each verified as it is read."""
    stored = spark.read.parquet(f"{path}/payloads").select("address", "payload")
    return stored.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("address"), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("payload does not match its address "), F.col("address"))).cast("binary")))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``(header, record, payload, address)``: each record's exact bytes (a revisit's end after its
    headers) and the full payload that it has or refers to."""
    joined = spark.read.parquet(f"{path}/headers").join(_payloads(spark, path), "address")
    body = F.when(_field("WARC-Type", "([a-z]+)") == "response", F.col("payload")).otherwise(F.lit(b""))
    return joined.select("header", F.concat(F.col("header"), body, F.lit(END.encode())).alias("record"),
                         "payload", "address")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, url, payload_bytes, payload_digest, record_type, refers_to)`` of the rebuilt records.

    Every record is put together first and its fields are read off its own bytes. Size and SHA-1 are those
    of the body in the record, for a revisit of the payload that it refers to; a record whose length, end
    mark or digest disagrees with its header raises. Payloads are shuffled to the headers' addresses.
    """
    start = F.octet_length("header")
    rebuilt = read_records(spark, path).select("record", "payload", start.alias("start"),
                                               F.substring("record", F.lit(1), start).alias("header"))
    read = rebuilt.select(
        "record", "payload", "start", _field("WARC-Type", "([a-z]+)").alias("record_type"),
        _field("WARC-Record-ID", "<urn:page:(-?[0-9]+)>").cast("long").alias("page_id"),
        F.regexp_extract(_header(), "\\r\\nWARC-Target-URI: ([^\\r\\n]*)\\r\\n", 1).alias("url"),
        _field("WARC-Payload-Digest", "sha1:([0-9a-f]+)").alias("said"),
        _field("Content-Length", "([0-9]+)").cast("int").alias("length"),
        _field("WARC-Refers-To", "<urn:page:(-?[0-9]+)>").cast("long").alias("refers_to"))
    held = F.substring("record", F.col("start") + 1, F.col("length") - len(HTTP))
    last = F.substring("record", F.octet_length("record") - len(END) + 1, F.lit(len(END)))
    whole = (F.octet_length("record") == F.col("start") - len(HTTP) + F.col("length") + len(END)) & (last == F.lit(END.encode()))
    facts = read.select("page_id", "url", "record_type", "refers_to", "said", whole.alias("whole"),
                        F.when(F.col("record_type") == "response", held).otherwise(F.col("payload")).alias("body")).select(
        "page_id", "url", F.octet_length("body").cast("long").alias("payload_bytes"),
        F.sha1("body").alias("payload_digest"), "record_type", "refers_to", "said", "whole")
    sound = F.col("whole") & (F.col("said") == F.col("payload_digest"))
    return facts.select(
        "page_id", "url", "payload_bytes",
        F.when(sound, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a record does not match its header"))
                                                         .cast("string")).alias("payload_digest"),
        "record_type", "refers_to")


def op10_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages in the shared folder and read the records back."""
    path = shared_folder(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_index(spark, path).drop("url")


OP10_SQL = """
WITH a AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
b AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS d,
             max(page_id) OVER (PARTITION BY payload) AS last FROM a)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
FROM b
"""
