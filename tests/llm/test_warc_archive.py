import hashlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stagecast.llm import warc_archive
from stagecast.llm.common import shared_folder
from stagecast.llm.warc_archive import read_index, read_records, write_archive

BIG, SMALL = "é" * 600, "x" * 999


def archive(spark, rows):
    path = shared_folder(spark, "warc-test")
    write_archive(spark.createDataFrame(rows, "page_id long, url string, html string, header string"), path)
    return path


def test_types_links_and_digests(spark):
    path = archive(spark, [(1, "u1", BIG, "x"), (2, "u2", BIG, "x"), (9, "u9", BIG, "x"), (3, None, SMALL, "x"),
                           (4, "a\r\nWARC-Type: revisit", SMALL, "x"), (5, "u5", None, "x"), (6, "u6", "", "x"),
                           (None, "n", BIG, "x"), (9, "u9", BIG, "x")])
    got = sorted(((r["page_id"] or -1, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])
                  for r in read_index(spark, path).collect()), key=str)
    sha = {x: hashlib.sha1(x.encode()).hexdigest() for x in (BIG, SMALL, "")}
    want = [(1, 1200, sha[BIG], "revisit", 9), (2, 1200, sha[BIG], "revisit", 9), (-1, 1200, sha[BIG], "revisit", 9),
            (9, 1200, sha[BIG], "response", None), (9, 1200, sha[BIG], "response", None),
            (3, 999, sha[SMALL], "response", None), (4, 999, sha[SMALL], "response", None),
            (5, 0, sha[""], "response", None), (6, 0, sha[""], "response", None)]
    assert got == sorted(want, key=str)
    assert spark.read.parquet(f"{path}/payloads").count() == 3


def test_records_are_exact_bytes(spark):
    path = archive(spark, [(1, "u1", BIG, "x"), (2, "u2", BIG, "x"), (3, "u3", "hi", "x")])
    records = {bytes(r["record"]).split(b"urn:page:")[1][:1]: bytes(r["record"]) for r in read_records(spark, path).collect()}
    for page, body in ((b"2", BIG.encode()), (b"3", b"hi"), (b"1", b"")):
        head, block = records[page].split(b"\r\n\r\n", 1)
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and len(block) == int(fields[b"Content-Length"]) + 4
        assert block.endswith(b"\r\n\r\n") and block[:-4].endswith(b"\r\n\r\n" + body)
    assert b"WARC-Refers-To: <urn:page:2>" in records[b"1"]


def test_damaged_payloads_are_found(spark):
    path = archive(spark, [(1, "u1", BIG, "x")])
    stored = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"other"))
    damaged = shared_folder(spark, "warc-test")
    stored.write.parquet(f"{damaged}/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{damaged}/headers")
    with pytest.raises(PySparkException, match="does not match its address"):
        read_index(spark, damaged).collect()


def test_empty_table(spark):
    path = archive(spark, [])
    assert read_index(spark, path).count() == 0 and read_records(spark, path).count() == 0


def test_index_comes_from_rebuilt_records(spark, monkeypatch):
    path = archive(spark, [(1, "u1", BIG, "x"), (2, "u2", BIG, "x"), (3, "u3", "hi", "x")])
    assert read_index(spark, path).count() == 3
    for record in (F.expr("substring(record, 1, octet_length(record) - 1)"),
                   F.expr("concat(substring(record, 1, octet_length(header)), cast('ho' as binary), substring(record, octet_length(header) + 3))"),
                   F.expr("cast(replace(decode(record, 'UTF-8'), 'sha1:', 'sha1:0') as binary)")):
        monkeypatch.setattr(warc_archive, "read_records", lambda s, p: read_records(s, p).withColumn("record", record))
        with pytest.raises(PySparkException, match="does not match its header"):
            read_index(spark, path).collect()


def test_very_long_payloads_stay_whole(spark):
    long = "é<p>" * 1_500_000
    path = archive(spark, [(1, "u1", long, "x"), (2, "u2", long, "x"), (3, "u3", long + "!", "x")])
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"]) for r in read_index(spark, path).collect()}
    n, sha, more = len(long.encode()), hashlib.sha1(long.encode()).hexdigest(), hashlib.sha1((long + "!").encode()).hexdigest()
    assert got == {1: (n, sha, "revisit"), 2: (n, sha, "response"), 3: (n + 1, more, "response")}
