import base64
import collections
import gzip
import hashlib
import os

import pytest

from parley.llm.warc import archive_pages, encode_record, gzip_member, page_records, register_warc


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def expected(pages):
    by = collections.defaultdict(list)
    for page, html in pages:
        by[(html or "").encode()].append(page)
    out = []
    for payload, ids in by.items():
        keeper = max((x for x in ids if x is not None), default=None)
        out += [(x, len(payload), digest(payload), *(("response", None) if x == keeper else ("revisit", keeper))) for x in ids]
    return out


ROWS = [(1, "u1", "<p>a</p>"), (2, "u2", "<p>a</p>"), (3, None, None), (4, "u\r\n4", ""), (5, "u5", "é\x00" * 70000),
        (6, "u6", "b\r\n\r\nWARC/1.1\r\n"), (6, "u6", "b\r\n\r\nWARC/1.1\r\n"), (None, "u7", "<p>a</p>"), (None, "u8", "alone")]


def test_pages(spark, tmp_path):
    df = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "page_id long, url string, html string, sha string, body int")
    got = [tuple(r) for r in archive_pages(df, f"file://{tmp_path}/a").collect()]
    assert sorted(got, key=str) == sorted(expected([(r[0], r[2]) for r in ROWS]), key=str)
    assert archive_pages(df.limit(0), f"{tmp_path}/b").collect() == []


def test_small_payloads_are_all_responses(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    kinds = {(r.record_id, r.record_type) for r in page_records(df, min_bytes=9).collect()}
    assert ("urn:page:1", "response") in kinds and ("urn:page:2", "response") in kinds


def test_archive_is_plain_gzip_and_filters_reach_the_reader(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    register_warc(spark)
    path = str(tmp_path / "c")
    page_records(df).repartition(1).write.format("warc").mode("append").option("fileBytes", 200).save(path)
    names = [x for x in os.listdir(path) if x.endswith(".warc.gz")]
    assert len(names) > 1
    whole = b"".join(gzip.open(os.path.join(path, x)).read() for x in names)
    assert whole.count(b"WARC-Type: revisit") == 3 and whole.startswith(b"WARC/1.1\r\n")
    read = spark.read.format("warc").load(path)
    kept = read.where("record_type = 'response' AND target_uri LIKE 'u5%'").select("target_uri", "payload")
    assert [(r.target_uri, bytes(r.payload)) for r in kept.collect()] == [("u5", ("é\x00" * 70000).encode())]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert ") Filter " not in plan   # the scan applied both conditions


def test_header_columns_skip_payloads_and_foreign_archives(spark, tmp_path):
    register_warc(spark)
    rows = [{"record_id": f"urn:x:{i}", "target_uri": "u", "payload": bytes([65 + i]) * 5000} for i in range(3)]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "plain.warc").write_bytes(b"".join(map(encode_record, rows)))
    (tmp_path / "d" / "noskip.warc.gz").write_bytes(b"".join(gzip.compress(encode_record(r)) for r in rows))
    spoilt = bytearray(gzip_member(encode_record(rows[0] | {"payload": os.urandom(5000)})))
    spoilt[-2000] ^= 255   # never inflated when only headers are asked for
    (tmp_path / "d" / "skip.warc.gz").write_bytes(bytes(spoilt) + gzip_member(encode_record(rows[1])))
    load = lambda columns: spark.read.format("warc").schema(columns).load(str(tmp_path / "d"))
    assert load("record_id string, record_type string").count() == 8
    with pytest.raises(Exception):
        load("payload binary").collect()
    (tmp_path / "d" / "skip.warc.gz").unlink()
    assert sorted(bytes(r.payload) for r in load("payload binary").collect()) == sorted(2 * [r["payload"] for r in rows])


def test_files_without_commit_are_not_read(spark, tmp_path):
    register_warc(spark)
    path = tmp_path / "e"
    df = spark.createDataFrame(ROWS[:2], "page_id long, url string, html string")
    page_records(df).write.format("warc").mode("append").save(str(path))
    (path / "part-lost.warc.gz").write_bytes(gzip_member(encode_record({"record_id": "urn:lost"})))
    assert spark.read.format("warc").load(str(path)).count() == 2


def test_query(spark):
    import __spark_entry__ as E
    sf = "/root/testdata/sf0.001"
    got = [tuple(r) for r in E.queries()["op1_warc"](spark, sf).collect()]
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted(got) == sorted(expected(pages))
