"""Operator 11: round trips, the verdicts by a plain rule, archives of other make, and its SQL."""

import base64
import gzip
import hashlib
import io
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from phasegrid.llm import warc
from phasegrid.llm.common import stored

SMALL = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string"


def _expected(rows):
    by = defaultdict(list)
    for page_id, _, html, *_ in rows:
        by[html or ""].append(page_id)
    out = []
    for page_id, _, html, *_ in rows:
        data, held = (html or "").encode(), max((p for p in by[html or ""] if p is not None), default=None)
        first = len(by[html or ""]) < 2 or held is None or page_id == held
        out.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first else held))
    return sorted(out, key=repr)


def _query(spark, tmp_path, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "pages.parquet"))
    return sorted(map(tuple, warc.op11_warc(spark, str(tmp_path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


def test_odd_pages(spark, tmp_path):
    rows = [(1, "http://a.example/x?y=1", "<p>é</p>"), (2, "http://a.example/\r\nWARC-Type: response", "<p>é</p>"), (3, None, None), (4, "", ""), (5, "http://[bad", "WARC/1.1\r\nWARC-Type: request\r\n\r\n\r\n\r\n"), (6, "u", "x" * 3_000_000)]
    rows += [(7, "u", "same")] * 2 + [(None, "n", "same"), (None, "n", "alone"), (None, "m", "alone"), (8, "q", "\r\n\r\n"), (8, "q", "other")]
    assert _query(spark, tmp_path, rows) == _expected(rows)


def test_a_third_of_the_pages_alike_and_clashing_columns(spark, tmp_path):
    rows = [(i, f"http://h/{i}", "copy" if i % 3 == 0 else f"page {i}", "s", "p", 1) for i in range(900)]
    assert _query(spark, tmp_path, rows, SCHEMA + ", sha1 string, payload string, holder int") == _expected(rows)


def test_no_pages(spark, tmp_path):
    assert _query(spark, tmp_path, []) == []


def test_small_payloads_are_responses_and_files_roll(spark):
    pages = spark.createDataFrame([(i, "u", "ab" if i % 2 else "a longer one") for i in range(40)], SCHEMA).coalesce(1)
    files = warc.write_archives(pages, least=5, file_bytes=100)
    assert files.count() > 2 and files.agg(F.sum("n_pages")).first()[0] == 40
    kinds = warc.read_archives(files).where("type IN ('response', 'revisit')").groupBy("type").count().collect()
    assert {r["type"]: r["count"] for r in kinds} == {"response": 21, "revisit": 19}


def test_payloads_and_urls_come_back(spark):
    rows = [(1, "http://a/ b\n", "é\r\n\r\nWARC/1.1\r\n"), (2, "http://a/%20", "x" * 2_500_000)]
    records = stored(warc.read_archives(warc.write_archives(spark.createDataFrame(rows, SCHEMA)), True), "records")
    got = warc.captures(records).select(F.get("responses", F.lit(0)).alias("r"), F.get("metadata", F.lit(0)).alias("m"), F.size("requests").alias("n")).collect()
    assert sorted((r.m.target_uri, r.r.payload.decode(), r.n) for r in got) == sorted([("http://a/%20b%0A", rows[0][2], 1), ("http://a/%20", rows[1][2], 1)])
    said = {x["name"]: x["value"] for r in got for x in r.m.fields if r.m.target_uri.endswith("%0A")}
    assert said == {"page-id": "1", "url": '"http://a/ b\\n"'}


def _foreign(record_id, kind, block=b"", content="text/plain", **named):
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}"] if record_id else [f"WARC-Type: {kind}"]
    lines += [f"WARC-Concurrent-To: {x}" for x in named.get("to", ())] + [f"Content-Type: {content}", f"Content-Length: {len(block)}"]
    return ("WARC/1.0\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


FOREIGN = [
    _foreign("<i>", "warcinfo", b"software: x\r\n", warc.FIELDS),
    _foreign("<a>", "response", b"HTTP/1.1 200 OK\r\nX: 1\r\n folded\r\n\r\nbody", "application/http; msgtype=response"),
    _foreign("<b>", "request", b"GET / HTTP/1.1\r\n\r\n", "application/http; msgtype=request", to=["<a>"]),
    _foreign("<c>", "metadata", b"k: v\r\n", warc.FIELDS, to=["<b>"]),
    _foreign("<d>", "response", b"no head", "text/plain", to=["<e>", "<f>"]),
    _foreign("<e>", "request", b"", to=["<d>"]),
    _foreign("<f>", "metadata", b""),
    _foreign("<g>", "resource", b"alone"),
    _foreign(None, "conversion", b"nameless"),
]


@pytest.mark.parametrize("make", [lambda x: b"".join(x), lambda x: gzip.compress(b"".join(x)), lambda x: b"".join(map(gzip.compress, x))])
def test_archives_of_other_make(spark, tmp_path, make):
    path = tmp_path / "foreign.warc"
    path.write_bytes(make(FOREIGN))
    records = stored(warc.read_archives(spark.createDataFrame([(f"file://{path}",)], "path string"), True), "records")
    assert records.count() == 9
    names = lambda x: tuple(sorted(r.record_id or "-" for r in x))
    got = sorted((names(r.requests), names(r.responses), names(r.metadata), names(r.others)) for r in warc.captures(records).collect())
    assert got == sorted([(("<b>",), ("<a>",), ("<c>",), ()), (("<e>",), ("<d>",), ("<f>",), ()), ((), ("<g>",), (), ()), ((), (), (), ("-",))])
    one = records.where("record_id = '<a>'").first()
    assert bytes(one.payload) == b"body" and [tuple(x) for x in one.http] == [("x", "1 folded")]


def test_a_cut_archive_is_an_error():
    for whole in (FOREIGN[1], FOREIGN[7]):
        with pytest.raises(ValueError, match="ends inside"):
            list(warc.records_of(io.BufferedReader(io.BytesIO(whole[:-8]))))


def test_query_gives_the_rows_of_its_sql(spark, duck):
    want = duck.execute(warc.OP11_SQL).fetchall()
    assert sorted(map(tuple, warc.op11_warc(spark, SMALL).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr) == sorted(want, key=repr)
