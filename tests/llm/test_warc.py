import gzip
import io
import random

import pyarrow as pa
from pyspark.sql import functions as F

from tideloom.llm import warc


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"payload": F.lit(1), "last": F.lit("x")})


ROWS = [(1, "http://a/\r\nX: y", "same é"), (7, "http://b", "same é"), (3, None, "same é"), (4, "u", None), (5, "u", ""), (6, "u", "x" * 300000 + "\r\n\r\nWARC/1.1"),
        (None, "u", "same é"), (None, "u", "alone"), (8, "u", "own"), (8, "u", "own")]


def test_round_trip(spark):
    got = sorted(map(tuple, warc.archived(pages_of(spark, ROWS)).collect()), key=str)
    last = {"same é": 7, "": 5, "own": 8}
    want = []
    for i, _, html in ROWS:
        body = (html or "").encode()
        other = last.get(html or "")
        revisit = other is not None and other != i
        want.append((i, len(body), warc.digest(body), "revisit" if revisit else "response", other if revisit else None))
    assert got == sorted(want, key=str)
    assert warc.archived(pages_of(spark, [])).count() == 0


def test_payloads_headers_and_pushed_filters(spark, folder):
    path = folder()
    warc.write(pages_of(spark, ROWS).repartition(3), path)
    texts = sorted(bytes(r.payload).decode() for r in warc.read(spark, path).filter("record_type = 'response'").collect())
    assert texts == sorted(["same é", "", "x" * 300000 + "\r\n\r\nWARC/1.1", "alone", "own", "own"])
    revisits = warc.read(spark, path, payload=False).filter(F.col("record_type").isin("revisit", "metadata"))
    assert "filter" not in revisits._jdf.queryExecution().executedPlan().toString().lower().split("scan")[0]
    assert revisits.count() == 4 and revisits.filter("payload is not null").count() == 0
    assert warc.read(spark, path).filter("record_id = '<urn:x-page:6>'").first().target_uri == "u"


def test_small_least_size(spark):
    kept = warc.planned(pages_of(spark, ROWS), least=4).collect()
    assert {r.page_id for r in kept if r.refers_to is not None} == {1, 3, None}


def test_unwanted_blocks_are_not_decoded():
    fields = {"WARC-Type": "response", "WARC-Record-ID": "<urn:x:1>"}
    good, bad = warc.record(fields, b"abc"), bytearray(warc.record({**fields, "WARC-Record-ID": "<urn:x:2>"}, random.Random(1).randbytes(200000)))
    bad[5000:5100] = b"\xff" * 100  # a broken block
    seen = []
    for headers, block in warc.records(pa.BufferReader(good + bytes(bad) + good), True):
        if headers["WARC-Record-ID"] == "<urn:x:1>":
            seen.append(block())
    assert seen == [b"abc", b"abc"]


def test_archives_of_other_writers(spark, folder):
    path, big = folder(), b"z" * 200000
    plain = b"".join(b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, len(b), b) for i, b in enumerate([b"one", big, b"", b"four"]))
    (open(f"{path}/a.warc", "wb")).write(plain)
    members = io.BytesIO()
    for part in plain.split(b"WARC/1.0")[1:]:
        members.write(gzip.compress(b"WARC/1.0" + part))
    open(f"{path}/b.warc.gz", "wb").write(members.getvalue())
    got = warc.read(spark, path).collect()
    assert sorted(bytes(r.payload) for r in got) == sorted([b"one", big, b"", b"four"] * 2)
    assert warc.read(spark, path).filter("record_id = '<urn:x:3>'").count() == 2
