"""Archives: what is written can be read, revisits name the right original, odd rows have their result."""

from __future__ import annotations

import gzip
import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quaylight.llm import queries, warc

PAGES = "page_id long, url string, html string"
LONG = "<p>" + "\u00e9\r\n\r\nWARC/1.1\r\n" * 100
ROWS = [
    (1, "https://a.example/1", LONG), (9, "https://a.example/ 9\r\nX: y", LONG), (3, None, LONG), (9, "https://a.example/9b", LONG),
    (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (None, "u", LONG), (None, "u", "x" * 2000), (None, "u", "x" * 2000),
    (10, "u", "y" * 999), (11, "u", "y" * 999), (12, "u", "z" * 1000), (13, "u", "z" * 1000), (14, "u", "\x00\x7f" * 600), (14, "u", "\x00\x7f" * 600),
]


def plain(rows: list[tuple]) -> list[tuple]:
    groups = defaultdict(list)
    for page, _, html in rows:
        groups[(html or "").encode()].append(page)
    out = []
    for payload, pages in groups.items():
        pages = sorted(pages, key=lambda p: (p is not None, p), reverse=True)
        what = (len(payload), hashlib.sha1(payload).hexdigest())
        out += [(p, *what, *(("revisit", pages[0]) if len(payload) >= 1000 and i else ("response", None))) for i, p in enumerate(pages)]
    return sorted(out, key=repr)


def test_query_equals_a_plain_version(spark, tmp_path):
    spark.createDataFrame(ROWS, PAGES).withColumn("file", F.lit("clash")).withColumn("digest", F.lit(1)).repartition(4).write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(map(tuple, queries.QUERIES["op12_warc"](spark, str(tmp_path)).collect()), key=repr) == plain(ROWS)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    assert queries.QUERIES["op12_warc"](spark, str(tmp_path)).count() == 0


def test_archives_hold_each_payload_once(spark, tmp_path):
    df = spark.createDataFrame(ROWS, PAGES).repartition(3)
    raw = warc.capture(df, f"{tmp_path}/raw", "2020-02-02T00:00:00Z")
    again = warc.deduplicate(spark, raw, f"{tmp_path}/again")
    first, second = warc.read(spark, raw, True).collect(), warc.read(spark, again, True).collect()
    assert sorted(bytes(r.payload) for r in first) == sorted((h or "").encode() for _, _, h in ROWS)
    assert {r.type for r in first} == {"response"} and len(first) == len(second) == len(ROWS)
    held = [bytes(r.payload) for r in second if r.type == "response" and len(r.payload) >= 1000]
    assert len(held) == len(set(held)) == 4
    assert all(r.payload == b"" and r.payload_bytes is None and r.refers_to for r in second if r.type == "revisit")
    ids = {r.record_id for r in second}
    assert len(ids) == len(ROWS) and {r.refers_to for r in second if r.refers_to} <= ids and not ids & {r.record_id for r in first}
    assert {r.date for r in second} == {"2020-02-02T00:00:00Z"}
    assert "https://a.example/%209%0D" not in {r.uri for r in first} and "https://a.example/%209%20%20X:%20y" in {r.uri for r in first}
    # Each file is a run of whole records for any reader of the format.
    import glob

    for f in glob.glob(f"{again}/*.gz"):
        with open(f, "rb") as g:
            data = gzip.decompress(g.read())
        assert not data or (data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n"))


def test_reader_follows_lengths_and_members(spark):
    one = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 6\r\n\r\na\r\n\r\nb\r\n\r\n"
    packed = gzip.compress(one) + gzip.compress(one * 2)
    got = list(warc.records(memoryview(packed)))
    assert [(at, block) for at, _, block in got] == [(i * len(one), b"a\r\n\r\nb") for i in range(3)]
    assert list(warc.records(memoryview(gzip.compress(b"")))) == []
    for bad in (one[:-3], one.replace(b"Length: 6", b"Length: 5"), b"x" + one, one + b"WARC"):
        with pytest.raises(ValueError):
            list(warc.records(memoryview(gzip.compress(bad))))


def test_a_changed_payload_is_noticed(spark, tmp_path):
    record = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nWARC-Date: d\r\nWARC-Target-URI: u\r\nWARC-Payload-Digest: sha1:00\r\nContent-Length: 9\r\n\r\nH\r\n\r\nbody"
    spark.createDataFrame([(record,)], "value string").write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(f"{tmp_path}/bad")
    with pytest.raises(Exception, match="not that of its digest"):
        warc.read(spark, f"{tmp_path}/bad").collect()
