"""WARC archives of pages, and their deduplication by revisit records.

`capture` writes one response record a page. `read` parses archives by their Content-Length and
checks every payload against its digest. `revisits` shuffles the headers alone by payload digest:
of equal payloads of at least LEAST bytes the one with the largest page_id stays a response, the
others become revisit records that name it. `deduplicate` writes new archives with fresh headers
(new record ids and lengths); revisit records carry no payload. `resolve` reads a deduplicated
archive and joins each revisit to its original, so that every page has its digest and size again.

Archives are written by Spark's text writer, whose line separator is the end of a record, as gzip
files of at most RECORDS records: a lost task is written again under the writer's commit rules, and
any file system that Spark reaches will do. They are read as whole files, one row each, unpacked as
a stream in the task that has the row: a task holds one packed file and one record. A record's
place (file, offset) names it, so repeated pages stay apart. The joins meet on digests and record
ids with a unique right side; a payload or response that a third of all pages share makes a large
left side alone, which adaptive execution splits. The aggregate that finds originals combines
before it shuffles. Payloads are shuffled once, to meet the decision on their record.

Defined results: null html is the empty payload; payloads under LEAST bytes are all responses; of
equal page_ids with equal payloads one record, the last in the archive, is the response; a null page_id is
less than any other, and refers_to is null where the response has none; a null url is
`urn:page:<page_id>`; blanks and control characters of a url become %20, as they end a header; an
empty table gives archives without records and an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from .common import store, table

LEAST, RECORDS = 1000, 10_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
PLACE = ["file", "offset"]
HEADERS = "file string, offset long, type string, record_id string, page_id long, uri string, date string, refers_to string, digest string, payload_bytes long"
BATCH = 8 << 20


def _record(fields: dict[str, Column], http: Column, payload: Column) -> Column:
    """A record without its end: header lines, a blank line, the HTTP header and the payload. Fields that are null are left out."""
    length = (F.octet_length(http) + F.octet_length(payload)).cast("string")
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in (fields | {"Content-Length": length}).items()]
    return F.concat(F.concat_ws("\r\n", F.lit("WARC/1.1"), *lines), F.lit(END), http, payload)


def _http(size: Column) -> Column:
    return F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit(END))


def _uuid(of: Column) -> Column:
    h = F.md5(of)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[h.substr(a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _write(records: DataFrame, folder: str) -> str:
    records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(folder)
    return folder


def capture(pages: DataFrame, folder: str, date: str) -> str:
    """Write a response record for each row of pages (page_id, url, html); date is the records' WARC-Date."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    page = F.col("page_id").cast("string")
    uri = F.regexp_replace(F.coalesce(F.col("url"), F.concat(F.lit("urn:page:"), F.coalesce(page, F.lit("")))), "[\\x00-\\x20\\x7f]", "%20")
    fields = {
        "WARC-Type": F.lit("response"),
        "WARC-Record-ID": F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")),
        "WARC-Date": F.lit(date),
        "WARC-Target-URI": uri,
        "X-Page-ID": page,
        "WARC-Payload-Digest": F.concat(F.lit("sha1:"), F.sha1(payload)),
        "Content-Type": F.lit("application/http;msgtype=response"),
    }
    return _write(pages.select(_record(fields, _http(F.octet_length(payload)), payload).alias("value")), folder)


class _Stream:
    """Bytes of a gzip file, unpacked as they are asked for; the file may have several members."""

    def __init__(self, packed: memoryview):
        self.packed, self.at, self.open, self.held, self.offset = packed, 0, zlib.decompressobj(31), bytearray(), 0

    def _more(self) -> bool:
        if self.open.eof:
            left = self.open.unused_data
            self.at -= len(left)
            self.open = zlib.decompressobj(31)
        if self.at >= len(self.packed):
            return False
        self.held += self.open.decompress(self.packed[self.at : self.at + (1 << 18)])
        self.at += 1 << 18
        self.at = min(self.at, len(self.packed))
        return True

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        if len(self.held) < n:
            raise ValueError("the archive ends inside a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        self.offset += n
        return out

    def until(self, end: bytes) -> bytes:
        """Bytes to the next end, which is taken too; nothing at the end of the file."""
        seen = 0
        while (i := self.held.find(end, seen)) < 0:
            seen = max(0, len(self.held) - len(end))
            if not self._more():
                if self.held:
                    raise ValueError("the archive ends inside a header")
                return b""
        return self.take(i + len(end))


def records(packed: memoryview) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset in the unpacked file, headers with names in lower case, block) of each record."""
    stream, end = _Stream(packed), END.encode()
    while True:
        at = stream.offset
        head = stream.until(end).decode()
        if not head:
            return
        version, *lines = head[: -len(END)].split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        named = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
        yield at, named, stream.take(int(named["content-length"]))
        if stream.take(len(end)) != end:
            raise ValueError(f"the record at {at} is longer than its header says")


def _parsed(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in HEADERS.split(", ")] + ["payload"] * with_payload
        kinds = [pa.int64() if x.endswith("long") else pa.string() for x in HEADERS.split(", ")] + [pa.binary()] * with_payload
        rows: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if rows:
                cols = zip(*rows, strict=True)
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
                rows.clear()
                size = 0

        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                file = path.as_py().rsplit("/", 1)[1]
                for at, named, block in records(memoryview(content.as_buffer())):
                    payload = block.split(END.encode(), 1)[1]
                    full = named["warc-type"] == "response"
                    digest = named["warc-payload-digest"].removeprefix("sha1:")
                    if full and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"the payload at {at} of {file} is not that of its digest")
                    page = named.get("x-page-id")
                    row = (file, at, named["warc-type"], named["warc-record-id"], page and int(page), named["warc-target-uri"], named["warc-date"], named.get("warc-refers-to"), digest, len(payload) if full else None)
                    rows.append((*row, payload) if with_payload else row)
                    size += 500 + len(payload) * with_payload
                    if size > BATCH:
                        yield from flush()
        yield from flush()

    return run


def read(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """HEADERS of every record (and the payload as bytes): its place, and the payload's digest and size; revisit records have no size."""
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.gz").load(folder)
    return files.select("path", "content").mapInArrow(_parsed(with_payload), HEADERS + ", payload binary" * with_payload)


def revisits(headers: DataFrame, least: int = LEAST) -> DataFrame:
    """PLACE of each record that repeats another's payload, with that one's record_id, uri and date."""
    long = headers.where(F.col("payload_bytes") >= least)
    order = F.struct("page_id", *PLACE, "record_id", "uri", "date")
    kept = long.groupBy("digest", "payload_bytes").agg(F.max(order).alias("_kept"), F.count("*").alias("_n")).where("_n > 1")
    met = long.select("digest", "payload_bytes", *PLACE).join(kept.hint("merge"), ["digest", "payload_bytes"])
    other = (F.col("file") != F.col("_kept.file")) | (F.col("offset") != F.col("_kept.offset"))
    return met.where(other).select(*PLACE, *[F.col(f"_kept.{c}").alias(f"to_{c}") for c in ("record_id", "uri", "date")])


def deduplicate(spark: SparkSession, source: str, folder: str, least: int = LEAST) -> str:
    """Write the records of the archives in source again, repeated payloads as revisit records. Dates stay those of the capture."""
    again = revisits(store(read(spark, source), "headers"), least)
    all_ = read(spark, source, True).join(again.hint("merge"), PLACE, "left")
    repeat = F.col("to_record_id").isNotNull()
    new = lambda c: _uuid(F.concat(F.lit("deduplicated "), F.col(c)))
    only = lambda c: F.when(repeat, c)
    fields = {
        "WARC-Type": F.when(repeat, "revisit").otherwise(F.col("type")),
        "WARC-Record-ID": new("record_id"),
        "WARC-Date": F.col("date"),
        "WARC-Target-URI": F.col("uri"),
        "X-Page-ID": F.col("page_id").cast("string"),
        "WARC-Payload-Digest": F.concat(F.lit("sha1:"), F.col("digest")),
        "WARC-Profile": only(F.lit(PROFILE)),
        "WARC-Refers-To": only(new("to_record_id")),
        "WARC-Refers-To-Target-URI": only(F.col("to_uri")),
        "WARC-Refers-To-Date": only(F.col("to_date")),
        "Content-Type": F.lit("application/http;msgtype=response"),
    }
    payload = F.when(repeat, F.lit("")).otherwise(F.col("payload").cast("string"))
    return _write(all_.select(_record(fields, _http(F.col("payload_bytes")), payload).alias("value")), folder)


def resolve(headers: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (a page_id) for each record of a deduplicated archive."""
    full = headers.where("type = 'response'")
    original = full.select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("_page"), F.col("payload_bytes").alias("_bytes"), F.col("digest").alias("_digest"))
    again = headers.where("type = 'revisit'").drop("payload_bytes").join(original.hint("merge"), "refers_to")
    first = full.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return first.unionByName(again.select("page_id", F.col("_bytes").alias("payload_bytes"), F.col("_digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("_page").alias("refers_to")))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = capture(table(spark, sf_dir, "pages"), shared_folder(spark, "captured"), "2024-01-01T00:00:00Z")
    return resolve(store(read(spark, deduplicate(spark, raw, shared_folder(spark, "deduplicated"))), "headers"))


OP12_SQL = f"""
with p as (select row_number() over () as i, page_id, coalesce(html, '') as h from pages),
d as (select i, page_id, octet_length(encode(h)) as n, sha1(h) as g from p),
r as (select *, first_value(page_id) over w as kept, n >= {LEAST} and row_number() over w > 1 as again from d window w as (partition by g, n order by page_id desc nulls last, i))
select page_id, n::bigint as payload_bytes, g as payload_digest, case when again then 'revisit' else 'response' end as record_type, case when again then kept end as refers_to from r
"""
