"""WARC archives and transaction assembly.

write_archives() turns rows of pages into WARC records: for each page a request, a response (or a
revisit, if an equal payload is stored already) and a metadata record.  The request and the metadata
name the response through WARC-Concurrent-To.  Spark's own text writer makes the files, so any
store that Spark reaches will do and a lost executor's files are written anew; a file is one gzip stream.

read_archives() parses files by Content-Length, members of a gzip file one after another.
assemble() joins request, response and metadata records through their concurrent-to identifiers, in
either direction and over one record between, and emits one nested row a capture.

Record ids are made from a record's content, so equal rows make equal records; assembly counts
those and emits as many captures.  Defined results: a null page_id or url is kept as null, a
null html is an empty payload.  Of equal payloads the least page_id (null last, then url) is stored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import blocks_for, keyed_join, read_table, shared_dir, stored

LEAST_REVISIT, FILE_BYTES = 100, 16 << 20
VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"  # pages carry no time of capture
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(kind: str, page_id: Column, url: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("\u0001", F.lit(kind), F.coalesce(page_id.cast("string"), F.lit("")), F.coalesce(url, F.lit("\u0002")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(kind: str | Column, ident: Column, fields: list[tuple[str, Column]], content: Column) -> Column:
    head = [F.lit(f"{VERSION}\r\nWARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind, F.lit("\r\nWARC-Record-ID: "), ident, F.lit(f"\r\nWARC-Date: {DATE}")]
    for name, value in fields:
        head.append(F.coalesce(F.concat(F.lit(f"\r\n{name}: "), value), F.lit("")))
    size = F.octet_length(content).cast("string")
    return F.concat(*head, F.lit("\r\nContent-Length: "), size, F.lit("\r\n\r\n"), content, F.lit("\r\n\r"))


def records(pages: DataFrame, n_files: int) -> DataFrame:
    """One column, value: WARC records less their last line feed, in n_files partitions that hold a capture's records together."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("size", F.octet_length("html"))
    order = F.struct(F.col("page_id").isNull().alias("n"), F.col("page_id").alias("page_id"), F.coalesce("url", F.lit("")).alias("u"), F.col("url").alias("url"))
    large = p.where(F.col("size") >= LEAST_REVISIT).select("digest", order.alias("o"))
    first = large.groupBy("digest").agg(F.min("o").alias("o"), F.count("*").alias("n")).where("n > 1").select("digest", F.col("o.page_id").alias("first_page"), F.col("o.url").alias("first_url"), F.lit(True).alias("shared"), F.col("n").alias("n_rows"))
    first = stored(first, "shared-payloads")
    x = keyed_join(p, first, "digest", ["page_id", "url"], "left").repartition(n_files).withColumn("kept", F.col("shared").isNull() | (F.col("page_id").eqNullSafe(F.col("first_page")) & F.col("url").eqNullSafe(F.col("first_url"))))
    one_line = F.regexp_replace("url", "[\\r\\n]+", "%0A")
    own = record_id("response", F.col("page_id"), F.col("url"), F.col("digest"))
    stored_as = record_id("response", F.col("first_page"), F.col("first_url"), F.col("digest"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"), F.when(F.col("kept"), F.col("html")).otherwise(""))
    response = _record(
        F.when(F.col("kept"), "response").otherwise("revisit"), own,
        [("WARC-Target-URI", one_line), ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), ("Content-Type", F.lit("application/http; msgtype=response")),
         ("WARC-Profile", F.when(~F.col("kept"), PROFILE)), ("WARC-Refers-To", F.when(~F.col("kept"), stored_as))], http,
    )
    path = F.coalesce(F.nullif(F.regexp_extract(F.coalesce(one_line, F.lit("")), "^[a-zA-Z][^:]*://[^/]*(/[^#]*)", 1), F.lit("")), F.lit("/"))
    host = F.regexp_extract(F.coalesce(one_line, F.lit("")), "^[a-zA-Z][^:]*://([^/?#]*)", 1)
    request = _record(
        "request", record_id("request", F.col("page_id"), F.col("url"), F.col("digest")),
        [("WARC-Target-URI", one_line), ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), path, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n")),
    )
    metadata = _record(
        "metadata", record_id("metadata", F.col("page_id"), F.col("url"), F.col("digest")),
        [("WARC-Target-URI", one_line), ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit("")), F.lit("payload-bytes: "), F.col("size").cast("string"), F.lit("\r\n")),
    )
    return x.select(F.explode(F.array(request, response, metadata)).alias("value"))


def write_archives(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> str:
    """Writes pages as *.warc.gz-format files (one gzip stream each) of at most about file_bytes before compression."""
    total = pages.agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0)) + 1500).alias("n")).first()["n"] or 0
    out = records(pages, blocks_for(total, file_bytes))
    out.write.option("lineSep", "\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)
    return path


HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)")
LENGTH = re.compile("[0-9]{1,18}")
GZIP = b"\x1f\x8b\x08"


def inflated(data: bytes) -> bytes:
    """A gzip file's members, one after another; plain bytes as they are.

    A member that is cut or damaged is read as far as it goes, and then the next one; bytes between members are no content.
    """
    if data[:2] != GZIP[:2]:
        return data
    out, at = [], 0
    while at >= 0:
        d, view = zlib.decompressobj(31), memoryview(data)
        try:
            for k in range(at, len(data), 1 << 16):
                out.append(d.decompress(view[k : k + (1 << 16)]))
                if d.eof:
                    break
        except zlib.error:
            at = data.find(GZIP, at + 1)
            continue
        if not d.eof:
            break
        at = data.find(GZIP, min(len(data), k + (1 << 16)) - len(d.unused_data))
    return b"".join(out)


def parsed(data: bytes) -> Iterator[dict]:
    """Records of one archive.

    A header without a length, or with one that is no number, begins no record: reading goes on at the next WARC/.  A record that is cut
    ends the archive.  Each record has skipped, the bytes before it that belong to none; those after the last are a row of type skipped.
    """
    at, done = 0, 0
    lost = lambda a, b: len(data[a:b].strip(b"\r\n"))
    while True:
        at = data.find(b"WARC/", at)
        end = data.find(b"\r\n\r\n", at)
        if at < 0 or end < 0:
            break
        begin = data.find(b"\r\n", at)
        fields = [(m[1].strip().lower().decode("utf-8", "replace"), m[2].strip().decode("utf-8", "replace")) for m in HEADER.finditer(data, begin, end)]
        one = dict(fields)
        if not LENGTH.fullmatch(one.get("content-length", "")):
            at += 5
            continue
        size = int(one["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size:
            break
        payload = block
        if one.get("content-type", "").startswith("application/http"):
            payload = block.partition(b"\r\n\r\n")[2]
        yield {
            "record_id": one.get("warc-record-id"), "type": one.get("warc-type"), "date": one.get("warc-date"), "uri": one.get("warc-target-uri"),
            "concurrent_to": [v for k, v in fields if k == "warc-concurrent-to"], "refers_to": one.get("warc-refers-to"), "declared_digest": one.get("warc-payload-digest"),
            "block": block, "payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest(), "skipped": lost(done, at),
        }
        at = done = end + 4 + size
    if rest := lost(done, len(data)):
        yield {"record_id": None, "type": "skipped", "concurrent_to": [], "skipped": rest}


RECORD = "record_id string, type string, date string, uri string, concurrent_to array<string>, refers_to string, declared_digest string, block binary, payload_bytes long, payload_digest string, skipped long"
ARROW = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("date", pa.string()), ("uri", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("declared_digest", pa.string()), ("block", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("skipped", pa.int64())])


def read_archives(spark: SparkSession, path: str, blocks: tuple[str, ...] = ("request", "response", "revisit", "metadata", "resource")) -> DataFrame:
    """Records of all archives under path; digests are taken from the payloads as read.  Blocks of other types than asked for are null.

    Unreadable bytes are told by skipped (see parsed); rows of type skipped are no records, and assemble() leaves them out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for r in parsed(inflated(content.as_py())):
                    if r["type"] not in blocks:
                        r["block"] = None
                    rows.append(r)
                    size += len(r.get("block") or b"") + 500
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, ARROW)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*part-*").load(path).select("content")
    return files.mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row a capture: capture_id, uri, record_type, n_equal (equal captures), response, request and metadata (nested).

    A capture is a response, revisit or resource record; other records belong to it by
    WARC-Concurrent-To, theirs or its own, at first or second hand (a metadata record concurrent to the request).
    Records that reach no capture are left out.  A capture has one request (the least record id); its metadata stand in order of id.
    """
    slim = records.withColumn("is_capture", F.col("type").isin("response", "revisit", "resource"))
    captures = slim.where("is_capture").groupBy("record_id").agg(*(F.first(c).alias(c) for c in ("type", "uri", "date", "refers_to", "declared_digest", "payload_bytes", "payload_digest", "block")), F.count("*").alias("n_equal"))
    others = slim.where("not is_capture").groupBy("record_id").agg(*(F.first(c).alias(c) for c in ("type", "date", "block", "concurrent_to")))
    links = slim.where("is_capture").select("record_id", F.explode("concurrent_to").alias("other")).distinct()
    said = others.select("record_id", F.explode("concurrent_to").alias("other")).distinct()
    of_capture = captures.select(F.col("record_id").alias("other"))
    direct = said.join(of_capture, "other").select("record_id", F.col("other").alias("capture_id")).unionByName(links.select(F.col("other").alias("record_id"), F.col("record_id").alias("capture_id")))
    # the rest may name a record that names the capture, or be named by one
    either = said.unionByName(said.select(F.col("other").alias("record_id"), F.col("record_id").alias("other")))
    unplaced = either.join(of_capture, "other", "left_anti").join(direct.select("record_id").distinct(), "record_id", "left_anti")
    second = unplaced.join(direct.withColumnRenamed("record_id", "other"), "other").select("record_id", "capture_id")
    placed = direct.unionByName(second).distinct()
    joined = others.join(placed, "record_id")
    request = joined.where("type = 'request'").groupBy("capture_id").agg(F.min(F.struct("record_id", "date", "block")).alias("request"))
    metadata = joined.where("type = 'metadata'").groupBy("capture_id").agg(F.array_sort(F.collect_list(F.struct("record_id", "date", "block"))).alias("metadata"))
    response = F.struct("record_id", "date", "refers_to", "declared_digest", "payload_bytes", "payload_digest", "block")
    out = captures.select(F.col("record_id").alias("capture_id"), "uri", F.col("type").alias("record_type"), "n_equal", response.alias("response"))
    return out.join(request, "capture_id", "left").join(metadata, "capture_id", "left")


def captured(spark: SparkSession, pages: DataFrame, path: str) -> DataFrame:
    """Writes pages to archives under path, reads them back and assembles; page_id is taken from the metadata record.

    For a revisit, payload_bytes and payload_digest are those of the record that it refers to.
    """
    write_archives(pages, path)
    nested = assemble(stored(read_archives(spark, path, ("request", "metadata")), "records"))
    page = F.nullif(F.regexp_extract(F.col("metadata")[0]["block"].cast("string"), "page-id: (-?\\d+)", 1), F.lit("")).cast("long")
    rows = nested.select("capture_id", "uri", "record_type", "n_equal", page.alias("page_id"), "response.payload_bytes", "response.payload_digest", F.col("response.refers_to").alias("stored"))
    rows = stored(rows, "captures")  # no payloads
    target = rows.where("record_type = 'response'").select(F.col("capture_id").alias("stored"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("b"), F.col("payload_digest").alias("d"))
    whole = rows.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"), "uri", "n_equal")
    again = rows.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest")
    target = stored(target.join(again.groupBy("stored").agg(F.count("*").alias("n_rows")), "stored"), "revisited")
    revisits = keyed_join(again, target, "stored", ["capture_id"]).select("page_id", F.col("b").alias("payload_bytes"), F.col("d").alias("payload_digest"), "record_type", "refers_to", "uri", "n_equal")
    return whole.unionByName(revisits).withColumn("n_equal", F.explode(F.sequence(F.lit(1), F.col("n_equal").cast("int")))).drop("n_equal")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    return captured(spark, read_table(spark, sf_dir, "pages"), path).drop("uri")
