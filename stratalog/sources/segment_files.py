"""Segment files: a sequential decoder, a reader on any store that Spark reaches, and a Python data source.

A file is records one after another, padded with zeros to whole pages.  Where no record stands and there are only
zeros, up to a header's bytes or the next page, the decoder goes on at that page.  It stops at the first torn record:
a header or payload that is cut, or a checksum that doesn't fit.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from stratalog.functions import encoding as E
from stratalog.functions.encoding import HEADER_BYTES, PAGE, RECORD_OVERHEAD

SCHEMA = "file string, offset long, length long, ledger_id long, entry_id long, payload binary, status string"
ARROW = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("ledger_id", pa.int64()), ("entry_id", pa.int64()), ("payload", pa.binary()), ("status", pa.string())])


def decode(data: bytes) -> Iterator[tuple]:
    """(offset, length, ledger_id, entry_id, payload, status): status is ok, or how the last record is torn."""
    at, end = 0, len(data)
    while at < end:
        page = (at // PAGE + 1) * PAGE
        blank = not any(data[at : min(page, at + HEADER_BYTES)])
        if at + HEADER_BYTES > end:
            if not blank:
                yield (at, end - at, None, None, None, "torn_header")
                return
            at = page
            continue
        size = struct.unpack_from("<I", data, at)[0]
        ledger, entry = struct.unpack_from(">QQ", data, at + 4)
        stop = at + RECORD_OVERHEAD + size
        fits = stop <= end
        if fits and zlib.crc32(data[at : stop - 4]) == struct.unpack_from("<I", data, stop - 4)[0]:
            yield (at, stop - at, ledger, entry, data[at + HEADER_BYTES : stop - 4], "ok")
            at = stop
        elif blank:
            at = page
        else:
            yield (at, min(stop, end) - at, ledger, entry, None, "bad_checksum" if fits else "torn_payload")
            return


def decoded(files: DataFrame, rows: int = 4096) -> DataFrame:
    """files (path, content) -> records; a file is a unit, bounded by the seal size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                waiting = []
                for record in decode(content.as_py() or b""):
                    waiting.append((path, *record))
                    if len(waiting) == rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*waiting, strict=True), ARROW, strict=True)], schema=ARROW)
                        waiting = []
                if waiting:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*waiting, strict=True), ARROW, strict=True)], schema=ARROW)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def packed(records: DataFrame, order: list[str]) -> DataFrame:
    """records (segment, ledger_id, entry_id, data, and the columns of order) -> (segment, content): one row a segment, padded to whole pages.

    A segment is bounded by the seal size, so it fits a row.
    """
    one = E.record(F.col("ledger_id"), F.col("entry_id"), F.col("data"))
    rows = records.groupBy("segment").agg(F.array_sort(F.collect_list(F.struct(*order, one.alias("_record")))).alias("rows"))
    body = F.unhex(F.array_join(F.transform("rows", lambda r: F.hex(r["_record"])), ""))
    return rows.withColumn("body", body).select("segment", F.rpad("body", E.align_up(F.octet_length("body")).cast("int"), F.unhex(F.lit("00"))).alias("content"))


def write_segments(segments: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """segments (segment, content) as files on any store that Spark writes to: a folder segment=<name> with one file for each.

    The text writer ends a row with a separator, here a zero byte: it takes the place of the last byte of the padding.  Content that ends in
    another byte gets a page of zeros behind it, which the decoder passes over.  Files appear when the job commits; lost tasks leave none.
    """
    last = F.substring("content", -1, 1) == F.unhex(F.lit("00"))
    size = F.octet_length("content")
    body = F.when(last, F.substring(F.col("content"), F.lit(1), size - 1)).otherwise(F.rpad("content", size + PAGE - 1, F.unhex(F.lit("00"))))
    rows = segments.where(size > 0).select("segment", body.cast("string").alias("value"))
    rows.write.mode(mode).partitionBy("segment").option("lineSep", "\0").text(path)


def written(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the segments under path; path is the segment's name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.regexp_extract("path", "/segment=([^/]*)/", 1).alias("path"), "content")


def truncated(files: DataFrame) -> DataFrame:
    """files (path, content) without what is torn: cut before the first torn record and padded to whole pages; cut: the bytes lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data = content.as_py() or b""
                torn = next((at for at, _, _, _, _, status in decode(data) if status != "ok"), len(data))
                whole = data[:torn].ljust(-(-torn // PAGE) * PAGE, b"\0") if torn < len(data) else data
                yield pa.RecordBatch.from_pydict({"path": [path], "content": [whole], "cut": [len(data) - torn]}, pa.schema([("path", pa.string()), ("content", pa.binary()), ("cut", pa.int64())]))

    return files.select("path", "content").mapInArrow(run, "path string, content binary, cut long")


def read_at(files: DataFrame, places: DataFrame) -> DataFrame:
    """places (segment_id, kind, offset, length, ledger_id, entry_id) with payload: the record there, null unless it is whole and of that key.

    files: segment_id, kind, content.  Just the bytes of the record are taken, JVM-side; a segment's content meets the list of its places once.
    """
    spots = places.groupBy("segment_id", "kind").agg(F.collect_list(F.struct("offset", "length", "ledger_id", "entry_id")).alias("spots"))
    cut = lambda s: s.withField("record", F.substring(F.col("content"), s["offset"].cast("int") + 1, s["length"].cast("int")))
    found = spots.join(files, ["segment_id", "kind"]).select("segment_id", "kind", F.explode(F.transform("spots", cut)).alias("s")).select("segment_id", "kind", "s.*")
    data = F.substring(F.col("record"), F.lit(HEADER_BYTES + 1), (F.col("length") - RECORD_OVERHEAD).cast("int"))
    whole = F.col("record") == E.record(F.col("ledger_id"), F.col("entry_id"), data)
    return found.withColumn("payload", F.when(whole, data)).drop("record")


def read_segments(spark: SparkSession, path: str, glob: str = "*.{seg,ent}") -> DataFrame:
    return decoded(spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path))


def listed(spark: SparkSession, path: str) -> DataFrame:
    """Segment files in order of id; other files are left out."""
    from stratalog.functions.encoding import file_id

    name = F.element_at(F.split("path", "/"), -1)
    files = spark.read.format("binaryFile").load(path).select("path", name.alias("name"), "length", "modificationTime")
    return files.withColumn("id", file_id(F.col("name"))).where("id is not null").orderBy("id")


class SegmentSource(DataSource):
    """spark.read.format("ledger_segment").load(folder): one partition a file, for folders mounted on every machine."""

    @classmethod
    def name(cls) -> str:
        return "ledger_segment"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> "SegmentReader":
        return SegmentReader(self.options["path"])


#: Filters that a reader applies itself, on the columns that a record's header holds.
PUSHED = {
    EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v,
}
COLUMNS = {"offset": 0, "length": 1, "ledger_id": 2, "entry_id": 3}


class SegmentReader(DataSourceReader):
    """Filters on offset, length, ledger_id and entry_id are applied before a row is made."""

    def __init__(self, path: str):
        self.path = path.removeprefix("file://")
        self.tests: list[tuple[type, int, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if type(f) in PUSHED and len(f.attribute) == 1 else None
            if name in COLUMNS:
                self.tests.append((type(f), COLUMNS[name], f.value))
            else:
                yield f

    def wanted(self, record: tuple) -> bool:
        return all(record[k] is not None and PUSHED[kind](record[k], value) for kind, k, value in self.tests)

    def partitions(self) -> list[InputPartition]:
        names = sorted(n for n in os.listdir(self.path) if n.endswith((".seg", ".ent")))
        return [InputPartition(os.path.join(self.path, n)) for n in names] or [InputPartition("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value:
            with open(partition.value, "rb") as file:
                for record in decode(file.read()):
                    if self.wanted(record):
                        yield (partition.value, *record)


def register(spark: SparkSession) -> None:
    """Also lets readers take filters: Spark refuses a reader that would, where that is off."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SegmentSource)
