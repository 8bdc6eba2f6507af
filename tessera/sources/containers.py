"""Scanning image containers: files, their boxes, and the codestream they hold, as tables.

Files come from Spark's ``binaryFile`` source, a row a file, so listing, splitting over tasks and any store are Spark's.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The two signatures, and the content of the second box.
NAKED = "FF0A"
BOXED = "0000000C4A584C200D0A870A"
BRAND = bytearray(b"jxl \0\0\0\0jxl ")

_BOXES = "path string, seq int, box_type string, header_size long, content_size long, offset long, error string"


def scan(spark: SparkSession, paths: str, pattern: str | None = None) -> DataFrame:
    """path, length, content of every file."""
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(paths).select("path", "length", "content")


def signature(content: str = "content") -> Column:
    """What a file starts with: naked, boxed, invalid, or short (too few bytes to tell)."""
    size, head = F.octet_length(content), F.hex(F.substring(content, 1, 12))
    first = F.substring(head, 1, 2)
    return (
        F.when(size == 0, "short")
        .when((first == "FF") & (size < 2), "short").when(F.substring(head, 1, 4) == NAKED, "naked")
        .when((first == "00") & (size < 12), "short").when(head == BOXED, "boxed")
        .otherwise("invalid")
    )


def _walk(path: str, data: bytes) -> Iterator[tuple]:
    at, seq = 0, 0
    while at < len(data):
        size, header = int.from_bytes(data[at : at + 4], "big"), 8
        kind = data[at + 4 : at + 8].decode("utf-8", "replace")
        if size == 1:
            size, header = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        elif size == 0:
            size = len(data) - at
        if at + header > len(data) or size < header or at + size > len(data):
            yield path, seq, kind, header, None, at, "truncated" if at + max(size, header) > len(data) else "size under header"
            return
        yield path, seq, kind, header, size - header, at, None
        at, seq = at + size, seq + 1


def boxes(files: DataFrame) -> DataFrame:
    """path, seq, box_type, header_size, content_size, offset, error: a row a box; a bad box ends its file with an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        for batch in batches:
            rows = [r for path, data in zip(batch.column(0).to_pylist(), batch.column(1)) for r in _walk(path, data.as_py() or b"")]
            columns = zip(*rows) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[c.split()[0] for c in _BOXES.split(", ")])

    return files.select("path", "content").mapInArrow(run, _BOXES)


def codestreams(files: DataFrame) -> DataFrame:
    """path, format, codestream, error: the naked stream, the content of the one jxlc box, or the jxlp parts put together.

    Empty files have no row, as Spark's reader leaves them out.

    Part boxes carry a 31-bit number that must count from 0; the last has the top bit set.
    """
    known = files.select("path", "content", signature().alias("format"))
    naked = known.where("format <> 'boxed'").select(
        "path", "format", F.when(F.col("format") == "naked", F.col("content")).alias("codestream"),
        F.when(F.col("format") == "short", "truncated").when(F.col("format") == "invalid", "invalid signature").alias("error"),
    )
    found = boxes(known.where("format = 'boxed'")).join(known.select("path", "content"), "path")
    body = F.expr("substring(content, int(offset + header_size + 1), int(content_size))")
    number = F.conv(F.hex(F.expr("substring(content, int(offset + header_size + 1), 4)")), 16, 10).cast("long")
    rows = found.select("path", "seq", "box_type", "header_size", "error", body.alias("body"), F.when(F.col("box_type") == "jxlp", number).alias("n"))
    part = F.struct("seq", F.expr("n % 2147483648").alias("i"), (F.col("n") >= 2**31).alias("last"))
    rows = rows.withColumn("piece", F.when(F.col("box_type") == "jxlp", F.expr("substring(body, 5)")))
    whole = rows.groupBy("path").agg(
        F.first("error", True).alias("bad"),
        F.count_if(F.col("box_type") == "jxlc").alias("streams"),
        F.first(F.when(F.col("box_type") == "jxlc", F.col("body")), True).alias("stream"),
        F.array_sort(F.collect_list(F.when(F.col("box_type") == "jxlp", part))).alias("parts"),
        F.max_by("box_type", -F.col("seq")).alias("first"),
        F.first(F.when(F.col("seq") == 1, F.struct("box_type", "header_size", "body")), True).alias("second"),
        F.expr("listagg(piece) within group (order by seq)").alias("joined"),
    )
    n = F.size("parts")
    counted = F.transform("parts", lambda p: p["i"]) == F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i.cast("long"))
    ended = F.transform("parts", lambda p: p["last"]) == F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: i == n)
    error = (
        F.when(F.col("bad").isNotNull(), F.col("bad"))
        .when(F.coalesce(F.col("second.box_type"), F.lit("")) != "ftyp", "second box is not ftyp")
        .when((F.col("second.body") != F.lit(BRAND)) | (F.col("second.header_size") != 8), "invalid ftyp box")
        .when((F.col("streams") > 1) | ((F.col("streams") == 1) & (n > 0)), "several codestreams")
        .when((F.col("streams") == 0) & (n == 0), "no codestream")
        .when((n > 0) & ~counted, "parts out of order")
        .when((n > 0) & ~ended, "parts without an end")
    )
    stream = F.when(error.isNull(), F.when(n > 0, F.col("joined")).otherwise(F.col("stream")))
    return naked.union(whole.select("path", F.lit("boxed").alias("format"), stream.alias("codestream"), error.alias("error")))
