"""WARC archives: writing them, an index of their records, and reading records by merged byte ranges.

Writing is Spark's text sink with a record's closing blank lines as line separator: a record never changes a byte, files
go to any store Spark writes to, and its commit protocol keeps a lost executor's half-written files out. An archive is
read in two steps. The index says, for every record, file, offset, length, URL, type and payload digest; it is made by
one pass that reads record heads and skips over bodies. To fetch records, those wanted are sorted by file and offset,
ranges closer than a gap are merged up to a size, and each merged range is one read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import scratch_dir, stored

END = "\r\n\r\n"
#: Payloads under this many bytes are written again rather than referred to.
REVISIT_FROM = 100
#: Tasks that a payload common to very many pages is spread over, at least.
SALTS = 16
#: Payloads that several pages have, some 100 bytes each, that are broadcast at most.
BROADCAST_DIGESTS = 100_000

_INDEX = "file string, offset long, length long, type string, record_id string, url string, digest string, refers_to string"


def records(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """One string column ``value``, a WARC record without its closing blank lines, for each row of page_id, url, html.

    Of rows with equal payloads of at least ``revisit_from`` bytes those with the smallest page_id are responses (a
    repeated row is one too), the others revisit it and carry no payload. A null html is an empty payload, a null url
    leaves the target out, a null page_id is written as an empty one and never revisits or is revisited.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    size = F.octet_length("html").cast("long")
    rows = rows.withColumn("size", size).withColumn("key", F.when((size >= revisit_from) & F.col("page_id").isNotNull(), F.col("digest")))
    # a partial aggregate first; only payloads that several pages have come to the join
    repeated = rows.where("key is not null").groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    repeated = stored(repeated.select("key", "first"))
    if repeated.count() <= BROADCAST_DIGESTS:  # then the pages stay where they are
        joined = rows.join(F.broadcast(repeated), "key", "left")
    else:  # in several salts, so that a payload a third of the pages share is not one task's
        salted = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.hash("page_id"), F.lit(SALTS))).join(salted, ["key", "salt"], "left")
    revisit = F.col("page_id") > F.col("first")
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END)
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    url = F.regexp_replace("url", "[\\x00-\\x20\\x7f]", "%20")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), page,
        F.coalesce(F.concat(F.lit(">\r\nWARC-Target-URI: "), url), F.lit(">")),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(
            revisit,
            F.concat(
                F.lit("\r\nWARC-Refers-To: <urn:page:"), F.col("first").cast("string"),
                F.lit(">\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ),
        ).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(END),
    )
    return joined.select(F.concat(head, block).alias("value"))


def write(recs: DataFrame, path: str, max_records: int = 20_000) -> str:
    """Writes records to a new folder, a file per task and ``max_records``, and returns the folder."""
    recs.write.option("lineSep", END).option("maxRecordsPerFile", max_records).text(path)
    return path


def _open(path: str):
    """A seekable file of any store that Arrow knows; a path without a scheme, or file:, is a shared folder."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if path.startswith("/"):
        return fs.LocalFileSystem().open_input_file(path)
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}


def _scan(path: str, step: int = 1 << 16) -> Iterator[tuple]:
    """Index rows of one archive: heads are parsed, bodies skipped by their length."""
    with _open(path) as f:
        total, at = f.size(), 0
        while at < total:
            head, end = b"", -1
            while end < 0 and at + len(head) < total:
                f.seek(at + len(head))
                head += f.read(step if not head else 4 * step)
                end = head.find(b"\r\n\r\n")
            if end < 0:
                raise ValueError(f"{path}: no record at {at}")
            fields = _fields(head[:end])
            length = end + 4 + int(fields["content-length"])
            ident = lambda v: v.strip("<>").removeprefix("urn:page:") if v is not None else None
            yield (
                path, at, length, fields["warc-type"], ident(fields["warc-record-id"]), fields.get("warc-target-uri"),
                fields["warc-payload-digest"].removeprefix("sha256:"), ident(fields.get("warc-refers-to")),
            )
            at += length + 4


def index(spark: SparkSession, folder: str) -> DataFrame:
    """file, offset, length, type, record_id, url, digest, refers_to of every record below ``folder``; one task a file."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length").where("length > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = list(zip(*_scan(path))) or [()] * 8
                kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names=[x.split()[0] for x in _INDEX.split(", ")])

    return files.repartition("path").mapInArrow(run, _INDEX)


def fetch(wanted: DataFrame, gap: int = 1 << 16, most: int = 8 << 20) -> DataFrame:
    """Reads the records of index rows ``wanted``: their columns and ``block``, the bytes after the WARC head.

    Rows of a file are taken in order of offset; a new range starts where the hole before it exceeds ``gap`` bytes or
    the range would pass ``most`` bytes (in windows of that size, so that no range depends on what came long before).
    """
    by_file = W.partitionBy("file").orderBy("offset")
    window = F.floor(F.col("offset") / most)
    before = F.lag(F.col("offset") + F.col("length")).over(by_file)
    new = before.isNull() | (F.col("offset") - before > gap) | (window != F.lag(window).over(by_file))
    ranges = (
        wanted.withColumn("_new", new.cast("int"))
        .withColumn("_range", F.sum("_new").over(by_file))
        .groupBy("file", "_range")
        .agg(F.min("offset").alias("_from"), F.max(F.col("offset") + F.col("length")).alias("_to"), F.sort_array(F.collect_list(F.struct("offset", *[c for c in wanted.columns if c not in ("file", "offset")]))).alias("_rows"))
    )
    columns = [c for c in wanted.columns if c not in ("file", "offset")]
    schema = "file string, offset long, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema if f.name in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, end, rows in zip(*(batch.column(c).to_pylist() for c in ("file", "_from", "_to", "_rows"))):
                with _open(path) as f:
                    f.seek(start)
                    data = f.read(end - start)
                if len(data) != end - start:
                    raise ValueError(f"{path} ends before {end}")
                blocks = []
                for r in rows:
                    record = data[r["offset"] - start : r["offset"] - start + r["length"]]
                    blocks.append(record[record.index(b"\r\n\r\n") + 4 :])
                named = batch.schema.field("_rows").type.value_type
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(rows)), pa.array([r["offset"] for r in rows], pa.int64())]
                    + [pa.array([r[c] for r in rows], named.field(c).type) for c in columns]
                    + [pa.array(blocks, pa.binary())],
                    names=["file", "offset", *columns, "block"],
                )

    return ranges.select("file", "_from", "_to", "_rows").mapInArrow(run, f"{schema}, block binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives all pages, indexes the archives, reads every record back and reports on its full payload.

    page_id, payload_bytes, payload_digest, record_type, refers_to. A response's size and digest are of the bytes read;
    a revisit has no payload of its own, its record states the digest and, in its HTTP head, the size. A response whose
    bytes do not have the digest of the index is an error.
    """
    spark = pages.sparkSession
    folder = write(records(pages), scratch_dir(spark))
    cdx = stored(index(spark, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for ident, kind, digest, refers, block in zip(*(batch.column(c).to_pylist() for c in ("record_id", "type", "digest", "refers_to", "block"))):
                head, _, payload = block.partition(b"\r\n\r\n")
                size = int(_fields(head)["content-length"])
                if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"record {ident} does not hold what its head states")
                row = (int(ident) if ident else None, size, digest, kind, int(refers) if refers else None)
                for column, value in zip(out, row):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            )

    return fetch(cdx).mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )
