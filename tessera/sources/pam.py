"""Writing images as portable arbitrary maps, one file an image, through a Spark data source named ``pam``."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def strips(pixels: DataFrame, bits: int = 8) -> DataFrame:
    """img, y, part (binary): each row of pixels (img, x, y, r, g, b, a) as bytes, and the header as row -1.

    Samples over 8 bits are big-endian. No step holds more than a row of an image.
    """
    digits, most = (2, 255) if bits == 8 else (4, 65535)
    pixel = F.unhex(F.concat(*[F.lpad(F.hex(c), digits, "0") for c in "rgba"]))
    rows = pixels.select("img", "x", "y", pixel.alias("p")).groupBy("img", "y").agg(F.expr("listagg(p) within group (order by x)").alias("part"), F.max("x").alias("x"))
    sizes = rows.groupBy("img").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    head = F.format_string(f"P7\nWIDTH %d\nHEIGHT %d\nDEPTH 4\nMAXVAL {most}\nTUPLTYPE RGB_ALPHA\nENDHDR\n", "w", "h")
    return rows.select("img", F.col("y").cast("long").alias("y"), "part").union(sizes.select("img", F.lit(-1).cast("long"), F.encode(head, "UTF-8")))


def payloads(pixels: DataFrame, bits: int = 8) -> DataFrame:
    """img, payload (binary): the whole file of each image, for images that fit a row."""
    return strips(pixels, bits).groupBy("img").agg(F.expr("listagg(part) within group (order by y)").alias("payload"))


@dataclass
class _Written(WriterCommitMessage):
    names: list


class _Writer(DataSourceWriter):
    """Files are written strip by strip under hidden names and renamed when the job commits, so a failed task leaves no image.

    Rows come in order of image and strip, all of an image in one task.
    """

    def __init__(self, path: str):
        self.path = path

    def _store(self):
        from pyarrow import fs

        if self.path.startswith("file:") or self.path.startswith("/"):
            return fs.LocalFileSystem(), "/" + self.path.removeprefix("file:").lstrip("/")
        return fs.FileSystem.from_uri(self.path)

    def write(self, rows):
        from pyspark import TaskContext

        store, folder = self._store()
        store.create_dir(folder, recursive=True)
        task, names = TaskContext.get().taskAttemptId(), []
        for img, parts in groupby(rows, key=lambda row: row["img"]):
            hidden = f"{folder}/_{img}-{task}"
            with store.open_output_stream(hidden) as f:
                for row in parts:
                    f.write(bytes(row["part"]))
            names.append((hidden, f"{folder}/{img}.pam"))
        return _Written(names)

    def commit(self, messages):
        store, _ = self._store()
        for m in messages:
            for hidden, name in m.names if m else []:
                store.move(hidden, name)

    def abort(self, messages):
        store, _ = self._store()
        for m in messages:
            for hidden, _ in m.names if m else []:
                store.delete_file(hidden)


class PamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pam"

    def schema(self) -> str:
        return "img long, y long, part binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def write(spark: SparkSession, pixels: DataFrame, path: str, bits: int = 8) -> None:
    spark.dataSource.register(PamSource)
    dealt = strips(pixels, bits).select(F.col("img").cast("long").alias("img"), "y", "part").repartition("img").sortWithinPartitions("img", "y")
    dealt.write.format("pam").mode("append").save(path)
