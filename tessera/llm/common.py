"""What the operators of this subpackage share: the scratch folder, bucket counts, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where that is unset on one machine (tests) a temporary folder becomes the checkpoint folder; on a cluster, whose
    machines share no such folder, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
        if not base and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="spark-")
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_stored_at"] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` made, once everything that is to be made of them is itself stored."""
    for df in tables:
        spark, path = df.sparkSession, df.__dict__["_stored_at"]
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are done with: it does so when the driver collects its garbage,
    which a driver with memory to spare may not do for long while the executors' disks fill."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


#: Rows that a task unpacks of a Parquet file at a time, and bytes of what it sends to a Python worker at a time.
READ_ROWS, SENT_BYTES = 512, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on tasks of this session hold texts by a few MB at a time, whatever their length.

    Spark counts what it unpacks and sends on by rows, 4,096 and 10,000 of them, which of texts are some 20 to 64 MB at a
    time on each side of the pipe to a worker. Executors keep much of such buffers when they are done with them, so a long
    run of stages needs the more memory the longer it runs. Results do not depend on it.
    """
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", SENT_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_count(n: int, per_bucket: int, least: int = 8) -> int:
    """Buckets so that each holds about ``per_bucket`` of ``n``; grows with the input, so memory per bucket does not."""
    return max(least, -(-int(n) // per_bucket))


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def salt_count(spark: SparkSession) -> int:
    """Parts that a hot key is dealt to: more where there are more shuffle partitions, as on larger clusters."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) // 16)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for the undirected ``edges`` (a long, b long): component is the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al. 2014), each one shuffle; every round is written to the
    shared folder. A node with very many neighbours is no problem: stars only need the smallest neighbour, which is a
    partial aggregate, and the join that hands it out is one Spark can split.
    """
    both = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    cur = stored(both)
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node links to the node's smallest neighbour (or itself)
        sym = cur.select("a", "b").union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sym.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = sym.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # small star: smaller neighbours and the node itself link to the smallest of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = (
            large.join(least, "b")
            .select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y"))
            .where("x <> y")
            .select(F.col("x").alias("a"), F.col("y").alias("b"))
            .distinct()
        )
        nxt = stored(small)
        done = nxt.exceptAll(cur).isEmpty() and cur.exceptAll(nxt).isEmpty()
        cur = nxt
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    heads = cur.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return heads.union(cur.select(F.col("b").alias("node"), F.col("a").alias("component")))


def slices(batches, rows: int = 512):
    """The batches in parts of few rows, so that texts are never unpacked by the ten thousand; tidies up at the end."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    tidy()


def tidy() -> None:
    """Gives memory that a task no longer uses back to the machine; workers live on, and keep it otherwise."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file on this machine; every machine has the same package."""
    import public_tokenizers

    return public_tokenizers.path(name)
