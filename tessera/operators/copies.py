"""Window copies: a stream of literals and of copies (distance, length) of what came before, undone without a serial loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.sources.scratch import stored

#: Fixed value: how far back a copy may reach.
WINDOW = 1 << 20


def positions(tokens: DataFrame) -> DataFrame:
    """stream, pos, v, source: a row for each value that tokens (stream, idx, literal, distance, length) put out.

    A literal is its own value. A copied value comes from ``source``, an earlier position: a copy that overlaps itself
    repeats what it began with, so its sources all lie before it. Distances end at the stream's begin; a copy before
    any value gives zeros.
    """
    tokens = tokens.withColumn("_n", F.when(F.col("literal").isNotNull(), F.lit(1)).otherwise(F.col("length")).cast("bigint")).where("_n > 0")
    before = W.partitionBy("stream").orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    placed = tokens.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    back = F.least(F.col("distance"), F.col("_start"), F.lit(WINDOW))
    rows = placed.select("stream", "literal", "_start", back.alias("_back"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)).alias("_j"))
    value = F.when(F.col("literal").isNull() & (F.col("_start") == 0), F.lit(0)).otherwise(F.col("literal")).cast("bigint")
    source = F.when(value.isNull(), F.col("_start") - F.col("_back") + F.col("_j") % F.col("_back"))
    return rows.select("stream", (F.col("_start") + F.col("_j")).alias("pos"), value.alias("v"), source.cast("bigint").alias("source"))


def resolved(rows: DataFrame) -> DataFrame:
    """stream, pos, v of ``positions``: every open position takes the value of its source, or the source's source.

    Pointers jump, so a chain of n copies takes about log2 n rounds, a self-join each; positions that have their value
    no longer move. Each round is stored.
    """
    rows = stored(rows)
    known, live = rows.where("v is not null"), rows.where("v is null")
    while not live.isEmpty():
        at = known.unionByName(live).select("stream", F.col("pos").alias("source"), "v", F.col("source").alias("further"))
        moved = stored(live.drop("v").join(at, ["stream", "source"]).select("stream", "pos", "v", F.col("further").alias("source")))
        known, live = known.unionByName(moved.where("v is not null")), moved.where("v is null")
    return known.select("stream", "pos", "v")
