"""Alias tables of distributions, by prefix sums: (dist, entry, count), counts of a distribution adding up to 2**log_range.

A table has 2**log_size entries of equal room. Entries with more than their room fill up those with less. Taken from the
highest entry down on both sides, the surpluses in a row and the gaps in a row are two divisions of one line, and who
fills whom is read off from where their borders lie: a gap is filled by the surplus that its begin falls into, and a
surplus that ends inside a gap is itself short by the rest, which the next surplus fills.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(counts: DataFrame, log_range: int = 12, log_size: int = 6) -> DataFrame:
    """dist, entry, cutoff, other, shift, own, its: for each of the 2**log_size entries of every distribution.

    A value at or above ``cutoff`` in its entry means the symbol ``other`` at place ``shift`` more, one below it the entry
    itself; ``own`` and ``its`` are both symbols' counts. An entry that is just full points at itself from 0 on.
    """
    size, room = 1 << log_size, (1 << log_range) >> log_size
    every = counts.select("dist").distinct().withColumn("entry", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(size - 1).cast("bigint"))))
    rows = every.join(counts.select("dist", "entry", "count"), ["dist", "entry"], "left").withColumn("own", F.coalesce("count", F.lit(0)).cast("bigint"))
    over, down = F.col("own") - room, W.partitionBy("dist").orderBy(F.col("entry").desc())
    upto = down.rowsBetween(W.unboundedPreceding, W.currentRow)
    surplus, gap = F.sum(F.when(over > 0, over)).over(upto), F.sum(F.when(over < 0, -over)).over(upto)
    rows = rows.select("dist", "entry", "own", over.alias("over"), F.coalesce(surplus, F.lit(0)).alias("o"), F.coalesce(gap, F.lit(0)).alias("u"))
    rows = rows.withColumn("only", F.max(F.when(F.col("own") == 1 << log_range, F.col("entry"))).over(W.partitionBy("dist")))
    # borders on the line: a surplus at its begin, a gap at its begin
    begin = F.when(F.col("over") > 0, F.col("o") - F.col("over")).otherwise(F.col("u") + F.col("over"))
    line = W.partitionBy("dist").orderBy("begin", F.when(F.col("over") > 0, 0).otherwise(1)).rowsBetween(W.unboundedPreceding, W.currentRow)
    after = W.partitionBy("dist").orderBy("end", F.when(F.col("over") < 0, 1).otherwise(0)).rowsBetween(W.currentRow, W.unboundedFollowing)
    held = rows.where("over <> 0").withColumn("begin", begin).withColumn("end", F.when(F.col("over") > 0, F.col("o")).otherwise(F.col("u")))
    filler = F.last(F.when(F.col("over") > 0, F.struct("entry", "o", "own")), ignorenulls=True).over(line)
    follower = F.lead(F.when(F.col("over") > 0, F.struct("entry", "o", "own"))).over(W.partitionBy("dist", F.col("over") > 0).orderBy("o"))
    closed = F.first(F.when(F.col("over") < 0, F.col("u")), ignorenulls=True).over(after)  # where the gap ends that a surplus ends in
    held = held.withColumns({"filler": filler, "next": follower, "closed": closed})
    short = F.col("closed") - F.col("o")  # of a surplus, after it has filled gaps
    made = held.select(
        "dist", "entry",
        F.when(F.col("over") < 0, F.struct(F.col("own").alias("cutoff"), F.col("filler.entry").alias("other"), (F.col("filler.o") - F.col("begin")).alias("shift"), F.col("filler.own").alias("its")))
        .when(short > 0, F.struct((room - short).alias("cutoff"), F.col("next.entry").alias("other"), (F.col("next.own") - room).alias("shift"), F.col("next.own").alias("its"))).alias("made"),
    )
    full = F.struct(F.lit(0).cast("bigint").alias("cutoff"), F.col("entry").alias("other"), F.lit(0).cast("bigint").alias("shift"), F.col("own").alias("its"))
    single = F.struct(F.lit(0).cast("bigint").alias("cutoff"), F.col("only").alias("other"), (F.col("entry") * room).alias("shift"), F.lit(1 << log_range).cast("bigint").alias("its"))
    out = rows.join(made, ["dist", "entry"], "left").withColumn("made", F.when(F.col("only").isNotNull(), single).otherwise(F.coalesce("made", full)))
    own = F.when(F.col("only").isNull(), F.col("own")).otherwise(F.lit(0).cast("bigint"))
    return out.select("dist", "entry", "made.cutoff", "made.other", "made.shift", own.alias("own"), "made.its")


def symbols(values: DataFrame, tables: DataFrame, log_range: int = 12, log_size: int = 6) -> DataFrame:
    """Adds symbol, place and count to values (dist, value) from 0 to 2**log_range less one: a join on the entry."""
    log_room = log_range - log_size
    rows = values.withColumn("entry", F.shiftright("value", log_room)).withColumn("_in", F.col("value") % (1 << log_room)).join(tables, ["dist", "entry"])
    far = F.col("_in") >= F.col("cutoff")
    found = rows.withColumns(
        {
            "symbol": F.when(far, F.col("other")).otherwise(F.col("entry")),
            "place": F.when(far, F.col("shift")).otherwise(F.lit(0)) + F.col("_in"),
            "count": F.when(far, F.col("its")).otherwise(F.col("own")),
        }
    )
    return found.select(*values.columns, "symbol", "place", "count")
