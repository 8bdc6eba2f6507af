"""Prefix codes read from the least significant bit on: look-up tables of two levels, made and used without a loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.coding import canonical_codes

#: Bits that the first table looks at, bits of the longest code.
ROOT, MOST = 8, 15


def _power(bits) -> Column:
    return F.expr(f"shiftleft(1L, int({bits}))")


def turned(value: Column, width: Column) -> Column:
    """The lowest ``width`` bits of a number in reverse order."""
    bits = F.reverse(F.lpad(F.bin(value), width, F.lit("0")))
    return F.when(width > 0, F.conv(bits, 2, 10).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def tables(lengths: DataFrame, group: str, symbol: str, length: str) -> DataFrame:
    """group, slot, bits, value: the look-up table of every group's code (group, symbol, length), root table first.

    A slot of the root with ``bits`` up to 8 holds a symbol; with more, value is the place of a second table that the
    next bits - 8 bits look up, whose slots hold a symbol and the bits left of its code. Symbols of length 0 have no
    code. The one symbol of a group takes no bits. A code that leaves a gap or overlaps is an error.
    """
    whole = W.partitionBy(group)
    rows = lengths.select(group, symbol, F.col(length).cast("int").alias("_len")).where("_len > 0")
    rows = rows.withColumns({"_n": F.count("*").over(whole), "_all": F.sum(_power(f"{MOST} - _len")).over(whole)})
    fits = (F.col("_n") == 1) | (F.col("_all") == 1 << MOST)
    rows = rows.withColumn("_len", F.when(fits, F.col("_len")).otherwise(F.raise_error(F.lit("incomplete or oversubscribed prefix code")).cast("int")))
    codes = canonical_codes(rows, group, symbol, "_len", MOST)
    one = F.col("_n") == 1
    codes = codes.select(group, symbol, F.when(one, 0).otherwise(F.col("_len")).alias("_len"), F.when(one, 0).otherwise(F.col("code")).alias("_code"))

    short = codes.where(F.col("_len") <= ROOT)
    slots = F.sequence(turned(F.col("_code"), F.col("_len")), F.lit((1 << ROOT) - 1).cast("bigint"), _power("_len"))
    short = short.select(group, F.explode(slots).alias("slot"), F.col("_len").alias("bits"), F.col(symbol).cast("bigint").alias("value"))

    # at most 256 second tables a group, so the windows below are over few rows
    head = F.expr(f"shiftright(_code, _len - {ROOT})")
    deep = codes.where(F.col("_len") > ROOT).withColumns({"_head": head, "_rest": F.col("_len") - ROOT})
    links = deep.groupBy(group, "_head").agg(F.max("_rest").alias("_width"))
    before = W.partitionBy(group).orderBy("_head").rowsBetween(W.unboundedPreceding, -1)
    links = links.withColumn("_place", (1 << ROOT) + F.coalesce(F.sum(_power("_width")).over(before), F.lit(0).cast("bigint")))
    root = links.select(group, turned(F.col("_head"), F.lit(ROOT)).alias("slot"), (ROOT + F.col("_width")).alias("bits"), F.col("_place").alias("value"))

    tail = turned(F.col("_code").bitwiseAND(_power("_rest") - 1), F.col("_rest"))
    inner = F.sequence(F.col("_place") + tail, F.col("_place") + _power("_width") - 1, _power("_rest"))
    second = deep.join(links, [group, "_head"]).select(group, F.explode(inner).alias("slot"), F.col("_rest").alias("bits"), F.col(symbol).cast("bigint").alias("value"))
    return short.unionByName(root).unionByName(second)


def looked_up(windows: DataFrame, table: DataFrame, group: str, ahead: str) -> DataFrame:
    """Adds symbol and used (bits) to rows that hold the next 15 bits of a stream as a number, by ``tables`` of groups.

    Two equi-joins on keys that are unique in the table; rows of short codes take no part in the second.
    """
    first = table.select(F.col(group), F.col("slot").alias("_slot"), F.col("bits").alias("_bits"), F.col("value").alias("_value"))
    rows = windows.withColumn("_slot", F.col(ahead).bitwiseAND(F.lit((1 << ROOT) - 1)).cast("bigint")).join(first, [group, "_slot"])
    place = F.col("_value") + F.shiftright(F.col(ahead), ROOT).bitwiseAND(_power(f"_bits - {ROOT}") - 1)
    rows = rows.withColumn("_slot", F.when(F.col("_bits") > ROOT, place))
    second = table.where(F.col("slot") >= 1 << ROOT).select(group, F.col("slot").alias("_slot"), F.col("bits").alias("_more"), F.col("value").alias("_symbol"))
    rows = rows.join(second, [group, "_slot"], "left")
    deep = F.col("_bits") > ROOT
    symbol, used = F.when(deep, F.col("_symbol")).otherwise(F.col("_value")), F.when(deep, ROOT + F.col("_more")).otherwise(F.col("_bits"))
    return rows.withColumns({"symbol": symbol, "used": used.cast("bigint")}).drop("_slot", "_bits", "_value", "_more", "_symbol")
