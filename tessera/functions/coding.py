"""Column functions of the entropy-coded parts that are not bit-serial themselves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.samples import col
from tessera.operators.transforms import folded


def token_parts(token, split: int = 4, msb: int = 2, lsb: int = 1) -> Column:
    """struct(bits, high, low) of a hybrid-integer token: the value is ((high << bits | raw) << lsb) | low.

    Tokens under 2**split are the value itself, with no raw bits.
    """
    t = col(token).cast("bigint")
    first = 1 << split
    bits = split - msb - lsb + F.shiftright(t - first, msb + lsb)
    high = (F.shiftright(t, lsb).bitwiseAND(F.lit((1 << msb) - 1))) + (1 << msb)
    small = F.struct(F.lit(0).cast("bigint").alias("bits"), F.shiftright(t, lsb).alias("high"), t.bitwiseAND(F.lit((1 << lsb) - 1)).alias("low"))
    large = F.struct(bits.cast("bigint").alias("bits"), high.cast("bigint").alias("high"), t.bitwiseAND(F.lit((1 << lsb) - 1)).alias("low"))
    return F.when(t < first, small).otherwise(large)


def move_to_front(codes: str, size: int) -> Column:
    """Undoes move-to-front coding of an array of numbers under ``size``."""
    def step(s, code):
        at = (code + 1).cast("int")
        found = F.element_at(s["table"], at)
        table = F.concat(F.array(found), F.slice(s["table"], 1, at - 1), F.slice(s["table"], at + 1, F.lit(size)))
        return F.struct(table.alias("table"), F.array(found).alias("added"))

    start = {"table": ("array<bigint>", F.sequence(F.lit(0).cast("bigint"), F.lit(size - 1).cast("bigint")))}
    return folded(F.col(codes), start, step, "out", "bigint")


def canonical_codes(lengths: DataFrame, group: str, symbol: str, length: str, most: int = 15) -> DataFrame:
    """Adds ``code``: the canonical prefix code of every symbol, shorter codes first, then by symbol; 0 bits have none."""
    before = W.partitionBy(group).orderBy(length, symbol).rowsBetween(W.unboundedPreceding, -1)
    used = lengths.where(F.col(length) > 0).withColumn("_s", F.expr(f"shiftleft(1L, int({most} - {length}))"))
    start = F.coalesce(F.sum("_s").over(before), F.lit(0).cast("bigint"))
    return used.withColumn("code", F.floor(start / F.pow(F.lit(2.0), most - F.col(length))).cast("bigint")).drop("_s")


def strength(value, table: Sequence[float]) -> Column:
    """Linear interpolation in a table over 0 to 1 and a step more, clamped to 0 to 1."""
    steps = len(table) - 2
    scaled = F.greatest(col(value) * steps, F.lit(0.0))
    past = scaled >= steps + 1
    at = F.when(past, F.lit(steps)).otherwise(F.floor(scaled)).cast("int")
    part = F.when(past, F.lit(1.0)).otherwise(scaled - F.floor(scaled))
    lut = F.array(*[F.lit(float(v)) for v in table])
    low, high = F.element_at(lut, at + 1), F.element_at(lut, at + 2)
    return F.least(F.greatest(low + (high - low) * part, F.lit(0.0)), F.lit(1.0))


def token_value(token, raw, split: int = 4, msb: int = 2, lsb: int = 1) -> Column:
    """The integer that a token and its raw bits stand for."""
    p = token_parts(token, split, msb, lsb)
    whole = F.expr("shiftleft(1L, 0)")
    shifted = p["high"] * F.pow(F.lit(2.0), p["bits"].cast("double")).cast("bigint") + F.when(p["bits"] > 0, col(raw)).otherwise(0 * whole)
    return F.shiftleft(shifted, lsb).bitwiseOR(p["low"])


def unshuffled(position, size, width: int) -> Column:
    """Where the byte at ``position`` comes from in bytes that were written column by column, ``width`` columns wide.

    Columns are ceil(size / width) long. The first rounds of one byte a column reach the last column, which may be short;
    the others end one column earlier.
    """
    p, n = col(position), col(size)
    rows = F.call_function("div", n + (width - 1), F.lit(width).cast("bigint"))
    across = F.call_function("div", n + rows - 1, rows)  # columns that have any byte
    full = n - rows * (across - 1)  # bytes of the last one
    late, short = p - full * across, F.greatest(across - 1, F.lit(1).cast("bigint"))
    row = F.when(p < full * across, F.call_function("div", p, across)).otherwise(full + F.call_function("div", late, short))
    column = F.when(p < full * across, p % across).otherwise(late % short)
    return row + column * rows


def shuffled(position, size, width: int) -> Column:
    """Where the byte at ``position`` goes: the other way round of ``unshuffled``."""
    p, n = col(position), col(size)
    rows = F.call_function("div", n + (width - 1), F.lit(width).cast("bigint"))
    across = F.call_function("div", n + rows - 1, rows)
    full = n - rows * (across - 1)
    row, column = p % rows, F.call_function("div", p, rows)
    return F.when(row < full, row * across + column).otherwise(full * across + (row - full) * (across - 1) + column)


def varints(rows: DataFrame, key: str, position: str, byte: str) -> DataFrame:
    """(key, n, v): the numbers in a stream of bytes, seven bits each, the last byte of a number under 128.

    Windows find where numbers start, a partial aggregate adds them up. Numbers are of at most eight bytes.
    """
    before = W.partitionBy(key).orderBy(position)
    first = F.coalesce(F.lag(byte).over(before) < 128, F.lit(True))
    named = rows.withColumn("_first", first).withColumn("n", F.sum(F.col("_first").cast("bigint")).over(before) - 1)
    start = F.min(position).over(W.partitionBy(key, "n"))
    part = F.col(byte) % 128 * F.pow(F.lit(2.0), 7.0 * (F.col(position) - F.col("_start"))).cast("bigint")
    named = named.withColumn("_start", start)
    done = named.groupBy(key, "n").agg(F.sum(part).alias("v"), F.max_by(byte, position).alias("_last"))
    return done.where("_last < 128").drop("_last")
