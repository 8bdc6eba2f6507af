"""Laying transforms of several sizes on a grid of cells, each at the first free cell in reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.transforms import folded, named


def laid_out(groups: DataFrame) -> DataFrame:
    """group, n, x, y, bw, bh: the place of each item of groups (group, w, h, items), items an array of struct<bw, bh>.

    As an item takes the first free cell, what is taken of a column is always its upper part, so the state of the fold is
    a number for each column, how far down it is taken. Items left over when the grid is full have no place and are left
    out; so is nothing else, but a group may have too few items to fill its grid (see ``covers``). A group is one row.
    """
    start = {"n": ("bigint", F.lit(0).cast("bigint")), "tops": ("array<bigint>", F.array_repeat(F.lit(0).cast("bigint"), F.col("w").cast("int")))}
    none = F.array().cast("array<struct<n: bigint, x: bigint, y: bigint, bw: bigint, bh: bigint>>")

    def step(s, item):
        first = F.array_min(F.transform(s["tops"], lambda top, x: F.struct(top.alias("y"), x.cast("bigint").alias("x"))))

        def put(at):
            fits = at["y"] < F.col("h")
            inside = lambda x: (x >= at["x"]) & (x < at["x"] + item["bw"])
            tops = F.transform(s["tops"], lambda top, x: F.when(fits & inside(x), F.greatest(top, at["y"] + item["bh"])).otherwise(top))
            one = F.struct(s["n"].alias("n"), at["x"].alias("x"), at["y"].alias("y"), item["bw"].cast("bigint").alias("bw"), item["bh"].cast("bigint").alias("bh"))
            return F.struct((s["n"] + 1).alias("n"), tops.alias("tops"), F.when(fits, F.array(one)).otherwise(none).alias("added"))

        return named(first, put)

    placed = folded(F.col("items"), start, step, "placed", "struct<n: bigint, x: bigint, y: bigint, bw: bigint, bh: bigint>")
    return groups.select("group", F.inline(placed))


def covers(placed: DataFrame, sizes: DataFrame) -> DataFrame:
    """group, x, y, n, dx, dy: each cell of the grids (group, w, h) that is covered, by which item and where in it.

    Items that reach over the grid's edge are cut there; where two overlap, the later one has the cell.
    """
    cell = placed.withColumnsRenamed({"x": "x0", "y": "y0"}).withColumn("dx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bw") - 1)))
    cell = cell.withColumn("dy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bh") - 1)))
    cell = cell.withColumns({"x": F.col("x0") + F.col("dx"), "y": F.col("y0") + F.col("dy")}).join(sizes.select("group", "w", "h"), "group").where("x < w and y < h")
    best = cell.groupBy("group", "x", "y").agg(F.max(F.struct("n", "dx", "dy")).alias("c"))
    return best.select("group", "x", "y", "c.n", "c.dx", "c.dy")
