"""Cropping, orientation, overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def crop(df: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    """The samples inside a region, with coordinates from its corner. The filter reaches the scan where x and y do."""
    inside = F.col("x").between(x, x + width - 1) & F.col("y").between(y, y + height - 1)
    return df.where(inside).withColumn("x", F.col("x") - x).withColumn("y", F.col("y") - y)


def orient(df: DataFrame, code: str, width: str, height: str) -> DataFrame:
    """Moves samples by an orientation code 1 to 8 in column ``code``: a projection, no shuffle.

    2 mirrors, 3 turns half, 4 flips, 5 transposes, 6 turns clockwise, 7 transposes across, 8 turns back.
    """
    x, y, right, bottom = F.col("x"), F.col("y"), F.col(width) - 1 - F.col("x"), F.col(height) - 1 - F.col("y")
    o = F.col(code)
    new_x = F.when(o.isin(2, 3), right).when(o == 5, y).when(o == 6, bottom).when(o == 7, bottom).when(o == 8, y).otherwise(x)
    new_y = F.when(o.isin(3, 4), bottom).when(o == 5, x).when(o == 6, x).when(o == 7, right).when(o == 8, right).otherwise(y)
    return df.withColumn("_x", new_x).withColumn("y", new_y).withColumn("x", F.col("_x")).drop("_x")


def overlapping(many: DataFrame, regions: DataFrame, cell: int = 256) -> DataFrame:
    """Pairs of half-open rectangles that overlap, (id, region): an equi-join on grid cells, each pair found once.

    Both sides are dealt to the cells they touch; a pair is kept in the cell of its overlap's upper left corner.
    """
    def dealt(df: DataFrame, name: str, p: str) -> DataFrame:
        df = df.where("x1 > x0 and y1 > y0").select(F.col(name), *[F.col(c).alias(f"{p}{c}") for c in ("x0", "y0", "x1", "y1")])
        cells = lambda a, b: F.explode(F.sequence(F.expr(f"{p}{a} div {cell}"), F.expr(f"({p}{b} - 1) div {cell}")))
        return df.withColumn("cx", cells("x0", "x1")).withColumn("cy", cells("y0", "y1"))

    met = dealt(many, "id", "a").join(dealt(regions, "region", "b"), ["cx", "cy"])
    touch = (F.col("ax0") < F.col("bx1")) & (F.col("bx0") < F.col("ax1")) & (F.col("ay0") < F.col("by1")) & (F.col("by0") < F.col("ay1"))
    corner_x, corner_y = F.greatest("ax0", "bx0"), F.greatest("ay0", "by0")
    first = (F.col("cx") == F.call_function("div", corner_x, F.lit(cell))) & (F.col("cy") == F.call_function("div", corner_y, F.lit(cell)))
    return met.where(touch & first).select("id", "region")
