"""Animations whose frames are rectangles laid on a canvas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.samples import blend, blend_alpha
from tessera.operators.assembly import grid
from tessera.operators.transforms import folded, named

COLOURS = ("r", "g", "b")


def placed(sizes: DataFrame, frames: DataFrame, pixels: DataFrame) -> DataFrame:
    """img, frame, whole, x, y, r, g, b, a: the pixels (px, py in their frame) that fall on the canvas, at their places there.

    ``whole`` frames replace what is below them, others are blended over it.
    """
    rows = pixels.join(frames.select("img", "frame", "x0", "y0", "whole"), ["img", "frame"]).join(sizes.select("img", "w", "h"), "img")
    rows = rows.withColumns({"x": F.col("x0") + F.col("px"), "y": F.col("y0") + F.col("py")})
    return rows.where("x >= 0 and x < w and y >= 0 and y < h").select("img", "frame", "whole", "x", "y", *COLOURS, "a")


def layered(pixels: DataFrame) -> DataFrame:
    """img, x, y, frame, r, g, b, a: a cell's colour after each frame that touches it.

    A replacing frame needs nothing from below, so a cell's layers are folded from one such frame to the next.
    """
    cell = ["img", "x", "y"]
    upto = W.partitionBy(*cell).orderBy("frame").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = pixels.withColumn("_from", F.max(F.when(F.col("whole"), F.col("frame"))).over(upto))
    steps = rows.groupBy(*cell, "_from").agg(F.array_sort(F.collect_list(F.struct("frame", "whole", *COLOURS, "a"))).alias("steps"))
    clear = ("bigint", F.lit(0).cast("bigint"))

    def lay(below, s):
        shown = [F.when(s["whole"], s[c]).otherwise(blend(s[c], below[c], s["a"])).cast("bigint").alias(c) for c in COLOURS]
        alpha = F.when(s["whole"], s["a"]).otherwise(blend_alpha(s["a"], below["a"])).cast("bigint").alias("a")
        made = F.struct(s["frame"].alias("frame"), *shown, alpha)
        return named(made, lambda v: F.struct(*[v[c].alias(c) for c in (*COLOURS, "a")], F.array(v).alias("added")))

    kind = "struct<frame: bigint, r: bigint, g: bigint, b: bigint, a: bigint>"
    return steps.select(*cell, F.inline(folded(F.col("steps"), {c: clear for c in (*COLOURS, "a")}, lay, "shown", kind)))


def canvases(sizes: DataFrame, frames: DataFrame, pixels: DataFrame) -> DataFrame:
    """img, frame, x, y, r, g, b, a: the whole canvas (img, w, h) after every frame.

    Cells change only where a frame touches them; every other frame reads the last change before it. Cells that no frame
    has touched yet are clear.
    """
    changes = layered(placed(sizes, frames, pixels)).select("img", "x", "y", "frame", F.struct(*COLOURS, "a").alias("c"))
    cells = grid(sizes).select("img", F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"))
    every = cells.join(frames.select("img", "frame"), "img").join(changes, ["img", "x", "y", "frame"], "left")
    since = W.partitionBy("img", "x", "y").orderBy("frame").rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = every.withColumn("c", F.last("c", ignorenulls=True).over(since))
    return seen.select("img", "frame", "x", "y", *[F.coalesce(f"c.{c}", F.lit(0).cast("bigint")).alias(c) for c in (*COLOURS, "a")])
