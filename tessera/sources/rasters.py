"""Rasters lifted from the star-schema tables, in long form: one row a sample, every order an explicit column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str, width: int = 16) -> DataFrame:
    """img, x, y, c0, c1, c2 (bigint): an image a supplier, ``width`` samples a row, the last row partly filled."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    n = F.row_number().over(W.partitionBy("l_suppkey").orderBy(*order)) - 1
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("img"), n.cast("bigint").alias("n"),
        F.col("l_quantity").cast("bigint").alias("c0"), F.col("l_linenumber").cast("bigint").alias("c1"),
        (F.floor("l_extendedprice") % 256).cast("bigint").alias("c2"),
    )
    return rows.select("img", (F.col("n") % width).alias("x"), F.expr(f"n div {width}").alias("y"), "c0", "c1", "c2")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """blk, k, v: an 8 x 8 block of coefficients an embedding, k from 0 to 63 row by row."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("blk"), F.posexplode("embedding").alias("k", "v"))
    return rows.select("blk", F.col("k").cast("bigint").alias("k"), F.col("v").cast("double").alias("v"))


def large_blocks(spark: SparkSession, sf_dir: str, cells: dict[int, int]) -> DataFrame:
    """blk, strategy, k, v: for each strategy blocks of as many 8 x 8 cells as it has, of consecutive embeddings.

    Embeddings that are left over at the end make no block.
    """
    kinds = F.explode(F.array(*[F.struct(F.lit(s).cast("bigint").alias("strategy"), F.lit(n).cast("bigint").alias("cells")) for s, n in cells.items()]))
    rows = blocks(spark, sf_dir).select("*", kinds.alias("kind")).select("blk", "k", "v", "kind.strategy", "kind.cells")
    rows = rows.select(F.expr("blk div cells").alias("blk"), "strategy", (F.col("blk") % F.col("cells") * 64 + F.col("k")).alias("k"), "v", "cells")
    whole = F.count("*").over(W.partitionBy("strategy", "blk")) == 64 * F.col("cells")
    return rows.withColumn("whole", whole).where("whole").select("blk", "strategy", "k", "v")


def animation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img, frame, colour, alpha: one sample of an animation an event, an image a user."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("img"), F.col("event_id").alias("frame"), (F.col("event_id") * 37 % 256).alias("colour"),
        (F.round(F.col("value") * 100).cast("bigint") % 256).alias("alpha"),
    )


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, idx, size: the sections of a frame in file order."""
    idx = F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("frame"), idx.cast("bigint").alias("idx"), F.round(F.col("value") * 100).cast("bigint").alias("size"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, w, h: frame sizes from 1 to 3000 and 1 to 2000."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("frame"), (k * 131 % 3000 + 1).alias("w"), (k * 71 % 2000 + 1).alias("h"))


def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x0, y0, x1, y1: half-open rectangles on a 4096 x 4096 plane."""
    k = F.col("o_orderkey")
    r = table(spark, sf_dir, "orders").select(k.alias("id"), (k * 97 % 4000).alias("x0"), (k * 61 % 4000).alias("y0"), (k % 90 + 1).alias("w"), (k % 70 + 1).alias("h"))
    return r.select("id", "x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("h")).alias("y1"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region, x0, y0, x1, y1: one region of interest a nation."""
    k = F.col("n_nationkey").cast("bigint")
    return table(spark, sf_dir, "nation").select(k.alias("region"), (k * 150).alias("x0"), (k * 130).alias("y0"), (k * 150 + 400).alias("x1"), (k * 130 + 300).alias("y1"))


def palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i, r, g, b: a colour for every part size, of the first part with it."""
    first = table(spark, sf_dir, "part").groupBy((F.col("p_size").cast("bigint") - 1).alias("i")).agg(F.min("p_partkey").alias("k"))
    return first.select("i", (F.col("k") % 256).alias("r"), (F.col("k") * 7 % 256).alias("g"), (F.col("k") * 13 % 256).alias("b"))


def name_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, pos, byte: the UTF-8 bytes of every part's name, position from 0."""
    name = F.col("p_name").cast("binary")
    pos = F.explode(F.sequence(F.lit(0), F.octet_length("p_name") - 1)).alias("pos")
    rows = table(spark, sf_dir, "part").where("octet_length(p_name) > 0").select(F.col("p_partkey").alias("id"), name.alias("name"), pos)
    byte = F.conv(F.hex(F.expr("substring(name, pos + 1, 1)")), 16, 10).cast("bigint")
    return rows.select("id", F.col("pos").cast("bigint").alias("pos"), byte.alias("byte"))


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tree, node, property, split, left, right, predictor: five decision trees over the parts, node 0 the root.

    Odd nodes, the root and some others split as long as there are nodes left; the k-th that splits gets the nodes 2 k + 1
    and 2 k + 2. Few branches go on on both sides, so the trees are tall.
    """
    part = table(spark, sf_dir, "part")
    rows = part.select(((F.col("p_partkey") - 1) % 5).alias("tree"), F.expr("(p_partkey - 1) div 5").alias("node"), "p_size", "p_partkey", F.floor("p_retailprice").alias("price"))
    rows = rows.withColumn("opens", (F.col("node") % 2 == 1) | (F.col("node") == 0) | (F.col("p_size") % 5 == 0))
    k = F.row_number().over(W.partitionBy("tree", "opens").orderBy("node")).cast("bigint") - 1
    rows = rows.withColumn("k", k).withColumn("n", F.count("*").over(W.partitionBy("tree")))
    rows = rows.withColumn("splits", F.col("opens") & (2 * F.col("k") + 2 < F.col("n")))
    splits, pairs = F.col("splits"), F.count_if("splits").over(W.partitionBy("tree"))
    return rows.withColumn("pairs", pairs).where("node <= 2 * pairs").select(
        "tree", "node", F.when(splits, 2 + F.col("p_size") % 13).otherwise(-1).cast("bigint").alias("property"), (F.col("price") % 60 - 20).cast("bigint").alias("split"),
        F.when(splits, 2 * F.col("k") + 1).alias("left"), F.when(splits, 2 * F.col("k") + 2).alias("right"), (F.col("p_partkey") % 14).alias("predictor"),
    )


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream, idx, literal, distance, length: a token an event, every third a literal, the others copies."""
    k = F.col("event_id")
    literal = F.when(k % 3 == 0, k * 37 % 256)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), k.alias("idx"), literal.alias("literal"), (k * 7 % 23 + 1).alias("distance"), (k % 9).alias("length"))


def distributions(spark: SparkSession, sf_dir: str, total: int = 4096) -> DataFrame:
    """dist, entry, count: how a supplier's line quantities are spread, scaled to add up to ``total``."""
    line = table(spark, sf_dir, "lineitem")
    n = line.groupBy(F.col("l_suppkey").alias("dist"), (F.col("l_quantity").cast("bigint") - 1).alias("entry")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy("dist").orderBy("entry"))
    share = lambda c: F.expr(f"{c} * {total} div sum")
    rows = n.withColumn("upto", upto).withColumn("sum", F.sum("n").over(W.partitionBy("dist")))
    return rows.select("dist", "entry", (share("upto") - share("(upto - n)")).alias("count"))


def curve_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spline, i, x, y: a control point an order, a spline a customer."""
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("spline"), F.col("o_orderkey").alias("i"), ((price + F.col("o_orderkey")) % 13.0).alias("x"), (price * 7.0 % 11.0).alias("y"))


def placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """group, w, h, items: a grid a user, and a transform of 1 to 4 cells a side for each of the user's events."""
    sizes = F.array(*[F.struct(F.lit(w).cast("bigint").alias("bw"), F.lit(h).cast("bigint").alias("bh")) for w, h in ((1, 1), (2, 2), (1, 2), (2, 1), (4, 4), (1, 4), (4, 1), (2, 4), (4, 2))])
    item = F.struct("event_id", F.element_at(sizes, (F.col("event_id") % 9 + 1).cast("int")).alias("size"))
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("group")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    rows = rows.withColumn("w", 4 + F.col("group") % 5)
    return rows.select("group", "w", F.expr("size(items) div w").alias("h"), F.col("items.size").alias("items"))


def channel_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """plan, channels: three channels of an order's frame, and a fourth of half the size for every other order."""
    rows = frames(spark, sf_dir).withColumn("n", 3 + F.col("frame") % 2)
    half = lambda c: F.expr(f"({c} + (1 << (k div 3)) - 1) div (1 << (k div 3))")
    rows = rows.withColumn("k", F.explode(F.expr("sequence(0L, n - 1)")))
    one = F.struct("k", F.struct(half("w").cast("bigint").alias("w"), half("h").cast("bigint").alias("h"), F.expr("k div 3").alias("hs"), F.expr("k div 3").alias("vs"), F.col("k").alias("component")).alias("c"))
    return rows.groupBy(F.col("frame").alias("plan")).agg(F.array_sort(F.collect_list(one)).alias("c")).select("plan", F.col("c.c").alias("channels"))


def transform_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """plan, step, kind, begin, num, colours, deltas, squeezes: a transform a line of the order."""
    line, p, s = table(spark, sf_dir, "lineitem"), F.col("l_partkey"), F.col("l_suppkey")
    step = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    kind = F.element_at(F.array(*map(F.lit, ("rct", "palette", "squeeze"))), (p % 3 + 1).cast("int"))
    begin, num = s % 3, 1 + p * 7 % 3
    squeeze = F.struct((p % 2 == 0).alias("across"), (s % 2 == 0).alias("in_place"), begin.alias("begin"), num.alias("num"))
    squeezes = F.when(F.col("l_quantity") > 25, F.array(squeeze)).otherwise(F.array().cast("array<struct<across: boolean, in_place: boolean, begin: bigint, num: bigint>>"))
    return line.select(F.col("l_orderkey").alias("plan"), step.cast("bigint").alias("step"), kind.alias("kind"), begin.alias("begin"), num.alias("num"), (p % 50 + 1).alias("colours"), (s % 4).alias("deltas"), squeezes.alias("squeezes"))


def rectangles_of_frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Canvases of 20 x 15 (img, w, h), one a nation; a supplier's frame (img, frame, x0, y0, whole) and its pixels."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("bigint").alias("img"), k.alias("frame"), (k % 23 - 6).alias("x0"), (k % 17 - 4).alias("y0"), (k % 4 == 0).alias("whole"), (k % 11 + 3).alias("pw"), (k % 7 + 2).alias("ph"))
    pixels = rows.withColumn("px", F.explode(F.expr("sequence(0L, pw - 1)"))).withColumn("py", F.explode(F.expr("sequence(0L, ph - 1)")))
    base = F.col("frame") * 37 + F.col("px") * 11 + F.col("py") * 5
    pixels = pixels.select("img", "frame", "px", "py", *[(base * m % 256).alias(c) for c, m in zip("rgba", (1, 3, 7, 13))])
    sizes = rows.select("img").distinct().select("img", F.lit(20).cast("bigint").alias("w"), F.lit(15).cast("bigint").alias("h"))
    return sizes, rows.select("img", "frame", "x0", "y0", "whole"), pixels


def noise_groups(spark: SparkSession, sf_dir: str, dim: int = 16) -> DataFrame:
    """img, grp, x, y, gw, gh: the groups of a supplier's small image."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k.alias("img"), (17 + k % 30).alias("w"), (5 + k % 19).alias("h"))
    for axis, size in (("x", "w"), ("y", "h")):
        rows = rows.withColumn(axis, F.explode(F.expr(f"sequence(0L, {size} - 1, {dim}L)")))
    grp = F.expr(f"y div {dim} * ((w + {dim - 1}) div {dim}) + x div {dim}")
    return rows.select("img", grp.alias("grp"), "x", "y", F.least(F.lit(dim), F.col("w") - F.col("x")).alias("gw"), F.least(F.lit(dim), F.col("h") - F.col("y")).alias("gh"))
