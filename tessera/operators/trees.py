"""Decision trees as node tables: (tree, node, property, split, left, right), property -1 for a leaf, node 0 the root.

A sample whose property is above the split goes left, else right.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.scratch import sent, stored

#: The range of a property, and the tallest tree that is valid.
LOWEST, HIGHEST, TALLEST = -(2**31), 2**31 - 1, 2048
#: Nodes of the largest tree that is walked as an array beside each sample; larger ones are walked by joins.
HELD = 1024
#: Nodes of the largest table that goes to every task whole; of larger ones only those that a round can come to go.
SENT = 1_000_000


def ranges(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tree, node, root, height) and (tree, node, property, lower, upper): what a node's ancestors leave of each property.

    Every node points at its parent and holds the one bound that its edge sets. A round lets each node take over the
    bounds of the node it points at, and point where that one points, so the path to the root is covered after as many
    rounds as the binary logarithm of the tree's height. Properties that no ancestor splits have no row.
    """
    opened = nodes.where(F.col("property") >= 0)
    edge = lambda child, low, high: opened.select(
        "tree", F.col(child).alias("node"), F.col("node").alias("to"), "property", low.cast("bigint").alias("lower"), high.cast("bigint").alias("upper")
    )
    edges = stored(edge("left", F.col("split") + 1, F.lit(HIGHEST)).union(edge("right", F.lit(LOWEST), F.col("split"))))
    if not edges.groupBy("tree", "node").count().where("count > 1").isEmpty():
        raise ValueError("a node is the child of two others")
    up = edges.select("tree", "node", "to", F.lit(1).cast("bigint").alias("height"))
    bounds = edges.select("tree", "node", "property", "lower", "upper")
    covered = 1
    while True:
        above = up.select("tree", F.col("node").alias("to"), F.col("to").alias("further"), F.col("height").alias("more"))
        moved = stored(up.join(above, ["tree", "to"], "left"))
        if moved.where("further is not null").isEmpty():
            break
        covered *= 2
        if covered > 2 * TALLEST:
            raise ValueError("a tree is too tall, or its nodes form a ring")
        taken = up.select("tree", F.col("node").alias("below"), F.col("to").alias("node")).join(bounds, ["tree", "node"])
        taken = taken.select("tree", F.col("below").alias("node"), "property", "lower", "upper")
        bounds = stored(bounds.union(taken).groupBy("tree", "node", "property").agg(F.max("lower").alias("lower"), F.min("upper").alias("upper")))
        up = moved.select("tree", "node", F.coalesce("further", "to").alias("to"), (F.col("height") + F.coalesce("more", F.lit(0))).alias("height"))
    roots = nodes.select("tree", "node").join(edges.select("tree", "node"), ["tree", "node"], "left_anti")
    heights = up.select("tree", "node", F.col("to").alias("root"), "height").union(roots.select("tree", "node", "node", F.lit(0).cast("bigint")))
    return heights, bounds


def validated(nodes: DataFrame) -> DataFrame:
    """tree, node, height, lower, upper, valid: whether a node's children exist and its split parts the range it inherits.

    ``lower`` and ``upper`` are that range of the property it splits, null for leaves. Leaves are valid too; a node that
    does not lie below node 0, or lies too deep, is not.
    """
    heights, bounds = ranges(nodes)
    rows = nodes.join(heights, ["tree", "node"]).join(bounds, ["tree", "node", "property"], "left")
    leaf = F.col("property") < 0
    lower, upper = (F.when(~leaf, F.coalesce(c, F.lit(v).cast("bigint"))) for c, v in (("lower", LOWEST), ("upper", HIGHEST)))
    rows = rows.select("tree", "node", "root", "height", "split", "left", "right", leaf.alias("leaf"), lower.alias("lower"), upper.alias("upper"))
    there = nodes.select("tree", F.col("node").alias("child")).withColumn("there", F.lit(True))
    for side in ("left", "right"):
        rows = rows.join(there.withColumnsRenamed({"child": side, "there": f"has_{side}"}), ["tree", side], "left")
    parts = (F.col("lower") <= F.col("split")) & (F.col("split") < F.col("upper"))
    valid = (F.col("root") == 0) & (F.col("height") <= TALLEST) & (F.col("leaf") | (parts & F.col("has_left").isNotNull() & F.col("has_right").isNotNull()))
    return rows.select("tree", "node", "height", "lower", "upper", valid.alias("valid"))


def _by_array(live: DataFrame, nodes: DataFrame, properties: Sequence[str], levels: int) -> DataFrame:
    """``levels`` steps of every sample in one fold over its tree, an array by node; nodes count from 0 without gaps."""
    entry = F.struct("node", "property", "split", "left", "right")
    held = stored(nodes.groupBy("tree").agg(F.array_sort(F.collect_list(entry)).alias("_tree")))
    values = F.array(*[F.col(p).cast("bigint") for p in properties])

    def step(at, _):
        node = F.get("_tree", at.cast("int"))
        to = lambda n: F.when(n["property"] < 0, n["node"]).when(F.get("_values", n["property"].cast("int")) > n["split"], n["left"]).otherwise(n["right"])
        return F.transform(F.array(node), lambda n: to(n).cast("bigint"))[0]

    at = F.aggregate(F.sequence(F.lit(1), F.lit(levels)), F.col("_node"), step)
    moved = live.withColumn("_values", values).join(sent(held, 100), "tree").withColumn("_node", at)
    return moved.withColumn("_leaf", F.get("_tree", F.col("_node").cast("int"))["property"] < 0).drop("_tree", "_values")


def _in_reach(nodes: DataFrame, near: DataFrame, levels: int) -> DataFrame:
    """The nodes that a walk of ``levels`` steps from the nodes (tree, node) of ``near`` can come to; a level is a join."""
    near, found = stored(near), None
    for _ in range(levels):
        found = near if found is None else found.union(near)
        here = nodes.where("property >= 0").join(near, ["tree", "node"])
        near = stored(here.select("tree", F.explode(F.array("left", "right")).alias("node")).where("node is not null").distinct())
    return stored(nodes.join(found.union(near).distinct(), ["tree", "node"]).select("tree", "node", "property", "split", "left", "right"))


def _by_joins(live: DataFrame, nodes: DataFrame, properties: Sequence[str], levels: int) -> DataFrame:
    """``levels`` steps, a join each; the node table is broadcast if its size allows it."""
    table = sent(nodes.select("tree", F.col("node").alias("_node"), "property", "split", "left", "right"))
    values = F.array(*[F.col(p).cast("bigint") for p in properties])
    for _ in range(levels):
        joined = live.join(table, ["tree", "_node"])
        to = F.when(F.col("property") < 0, F.col("_node")).when(F.get(values, F.col("property").cast("int")) > F.col("split"), F.col("left")).otherwise(F.col("right"))
        live = joined.withColumn("_node", to.cast("bigint")).drop("property", "split", "left", "right")
    leaf = table.select("tree", "_node", (F.col("property") < 0).alias("_leaf"))
    return live.join(leaf, ["tree", "_node"])


def leaves(samples: DataFrame, nodes: DataFrame, properties: Sequence[str], held: int = HELD, keep: Sequence[str] | None = None) -> DataFrame:
    """Adds ``leaf``, the leaf of its ``tree`` that each sample reaches; ``properties`` names its properties from 0 on.

    Samples walk in rounds of ever more levels, and those that have reached a leaf leave the walk, so a deep branch costs
    only the samples on it. Each round is stored. Samples of a tree that has no nodes are left out.
    Of the samples' columns ``keep`` stay (all, unless given); the others are not stored once a sample has its leaf.
    """
    keep = list(samples.columns if keep is None else keep)
    nodes = stored(nodes.select("tree", "node", "property", "split", "left", "right"))
    largest, number = nodes.groupBy("tree").count().agg(F.max("count"), F.sum("count")).first()
    largest, number = largest or 0, number or 0
    step, most = (_by_array, 64) if largest <= held else (_by_joins, 16)
    live, levels, walked, done = samples.withColumn("_node", F.lit(0).cast("bigint")), 8, 0, None
    near = nodes.where("node = 0").select("tree", "node")
    while True:
        known = _in_reach(nodes, near, levels) if step is _by_joins and number > SENT else nodes
        moved = step(live, known, properties, levels)
        moved = stored(moved.withColumns({c: F.when(~F.col("_leaf"), F.col(c)) for c in samples.columns if c not in keep}))
        there = moved.where("_leaf").drop("_leaf").select(*keep, F.col("_node").alias("leaf"))
        done = there if done is None else done.union(there)
        live = moved.where("not _leaf").drop("_leaf")
        if live.isEmpty():
            return done
        walked += levels
        if walked > TALLEST:
            raise ValueError("a sample walked further than the tallest valid tree")
        near = live.select("tree", F.col("_node").alias("node")).distinct()
        levels = min(2 * levels, most)
