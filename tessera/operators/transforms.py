"""Inverse transforms of channels and blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.samples import clamp, div, inverse_rct, smooth_tendency
from tessera.operators.gathering import by_groups


def look_up_palette(indices: DataFrame, palette: DataFrame, size: int) -> DataFrame:
    """Colours of an index channel ``idx``: a join with a palette of at most 2**16 entries, so broadcast."""
    known = indices.withColumn("i", clamp("idx", F.lit(0), F.lit(size - 1)).cast("bigint"))
    return known.join(F.broadcast(palette.where(F.col("i") < size)), "i", "left").drop("i")


def named(value, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used; for use inside folds."""
    return F.transform(F.array(value), use)[0]


def folded(items, start, step, out: str, kind: str, chunk: int = 64) -> Column:
    """An ordered fold of an array whose steps each add something to ``out``, an array<``kind``>.

    ``start`` gives the state's fields, {name: (type, first value)}; ``step(state, item)`` is a struct of the new fields
    and ``added``, the array to append. Items are folded in chunks and a chunk's output is appended at once, so that the
    output is not copied at every step.
    """
    fields = ", ".join(f"{n}: {t}" for n, (t, _) in start.items())
    state = f"struct<{fields}, {out}: array<{kind}>>"
    empty = F.array().cast(f"array<{kind}>")
    make = lambda values, done: F.struct(*[v.alias(n) for n, v in values.items()], done.alias(out)).cast(state)

    def one(s, item):
        return named(step(s, item), lambda v: make({n: v[n] for n in start}, F.concat(s[out], v["added"])))

    def many(s, at):
        inner = F.aggregate(F.slice(items, at, F.lit(chunk)), make({n: s[n] for n in start}, empty), one)
        return named(inner, lambda v: make({n: v[n] for n in start}, F.concat(s[out], v[out])))

    starts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), F.lit(chunk))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(starts, make({n: v for n, (_, v) in start.items()}, empty), many)[out]


def unsqueeze(rows: DataFrame, average: str, residual: str, out: str = "samples") -> DataFrame:
    """Undoes a squeeze along rows: arrays of averages and residuals become one of both's lengths.

    Every pair needs the sample before it, so a row is one fold; rows are independent. For columns, gather columns.
    """
    n = F.size(residual)
    pairs = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.struct(
            F.element_at(average, i).cast("bigint").alias("a"),
            F.coalesce(F.try_element_at(average, i + 1), F.element_at(average, i)).cast("bigint").alias("b"),
            F.element_at(residual, i).cast("bigint").alias("r"),
        ),
    )
    rows = rows.withColumn("_pairs", F.when(n > 0, pairs).otherwise(F.array().cast("array<struct<a: bigint, b: bigint, r: bigint>>")))

    def step(s, p):
        # each value is named once: Spark would work out a repeated expression again
        around = F.struct(F.coalesce(s["last"], p["a"]).alias("p"), p["a"].alias("a"), p["b"].alias("n"))
        diff = p["r"] + named(around, lambda v: smooth_tendency(v["p"], v["a"], v["n"]))
        two = named(diff, lambda d: named(p["a"] + div(d, F.lit(2)), lambda first: F.array(first, first - d)))
        return named(two, lambda v: F.struct(v[1].alias("last"), v.alias("added")))

    made = folded(F.col("_pairs"), {"last": ("bigint", F.lit(None).cast("bigint"))}, step, "done", "bigint")
    odd = F.when(F.size(average) > n, F.slice(F.col(average).cast("array<bigint>"), -1, 1)).otherwise(F.array().cast("array<bigint>"))
    whole = F.when(n > 0, F.concat(made, odd)).otherwise(F.col(average).cast("array<bigint>"))
    return rows.withColumn(out, whole).drop("_pairs")


def unsqueeze_prefix(rows: DataFrame, average: str, residual: str, upto: int, out: str = "samples") -> DataFrame:
    """The first ``upto`` samples of ``unsqueeze``, from no more than they need: a pair looks back, and one average ahead."""
    pairs = -(-upto // 2)
    cut = rows.withColumn("_a", F.slice(average, 1, pairs + 1)).withColumn("_r", F.slice(residual, 1, pairs))
    return unsqueeze(cut, "_a", "_r", out).withColumn(out, F.slice(out, 1, upto)).drop("_a", "_r")


def _quotient(a: np.ndarray, b: int) -> np.ndarray:
    return np.where(a < 0, -(-a // b), a // b)


def _slope(p: np.ndarray, a: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``samples.smooth_tendency`` of arrays."""
    fall = _quotient(4 * p - 3 * n - a + 6, 12)
    fall = np.where(fall - (fall & 1) > 2 * (p - a), 2 * (p - a) + 1, fall)
    fall = np.where(fall + (fall & 1) > 2 * (a - n), 2 * (a - n), fall)
    rise = _quotient(4 * p - 3 * n - a - 6, 12)
    rise = np.where(rise + (rise & 1) < 2 * (p - a), 2 * (p - a) - 1, rise)
    rise = np.where(rise - (rise & 1) < 2 * (a - n), 2 * (a - n), rise)
    return np.where((p >= a) & (a >= n), fall, np.where((p <= a) & (a <= n), rise, 0))


def unsqueezed(low: DataFrame, residual: DataFrame, across: bool) -> DataFrame:
    """img, x, y, v: undoes a squeeze of channels in long form (img, x, y, v), along rows (``across``) or columns.

    A line's averages and residuals meet in a task in their order; lines of any number of images are independent, and a
    task goes along many of them at once. A pair without its average is an error; nulls come out where ``unsqueeze`` has them.
    """
    along, line = ("x", "y") if across else ("y", "x")
    number = F.col("v").cast("bigint").alias("v")
    both = low.select("img", line, along, number, F.lit(0).alias("_rest")).union(residual.select("img", line, along, number, F.lit(1)))
    keys = ["img", line]

    def run(part: pa.Table, lines: np.ndarray) -> Iterator[pa.RecordBatch]:
        value, rest = part.column("v").combine_chunks(), part.column("_rest").to_numpy() == 1
        v, known = value.fill_null(0).to_numpy(), value.is_valid().to_numpy(zero_copy_only=False)
        averages, pairs = (np.bincount(lines[some], minlength=lines[-1] + 1) for some in (~rest, rest))
        if (pairs > averages).any():
            raise ValueError("more residuals than averages in a line")
        size = np.where(pairs > 0, 2 * pairs + (averages > pairs), averages)
        first = np.cumsum(averages + pairs) - averages - pairs  # of a line's rows; its averages come first
        begin, out, whole = np.cumsum(size) - size, np.zeros(size.sum(), np.int64), np.zeros(size.sum(), bool)
        for some, at, to in ((pairs == 0, 0, 0), ((pairs > 0) & (averages > pairs), -1, -1)):  # lines without residuals, odd last ones
            which = np.flatnonzero(some)
            if at == 0:
                of = np.repeat(which, averages[which])
                k = np.arange(len(of)) - np.repeat(np.cumsum(averages[which]) - averages[which], averages[which])
                out[begin[of] + k], whole[begin[of] + k] = v[first[of] + k], known[first[of] + k]
            else:
                last = first[which] + averages[which] - 1
                out[begin[which] + size[which] - 1], whole[begin[which] + size[which] - 1] = v[last], known[last]
        p, had = np.zeros(len(size), np.int64), np.zeros(len(size), bool)
        order = np.argsort(-pairs, kind="stable")  # lines that are over leave at the end
        upto = np.searchsorted(-pairs[order], -np.arange(1, pairs.max(initial=0) + 1), side="right")
        for k, many in enumerate(upto):
            on = order[:many]
            at, res = first[on] + k, first[on] + averages[on] + k
            after = np.where((k + 1 < averages[on]) & known[np.minimum(at + 1, len(v) - 1)], at + 1, at)
            a, is_a, r, is_r, n, is_n = v[at], known[at], v[res], known[res], v[after], known[after]
            before, is_p = np.where(had[on], p[on], a), had[on] | is_a
            diff = r + np.where(is_p & is_a & is_n, _slope(before, a, n), 0)
            one = a + _quotient(diff, 2)
            p[on], had[on] = one - diff, is_a & is_r
            for j, new in ((0, one), (1, one - diff)):
                out[begin[on] + 2 * k + j], whole[begin[on] + 2 * k + j] = new, had[on]
        of = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(out)) - begin[of]
        rows = pa.array(first[of])
        yield pa.RecordBatch.from_arrays([*[part.column(c).combine_chunks().take(rows) for c in keys], pa.array(place), pa.array(out, mask=~whole)], ["img", line, along, "v"])

    ordered = both.repartition(*keys).sortWithinPartitions(*keys, "_rest", along, "v")
    types = {f.name: f.dataType.simpleString() for f in both.schema}
    out = ordered.mapInArrow(by_groups(keys, run), f"img {types['img']}, {line} {types[line]}, {along} long, v long")
    return out.select("img", F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"), "v")


def undone(channels: DataFrame, count: int, transforms: list[tuple]) -> DataFrame:
    """img, channel, x, y, v: the image channels left when all transforms of coded channels (same columns) are undone.

    ``transforms`` come in the order they were applied: ("rct", kind, first channel), ("palette", first channel, channels,
    size of the table) or ("squeeze", across, in place, first channel, channels). The last is undone first. A palette puts
    its table (x counts colours, y channels) before all others, and tables are no image channels; ``count`` is how many
    channels are coded. Numbers of channels change as they come and go.
    """
    channels = channels.select("img", "channel", "x", "y", "v")
    at, undo = F.col("channel"), list(transforms)
    while undo:
        kind, *what = undo.pop()
        if kind == "rct":
            number, first = what
            held = channels.where(at.between(first, first + 2)).groupBy("img", "x", "y").agg(*[F.max(F.when(at == first + i, F.col("v"))).alias(f"c{i}") for i in range(3)])
            made = F.posexplode(F.array(*inverse_rct(number, "c0", "c1", "c2"))).alias("channel", "v")
            held = held.select("img", "x", "y", made).select("img", (F.col("channel") + first).cast("bigint").alias("channel"), "x", "y", "v")
            channels = channels.where(~at.between(first, first + 2)).union(held)
        elif kind == "palette":
            first, many, size = what
            # a row a colour: the join's smaller side by far, so it is hashed and samples are not sorted
            colours = [F.max(F.when(F.col("y") == c, F.col("v"))).alias(f"_c{c}") for c in range(many)]
            table = channels.where((at == 0) & F.col("y").between(0, many - 1)).groupBy("img", F.col("x").alias("_i")).agg(*colours, *[F.count_if(F.col("y") == c).alias(f"_n{c}") for c in range(many)])
            index = channels.where(at == first + 1).withColumn("_i", clamp("v", F.lit(0), F.lit(size - 1)).cast("bigint")).drop("v")
            found = index.join(table.hint("shuffle_hash"), ["img", "_i"])
            shown = [F.when(F.col(f"_n{c}") > 0, F.struct(F.lit(first + c).cast("bigint").alias("channel"), F.col(f"_c{c}").alias("v"))) for c in range(many)]
            if many == 3 and undo and undo[-1][0] == "rct" and undo[-1][2] == first:  # its three channels are side by side here
                made = inverse_rct(undo.pop()[1], "_c0", "_c1", "_c2")
                shown = [F.struct(F.lit(first + c).cast("bigint").alias("channel"), v.alias("v")) for c, v in enumerate(made)]
            shown = found.select("img", "x", "y", F.explode(F.array_compact(F.array(*shown))).alias("_s")).select("img", "_s.channel", "x", "y", "_s.v")
            moved = F.when(at > first + 1, at + (many - 2)).otherwise(at - 1)
            channels = channels.where((at > 0) & (at != first + 1)).withColumn("channel", moved).union(shown)
            count += many - 2
        elif kind == "squeeze":
            across, in_place, first, many = what
            lost = first + many if in_place else count - many
            out = channels.where(~at.between(first, first + many - 1) & ~at.between(lost, lost + many - 1))
            out = out.withColumn("channel", F.when(at >= lost + many, at - many).otherwise(at))
            for i in range(many):
                low, rest = (channels.where(at == c).drop("channel") for c in (first + i, lost + i))
                out = out.union(unsqueezed(low, rest, across).select("img", F.lit(first + i).cast("bigint").alias("channel"), "x", "y", "v"))
            channels, count = out, count - many
        else:
            raise ValueError(f"no such transform: {kind}")
    return channels


def inverted(df: DataFrame, transforms: list[tuple]) -> DataFrame:
    """Undoes transforms of channels, the last one first: ("rct", kind, columns) or ("palette", column, table, size)."""
    for kind, *what in reversed(transforms):
        if kind == "rct":
            number, columns = what
            df = df.withColumn("_rct", F.array(*inverse_rct(number, *columns)))
            for i, c in enumerate(columns):
                df = df.withColumn(c, F.col("_rct")[i])
            df = df.drop("_rct")
        elif kind == "palette":
            column, table, size = what
            df = look_up_palette(df.withColumnRenamed(column, "idx"), table, size).drop("idx")
        else:
            raise ValueError(f"no such transform: {kind}")
    return df


def inverse_dct(blocks: DataFrame, size: int = 8) -> DataFrame:
    """Separable inverse cosine transform of blocks (blk, k, v): one join with the size x size table for each axis."""
    spark = blocks.sparkSession
    u, x = F.col("u"), F.col("i")
    scale = F.when(u == 0, F.lit(math.sqrt(1 / size))).otherwise(F.lit(math.sqrt(2 / size)))
    basis = spark.range(size * size).select(F.expr(f"id div {size}").alias("u"), (F.col("id") % size).alias("i"))
    basis = F.broadcast(basis.withColumn("w", scale * F.cos((2 * x + 1) * u * F.lit(math.pi / (2 * size)))))
    rows = blocks.select("blk", F.expr(f"k div {size}").alias("r"), (F.col("k") % size).alias("u"), "v")
    rows = rows.join(basis, "u").groupBy("blk", "r", "i").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    rows = rows.select("blk", F.col("r").alias("u"), F.col("i").alias("x"), "v")
    out = rows.join(basis, "u").groupBy("blk", F.col("i").alias("y"), "x").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return out.select("blk", "x", "y", "v")


def haar_matrix(size: int = 8) -> list[list[tuple[int, int]]]:
    """For every output of the 2 x 2 cascade which coefficients it adds (+1) or takes away (-1).

    The cascade is linear, so it is applied to symbols once here and becomes a sum for each output.
    """
    block = [{k: 1} for k in range(size * size)]
    half = 1
    while half < size:
        new = dict(enumerate(block))
        for y in range(half):
            for x in range(half):
                parts = [block[y * size + x], block[y * size + half + x], block[(y + half) * size + x], block[(y + half) * size + half + x]]
                for dy in (0, 1):
                    for dx in (0, 1):
                        signs = (1, -1 if dy else 1, -1 if dx else 1, -1 if dx != dy else 1)
                        total: dict[int, int] = {}
                        for sign, part in zip(signs, parts):
                            for k, w in part.items():
                                total[k] = total.get(k, 0) + sign * w
                        new[(2 * y + dy) * size + 2 * x + dx] = total
        block = [new[k] for k in range(size * size)]
        half *= 2
    return [sorted(b.items()) for b in block]


def inverse_haar(blocks: DataFrame, size: int = 8) -> DataFrame:
    """Inverse of the 2 x 2 cascade on blocks (blk, k, v): each coefficient goes to the outputs it is part of."""
    spark = blocks.sparkSession
    rows = [(k, o, w) for o, parts in enumerate(haar_matrix(size)) for k, w in parts if w]
    text = ",".join(f"({k},{o},{w})" for k, o, w in rows)  # size**2 * (log2(size) * 3 + 1) entries, from the rule
    basis = F.broadcast(spark.sql(f"SELECT * FROM VALUES {text} AS t(k, o, w)"))
    out = blocks.join(basis, "k").groupBy("blk", "o").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return out.select("blk", (F.col("o") % size).cast("bigint").alias("x"), F.expr(f"o div {size}").alias("y"), "v")
