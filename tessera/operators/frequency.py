"""Blocks of coefficients: weights and orders from rules, dequantisation, inverse transforms by strategy.

Blocks are long tables (blk, k, v), k counting a block's coefficients row by row. Transforms are joins with tables of
basis values, whose size depends on the transform alone, so they are broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.samples import col, div, quant_bias
from tessera.operators.gathering import by_groups
from tessera.operators.transforms import haar_matrix

# Width, height and kind of the transforms by strategy number.
STRATEGIES = [
    (8, 8, "dct"), (8, 8, "identity"), (8, 8, "haar"), (8, 8, "dct4x4"), (16, 16, "dct"), (32, 32, "dct"), (8, 16, "dct"), (16, 8, "dct"),
    (8, 32, "dct"), (32, 8, "dct"), (16, 32, "dct"), (32, 16, "dct"), (8, 8, "dct4x8"), (8, 8, "dct8x4"), (8, 8, "corner0"), (8, 8, "corner1"),
    (8, 8, "corner2"), (8, 8, "corner3"), (64, 64, "dct"), (32, 64, "dct"), (64, 32, "dct"), (128, 128, "dct"), (64, 128, "dct"), (128, 64, "dct"),
    (256, 256, "dct"), (128, 256, "dct"), (256, 128, "dct"),
]
# Default bands of the weights of 8 x 8 and 8 x 4 blocks for each channel, the biases of quantised values, and the
# default quantisation of DC.
BANDS8 = [[3150.0, 0.0, -0.4, -0.4, -0.4, -2.0], [560.0, 0.0, -0.3, -0.3, -0.3, -0.3], [512.0, -2.0, -1.0, 0.0, -1.0, -2.0]]
BANDS4X8 = [[2198.0505, -0.96269625, -0.7619425, -0.65511405], [764.36554, -0.926302, -0.9675229, -0.2784529], [527.10754, -1.4594386, -1.4500821, -1.5843723]]
# Weights of the other transforms: bands by strategy, the three numbers of the identity, the six of the 2 x 2 cascade.
BANDS = {
    (0,): BANDS8,
    (3,): [[2200.0, 0.0, 0.0, 0.0], [392.0, 0.0, 0.0, 0.0], [112.0, -0.25, -0.25, -0.5]],
    (4,): [
        [8996.872, -1.3000777, -0.4942453, -0.43909377, -0.6350102, -0.9017726, -1.6162099],
        [3191.4836, -0.67424583, -0.80745816, -0.44925836, -0.3586544, -0.3132239, -0.37615025],
        [1157.504, -2.0531423, -1.4, -0.5068713, -0.4270873, -1.4856834, -4.920914],
    ],
    (6, 7): [
        [7240.7734, -0.7, -0.7, -0.2, -0.2, -0.2, -0.5],
        [1448.1547, -0.5, -0.5, -0.5, -0.2, -0.2, -0.2],
        [506.85413, -1.4, -0.2, -0.5, -0.5, -1.5, -3.6],
    ],
    (12, 13): BANDS4X8,
}
IDENTITY_WEIGHTS = [[280.0, 3160.0, 3160.0], [60.0, 864.0, 864.0], [18.0, 200.0, 200.0]]
HAAR_WEIGHTS = [[3840.0, 2560.0, 1280.0, 640.0, 480.0, 300.0], [960.0, 640.0, 320.0, 180.0, 140.0, 120.0], [640.0, 320.0, 128.0, 64.0, 32.0, 16.0]]
BIASES = (1 - 0.05465007330715401, 1 - 0.07005449891748593, 1 - 0.049935103337343655, 0.145)
DC_QUANT = (1 / 4096, 1 / 512, 1 / 256)


def strategies(spark: SparkSession) -> DataFrame:
    """strategy, width, height, kind: 27 rows."""
    rows = [(i, w, h, kind) for i, (w, h, kind) in enumerate(STRATEGIES)]
    return spark.createDataFrame(rows, "strategy long, width long, height long, kind string")


def band_weights(spark: SparkSession, width: int, height: int, bands: Sequence[float], out: str = "weight") -> DataFrame:
    """k and the weight of each coefficient: bands over the distance from the corner, interpolated geometrically.

    The first band is a value, each of the others a step: positive s multiplies by 1 + s, others by 1 / (1 - s).
    """
    values = [float(bands[0])]
    for s in bands[1:]:
        values.append(values[-1] * (1 + s if s > 0 else 1 / (1 - s)))
    k = F.col("k")
    axis = lambda v, n: v / F.lit(float(max(n - 1, 1)))
    x, y = axis(k % width, width), axis(div(k, F.lit(width)), height)
    far = F.sqrt(x * x + y * y) * ((len(values) - 1) / (math.sqrt(2) + 1e-6))
    at = F.floor(far).cast("int")
    table = F.array(*[F.lit(v) for v in values])
    low, high = F.element_at(table, F.least(at + 1, F.lit(len(values)))), F.element_at(table, F.least(at + 2, F.lit(len(values))))
    value = F.when(at + 1 >= len(values), F.lit(values[-1])).otherwise(low * F.pow(high / low, far - at))
    return spark.range(width * height).withColumnRenamed("id", "k").withColumn(out, value)


def coefficient_order(spark: SparkSession, width: int, height: int) -> DataFrame:
    """place, k: the natural order of a width x height transform, the coefficients that DC gives first, then diagonals.

    The longer side lies across. Diagonals are those of a square: rows of a flat block stand for several. Every other
    one runs backwards.
    """
    across, down = max(width, height) // 8, min(width, height) // 8
    step = across // down
    x, y = F.col("k") % (across * 8), div("k", F.lit(across * 8))
    diagonal = x + y * step
    first = (x < across) & (y < down)
    key = [F.when(first, y * across + x).otherwise(F.lit(1 << 40)), diagonal, F.when(diagonal % 2 == 0, x).otherwise(-x)]
    rows = spark.range(width * height).withColumnRenamed("id", "k")
    # one window over a table of at most 65,536 rows that depends on the transform alone
    return rows.withColumn("place", (F.row_number().over(W.orderBy(*key)) - 1).cast("bigint"))


def dequantised(q, channel: int, weight, quant, global_scale: float, matrix_scale: int = 2) -> Column:
    """A quantised AC coefficient as a number: biased, over its weight and the block's quantiser.

    ``matrix_scale`` of the first and last channel scales by 0.8 for each step above 2.
    """
    scale = F.lit(global_scale) * F.lit(0.8 ** (matrix_scale - 2) if channel != 1 else 1.0) / col(quant)
    return quant_bias(q, BIASES[channel], BIASES[3]) / col(weight) * scale


def correlation(factor, base: float, colour_factor: float = 84.0) -> Column:
    """How much of the middle channel belongs to another: the base and a part of the tile's factor."""
    return F.lit(base) + col(factor) / F.lit(colour_factor)


def dc_values(x, y, b, inverse_quant: float, factors: tuple[float, float], extra_bits=0, quant: Sequence[float] = DC_QUANT) -> list[Column]:
    """Three DC channels of quantised ones; the outer two get their part of the middle one (no chroma subsampling)."""
    scale = F.lit(inverse_quant) / F.pow(F.lit(2.0), col(extra_bits))
    x, y, b = (col(v) * F.lit(float(q)) * scale for v, q in zip((x, y, b), quant))
    return [x + y * F.lit(factors[0]), y, b + y * F.lit(factors[1])]


def _basis(spark: SparkSession, size: int, names: tuple[str, str, str]) -> DataFrame:
    """(frequency, place, weight): cosines, the constant one by 1 / sqrt 2; size * size rows, so broadcast."""
    u, i = div("id", F.lit(size)), F.col("id") % size
    w = F.cos((2 * i + 1) * u * F.lit(math.pi / (2 * size))) * F.when(u == 0, F.lit(math.sqrt(0.5))).otherwise(F.lit(1.0))
    return F.broadcast(spark.range(size * size).select(u.alias(names[0]), i.alias(names[1]), w.alias(names[2])))


def inverse_rect(blocks: DataFrame, keys: Sequence[str], width: int, height: int, scale: float) -> DataFrame:
    """keys, x, y, v: the inverse cosine transform of (keys, k, v), times ``scale``; one join and sum for each axis."""
    spark = blocks.sparkSession
    rows = blocks.select(*keys, div("k", F.lit(width)).alias("_v"), (F.col("k") % width).alias("_u"), "v")
    rows = rows.join(_basis(spark, width, ("_u", "x", "_w")), "_u").groupBy(*keys, "_v", "x").agg(F.sum(F.col("v") * F.col("_w")).alias("v"))
    rows = rows.join(_basis(spark, height, ("_v", "y", "_w")), "_v").groupBy(*keys, "x", "y").agg(F.sum(F.col("v") * F.col("_w")).alias("v"))
    return rows.withColumn("v", F.col("v") * F.lit(scale))


def forward_rect(samples: DataFrame, keys: Sequence[str], width: int, height: int) -> DataFrame:
    """keys, k, v: the cosine transform of samples (keys, x, y, v), scaled so that a constant is its own first coefficient."""
    spark = samples.sparkSession
    rows = samples.join(_basis(spark, width, ("_u", "x", "_w")), "x").groupBy(*keys, "_u", "y").agg(F.sum(F.col("v") * F.col("_w")).alias("v"))
    rows = rows.join(_basis(spark, height, ("_v", "y", "_w")), "y").groupBy(*keys, "_u", "_v").agg(F.sum(F.col("v") * F.col("_w")).alias("v"))
    return rows.select(*keys, (F.col("_v") * width + F.col("_u")).alias("k"), (F.col("v") * (2.0 / (width * height))).alias("v"))


def _resample(index, size: int) -> Column:
    """What a coefficient of ``size`` DC values is to be scaled by in a transform eight times as long."""
    angle = col(index) * F.lit(math.pi / (8 * size))
    return 1 / (F.cos(angle / 2) * F.cos(angle) * F.cos(angle * 2))


def lowest_from_dc(dc: DataFrame, keys: Sequence[str], width: int, height: int) -> DataFrame:
    """keys, k, v: the lowest coefficients of a transform that covers width x height DC values (keys, x, y, v)."""
    lf = forward_rect(dc, keys, width, height)
    u, v = F.col("k") % width, div("k", F.lit(width))
    return lf.select(*keys, (v * (width * 8) + u).alias("k"), (F.col("v") * _resample(u, width) * _resample(v, height)).alias("v"))


def _cosines(size: int) -> np.ndarray:
    """(frequency, place): cosines, the constant one by 1 / sqrt 2."""
    u, i = np.arange(size)[:, None], np.arange(size)[None, :]
    return np.cos((2 * i + 1) * u * math.pi / (2 * size)) * np.where(u == 0, math.sqrt(0.5), 1.0)


def _inverse(width: int, height: int) -> np.ndarray:
    """(sample, coefficient), both row by row, of the inverse transform that keeps a constant as it is."""
    return 2.0 * np.kron(_cosines(height).T, _cosines(width).T)


def _interleaved(across: int, down: int) -> list[np.ndarray]:
    """For each of across * down smaller blocks which coefficients of an 8 x 8 block it is made of, (its own, 64).

    They lie interleaved; the first ones are sums and differences (a Hadamard transform) of the interleaved first ones.
    """
    n, out = across * down, []
    # block 1 of four is to the right in space, but its coefficient stands for a change downwards
    flips = lambda a, b: (a >> 1 & b & 1) + (a & b >> 1 & 1) if n == 4 else a & b
    for s in range(n):
        y, x = divmod(s, across)
        part = np.zeros((64 // n, 64))
        for k in range(1, 64 // n):
            r, c = divmod(k, 8 // across)
            part[k, (r * down + y) * 8 + c * across + x] = 1
        for t in range(n):
            part[0, t // across * 8 + t % across] = -1 if flips(s, t) & 1 else 1
        out.append(part)
    return out


def _corner(number: int, basis: np.ndarray) -> np.ndarray:
    """A block whose one corner of 4 x 4 has a ``basis`` (coefficient, sample) of its own, beside a 4 x 4 and an 8 x 4 transform."""
    right, low = number % 2, number // 2
    own, beside, rest = np.zeros((16, 64)), np.zeros((16, 64)), np.zeros((32, 64))
    for k in range(1, 16):
        y, x = divmod(k, 4)
        own[k, 16 * y + 2 * x], beside[k, 16 * y + 2 * x + 1] = 1, 1
    for k in range(1, 32):
        rest[k, 8 * (2 * (k // 8) + 1) + k % 8] = 1
    own[0, [0, 1, 8]] = 4
    beside[0, [0, 8, 1]] = 1, 1, -1
    rest[0, [0, 8]] = 1, -1
    out = np.zeros((8, 8, 64))
    shown = (basis.T @ own).reshape(4, 4, 64)[:: -1 if low else 1, :: -1 if right else 1]
    out[4 * low : 4 * low + 4, 4 * right : 4 * right + 4] = shown
    out[4 * low : 4 * low + 4, 4 - 4 * right : 8 - 4 * right] = (_inverse(4, 4) @ beside).reshape(4, 4, 64)
    out[4 - 4 * low : 8 - 4 * low] = (_inverse(8, 4) @ rest).reshape(4, 8, 64)
    return out.reshape(64, 64)


def matrix(kind: str, corner_basis: np.ndarray | None = None) -> np.ndarray:
    """(sample, coefficient), both row by row, of a transform of 8 x 8 blocks: all of them are linear.

    Corner transforms take the 16 x 16 ``corner_basis`` (coefficient, sample) of the format.
    """
    if kind == "dct":
        return _inverse(8, 8)
    if kind == "haar":
        out = np.zeros((64, 64))
        for sample, parts in enumerate(haar_matrix()):
            for k, w in parts:
                out[sample, k] = w
        return out
    if kind.startswith("corner"):
        if corner_basis is None:
            raise ValueError("corner transforms need a basis")
        return _corner(int(kind[-1]), np.asarray(corner_basis, float))
    out = np.zeros((8, 8, 64))
    if kind == "dct4x8":
        for s, part in enumerate(_interleaved(1, 2)):
            out[4 * s : 4 * s + 4] = (_inverse(8, 4) @ part).reshape(4, 8, 64)
    elif kind == "dct8x4":
        for s, part in enumerate(_interleaved(1, 2)):
            out[:, 4 * s : 4 * s + 4] = (_inverse(8, 4) @ part).reshape(4, 8, 64).swapaxes(0, 1)
    elif kind in ("dct4x4", "identity"):
        for s, part in enumerate(_interleaved(2, 2)):
            if kind == "dct4x4":
                small = _inverse(4, 4) @ part
            else:  # samples themselves, less their mean; the coefficient at (1, 1) is the sample at (0, 0), and there is the anchor
                anchor = part[0] - part[1:].sum(axis=0) / 16
                small = part + anchor
                small[0], small[5] = part[5] + anchor, anchor
            y, x = divmod(s, 2)
            out[4 * y : 4 * y + 4, 4 * x : 4 * x + 4] = small.reshape(4, 4, 64)
    else:
        raise ValueError(f"no such transform: {kind}")
    return out.reshape(64, 64)


def _by_matrix(blocks: DataFrame, keys: Sequence[str], matrices: dict[int, np.ndarray]) -> DataFrame:
    """keys, x, y, v of 8 x 8 blocks (keys with strategy, k, v): one join with the strategies' matrices, one sum."""
    rows = [(s, k, o, float(m[o, k])) for s, m in matrices.items() for o, k in np.argwhere(m).tolist()]
    table = blocks.sparkSession.createDataFrame(rows, "strategy long, k long, _o long, _w double")  # 4096 rows a strategy at most
    out = blocks.join(F.broadcast(table), ["strategy", "k"]).groupBy(*keys, "_o").agg(F.sum(F.col("v") * F.col("_w")).alias("v"))
    return out.select(*keys, (F.col("_o") % 8).alias("x"), div("_o", F.lit(8)).alias("y"), "v")


def inverse_small(blocks: DataFrame, kind: str) -> DataFrame:
    """blk, x, y, v of 8 x 8 blocks (blk, k, v) made of smaller transforms: dct4x4, dct4x8, dct8x4 or identity."""
    return _by_matrix(blocks.withColumn("strategy", F.lit(0).cast("bigint")), ["blk"], {0: matrix(kind)})


def _block_samples(part: pa.Table, block: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The samples of whole blocks (blk, strategy, width, height, k, v), those of one size at once.

    Coefficients of one place add up, nulls count nothing, and a block of nulls alone has null samples.
    """
    width, height, k = (part.column(c).to_numpy() for c in ("width", "height", "k"))
    value = part.column("v").combine_chunks()
    v, known = value.fill_null(0.0).to_numpy(), value.is_valid().to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    some_known = np.logical_or.reduceat(known, first)
    block = block - block[0]
    for w, h in np.unique(np.stack([width[first], height[first]], axis=1), axis=0).tolist():
        mine = (width[first] == w) & (height[first] == h)
        blocks = np.flatnonzero(mine)
        at = np.flatnonzero(mine[block])
        at = at[(k[at] >= 0) & (k[at] < w * h)]
        held = np.zeros((len(blocks), h * w))
        np.add.at(held, ((np.cumsum(mine) - 1)[block[at]], k[at]), v[at])
        across, down = _cosines(w), _cosines(h).T
        for start in range(0, len(blocks), max(1, (1 << 18) // (w * h))):
            some = blocks[start : start + max(1, (1 << 18) // (w * h))]
            made = 2 * (down @ (held[start : start + len(some)].reshape(-1, h, w) @ across))
            of = pa.array(np.repeat(first[some], w * h))
            place = np.tile(np.arange(w * h), len(some))
            lost = np.repeat(~some_known[some], w * h)
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c).combine_chunks().take(of) for c in ("blk", "strategy")], pa.array(place % w), pa.array(place // w), pa.array(made.reshape(-1), mask=lost)],
                ["blk", "strategy", "x", "y", "v"],
            )


def spatial(blocks: DataFrame, corner_basis: np.ndarray | None = None) -> DataFrame:
    """blk, strategy, x, y, v: blocks of any strategy and size (blk, strategy, k, v), k counting row by row.

    Cosine transforms are products with the cosines of their sizes, of whole blocks in tasks; the other 8 x 8 ones go
    through one join with their matrices, which depend on the format alone and are broadcast. A block comes out
    whole: 8 x 8 ones of the other kinds need all their coefficients there, cosine ones at least one. Strategies that do
    not exist are an error, and so are corner transforms without their ``corner_basis`` (see ``matrix``).
    """
    spark, keys = blocks.sparkSession, ["blk", "strategy"]
    rows = blocks.withColumn("strategy", F.coalesce("strategy", F.lit(-1).cast("bigint")))  # joins would leave a null out without a word
    rows = rows.join(F.broadcast(strategies(spark)), "strategy", "left")
    missing = F.raise_error(F.concat(F.lit("no transform for strategy "), F.col("strategy").cast("string"))).cast("string")
    known = F.col("kind").isNotNull() & (F.lit(corner_basis is not None) | ~F.col("kind").startswith("corner"))
    rows = rows.withColumn("kind", F.when(known, F.col("kind")).otherwise(missing))
    special = {n: matrix(kind, corner_basis) for n, (_, _, kind) in enumerate(STRATEGIES) if kind != "dct" and (corner_basis is not None or not kind.startswith("corner"))}
    small = _by_matrix(rows.where("kind <> 'dct'"), keys, special)
    kind = blocks.schema["blk"].dataType.simpleString()
    large = rows.where("kind = 'dct'").select(*keys, "width", "height", "k", F.col("v").cast("double").alias("v"))
    large = large.repartition(*keys).sortWithinPartitions(*keys)
    large = large.mapInArrow(by_groups(keys, _block_samples), f"blk {kind}, strategy long, x long, y long, v double")
    return large.select(*keys, "x", "y", "v").union(small.select(*keys, "x", "y", "v"))


def weights(spark: SparkSession, bands: dict[int, Sequence[Sequence[float]]] | None = None) -> DataFrame:
    """strategy, channel, k, weight: the weights of quantised coefficients, by rule from the default numbers.

    ``bands`` adds or replaces strategies, {strategy: bands of the three channels}; of the larger sizes' default bands only
    those in BANDS are built in. The table is as large as the transforms it covers, some 10^5 rows at most.
    """
    known = {s: b for names, b in BANDS.items() for s in names} | (bands or {})
    parts = []
    for strategy, by_channel in known.items():
        width, height, kind = STRATEGIES[strategy]
        for channel, numbers in enumerate(by_channel):
            if kind == "dct" or strategy in (bands or {}):
                one = band_weights(spark, width, height, numbers)
            elif kind == "dct4x4":  # four coefficients share one of a 4 x 4 block's weights
                one = band_weights(spark, 4, 4, numbers).select(F.explode(F.expr("transform(sequence(0L, 3L), n -> (k div 4 * 2 + n div 2) * 8 + k % 4 * 2 + n % 2)")).alias("k"), "weight")
            else:  # dct4x8, dct8x4: two share one of an 8 x 4 block's
                one = band_weights(spark, 8, 4, numbers).select(F.explode(F.expr("transform(sequence(0L, 1L), n -> (k div 8 * 2 + n) * 8 + k % 8)")).alias("k"), "weight")
            parts.append(one.select(F.lit(strategy).cast("bigint").alias("strategy"), F.lit(channel).cast("bigint").alias("channel"), "k", "weight"))
    k, x, y = F.col("k"), F.col("k") % 8, div("k", F.lit(8))
    for strategy, by_channel in ((1, IDENTITY_WEIGHTS), (2, HAAR_WEIGHTS)):
        if strategy in (bands or {}):
            continue
        for channel, numbers in enumerate(by_channel):
            if strategy == 1:
                value = F.when(k.isin(1, 8), numbers[1]).when(k == 9, numbers[2]).otherwise(numbers[0])
            else:  # a pair of numbers for each level of the cascade: along an axis, and across both
                level = F.floor(F.log2(F.greatest(x, y, F.lit(1)).cast("double")) + 1e-9)
                both = F.least(x, y) >= F.pow(F.lit(2.0), level)
                value = F.when(k == 0, numbers[0]).otherwise(F.element_at(F.array(*map(F.lit, numbers)), (2 * level + both.cast("int") + 1).cast("int")))
            one = spark.range(64).withColumnRenamed("id", "k").withColumn("weight", value.cast("double"))
            parts.append(one.select(F.lit(strategy).cast("bigint").alias("strategy"), F.lit(channel).cast("bigint").alias("channel"), "k", "weight"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def weighed(coefficients: DataFrame, table: DataFrame, custom: DataFrame | None = None) -> DataFrame:
    """Adds ``weight`` to coefficients (strategy, channel, k, ...): of the ``custom`` table where it has one, else of ``table``.

    A coefficient without a weight is an error.
    """
    rows = coefficients.join(F.broadcast(table), ["strategy", "channel", "k"], "left")
    if custom is not None:
        own = custom.select("strategy", "channel", "k", F.col("weight").alias("_own"))
        rows = rows.join(F.broadcast(own), ["strategy", "channel", "k"], "left").withColumn("weight", F.coalesce("_own", "weight")).drop("_own")
    missing = F.raise_error(F.concat(F.lit("no weights for strategy "), F.coalesce(F.col("strategy").cast("string"), F.lit("null")))).cast("double")
    return rows.withColumn("weight", F.coalesce("weight", missing))


def in_natural_order(coded: DataFrame, numbers: Sequence[int]) -> DataFrame:
    """(blk, strategy, place, k, v): coefficients (blk, strategy, place, v) in coded order, with their places k in the block.

    ``numbers`` are the strategies that may occur; their orders are one broadcast table of as many rows as their sizes.
    A tall block's coefficients lie in the block turned on its side.
    """
    spark, table = coded.sparkSession, None
    for n in numbers:
        one = coefficient_order(spark, *STRATEGIES[n][:2]).select(F.lit(n).cast("bigint").alias("strategy"), "place", "k")
        table = one if table is None else table.union(one)
    return coded.join(F.broadcast(table), ["strategy", "place"]).select("blk", "strategy", "place", "k", "v")


def with_tiles(samples: DataFrame, tiles: DataFrame, size: int) -> DataFrame:
    """Samples beside the row of (img, tx, ty) of the tile of ``size`` samples a side that they lie in."""
    placed = samples.withColumn("tx", div("x", F.lit(size))).withColumn("ty", div("y", F.lit(size)))
    return placed.join(tiles, ["img", "tx", "ty"]).drop("tx", "ty")
