"""Operators that look at a sample's neighbours.

Neighbourhoods come from two windows, along the row and then along the column, so a sample is shuffled twice whatever the
size of the stencil, and never copied once for every neighbour. Beyond an edge coordinates are mirrored: -1 is 0, n is
n - 1. Windows are by image and row or column, so an image's rows spread over tasks. Enlarging and the filters of a whole
frame go over strips of rows instead (``strips``), which copies no neighbourhoods between steps.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import strips


def _line(value: str, keys: Sequence[str], along: str, reach: int) -> list[Column]:
    """The values at -reach .. reach along an axis, mirrored (reach 1 to 3)."""
    over = W.partitionBy(*keys).orderBy(along)
    here = F.col(value)
    before, after = ([here, *[f(value, i).over(over) for i in range(1, reach + 1)]] for f in (F.lag, F.lead))

    def side(near: list[Column], far: list[Column], n: int) -> Column:
        """The n-th on one side; past the end the walk turns round: the last one again, then back."""
        choices = [near[n]]
        for left in range(n - 1, 0, -1):  # so many are there on this side
            turned = 2 * left - n + 1
            choices.append(F.when(near[left].isNotNull(), near[turned] if turned >= 0 else far[-turned]))
        return F.coalesce(*choices, *[far[i] for i in range(n - 1, 0, -1)], here)

    return [side(before, after, n) for n in range(reach, 0, -1)] + [here] + [side(after, before, n) for n in range(1, reach + 1)]


def neighbourhood(df: DataFrame, value: str, reach: int = 1, image: str = "img", out: str = "around") -> DataFrame:
    """Adds ``out``: array<array> of the (2 reach + 1) square around every sample, rows first."""
    wide = df.withColumn("_row", F.array(*_line(value, [image, "y"], "x", reach)))
    return wide.withColumn(out, F.array(*_line("_row", [image, "x"], "y", reach))).drop("_row")


def neighbourhoods(df: DataFrame, values: Sequence[str], reach: int = 1, image: str = "img") -> DataFrame:
    """Adds ``_<value>``, the neighbourhood of each of several channels, by the same two windows for all of them."""
    df = neighbourhood(df.withColumn("_all", F.struct(*values)), "_all", reach, image, "_near")
    channel = lambda v: F.transform("_near", lambda row: F.transform(row, lambda s: s[v]))
    for v in values:
        df = df.withColumn(f"_{v}", channel(v))
    return df.drop("_all", "_near")


def weigh(around: str, weights: Sequence[Sequence[float]]) -> Column:
    """Sum of a neighbourhood by weights, row by row."""
    total = F.lit(0.0)
    for j, row in enumerate(weights):
        for i, w in enumerate(row):
            if w:
                total = total + F.col(around)[j][i] * F.lit(float(w))
    return total


# The smoothing filter's default weights, the weights of the kernels that double and quadruple, and the
# bound under which the edge filter leaves samples alone.
GABORISH = (1.1 * 0.104699568, 1.1 * 0.055680538)
DOUBLING = [
    -0.017166138, -0.03451538, -0.040222168, -0.029205322, -0.0062446594, 0.14111328, 0.2890625, 0.0027866364,
    -0.016098022, 0.56640625, 0.03778076, -0.019866943, -0.031433105, -0.01184845, -0.0021362305,
]
QUADRUPLING = [
    -0.024185181, -0.034912109, -0.03692627, -0.030944824, -0.0052986145, -0.01663208, -0.035583496, -0.038879395,
    -0.03515625, -0.0098953247, 0.23657227, 0.33398438, -0.010734558, -0.013130188, -0.035552979, 0.13049316, 0.40112305,
    0.039520264, -0.020782471, 0.46923828, -0.0020923615, -0.014846802, -0.040649414, 0.18945312, 0.56298828, 0.066772461,
    -0.023361206, -0.035522461, -0.0075492859, -0.022674561, -0.023635864, 0.0031585693, -0.033996582, -0.013595581,
    -0.00091648102, -0.0033550262, -0.011634827, -0.016098022, -0.0097427368, -0.0019159317, -0.010955811, -0.031982422,
    -0.044555664, -0.027999878, -0.0064582825, 0.063903809, 0.22961426, 0.0063095093, -0.018966675, 0.67529297,
    0.084838867, -0.025344849, -0.02204895, -0.016677856, -0.0038452148,
]
LEAST_SIGMA = -3.905243


def gaborish(df: DataFrame, value: str, out: str = "smooth") -> DataFrame:
    """3 x 3 smoothing whose weights add up to 1."""
    side, corner = GABORISH
    total = 1 + 4 * (side + corner)
    a, b, c = 1 / total, side / total, corner / total
    return neighbourhood(df, value).withColumn(out, weigh("around", [[c, b, c], [b, a, b], [c, b, c]])).drop("around")


def noise_filter(df: DataFrame, value: str, out: str = "noise") -> DataFrame:
    """5 x 5: 0.16 of each neighbour less 3.84 of the centre."""
    weights = [[-3.84 if i == j == 2 else 0.16 for i in range(5)] for j in range(5)]
    return neighbourhood(df, value, 2).withColumn(out, weigh("around", weights)).drop("around")


def smooth_dc(df: DataFrame, values: Sequence[str], steps: Sequence[float]) -> DataFrame:
    """Adaptive smoothing of channels: inside the image only, and less where any channel differs much by its step.

    Adds ``<value>_smooth``. Samples at the edges of their row or column stay.
    """
    w1, w2 = 0.20345139757231578, 0.0334829185968739  # fixed values of the format
    w0 = 1 - 4 * (w1 + w2)
    row, column = W.partitionBy("img", "y").orderBy("x"), W.partitionBy("img", "x").orderBy("y")
    inside = F.lag("x").over(row).isNotNull() & F.lead("x").over(row).isNotNull()
    df = df.withColumn("_in", inside).withColumn("_in", F.col("_in") & F.lag("x").over(column).isNotNull() & F.lead("x").over(column).isNotNull())
    df = neighbourhoods(df, values)
    for v in values:
        df = df.withColumn(f"_{v}", weigh(f"_{v}", [[w2, w1, w2], [w1, w0, w1], [w2, w1, w2]]))
    gap = F.greatest(F.lit(0.5), *[F.abs((F.col(v) - F.col(f"_{v}")) / F.lit(float(s))) for v, s in zip(values, steps)])
    df = df.withColumn("_f", F.greatest(3 - 4 * gap, F.lit(0.0)))
    for v in values:
        df = df.withColumn(f"{v}_smooth", F.when(F.col("_in"), F.col(v) + (F.col(f"_{v}") - F.col(v)) * F.col("_f")).otherwise(F.col(v).cast("double")))
    return df.drop("_in", "_f", *[f"_{v}" for v in values])


_AROUND = {0: [(0, -2), (-1, -1), (0, -1), (1, -1), (-2, 0), (-1, 0), (1, 0), (2, 0), (-1, 1), (0, 1), (1, 1), (0, 2)]}
_CROSS = [(0, -1), (-1, 0), (1, 0), (0, 1)]
#: How the edge filter's steps scale its sigma.
STEP_SCALES = {0: 0.9, 1: 1.0, 2: 6.5}


def edge_filter(df: DataFrame, values: Sequence[str], scales: Sequence[float], inverse_sigma, step: int = 2, sigma_scale: float | None = None, border: float = 2 / 3) -> DataFrame:
    """Edge-preserving mean of a sample and its neighbours, each by how alike all channels are there.

    Step 0 looks at 12 neighbours, 1 and 2 at four; 0 and 1 compare crosses of five samples, 2 single ones. A neighbour
    weighs max(0, 1 + difference * inverse_sigma), the sample itself 1. ``inverse_sigma`` (negative) is a number or a
    column; it is scaled by 1.65, by the step's own scale and, at the borders of 8 x 8 blocks, by ``border``. Where it is
    under LEAST_SIGMA samples stay. Adds ``<value>_kept``.
    """
    reach = {0: 3, 1: 2, 2: 1}[step]
    df = neighbourhoods(df, values, reach)
    places = _AROUND.get(step, _CROSS)
    cross = [(0, 0), *_CROSS] if step < 2 else [(0, 0)]
    at = lambda v, x, y: F.col(f"_{v}")[reach + y][reach + x]
    sigma = F.lit(inverse_sigma) if isinstance(inverse_sigma, (int, float)) else F.col(inverse_sigma)
    edge = (F.col("x") % 8).isin(0, 7) | (F.col("y") % 8).isin(0, 7)
    scale = 1.65 * (STEP_SCALES[step] if sigma_scale is None else sigma_scale)
    df = df.withColumn("_sigma", sigma).withColumn("_scaled", F.col("_sigma") * F.lit(scale) * F.when(edge, F.lit(border)).otherwise(F.lit(1.0)))
    for n, (x, y) in enumerate(places):
        off = F.lit(0.0)
        for v, s in zip(values, scales):
            for i, j in cross:
                off = off + F.abs(at(v, i, j) - at(v, x + i, y + j)) * F.lit(float(s))
        df = df.withColumn(f"_w{n}", F.greatest(1 + off * F.col("_scaled"), F.lit(0.0)))
    whole = sum((F.col(f"_w{n}") for n in range(len(places))), F.lit(1.0))
    for v in values:
        total = sum((F.col(f"_w{n}") * at(v, x, y) for n, (x, y) in enumerate(places)), F.col(v).cast("double"))
        df = df.withColumn(f"{v}_kept", F.when(F.col("_sigma") < LEAST_SIGMA, F.col(v).cast("double")).otherwise(total / whole))
    return df.drop("_sigma", "_scaled", *[f"_{v}" for v in values], *[f"_w{n}" for n in range(len(places))])


def enlarging_kernels(factor: int, weights: Sequence[float]) -> list[list[list[float]]]:
    """5 x 5 weights for each of the factor * factor samples that a sample becomes, row by row.

    ``weights`` is the upper triangle, row by row, of a symmetric square of 5 * factor / 2 a side, whose blocks of five
    are the kernels of the first quadrant; the others are mirrored.
    """
    half = factor // 2
    side, given = 5 * half, iter(weights)
    square = [[0.0] * side for _ in range(side)]
    for i in range(side):
        for j in range(i, side):
            square[i][j] = square[j][i] = float(next(given))
    if next(given, None) is not None:
        raise ValueError("too many weights")
    lines = [[range(5 * o, 5 * o + 5), range(5 * (factor - 1 - o) + 4, 5 * (factor - 1 - o) - 1, -1)][o >= half] for o in range(factor)]
    return [[[square[i][j] for i in lines[ox]] for j in lines[oy]] for oy in range(factor) for ox in range(factor)]


def _cells(around: strips.Around, value: np.ndarray, own: np.ndarray) -> np.ndarray:
    """(own sample, 25): neighbourhoods, rows first."""
    at = around.of(value)
    return np.stack([at(i, j)[own] for j in range(-2, 3) for i in range(-2, 3)], axis=1)


def _enlarging(factor: int, weights: Sequence[float] | None) -> np.ndarray:
    return np.array(enlarging_kernels(factor, weights or {2: DOUBLING, 4: QUADRUPLING}[factor])).reshape(factor * factor, 25)


def enlarge(df: DataFrame, value: str, factor: int = 2, weights: Sequence[float] | None = None, out: str = "v", steps: int | None = None) -> DataFrame:
    """``factor`` (2, 4 or 8) times the width and height; every new sample is a weighed 5 x 5 neighbourhood, kept in its range.

    Weights for 8 have no default here: 210 numbers that the caller gives. With ``steps`` new samples are whole numbers of
    1/steps, rounded with the last place that SQL's inner product has (see ``strips.enlarged``).
    """
    kernels = _enlarging(factor, weights)

    def work(around, x, y, values, own):
        many = max(1, strips.SHOWN // (factor * factor))
        for start in range(0, len(own), many):
            some = own[start : start + many]
            yield start, [strips.enlarged(_cells(around, values[0], some), kernels, steps)]

    return strips.over_strips(df, [value], 2, 2, work, factor, "long" if steps else "double", [out])


def restored(
    df: DataFrame, values: Sequence[str], smooth: bool = True, steps: Sequence[int] = (1, 2), scales: Sequence[float] = (40.0, 5.0, 3.5),
    inverse_sigma: float | str = -1.0, factor: int = 1, weights: Sequence[float] | None = None,
) -> DataFrame:
    """img, x, y and the channels after all filters of a frame, in their order: smoothing, edge filter, enlarging.

    ``smooth`` says whether the first is on, ``steps`` which of the edge filter's steps run (none: it is off), ``factor``
    how much wider and higher the frame gets (1: it stays). All filters go over a strip of rows in one task, one shuffle
    for all of them and all channels. Where ``inverse_sigma`` is a column, it goes along from step to step.
    """
    sigma = [inverse_sigma] if isinstance(inverse_sigma, str) else []
    reach = {0: 3, 1: 2, 2: 1}
    every = [*[1] * smooth, *[reach[s] for s in steps], *[2] * (factor > 1)]
    if not every:
        return df.select("img", "x", "y", *[F.col(v).cast("double").alias(v) for v in values])
    side, corner = GABORISH
    total = 1 + 4 * (side + corner)
    a, b, c = 1 / total, side / total, corner / total
    kernels = _enlarging(factor, weights) if factor > 1 else None

    def work(around, x, y, held, own):
        given = held[len(values)] if sigma else np.full(len(x), float(inverse_sigma))
        held = held[: len(values)]
        if smooth:
            held = [strips.smooth(around, v, [[c, b, c], [b, a, b], [c, b, c]]) for v in held]
        edge = np.isin(x % 8, (0, 7)) | np.isin(y % 8, (0, 7))
        for step in sorted(steps):
            scaled = given * (1.65 * STEP_SCALES[step]) * np.where(edge, 2 / 3, 1.0)
            held = strips.kept(around, held, scales, given, scaled, _AROUND.get(step, _CROSS), [(0, 0), *_CROSS] if step < 2 else [(0, 0)], LEAST_SIGMA)
        many = max(1, strips.SHOWN // (factor * factor))
        for start in range(0, len(own), many):
            some = own[start : start + many]
            yield start, [strips.enlarged(_cells(around, v, some), kernels) if factor > 1 else v[some, None] for v in held]

    return strips.over_strips(df, [*values, *sigma], sum(every), max(every), work, factor, names=list(values))


def widen_chroma(df: DataFrame, value: str, out: str = "v", axis: str = "x") -> DataFrame:
    """Twice as long along an axis: three quarters of the sample and a quarter of the nearer neighbour."""
    other = "y" if axis == "x" else "x"
    before, here, after = _line(value, ["img", other], axis, 1)
    wide = df.withColumn("_b", before).withColumn("_a", after)
    parts = [F.struct((F.col(axis) * 2 + i).alias(axis), (0.75 * here + 0.25 * F.col(n)).alias(out)) for i, n in enumerate(("_b", "_a"))]
    return wide.select("img", other, F.explode(F.array(*parts)).alias("s")).select("img", other, f"s.{axis}", f"s.{out}")


def enlarge_alpha(df: DataFrame, value: str, most: int, factor: int = 2, weights: Sequence[float] | None = None, out: str = "v") -> DataFrame:
    """A subsampled integer channel at full size: enlarged, rounded, from 0 to ``most``."""
    return enlarge(df, value, factor, weights, out, steps=1).withColumn(out, F.least(F.greatest(F.col(out), F.lit(0)), F.lit(most)).cast("bigint"))


def causal(df: DataFrame, value: str) -> DataFrame:
    """Adds what precedes a sample in raster order: left, top, top_left, top_right, left_left, top_top, top_right_right.

    Where there is no such sample: left is the top one at the start of a row (0 at the very first), top is left in the
    first row, and the others fall back to the nearer of left and top.
    """
    row, column = W.partitionBy("img", "y").orderBy("x"), W.partitionBy("img", "x").orderBy("y")
    df = df.withColumn("_w", F.lag(value).over(row)).withColumn("_ww", F.lag(value, 2).over(row))
    df = df.withColumn("_up", F.struct(F.col(value).alias("n"), F.col("_w").alias("nw"), F.lead(value).over(row).alias("ne"), F.lead(value, 2).over(row).alias("nee")))
    df = df.withColumn("_above", F.lag("_up").over(column)).withColumn("_nn", F.lag(value, 2).over(column))
    df = df.withColumn("left", F.coalesce("_w", "_above.n", F.lit(0).cast("bigint"))).withColumn("top", F.coalesce("_above.n", "left"))
    df = df.withColumn("top_left", F.coalesce("_above.nw", "left")).withColumn("top_right", F.coalesce("_above.ne", "top"))
    df = df.withColumn("left_left", F.coalesce("_ww", "left")).withColumn("top_top", F.coalesce("_nn", "top"))
    return df.withColumn("top_right_right", F.coalesce("_above.nee", "top_right")).drop("_w", "_ww", "_up", "_above", "_nn")


def pixel_properties(df: DataFrame, value: str, channel: int = 0, stream: int = 0) -> DataFrame:
    """Adds p0 to p14: what a decision tree asks about a sample's place and the samples before it (see ``causal``).

    p8 is how far the left sample is from the guess made for the sample before, 0 at the start of a row.
    """
    d = causal(df, value)
    t, l, tl = F.col("top"), F.col("left"), F.col("top_left")
    before = F.coalesce(F.lag("p9").over(W.partitionBy("img", "y").orderBy("x")), F.lit(0).cast("bigint"))
    found = {
        0: F.lit(channel).cast("bigint"), 1: F.lit(stream).cast("bigint"), 2: F.col("y"), 3: F.col("x"), 4: F.abs(t), 5: F.abs(l), 6: t, 7: l, 9: l + t - tl,
        10: l - tl, 11: tl - t, 12: t - F.col("top_right"), 13: t - F.col("top_top"), 14: l - F.col("left_left"),
    }
    for i, c in found.items():
        d = d.withColumn(f"p{i}", c)
    return d.withColumn("p8", l - before)


PREDICTORS = (
    "zero", "left", "top", "average0", "pick", "gradient", "weighted", "top_right", "top_left", "left_left", "average1", "average2", "average3", "average4",
)


def predict(kind: str, weighted: str | None = None) -> Column:
    """A guess at a sample from the columns of ``causal``; ``weighted`` names the column of the weighted predictor."""
    t, l, tl, tr = F.col("top"), F.col("left"), F.col("top_left"), F.col("top_right")
    half = lambda a, b: F.call_function("div", a + b, F.lit(2).cast("bigint"))
    if kind == "average4":
        total = 6 * t - 2 * F.col("top_top") + 7 * l + F.col("left_left") + F.col("top_right_right") + 3 * tr + 8
        return F.call_function("div", total, F.lit(16).cast("bigint"))
    if kind == "pick":
        return F.when(F.abs(t - tl) < F.abs(l - tl), l).otherwise(t)
    if kind == "gradient":
        return F.least(F.greatest(l + t - tl, F.least(l, t)), F.greatest(l, t))
    if kind in ("zero", "weighted"):
        return F.col(weighted) if kind == "weighted" and weighted else F.lit(0).cast("bigint")
    pairs = {"average0": (l, t), "average1": (l, tl), "average2": (tl, t), "average3": (t, tr)}
    return half(*pairs[kind]) if kind in pairs else F.col(kind)
