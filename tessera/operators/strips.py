"""Stencils over strips of rows: an image's rows are dealt to tasks in strips, each with the rows that its filters reach over.

A strip is a group of ``STRIP`` rows of samples of an image and as many more above and below as all filters of a call
reach together, so one shuffle of narrow rows is enough however many filters follow one another. Neighbours are found by
index, along the row and then along the column, mirrored at the ends as ``stencils.neighbourhood`` does; columns have no gaps.
Nulls and NaN count as NaN and come out as null.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.gathering import by_groups

#: Rows of samples in a strip, and samples that a task puts out at once.
STRIP, SHOWN = 64, 1 << 18


def _mirrored(line: np.ndarray, reach: int) -> dict[int, np.ndarray]:
    """For -reach .. reach the indices of the samples so far along, in rows ordered by ``line``; past an end the walk turns round."""
    here = np.arange(len(line))

    def beside(by: int) -> np.ndarray:
        at = here + by
        inside = (at >= 0) & (at < len(line))
        at = np.where(inside, at, 0)
        return np.where(inside & (line[at] == line), at, -1)

    steps = {by: here if by == 0 else beside(by) for by in range(-reach, reach + 1)}
    found = {0: here}
    for sign in (-1, 1):
        for n in range(1, reach + 1):
            at = steps[sign * n]
            for left in range(n - 1, 0, -1):  # so many are there on this side
                at = np.where((at < 0) & (steps[sign * left] >= 0), steps[sign * (2 * left - n + 1)], at)
            for i in range(n - 1, 0, -1):
                at = np.where(at < 0, steps[-sign * i], at)
            found[sign * n] = np.where(at < 0, here, at)
    return found


class Around:
    """Where the neighbours of samples are, which are ordered by strip, y and x."""

    def __init__(self, strip: np.ndarray, x: np.ndarray, y: np.ndarray, reach: int):
        line = np.cumsum(np.r_[True, (strip[1:] != strip[:-1]) | (y[1:] != y[:-1])])
        self.along = _mirrored(line, reach)
        order = np.lexsort((y, x, strip))
        column = np.cumsum(np.r_[True, (np.diff(strip[order]) != 0) | (np.diff(x[order]) != 0)])
        self.down = {}
        for by, at in _mirrored(column, reach).items():
            self.down[by] = np.empty(len(x), np.int64)
            self.down[by][order] = order[at]

    def of(self, value: np.ndarray) -> Callable[[int, int], np.ndarray]:
        """The value ``x`` samples along and ``y`` down, each worked out once."""
        lines, cells = {}, {}

        def at(x: int, y: int) -> np.ndarray:
            if x not in lines:
                lines[x] = value[self.along[x]]
            if (x, y) not in cells:
                cells[x, y] = lines[x][self.down[y]]
            return cells[x, y]

        return at


def smooth(around: Around, value: np.ndarray, weights: Sequence[Sequence[float]]) -> np.ndarray:
    at, half, total = around.of(value), len(weights) // 2, 0.0
    for j, row in enumerate(weights):
        for i, w in enumerate(row):
            total = total + at(i - half, j - half) * w
    return total


def kept(around: Around, values: list[np.ndarray], scales: Sequence[float], sigma: np.ndarray, scaled: np.ndarray, places, cross, least: float) -> list[np.ndarray]:
    """The edge filter's mean of each channel, see ``stencils.edge_filter``."""
    near, weights = [around.of(v) for v in values], []
    for x, y in places:
        off = 0.0
        for at, s in zip(near, scales):
            for i, j in cross:
                off = off + np.abs(at(i, j) - at(x + i, y + j)) * float(s)
        weights.append(np.fmax(1 + off * scaled, 0.0))
    whole = 1.0
    for w in weights:
        whole = whole + w
    out = []
    for v, at in zip(values, near):
        total = v
        for w, (x, y) in zip(weights, places):
            total = total + w * at(x, y)
        out.append(np.where(sigma < least, v, total / whole))
    return out


def enlarged(cells: np.ndarray, kernels: np.ndarray, steps: int | None = None) -> np.ndarray:
    """(sample, new sample): sums of (sample, 25) cells by (new sample, 25) weights, kept in the cells' range.

    With ``steps`` they are whole numbers of 1/steps, halves up. There a sum is one of fused products in order, as SQL's
    inner product is: where the last places of another order could change the whole number, that order is gone through.
    """
    low, high = np.fmin.reduce(cells, axis=1)[:, None], np.fmax.reduce(cells, axis=1)[:, None]
    total = cells @ kernels.T
    if steps is None:
        return np.fmin(np.fmax(total, low), high)
    scaled = total * steps + 0.5
    most = np.abs(cells).max(axis=1, initial=0.0)[:, None] * np.abs(kernels).sum(axis=1) * steps + 1
    for i, o in zip(*np.nonzero(np.abs(scaled - np.rint(scaled)) <= most * 2.0**-45)):
        exact = 0.0
        for c, w in zip(cells[i].tolist(), kernels[o].tolist()):
            exact = math.fma(c, w, exact)
        total[i, o] = exact
    return np.floor(np.fmin(np.fmax(total, low), high) * steps + 0.5)


def over_strips(df: DataFrame, values: Sequence[str], reach: int, most: int, work: Callable, factor: int = 1, shown: str = "double", names: Sequence[str] | None = None) -> DataFrame:
    """img, x, y and ``names`` (as ``values`` when there are none): ``work`` of the strips of df (img, x, y, values).

    ``reach`` is how far the filters see together, ``most`` how far one of them. ``work`` takes an ``Around``, x, y, a list
    of arrays and which samples are the strip's own, and gives an array (own sample, new sample) for each of ``names``, new
    samples by row of the ``factor`` times wider and higher image.
    """
    names = list(names or values)
    if not reach < STRIP // 2:
        raise ValueError("filters reach over too many rows")
    y = F.col("y").cast("bigint")
    strip = lambda c: F.floor(c / STRIP).cast("bigint")
    rows = df.select("img", *[F.col(c).cast("bigint").alias(c) for c in "xy"], *[F.col(v).cast("double").alias(v) for v in dict.fromkeys(values)])
    near = F.array_distinct(F.array(strip(F.least(y, F.greatest(y - reach, F.lit(0)))), strip(y + reach)))
    rows = rows.withColumn("_strip", F.explode(near)).repartition("img", "_strip").sortWithinPartitions("img", "_strip", "y", "x")

    def worked_out(part: pa.Table, strips: np.ndarray) -> Iterator[pa.RecordBatch]:
        x, y, number = (part.column(c).to_numpy() for c in ("x", "y", "_strip"))
        own = np.flatnonzero(y // STRIP == number)
        columns = {v: part.column(v).to_numpy() for v in dict.fromkeys(values)}  # nulls become NaN
        img = part.column("img").combine_chunks()
        for start, made in work(Around(strips, x, y, most), x, y, [columns[v] for v in values], own):
            of = np.repeat(own[start : start + len(made[0])], factor * factor)
            n = np.tile(np.arange(factor * factor), len(made[0]))
            out = [img.take(pa.array(of)), pa.array(x[of] * factor + n % factor), pa.array(y[of] * factor + n // factor)]
            kind = pa.int64() if shown == "long" else pa.float64()
            out += [pc.cast(pa.array(m.reshape(-1), from_pandas=True), kind) for m in made]
            yield pa.RecordBatch.from_arrays(out, ["img", "x", "y", *names])

    kind = df.schema["img"].dataType.simpleString()
    run = by_groups(["img", "_strip"], worked_out)
    out = rows.mapInArrow(run, f"img {kind}, x long, y long, " + ", ".join(f"`{n}` {shown}" for n in names))
    return out.select("img", *[F.col(c).cast(df.schema[c].dataType).alias(c) for c in "xy"], *names)
