"""Splines: centripetal Catmull-Rom curves through control points, drawn as segments of unit arc length."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Points of a curve between two control points, coefficients of a colour along a spline.
BETWEEN, COEFFICIENTS = 16, 32


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def _far(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def curve(points: DataFrame, strict: bool = True) -> DataFrame:
    """spline, n, x, y: the curve through control points (spline, i, x, y), ``BETWEEN`` steps from each to the next.

    The ends are extended by reflection. A point equal to the one before it is an error, as its knots would coincide.
    Unless ``strict`` it ends no other spline's work: pieces that such knots belong to keep their rows, between control
    points without coordinates. Splines are dealt to as many tasks as a shuffle has: few bytes of points become many rows.
    """
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = W.partitionBy("spline").orderBy("i")
    here = _point(F.col("x").cast("double"), F.col("y").cast("double"))
    rows = points.repartition(tasks, "spline").select("spline", "i", here.alias("p1"), F.lag(here).over(by).alias("p0"), F.lead(here).over(by).alias("p2"), F.lead(here, 2).over(by).alias("p3"))
    rows = rows.withColumn("i", F.row_number().over(by) - 1)
    mirror = lambda p, q: _point(2 * p["x"] - q["x"], 2 * p["y"] - q["y"])
    last = F.col("p2").isNull()
    p0, p3 = F.coalesce("p0", mirror(F.col("p1"), F.col("p2"))), F.coalesce("p3", mirror(F.col("p2"), F.col("p1")))
    rows = rows.withColumns({"p0": F.when(~last, p0), "p3": F.when(~last, p3)})
    same = F.raise_error(F.lit("identical successive control points")).cast("double") if strict else F.lit(None).cast("double")
    rows = rows.withColumns({f"d{k}": F.sqrt(_far(F.col(f"p{k}"), F.col(f"p{k + 1}"))) for k in range(3)})
    rows = rows.withColumns({f"d{k}": F.when(F.col(f"d{k}") == 0, same).otherwise(F.col(f"d{k}")) for k in range(3)})
    places = [F.col(f"p{k}.{c}").alias(f"{c}{k}") for k in range(4) for c in "xy"]
    steps = F.explode(F.sequence(F.lit(0), F.when(last, 0).otherwise(BETWEEN - 1))).alias("step")
    rows = rows.select("spline", "i", *places, "d0", "d1", "d2", steps)
    into, d0, d1, d2 = (F.col(c) for c in ("into", "d0", "d1", "d2"))
    rows = rows.withColumn("into", F.col("step") / F.lit(float(BETWEEN)) * d1)  # how far the knot lies beyond the second one
    shares = {"t0": (d0 + into) / d0, "t1": into / d1, "t2": (into - d1) / d2, "lower": (d0 + into) / (d0 + d1), "upper": into / (d1 + d2)}
    between = lambda a, b, t: F.col(a) + F.col(t) * (F.col(b) - F.col(a))
    # a column for what is used again: plain arithmetic is compiled, lambdas on arrays are not
    rows = rows.withColumns(shares).withColumns({f"a{k}{c}": between(f"{c}{k}", f"{c}{k + 1}", f"t{k}") for k in range(3) for c in "xy"})
    rows = rows.withColumns({f"b{k}{c}": between(f"a{k}{c}", f"a{k + 1}{c}", t) for k, t in ((0, "lower"), (1, "upper")) for c in "xy"})
    at = lambda c: F.when(F.col("step") == 0, F.col(f"{c}1")).otherwise(between(f"b0{c}", f"b1{c}", "t1"))
    n = (F.col("i") * BETWEEN + F.col("step")).cast("bigint")
    return rows.select("spline", n.alias("n"), at("x").alias("x"), at("y").alias("y"))


def stepped(line: DataFrame) -> DataFrame:
    """spline, k, x, y, intensity: points at whole arc lengths k of polylines (spline, n, x, y), and their ends.

    Arc lengths are prefix sums. Each piece of a line holds the whole lengths from its begin up to its end, so the as-of
    join of steps to pieces is a sequence on each piece. The end's intensity is what is left of the last step; the others
    have 1. A line that lacks a coordinate has no length: it has one row, null but for its spline.
    """
    by = W.partitionBy("spline").orderBy("n")
    lacks = F.max(F.col("x").isNull() | F.col("y").isNull()).over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    rows = line.withColumns({"lacks": lacks, "x1": F.lead("x").over(by), "y1": F.lead("y").over(by)})
    rows = rows.withColumn("length", F.coalesce(F.hypot(F.col("x1") - F.col("x"), F.col("y1") - F.col("y")), F.lit(0.0)))
    before = F.sum("length").over(by.rowsBetween(W.unboundedPreceding, -1))  # null for a first row alone
    rows = rows.withColumn("before", before).withColumns({"since": F.coalesce("before", F.lit(0.0)), "first": F.col("before").isNull(), "last": F.col("x1").isNull()})
    rows = rows.withColumn("to", F.col("since") + F.col("length"))
    whole = F.floor("to").cast("bigint")
    low = F.when(F.col("first"), F.lit(0)).otherwise(F.floor("since") + 1).cast("bigint")
    steps = F.sequence(low, F.when(F.col("last"), whole + 1).otherwise(whole))  # the end comes after the whole lengths
    rows = rows.where(F.col("first") | ~F.col("lacks") & (F.col("last") | (F.floor("to") > F.floor("since"))))
    rows = rows.withColumn("k", F.explode(F.when(F.col("lacks"), F.array(F.lit(None).cast("bigint"))).otherwise(steps)))
    t = F.when(F.col("length") > 0, (F.col("k") - F.col("since")) / F.col("length")).otherwise(F.lit(0.0))
    end = F.col("last") & (F.col("k") > whole)
    at = lambda a: F.when(end, F.col(a)).otherwise(F.col(a) + t * (F.coalesce(f"{a}1", a) - F.col(a)))
    intensity = F.when(end, F.col("to") - F.floor("to")).otherwise(F.lit(1.0))
    return rows.select("spline", "k", *[F.when(~F.col("lacks"), c).alias(name) for name, c in (("x", at("x")), ("y", at("y")), ("intensity", intensity))])


def _dense(series: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of series, a row each, filled up with zeros; and which series lack one or are null."""
    size, flat = series.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), series.flatten()
    inside = np.arange(size.max(initial=1)) < size[:, None]
    terms, lacks = np.zeros(inside.shape), np.zeros(inside.shape, bool)
    terms[inside], lacks[inside] = flat.to_numpy(zero_copy_only=False), flat.is_null().to_numpy(zero_copy_only=False)
    return terms, lacks.any(axis=1) | series.is_null().to_numpy(zero_copy_only=False)


def _lit(parts: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Sums of series at places from 0 to ``COEFFICIENTS`` less one: those of colours, and the last one's, the width.

    Of rows numbered from 1 the first has the series. They hold for the rows up to the next first one, in whatever part.
    """
    held = None
    for nth, at, series in parts:
        first, held = nth.to_numpy() == 1, series.slice(0, 0) if held is None else held
        own = np.cumsum(first) - 1 + len(held)
        series = pa.concat_arrays([held, series.filter(pa.array(first))])
        held = series.slice(max(len(series) - 1, 0))
        terms, lacks = _dense(series.flatten())
        counts = series.value_lengths().to_numpy()
        begins, each = (np.cumsum(counts) - counts)[own], counts[own] - 1
        width, places = begins + each, np.arange(each.max(initial=0))
        inside = places < each[:, None]
        which = np.where(inside, begins[:, None] + places, width[:, None])
        place = (at.to_numpy(zero_copy_only=False) + 0.5) * (math.pi / COEFFICIENTS)
        cosines = np.cos(place[:, None] * np.arange(terms.shape[1]))
        terms *= math.sqrt(2)
        colour = pa.array(np.einsum("ij,icj->ic", cosines, terms[which])[inside], mask=lacks[which][inside])
        colour = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(each)), pa.int32()), colour)
        sigma = pa.array(np.einsum("ij,ij->i", cosines, terms[width]), mask=lacks[width])
        yield pa.StructArray.from_arrays([colour, sigma], ["colour", "sigma"])


def segments(steps: DataFrame, splines: DataFrame) -> DataFrame:
    """spline, k, channel, cx, cy, reach, sigma, intensity, colour: what ``assembly.draw`` draws, from ``stepped`` points.

    ``splines`` has (spline, colours, sigmas): the series of three channels' colours and of the width along the line, as
    arrays of doubles. A spline without length, a point without width and one whose numbers are not finite draw nothing.
    ``reach`` is how far the brightest channel is worth drawing.
    """
    by = W.partitionBy("spline").orderBy("k")
    length = F.sum("intensity").over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) - 1  # of n points n - 2 are whole steps from the one before
    rows = steps.withColumns({"arc": length, "nth": F.row_number().over(by)}).where("arc > 0")
    series = F.concat(F.col("colours").cast("array<array<double>>"), F.array(F.col("sigmas").cast("array<double>")))
    series = splines.select("spline", F.monotonically_increasing_id().alias("own"), series.alias("series")).where("series is not null")
    # windows have dealt steps out by spline; series are wider than Spark guesses, and go to Python once for each spline
    rows = rows.join(series.hint("merge"), "spline").withColumn("series", F.when(F.col("nth") == 1, F.col("series")))
    at = (COEFFICIENTS - 1) * F.least(F.col("k") / F.col("arc"), F.lit(1.0))
    lit = F.arrow_udf(_lit, "colour array<double>, sigma double").asNondeterministic()("nth", at, "series")  # no row is taken away before: it may be a first one
    rows = rows.sortWithinPartitions("spline", "own", "nth").select("spline", "k", F.col("x").alias("cx"), F.col("y").alias("cy"), "intensity", lit.alias("lit"))
    rows = rows.select("spline", "k", "cx", "cy", "intensity", "lit.colour", "lit.sigma")
    finite = lambda c: F.abs(c) < float("inf")
    rows = rows.where((F.col("sigma") != 0) & finite(F.col("sigma")) & finite(1 / F.col("sigma")) & finite(F.col("intensity")))
    most = F.greatest(F.lit(0.01), *[F.abs(pick("colour") * F.col("intensity")) for pick in (F.array_min, F.array_max)])
    reach = F.sqrt(-2.0 * F.col("sigma") * F.col("sigma") * (F.log(F.lit(0.1)) * 3.0 - F.log(most)))
    return rows.select("spline", "k", F.posexplode("colour").alias("channel", "colour"), "cx", "cy", reach.alias("reach"), "sigma", "intensity")
