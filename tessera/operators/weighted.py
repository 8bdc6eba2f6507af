"""The self-correcting predictor: four guesses weighted by how far each was off nearby, on samples that are given.

A sample's guesses need the errors of the one before it and of three in the row above. Samples on a line x + 2 y = t need
none of each other, so an image is gone through in width + 2 height rounds, each a few array operations over all samples
of its line and over all images of a batch that have the same size. A group of an image is one row; its size is bounded
by the format, and groups do not depend on each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Extra bits of guesses, and what halves are rounded by; reciprocals come from the rule 2**24 / n.
BITS, ROUND = 3, 3
_OVER = np.array([0, *((1 << 24) // n for n in range(1, 65))], np.int64)


@dataclass(frozen=True)
class Parameters:
    """Fixed values of the format's default parameters."""

    first: int = 16
    second: int = 10
    third: tuple[int, ...] = (7, 7, 7, 0, 0)
    weights: tuple[int, ...] = (13, 12, 12, 12)


def _log2(v: np.ndarray) -> np.ndarray:
    return np.frexp(v.astype(np.float64))[1].astype(np.int64) - 1


def _rounds(v: np.ndarray, p: Parameters) -> tuple[np.ndarray, np.ndarray]:
    """(prediction, property) of images (n, height, width)."""
    n, h, w = v.shape
    value = np.zeros((n, h + 2, w), np.int64)  # two rows above the first
    value[:, 2:] = v
    off = np.zeros((4, n, h + 1, w + 2), np.int64)  # a row above, and two columns before, the first
    true = np.zeros((n, h + 1, w + 2), np.int64)
    out, prop = np.zeros((n, h, w), np.int64), np.zeros((n, h, w), np.int64)
    for t in range(w + 2 * h - 2):
        y = np.arange(max(0, -(-(t - w + 1) // 2)), min(h - 1, t // 2) + 1)
        x = t - 2 * y
        at = lambda dx, dy: value[:, y + 2 + dy, np.clip(x + dx, 0, w - 1)]
        up, begins, ends = y > 0, x == 0, x == w - 1
        left = np.where(begins, np.where(up, at(0, -1), 0), at(-1, 0))
        top = np.where(up, at(0, -1), left)
        top_left = np.where(up & ~begins, at(-1, -1), left)
        top_right = np.where(up & ~ends, at(1, -1), top)
        top_top = np.where(y > 1, at(0, -2), top)
        n_, w_, ne, nw, nn = (a << BITS for a in (top, left, top_right, top_left, top_top))
        # errors around: a sample's error also counts for the place above its right neighbour
        above = off[:, :, y, x + 2] + off[:, :, y + 1, x + 1]
        right = np.where(ends, above, off[:, :, y, np.minimum(x + 1, w - 1) + 2])
        before = np.where(begins, above, off[:, :, y, x + 1] + off[:, :, y + 1, x])
        error = above + right + before
        shift = np.maximum(_log2(error + 1) - 5, 0)
        weight = 4 + ((np.array(p.weights)[:, None, None] * _OVER[(error >> shift) + 1]) >> shift)
        e_w, e_n = np.where(begins, 0, true[:, y + 1, x + 1]), true[:, y, x + 2]
        e_nw, e_ne = np.where(begins, e_n, true[:, y, x + 1]), np.where(ends, e_n, true[:, y, np.minimum(x + 1, w - 1) + 2])
        largest = e_w
        for e in (e_n, e_nw, e_ne):
            largest = np.where(np.abs(e) > np.abs(largest), e, largest)
        a, b, c, d, e = p.third
        guesses = np.stack(
            [
                w_ + ne - n_,
                n_ - (((e_n + e_w + e_ne) * p.first) >> 5),
                w_ - (((e_n + e_w + e_nw) * p.second) >> 5),
                n_ - ((e_nw * a + e_n * b + e_ne * c + (nn - n_) * d + (nw - w_) * e) >> 5),
            ]
        )
        weight = weight >> (_log2(weight.sum(axis=0)) - 4)
        total = weight.sum(axis=0)
        mean = (((guesses * weight).sum(axis=0) + total // 2 - 1) * _OVER[total]) >> 24
        alike = ((e_n ^ e_w) | (e_n ^ e_nw)) <= 0  # errors around that do not all agree in sign, or are all equal: not beyond the neighbours
        low, high = np.minimum(np.minimum(w_, ne), n_), np.maximum(np.maximum(w_, ne), n_)
        mean = np.where(alike, np.clip(mean, low, high), mean)
        out[:, y, x], prop[:, y, x] = (mean + ROUND) >> BITS, largest
        now = value[:, y + 2, x] << BITS
        true[:, y + 1, x + 2] = mean - now
        off[:, :, y + 1, x + 2] = (np.abs(guesses - now) + ROUND) >> BITS
    return out, prop


#: Samples of whole images that a task gathers before it works them out: bounds its memory where images are smaller.
GATHERED = 1 << 17


def weighted(samples: DataFrame, value: str, parameters: Parameters = Parameters()) -> DataFrame:
    """img, x, y, weighted, property: the prediction of every sample (img, x, y, value), and the largest error around it.

    An image's places without a sample count as 0; they must come after its last sample in reading order. The samples of
    an image (a group of one) come to one task one after another; a task holds a few images at a time, at least one.
    """
    rows = samples.select(*[F.col(c).cast("bigint").alias(c) for c in ("img", "x", "y")], F.col(value).cast("bigint").alias("v"))

    def worked_out(part: pa.Table) -> Iterator[pa.RecordBatch]:
        x, y, v = (part.column(c).to_numpy() for c in ("x", "y", "v"))
        new = _begins(part)
        starts, image = np.flatnonzero(new), np.cumsum(new) - 1
        sizes = np.stack([np.maximum.reduceat(y, starts) + 1, np.maximum.reduceat(x, starts) + 1], axis=1)
        for h, w in np.unique(sizes, axis=0):
            some = (sizes == (h, w)).all(axis=1)
            at = np.flatnonzero(some[image])
            of = (np.cumsum(some) - 1)[image[at]]
            images = np.zeros((int(some.sum()), h, w), np.int64)
            images[of, y[at], x[at]] = v[at]
            found, prop = _rounds(images, parameters)
            img = part.column("img").take(pa.array(at)).combine_chunks()
            yield pa.RecordBatch.from_arrays([img, *[pa.array(a) for a in (x[at], y[at], found[of, y[at], x[at]], prop[of, y[at], x[at]])]], ["img", "x", "y", "weighted", "property"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, enough = [], 0, GATHERED
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count < enough:
                continue
            part = pa.Table.from_batches(held).combine_chunks()
            whole = int(np.flatnonzero(_begins(part))[-1])  # the last image may go on
            if whole:
                yield from worked_out(part.slice(0, whole))
            held, count = part.slice(whole).to_batches(), part.num_rows - whole
            enough = max(GATHERED, 2 * count)
        if count:
            yield from worked_out(pa.Table.from_batches(held).combine_chunks())

    ordered = rows.repartition("img").sortWithinPartitions("img")
    return ordered.mapInArrow(run, "img long, x long, y long, weighted long, property long")


def _begins(part: pa.Table) -> np.ndarray:
    """Where an image begins in rows ordered by image."""
    column = part.column("img").combine_chunks()
    img, none = column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)
    new = np.ones(len(img), bool)
    new[1:] = (img[1:] != img[:-1]) | (none[1:] != none[:-1])
    return new


def with_weighted(samples: DataFrame, value: str, parameters: Parameters = Parameters()) -> DataFrame:
    """``samples`` with ``weighted`` and ``property``; a place that has several rows has them all."""
    found = weighted(samples, value, parameters)
    return samples.join(found.withColumns({c: F.col(c).cast(samples.schema[c].dataType) for c in ("img", "x", "y")}), ["img", "x", "y"])
