"""Noise planes from a counter: any batch of the generator's stream is worked out without those before it.

The generator is xorshift128+ in ``LANES`` lanes. Its step is linear over bits, so n steps are a power of a 128 x 128 bit
matrix, and the powers of two of that matrix take a state any distance ahead in as many products as n has bits. A row of
a group's plane is a run of batches at a known place of the group's stream; each is one row of a table, and tasks fill
them in without any order between them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lanes of the generator, and numbers in a batch: each lane's 64 bits give two.
LANES, BATCH = 8, 16
# The constants of splitmix64.
_GOLDEN, _MIX1, _MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_U = np.uint64


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> _U(30))) * _U(_MIX1)
    z = (z ^ (z >> _U(27))) * _U(_MIX2)
    return z ^ (z >> _U(31))


def seeded(seeds: np.ndarray) -> np.ndarray:
    """States (n, LANES, 2) from n rows of four 32-bit seeds; each lane is seeded from the one before."""
    seeds = seeds.astype(_U)
    at = _mixed(np.stack([(seeds[:, 0] << _U(32)) + seeds[:, 1], (seeds[:, 2] << _U(32)) + seeds[:, 3]], axis=1) + _U(_GOLDEN))
    lanes = [at]
    for _ in range(LANES - 1):
        lanes.append(_mixed(lanes[-1]))
    return np.stack(lanes, axis=1)


def stepped(state: np.ndarray) -> np.ndarray:
    """The states one step on."""
    a, b = state[..., 0], state[..., 1]
    a = a ^ (a << _U(23))
    return np.stack([b, a ^ b ^ (a >> _U(18)) ^ (b >> _U(5))], axis=-1)


@lru_cache(maxsize=64)
def _power(k: int) -> np.ndarray:
    """What each of the 128 bits of a state becomes after 2**k steps, (128, 2)."""
    if k == 0:
        bits = np.zeros((128, 2), _U)
        for i in range(128):
            bits[i, i // 64] = _U(1) << _U(i % 64)
        return stepped(bits)
    return _times(_power(k - 1), _power(k - 1))


def _times(state: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    out = np.zeros_like(state)
    for i in range(128):
        on = (state[..., i // 64] >> _U(i % 64)) & _U(1)
        out ^= matrix[i] * on[..., None]
    return out


def ahead(state: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The states (n, LANES, 2) after each of the n numbers of steps."""
    for k in range(int(steps.max(initial=0)).bit_length()):
        some = np.flatnonzero((steps >> k) & 1)
        if len(some):
            state = state.copy()
            state[some] = _times(state[some], _power(k))
    return state


def plane_rows(groups: DataFrame) -> DataFrame:
    """A row for each row of samples of each of a group's three planes, with its place in the group's stream.

    ``groups`` has img, grp, x, y (of its corner), gw, gh. A row of samples takes whole batches, at least one; a plane
    begins where the one before ends.
    """
    batches = F.expr(f"(gw + {BATCH - 1}) div {BATCH}")
    rows = groups.select("img", "grp", "x", "y", "gw", "gh", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("plane"))
    rows = rows.withColumn("row", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("gh").cast("bigint") - 1)))
    return rows.withColumn("batches", batches.cast("bigint")).withColumn("at", (F.col("plane") * F.col("gh") + F.col("row")) * F.col("batches"))


def noise(groups: DataFrame, visible: int = 1, hidden: int = 0) -> DataFrame:
    """img, plane, x, y, v: three planes of noise in [1, 2) over each group, seeded by frame numbers and the corner.

    Groups are dealt to as many tasks as a shuffle has: few bytes of groups become very many samples.
    """
    tasks = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                part = whole.slice(start, 1024)
                img, plane, x, y, wide, row, n, at = (np.asarray(part.column(c), np.int64) for c in ("img", "plane", "x", "y", "gw", "row", "batches", "at"))
                # images have corners and places in common, and the same of both have the same noise
                (cx, cy, upto), row_of = np.unique(np.stack([x, y, at]), axis=1, return_inverse=True)
                state = ahead(seeded(np.stack([np.full_like(cx, visible), np.full_like(cx, hidden), cx, cy], axis=1)), upto)
                values = np.empty((len(cx), int(n.max(initial=1)) * BATCH), np.uint32)
                for b in range(values.shape[1] // BATCH):
                    values[:, b * BATCH : (b + 1) * BATCH] = (state[..., 0] + state[..., 1]).view(np.uint32)  # little-endian: the lower half first
                    state = stepped(state)
                of, column = np.nonzero(np.arange(values.shape[1]) < wide[:, None])
                v = ((values[row_of.reshape(-1)[of], column] >> np.uint32(9)) | np.uint32(0x3F800000)).view(np.float32).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in (img[of], plane[of], x[of] + column, (y + row)[of], v)], ["img", "plane", "x", "y", "v"])

    return plane_rows(groups.repartition(tasks, "img", "grp")).select("img", "plane", "x", "y", "gw", "row", "batches", "at").mapInArrow(fill, "img long, plane long, x long, y long, v double")
