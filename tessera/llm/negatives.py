"""Hard-negative mining by blocked dense products.

Anchors are cut into blocks of at most ``block`` rows. A block is broadcast, and every task multiplies it with its rows
of the table, some hundred at a time, in float64; sums of whole numbers are exact below 2^53, which is checked. Each
task keeps a running best of five for each anchor, and tasks' bests merge to the block's positives. These fix the window
of scores in which a negative counts as hard, and a second pass keeps the best of each window in the same way. What is
broadcast or collected is a block and its positives, so it is bounded by ``block``; the table itself is never moved.

The number of products is that of anchors times rows, as the task asks for all of them; the passes over the table are
two for each block, and each block's result is written before the next begins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import scratch_dir, stored, tidy

#: Cells of a product that a task has in memory at once.
CELLS = 1 << 21
_TOP = np.iinfo(np.int64).max


class Best:
    """The ``k`` best (score, id) of each of ``n`` rows: higher scores first, then smaller ids, null ids last."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.row, self.score, self.id, self.void = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, bool)
        self.least = np.full(n, -np.inf)  # a score below this can no longer enter

    def merge(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray, void: np.ndarray) -> None:
        if not len(row):
            return
        row, score, ids, void = (np.concatenate(x) for x in ((self.row, row), (self.score, score), (self.id, ids), (self.void, void)))
        order = np.lexsort((ids, void, -score, row))
        row = row[order]
        first = np.searchsorted(row, row, side="left")
        kept = np.arange(len(row)) - first < self.k
        order, row = order[kept], row[kept]
        self.row, self.score, self.id, self.void = row, score[order], ids[order], void[order]
        full = np.arange(len(row)) - np.searchsorted(row, row, side="left") == self.k - 1
        self.least[row[full]] = self.score[full]


def usable(vectors: DataFrame, factor: float) -> DataFrame:
    """vec_id, label and floor(factor * component) as doubles, without rows that have a null or non-finite part."""
    parts = F.col("embedding")
    good = parts.isNotNull() & F.col("label").isNotNull()
    good &= ~F.exists(parts, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(parts, lambda x: F.floor(F.lit(factor) * x.cast("double")).cast("double"))
    return vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("parts"))


def _matrix(parts: pa.Array, width: int) -> np.ndarray:
    """Rows of the list array, short ones filled with zeros."""
    parts = parts.combine_chunks() if isinstance(parts, pa.ChunkedArray) else parts
    sizes = np.asarray(parts.value_lengths(), np.int64)
    out = np.zeros((len(parts), width))
    row = np.repeat(np.arange(len(parts)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.asarray(parts.flatten())
    return out


def _products(batches: Iterator[pa.RecordBatch], anchors: np.ndarray) -> Iterator[tuple]:
    """(products with the anchors, labels, ids, whether the id is null) of the rows, a few at a time."""
    rows = max(64, CELLS // max(1, len(anchors)))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            ids = part.column("vec_id")
            void = np.asarray(ids.is_null())
            yield anchors @ _matrix(part.column("parts"), anchors.shape[1]).T, np.asarray(part.column("label")), np.asarray(ids.fill_null(_TOP)), void


def _ids(ids: np.ndarray, void: np.ndarray) -> pa.Array:
    return pa.array(ids, mask=void)


def _first(df: DataFrame, key: list[str], k: int, ids: str = "vec_id") -> DataFrame:
    """The first ``k`` rows of each key, numbered in ``rank``."""
    order = W.partitionBy(*key).orderBy(F.col("score").desc(), F.col(ids).asc_nulls_last())
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _positives(rows: DataFrame, ids: list, labels: np.ndarray, matrix: np.ndarray, k: int) -> DataFrame:
    """(anchor, rank, vec_id, score): the first ``k`` other rows with the anchor's label; anchor is its place in the block.

    The anchor is itself among the rows. Rows of the same id and score are alike here, so one such row is left out.
    """
    sent = rows.sparkSession.sparkContext.broadcast((labels, matrix))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, anchors = sent.value
        best = Best(len(anchors), k + 1)
        for scores, label, vec, void in _products(batches, anchors):
            a, c = np.nonzero((scores >= best.least[:, None]) & (own[:, None] == label[None, :]))
            best.merge(a, scores[a, c], vec[c], void[c])
        yield pa.RecordBatch.from_arrays([pa.array(best.row), _ids(best.id, best.void), pa.array(best.score.astype(np.int64))], ["anchor", "vec_id", "score"])
        tidy()

    spark = rows.sparkSession
    itself = spark.createDataFrame([(n, i, int(v @ v)) for n, (i, v) in enumerate(zip(ids, matrix))], "anchor long, own long, own_score long")
    top = _first(rows.mapInArrow(find, "anchor long, vec_id long, score long"), ["anchor"], k + 1)
    top = top.join(F.broadcast(itself), "anchor")
    same = F.col("vec_id").eqNullSafe(F.col("own")) & (F.col("score") == F.col("own_score"))
    at = F.min(F.when(same, F.col("rank"))).over(W.partitionBy("anchor"))
    top = top.withColumn("at", at).where(F.col("at").isNull() | (F.col("rank") != F.col("at")))
    top = top.withColumn("rank", F.col("rank") - F.when(F.col("rank") > F.col("at"), 1).otherwise(0)).where(F.col("rank") <= k)
    return top.select("anchor", "rank", "vec_id", "score")


def _negatives(rows: DataFrame, labels: np.ndarray, matrix: np.ndarray, windows: np.ndarray, k: int) -> DataFrame:
    """(window, vec_id, score, rank): the first ``k`` rows of another label in each window (anchor, lowest, highest score)."""
    sent = rows.sparkSession.sparkContext.broadcast((labels, matrix, windows))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, anchors, (of, low, high) = sent.value
        best = Best(len(of), k)
        best.least[:] = low
        nth = np.arange(len(of)) - np.searchsorted(of, of, side="left")  # windows come in order of their anchors
        for scores, label, vec, void in _products(batches, anchors):
            scores[own[:, None] == label[None, :]] = np.nan  # in no window
            for n in range(nth.max(initial=-1) + 1):
                some = np.flatnonzero(nth == n)
                held = scores if len(some) == len(anchors) else scores[of[some]]
                a, c = np.nonzero((held >= best.least[some, None]) & (held <= high[some, None]))
                best.merge(some[a], held[a, c], vec[c], void[c])
        yield pa.RecordBatch.from_arrays([pa.array(best.row), _ids(best.id, best.void), pa.array(best.score.astype(np.int64))], ["window", "vec_id", "score"])
        tidy()

    return _first(rows.mapInArrow(find, "window long, vec_id long, score long"), ["window"], k)


def mine(
    vectors: DataFrame,
    anchors: F.Column,
    *,
    factor: float = 256.0,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    block: int = 8192,
) -> DataFrame:
    """The hard negatives of the rows for which ``anchors`` holds: anchor_id, positive_id, rank, negative_id and both scores.

    ``vectors`` has vec_id, label and embedding (numbers); other columns are ignored. Rows with a null label, a null
    vector or a null or non-finite component take no part; a null id does, and comes last among equal scores. A score is
    the inner product of the rows' floor(factor * component). An anchor's positives are its first ``positives`` other
    rows of the same label; a positive's negatives are the first ``negatives`` rows of another label with
    low * positive_score <= 100 * negative_score <= high * positive_score, numbered from 1. Anchors without a positive, and
    positives without a negative, give no rows; repeated rows are rows of their own. Missing components of shorter
    vectors count as 0. Scores beyond 2^53 raise an error, as they would not be exact. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    rows = stored(usable(vectors, factor))
    size = F.aggregate("parts", F.lit(0.0), lambda s, x: s + x * x)
    found = rows.agg(F.max(F.size("parts")).alias("width"), F.max(size).alias("longest"), F.count(F.when(anchors, 1)).alias("n")).first()
    kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not found["n"]:
        return spark.createDataFrame([], kind)
    if found["longest"] * max(100, low, high) >= 2.0**53:  # by Cauchy and Schwarz, the bound of all scores
        raise ValueError("inner products of these vectors are not exact in float64")
    n_blocks = -(-found["n"] // block)
    # dealt out evenly; a block is what one partition holds, and is written with its number
    dealt = stored(rows.where(anchors).repartition(n_blocks).withColumn("block", F.spark_partition_id()))
    folder = scratch_dir(spark)
    for b in range(n_blocks):
        held = dealt.where(F.col("block") == b).select("vec_id", "label", "parts").toArrow()
        if not held.num_rows:
            continue
        ids, labels, matrix = held.column("vec_id").to_pylist(), np.asarray(held.column("label")), _matrix(held.column("parts"), found["width"])
        near = sorted(_positives(rows, ids, labels, matrix, positives).collect(), key=lambda r: (r["anchor"], r["rank"]))
        score = [r["score"] for r in near]
        windows = np.array([[r["anchor"] for r in near], [-(-low * s // 100) for s in score], [high * s // 100 for s in score]], np.int64).reshape(3, -1)
        pairs = [(n, ids[r["anchor"]], r["vec_id"], r["score"]) for n, r in enumerate(near)]
        pairs = spark.createDataFrame(pairs, "window long, anchor_id long, positive_id long, positive_score long")
        hard = _negatives(rows, labels, matrix, windows, negatives).join(F.broadcast(pairs), "window")
        hard = hard.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        hard.write.parquet(f"{folder}/block={b}")
    return spark.read.schema(kind).parquet(f"{folder}/block=*")
