"""Exact top-k inner products by a Voronoi join.

Vectors are grouped by their nearest pivot; pivots are drawn by a hash of the id, about one for every ``group`` vectors
and ``pivots`` at most. A group's summary is its count and, for x = a p + h with p the pivot's direction and h at right
angles to it, the range of a and the greatest length of h. There are at most ``pivots`` summaries, so they go to the
driver and back to tasks. A query first meets its home groups, the nearest ones that hold ``2 * k`` vectors together,
which gives a k-th best score to beat. Since q.x <= max(q.p a) + |h of q| |h of x|, no member of a group whose summary
keeps that sum below the score can enter, and the query is sent to the other groups only. Groups are cut into blocks of
about ``block`` rows, so a large group is many tasks; every block is solved by matrix products and the blocks' best are
merged. Only products that reach the score to beat leave a task.

Of equal vectors only the k + 1 smallest rows can ever be returned (one may be the query itself); tasks keep just these
before the shuffle, so any number of copies of a vector stays small.

How much the bounds exclude depends on the data: on vectors in clusters most pairs of query and group fall away, on
vectors spread evenly over a sphere of many dimensions no bound by distances excludes anything (see the tests).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import stored

_FOUND = "query_id long, query_vec binary, vec_id long, score long, over binary"
_MOST = 2**63 - 1


def quantised(vectors: DataFrame, factor: float = 64.0) -> DataFrame:
    """vec_id, vec (binary, float64 components floor(factor * x)), rows: how many rows are equal in both.

    Left out: null ids, and vectors null or with null or non-finite components (or such whose product with ``factor`` is
    not finite). An empty vector takes part with all its products 0. Vectors of unequal length are compared as if padded
    with zeros.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                if i is None or not v.is_valid:
                    continue
                x = v.values
                if x.null_count:
                    continue
                x = np.floor(factor * x.to_numpy(zero_copy_only=False).astype(np.float64)) + 0.0
                if np.isfinite(x).all():
                    ids.append(i)
                    out.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "vec"])

    rows = vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, vec binary")
    return rows.groupBy("vec_id", "vec").agg(F.count("*").alias("rows"))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    rows = column.to_pylist()
    if all(len(r) == 8 * width for r in rows):
        return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), width)
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r) // 8] = np.frombuffer(r, np.float64)
    return out


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of integers in float64: exact, as int64 or, where they may not fit, as Python's whole numbers."""
    if not len(q) or not len(x):
        return np.zeros((len(q), len(x)), np.int64)
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1] < 2**53:
        return (q @ x.T).astype(np.int64)
    left, right = ([[int(v) for v in row] for row in m] for m in (q, x))
    out = np.empty((len(q), len(x)), object)
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            out[i, j] = sum(map(int.__mul__, a, b))
    return out


def _floats(scores) -> np.ndarray:
    """Scores to beat as doubles, never above the whole numbers; none is minus infinity."""
    return np.nextafter(np.array([-np.inf if s is None or s == -_MOST - 1 else s for s in scores.to_pylist()], float), -np.inf)


def _over(score: int) -> bytes | None:
    """None, or for a score at the end of the 64-bit range or beyond it bytes that sort as these scores do."""
    if -_MOST - 1 < score < _MOST:
        return None
    size = (abs(score).bit_length() + 7) // 8
    whole = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return b"\1" + whole if score > 0 else bytes(255 - b for b in b"\xff" + whole)


def _best(q: np.ndarray, least: np.ndarray, own: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """(number of the query, number of the row, score), in parts: each query's k best rows of x with ``least`` or more.

    x is sorted by id, so that ties go to the smaller id; own is the number of a query's own row, or -1.
    """
    for at in range(0, len(q), 512):
        scores, mine = _products(q[at : at + 512], x), own[at : at + 512]
        if scores.dtype == object:
            floor = np.array([sorted(row)[-k - 1] if len(row) > k + 1 else min(row, default=0) for row in scores], object)
        elif x.shape[0] > k + 1:
            floor = np.partition(scores, x.shape[0] - k - 1, axis=1)[:, x.shape[0] - k - 1]
        else:
            floor = np.full(len(scores), -_MOST - 1)
        keep = (scores >= floor[:, None]) & (scores >= least[at : at + 512, None])
        keep = keep.astype(bool)
        keep[np.flatnonzero(mine >= 0), mine[mine >= 0]] = False
        i, j = np.nonzero(keep)
        found = scores[i, j]
        # rows of a query are in order of id; a stable sort by score keeps that for ties
        order = np.argsort(-found, kind="stable")
        order = order[np.argsort(i[order], kind="stable")]
        first = np.searchsorted(i[order], np.arange(len(scores)))
        order = order[np.arange(len(order)) - first[i[order]] < k]
        yield i[order] + at, j[order], found[order].tolist()


class _Groups:
    """The pivots and what is known of their groups; at most ``pivots`` rows, whatever the size of the table."""

    def __init__(self, pivots: np.ndarray, summary: list, need: int):
        size = np.sqrt((pivots * pivots).sum(1))
        self.along = np.divide(pivots, size[:, None], out=np.zeros_like(pivots), where=size[:, None] > 0)
        n = len(pivots)
        self.count, self.low, self.high, self.off = np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.zeros(n)
        for r in summary:
            self.count[r["cell"]], self.low[r["cell"]], self.high[r["cell"]], self.off[r["cell"]] = r["n"], r["low"], r["high"], r["off"]
        self.need = need

    def most(self, q: np.ndarray) -> np.ndarray:
        """For every query and group a bound on the inner products; rounding errors are added, so no tie is lost."""
        with np.errstate(all="ignore"):
            a = q @ self.along.T
            square = (q * q).sum(1)
            off = np.sqrt(np.maximum(square[:, None] - a * a, 0) + 1e-9 * square[:, None])
            bound = np.maximum(a * self.low, a * self.high) + off * self.off
            return bound + 1e-9 * np.abs(bound) + 1e-6 * (1 + np.sqrt(square)[:, None])

    def home(self, q: np.ndarray) -> np.ndarray:
        """Marks for every query its home groups, by bounds in descending order until they hold ``need`` vectors."""
        bound = np.where(self.count > 0, self.most(q), -np.inf)
        order = np.argsort(-bound, axis=1, kind="stable")
        held = np.cumsum(self.count[order], axis=1) - self.count[order]
        out = np.zeros(bound.shape, bool)
        np.put_along_axis(out, order, held < self.need, 1)
        return out & (self.count > 0)


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, pivots: int = 256, group: int = 160, block: int = 8192, factor: float = 64.0, seen: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of every row whose id ``every`` divides.

    Exact. Candidates are all rows but the query's own, also rows that repeat its vec_id. Ties go to the smaller vec_id.
    Queries with fewer than k other vectors return all; a query row that is repeated returns its result as often. The
    order is that of the exact products; one beyond 64 bits is shown as the nearest 64-bit number. No vectors, no rows.
    ``seen``, if given, gets the numbers of pairs of query and group that there are and that were sent.
    """
    spark = vectors.sparkSession
    data = stored(quantised(vectors, factor))
    shape = data.agg(F.count("*").alias("n"), F.max(F.octet_length("vec")).alias("width")).first()
    width = max((shape["width"] or 8) // 8, 1)
    drawn = data.withColumn("_draw", F.xxhash64(F.lit(3), "vec_id", "vec")).orderBy("_draw", "vec_id", "vec")
    drawn = drawn.limit(max(1, min(pivots, shape["n"] // group)))
    centre_rows = [bytes(r["vec"]) for r in drawn.select("vec").collect()]  # at most ``pivots`` vectors
    centres = np.unique(_matrix(pa.array(centre_rows, pa.binary()), width), axis=0) if centre_rows else np.zeros((1, width))
    shared = spark.sparkContext.broadcast((centres, _Groups(centres, [], 0).along))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, along = shared.value
        square = (p * p).sum(1)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column(1).to_pylist()
            x, ids, n = _matrix(batch.column(1), width), batch.column(0).to_numpy(), batch.column(2).to_numpy()
            with np.errstate(all="ignore"):
                cell = np.argmin(square - 2 * (x @ p.T), axis=1)
                a = (x * along[cell]).sum(1)
                length = (x * x).sum(1)
                off = np.sqrt(np.maximum(length - a * a, 0) + 1e-9 * length)
            # of equal vectors the k + 1 smallest rows, in this batch; queries stay, marked
            held: dict[bytes, int] = {}
            keep = np.zeros(len(ids), np.int64)
            for i in np.argsort(ids, kind="stable"):
                had = held.get(rows[i], 0)
                keep[i] = min(n[i], max(k + 1 - had, 0))
                held[rows[i]] = had + keep[i]
            query = ids % every == 0
            some = pa.array((keep > 0) | query)
            columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(cell.astype(np.int32)), pa.array(a), pa.array(off), pa.array(keep), pa.array(query)]
            names = ["vec_id", "vec", "rows", "cell", "along", "off", "keep", "query"]
            yield pa.RecordBatch.from_arrays([c.filter(some) for c in columns], names=names)

    kind = "vec_id long, vec binary, rows long, cell int, along double, off double, keep long, query boolean"
    placed = stored(data.mapInArrow(assign, kind))
    of_group = [F.sum("keep").alias("n"), F.min("along").alias("low"), F.max("along").alias("high"), F.max("off").alias("off")]
    summary = placed.where("keep > 0").groupBy("cell").agg(*of_group).collect()
    known = spark.sparkContext.broadcast(_Groups(centres, summary, 2 * k))
    blocks = {r["cell"]: -(-r["n"] // block) for r in summary}  # at most ``pivots`` numbers
    in_blocks = F.create_map(*[F.lit(v) for pair in (blocks or {0: 1}).items() for v in pair])
    rows = placed.where("keep > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("keep").cast("int"))))
    dealt = F.pmod(F.xxhash64(F.lit(11), "vec_id", "vec", "copy"), F.element_at(in_blocks, F.col("cell")).cast("long")).cast("int")
    rows = rows.select("vec_id", "vec", (F.col("copy") == 1).alias("first"), "cell", dealt.alias("block"))
    queries = placed.where("query").select(F.col("vec_id").alias("query_id"), "vec")

    def solve(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = {"query_id": pa.int64(), "query_vec": pa.binary(), "vec_id": pa.int64(), "score": pa.int64(), "over": pa.binary()}
        parts = [pa.table([pa.array([], t) for t in kinds.values()], names=list(kinds))]
        if left.num_rows and right.num_rows:
            right = right.take(np.argsort(right.column("vec_id").to_numpy(), kind="stable"))
            vecs, ids = right.column("vec").to_pylist(), right.column("vec_id").to_pylist()
            rows = {(i, v): n for n, (i, v, first) in enumerate(zip(ids, vecs, right.column("first").to_pylist())) if first}
            own = np.array([rows.get(q, -1) for q in zip(left.column("query_id").to_pylist(), left.column("vec").to_pylist())])
            least = _floats(left.column("least"))
            for i, j, score in _best(_matrix(left.column("vec"), width), least, own, _matrix(right.column("vec"), width), k):
                asked, row = left.take(i), right.column("vec_id").take(j)
                shown = pa.array([max(-_MOST - 1, min(_MOST, s)) for s in score], pa.int64())
                over = pa.array([_over(s) for s in score], pa.binary())
                parts.append(pa.table([asked.column("query_id"), asked.column("vec"), row, shown, over], names=list(kinds)))
        return pa.concat_tables(parts).combine_chunks()

    def met(sent: DataFrame) -> DataFrame:
        """Every query of ``sent`` (query_id, vec, cell, least) against all blocks of the cell."""
        each = sent.withColumn("block", F.explode(F.sequence(F.lit(0), F.element_at(in_blocks, F.col("cell")) - 1)))
        return each.groupBy("cell", "block").cogroup(rows.groupBy("cell", "block")).applyInArrow(solve, _FOUND)

    def reach(home: bool):
        """Sends queries to their home groups, or to the others that their k-th best score does not rule out."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g = known.value
            for batch in batches:
                q = _matrix(batch.column(1), width)
                go = g.home(q)
                if not home:
                    go = ~go & ~(g.most(q) < _floats(batch.column(2))[:, None]) & (g.count > 0)
                i, cell = np.nonzero(go)
                take = pa.array(i)
                columns = [batch.column(0).take(take), batch.column(1).take(take), pa.array(cell.astype(np.int32)), batch.column(2).take(take)]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec", "cell", "least"])

        return run

    best_first = W.partitionBy("query_id", "query_vec").orderBy(F.desc("score"), F.desc("over"), "vec_id")
    sent = "query_id long, vec binary, cell int, least long"
    near = queries.withColumn("score", F.lit(None).cast("long")).mapInArrow(reach(True), sent)
    at_home = stored(met(near))
    to_beat = at_home.withColumn("r", F.row_number().over(best_first)).where(F.col("r") == k)
    to_beat = to_beat.select("query_id", F.col("query_vec").alias("vec"), "score")
    away = queries.join(to_beat, ["query_id", "vec"], "left").select("query_id", "vec", "score").mapInArrow(reach(False), sent)
    if seen is not None:
        seen["pairs"], seen["sent"] = queries.count() * len(summary), near.count() + away.count()
    ranked = at_home.union(met(away)).withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
    repeated = placed.where("query and rows > 1").select(F.col("vec_id").alias("query_id"), F.col("vec").alias("query_vec"), "rows")
    often = F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("rows", F.lit(1))))
    out = ranked.join(repeated, ["query_id", "query_vec"], "left").withColumn("_copy", often)
    return out.select("query_id", "rank", "vec_id", "score")
