"""Quality by compression: which of two zstandard dictionaries, of good or of bad text, makes a document smaller.

Labelled rows are drawn by a hash of doc_id, so the sample is bounded (``2 * per_class`` rows of a class for its dictionary
and ``per_class`` more for the calibration), the same on every run and at every size. Each class's dictionary is raw
content: all drawn texts, cut into the blocks that scoring compresses, in the order of a hash, ``dictionary`` bytes at most;
where the texts have more, the draw is one of blocks, so a long text teaches by its share and none is passed over for its
length. A class with fewer bytes has the shorter dictionary; the curve makes up for it, better than cutting the other one
to its length does. A document's bytes are compressed in
blocks with either dictionary; the difference of the two sizes, by bytes and by compressed size, becomes a probability
through a logistic curve fitted on labelled documents that are in no dictionary. Scoring needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices

BLOCK = 4096
LEVEL = 12
SLICES = 4096


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the curve; ``weights`` is empty when there was nothing to learn from."""

    good: bytes
    bad: bytes
    centre: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()

    def score(self, features: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(features), 0.5)
        z = (features - np.array(self.centre)) / np.array(self.scale)
        return 1 / (1 + np.exp(-np.clip(z @ np.array(self.weights[1:]) + self.weights[0], -50, 50)))


class _Sizes:
    """Compressed sizes of a text with either dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        self.two = []
        for content in (good, bad):
            d = zstandard.ZstdCompressionDict(content or b"\n" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.two.append(zstandard.ZstdCompressor(LEVEL, dict_data=d, write_content_size=False).compress)

    def features(self, data: bytes) -> tuple[float, float]:
        good, bad = (sum(len(c(data[i : i + BLOCK])) for i in range(0, len(data), BLOCK)) for c in self.two)
        return (bad - good) / (bad + good + 16), (bad - good) / (len(data) + 16)


def held_out(doc_id: str = "doc_id"):
    """Rows that are never learned from: CRC-32 of the id as text, modulo 3, is 1 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _features(rows: DataFrame, good: bytes, bad: bytes) -> DataFrame:
    """rows(y int, text) -> y and the two differences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = _Sizes(good, bad)
        for batch in batches:
            x = [sizes.features((t.as_py() or "").encode()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([list(f) for f in x], pa.list_(pa.float64()))], names=["y", "x"]
            )

    return rows.select("y", "text").mapInArrow(run, "y int, x array<double>")


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Newton's method, a step being halved until it lowers the loss; intercept first, not penalised."""
    a = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(a.shape[1]), ridge * np.eye(a.shape[1])
    penalty[0, 0] = 1e-9

    def loss(v: np.ndarray) -> float:
        return float(np.logaddexp(0, np.where(y > 0, -1, 1) * (a @ v)).sum() + v @ penalty @ v / 2)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -50, 50)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-9:
            step /= 2
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _dictionaries(rows: DataFrame, dictionary: int) -> dict[int, bytes]:
    """rows(y, doc_id, _mark, text) -> for each class the blocks of its texts in the order of a hash.

    Bytes are counted by slices of the hash first, so that the blocks fetched exceed ``dictionary`` by one slice at most.
    Of rows equal in doc_id and text one counts.
    """
    data = rows.dropDuplicates(["doc_id", "_mark"]).select("y", "doc_id", "_mark", F.col("text").cast("binary").alias("_data"))
    last = F.floor((F.octet_length("_data") - 1) / BLOCK)
    blocks = data.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_nr"))
    blocks = blocks.withColumn("_at", F.xxhash64(F.lit(7), "doc_id", "_mark", "_nr"))
    size = F.least(F.octet_length("_data") - F.col("_nr") * BLOCK, F.lit(BLOCK)) + 1
    counts: dict[int, dict[int, int]] = {0: {}, 1: {}}
    for r in blocks.groupBy("y", F.pmod("_at", F.lit(SLICES)).alias("part")).agg(F.sum(size).alias("n")).collect():
        counts[r["y"]][r["part"]] = r["n"]
    wanted = F.lit(False)
    for y, sizes in counts.items():
        parts, held = -1, 0
        for part in sorted(sizes):
            if held < dictionary:
                parts, held = part, held + sizes[part]
        wanted = wanted | ((F.col("y") == y) & (F.pmod("_at", F.lit(SLICES)) <= parts))
    found = blocks.where(wanted).select(
        "y", F.pmod("_at", F.lit(SLICES)).alias("part"), "_at", "doc_id", "_mark", "_nr",
        F.substring("_data", (F.col("_nr") * BLOCK + 1).cast("int"), F.lit(BLOCK)).alias("block"),
    ).collect()
    found.sort(key=lambda r: tuple(r)[1:6])
    return {y: b"\n".join(bytes(r["block"]) for r in found if r["y"] == y)[:dictionary] for y in counts}


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1000, dictionary: int = 1_500_000) -> Model:
    """Learns ``quality`` from labelled documents that are not held out, ``3 * per_class`` rows of each class at most.

    Rows with a null label, ids labelled both ways and ids without a document teach nothing; nor do null and empty texts.
    Of a repeated id or text every row may be drawn, within the same bounds. Without both classes the model gives every
    document 0.5.
    """
    known = (
        labels.where("doc_id is not null and quality in (0, 1)").where(~held_out())
        .groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("_most"))
        .where("y = _most").select("doc_id", "y", F.xxhash64(F.lit(5), "doc_id").alias("_draw"))
    )
    picked: list = []
    for y in (0, 1):  # takes the smallest draws: each task sends 3 * per_class rows at most
        picked += known.where(F.col("y") == y).orderBy("_draw", "doc_id").limit(3 * per_class).collect()
    spark = docs.sparkSession
    if not picked:
        return Model(b"", b"")
    ids = spark.createDataFrame([(r["doc_id"], int(r["y"]), r["_draw"]) for r in picked], "doc_id long, y int, _draw long")
    # at most 6 * per_class rows of three numbers: bounded by a parameter, so broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").where("text is not null and text <> ''")
    rows = rows.withColumn("_mark", F.xxhash64("text"))
    cut: dict[int, int] = {}
    for y in (0, 1):  # an id may have many rows: again 3 * per_class of them at most
        some = rows.where(F.col("y") == y).select("_draw", "_mark").orderBy("_draw", "_mark").limit(3 * per_class).collect()
        if not some:
            return Model(b"", b"")
        cut[y] = some[2 * (len(some) - 1) // 3]["_draw"]  # the smaller two thirds of the draws go to the dictionaries
    last = F.when(F.col("y") == 1, F.lit(cut[1])).otherwise(F.lit(cut[0]))
    texts = _dictionaries(rows.where(F.col("_draw") <= last), dictionary)
    good, bad = texts[1], texts[0]
    rest = rows.where(F.col("_draw") > last)
    fit = []
    for y in (0, 1):
        fit += _features(rest.where(F.col("y") == y).orderBy("_draw", "_mark").limit(per_class), good, bad).collect()
    y = np.array([r["y"] for r in fit], float)
    if not good or not bad or len(set(y)) < 2:
        return Model(b"", b"")
    x = np.array([r["x"] for r in fit])
    # the sample is balanced by class; weigh it back to the share of good labels
    share = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    centre, scale = x.mean(0), x.std(0) + 1e-9
    w = _logistic((x - centre) / scale, y)
    w[0] += np.log(share[1] / share[0]) - np.log(y.sum() / (len(y) - y.sum()))
    return Model(good, bad, tuple(centre), tuple(scale), tuple(w))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 where score >= 0.5); a null text counts as empty. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score", "predicted")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        sizes = _Sizes(m.good, m.bad)
        for batch in slices(batches):
            x = np.array([sizes.features((t.as_py() or "").encode()) for t in batch.column(at)]).reshape(-1, 2)
            s = m.score(x)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                names=[*batch.schema.names, "score", "predicted"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, with their own columns."""
    return score(docs, train(docs, labels)).where("predicted = 1").select(*docs.columns)
