"""Mixing sources to target weights with soft membership.

A document belongs to every domain in part: a classifier learned from a labelled table gives its posterior p. Its rate r
says how often it is to be seen. Domain k is then expected to give sum r n p_k tokens, n being the document's tokens, and
rates between bounds are sought for which these totals are nearest to the targets by least squares, by projected
gradient. In the metric that weighs documents by their tokens, and with the Gram matrix G = sum n p p' as scale, a step
is r <- clip(r - p . y), y = G^-1 (totals - targets). G is first that of the documents inside the bounds, which makes a
Newton step, and that of all where such a step does not bring the totals nearer. Only the totals and G, K + K * K
numbers, are gathered from all documents in each round, and the steps y so far, K numbers each, are all that a task needs
to know any document's rate.

The classifier is naive Bayes on pairs of bytes of the whole text, by the mean log-probability a byte, with a softmax
fitted on labelled documents that the tables of pairs have not seen, so posteriors stay soft.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices, stored, tidy
from tessera.llm.jaccard import _SPACE, _grouped


@dataclass(frozen=True)
class Domains:
    """names, log-probabilities of byte pairs (65536 x K), softmax weights (K + 1 x K)."""

    names: tuple[str, ...]
    pairs: np.ndarray
    softmax: np.ndarray


def _features(texts: list[bytes], pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words of each text, mean log-probability of its byte pairs under each domain); zeros for texts under two bytes."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    size = np.array([len(t) for t in texts])
    start = np.cumsum(size + 1) - size - 1
    inside = ~_SPACE[data]
    begins = inside & ~np.concatenate([[False], inside[:-1]])
    tokens = np.add.reduceat(begins.astype(np.int64), start)
    pair = data[:-1].astype(np.uint16) * np.uint16(256) + data[1:]
    sums = np.empty((len(pair) + 1, pairs.shape[1]))
    sums[0] = 0
    np.cumsum(pairs[pair], axis=0, out=sums[1:])
    n = np.maximum(size - 1, 0)
    return tokens, (sums[start + n] - sums[start]) / np.maximum(n, 1)[:, None]


def _posterior(x: np.ndarray, softmax: np.ndarray) -> np.ndarray:
    z = x @ softmax[1:] + softmax[0]
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def learn(docs: DataFrame, labelled: DataFrame, per_domain: int = 800) -> Domains:
    """labelled: (doc_id, domain). Takes at most ``2 * per_domain`` documents of each domain, by a hash of the id.

    Rows with nulls teach nothing; an id with several domains teaches its first. Half of the sample fills the tables of
    pairs, half fits the softmax.
    """
    spark = docs.sparkSession
    known = labelled.where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    known = stored(known.withColumn("draw", F.xxhash64(F.lit(13), "doc_id")))
    names = sorted(r[0] for r in known.select("domain").distinct().collect())  # a domain is a class, not data
    picked = []
    for name in names:
        some = known.where(F.col("domain") == name).orderBy("draw", "doc_id").limit(2 * per_domain).collect()
        picked += [(r["doc_id"], names.index(name), int(i % 2)) for i, r in enumerate(some)]
    k = max(len(names), 1)
    if not picked:
        return Domains(tuple(names) or ("all",), np.zeros((65536, k)), np.zeros((k + 1, k)))
    ids = spark.createDataFrame(picked, "doc_id long, k int, half int")  # bounded by parameters, so broadcast
    rows = stored(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, 65536), np.int64)
        for batch in batches:
            for t, which in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                b = np.frombuffer((t or "").encode(), np.uint8)
                if len(b) > 1:
                    total[which] += np.bincount(b[:-1].astype(np.int64) * 256 + b[1:], minlength=65536)
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["k", "pair", "n"])

    pairs = np.full((65536, k), 0.1)
    for r in rows.where("half = 0").select("text", "k").mapInArrow(count, "k long, pair long, n long").groupBy("k", "pair").sum("n").collect():
        pairs[r[1], r[0]] += r[2]  # at most 65536 rows a domain
    pairs = np.log(pairs / pairs.sum(0))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for which, texts in _grouped(batches):
            _, x = _features(texts, pairs)
            yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["k", "x"])

    fit = rows.where("half = 1").select("k", "text").mapInArrow(score, "k int, x array<double>").collect()
    softmax = np.zeros((k + 1, k))
    if fit and k > 1:
        x, y = np.array([r["x"] for r in fit]), np.array([r["k"] for r in fit])
        centre, scale = x.mean(0), x.std() + 1e-9
        a, target, w = np.column_stack([np.ones(len(x)), (x - centre) / scale]), np.eye(k)[y], np.zeros((k + 1, k))
        for _ in range(400):
            p = _posterior(a[:, 1:], w)
            w -= 2.0 * (a.T @ (p - target) / len(a) + 1e-3 * w * (np.arange(k + 1) > 0)[:, None])
        softmax = np.vstack([w[0] - (centre / scale) @ w[1:], w[1:] / scale])
    return Domains(tuple(names), pairs, softmax)


def _rates(p: np.ndarray, steps: np.ndarray, low: float, high: float) -> np.ndarray:
    r = np.ones(len(p))
    for y in steps:
        r = np.clip(r - p @ y, low, high)
    return r


def _missed(reached: np.ndarray, targets: np.ndarray) -> float:
    return float((np.abs(reached - targets) / np.maximum(targets, 1e-9 * targets.sum() + 1e-300)).max())


@dataclass(frozen=True)
class Mix:
    domains: Domains
    steps: np.ndarray
    low: float
    high: float
    targets: np.ndarray
    reached: np.ndarray

    @property
    def missed(self) -> float:
        """How far the domain that is furthest off is from its target, as a part of the target."""
        return _missed(self.reached, self.targets)


def solve(docs: DataFrame, domains: Domains, weights: dict[str, float], low: float = 1.0, high: float = 4.0, rounds: int = 60, tolerance: float = 1e-3) -> Mix:
    """Finds the rates' steps. Targets: ``weights`` (those of the known domains, made to add up to 1) of the least total
    of tokens for which no domain need be seen less than ``low`` times. A domain without a weight keeps its own share.
    With a lower bound and no upper one (``high`` infinite) that total grows where it leaves soft members no room. Warns
    where a domain is off its target by more than ``tolerance`` of it; the bounds may allow no better.
    """
    k = len(domains.names)
    shared = docs.sparkSession.sparkContext.broadcast(domains)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = shared.value
        for _, texts in _grouped(batches):
            tokens, x = _features(texts, d.pairs)
            p = _posterior(x, d.softmax)
            yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(p.tolist(), pa.list_(pa.float64()))], names=["n", "p"])
        tidy()

    table = stored(docs.select("doc_id", "text").mapInArrow(members, "n long, p array<double>"))

    def total(of) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = 0.0
            for batch in batches:
                n = batch.column(0).to_numpy().astype(float)
                s = s + of(n, np.array(batch.column(1).to_pylist(), float).reshape(-1, k))
            flat = np.ravel(s) if np.ndim(s) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["i", "v"])

        sums = table.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        return np.array([r["v"] for r in sorted(sums, key=lambda r: r["i"])])

    gram = total(lambda n, p: (p * n[:, None]).T @ p)
    if not len(gram) or not gram.any():
        return Mix(domains, np.zeros((0, k)), low, high, np.zeros(k), np.zeros(k))
    gram = gram.reshape(k, k)
    own = gram.sum(1)  # posteriors add up to 1, so this is sum n p
    share = own / own.sum()
    want = np.array([weights.get(name, s) for name, s in zip(domains.names, share)], float)
    want = np.maximum(want, 1e-12) / np.maximum(want, 1e-12).sum()
    targets = want * (low * own / want).max() if low > 0 else want * own.sum()
    ridge = 1e-9 * np.trace(gram) * np.eye(k)
    inverse = np.linalg.pinv(gram + ridge)

    def measured(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def of(n, p):
            r = _rates(p, s, low, high)
            free = n * ((r > low) & (r < high))
            return np.concatenate([p.T @ (n * r), ((p * free[:, None]).T @ p).ravel()])

        sums = total(of)
        return sums[:k], sums[k:].reshape(k, k)

    steps, now, free, newton = np.zeros((0, k)), own, gram, True
    for _ in range(rounds):
        if _missed(now, targets) <= tolerance:
            break
        off = now - targets
        trial = np.vstack([steps, (np.linalg.pinv(free + ridge) if newton else inverse) @ off])
        reached, inside = measured(trial)
        before, after = off @ inverse @ off, (reached - targets) @ inverse @ (reached - targets)
        if after < 0.999 * before:
            steps, now, free, newton = trial, reached, inside, True
        elif newton:
            newton = False
        elif low > 0 and np.isinf(high):
            targets, newton = targets * 1.1, True
        else:
            break
    mix = Mix(domains, steps, low, high, targets, now)
    if mix.missed > tolerance:
        warnings.warn(f"mixing: targets {targets.tolist()} of {domains.names} not reached, but {now.tolist()}", stacklevel=2)
    return mix


def rates(docs: DataFrame, mix: Mix) -> DataFrame:
    """Adds n_tokens long, domain string (the likeliest), rate double and copies int: the rate rounded up or down by a
    hash of id and text, so that the copies of many documents add up to their rates. Clashing columns are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(mix)
    docs = docs.drop("n_tokens", "domain", "rate", "copies", "_u")
    at = docs.columns.index("text")
    chance = F.pmod(F.xxhash64(F.lit(23), "doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches):
            texts = [t.encode() if t else b"" for t in batch.column(at).to_pylist()]
            parts, some, size = [], [], 0
            for i, t in enumerate(texts):
                some.append(t)
                size += len(t)
                if size > 1 << 20 or i == len(texts) - 1:
                    parts.append(_features(some, m.domains.pairs))
                    some, size = [], 0
            tokens, p = np.concatenate([x for x, _ in parts]), _posterior(np.concatenate([x for _, x in parts]), m.domains.softmax)
            r = _rates(p, m.steps, m.low, m.high)
            copies = np.floor(r + batch.column(batch.num_columns - 1).to_numpy()).astype(np.int32)
            best = [m.domains.names[i] for i in p.argmax(1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(tokens), pa.array(best), pa.array(r), pa.array(copies)],
                names=[*batch.schema.names[:-1], "n_tokens", "domain", "rate", "copies"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.withColumn("_u", chance).mapInArrow(run, f"{schema}, n_tokens long, domain string, rate double, copies int")


def language_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, domain): the language of the documents that the labelled table names."""
    ids = labels.select("doc_id").distinct()
    return docs.where("lang is not null").select("doc_id", F.col("lang").alias("domain")).join(ids, "doc_id", "left_semi")


def mixed(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], low: float = 1.0, high: float = 4.0) -> DataFrame:
    """Every document as often as its copies say, with its own columns. With ``low`` of 1 or more none is lost."""
    found = rates(docs, solve(docs, learn(docs, labelled), weights, low, high))
    return found.where("copies > 0").withColumn("_copy", F.explode(F.expr("sequence(1, copies)"))).select(*docs.columns)
