"""Target-distribution importance resampling with hashed word features.

A text's features are its runs of 1 to ``order`` consecutive words, each known by the CRC-32 of its bytes modulo
``buckets``. Feature counts of the pool and of the target give every bucket a gain, the scaled logarithm of how much
likelier the bucket is in the target; the gains are one array of ``buckets`` numbers, whatever the size of the tables.
A document's weight is the floored mean of its features' gains, and a Gumbel deviate drawn from its id turns taking the
highest scores into sampling without replacement in proportion to exp(weight / 1000).

Scores are integers in a bounded range, so the draw needs no sort of the pool: a histogram of scores gives each score the
number of documents above it (its rank offset) and the score at which the draw ends; ranks inside one score are by doc_id.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import stored, tidy

#: Bytes of text that a task works on at a time; a longer text is worked on alone.
CHUNK_BYTES = 4 << 20
#: Words of up to so many bytes go through the table-driven CRC together, longer ones one by one.
LONG_WORD = 48
#: Equal rows that are ranked as one.
EQUAL_ROWS = 1 << 14


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table.astype(np.uint32)


_CRC = _crc_table()
_LOW = np.arange(256, dtype=np.uint8)
_LOW[ord("A") : ord("Z") + 1] += 32
#: Bytes of a word, after lower-casing: digits, letters and all bytes of characters beyond ASCII.
_IN_WORD = np.array([chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" or b > 127 for b in range(256)])


def _fed(state: np.ndarray, low: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC registers ``state`` after the bytes ``low[start:start + length]`` of each."""
    out = state.copy()
    for i in np.flatnonzero(length > LONG_WORD):
        word = low[start[i] : start[i] + length[i]].tobytes()
        out[i] = zlib.crc32(word, int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    order = np.argsort(-length, kind="stable")
    order = order[np.count_nonzero(length > LONG_WORD) :]  # longest first, so those not yet at their end are a prefix
    at, state = start[order], state[order]
    left = np.searchsorted(-length[order], -np.arange(LONG_WORD), side="left")
    for k in range(LONG_WORD):
        n = left[k]
        if not n:
            break
        state[:n] = _CRC[(state[:n] ^ low[at[:n] + k]) & 255] ^ (state[:n] >> 8)
    out[order] = state
    return out


def features(texts: pa.Array, order: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each feature, its CRC-32, words of each text) for a batch of texts; null texts have no words.

    Only A-Z are lower-cased, so bytes stand for characters: every byte of a character beyond ASCII is part of a word.
    """
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    low = _LOW[np.frombuffer(held, np.uint8)[bounds[0] : bounds[-1]]] if held is not None and len(texts) else np.empty(0, np.uint8)
    bounds = bounds - bounds[0] if len(bounds) else np.zeros(1, np.int64)
    inside = _IN_WORD[low]
    edges = np.zeros(len(low) + 1, bool)
    edges[bounds] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edges[1:-1]
    last[:-1] &= ~inside[1:] | edges[1:-1]
    start = np.flatnonzero(first)
    length = np.flatnonzero(last) + 1 - start
    text = np.searchsorted(bounds[1:], start, side="right")
    words = np.bincount(text, minlength=len(texts)).astype(np.int64)
    runs = _fed(np.full(len(start), 0xFFFFFFFF, np.uint32), low, start, length)
    whose, crcs, begun = [text], [~runs], np.arange(len(start))
    for n in range(1, order):  # runs of n words go on by a space and the word after them
        begun = begun[begun + n < len(start)]
        begun = begun[text[begun] == text[begun + n]]
        spaced = _CRC[(runs[begun] ^ 32) & 255] ^ (runs[begun] >> 8)
        grown = _fed(spaced, low, start[begun + n], length[begun + n])
        runs = np.zeros(len(start), np.uint32)
        runs[begun] = grown
        whose.append(text[begun])
        crcs.append(~grown)
    return np.concatenate(whose), np.concatenate(crcs), words


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about CHUNK_BYTES of text, at least a row each."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.binary_length(batch.column("text")).fill_null(0), np.int64))
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK_BYTES, side="right")))
            yield batch.slice(at, upto - at)
            at = upto
    tidy()


def bucket_counts(texts: DataFrame, buckets: int, order: int = 2) -> np.ndarray:
    """Features of the column ``text`` by bucket; each task sends its sums, at most ``buckets`` of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in _chunks(batches):
            total += np.bincount(features(batch.column("text"), order)[1] % buckets, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": held.astype(np.int32), "n": total[held]})

    counted = texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in counted.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(pool: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed share of each bucket in the target over that in the pool."""
    n, all_pool, all_target = len(pool), int(pool.sum()), int(target.sum())
    above = lambda s, t: float((t + 1) * (all_pool + n)) / float((s + 1) * (all_target + n))
    return np.array([math.floor(1000 * math.log(above(int(s), int(t)))) for s, t in zip(pool, target)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, order: int = 2) -> DataFrame:
    """doc_id, n_words, n_features and weight (the floored mean of the features' gains; 0 without features)."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            text, crc, words = features(batch.column("text"), order)
            total = np.bincount(text, weights=gain[crc % len(gain)], minlength=batch.num_rows).astype(np.int64)  # whole, below 2^53
            n = np.bincount(text, minlength=batch.num_rows)
            weight = np.where(n, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (words, n, weight))], ["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")


def gumbel(seed: int) -> F.Column:
    """floor(1000 g) of a standard Gumbel deviate g, settled by the seed and the doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def drawn(scored: DataFrame, eligible: F.Column, percent: int) -> DataFrame:
    """Adds ``rank``: of the n eligible rows the floor(percent n / 100) highest scores, from 1, ties to the smaller doc_id.

    ``scored`` (doc_id, score and others) is read more than once, so it should be stored. The histogram has a number for
    each distinct score: scores are integers, and logarithms of counts and of a 32-bit hash bound them to some 10^5.
    Equal rows are counted before they are ranked, so that any number of them is a few rows. Null ids come last.
    """
    columns = scored.columns
    found = scored.where(eligible).groupBy("score").agg(F.count("*").alias("n")).collect()
    counts = sorted(((r["score"], r["n"]) for r in found), reverse=True)
    take = percent * sum(n for _, n in counts) // 100
    offsets, above = [], 0
    for score, n in counts:  # from the highest score, until the draw is full
        if above >= take:
            break
        offsets.append((score, above))
        above += n
    none = F.lit(None).cast("long").alias("rank")
    if not offsets:
        return scored.select(*columns, none)
    cutoff = offsets[-1][0]
    above = F.broadcast(scored.sparkSession.createDataFrame(offsets, "score long, above long"))
    enters = F.coalesce(eligible & (F.col("score") >= cutoff), F.lit(False))
    alike = scored.where(enters).groupBy(*columns).agg(F.count("*").alias("alike"))
    tied = W.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), *[c for c in columns if c not in ("doc_id", "score")])
    before = F.coalesce(F.sum("alike").over(tied.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    some = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(alike - 1) div {EQUAL_ROWS}"))).alias("chunk")
    ranked = alike.withColumn("before", before).join(above, "score").select(*columns, "alike", "before", "above", some)
    last = F.least(F.col("alike"), (F.col("chunk") + 1) * EQUAL_ROWS)
    one = F.explode(F.sequence(F.col("chunk") * EQUAL_ROWS + 1, last)).alias("nth")
    ranked = ranked.select(*columns, "above", "before", one).withColumn("rank", F.col("above") + F.col("before") + F.col("nth"))
    ranked = ranked.select(*columns, F.when(F.col("rank") <= take, F.col("rank")).alias("rank"))
    return ranked.unionByName(scored.where(~enters).select(*columns, none))


def resample(
    docs: DataFrame, target: DataFrame, *, buckets: int = 10_000, order: int = 2, percent: int = 25, least_words: int = 20, seed: int = 7
) -> DataFrame:
    """doc_id, n_features, weight, score and rank (long) of every document; rank is null where it is not drawn.

    ``docs`` has doc_id and text, ``target`` text. A null or empty text, or one without words, has no features and weight 0;
    it has under ``least_words`` words and is never drawn. A null id is hashed as an empty one. Repeated rows and ids all
    count, and all come back. Texts of any length are worked on whole, in some 60 bytes of memory a byte. An empty
    pool gives an empty result; with an empty target the gains are those of smoothing alone.
    """
    gain = gains(bucket_counts(docs, buckets, order), bucket_counts(target, buckets, order))
    scored = stored(weighed(docs, gain, order).withColumn("score", F.col("weight") + gumbel(seed)))
    return drawn(scored, F.col("n_words") >= least_words, percent).select("doc_id", "n_features", "weight", "score", "rank")
