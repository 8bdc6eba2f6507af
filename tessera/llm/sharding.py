"""Consistent hashing with bounded loads, in DataFrame operations only.

Every shard owns ``vnodes`` points of a ring of SLICES equal arcs. A row's key falls on a slice; the shard of the next
point clockwise takes it unless that shard is full, and then the row goes on clockwise to the next shard with room.

Which rows overflow is settled on counts: rows of one slice are alike but for their order, so it is enough to know how
many rows every slice holds (at most SLICES numbers, whatever the size of the table). The walk is done on those numbers
in rounds; each round moves what does not fit one shard further, and a shard that is full stays full, so it ends after
at most ``shards`` rounds. The outcome is a small table of (slice, first rank, last rank, shard), also bounded by the
ring, that is broadcast; rows get their rank in their slice from windows over parts of it and look their shard up.
"""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import stored

#: Arcs of the ring; also the bound of every table that is collected or broadcast here.
SLICES = 1 << 14
#: Equal rows that are ranked as one.
CHUNK = 1 << 14


def _owners(shards: int, vnodes: int) -> list[int]:
    """The shard that owns each slice: of the next point clockwise; the lower shard where two points meet."""
    at: dict[int, int] = {}
    for shard in range(shards):
        for v in range(vnodes):
            point = int.from_bytes(hashlib.blake2b(f"{shard}/{v}".encode(), digest_size=8).digest(), "big") % SLICES
            at[point] = min(shard, at.get(point, shard))
    owners, nxt = [0] * SLICES, at[min(at)]
    for s in range(SLICES - 1, -1, -1):
        nxt = at.get(s, nxt)
        owners[s] = nxt
    return owners


def _walk(counts: dict[int, int], owners: list[int], capacity: list[int]) -> list[dict]:
    """(slice, first, last, shard, base): which ranks of a slice go to which shard, and the shard's slot of the first."""
    shards = len(capacity)
    used = [0] * shards
    out = []
    waiting = [(s, s, 0, n) for s, n in sorted(counts.items()) if n]  # home slice, place of the walk, ranks [from, to)
    while waiting:
        moved = []
        for home, place, lo, hi in waiting:
            shard = owners[place]
            take = min(hi - lo, capacity[shard] - used[shard])
            if take > 0:
                out.append({"slice": home, "first": lo, "last": lo + take - 1, "shard": shard, "base": used[shard]})
                used[shard] += take
                lo += take
            if lo < hi:
                moved.append((home, place, lo, hi))
        if moved and all(u >= c for u, c in zip(used, capacity)):
            raise ValueError("the shards have less room than there are rows")
        nxt_open: dict[int, int] = {}
        waiting = []
        for home, place, lo, hi in moved:  # clockwise to the next shard that still has room
            if place not in nxt_open:
                p = place
                while used[owners[p]] >= capacity[owners[p]]:
                    p = (p + 1) % SLICES
                nxt_open[place] = p
            waiting.append((home, nxt_open[place], lo, hi))
    return out


def shard(df: DataFrame, key: str, shards: int, *, order: list[str], epsilon: float = 0.0, vnodes: int = 64) -> DataFrame:
    """Adds ``shard`` int and ``slot`` long (gapless from 0 in each shard).

    A shard holds at most ceil((1 + epsilon) * rows / shards) rows. With epsilon = 0 the capacities add up to the number
    of rows, so all shards are full and their counts differ by at most one. ``order`` settles which rows of a slice come
    first; rows equal in all columns are interchangeable. Null keys are one key (hashed as null). An empty table gives an
    empty result. Columns named shard, slot or starting with ``_ring_`` are replaced; none may be of a map type.

    Equal rows are counted before the first shuffle. A slice is ranked in parts, by a hash of all of ``order``, whose
    number grows with the root of the table, so that one key with a third of the rows is many windows; the parts' bases
    are a window over counts.
    """
    if shards < 1 or vnodes < 1 or shards > SLICES or epsilon < 0:
        raise ValueError("shards and vnodes must be positive, epsilon not negative")
    spark = df.sparkSession
    df = df.drop("shard", "slot", *[c for c in df.columns if c.startswith("_ring_")])
    names = df.columns
    alike = stored(df.groupBy(*names).agg(F.count("*").alias("_ring_rows")))
    total = alike.agg(F.sum("_ring_rows")).first()[0] or 0
    parts = max(16, math.isqrt(total))
    # equal rows in chunks, as a row each; the slice is of the key alone, the part of the row
    chunk = F.explode(F.sequence(F.lit(0), F.expr(f"int((_ring_rows - 1) div {CHUNK})"))).alias("_ring_chunk")
    rows = alike.select(
        *names, "_ring_rows", chunk, F.pmod(F.xxhash64(F.lit(17), F.col(key)), F.lit(SLICES)).cast("int").alias("_ring_slice")
    )
    rows = rows.withColumn("_ring_rows", F.least(F.lit(CHUNK).cast("long"), F.col("_ring_rows") - F.col("_ring_chunk") * CHUNK))
    rows = rows.withColumn("_ring_part", F.pmod(F.xxhash64(F.lit(29), F.col(key), *order, "_ring_chunk"), F.lit(parts)).cast("int"))
    counted = stored(rows.groupBy("_ring_slice", "_ring_part").agg(F.sum("_ring_rows").alias("_ring_n")))
    counts = dict(map(tuple, counted.groupBy("_ring_slice").agg(F.sum("_ring_n")).collect()))  # at most SLICES numbers
    if epsilon:
        capacity = [-int(-(1 + epsilon) * total // shards)] * shards
    else:
        capacity = [total // shards + (s < total % shards) for s in range(shards)]
    plan = _walk(counts, _owners(shards, vnodes), capacity)
    kind = "array<struct<slice:int,first:bigint,last:bigint,shard:int,base:bigint>>"
    ranges = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(plan)), kind))).select(
        F.col("slice").alias("_ring_slice"), F.col("first").alias("_ring_first"), F.col("last").alias("_ring_last"),
        F.col("shard"), F.col("base").alias("_ring_base"),
    )
    before = W.partitionBy("_ring_slice").orderBy("_ring_part").rowsBetween(W.unboundedPreceding, -1)
    bases = counted.select("_ring_slice", "_ring_part", F.coalesce(F.sum("_ring_n").over(before), F.lit(0)).alias("_ring_start"))
    inside = W.partitionBy("_ring_slice", "_ring_part").orderBy(F.xxhash64(F.lit(29), F.col(key)), *order, "_ring_chunk")
    inside = inside.rowsBetween(W.unboundedPreceding, -1)
    ranked = rows.join(bases.hint("merge"), ["_ring_slice", "_ring_part"])
    ranked = ranked.withColumn("_ring_rank", F.col("_ring_start") + F.coalesce(F.sum("_ring_rows").over(inside), F.lit(0)))
    low = F.greatest("_ring_rank", "_ring_first")
    high = F.least(F.col("_ring_rank") + F.col("_ring_rows") - 1, F.col("_ring_last"))
    return (
        ranked.join(F.broadcast(ranges), "_ring_slice")
        .where(low <= high)
        .withColumn("_ring_rank", F.explode(F.sequence(low, high)))
        .withColumn("slot", F.col("_ring_base") + F.col("_ring_rank") - F.col("_ring_first"))
        .select(*names, "shard", "slot")
    )


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """One row per document with its shard, under the law that counts differ by at most one (``rows``).

    size is the text's UTF-8 bytes plus 16, text_crc32 its unsigned CRC-32; a null text counts as empty in both.
    Repeated rows and repeated doc_ids are all placed. grown_shard is null: it belongs to another law.
    """
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = shard(rows, "doc_id", shards, order=["doc_id", "size", "text_crc32"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
