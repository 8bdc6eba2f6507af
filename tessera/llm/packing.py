"""Best-fit packing of tokenised documents into fixed-length sequences by linear grouping.

Only the number of pieces of each length decides the packing, and there are at most ``capacity`` lengths. So the
histogram (a partial aggregate) goes to the driver, the packing is settled there for *counts* of pieces, and the
outcome, ranges "pieces of length L ranked r to r+m go to sequences s to s+m at offset o", is bounded by the capacity,
not by the number of documents. Tasks then look up each piece's rank among those of its length.

Linear grouping (Fernandez de la Vega and Lueker 1981): lengths over ``small`` are cut, longest first, into groups of
equal cardinality; each counts as its group's longest. For these few sizes configurations are optimised one by one:
the largest size left plus the subset of the others that fills the rest best (exact subset sums), repeated as often as
the counts allow. Actual pieces replace the rounded ones, which leaves room; the small lengths are put there best-fit,
longest first, and open new sequences only when nothing has room.
"""

from __future__ import annotations

import gc
import json
import os
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import bucket_count, slices, stored

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordEncoder:
    """Ids of texts by a ``tokenizers`` file whose pieces never span white space, as little-endian 32-bit bytes.

    Such a tokenizer gives every stretch between two spaces or line feeds the same ids in any text, so stretches are
    encoded once and kept in two generations of at most ``keep`` entries. Where the file splits by the pattern below, a
    text of plain Latin letters, digits and symbols is cut further, between letters and what is none: those runs recur
    more often than whole stretches. Equal to encoding the whole text (tested).
    """

    #: Fixed value: the pattern of the vocabulary file's splitting step.
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: Characters that its normalising steps leave alone but for their case, which Python lowers alike. Not the
    #: apostrophe, by which some of the pattern's alternatives join a symbol to letters, nor special tokens (``<|``).
    PLAIN = r"(?:[\n !-&(-;=-~À-ÖØ-öø-ÿ]|<(?!\|))*"
    RUNS = r"[a-zß-öø-ÿ]+|[^ \na-zß-öø-ÿ]+"

    def __init__(self, path: str, keep: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        with open(path, encoding="utf-8") as f:
            steps = json.load(f).get("pre_tokenizer") or {}
        self.runs = None
        if any(s.get("pattern", {}).get("Regex") == self.SPLIT for s in steps.get("pretokenizers", [])):
            self.runs, self.plain = re.compile(self.RUNS).findall, re.compile(self.PLAIN).fullmatch
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def units(self, text: str) -> list[str]:
        """Parts of a text that are encoded on their own."""
        if self.runs and self.plain(text):
            return self.runs(text.lower()) or [""]
        return text.replace("\n", " ").split(" ")

    def _whole(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        for at in range(0, len(texts), 4096):
            part = texts[at : at + 4096]
            for text, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                yield text, array("I", e.ids).tobytes()

    def _letters(self, runs: list[str], together: int = 128) -> Iterator[tuple[str, bytes]]:
        """Runs of letters: many in one text, told apart by the number of the word that every id belongs to."""
        lists = [runs[at : at + together] for at in range(0, len(runs), together)]
        for part, e in zip(lists, self.tokenizer.encode_batch([" ".join(x) for x in lists], add_special_tokens=False)):
            raw = array("I", e.ids).tobytes()
            cuts = (np.searchsorted(np.array(e.word_ids), np.arange(len(part) + 1)) * 4).tolist()
            yield from ((p, raw[i:j]) for p, i, j in zip(part, cuts, cuts[1:]))

    def learn(self, lists: list[list[str]]) -> None:
        """Makes every unit of these lists known; at most one generation is given up for it."""
        if len(self.young) > self.keep:
            self.young, self.old = {"": b""}, self.young
        young, old = self.young, self.old
        if missing := set().union(*lists).difference(young):
            if known := [w for w in missing if w in old]:
                young.update(zip(known, map(old.__getitem__, known)))
                missing.difference_update(known)
            letters = re.compile(r"[a-zß-öø-ÿ]+").fullmatch
            runs = [w for w in missing if letters(w)] if self.runs else []
            young.update(self._letters(runs))
            young.update(self._whole(list(missing.difference(runs))))

    def encode_all(self, texts: list[str], at_once: int = 1 << 20) -> Iterator[bytes]:
        """Ids of each text; what is new in up to ``at_once`` characters of texts is learned in one go."""
        lists, size = [], 0
        for i, text in enumerate(texts):
            lists.append(self.units(text))
            size += len(text)
            if size >= at_once or i == len(texts) - 1:
                self.learn(lists)
                young = self.young
                for units in lists:
                    yield b"".join(itemgetter(*units)(young)) if len(units) > 1 else young[units[0]]
                lists, size = [], 0

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))


@lru_cache(maxsize=2)
def word_encoder(path: str, keep: int) -> WordEncoder:
    """One encoder for a worker process, so that tasks that follow each other share what is known."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    gc.set_threshold(200_000, 50, 1000)  # the many entries hold no cycles, and looking for them takes a tenth of the time
    return WordEncoder(path, keep)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, keep: int = 300_000) -> DataFrame:
    """Tokenised documents, cut where longer than ``capacity``: doc_id, piece, start, length, ids_crc32.

    A worker keeps the ids of up to ``2 * keep`` word parts, some 150 bytes each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_encoder(tokenizer_path, keep), np.array([end_id], "<u4").tobytes()
        for batch in slices(batches):
            out: tuple[list, ...] = ([], [], [], [], [])
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode_all(texts)):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = memoryview(ids)[at : at + 4 * capacity]
                    for column, value in zip(out, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, _PIECES)


def _configuration(first: int, sizes: list[int], left: dict[int, int], capacity: int) -> dict[int, int]:
    """``first`` once and the others that fill the rest of the capacity best: size -> times."""
    room = capacity - first
    reach = np.full(room + 1, -1, np.int64)  # which size reached this sum last
    reach[0] = 0
    for s in sizes:
        if s > room:
            continue
        for _ in range(min(left[s] - (s == first), room // s)):
            new = (reach[: room + 1 - s] >= 0) & (reach[s:] < 0)
            if not new.any():
                break
            # only sums reached before this copy may grow by it, so that no size is used more often than it is there
            reach[s:][new] = s
        if reach[room] >= 0:
            break
    at, used = int(np.flatnonzero(reach >= 0)[-1]), defaultdict(int, {first: 1})
    while at:
        s = int(reach[at])
        used[s] += 1
        at -= s
    return dict(used)


def plan(histogram: dict[int, int], capacity: int = 4096, groups: int = 512, small: int | None = None) -> dict[str, np.ndarray]:
    """Ranges that place every rank of every length; see the module's text. Sorted by (length, first).

    ``small`` is a third of the capacity unless given.
    """
    small = capacity // 3 if small is None else small
    ranked: dict[int, int] = defaultdict(int)  # ranks given out, by length
    runs: list[list] = []  # [multiplicity, room, [(length, first rank)]]

    def take(length: int, n: int) -> int:
        ranked[length] += n
        return ranked[length] - n

    large = [(n, histogram[n]) for n in sorted(histogram, reverse=True) if n > small]
    each = max(1, -(-sum(c for _, c in large) // groups))
    left: dict[int, int] = {}  # rounded size -> pieces
    queue: dict[int, list[list[int]]] = defaultdict(list)  # rounded size -> [actual length, pieces]
    room_in_group, size = 0, 0
    for length, count in large:
        while count:
            if not room_in_group:
                room_in_group, size = each, length
            n = min(count, room_in_group)
            left[size] = left.get(size, 0) + n
            queue[size].append([length, n])
            count -= n
            room_in_group -= n
    sizes = sorted(left, reverse=True)
    while sizes:
        used = _configuration(sizes[0], sizes, left, capacity)
        times = min(left[s] // k for s, k in used.items())
        slots = []
        for s, k in used.items():
            left[s] -= k * times
            for _ in range(k):
                need, slot = times, []
                while need:
                    head = queue[s][0]
                    n = min(need, head[1])
                    slot.append((head[0], n))
                    head[1] -= n
                    need -= n
                    if not head[1]:
                        queue[s].pop(0)
                slots.append(slot)
        at = [[0, 0] for _ in slots]  # in each slot: which run, how many of it are used
        done = 0
        while done < times:
            n = min(slot[i][1] - u for slot, (i, u) in zip(slots, at))
            items = []
            for slot, place in zip(slots, at):
                items.append((slot[place[0]][0], take(slot[place[0]][0], n)))
                place[1] += n
                if place[1] == slot[place[0]][1]:
                    place[:] = [place[0] + 1, 0]
            runs.append([n, capacity - sum(x for x, _ in items), items])
            done += n
        sizes = [s for s in sizes if left[s]]

    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i, (_, room, _) in enumerate(runs):
        by_room[room].append(i)

    def put(i: int, length: int, times: int, copies: int) -> None:
        """``copies`` of length into each of ``times`` sequences of run i, the rest of which becomes a run of its own."""
        n, room, items = runs[i]
        if times < n:
            runs.append([n - times, room, [(x, first + times) for x, first in items]])
            by_room[room].append(len(runs) - 1)
        runs[i] = [times, room - copies * length, items + [(length, take(length, times)) for _ in range(copies)]]
        by_room[room - copies * length].append(i)

    for length in sorted((n for n in histogram if n <= small), reverse=True):
        count, room = histogram[length], length
        while count:
            while room <= capacity and not by_room[room]:
                room += 1
            if room > capacity:
                fit = capacity // length
                for times, copies in ((count // fit, fit), (1, count % fit)):
                    if times and copies:
                        runs.append([times, capacity, []])
                        put(len(runs) - 1, length, times, copies)
                count = 0
                continue
            i = by_room[room].pop()
            n = runs[i][0]
            if count >= n:
                copies = min(room // length, count // n)
                put(i, length, n, copies)
                count -= n * copies
            else:
                put(i, length, count, 1)
                count = 0
            room = length
    table: dict[str, list[int]] = {k: [] for k in ("length", "first", "times", "sequence", "offset")}
    sequence = 0
    for n, _, items in runs:
        offset = 0
        for length, first in items:
            for k, v in zip(table, (length, first, n, sequence, offset)):
                table[k].append(v)
            offset += length
        sequence += n
    out = {k: np.array(v, np.int64) for k, v in table.items()}
    order = np.lexsort((out["first"], out["length"]))
    return {k: v[order] for k, v in out.items()}


def pack(piece_table: DataFrame, capacity: int = 4096, groups: int = 512, small: int | None = None) -> DataFrame:
    """Adds sequence_id and offset to a table with doc_id, piece and length (1 to ``capacity``).

    Rows alike in doc_id and piece (repeated documents) are all placed. An empty table gives an empty result.
    """
    histogram = {r[0]: r[1] for r in piece_table.groupBy("length").count().collect()}  # at most ``capacity`` rows
    ranges = plan(histogram, capacity, groups, small)
    # Ranks in two steps, so that a length that very many pieces have is not one window.
    parts = bucket_count(sum(histogram.values()), 200_000, 4)
    spread = piece_table.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int"))
    before = (
        spread.groupBy("length", "_part").count()
        .withColumn("_before", F.sum("count").over(W.partitionBy("length").orderBy("_part")) - F.col("count"))
        .drop("count")
    )
    ranked = spread.join(before, ["length", "_part"]).withColumn(
        "_rank",
        F.col("_before") + F.row_number().over(W.partitionBy("length", "_part").orderBy("doc_id", "piece")) - 1,
    )
    columns = piece_table.columns
    shared = piece_table.sparkSession.sparkContext.broadcast(ranges)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        # one sorted key for (length, first); ranks stay below 2**50
        key = t["length"] * (1 << 50) + t["first"]
        for batch in batches:
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            length = batch.column("length").to_numpy(zero_copy_only=False)
            i = np.searchsorted(key, length * (1 << 50) + rank, "right") - 1
            found = [pa.array(t["sequence"][i] + rank - t["first"][i]), pa.array(t["offset"][i])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns] + found, names=[*columns, "sequence_id", "offset"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in piece_table.schema)
    return ranked.select(*columns, "_rank").mapInArrow(look_up, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, keep: int = 300_000) -> DataFrame:
    """One row per piece of every document (a null text is empty: just the end id) with its place in a sequence."""
    return pack(stored(pieces(docs, tokenizer_path, capacity, keep=keep)), capacity)
