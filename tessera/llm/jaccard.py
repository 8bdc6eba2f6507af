"""Exact self-join of documents by the Jaccard similarity of their word shingles.

Candidates by a partition of the universe (Deng et al. 2016). Sets are put in size bands a factor 1/threshold wide, so
partners stand in one band or in two that follow. For the pairs whose smaller set is in band b (family b) two similar
sets differ in at most H shingles. A hash deals all shingles to segments; a segment is indexed either by its subset, and
then takes one difference to lose a partner, or also by the subsets with one shingle left out, and then takes two. With
enough segments some segment survives whatever H differences hit, so partners meet under one of its keys. How many
segments get deletion neighbourhoods is settled for each family by an estimate of keys to write and of strangers met.

A segment empty in both sets would be a meeting too. Families have ``spare`` segments more than H takes, so a set with at
most that many empty ones needs no keys for them; only the rare others index them.

Strangers meet under a key when they share a common passage and a segment holds nothing else. So families have ``passed``
more segments still: partners then have passed + 1 keys in common, and every set may pass over its ``passed`` most
frequent keys. The rarest key in common is never among them, for either set, as the others in common are more frequent.

Groups of documents under one key are not paired off. Each first meets the group's smallest member that it shares most
keys with; members found similar are one component, and after that only members of different components meet, until no
such pair in any group is untested. Nothing is capped: a pair is left untested only if its members are connected, or if
their parity sketches differ in more bits than similar sets differ in shingles.
"""

from __future__ import annotations

import hashlib
import math
import secrets
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import bucket_count, components, salt_count, stored, text_bytes, tidy
from tessera.llm.suffixes import CHUNK, U64, _by_bucket, _mix

WORDS = 5
#: Bytes of a word from which it is digested on its own.
LONG_WORD = 64
#: Text bytes for each bucket of keys; and ids that are broadcast at most (8 bytes each).
PER_BUCKET, BROADCAST_IDS = 6 << 20, 500_000
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_TIMES = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: int) -> np.ndarray:
    """64-bit hashes of the words data[start:end] under a key that is drawn anew for every run.

    Words of up to LONG_WORD bytes are mixed in eight bytes at a time, all words together; longer ones are digested one by
    one. Without the key nobody can make up two words that meet.
    """
    size = end - start
    out = _mix(size.astype(U64) * _TIMES[0] + U64(key))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded.tobytes(), strides=(1,))
    order = np.argsort(-size, kind="stable")
    order = order[np.count_nonzero(size > LONG_WORD) :]  # longest first, so those with bytes left are a prefix
    left = np.searchsorted(-size[order], -np.arange(0, LONG_WORD, 8), side="left")
    at, h = start[order], out[order]
    for k, n in enumerate(left.tolist()):
        if not n:
            break
        more = np.minimum(size[order[:n]] - 8 * k, 8).astype(U64)
        part = eight[at[:n] + 8 * k] & (U64(0xFFFFFFFFFFFFFFFF) >> (U64(64) - U64(8) * more))
        h[:n] = _mix((h[:n] ^ part) * _TIMES[(k + 1) % 5] + U64(key ^ 0xA5A5A5A5A5A5A5A5))
    out[order] = h
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        digest = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, key=key.to_bytes(8, "little")).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def _shingles(texts: list[bytes], key: int, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the distinct shingles of text i are hashes[bounds[i]:bounds[i + 1]], sorted.

    A-Z are lower-cased, words are stretches without ASCII white space. A text of fewer words is one shingle; one
    without words has none. A shingle is known by 64 bits, made of its words' keyed hashes.
    """
    joined = b" ".join(texts).lower()
    data = np.frombuffer(joined + b" ", np.uint8)
    ends_of = np.cumsum([len(t) + 1 for t in texts])
    inside = ~_SPACE[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.append(0, edge)
    start, end = edge[::2], edge[1::2]
    word = _word_hashes(data, start, end, key)
    doc = np.searchsorted(ends_of, start, "right")
    per_doc = np.bincount(doc, minlength=len(texts))
    times = _TIMES + [_mix(U64(i + 1) * _TIMES[0]) for i in range(5, words)]
    n = len(word) - words + 1
    if n > 0:
        h = np.zeros(n, U64)
        for j in range(words):
            h += word[j : j + n] * times[j]
        full = doc[:n] == doc[words - 1 :]
        h, d = _mix(h[full]), doc[:n][full]
    else:
        h, d = np.zeros(0, U64), np.zeros(0, np.int64)
    few = np.flatnonzero((per_doc > 0) & (per_doc < words))
    if len(few):
        at = np.cumsum(per_doc) - per_doc
        short = np.zeros(len(few), U64)
        for j in range(words - 1):
            has = per_doc[few] > j
            short[has] += word[at[few[has]] + j] * times[j]
        short = _mix(short + per_doc[few].astype(U64) * U64(0xE7037ED1A0B428DB))
        place = np.searchsorted(d, few)
        h, d = np.insert(h, place, short), np.insert(d, place, few)
    cuts = np.searchsorted(d, np.arange(len(texts) + 1))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[keep], np.concatenate([[0], np.cumsum(keep)])[cuts]


def _grouped(batches: Iterator[pa.RecordBatch], most: int = CHUNK // 2, rows: int = 256) -> Iterator[tuple[list, list[bytes]]]:
    """(first column, texts as bytes) of up to about ``most`` bytes or one text; a batch is never unpacked as a whole."""
    ids, texts, size = [], [], 0
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            batch = whole.slice(at, rows)
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = t.encode() if t else b""
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size >= most:
                    yield ids, texts
                    ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _digests(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers for each set."""
    size = np.diff(bounds)
    one, two = np.zeros(len(size), U64), np.zeros(len(size), U64)
    some = np.flatnonzero(size)
    if len(some):
        one[some] = np.add.reduceat(_mix(h * _TIMES[1]), bounds[:-1][some])
        two[some] = np.bitwise_xor.reduceat(_mix(h * _TIMES[2] + U64(1)), bounds[:-1][some])
    return one.view(np.int64), two.view(np.int64)


@dataclass(frozen=True)
class Family:
    """Segments for pairs whose smaller set is in one band: the first ``deletions`` of ``segments`` have neighbourhoods."""

    segments: int
    deletions: int
    spare: int
    passed: int = 0


def bands(largest: int, percent: int = 80) -> list[int]:
    """Smallest sizes of the bands, and one bound more: any partner of a set in band b is in b - 1, b or b + 1."""
    out = [1]
    while out[-1] <= largest:
        out.append(max(out[-1] + 1, -(-out[-1] * 100 // percent)))
    return out + [-(-out[-1] * 100 // percent)]


def family(low: int, high: int, sets: int, percent: int = 80) -> Family:
    """For smaller sets of ``low`` to ``high`` shingles, of which there are ``sets``; see the module's text.

    Every choice of deletions and spare gets as many segments as the differences can spoil, and 1 + passed more, and
    those that may be lost as empty. Its cost: keys a set, and a thousandth of a key for each stranger met, over an empty
    segment by two sets with more empty ones than spare, or over a segment of one shingle at most that many share.
    """
    most = (high + high * 100 // percent) * (100 - percent) // (100 + percent)  # differences, at most
    if most == 0:
        return Family(1, 0, 0)
    best, passed = None, 0 if most < 5 else 2 + -(-most * 15 // 100)
    for deletions in sorted({0, *((most + 1) // 2 * i // 4 for i in range(1, 5)), (most + 2) // 2}):
        for spare in (x for x in (0, 1, 2, 3, 4, 6, 8, 11, 15, 20, 28, 40, 56, 80, 120, 180, 270, 400, 600) if x <= high):
            need = 1 + passed + spare * (2 if deletions else 1)
            exact = 0
            while True:  # segments that survive: all but those that the differences can spoil
                hit = min(exact, most)
                missing = need - (exact + deletions - hit - min(deletions, (most - hit) // 2))
                if missing <= 0:
                    break
                exact += missing
            m = exact + deletions
            share = (1 - 1 / m) ** low if m > 1 else 0.0  # of segments that are empty
            over = 0.5 * math.erfc((spare + 0.5 - m * share) / math.sqrt(2 * m * share + 1e-9)) if share else 0.0
            each = low / m
            light = math.exp(-each) * (1 + each) if m > 1 else 0.0
            cost = m + deletions * each + over * m * share + 1e-3 * sets * m * (over**2 * share**2 + light * 1e-2)
            if best is None or cost < best[0]:
                best = (cost, Family(m, deletions, spare, passed))
    return best[1]


def _keys(h: np.ndarray, owner: np.ndarray, size: np.ndarray, number: int, f: Family) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, owner, whole subset?) of all sets, one after the other in ``h``, in family ``number``."""
    m = f.segments
    segment = ((h >> U64(17)) % U64(m)).astype(np.int64)
    cell = owner * m + segment
    order = np.argsort(cell.astype(np.uint32 if len(size) * m < 1 << 32 else np.int64), kind="stable")
    cell, content = cell[order], _mix(h[order] * _TIMES[3])
    head = np.ones(len(cell), bool)
    head[1:] = cell[1:] != cell[:-1]
    at = np.flatnonzero(head)
    sums = np.add.reduceat(content, at) if len(at) else np.zeros(0, U64)
    cells = cell[at]
    own = U64((number + 1) * int(_TIMES[0]) % (1 << 64))
    salt = lambda s: _mix(s.astype(U64) * _TIMES[4] + own)
    keys = [_mix(sums + salt(cells % m))]
    owners, whole = [cells // m], [np.ones(len(cells), bool)]
    if f.deletions:
        group = np.cumsum(head) - 1
        some = cell % m < f.deletions
        keys.append(_mix(sums[group[some]] - content[some] + salt(cell[some] % m)))
        owners.append(cell[some] // m)
        whole.append(np.zeros(int(some.sum()), bool))
    filled = np.bincount(cells // m, minlength=len(size))
    poor = np.flatnonzero(m - filled > f.spare)
    if len(poor):
        taken = np.zeros((len(poor), m), bool)
        mine = np.isin(cells // m, poor)
        taken[np.searchsorted(poor, cells[mine] // m), cells[mine] % m] = True
        i, s = np.nonzero(~taken)
        keys.append(_mix(salt(s)))
        owners.append(poor[i])
        whole.append(np.ones(len(i), bool))
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(whole)


_SETS = "doc_id long, n long, d1 long, d2 long"
_KEYS = "bucket int, low binary, member binary, family binary, docs binary"
_GROUPS = "gid long, doc_id long, whole boolean, family int, size int"
#: Groups of more documents are weighed against each other before they count.
FREQUENT = 4
#: Members of a group that meet in one piece.
MEETING = 2048


def _sizes(secret: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _grouped(batches):
            h, bounds = _shingles(texts, secret)
            one, two = _digests(h, bounds)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.diff(bounds)), pa.array(one), pa.array(two)], names=["doc_id", "n", "d1", "d2"])
        tidy()

    return run


def _index(edges: list[int], families: dict[int, Family], buckets: int, secret: int):
    low_edges = np.array(edges)

    def flush(kept: list) -> Iterator[pa.RecordBatch]:
        docs = np.concatenate([k[0] for k in kept])
        base = np.cumsum([0] + [len(k[0]) for k in kept])
        key = np.concatenate([k[1] for k in kept])
        member = np.concatenate([k[2] + np.uint32(2 * b) for k, b in zip(kept, base)])
        family = np.repeat(np.array([k[3] for k in kept], np.uint8), [len(k[1]) for k in kept])
        to = ((key >> U64(32)) % U64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.uint32)
        low = key.astype(np.uint32)
        rows = []
        for b, some in _by_bucket(to, np.arange(len(to))):
            used, short = np.unique(member[some] >> 1, return_inverse=True)
            short = (short.astype(np.uint32) * 2 + (member[some] & 1)).astype(np.uint32)
            rows.append((b, low[some].tobytes(), short.tobytes(), family[some].tobytes(), docs[used].tobytes()))
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        names = [x.split()[0] for x in _KEYS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, count = [], 0
        for ids, texts in _grouped(batches):
            h, bounds = _shingles(texts, secret)
            size = np.diff(bounds)
            one, two = _digests(h, bounds)
            # of equal sets in this part of the table only the smallest document sends keys
            known = np.array([i is not None for i in ids])
            doc = np.array([np.iinfo(np.int64).max if i is None else i for i in ids], np.int64)
            order = np.lexsort((doc, two, one, size))
            new = np.ones(len(order), bool)
            new[1:] = (size[order][1:] != size[order][:-1]) | (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
            chosen = np.zeros(len(size), bool)
            chosen[order[new]] = True
            chosen &= (size > 0) & known
            band = np.searchsorted(low_edges, size, "right") - 1
            for own in np.unique(band[chosen]).tolist():
                some = np.flatnonzero(chosen & (band == own))
                part = size[some]
                shift = np.repeat(bounds[some] - (np.cumsum(part) - part), part)
                values = h[np.arange(len(shift)) + shift]
                owner = np.repeat(np.arange(len(some)), part)
                for number in (own, own - 1):
                    if number in families:
                        key, of, whole = _keys(values, owner, part, number, families[number])
                        kept.append((doc[some], key, (of * 2 + whole).astype(np.uint32), number))
                        count += len(key)
            if count > 500_000:
                yield from flush(kept)
                kept, count = [], 0
        if kept:
            yield from flush(kept)
        kept = []
        tidy()

    return run


def _groups(key: tuple, table: pa.Table) -> pa.Table:
    """Documents that share a key at least one of them has as a whole subset; equal small groups of a bucket once."""
    low, member, docs = (table.column(c).to_pylist() for c in ("low", "member", "docs"))
    keys = np.concatenate([np.frombuffer(x, np.uint32) for x in low]).astype(U64)
    family = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("family").to_pylist()])
    keys |= family.astype(U64) << U64(32)
    flags = [np.frombuffer(x, np.uint32) for x in member]
    doc = np.concatenate([np.frombuffer(d, np.int64)[m >> 1] for m, d in zip(flags, docs)])
    whole = (np.concatenate(flags) & 1).astype(bool)
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    twin = np.zeros(len(k), bool)
    twin[1:] = k[1:] == k[:-1]
    twin[:-1] |= twin[1:]
    order = order[twin]
    order = order[np.lexsort((~whole[order], doc[order], keys[order]))]
    keys, doc, whole, family = keys[order], doc[order], whole[order], family[order]
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    keys, doc, whole, family = keys[first], doc[first], whole[first], family[first]
    if not len(keys):
        return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32())], names=[x.split()[0] for x in _GROUPS.split(", ")])
    head = np.ones(len(keys), bool)
    head[1:] = keys[1:] != keys[:-1]
    at, group = np.flatnonzero(head), np.cumsum(head) - 1
    size = np.bincount(group)
    useful = (size > 1) & np.logical_or.reduceat(whole, at)
    gid = np.add.reduceat(_mix(doc.astype(U64) * _TIMES[0] + whole.astype(U64) + U64(7)), at)
    frequent = size > FREQUENT
    bucket = U64(table.column("bucket")[0].as_py())
    gid[frequent] = _mix(keys[at[frequent]] * _TIMES[1] + bucket)
    _, unique = np.unique(gid, return_index=True)
    once = np.zeros(len(gid), bool)
    once[unique] = True
    keep = (useful & once)[group]
    group = group[keep]
    tidy()
    return pa.table(
        [pa.array(gid.view(np.int64)[group]), pa.array(doc[keep]), pa.array(whole[keep]), pa.array(family[keep].astype(np.int32)), pa.array(size[group].astype(np.int32))],
        names=[x.split()[0] for x in _GROUPS.split(", ")],
    )


def _only(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """``docs`` with (or, left_anti, without) these ids: broadcast if they are few, else a shuffle."""
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", how)


def _shingle_arrays(secret: int):
    """id, shingles, sketch: which of some 2 n bits (a power of two) an odd number of shingles fall on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _grouped(batches):
            h, bounds = _shingles(texts, secret)
            arrays = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(h.view(np.int64)))
            sketches = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                bits = max(64, 1 << (2 * (b - a) - 1).bit_length()) if b > a else 64
                odd = np.bincount((h[a:b] >> U64(7)).astype(np.int64) & (bits - 1), minlength=bits) & 1
                sketches.append(np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64))
            cuts = np.cumsum([0] + [len(x) for x in sketches]).astype(np.int32)
            sketch = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(sketches)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), arrays, sketch], names=["id", "shingles", "sketch"])
        tidy()

    return run


def _near(percent: int):
    """Pairs of members of different components whose sizes and sketches allow similarity, in every meeting of blocks."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        gid, low, high, own, rep, c, n = (table.column(x).to_numpy() for x in ("gid", "low", "high", "own", "rep", "c", "n"))
        whole, sketch = table.column("whole").to_numpy(), table.column("sketch").combine_chunks()
        if isinstance(sketch, pa.ChunkedArray):
            sketch = sketch.chunk(0)
        words, bounds = sketch.values.to_numpy().view(U64), sketch.offsets.to_numpy().astype(np.int64)
        order = np.lexsort((rep, high, low, gid))
        new = np.zeros(len(order), bool)
        for x in (gid, low, high):
            x = x[order]
            new[1:] |= x[1:] != x[:-1]
        found: list[np.ndarray] = []
        for part in np.split(order, np.flatnonzero(new)):
            if (c[part] == c[part[0]]).all():
                continue
            width = int((bounds[part + 1] - bounds[part]).min())
            bits = np.empty((len(part), width), U64)
            for i, p in enumerate(part.tolist()):
                bits[i] = np.bitwise_xor.reduce(words[bounds[p] : bounds[p + 1]].reshape(-1, width), axis=0)
            size, comp, block, full = n[part].astype(np.int64), c[part], own[part], whole[part]
            across = low[part[0]] != high[part[0]]
            kinds, kind, often = np.unique(comp, return_inverse=True, return_counts=True)
            largest, number = kind == often.argmax(), np.arange(len(part))
            for i in np.flatnonzero(~largest).tolist():  # of two components one is not the largest
                ok = (comp != comp[i]) & (largest | (number > i)) & (full | full[i])
                ok &= 100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i])
                if across:  # members of one block meet in that block's own meeting
                    ok &= block != block[i]
                j = np.flatnonzero(ok)
                if len(j):
                    odd = np.bitwise_count(bits[j] ^ bits[i]).sum(1, dtype=np.int64)
                    j = j[(100 + percent) * odd <= (100 - percent) * (size[j] + size[i])]
                    if len(j):
                        found.append(np.column_stack([np.full(len(j), rep[part[i]]), rep[part[j]]]))
        pairs = np.unique(np.concatenate(found or [np.zeros((0, 2), np.int64)]), axis=0)
        return pa.table([pa.array(pairs.min(1) if len(pairs) else pairs[:, 0]), pa.array(pairs.max(1) if len(pairs) else pairs[:, 1])], names=["a", "b"])

    return run


def similar_documents(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included), a row per row.

    Links: 100 * intersection >= percent * union of the two sets. Documents without words link with nothing. Rows with
    the same doc_id are one document. A null doc_id links with nothing and has a null component.
    """
    texts, secret = docs.select("doc_id", "text"), secrets.randbits(64)
    sets = stored(texts.mapInArrow(_sizes(secret), _SETS))
    some = sets.where("n > 0 and doc_id is not null")
    # equal sets: a partial aggregate; only digests that several rows have come to the join, in salts
    equal = some.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c")
    salts = salt_count(docs.sparkSession)
    salted = equal.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    members = stored(
        sets.withColumn("salt", F.pmod(F.hash("doc_id"), F.lit(salts)))
        .join(salted, ["n", "d1", "d2", "salt"], "left")
        .select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep"))
    )
    largest = sets.agg(F.max("n")).first()[0] or 0
    edges = bands(largest, percent)
    number = sum((F.col("n") >= e).cast("int") for e in edges) - 1
    counts = dict(some.groupBy(number.alias("band")).count().collect())  # one row a band
    families = {b: family(edges[b], edges[b + 1] - 1, counts.get(b, 0) + counts.get(b + 1, 0), percent) for b in range(len(edges) - 1)}
    buckets = bucket_count(text_bytes(docs), PER_BUCKET, 12)
    keys = texts.mapInArrow(_index(edges, families, buckets, secret), _KEYS)
    groups = stored(keys.repartition(2 * buckets, "bucket").groupBy("bucket").applyInArrow(_groups, _GROUPS))
    # every set passes over its most frequent keys, as many as its family allows
    allowed = F.create_map(*[F.lit(x) for b, f in families.items() for x in (b, f.passed)])
    most = F.row_number().over(W.partitionBy("doc_id", "family").orderBy(F.desc("size"), "gid"))
    heavy = groups.where(F.col("size") > FREQUENT).withColumn("r", most).where(F.col("r") > F.element_at(allowed, F.col("family")))
    groups = groups.where(F.col("size") <= FREQUENT).select("gid", "doc_id", "whole").union(heavy.select("gid", "doc_id", "whole"))
    reps = members.where("rep is not null and n > 0").groupBy("doc_id").agg(F.min("rep").alias("rep"))
    g = groups.join(reps, "doc_id").groupBy("gid", "rep").agg(F.max("whole").alias("whole"))
    g = stored(g)
    several = g.groupBy("gid").agg(F.min("rep").alias("a"), F.max("rep").alias("z"), F.min(F.when(F.col("whole"), F.col("rep"))).alias("centre"))
    several = several.where("a <> z and centre is not null")
    g = stored(g.join(several.select("gid", "centre"), "gid"))
    wanted = g.select(F.col("rep").alias("doc_id")).distinct()
    arrays = stored(_only(texts, wanted).mapInArrow(_shingle_arrays(secret), "id long, shingles array<long>, sketch array<long>"))

    def beside(pairs: DataFrame, what: list) -> DataFrame:
        """The pairs with columns of both members: few pairs go to the arrays, the arrays of many pairs to the pairs."""
        pairs = F.broadcast(pairs) if pairs.count() <= BROADCAST_IDS else pairs
        one = arrays.select(F.col("id").alias("a"), *[c.alias(f"{n}a") for n, c in what]).join(pairs, "a")
        two = arrays.select(F.col("id").alias("b"), *[c.alias(f"{n}b") for n, c in what]).join(pairs, "b")
        return one.join(two, ["a", "b"])

    def linked(pairs: DataFrame) -> DataFrame:
        """The stored pairs (a, b) that are similar: those whose sketches allow it are compared as a whole."""
        near = beside(pairs, [("k", F.col("sketch")), ("n", F.size("shingles"))])
        width = F.least(F.size("ka"), F.size("kb"))

        def folded(c: str):
            half = F.zip_with(F.slice(c, 1, width), F.slice(c, width + 1, width), lambda x, y: x.bitwiseXOR(y))
            return F.when(F.size(c) > width, half).otherwise(F.col(c))

        odd = F.aggregate(F.zip_with(folded("ka"), folded("kb"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        sized = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
        allowed = (100 + percent) * odd <= (100 - percent) * (F.col("na") + F.col("nb"))
        near = stored(near.where(sized & allowed).select("a", "b").distinct())
        both = F.size(F.array_intersect("sa", "sb"))
        found = beside(near, [("s", F.col("shingles"))]).select("a", "b", both.alias("i"), (F.size("sa") + F.size("sb")).alias("t"))
        return found.where(100 * F.col("i") >= percent * (F.col("t") - F.col("i"))).select("a", "b").distinct()

    def pair(x: str, y: str) -> list:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    def labelled(rows: DataFrame, column: str, out: str) -> DataFrame:
        named = found.select(F.col("node").alias(column), F.col("component").alias(out))
        return rows.join(named, column, "left").withColumn(out, F.coalesce(out, column))

    star = stored(g.where("rep <> centre").groupBy("centre", "rep").count())
    ranked = star.withColumn("r", F.row_number().over(W.partitionBy("rep").orderBy(F.desc("count"), "centre")))
    tested = stored(ranked.where("r = 1").select(*pair("centre", "rep")).distinct())
    links = stored(linked(tested))
    found = components(links)
    # then every member and centre of a group that are not connected yet
    apart = labelled(labelled(star, "centre", "ca"), "rep", "cb").where("ca <> cb").select(*pair("centre", "rep")).distinct()
    more = stored(apart.join(tested, ["a", "b"], "left_anti"))
    tested = tested.union(more)
    links = stored(links.union(linked(more)))
    found = components(links)
    # and at last all members of a group that are in different components, by their sketches, inside tasks
    placed = labelled(g.select("gid", "rep", "whole"), "rep", "c")
    mixed = placed.groupBy("gid").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size")).where("lo <> hi")
    rows = stored(placed.join(mixed.select("gid", "size"), "gid").join(arrays.select(F.col("id").alias("rep"), "sketch", F.size("shingles").alias("n")), "rep"))
    # a group of several blocks: every block meets itself and every other once, each meeting on its own
    blocks = F.ceil(F.col("size") / MEETING).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks.cast("long")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    tasks = bucket_count(rows.count(), 20_000, 12)
    rows = rows.withColumn("task", F.pmod(F.xxhash64("gid", "low", "high"), F.lit(tasks)).cast("int"))
    near = rows.select("task", "gid", "low", "high", "own", "rep", "whole", "c", "n", "sketch").repartition(2 * tasks, "task").groupBy("task").applyInArrow(_near(percent), "a long, b long")
    rest = near.distinct().join(tested, ["a", "b"], "left_anti")
    last = stored(linked(stored(rest)))
    if not last.isEmpty():
        found = components(links.union(last))
    spread = labelled(members.where("n > 0"), "rep", "component_id").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = members.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return spread.union(empty)


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The documents whose id is their component's: of every group of similar documents one stays.

    Rows that repeat an id stay or go together.
    """
    gone = similar_documents(docs, percent).where("doc_id <> component_id").select("doc_id").distinct()
    return _only(docs, stored(gone), "left_anti")
