"""Exact removal of repeated byte strings by longest-previous-factor arrays over partitioned suffixes.

A byte goes if a string of ``width`` bytes over it also starts in a document with a smaller id; that is where the
longest previous factor of a suffix, counting earlier documents only, is at least ``width``. One suffix array of a
corpus is out of reach, but suffixes whose first ``width`` bytes differ never meet, so suffixes are dealt out by a value
of just those bytes: the smallest hash of the GRAM-byte strings in them (a minimizer). Neighbouring suffixes mostly
share it, so a stretch of them (a span) travels as one string.

1. Texts are dealt into blocks of documents by a hash of id and text. A block sends the distinct minimizers of its texts,
   four bytes each, and the 128-bit digests of whole texts, to buckets; those seen in two documents or more come back. The
   others cannot hold a repeated string.
2. A block sends the distinct spans of the minimizers that came back, each with the smallest document that has it. Whole
   copies of an earlier document are settled by their digest and send nothing.
3. A bucket orders the suffixes of its spans by their first ``width`` bytes, ties by document. Inside an interval whose
   longest common prefix is ``width`` or more, a previous or next smaller document in suffix order is an earlier match.
   Spans with such suffixes come back as bit masks.
4. A block marks the bytes, removes them and digests what is left.

A passage that very many documents share is one entry a block, however many documents of it have it. A minimizer that
stands in very many places (a common line goes on in a different way everywhere) is frequent: its spans are cut into
single suffixes, which are dealt out by all of their ``width`` bytes instead, so no bucket holds all of them. No step
holds more than a block or a bucket, whose sizes do not grow with the input. Spans are named by 64-bit hashes inside a
block or under one minimizer only, where a false match has a chance of some 1e-9 in a block of the largest size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bucket_count, text_bytes, tidy

U64 = np.uint64
GRAM = 20
#: Suffixes in a span; their bits fit an unsigned 64-bit mask.
SPAN = 32
#: Bytes of text handled at once, in a block of documents, and to a bucket.
CHUNK, BLOCK, BUCKET = 1 << 20, 12 << 20, 24 << 20
#: Places from which a minimizer is frequent.
FREQUENT = 20_000
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_NONE = np.iinfo(np.int64).max


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(31))) * U64(0xBF58476D1CE4E5B9)
    return h ^ (h >> U64(29))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS = [np.ones(1, U64), np.ones(1, U64)]


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums and inverse powers, from which the hash of any stretch of ``data`` follows (_stretch)."""
    if len(_POWERS[0]) <= len(data):
        n = max(CHUNK + 1, len(data) + 1)
        _POWERS[:] = [_powers(_ODD, n), _powers(_INVERSE, n)]
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * _POWERS[0][: len(data)], out=sums[1:])
    return sums, _POWERS[1]


def _stretch(sums: np.ndarray, inverse: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return _mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def _minimizers(data: np.ndarray, width: int) -> np.ndarray:
    """For every start of a ``width``-byte string the smallest hash of the GRAM-byte strings in it."""
    h, step, mult, parts = data.astype(U64) + U64(1), 1, _ODD, []
    while True:
        if GRAM & step:
            parts.append((step, mult, h))
        if step * 2 > GRAM:
            break
        h = h[: len(h) - step] * U64(mult) + h[step:]
        mult, step = mult * mult % (1 << 64), step * 2
    done, out = 0, None
    for size, mult, h in reversed(parts):
        n = len(data) - done - size + 1
        out = h[:n] if out is None else out[:n] * U64(mult) + h[done : done + n]
        done += size
    out, w, step = _mix(out), width - GRAM + 1, 1
    while step * 2 <= w:
        out = np.minimum(out[: len(out) - step], out[step:])
        step *= 2
    return np.minimum(out[: len(out) - (w - step)], out[w - step :]) if step < w else out


def _runs(data: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of documents data[bounds[i]:bounds[i + 1]]: minimizer, first start, number of starts (at most SPAN)."""
    if len(data) < width:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = _minimizers(data, width)
    ok = np.zeros(len(least) + 2, bool)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= width:
            ok[a + 1 : b - width + 2] = True
    new = ok[1:-1].copy()
    new[1:] &= (least[1:] != least[:-1]) | ~ok[1:-2]
    start = np.flatnonzero(new)
    last = np.flatnonzero(ok[1:-1] & ~ok[2:])  # the last start of every document
    stop = np.append(start[1:], len(least))
    ends = np.searchsorted(last, start)
    count = np.minimum(stop, last[ends] + 1 if len(last) else stop) - start
    if len(count) and count.max() > SPAN:  # periodic text: same minimizer, same bucket, so any cut will do
        pieces = -(-count // SPAN)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start, count = np.repeat(start, pieces) + nth * SPAN, np.repeat(count, pieces) - nth * SPAN
        count = np.minimum(count, SPAN)
    return least[start], start, count


class _Texts:
    """Documents of a block, taken CHUNK bytes at a time."""

    def __init__(self, table: pa.Table):
        self.ids = np.array([_NONE if i is None else i for i in table.column("doc_id").to_pylist()], np.int64)
        self.texts = [t.encode() if t else b"" for t in table.column("text").to_pylist()]

    def chunks(self, skip: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(numbers of the documents, their bytes, bounds)"""
        some, size = [], 0
        for i, t in enumerate(self.texts):
            if skip is not None and skip[i]:
                continue
            some.append(i)
            size += len(t)
            if size >= CHUNK:
                yield self._chunk(some)
                some, size = [], 0
        if some:
            yield self._chunk(some)

    def _chunk(self, some: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = [self.texts[i] for i in some]
        return np.array(some), np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def _first_docs(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys sorted, the smallest id of each, whether a key has two ids or more, and how often it is there."""
    order = np.lexsort((ids, keys))
    k, i = keys[order], ids[order]
    head = np.ones(len(k), bool)
    head[1:] = k[1:] != k[:-1]
    at = np.flatnonzero(head)
    if not len(at):
        return k, i, head, np.zeros(0, np.int64)
    return k[at], i[at], np.maximum.reduceat(i, at) != i[at], np.diff(np.append(at, len(k)))


_DIGEST = np.dtype("S16")
_SENT = "bucket int, block int, kind int, data binary, docs binary"
_BACK = "block int, kind int, data binary, docs binary"


def _digest_keys(texts: _Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the document, 128-bit digest) of texts that can be removed."""
    long = np.array([len(t) >= width for t in texts.texts], bool)
    d = np.frombuffer(b"".join(hashlib.blake2b(t, digest_size=16).digest() for t, ok in zip(texts.texts, long) if ok), _DIGEST)
    return np.flatnonzero(long), d


def _half(digests: np.ndarray) -> np.ndarray:
    """The first eight bytes of every digest as a number."""
    return np.frombuffer(digests.tobytes(), U64)[::2]


def _send(width: int, buckets: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        texts, block = _Texts(table), key[0].as_py() if hasattr(key[0], "as_py") else key[0]
        hashes, ids = [], []
        for some, data, bounds in texts.chunks():
            h, start, _ = _runs(data, bounds, width)
            hashes.append(h)
            ids.append(texts.ids[some[np.searchsorted(bounds, start, "right") - 1]])
        h, _, many, often = _first_docs(np.concatenate(hashes or [np.zeros(0, U64)]), np.concatenate(ids or [np.zeros(0, np.int64)]))
        rows = []
        to, low, often = (h >> U64(32)) % U64(buckets), h.astype(np.uint32), often.astype(np.uint32)
        for kind, which in ((0, ~many), (1, many)):
            for b, x in _by_bucket(to, np.flatnonzero(which)):
                rows.append((b, block, kind, low[x].tobytes(), often[x].tobytes() if kind else b""))
        number, digest = _digest_keys(texts, width)
        d, first, _, _ = _first_docs(digest, texts.ids[number])
        for b, x in _by_bucket(_half(d) % U64(buckets), np.arange(len(d))):
            rows.append((b, block, 2, d[x].tobytes(), first[x].tobytes()))
        return _table(rows, _SENT)

    return run


def _by_bucket(to: np.ndarray, some: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, those of ``some`` that go to it) for the buckets that are there; the order inside a bucket stays."""
    some = some[np.argsort(to[some], kind="stable")]
    head = np.flatnonzero(np.append(True, to[some][1:] != to[some][:-1])) if len(some) else np.zeros(0, np.int64)
    for a, b in zip(head, np.append(head[1:], len(some))):
        yield int(to[some[a]]), some[a:b]


def _table(rows: list[tuple], schema: str) -> pa.Table:
    tidy()
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"int": pa.int32(), "binary": pa.binary(), "long": pa.int64(), "string": pa.string()}[c.split()[1]] for c in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def _seen_twice(most: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        kinds, blocks = table.column("kind").to_pylist(), table.column("block").to_pylist()
        data, docs, bucket = table.column("data").to_pylist(), table.column("docs").to_pylist(), table.column("bucket")[0].as_py()
        low = [(i, np.frombuffer(data[i], np.uint32)) for i, k in enumerate(kinds) if k < 2]
        values, at = np.unique(np.concatenate([v for _, v in low] or [np.zeros(0, np.uint32)]), return_inverse=True)
        # one place each where a block has one document only
        places = [np.frombuffer(docs[i], np.uint32) if kinds[i] else np.ones(len(v), np.uint32) for i, v in low]
        total = np.bincount(at, np.concatenate(places or [np.zeros(0, np.uint32)]), len(values))
        twice, frequent = values[total > 1], values[total >= most]
        by_block: dict[int, list[np.ndarray]] = {}
        for i, v in low:
            by_block.setdefault(blocks[i], []).append(v[np.isin(v, twice, assume_unique=True)])
        rows = []
        for b, v in by_block.items():
            v = np.concatenate(v)
            rows.append((b, bucket, v.tobytes(), np.isin(v, frequent, assume_unique=True).tobytes()))
        own = [(blocks[i], np.frombuffer(data[i], _DIGEST), np.frombuffer(docs[i], np.int64)) for i, k in enumerate(kinds) if k == 2]
        if own:
            d, first, _, _ = _first_docs(np.concatenate([x for _, x, _ in own]), np.concatenate([y for _, _, y in own]))
            for b, x, y in own:
                least = first[np.searchsorted(d, x)]
                if (least < y).any():
                    rows.append((b, -1, x[least < y].tobytes(), least[least < y].tobytes()))
        return _table(rows, _BACK)

    return run


class _Block:
    """What a block knows once its repeated minimizers have come back: whole copies, and the spans to compare."""

    def __init__(self, table: pa.Table, back: pa.Table, width: int, buckets: int):
        self.texts, self.width = _Texts(table), width
        kinds, data, docs = (back.column(c).to_pylist() for c in ("kind", "data", "docs"))
        known = [np.frombuffer(x, np.uint32).astype(U64) + (U64(k) << U64(32)) for k, x in zip(kinds, data) if k >= 0]
        self.known, at = np.unique(np.concatenate(known or [np.zeros(0, U64)]), return_index=True)
        self.frequent = np.concatenate([np.frombuffer(y, bool) for k, y in zip(kinds, docs) if k >= 0] or [np.zeros(0, bool)])[at]
        self.buckets = buckets
        number, digest = _digest_keys(self.texts, width)
        d, first, _, _ = _first_docs(digest, self.texts.ids[number])
        for k, x, y in zip(kinds, data, docs):
            if k == -1:
                at = np.searchsorted(d, np.frombuffer(x, _DIGEST))
                first[at] = np.minimum(first[at], np.frombuffer(y, np.int64))
        self.copy = np.zeros(len(self.texts.ids), bool)
        if len(number):
            self.copy[number] = self.texts.ids[number] > first[np.searchsorted(d, digest)]

    def spans(self) -> Iterator[tuple]:
        """(document numbers, data, bounds, minimizer, hash, start, count, id, what it is dealt by) of the spans that may be
        repeated; those of frequent minimizers are single suffixes, dealt by their hash."""
        for some, data, bounds in self.texts.chunks(self.copy):
            h, start, count = _runs(data, bounds, self.width)
            key = ((h >> U64(32)) % U64(self.buckets) << U64(32)) + (h & U64(0xFFFFFFFF))
            at = np.minimum(np.searchsorted(self.known, key), max(len(self.known) - 1, 0))
            keep = self.known[at] == key if len(self.known) else np.zeros(len(key), bool)
            often = self.frequent[at[keep]] if len(self.known) else np.zeros(0, bool)
            h, start, count = h[keep], start[keep], count[keep]
            if often.any():
                pieces = np.where(often, count, 1)
                nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                h, often, start, count = (np.repeat(x, pieces) for x in (h, often, start, count))
                start, count = start + nth, np.where(often, 1, count)
            sums, inverse = _sums(data)
            content = _stretch(sums, inverse, start, start + count + self.width - 1)
            ids = self.texts.ids[some[np.searchsorted(bounds, start, "right") - 1]]
            yield some, data, bounds, h, content, start, count, ids, np.where(often, content, h)


_SPANS = "bucket int, block int, classes binary, contents binary, docs binary, counts binary, data binary"
_MASKS = "block int, kind int, data binary, docs binary"


def _cut(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``data`` one after the other."""
    shift = np.repeat(start - (np.cumsum(size) - size), size)
    return data[np.arange(len(shift)) + shift]


def _send_spans(width: int, buckets: int, span_buckets: int):
    def run(key: tuple, table: pa.Table, back: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table([], _SPANS)
        block = table.column("block")[0].as_py()
        parts = []
        for _, data, _, h, content, start, count, ids, deal in _Block(table, back, width, buckets).spans():
            order = np.lexsort((ids, content))
            head = np.ones(len(order), bool)
            head[1:] = content[order][1:] != content[order][:-1]
            one = np.sort(order[head])
            size = count[one] + width - 1
            first = ids[order[head]][np.argsort(order[head], kind="stable")]
            parts.append((h[one], content[one], first, count[one], _cut(data, start[one], size), deal[one]))
        rows = []
        if parts:
            h, content, ids, count, deal = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 2, 3, 5))
            data = np.concatenate([p[4] for p in parts])
            size = count + width - 1
            at = np.cumsum(size) - size
            order = np.lexsort((ids, content))  # the same content in two chunks: the smaller id, once
            head = np.ones(len(order), bool)
            head[1:] = content[order][1:] != content[order][:-1]
            for b, x in _by_bucket((deal >> U64(8)) % U64(span_buckets), order[head]):
                rows.append((b, block, h[x].tobytes(), content[x].tobytes(), ids[x].tobytes(), count[x].astype(np.uint8).tobytes(), _cut(data, at[x], size[x]).tobytes()))
        return _table(rows, _SPANS)

    return run


def earlier_factor(data: np.ndarray, starts: np.ndarray, docs: np.ndarray, groups: np.ndarray, width: int) -> np.ndarray:
    """Whether the suffix at each start has a previous factor of ``width`` bytes or more in a smaller document.

    The suffixes are sorted by group and their first ``width`` bytes (big-endian words), then by document. An interval of
    longest common prefix >= ``width`` ends where a word or the group differs from the suffix before. A suffix has a
    previous (next) smaller document in the interval if the least document before (after) it there is smaller.
    """
    if not len(starts):
        return np.zeros(0, bool)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = []
    for at in range(0, width, 8):
        take = min(8, width - at)
        w = np.zeros(len(starts), U64)
        for j in range(take):
            w = (w << U64(8)) | padded[starts + at + j].astype(U64)
        words.append(w)
    _, rank = np.unique(docs, return_inverse=True)
    order = np.lexsort((rank, *reversed(words), groups))
    new = np.ones(len(order), bool)
    new[1:] = groups[order][1:] != groups[order][:-1]
    for w in words:
        w = w[order]
        new[1:] |= w[1:] != w[:-1]
    interval = np.cumsum(new) - 1
    n = int(rank.max()) + 1
    # documents offset so that every later (earlier, from behind) interval lies below all before it
    before = np.minimum.accumulate(rank[order] - interval * n) + interval * n
    after = (np.minimum.accumulate((rank[order] - (interval[-1] - interval) * n)[::-1]) + ((interval[-1] - interval) * n)[::-1])[::-1]
    out = np.zeros(len(order), bool)
    out[order] = (before < rank[order]) | (after < rank[order])
    return out


def _match(width: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        blocks = table.column("block").to_pylist()
        of = lambda c, t: [np.frombuffer(x, t) for x in table.column(c).to_pylist()]
        h, content, docs, counts = of("classes", U64), of("contents", U64), of("docs", np.int64), of("counts", np.uint8)
        owner = np.repeat(np.arange(len(blocks)), [len(x) for x in h])
        h, content, docs, counts = (np.concatenate(x) for x in (h, content, docs, counts))
        counts = counts.astype(np.int64)
        data = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("data").to_pylist()])
        size = counts + width - 1
        at = np.cumsum(size) - size
        everything = np.where(counts >= 64, ~U64(0), (U64(1) << counts.astype(U64)) - U64(1))
        order = np.lexsort((docs, content, h))
        c, g = content[order], h[order]
        head = np.ones(len(order), bool)
        head[1:] = (c[1:] != c[:-1]) | (g[1:] != g[:-1])
        which = np.cumsum(head) - 1  # distinct contents, in order
        one = order[head]  # of each the entry with the smallest document
        masks = np.zeros(len(order), U64)
        later = docs[order] > docs[one][which]
        masks[order[later]] = everything[order[later]]
        # contents that are alone with their minimizer have nothing else to meet
        group = np.cumsum(np.append(True, h[one][1:] != h[one][:-1])) - 1
        shared = np.bincount(group)[group] > 1
        some = one[shared]
        if len(some):
            starts = np.repeat(at[some], counts[some]) + np.arange(counts[some].sum()) - np.repeat(np.cumsum(counts[some]) - counts[some], counts[some])
            hit = earlier_factor(data, starts, np.repeat(docs[some], counts[some]), np.repeat(group[shared], counts[some]), width)
            nth = starts - np.repeat(at[some], counts[some])
            bits = np.add.reduceat(hit.astype(U64) << nth.astype(U64), np.cumsum(counts[some]) - counts[some])
            of_content = np.zeros(len(one), U64)
            of_content[shared] = bits
            first = ~later & (docs[order] == docs[one][which])
            masks[order[first]] |= of_content[which[first]]
        rows = []
        for i, b in enumerate(blocks):
            x = np.flatnonzero((owner == i) & (masks != 0)) if len(blocks) < 4 else np.arange(*np.searchsorted(owner, [i, i + 1]))
            x = x[masks[x] != 0]
            if len(x):
                rows.append((b, -2, content[x].tobytes(), masks[x].tobytes()))
        return _table(rows, _MASKS)

    return run


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _remove(width: int, buckets: int, kept):
    def run(key: tuple, table: pa.Table, back: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table([], f"{_OUT[:-6]}{kept[1]}")
        kinds = np.array(back.column("kind").to_pylist(), np.int64)
        block = _Block(table, back.filter(pa.array(kinds >= -1)), width, buckets)
        masked = back.filter(pa.array(kinds == -2))
        contents = np.concatenate([np.frombuffer(x, U64) for x in masked.column("data").to_pylist()] or [np.zeros(0, U64)])
        masks = np.concatenate([np.frombuffer(x, U64) for x in masked.column("docs").to_pylist()] or [np.zeros(0, U64)])
        order = np.argsort(contents)
        contents, masks = contents[order], masks[order]
        parts = [(p[4], p[7]) for p in block.spans()]  # content, id
        content, first, _, _ = _first_docs(np.concatenate([p[0] for p in parts] or [np.zeros(0, U64)]), np.concatenate([p[1] for p in parts] or [np.zeros(0, np.int64)]))
        texts = block.texts
        n = np.array([len(t) for t in texts.texts], np.int64)
        removed, spans = np.where(block.copy, n, 0), block.copy.astype(np.int64)
        left: list = [b"" if c else t for c, t in zip(block.copy, texts.texts)]
        for some, data, bounds, _, c, start, count, ids, _ in block.spans():
            if not len(c):
                continue
            mask = np.zeros(len(c), U64)
            if len(contents):
                at = np.minimum(np.searchsorted(contents, c), len(contents) - 1)
                mask = np.where(contents[at] == c, masks[at], U64(0))
            mask = np.where(ids > first[np.searchsorted(content, c)], ~U64(0), mask)
            go = np.flatnonzero(mask)
            if not len(go):
                continue
            window = np.repeat(start[go] - (np.cumsum(count[go]) - count[go]), count[go]) + np.arange(count[go].sum())
            bit = window - np.repeat(start[go], count[go])
            window = window[(np.repeat(mask[go], count[go]) >> bit.astype(U64)) & U64(1) != 0]
            edge = np.zeros(len(data) + 1, np.int64)
            np.add.at(edge, window, 1)
            np.subtract.at(edge, window + width, 1)
            gone = np.cumsum(edge[:-1]) > 0
            where = np.unique(np.searchsorted(bounds, window, "right") - 1)
            for w in where.tolist():
                a, b = bounds[w], bounds[w + 1]
                g = gone[a:b]
                i = some[w]
                removed[i] = np.count_nonzero(g)
                spans[i] = np.count_nonzero(g[1:] & ~g[:-1]) + g[0]
                left[i] = data[a:b][~g].tobytes()
        ids = table.column("doc_id").to_pylist()
        return _table(list(zip(ids, n.tolist(), removed.tolist(), spans.tolist(), map(kept[0], left))), f"{_OUT[:-6]}{kept[1]}")

    return run


def remove_repeats(docs: DataFrame, width: int = 50, digest: bool = False, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and ``kept`` (the bytes that stay, or with ``digest`` their SHA-256 in hex).

    Null texts are empty. Documents with the same id are the same document: they take nothing from each other. A null id
    comes after all others. Texts under ``width`` bytes lose nothing. An empty table gives an empty result. ``frequent``
    is the number of places from which a minimizer's suffixes are dealt out one by one.
    """
    if width < GRAM + 4 or width - GRAM + 1 > SPAN:
        raise ValueError(f"width must be from {GRAM + 4} to {GRAM + SPAN - 1}")
    total = text_bytes(docs)
    blocks, buckets = bucket_count(total, BLOCK, 6), bucket_count(total, BUCKET, 12)
    key = F.pmod(F.xxhash64(F.lit(41), "doc_id", F.xxhash64("text")), F.lit(blocks)).cast("int")
    # partitions by the number of blocks and buckets, so that a task never gets more of them as the input grows
    by_block = docs.select("doc_id", "text", key.alias("block")).repartition(2 * blocks, "block").groupBy("block")
    dealt = lambda df, by, n: df.repartition(2 * n, by).groupBy(by)
    sent = by_block.applyInArrow(_send(width, buckets), _SENT)
    back = dealt(sent, "bucket", buckets).applyInArrow(_seen_twice(frequent), _BACK)
    spans = by_block.cogroup(dealt(back, "block", blocks)).applyInArrow(_send_spans(width, buckets, buckets), _SPANS)
    masks = dealt(spans, "bucket", buckets).applyInArrow(_match(width), _MASKS)
    kept = (lambda b: hashlib.sha256(b).hexdigest(), "string") if digest else (bytes, "binary")
    out = by_block.cogroup(dealt(back.union(masks), "block", blocks)).applyInArrow(_remove(width, buckets, kept), f"{_OUT[:-6]}{kept[1]}")
    return out
