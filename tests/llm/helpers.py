"""Small awkward tables, and brute-force versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

WORDS = "the of and to in alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(n: int, seed: int, words=WORDS) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))


def awkward_texts() -> list[tuple]:
    """(doc_id, text): copies, near copies, shared passages, empty, null, tiny, periodic, non-Latin and long texts."""
    base, passage = prose(120, 1), prose(40, 2)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    rows = [
        (1, base), (2, base), (3, near), (5, " ".join([*near.split()[:100], "other", "end"])), (7, prose(30, 3) + " " + passage + " " + prose(30, 4)),
        (8, prose(20, 5) + " " + passage), (9, passage), (10, ""), (11, None), (12, "a"), (13, "ab" * 400), (14, "b" + "ab" * 90), (15, "ab" * 20),
        (16, "日本語のテキスト " * 30), (17, "日本語のテキスト " * 29 + "終"), (18, "\n\n \t"), (19, "One two three four"), (20, "one TWO three FOUR"),
        (21, prose(6000, 6)), (22, prose(6000, 6) + " tail"), (23, "É " * 60), (24, "é " * 60), (4, base.upper()), (25, "x y z w v u"), (26, "<|endoftext|> it's don't ''s İ Σας é"),
        (0, prose(15, 7)), (40, "line one is here\nline two is here\nend"), (41, "first\nline one is here\nline two is here\nother line with five words"),
        (42, "other line with five words\nother line with five words\na\nb\nc"), (43, "a\nb\nc\nlast"), (44, "a\n\nb\n \nc\nx"),
    ]
    return rows


def documents(spark, rows, extra: bool = False):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    full = [(i, t, "en" if (i or 0) % 2 else "de", "s", None if t is None else len(t)) for i, t in rows]
    df = spark.createDataFrame(full, schema)
    if extra:  # columns whose names operators might use themselves
        from pyspark.sql import functions as F

        for name in ("shard", "slot", "score", "predicted", "block", "bucket", "th", "gone", "n", "rep", "rank", "salt", "copies", "domain", "component_id", "id"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def repeats(rows, width=50):
    seen: dict[bytes, int] = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    big = 2**63 - 1
    key = lambda i: big if i is None else i
    for i, b in data:
        for p in range(len(b) - width + 1):
            s = b[p : p + width]
            seen[s] = min(seen.get(s, big), key(i))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if seen[b[p : p + width]] < key(i):
                gone[p : p + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def shingle_set(text) -> frozenset:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    return frozenset(tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4)))


def groups(rows):
    """(doc_id, set size, component) by comparing everything with everything."""
    sets, up = [(i, shingle_set(t)) for i, t in rows], {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    by = defaultdict(list)
    for i, s in sets:
        for x in s:
            by[x].append((i, s))
    for i, s in sets:
        for j, t in {(j, t) for x in s for j, t in by[x]}:
            both = len(s & t)
            if i is not None and j is not None and 100 * both >= 80 * (len(s) + len(t) - both):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [(i, len(s), None if i is None else root(i)) for i, s in sets]


def best_fit_decreasing(histogram, capacity):
    rooms, used = [0] * (capacity + 1), 0
    for n in sorted(histogram, reverse=True):
        for _ in range(histogram[n]):
            r = next((r for r in range(n, capacity + 1) if rooms[r]), None)
            if r is None:
                used, r = used + 1, capacity
            else:
                rooms[r] -= 1
            rooms[r - n] += 1
    return used
