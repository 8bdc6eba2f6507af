"""Decontamination, hard negatives and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, negatives, resampling
from tests.llm import helpers as h

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# ---- decontamination


def bench(spark, data, extra=False):
    df = spark.createDataFrame(data, "item_id long, text string")
    for name in ("row", "term", "p", "pos", "n", "found", "words", "doc_id") if extra else ():
        df = df.withColumn(name, F.lit("clash"))
    return df


def contaminated(docs, items, width=10, near_words=5, within=20):
    parsed = [("" if i is None else str(i), words(t)) for i, t in items]
    freq = Counter(w for _, t in docs for w in words(t))
    out = []
    for doc_id, text in docs:
        w = words(text)
        at = defaultdict(list)
        for n in {min(width, len(b)) for _, b in parsed if b}:
            for k in range(len(w) - n + 1):
                at[tuple(w[k : k + n])].append(k)
        hit, found, close = set(), set(), set()
        for item, b in parsed:
            n = min(width, len(b))
            for k in range(len(b) - n + 1 if b else 0):
                for p in at[tuple(b[k : k + n])]:
                    hit |= set(range(p, p + n))
                    found.add(item)
            rare = set(sorted((x for x in set(b) if freq[x]), key=lambda x: (freq[x], x.encode()))[:near_words])
            if rare and any(w[k] in rare and rare <= set(w[k : k + within]) for k in range(len(w))):
                close.add(item)
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit), len(close)))
    return sorted(out, key=str)


def benchmark_case():
    rng = random.Random(5)
    long = h.prose(60, 31)
    passage = long.split()
    shuffled = passage[10:24]
    rng.shuffle(shuffled)
    items = [
        (1, long), (2, long), (None, h.prose(25, 32)), (3, "of the"), (4, ""), (5, None), (6, "..., !"), (7, "É ÉCOLE naïve Zürich 東京 é école Naïve zürich 東京 x y"),
        (8, "the the the the the the the the the the the the"), (9, h.prose(12, 2)), (10, "never seen " + h.prose(12, 33)), (3, h.prose(14, 34)), (11, "alone"), (12, "absent"),
    ]
    docs = [
        *h.awkward_texts(), (100, "Start. " + long.upper() + " end"), (101, " ".join(passage[5:14])), (102, " ".join(passage[5:15])), (103, "  ".join([*passage[:20], "x", *passage[20:40]])),
        (104, "the " * 40), (105, "school É école NAÏVE zürich 東京 é école naïve Zürich 東京 X y"), (106, "é école naïve zürich"), (107, " ".join(shuffled)), (None, long), (None, None), (100, long), (100, long),
        (108, h.prose(8000, 40) + " " + long + " " + h.prose(8000, 41)), (109, "alone"), (110, (" ".join(passage[:11]) + " ") * 300), (111, h.prose(25, 32) + long), (112, "w" * 100_000),
    ]
    return docs, items


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_contamination_matches_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", most)
    docs, items = benchmark_case()
    got = decontaminate.contamination(h.documents(spark, docs, True), bench(spark, items, True))
    assert sorted(map(tuple, got.collect()), key=str) == contaminated(docs, items)


@pytest.mark.parametrize("width,near_words,within", [(1, 1, 1), (3, 2, 4), (25, 30, 40)])
def test_contamination_of_other_widths(spark, width, near_words, within):
    docs, items = benchmark_case()
    got = decontaminate.contamination(h.documents(spark, docs), bench(spark, items), width=width, near_words=near_words, near_within=within)
    assert sorted(map(tuple, got.collect()), key=str) == contaminated(docs, items, width, near_words, within)


def test_contamination_of_empty_tables(spark):
    docs, items = benchmark_case()
    assert decontaminate.contamination(h.documents(spark, []), bench(spark, items)).collect() == []
    for none in ([], [(1, None), (2, "!")]):
        got = decontaminate.contamination(h.documents(spark, docs), bench(spark, none)).collect()
        assert sorted(map(tuple, got), key=str) == contaminated(docs, none)


def test_contamination_has_no_python_on_its_path(spark):
    docs, items = benchmark_case()
    plan = decontaminate.contamination(h.documents(spark, docs), bench(spark, items))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# ---- hard negatives


def embeddings(spark, data, extra=False):
    df = spark.createDataFrame(data, "vec_id long, label int, embedding array<float>")
    for name in ("parts", "score", "rank", "block", "anchor", "window") if extra else ():
        df = df.withColumn(name, F.lit("clash"))
    return df


def mined(data, every, factor=256, positives=5, negs=10, low=30, high=90):
    rows = []
    for i, label, v in data:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            rows.append((i, label, [math.floor(factor * float(np.float32(x))) for x in v]))
    key = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for n, (i, label, v) in enumerate(rows):
        if i is None or i % every:
            continue
        scored = [(sum(a * b for a, b in zip(v, u)), j, other) for m, (j, other, u) in enumerate(rows) if m != n]
        for score, j, _ in sorted((s for s in scored if s[2] == label), key=key)[:positives]:
            hard = sorted((s for s in scored if s[2] != label and low * score <= 100 * s[0] <= high * score), key=key)[:negs]
            out += [(i, j, rank, k, score, s) for rank, (s, k, _) in enumerate(hard, 1)]
    return sorted(out, key=str)


def vectors(seed, n, dims=8, labels=4):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(labels)]
    return [(i, k := rng.randrange(labels), [0.6 * c + 0.4 * rng.gauss(0, 1) for c in centre[(k + (i % 5 == 0)) % labels]]) for i in range(n)]


AWKWARD = [
    (None, 1, [0.5] * 8), (0, None, [1.0] * 8), (10, 2, None), (20, 1, [1.0, None] + [0.0] * 6), (30, 1, [float("nan")] * 8), (40, 1, [float("inf")] * 8),
    (50, 0, [0.25] * 8), (50, 0, [0.25] * 8), (50, 0, [0.25] * 8), (50, 1, [0.5] * 8), (60, 0, [0.0] * 8), (70, 1, []), (80, 2, [0.3] * 3), (-10, 1, [-0.5] * 8), (90, 9, [0.1] * 8),
]


@pytest.mark.parametrize("block", [8192, 7])
def test_hard_negatives_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "CELLS", 1 << 9)
    copies = [(1000 + i, i % 3, [0.5, 0.25] * 4) for i in range(90)]  # ties by the dozen
    data = vectors(1, 400) + AWKWARD + copies + [(1000, 0, [0.5, 0.25] * 4)]
    got = negatives.mine(embeddings(spark, data, True).repartition(5), F.col("vec_id") % 10 == 0, block=block)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect()), key=str) == mined(data, 10)


def test_hard_negatives_of_few_rows(spark):
    mine = lambda data, **k: sorted(map(tuple, negatives.mine(embeddings(spark, data), F.col("vec_id") % 10 == 0, **k).collect()), key=str)
    assert mine([]) == [] and mine([(1, 1, [1.0])]) == [] and mine([(0, 1, [1.0])]) == []
    assert mine([(0, 1, [1.0]), (3, 1, [1.0])]) == []  # a positive, but no negative
    two = [(0, 1, [1.0]), (3, 1, [1.0]), (4, 2, [0.5]), (5, 2, [0.95]), (6, 2, [0.2]), (7, 2, [0.9])]
    assert mine(two) == mined(two, 10) and [r[3] for r in mine(two)] == [7, 4]
    zero = [(0, 1, [1.0, 0.0]), (3, 1, [0.0, 1.0]), (4, 2, [0.0, 3.0]), (5, 2, [1.0, 0.0]), (6, 2, [-1.0, 0.0])]
    assert mine(zero) == mined(zero, 10) == [(0, 3, 1, 4, 0, 0)]  # a positive score of 0 has a window of one score
    assert mine(two, positives=1, negatives=1, low=0, high=100) == mined(two, 10, positives=1, negs=1, low=0, high=100)
    with pytest.raises(ValueError, match="exact"):
        mine([(0, 1, [1e12]), (1, 1, [1e12])])


# ---- importance resampling


def resampled(docs, target, buckets=10_000, order=2, percent=25, least=20, seed=7):
    def features(text):
        w = words(text)
        runs = [" ".join(w[k : k + n]) for n in range(1, order + 1) for k in range(len(w) - n + 1)]
        return [zlib.crc32(x.encode()) % buckets for x in runs]

    pool, aim = Counter(b for _, t in docs for b in features(t)), Counter(b for t in target for b in features(t))
    s_all, t_all = pool.total() + buckets, aim.total() + buckets
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * s_all / ((pool[b] + 1) * t_all))) for b in pool}
    rows = []
    for i, t in docs:
        f = features(t)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        u = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((u + 0.5) / 4294967296))), len(words(t))))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = able[: percent * len(able) // 100]
    rest = Counter(rows) - Counter(drawn)
    return sorted([(*r[:4], n) for n, r in enumerate(drawn, 1)] + [(*r[:4], None) for r in rest.elements()], key=str)


def pool():
    rng = random.Random(9)
    texts = [" ".join(rng.choice(h.WORDS[: 4 + i % 21]) for _ in range(rng.randrange(60))) for i in range(300)]
    odd = [(500, "É école " * 30), (501, "日本語 テキスト " * 30), (502, "A-b_c\x7fd\u0080e " * 20), (503, "x" * 70 + " " + "y" * 5000 + " z" * 30), (504, "q " * 40_000), (505, "İ ı ß 0 9 " * 9)]
    return list(enumerate(texts)) + odd + [(600, texts[7])] * 40 + [(None, texts[8])] * 30 + [(None, None), (601, None), (602, "")] + h.awkward_texts()


@pytest.mark.parametrize("percent,buckets,order", [(25, 10_000, 2), (100, 50, 1), (3, 1000, 3), (0, 10_000, 2)])
def test_resampling_matches_brute_force(spark, monkeypatch, percent, buckets, order):
    monkeypatch.setattr(resampling, "EQUAL_ROWS", 7)
    monkeypatch.setattr(resampling, "CHUNK_BYTES", 2000)
    docs, target = pool(), [h.prose(50, 3), None, "alpha beta gamma alpha", "École"]
    got = resampling.resample(h.documents(spark, docs, True).repartition(6), bench(spark, list(enumerate(target)), True), percent=percent, buckets=buckets, order=order)
    assert sorted(map(tuple, got.collect()), key=str) == resampled(docs, target, buckets, order, percent)


def test_resampling_of_ties_and_empty_tables(spark):
    target = bench(spark, [(1, h.prose(50, 3))])
    assert resampling.resample(h.documents(spark, []), target).collect() == []
    docs = [(5, h.prose(30, 1))] * 9 + [(6, h.prose(30, 1))] * 3
    for t in ([], [(1, h.prose(50, 3))]):
        got = resampling.resample(h.documents(spark, docs), bench(spark, t), percent=50).collect()
        assert sorted(map(tuple, got), key=str) == resampled(docs, [x for _, x in t], percent=50)
    assert [r["rank"] for r in resampling.resample(h.documents(spark, [(1, "a b"), (2, None)]), target).collect()] == [None, None]


def test_resampling_draws_the_target(spark):
    """A pool of two kinds of text, a target of one of them: the draw is mostly of that kind, but not only."""
    rng = random.Random(3)
    kind = {0: "alpha beta gamma delta epsilon".split(), 1: "rho sigma tau omicron pi".split()}
    text = lambda k: " ".join(rng.choice(kind[k if rng.random() < 0.8 else 1 - k]) for _ in range(30))
    docs = [(i, text(i % 2)) for i in range(800)]
    got = resampling.resample(h.documents(spark, docs), bench(spark, [(i, text(1)) for i in range(100)])).where("rank is not null").collect()
    assert len(got) == 200 and 0.58 < sum(r["doc_id"] % 2 for r in got) / 200 < 0.9
