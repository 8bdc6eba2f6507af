"""Trees, copies, curves, noise, alias tables, layouts and canvases on small awkward input, against serial versions."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import alias, assembly, compositing, copies, noise, splines, trees, weighted
from tessera.plans import blocks, channels, layout, prefixes

NODE = "tree long, node long, property long, split long, left long, right long"


# ---- trees


def chain(depth, tree=0):
    """A tree of one long branch: node 2 d splits x at d, its left child goes on."""
    rows = []
    for d in range(depth):
        rows += [(tree, 2 * d, 0, d, 2 * d + 2, 2 * d + 1), (tree, 2 * d + 1, -1, 0, None, None)]
    return [*rows, (tree, 2 * depth, -1, 0, None, None)]


@pytest.mark.parametrize("held", [1024, 0])
def test_leaves_of_a_deep_tree(spark, held):
    nodes = spark.createDataFrame([*chain(150), *chain(0, 1), (2, 0, 1, 5, 1, 2), (2, 1, -1, 0, None, None), (2, 2, -1, 0, None, None)], NODE)
    samples = spark.createDataFrame([(i, i % 4, i % 200, i % 11) for i in range(800)], "id long, tree long, a long, b int")
    got = {r["id"]: r["leaf"] for r in trees.leaves(samples, nodes, ["a", "b"], held).collect()}
    for i in range(800):
        tree, a, b = i % 4, i % 200, i % 11
        if tree < 3:
            want = (2 * a + 1 if a < 150 else 300) if tree == 0 else 0 if tree == 1 else 1 if b > 5 else 2
            assert got.pop(i) == want
    assert not got  # tree 3 has no nodes


def test_leaves_end_on_rings_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(trees, "TALLEST", 60)
    ring = spark.createDataFrame([(0, 0, 0, 5, 1, 2), (0, 1, 0, 5, 0, 0), (0, 2, 0, 5, 0, 0)], NODE)
    with pytest.raises(ValueError, match="walked"):
        trees.leaves(spark.createDataFrame([(0, 1)], "tree long, a long"), ring, ["a"])
    with pytest.raises(ValueError, match="two others"):
        trees.ranges(ring)
    with pytest.raises(ValueError, match="ring"):
        trees.ranges(spark.createDataFrame([(0, 0, 0, 5, 1, 2), (0, 1, 0, 5, 0, 3), (0, 2, -1, 0, None, None), (0, 3, -1, 0, None, None)], NODE))
    none = spark.createDataFrame([], "tree long, a long")
    assert trees.leaves(none, ring, ["a"]).collect() == []


def test_ranges_take_a_logarithm_of_rounds(spark, monkeypatch):
    calls, stored = [], trees.stored
    monkeypatch.setattr(trees, "stored", lambda df: calls.append(1) or stored(df))
    heights, bounds = trees.ranges(spark.createDataFrame(chain(130), NODE))
    assert len(calls) <= 2 * (math.ceil(math.log2(130)) + 1)
    assert {r["node"]: r["height"] for r in heights.collect()} == {0: 0} | {n: (n + 1) // 2 for n in range(1, 261)}
    low = {r["node"]: (r["lower"], r["upper"]) for r in bounds.collect()}
    assert low[260] == (130, 2**31 - 1) and low[1] == (-(2**31), 0) and low[101] == (50, 50)


def test_invalid_trees(spark):
    rows = [
        (0, 0, 0, 5, 1, 2), (0, 1, 0, 5, 3, 4), (0, 2, 0, 4, 5, 6), *[(0, n, -1, 0, None, None) for n in (3, 4, 5, 6)],  # above 5 there is no split at 5
        (1, 0, 0, 5, 1, 9), (1, 1, -1, 0, None, None), (1, 7, -1, 0, None, None),  # a child that is not there, and a node that nothing leads to
    ]
    got = {(r["tree"], r["node"]): r["valid"] for r in trees.validated(spark.createDataFrame(rows, NODE)).collect()}
    assert got == {(t, n): (t, n) not in ((0, 1), (1, 0), (1, 7)) for t, n, *_ in rows}


# ---- copies


def undone(tokens):
    out = []
    for literal, far, n in tokens:
        if literal is not None:
            out.append(literal)
            continue
        at = max(0, len(out) - far)
        for j in range(n):
            out.append(out[at + j] if at + j < len(out) else 0)
    return out


def test_copies_match_the_serial_form_in_few_rounds(spark, monkeypatch):
    rng = random.Random(4)
    streams = [[(rng.randrange(256), None, None) if rng.random() < 0.3 else (None, rng.randrange(1, 30), rng.randrange(0, 40)) for _ in range(60)] for _ in range(6)]
    streams += [[], [(None, 3, 4), (7, 0, 0), (None, 1, 9)], [(5, 1, 1)] + [(None, 1, 1)] * 500, [(1, 1, 1), (2, 1, 1), (None, 2, 5000)]]
    rows = [(s, i, *t) for s, tokens in enumerate(streams) for i, t in enumerate(tokens)]
    calls, stored = [], copies.stored
    monkeypatch.setattr(copies, "stored", lambda df: calls.append(1) or stored(df))
    got = {}
    for r in copies.resolved(copies.positions(spark.createDataFrame(rows, "stream long, idx long, literal long, distance long, length long"))).collect():
        got.setdefault(r["stream"], {})[r["pos"]] = r["v"]
    for s, tokens in enumerate(streams):
        want = undone(tokens)
        assert got.get(s, {}) == dict(enumerate(want))
    assert len(calls) <= 2 + math.ceil(math.log2(501))  # the longest chain has 500 links


def test_copies_of_nothing(spark):
    empty = spark.createDataFrame([], "stream long, idx long, literal long, distance long, length long")
    assert copies.resolved(copies.positions(empty)).collect() == []


# ---- splines


def points(spark, data):
    return spark.createDataFrame([(s, i, float(x), float(y)) for s, p in data.items() for i, (x, y) in enumerate(p)], "spline long, i long, x double, y double")


def test_curves_and_steps(spark):
    data = {1: [(0, 0), (10.25, 0)], 2: [(3, 4)], 3: [(0, 0), (3, 4)], 4: [(0, 0), (1, 5), (6, 6), (2, 9)]}
    line = splines.curve(points(spark, data))
    n = {r["spline"]: r["n"] for r in line.groupBy("spline").agg(F.max("n").alias("n")).collect()}
    assert n == {1: 16, 2: 0, 3: 16, 4: 48}
    at = {(r["spline"], r["n"]): (r["x"], r["y"]) for r in line.collect()}
    for s, p in data.items():
        assert all(at[s, 16 * i] == q for i, q in enumerate(p))  # the curve goes through its points
    steps = {}
    for r in splines.stepped(line).orderBy("spline", "k").collect():
        steps.setdefault(r["spline"], []).append((r["x"], r["y"], r["intensity"]))
    assert [round(x, 9) for x, _, _ in steps[1]] == [*range(11), 10.25] and round(steps[1][-1][2], 9) == 0.25
    assert steps[2] == [(3.0, 4.0, 1.0), (3.0, 4.0, 0.0)]
    far = [math.dist(a[:2], b[:2]) for a, b in zip(steps[4], steps[4][1:])]
    assert all(d <= 1 + 1e-9 for d in far) and sum(far) > 8


def test_equal_points_are_an_error(spark):
    with pytest.raises(Exception, match="identical successive"):
        splines.curve(points(spark, {1: [(0, 0), (1, 1), (1, 1)]})).collect()


def test_segments_are_drawn(spark):
    """From control points to a raster: light is highest on the line, none far from it; a spline of one point draws nothing."""
    line = splines.stepped(splines.curve(points(spark, {1: [(5, 8), (25, 8)], 2: [(3, 3)]})))
    flat = [1.0] + [0.0] * 31
    series = spark.createDataFrame([(1, [flat, [0.0] * 32, flat], flat), (2, [flat] * 3, flat)], "spline long, colours array<array<double>>, sigmas array<double>")
    found = splines.segments(line, series)
    assert {r["spline"] for r in found.collect()} == {1} and {r["channel"] for r in found.collect()} == {0, 1, 2}
    one = found.where("channel = 0").withColumn("img", F.col("spline"))
    lit = {(r["x"], r["y"]): r["v"] for r in assembly.draw(one, 40, 20).collect()}
    assert max(lit, key=lit.get)[1] == 8 and lit.get((15, 19), 0) < 0.01 * lit[15, 8] and lit.get((39, 8), 0) < 0.01 * lit[15, 8]


# ---- noise


def test_noise_matches_the_serial_generator():
    mask = 2**64 - 1
    state = noise.seeded(np.array([[1, 0, 16, 32]], np.uint64))
    s = [[int(a), int(b)] for a, b in state[0]]
    serial = []
    for _ in range(300):
        serial.append([(a + b) & mask for a, b in s])
        for lane in s:
            a, b = lane
            a ^= (a << 23) & mask
            lane[:] = [b, a ^ b ^ (a >> 18) ^ (b >> 5)]
    for steps in (0, 1, 2, 63, 64, 255, 299):
        far = noise.ahead(state, np.array([steps]))[0]
        assert [int(v) for v in far[:, 0] + far[:, 1]] == serial[steps]
    # one jump is as good as many: a distance that no loop would reach
    a = noise.ahead(noise.ahead(state, np.array([10**12])), np.array([7]))
    assert (a == noise.ahead(state, np.array([10**12 + 7]))).all()


def test_noise_planes(spark):
    groups = spark.createDataFrame([(1, 0, 0, 0, 33, 3), (1, 1, 256, 0, 16, 1), (2, 0, 0, 0, 1, 1)], "img long, grp long, x long, y long, gw long, gh long")
    got = noise.noise(groups).collect()
    assert len(got) == 3 * (99 + 16 + 1) == len({(r["img"], r["plane"], r["x"], r["y"]) for r in got})
    assert all(1 <= r["v"] < 2 for r in got) and 1.3 < sum(r["v"] for r in got) / len(got) < 1.7
    at = {(r["img"], r["plane"], r["x"], r["y"]): r["v"] for r in got}
    assert at[1, 0, 0, 0] == at[2, 0, 0, 0]  # seeded by the corner alone
    assert at[2, 1, 0, 0] == at[1, 0, 16, 0]  # the next batch of the same stream
    assert noise.noise(groups.where("img > 9")).collect() == []


# ---- alias tables


def stacked(own, room):
    """The serial form, with stacks: (cutoff, other, shift) of each entry."""
    n = len(own)
    cut, other, at = list(own), list(range(n)), [0] * n
    over, under = [i for i in range(n) if own[i] > room], [i for i in range(n) if own[i] < room]
    while over:
        o, u = over.pop(), under.pop()
        cut[o] -= room - cut[u]
        other[u], at[u] = o, cut[o]
        if cut[o] != room:
            (under if cut[o] < room else over).append(o)
    return [(0, i, 0) if cut[i] == room else (cut[i], other[i], at[i] - cut[i]) for i in range(n)]


def test_alias_tables_match_stacks_and_hold_their_masses(spark):
    rng = random.Random(8)
    dists = {}
    for d in range(40):
        size = rng.choice([1, 2, 5, 30, 64])
        cuts = sorted(rng.randrange(4097) for _ in range(size - 1))
        dists[d] = [b - a for a, b in zip([0, *cuts], [*cuts, 4096])]
    dists[40], dists[41], dists[42] = [64] * 64, [0, 0, 4096], [63, 65] * 32
    counts = spark.createDataFrame([(d, i, c) for d, own in dists.items() for i, c in enumerate(own) if c or d % 2], "dist long, entry long, count long")
    table = alias.table(counts)
    got = {(r["dist"], r["entry"]): (r["cutoff"], r["other"], r["shift"]) for r in table.collect()}
    for d, own in dists.items():
        own = own + [0] * (64 - len(own))
        want = [(0, own.index(4096), 64 * i) for i in range(64)] if 4096 in own else stacked(own, 64)
        assert [got[d, i] for i in range(64)] == want
    values = counts.select("dist").distinct().withColumn("value", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4095).cast("bigint"))))
    rows = alias.symbols(values, table).groupBy("dist", "symbol", "count").agg(F.count("*").alias("n"), F.countDistinct("place").alias("places"), F.max("place").alias("top"))
    mass = {(r["dist"], r["symbol"]): (r["n"], r["places"], r["top"] + 1, r["count"]) for r in rows.collect()}
    assert mass == {(d, i): (c, c, c, c) for d, own in dists.items() for i, c in enumerate(own) if c}


# ---- layouts


def test_blocks_cover_every_cell_once(spark):
    item = lambda *sizes: [{"bw": w, "bh": h} for w, h in sizes]
    groups = [(1, 4, 3, item((2, 2), (1, 1), (4, 4), *[(1, 1)] * 20)), (2, 3, 3, item((1, 1))), (3, 2, 0, item((1, 1))), (4, 1, 1, []), (5, 32, 32, item(*[(1, 2)] * 512))]
    df = spark.createDataFrame(groups, "group long, w long, h long, items array<struct<bw: bigint, bh: bigint>>")
    placed = blocks.laid_out(df)
    at = {(r["group"], r["n"]): (r["x"], r["y"]) for r in placed.collect()}
    assert [at[1, n] for n in range(3)] == [(0, 0), (2, 0), (3, 0)] and at[2, 0] == (0, 0) and not [k for k in at if k[0] in (3, 4)]
    assert len([k for k in at if k[0] == 5]) == 512
    cells = blocks.covers(placed, df).collect()
    assert len(cells) == len({(r["group"], r["x"], r["y"]) for r in cells})
    assert sorted(r["group"] for r in cells) == [1] * 12 + [2] + [5] * 1024
    assert all((r["x"] - r["dx"], r["y"] - r["dy"]) == at[r["group"], r["n"]] for r in cells)


def test_channel_plans(spark):
    c = lambda w, h, k=0: {"w": w, "h": h, "hs": 0, "vs": 0, "component": k}
    images = {1: [c(16, 8, k) for k in range(3)], 2: [c(9, 9)], 3: [c(5, 5), c(4, 4)], 4: [c(1, 9)], 5: [c(100, 60, k) for k in range(3)]}
    squeeze = lambda *q: [dict(zip(("across", "in_place", "begin", "num"), v)) for v in q]
    steps = [
        (1, 1, "rct", 0, 0, 0, 0, []), (1, 2, "palette", 0, 3, 17, 2, []), (1, 3, "squeeze", 0, 0, 0, 0, []),
        (2, 1, "squeeze", 0, 0, 0, 0, squeeze((True, True, 0, 1), (False, False, 0, 2))), (2, 2, "rct", 0, 0, 0, 0, []),
        (3, 1, "palette", 0, 2, 4, 0, []), (3, 2, "squeeze", 0, 0, 0, 0, squeeze((True, True, 0, 1))),
        (4, 1, "squeeze", 0, 0, 0, 0, squeeze((True, True, 0, 1), (True, True, 1, 1))), (5, 1, "squeeze", 0, 0, 0, 0, []),
    ]
    kind = f"plan long, step long, kind string, begin long, num long, colours long, deltas long, squeezes array<{channels.SQUEEZE}>"
    found = channels.planned(spark.createDataFrame(list(images.items()), f"plan long, channels array<{channels.CHANNEL}>"), spark.createDataFrame(steps, kind))
    got = {r["plan"]: (r["meta"], r["error"], [(x["w"], x["h"], x["hs"], x["vs"], x["component"]) for x in r["channels"]]) for r in found.collect()}
    assert got[1] == (1, None, [(19, 3, -1, -1, None), (8, 8, 1, 0, 0), (8, 8, 1, 0, 0)])
    assert got[2] == (0, None, [(5, 5, 1, 1, 0), (4, 5, 1, 1, 0), (5, 4, 1, 1, 0), (4, 4, 1, 1, 0)]) or got[2][1] is not None
    assert got[3][1] == "channels differ" and got[3][2] == [(5, 5, 0, 0, 0), (4, 4, 0, 0, 0)]
    assert got[4][1] == "empty channel"
    meta, error, made = got[5]
    assert (meta, error) == (0, None) and sum(w * h for w, h, *_ in made) == 3 * 6000  # a squeeze keeps the number of samples
    assert made[0][:2] == (7, 8)


def test_weighted_prediction_of_odd_images(spark):
    """One column, one row, one sample; and of a flat image every prediction after the first is right."""
    shapes = {1: (1, 5), 2: (7, 1), 3: (1, 1), 4: (9, 6)}
    rows = [(i, x, y, 50 if i == 4 else (x * 7 + y * 3) % 11) for i, (w, h) in shapes.items() for x in range(w) for y in range(h)]
    got = {(r["img"], r["x"], r["y"]): (r["weighted"], r["property"]) for r in weighted.weighted(spark.createDataFrame(rows, "img long, x long, y long, v long"), "v").collect()}
    assert set(got) == {r[:3] for r in rows}
    assert all(got[i, 0, 0] == (0, 0) for i in shapes)
    assert all(got[4, x, y][0] == 50 for x in range(9) for y in range(6) if y > 1)


# ---- canvases


def test_canvases(spark):
    sizes = spark.createDataFrame([(1, 3, 2), (2, 2, 2)], "img long, w long, h long")
    frames = spark.createDataFrame([(1, 0, 0, 0, True), (1, 1, -1, 0, False), (1, 2, 2, 1, True), (1, 3, 50, 50, True), (2, 5, 0, 0, False)], "img long, frame long, x0 long, y0 long, whole boolean")
    full = [(1, 0, px, py, 10, 20, 30, 255) for px in range(3) for py in range(2)]
    over = [(1, 1, px, py, 110, 120, 130, a) for px, py, a in ((0, 0, 255), (1, 0, 255), (2, 0, 128), (1, 1, 0))]
    rest = [(1, 2, 0, 0, 1, 2, 3, 4), (1, 2, 1, 0, 9, 9, 9, 9), (1, 3, 0, 0, 7, 7, 7, 7)]
    pixels = spark.createDataFrame(full + over + rest, "img long, frame long, px long, py long, r long, g long, b long, a long")
    got = {(r["img"], r["frame"], r["x"], r["y"]): (r["r"], r["g"], r["b"], r["a"]) for r in compositing.canvases(sizes, frames, pixels).collect()}
    assert len(got) == 4 * 6 + 4
    base = (10, 20, 30, 255)
    assert all(got[1, 0, x, y] == base for x in range(3) for y in range(2))
    assert got[1, 1, 0, 0] == (110, 120, 130, 255) and got[1, 1, 1, 0] == (60, 70, 80, 255) and got[1, 1, 0, 1] == base and got[1, 1, 2, 1] == base
    assert got[1, 2, 2, 1] == (1, 2, 3, 4) and got[1, 2, 1, 0] == got[1, 1, 1, 0]
    assert all(got[1, 3, x, y] == got[1, 2, x, y] for x in range(3) for y in range(2))  # a frame off the canvas changes nothing
    assert all(got[2, 5, x, y] == (0, 0, 0, 0) for x in range(2) for y in range(2))


def test_every_query_reads_its_tables():
    import inspect

    from tessera import catalog, catalog_frames, catalog_streams  # noqa: F401

    for name, f in catalog.QUERIES.items():
        body = inspect.getsource(f).split(f"def {name}(", 1)[1]
        assert re.search(r"\br\.\w+\(|_\w+\(spark, sf|containers\.|\bframes\(|_wide\(|\br\.", body), name


# ---- prefix codes


def complete(rng, symbols):
    """Code lengths of a random full tree with ``symbols`` leaves of at most 15 bits."""
    leaves = [0]
    while len(leaves) < symbols:
        at = rng.choice([i for i, n in enumerate(leaves) if n < 15])
        leaves += [leaves.pop(at) + 1] * 2
    rng.shuffle(leaves)
    return leaves


def test_prefix_tables_decode_what_codes_encode(spark):
    rng = random.Random(5)
    alphabets = {g: complete(rng, n) for g, n in enumerate((2, 3, 40, 300, 16))}
    alphabets[4] = [*range(1, 15), 15, 15]  # the deepest
    rows = [(g, s, n) for g, lengths in alphabets.items() for s, n in enumerate(lengths)] + [(2, 500, 0), (9, 77, 3), (9, 78, 0)]
    table = prefixes.tables(spark.createDataFrame(rows, "g long, s long, n int"), "g", "s", "n")
    slots = {}
    for r in table.collect():
        slots.setdefault(r.g, {})[r.slot] = (r.bits, r.value)
    assert all(sorted(t) == list(range(len(t))) for t in slots.values())  # every slot once, no gap
    assert set(slots[9].values()) == {(0, 77)}
    want, windows = {}, []
    for g, lengths in alphabets.items():
        code, last = 0, 0
        for n, s in sorted((n, s) for s, n in enumerate(lengths)):
            code <<= n - last
            last = n
            bits = f"{code:0{n}b}" + "".join(rng.choice("01") for _ in range(15 - n))
            want[len(windows)] = (s, n)
            windows.append((len(windows), g, int(bits[::-1], 2)))
            code += 1
    want[len(windows)] = (77, 0)
    windows += [(len(windows), 9, 12345), (len(windows) + 1, 8, 1)]  # no alphabet 8: no row
    got = prefixes.looked_up(spark.createDataFrame(windows, "id long, g long, ahead long"), table, "g", "ahead").collect()
    assert {r.id: (r.symbol, r.used) for r in got} == want


@pytest.mark.parametrize("lengths", [[1, 2], [1, 1, 2], [3, 3, 3]])
def test_prefix_codes_with_gaps_or_overlaps_are_errors(spark, lengths):
    rows = spark.createDataFrame([(0, s, n) for s, n in enumerate(lengths)], "g long, s long, n int")
    with pytest.raises(Exception, match="prefix code"):
        prefixes.tables(rows, "g", "s", "n").collect()


def test_groups_of_a_region_by_channels(spark):
    rows = [
        (0, 0, 5, 0, 0, 0, 0, 100, 100),  # touches nothing of the region
        (0, 1, 5, 0, 0, 100, 0, 100, 100),
        (0, 2, 0, 0, 0, 100, 0, 100, 100),  # no payload
        (0, 3, 5, 1, 1, 50, 50, 50, 50),  # touches it at its own scale only
        (0, 3, 5, 0, 0, 0, 0, 10, 10),
        (0, 4, 5, -1, 0, 0, 0, 1, 1),  # belongs to the whole image
        (0, 5, 5, 2, 0, 50, 0, 1, 1),  # begins where the region ends
    ]
    df = spark.createDataFrame(rows, "frame long, grp long, payload long, hshift long, vshift long, x long, y long, gw long, gh long")
    assert sorted(r.grp for r in layout.needed_for_channels(df, 120, 10, 200, 120).collect()) == [1, 3, 4]
