"""Queries whose rows are exploded: plans that stay small however many rows come out."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera import catalog, catalog_frames, catalog_streams  # noqa: F401  (register their queries with catalog)
from tessera.functions import coding
from tessera.operators import assembly, frequency, gathering, noise, splines, stencils, transforms, trees, weighted
from tessera.plans import layout

SF = "/root/testdata/sf0.001"


def plan(df):
    """The plan before it adapts; tables of sf0.001 would all be broadcast where there is a join."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_shuffled_bytes_are_placed_without_a_join(spark):
    for n in range(1, 40):
        got = spark.range(n).select(coding.shuffled("id", F.lit(n).cast("bigint"), 4)).collect()
        back = spark.createDataFrame(got, "to long").select(coding.unshuffled("to", F.lit(n).cast("bigint"), 4)).collect()
        assert [b[0] for b in back] == list(range(n))
        assert sorted(g[0] for g in got) == list(range(n))
    assert "Join" not in plan(catalog.QUERIES["ent12_shuffle"](spark, SF))


def test_group_counts_without_sending_groups(spark):
    groups = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (2, 0), (3, None), (3, 4)], "img long, grp long")
    found = spark.createDataFrame([(1, 1), (1, 1), (1, 9), (3, None), (3, 4), (4, 0)], "img long, grp long")
    want = [(1, 2, 1), (3, 1, 1)]
    assert sorted(map(tuple, assembly.group_counts(groups, found).collect())) == want
    said = groups.withColumn("found", F.expr("grp in (1, 4)"))
    assert sorted(map(tuple, assembly.group_counts(said).collect())) == want
    assert "Join" not in plan(assembly.group_counts(groups, found))
    assert "Join" not in plan(catalog.QUERIES["asm2_counts"](spark, SF))


def test_sections_take_their_rectangles_from_their_own_numbers(spark):
    frames = layout.group_layout(spark.createDataFrame([(1, 600, 300), (2, 2500, 10), (3, 20, 20)], "frame long, w long, h long"))
    rows = [(1, 0, "ac_group", 0), (1, 1, "ac_group", 5), (1, 2, "ac_group", 6), (1, 3, "dc_group", 0), (2, 0, "dc_group", 1), (2, 1, "dc_group", 2), (2, 2, "dc_global", None), (9, 0, "ac_group", 0)]
    kinds = spark.createDataFrame([(f, i, k, None, g) for f, i, k, g in rows], "frame long, id long, kind string, pass long, grp long")
    got = {(r["frame"], r["id"]): (r["x"], r["y"], r["gw"], r["gh"]) for r in layout.classified(kinds, frames).collect()}
    assert got == {(1, 0): (0, 0, 256, 256), (1, 1): (512, 256, 88, 44), (1, 3): (0, 0, 600, 300), (2, 0): (2048, 0, 452, 10)}
    assert "Join" not in plan(catalog.QUERIES["toc8_classified"](spark, SF))


def test_channels_of_groups_are_not_joined(spark):
    assert "Join" not in plan(catalog.QUERIES["toc9_channels"](spark, SF))
    groups = spark.createDataFrame([(1, 0, 0, 0, 256, 100, 0, 2), (2, 3, 256, 0, 10, 100, 2, 2)], "frame long, grp long, x long, y long, gw long, gh long, min_shift int, max_shift int")
    channels = spark.createDataFrame([(1, 0, 200, 50, 1), (1, 1, 80, 25, 3), (2, 0, 60, 25, 2)], "frame long, channel long, cw long, ch long, shift long")
    found = layout.channel_rects(groups, channels)
    assert "BroadcastHashJoin" not in plan(found)
    assert [tuple(f) for f in found.collect()] == [(1, 0, 0, 0, 0, 128, 50)]


def test_groups_bring_their_frame_along(spark):
    assert "Join" not in plan(catalog.QUERIES["vdp12_group_lookup"](spark, SF))


def test_one_spline_with_equal_points_ends_no_other(spark):
    rows = [(1, 0, 0.0, 0.0), (1, 1, 3.0, 4.0), (2, 0, 0.0, 0.0), (2, 1, 5.0, 5.0), (2, 2, 5.0, 5.0), (2, 3, 9.0, 9.0), (2, 4, 9.0, 0.0), (2, 5, 0.0, 0.0), (3, 0, 1.0, 1.0)]
    points = spark.createDataFrame(rows, "spline long, i long, x double, y double")
    line = splines.curve(points, strict=False)
    got = line.orderBy("spline", "n").collect()
    assert [(g["spline"], g["n"]) for g in got] == [(1, n) for n in range(17)] + [(2, n) for n in range(81)] + [(3, 0)]
    lost = {(g["spline"], g["n"]) for g in got if g["x"] is None or g["y"] is None}
    assert lost == {(2, n) for n in range(48) if n % 16}  # three pieces look at the gap of no length
    steps = splines.stepped(line).orderBy("spline", "k").collect()
    assert [tuple(s) for s in steps if s["spline"] == 2] == [(2, None, None, None, None)]
    assert [s["k"] for s in steps if s["spline"] == 1] == [0, 1, 2, 3, 4, 5, 6] and [s["k"] for s in steps if s["spline"] == 3] == [0, 1]
    series = spark.createDataFrame([(n, [[1.0] * 32] * 3, [1.0] * 32) for n in (1, 2, 3)], "spline long, colours array<array<double>>, sigmas array<double>")
    assert {s["spline"] for s in splines.segments(splines.stepped(line), series).collect()} == {1}


def test_a_line_is_walked_once_and_its_series_sent_once(spark):
    rows = [(n if n < 8 else None, i, float(i * (3 + n % 3)), float(i * i % 5)) for n in range(9) for i in range(2 + n)]
    line = splines.stepped(splines.curve(spark.createDataFrame(rows, "spline long, i long, x double, y double")))
    series = {
        1: ([[1.0, 0.5] * 16, [0.25] * 32, [-3.0] * 32], [2.0] + [0.01] * 31),
        2: ([[1.0] * 32, [None] + [1.0] * 31, None], [1.0] * 32),
        3: ([[float("inf")] * 2, [0.125], []], [1.5, 0.5]),
        4: ([[1.0] * 32], [0.0] * 32),
        5: ([[1.0] * 32], [1.0, None]),
        6: (None, [1.0]),
        7: ([[0.001] * 40, [1.0]], [1.0]),
        9: ([[1.0]], [1.0]),
    }
    given = spark.createDataFrame([(s, *both) for s, both in series.items()] + [(7, [[5.0]], [2.0])], "spline long, colours array<array<double>>, sigmas array<double>")

    def along(terms, at):
        lacks = terms is None or None in terms
        return None if lacks else sum(math.sqrt(2) * v * math.cos((at + 0.5) * math.pi / 32 * n) for n, v in enumerate(terms))

    steps, want = line.where("spline is not null").collect(), {}
    for spline, (colours, sigmas) in [*series.items(), (7, ([[5.0]], [2.0]))]:
        own = [s for s in steps if s["spline"] == spline]
        arc = sum(s["intensity"] for s in own) - 1
        for s in own:
            at = 31 * min(s["k"] / arc, 1)
            sigma, lit = along(sigmas, at), [along(c, at) for c in colours or []]
            if sigma:
                most = max([0.01, *[abs(c * s["intensity"]) for c in lit if c is not None]], key=lambda v: (v != v, v))
                reach = math.sqrt(-2 * sigma * sigma * (3 * math.log(0.1) - math.log(most)))
                for channel, colour in enumerate(lit):
                    want.setdefault((spline, s["k"], channel), []).append((colour, sigma, reach, s["x"], s["y"], s["intensity"]))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for sent in (before, "3"):  # a series also holds for the rows of later parts
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", sent)
        found = splines.segments(line, given)
        got = {}
        for g in found.collect():
            got.setdefault((g["spline"], g["k"], g["channel"]), []).append(tuple(g[c] for c in ("colour", "sigma", "reach", "cx", "cy", "intensity")))
        assert got.keys() == want.keys() and {s for s, *_ in got} == {1, 2, 3, 7}
        for key, rows in got.items():
            assert len(rows) == len(want[key])
            for one, other in zip(sorted(rows, key=str), sorted(want[key], key=str)):
                assert all(a is b if a is None or b is None else a == pytest.approx(b, rel=1e-9, nan_ok=True) for a, b in zip(one, other))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    said = plan(splines.segments(line, given))
    assert said.count("Scan ExistingRDD") == 2 and said.count("ArrowEvalPython") == 1  # points and series are read once
    assert "lambda" not in said and "Union" not in said and "Broadcast" not in said
    assert said.count("Exchange") == 2 and "REPARTITION_BY_NUM" in said  # few bytes of points still go to all tasks


def test_canvases_are_painted_where_their_segments_meet(spark, monkeypatch):
    monkeypatch.setattr(assembly, "PAINTED", 3)
    rows = [(i % 4 if i % 5 else None, i % 2, i * 7 % 20 - 2, i % 4, None if i % 9 == 8 else i) for i in range(60)] + [(9, 0, 5, 1, None), (9, 1, -9, 2, 1)]
    segments = spark.createDataFrame(rows, "img long, y int, centre long, reach long, amount long")
    want = {}
    for img, y, centre, reach, amount in rows:
        for x in range(max(centre - reach, 0), min(centre + reach, 15) + 1):
            had = want.get((img, y, x))
            want[img, y, x] = had if amount is None else (had or 0) + amount * (reach + 1 - abs(x - centre))
    for parts in (1, 3):
        got = assembly.accumulate(segments.repartition(parts), 16)
        assert got.columns == ["img", "y", "x", "v"]
        assert {(g["img"], g["y"], g["x"]): g["v"] for g in got.collect()} == want
    for name in ("syn9_draw", "syn9_accumulate"):  # what is shuffled are segments: nothing is exploded
        assert "Generate" not in plan(catalog.QUERIES[name](spark, SF))


def test_weighted_gathers_few_images_at_a_time(spark, monkeypatch):
    rows = [(i // 12 if i < 600 else None, i % 12 % 4, i % 12 // 4, i * 37 % 256) for i in range(612)] + [(77, x, y, x * y % 7) for x in range(30) for y in range(20)]
    samples = spark.createDataFrame(rows, "img long, x long, y long, v long").repartition(3)
    want = sorted(map(str, weighted.weighted(samples, "v").collect()))
    assert len(want) == len(rows)
    monkeypatch.setattr(weighted, "GATHERED", 50)
    few = weighted.weighted(samples, "v")
    assert sorted(map(str, few.collect())) == want
    assert "collect_list" not in plan(few)


def test_large_trees_go_to_tasks_by_what_is_in_reach(spark, monkeypatch):
    rows = [(t, 2 * d + i, -1 if i else 0, d, None if i else 2 * d + 2, None if i else 2 * d + 1) for t in range(2) for d in range(100) for i in range(2)] + [(t, 200, -1, 0, None, None) for t in range(2)]
    nodes = spark.createDataFrame(rows, "tree long, node long, property long, split long, left long, right long")
    samples = spark.createDataFrame([(i, i % 2, i % 130, "beside") for i in range(400)], "id long, tree long, a long, b string")
    sent, asked = trees.sent, []
    monkeypatch.setattr(trees, "SENT", 50)
    monkeypatch.setattr(trees, "sent", lambda df, *most: asked.append(df.count()) or sent(df, *most))
    found = trees.leaves(samples, nodes, ["a"], held=0, keep=["id"])
    assert found.columns == ["id", "leaf"]
    assert {f["id"]: f["leaf"] for f in found.collect()} == {i: 2 * (i % 130) + 1 if i % 130 < 100 else 200 for i in range(400)}
    assert max(asked) <= 2 * (2 * 16 + 1) < len(rows)


def test_enlarged_samples_are_rounded_as_sql_sums_them(spark):
    """SQL's inner product fuses products and sums; where a sum is all but a half, that decides the whole number."""
    import duckdb

    rng, weights = random.Random(3), [((n * 37) % 101 - 30) / 1000 for n in range(15)]
    rows = spark.createDataFrame([(1, x, y, rng.randrange(256)) for x in range(40) for y in range(30)], "img long, x long, y long, v long")
    got = {(r.x, r.y): r.v for r in stencils.enlarge(rows, "v", 2, weights, steps=100).collect()}
    cells = [(r.x, r.y, [float(v) for row in r.around for v in row]) for r in stencils.neighbourhood(rows, "v", 2).collect()]
    con, plain, want = duckdb.connect(), {}, {}
    for n, kernel in enumerate(stencils.enlarging_kernels(2, weights)):
        k = [w for row in kernel for w in row]
        whole = con.execute("select list_transform($1::double[][], lambda c: floor(least(greatest(list_inner_product(c, $2::double[]), list_min(c)), list_max(c)) * 100 + 0.5))", [[c for _, _, c in cells], k]).fetchone()[0]
        for (x, y, c), v in zip(cells, whole):
            at, total = (2 * x + n % 2, 2 * y + n // 2), 0.0
            for a, w in zip(c, k):
                total += a * w
            want[at], plain[at] = v, (min(max(total, min(c)), max(c)) * 100 + 0.5) // 1
    assert got == want and want != plain


def test_strips_give_what_windows_give(spark, monkeypatch):
    monkeypatch.setattr(gathering, "GATHERED", 40)
    rng = random.Random(5)
    places = [(img, x, y) for img, w, h in ((None, 3, 70), (1, 5, 200), (2, 1, 1), (3, 7, 65)) for x in range(w) for y in range(h) if (x, y) != (w - 1, h - 1) or w * h == 1]
    rows = spark.createDataFrame([(*p, rng.randrange(9), rng.random(), -0.3 - rng.randrange(5)) for p in places], "img long, x int, y int, a long, b double, s double").repartition(3)
    want = rows
    for v in "ab":
        want = stencils.gaborish(want, v, f"g{v}").drop(v).withColumnRenamed(f"g{v}", v)
    for step in (0, 1, 2):
        want = stencils.edge_filter(want, ["a", "b"], [0.1, 0.2], "s", step).select("img", "x", "y", "s", F.col("a_kept").alias("a"), F.col("b_kept").alias("b"))
    found = stencils.restored(rows, ["a", "b"], steps=[0, 1, 2], scales=[0.1, 0.2], inverse_sigma="s")
    assert found.columns == ["img", "x", "y", "a", "b"] and found.dtypes[:3] == [("img", "bigint"), ("x", "int"), ("y", "int")]
    key = lambda r: (str(r.img), r.x, r.y)
    got, want = ({key(r): (r.a, r.b) for r in df.collect()} for df in (found, want))
    assert got.keys() == want.keys() and len(got) == len(places)
    assert all(abs(p - q) < 1e-9 for k in got for p, q in zip(got[k], want[k]))
    for name in ("vdr11_step0", "vdr13_upsample8", "vdr18_restored"):  # neighbourhoods are not copied from row to row
        assert plan(catalog.QUERIES[name](spark, SF)).count("Window ") == 1  # the samples' own numbers


def test_squeezed_lines_are_undone_without_gathering_them_in_rows(spark, monkeypatch):
    monkeypatch.setattr(gathering, "GATHERED", 30)
    rng = random.Random(8)
    sizes = {(img, line): (a := rng.randrange(1, 9), rng.choice((0, a - 1, a, a))) for img in (None, 1, 2, 3) for line in range(9)}
    value = lambda: rng.choice((None, *range(-40, 40)))
    low, rest = ([(*k, i, value()) for k, n in sizes.items() for i in range(n[side])] for side in (0, 1))
    kind = "img long, y long, x long, v long"
    got = transforms.unsqueezed(spark.createDataFrame(low, kind).repartition(3), spark.createDataFrame(rest, kind), across=True)
    assert got.columns == ["img", "x", "y", "v"]
    assert "collect_list" not in plan(got)
    lines = [(*k, [r[3] for r in low if r[:2] == k], [r[3] for r in rest if r[:2] == k]) for k in sizes]
    folded = transforms.unsqueeze(spark.createDataFrame(lines, "img long, y long, a array<long>, r array<long>"), "a", "r")
    want = {(r.img, x, r.y): v for r in folded.collect() for x, v in enumerate(r.samples)}
    assert {(r.img, r.x, r.y): r.v for r in got.collect()} == want
    with pytest.raises(Exception, match="more residuals than averages"):
        transforms.unsqueezed(spark.createDataFrame([(1, 0, 0, 5)], kind), spark.createDataFrame([(1, 0, 0, 1), (1, 0, 1, 1)], kind), True).collect()


def test_a_palette_below_a_colour_transform_is_not_taken_apart_and_put_together(spark):
    assert "SortMergeJoin" not in plan(catalog.QUERIES["xfm1_chain"](spark, SF))
    assert plan(catalog.QUERIES["xfm1_chain"](spark, SF)).count("Aggregate") <= 6  # images, sizes and colours, no samples
    kind = "img long, channel long, x long, y long, v long"
    rows = [(1, 0, i, c, 10 * i + c) for i in range(3) for c in range(3)] + [(1, 1, x, 0, x) for x in range(-1, 5)]
    steps = [("rct", 6, 0), ("palette", 0, 3, 3)]
    got = {(r.channel, r.x): r.v for r in transforms.undone(spark.createDataFrame(rows, kind), 2, steps).collect()}
    plain = transforms.undone(spark.createDataFrame(rows, kind), 2, steps[1:])
    want = {(r.channel, r.x): r.v for r in transforms.undone(plain, 3, steps[:1]).collect()}
    assert got == want and len(got) == 18


def test_cosine_blocks_are_whole_in_tasks(spark, monkeypatch):
    monkeypatch.setattr(gathering, "GATHERED", 20)
    kind = "blk long, strategy long, k long, v double"
    rows = [(b, n, k, float((b or 0) + k % 5)) for b in (None, 1, 2) for n in (0, 6, 10) for k in range(0, 60, 7)] + [(1, 0, 7, 2.5), (3, 0, 0, None), (4, 0, 0, None), (4, 0, 1, 1.0)]
    found = frequency.spatial(spark.createDataFrame(rows, kind).repartition(3))
    wave = frequency._cosines
    got = {(r.blk, r.strategy, r.x, r.y): r.v for r in found.collect()}
    want = {}
    for b, n in {r[:2] for r in rows}:
        w, h, _ = frequency.STRATEGIES[n]
        mine = [(k, v) for bb, nn, k, v in rows if (bb, nn) == (b, n) and v is not None]
        for x in range(w):
            for y in range(h):
                want[b, n, x, y] = 2 * sum(v * wave(w)[k % w, x] * wave(h)[k // w, y] for k, v in mine) if mine else None
    assert got.keys() == want.keys()
    assert all(got[k] is None if v is None else abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_noise_is_dealt_to_tasks_and_worked_out_once_for_images_alike(spark, monkeypatch):
    groups = spark.createDataFrame([(i, 0, 0, 0, 5, 3) for i in range(200)], "img long, grp long, x long, y long, gw long, gh long").coalesce(1)
    found = noise.noise(groups)
    assert found.rdd.getNumPartitions() == 4
    got = {}
    for r in found.collect():
        got.setdefault(r.img, {})[r.plane, r.x, r.y] = r.v
    assert len(got) == 200 and all(g == got[0] and len(g) == 45 for g in got.values())
