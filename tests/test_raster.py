import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera import catalog, catalog_frames, catalog_streams  # noqa: F401  (register their queries with catalog)
from tessera.functions import samples as s
from tessera.operators import assembly, frequency, geometry, stencils, transforms
from tessera.plans import layout
from tessera.sources import containers, pam
from tessera.streaming import frames as stream_frames

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_matches_sql(spark, con, name):
    got, want = catalog.QUERIES[name](spark, SF), con.sql(catalog.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = con.sql("select " + ",".join(f'"{c}"' for c in columns) + " from want").fetchall()
    assert sorted(map(str, rows)) == sorted(str(tuple(r)) for r in got.select(*columns).collect())


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_reversible_colour_undoes_itself(spark):
    rng = random.Random(1)
    rgb = [tuple(rng.randrange(256) for _ in range(3)) for _ in range(50)]
    rows = []
    for r, g, b in rgb:  # forward transform of the lifting scheme
        co = r - b
        t = b + (co >> 1)
        cg = g - t
        rows.append((r, g, b, t + (cg >> 1), co, cg))
    df = spark.createDataFrame(rows, "r long, g long, b long, y long, co long, cg long")
    back = df.select("r", "g", "b", *[c.alias(f"o{i}") for i, c in enumerate(s.inverse_rct(6, "y", "co", "cg"))]).collect()
    assert all((x.r, x.g, x.b) == (x.o0, x.o1, x.o2) for x in back)


def test_wrapping_and_division(spark):
    df = spark.createDataFrame([(2**31,), (-(2**31) - 1,), (-7,), (7,)], "v long")
    got = df.select(s.wrap32("v").alias("w"), s.div("v", F.lit(2)).alias("h")).collect()
    assert [r.w for r in got] == [-(2**31), 2**31 - 1, -7, 7] and [r.h for r in got[2:]] == [-3, 3]


def test_alpha_and_depth(spark):
    r = one(spark, s.unpremultiply(F.lit(0), 8, F.lit(0), 8, 255).alias("a"), s.unpremultiply(F.lit(3), 8, F.lit(0), 8, 255).alias("b"),
            s.unpremultiply(F.lit(64), 8, F.lit(128), 8, 255).alias("c"), s.scale_depth(F.lit(1), 1, 65535).alias("d"), s.blend(F.lit(200), F.lit(100), F.lit(128)).alias("e"))
    assert (r.a, r.b, r.c, r.d, r.e) == (0, 255, 128, 65535, 150)


def test_squeeze_round_trip(spark):
    def tendency(p, a, n):
        q = lambda x, y: int(x / y)
        d = 0
        if p >= a >= n:
            d = q(4 * p - 3 * n - a + 6, 12)
            d = 2 * (p - a) + 1 if d - (d & 1) > 2 * (p - a) else d
            d = 2 * (a - n) if d + (d & 1) > 2 * (a - n) else d
        elif p <= a <= n:
            d = q(4 * p - 3 * n - a - 6, 12)
            d = 2 * (p - a) - 1 if d + (d & 1) < 2 * (p - a) else d
            d = 2 * (a - n) if d - (d & 1) < 2 * (a - n) else d
        return d

    rng, rows = random.Random(3), []
    for n in (1, 2, 3, 9, 16):
        v = [rng.randrange(256) for _ in range(n)]
        avg, res = [], []
        for i in range(0, n - 1, 2):
            avg.append((v[i] + v[i + 1] + (v[i] > v[i + 1])) >> 1)
        avg += [v[-1]] * (n % 2)
        for i in range(n // 2):
            left = v[2 * i - 1] if i else avg[i]
            nxt = avg[i + 1] if i + 1 < len(avg) else avg[i]
            res.append(v[2 * i] - v[2 * i + 1] - tendency(left, avg[i], nxt))
        rows.append((n, avg, res, v))
    df = spark.createDataFrame(rows, "n int, avg array<long>, res array<long>, v array<long>")
    assert all(r.samples == r.v for r in transforms.unsqueeze(df, "avg", "res").collect())


def test_crop_equals_region_of_whole_and_orientations_are_bijective(spark):
    df = spark.range(30).select(F.lit(1).alias("img"), (F.col("id") % 6).alias("x"), F.expr("id div 6").alias("y"), F.col("id").alias("v"))
    assert {(r.x, r.y, r.v) for r in geometry.crop(df, 2, 1, 3, 2).collect()} == {(x - 2, y - 1, y * 6 + x) for x in (2, 3, 4) for y in (1, 2)}
    for code in range(1, 9):
        out = geometry.orient(df.withColumn("o", F.lit(code)).withColumn("w", F.lit(6)).withColumn("h", F.lit(5)), "o", "w", "h").collect()
        w, h = (5, 6) if code > 4 else (6, 5)
        assert {(r.x, r.y) for r in out} == {(x, y) for x in range(w) for y in range(h)}


def test_stencils_keep_constants_and_mirror(spark):
    flat = spark.range(12).select(F.lit(1).alias("img"), (F.col("id") % 4).alias("x"), F.expr("id div 4").alias("y"), F.lit(7).cast("long").alias("v"))
    assert all(abs(r.smooth - 7) < 1e-9 for r in stencils.gaborish(flat, "v").collect())
    assert all(abs(r.noise) < 1e-9 for r in stencils.noise_filter(flat, "v").collect())
    doubled = stencils.enlarge(flat.withColumnRenamed("v", "c"), "c").collect()
    assert len(doubled) == 48 and all(abs(r.v - 7) < 1e-6 for r in doubled)
    ramp = flat.withColumn("v", F.col("x"))
    around = {(r.x, r.y): r.around for r in stencils.neighbourhood(ramp, "v", 2).collect()}
    assert around[0, 0][2] == [1, 0, 0, 1, 2] and around[3, 0][2] == [1, 2, 3, 3, 2]


def test_overlap_finds_each_pair_once(spark):
    rng = random.Random(4)
    rect = lambda i: (i, (x := rng.randrange(900)), (y := rng.randrange(900)), x + rng.randrange(0, 300), y + rng.randrange(0, 300))
    a, b = [rect(i) for i in range(60)], [rect(i) for i in range(40)]
    got = geometry.overlapping(spark.createDataFrame(a, "id long, x0 long, y0 long, x1 long, y1 long"), spark.createDataFrame(b, "region long, x0 long, y0 long, x1 long, y1 long"), 64).collect()
    want = {(i, j) for i, x0, y0, x1, y1 in a for j, u0, v0, u1, v1 in b if max(x0, u0) < min(x1, u1) and max(y0, v0) < min(y1, v1)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_final_pass_and_composite(spark):
    rows = spark.createDataFrame([(1, 0, 5, 10), (1, 2, 1, 11), (1, 2, 3, 12), (2, 1, 1, 13)], "grp long, pass int, ord long, v long")
    assert {(r.grp, r.v) for r in assembly.final_pass(rows, ["grp"], "pass", "ord").collect()} == {(1, 12), (2, 13)}
    frames = spark.createDataFrame([(1, 1, 200, 255), (1, 2, 100, 128), (2, 1, 50, 0)], "img long, frame long, colour long, alpha long")
    assert {(r.img, r.colour, r.alpha) for r in assembly.composite(frames).collect()} == {(1, 150, 255), (2, 0, 0)}


def test_snapshots_keep_every_frame(spark):
    rows = [(1, 1, 200, 255), (1, 2, 100, 128), (1, 5, 7, 9), (1, 6, 50, 0), (1, 8, 255, 128), (2, 1, 50, 0)]
    frames = spark.createDataFrame(rows, "img long, frame long, colour long, alpha long")
    got = {tuple(x) for x in assembly.snapshots(frames, every=5).select("img", "frame", "colour", "alpha").collect()}
    assert got == {(1, 1, 200, 255), (1, 2, 150, 255), (1, 5, 7, 9), (1, 6, 7, 9), (1, 8, 131, 132), (2, 1, 0, 0)}
    assert {x.frame for x in assembly.snapshots(frames).where("img = 1").collect()} == {1, 2, 5, 6, 8}


def test_lehmer(spark):
    rng = random.Random(2)
    codes = {1: [2, 0, 1, 0], 2: [0], 3: [rng.randrange(700 - i) for i in range(700)], 4: [0] * 33, 5: [32 - i for i in range(33)]}
    df = spark.createDataFrame([(f, i, d) for f, code in codes.items() for i, d in enumerate(code)], "frame long, idx long, digit long")
    got = {(x.frame, x.idx): x.to for x in layout.lehmer(df).collect()}
    for f, code in codes.items():
        left = list(range(len(code)))
        assert [got.pop((f, i)) for i in range(len(code))] == [left.pop(d) for d in code]
    assert not got and layout.lehmer(df.where("frame > 9")).collect() == []


def box(kind, body, long=False):
    size = len(body) + (16 if long else 8)
    return ((1).to_bytes(4, "big") + kind + size.to_bytes(8, "big") if long else size.to_bytes(4, "big") + kind) + body


def test_containers(spark, tmp_path):
    head = bytes.fromhex(containers.BOXED) + box(b"ftyp", b"jxl \0\0\0\0jxl ")
    part = lambda n, last, body: box(b"jxlp", (n | (2**31 if last else 0)).to_bytes(4, "big") + body)
    files = {
        "naked": b"\xff\x0aabc", "whole": head + box(b"Exif", b"x") + box(b"jxlc", b"\xff\x0astream", long=True), "parts": head + part(0, False, b"\xff\x0aab") + part(1, True, b"cd"),
        "short": b"\xff", "bad": b"GIF89a", "cut": head + box(b"jxlc", b"\xff\x0astream")[:-3], "order": head + part(1, False, b"a") + part(0, True, b"b"),
        "none": head, "two": head + box(b"jxlc", b"a") + box(b"jxlc", b"b"), "open": head + part(0, False, b"a"), "empty": b"",
        "brand": bytes.fromhex(containers.BOXED) + box(b"ftyp", b"jxl \0\0\0\1jxl ") + box(b"jxlc", b"a"), "wide": bytes.fromhex(containers.BOXED) + box(b"ftyp", b"jxl \0\0\0\0jxl ", long=True) + box(b"jxlc", b"a"),
    }
    for name, data in files.items():
        (tmp_path / f"{name}.jxl").write_bytes(data)
    got = {os.path.basename(r.path)[:-4]: r for r in containers.codestreams(containers.scan(spark, str(tmp_path), "*.jxl")).collect()}
    streams = {k: bytes(r.codestream) for k, r in got.items() if r.codestream is not None}
    assert streams == {"naked": b"\xff\x0aabc", "whole": b"\xff\x0astream", "parts": b"\xff\x0aabcd"}
    errors = {k: r.error for k, r in got.items() if r.error}
    assert errors == {"short": "truncated", "bad": "invalid signature", "cut": "truncated", "order": "parts out of order", "none": "no codestream", "two": "several codestreams", "open": "parts without an end", "brand": "invalid ftyp box", "wide": "invalid ftyp box"}
    assert len(got) == len(files) - 1  # the empty file


def test_pam(spark, tmp_path):
    df = spark.range(6).select(F.lit(3).cast("long").alias("img"), (F.col("id") % 3).alias("x"), F.expr("id div 3").alias("y"), *[(F.col("id") * 40 + i).alias(c) for i, c in enumerate("rgba")])
    pam.write(spark, df.repartition(3), f"file://{tmp_path}/out")
    head, _, body = (tmp_path / "out" / "3.pam").read_bytes().partition(b"ENDHDR\n")
    assert b"WIDTH 3\nHEIGHT 2\nDEPTH 4\nMAXVAL 255" in head and body == bytes(i * 40 + c for i in range(6) for c in range(4))
    assert os.listdir(tmp_path / "out") == ["3.pam"]
    assert bytes(pam.payloads(df, 16).first().payload).endswith(bytes([0, 203]))


def run_stream(spark, stream, mode, name):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.sql(f"select * from {name}").collect()


def test_streams(spark, tmp_path):
    first = spark.createDataFrame([(1, 1, 200, 255), (1, 2, 100, 128)], "img long, frame long, colour long, alpha long")
    first.coalesce(1).write.parquet(str(tmp_path / "f"))
    source = lambda: spark.readStream.schema(first.schema).parquet(str(tmp_path / "f"))
    assert [tuple(r) for r in run_stream(spark, stream_frames.composite(source()), "update", "canvas")] == [(1, 2, 150, 255)]
    rows = source().select(F.col("img").alias("grp"), F.lit(1).alias("pass"), F.col("frame").alias("ord"), F.col("colour").alias("v"))
    assert [tuple(r) for r in run_stream(spark, stream_frames.best_pass(rows), "complete", "best")] == [(1, 1, 2, 100)]


BLOCK = "blk long, strategy long, k long, v double"


def test_every_strategy_comes_out_whole(spark):
    """One sample a sample: blocks of all 27 strategies, the cosine ones from a few coefficients; constants stay constants."""
    rows = []
    for n, (w, h, kind) in enumerate(frequency.STRATEGIES):
        some = range(64) if kind != "dct" else (0,)
        rows += [(n, n, k, 5.0 if k == 0 else 0.0) for k in some]
    got = frequency.spatial(spark.createDataFrame(rows, BLOCK), [[float(j == 0) for _ in range(16)] for j in range(16)])
    counts = got.groupBy("strategy").agg(F.count("*").alias("n"), F.countDistinct("x", "y").alias("d"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.max("x").alias("x"), F.max("y").alias("y")).collect()
    assert len(counts) == 27
    for r in counts:
        w, h, kind = frequency.STRATEGIES[r.strategy]
        assert (r.n, r.d, r.x, r.y) == (w * h, w * h, w - 1, h - 1)
        if not kind.startswith("corner"):  # the first coefficient of a corner's own part counts four times
            assert abs(r.lo - 5) < 1e-9 and abs(r.hi - 5) < 1e-9


def test_large_blocks_match_the_formula(spark):
    rng = random.Random(6)
    parts = {(n, k): rng.uniform(-9, 9) for n in (18, 23, 26) for k in rng.sample(range(frequency.STRATEGIES[n][0] * frequency.STRATEGIES[n][1]), 5)}
    got = frequency.spatial(spark.createDataFrame([(n, n, k, v) for (n, k), v in parts.items()], BLOCK))
    import math

    wave = lambda u, i, size: math.cos((2 * i + 1) * u * math.pi / (2 * size)) * (math.sqrt(0.5) if u == 0 else 1)
    for r in got.where("x % 37 = 5 and y % 29 = 3").collect():
        w, h, _ = frequency.STRATEGIES[r.strategy]
        want = 2 * sum(v * wave(k % w, r.x, w) * wave(k // w, r.y, h) for (n, k), v in parts.items() if n == r.strategy)
        assert abs(r.v - want) < 1e-9


@pytest.mark.parametrize("strategy", [27, -1, 14, None])
def test_strategies_without_a_transform_are_an_error(spark, strategy):
    with pytest.raises(Exception, match="no transform for strategy"):
        frequency.spatial(spark.createDataFrame([(1, 0, 0, 1.0), (2, strategy, 0, 1.0)], BLOCK)).collect()


def test_weights_of_a_frame(spark):
    rows = spark.createDataFrame([(1, 0, 0, 0, 1.0), (1, 2, 1, 63, 1.0)], "blk long, strategy long, channel long, k long, v double")
    custom = spark.createDataFrame([(0, 0, 0, 7.0)], "strategy long, channel long, k long, weight double")
    table = frequency.weights(spark)
    assert {r.strategy: r.weight for r in frequency.weighed(rows, table).collect()} == {0: 3150.0, 2: 120.0}
    assert {r.strategy: r.weight for r in frequency.weighed(rows, table, custom).collect()} == {0: 7.0, 2: 120.0}
    with pytest.raises(Exception, match="no weights for strategy 5"):
        frequency.weighed(rows.withColumn("strategy", F.lit(5).cast("long")), table).collect()
    assert frequency.weights(spark, {5: [[10.0, -1.0]] * 3}).where("strategy = 5").count() == 3 * 1024


def test_channels_share_their_windows(spark):
    rows = spark.createDataFrame([(1, x, y, x * y % 7, x + y, x * 3 % 5) for x in range(9) for y in range(8)], "img long, x long, y long, a long, b long, c long")
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert exchanges(stencils.edge_filter(rows, ["a", "b", "c"], [0.1, 0.2, 0.3], -0.5, 0)) == 2
    for v in "abc":
        want = {(r.x, r.y): r.around for r in stencils.neighbourhood(rows, v).collect()}
        got = {(r.x, r.y): r[f"_{v}"] for r in stencils.neighbourhoods(rows, ["a", "b", "c"]).collect()}
        assert got == want


def test_filters_of_a_frame_are_those_one_by_one(spark):
    rows = spark.createDataFrame([(i, x, y, (x * 7 + y * 3 + i) % 11, (x * y) % 5) for i in (0, 1) for x in range(9) for y in range(9 - i)], "img int, x int, y int, a int, b int")
    want = stencils.gaborish(stencils.gaborish(rows, "a", "sa"), "b", "sb").select("img", "x", "y", F.col("sa").alias("a"), F.col("sb").alias("b"))
    for step in (0, 1, 2):
        want = stencils.edge_filter(want, ["a", "b"], [0.1, 0.2], -1.5, step)
        want = want.select("img", "x", "y", F.col("a_kept").alias("a"), F.col("b_kept").alias("b"))
    got = stencils.restored(rows, ["a", "b"], steps=[2, 0, 1], scales=[0.1, 0.2], inverse_sigma=-1.5, factor=2)
    sizes = {(r["img"], r["x"], r["y"]): (r["a"], r["b"]) for r in got.collect()}
    for n, c in enumerate("ab"):
        one_by_one = stencils.enlarge(want, c, 2).collect()
        assert len(one_by_one) == len(sizes) == 4 * rows.count()
        assert all(abs(sizes[r["img"], r["x"], r["y"]][n] - r["v"]) < 1e-9 for r in one_by_one)
    same = stencils.restored(rows, ["a", "b"], smooth=False, steps=[])
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, rows.collect()))
    assert stencils.restored(rows.limit(0), ["a", "b"], scales=[1, 1], factor=2).collect() == []


def test_transforms_are_undone_in_turn(spark):
    """Coded by hand: a palette of two colours, its index squeezed along columns; and a squeeze whose residual is at the end."""
    from tessera.operators.transforms import undone

    index = [[0, 1, 1], [1, 1, 0]]
    low = [[(a + b + (a > b)) // 2 for a, b in zip(*index)]]
    kind = "img long, channel long, x long, y long, v long"
    table = [(1, 0, i, c, v) for i, colour in enumerate(((10, 20, 30), (40, 50, 60))) for c, v in enumerate(colour)]
    extra = [(1, 3, x, y, 7) for x in range(3) for y in range(2)]
    averages = [(1, 1, x, 0, v) for x, v in enumerate(low[0])]
    rest = [(1, 2, x, 0, index[0][x] - index[1][x]) for x in range(3)]  # one pair a column: no neighbour, so no slope
    got = undone(spark.createDataFrame(table + averages + rest + extra, kind), 4, [("palette", 0, 3, 2), ("squeeze", False, True, 1, 1)])
    want = {(c, x, y): (10, 20, 30, 40, 50, 60)[3 * index[y][x] + c] for c in range(3) for x in range(3) for y in range(2)} | {(3, x, y): 7 for x in range(3) for y in range(2)}
    assert {(r.channel, r.x, r.y): r.v for r in got.collect()} == want
    end = [(1, 0, 0, 0, 5), (1, 1, 0, 0, 9), (1, 2, 0, 0, 2)]  # the residual of channel 0 stands last
    got = undone(spark.createDataFrame(end, kind), 3, [("squeeze", True, False, 0, 1)])
    assert {(r.channel, r.x, r.y): r.v for r in got.collect()} == {(0, 0, 0): 6, (0, 1, 0): 4, (1, 0, 0): 9}
