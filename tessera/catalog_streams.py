"""Further registered queries: trees, copies, curves, noise, alias tables, layouts and canvases.

These go over serial structures (a walk down a tree, a window of copies, a generator's stream) without a serial loop; the
SQL beside them is the serial form, by recursion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.catalog import ORACLE_SQL, _CAUSAL, _GROUPS, _SAMPLES, fixed, query
from tessera.functions import samples as s
from tessera.operators import alias, compositing, copies, noise, splines, stencils, transforms, trees, weighted
from tessera.plans import blocks, channels, layout, prefixes
from tessera.sources import rasters as r

_FIX = "cast(floor(({0}) * 10000 + 0.5) as bigint)"


# ---- decision trees


_TREES = """parts as (select (p_partkey - 1) % 5 as tree, (p_partkey - 1) // 5 as node, p_partkey, p_size, cast(floor(p_retailprice) as bigint) as price from part),
marked as (select *, node = 0 or node % 2 = 1 or p_size % 5 = 0 as opens from parts),
counted as (select *, row_number() over (partition by tree, opens order by node) - 1 as k, count(*) over (partition by tree) as n from marked),
split as (select *, opens and 2 * k + 2 < n as splits from counted), used as (select *, count(*) filter (where splits) over (partition by tree) as pairs from split),
trees as (select tree, node, cast(case when splits then 2 + p_size % 13 else -1 end as bigint) as property, price % 60 - 20 as split,
  case when splits then 2 * k + 1 end as "left", case when splits then 2 * k + 2 end as "right", p_partkey % 14 as predictor from used where node <= 2 * pairs)"""
_BOUNDS = f"""with recursive {_TREES}, down as (
  select tree, node, property, split, "left", "right", cast(0 as bigint) as height, list_transform(range(16), lambda i: cast(-2147483648 as bigint)) as low,
    list_transform(range(16), lambda i: cast(2147483647 as bigint)) as high from trees where node = 0
  union all
  select c.tree, c.node, c.property, c.split, c."left", c."right", d.height + 1,
    case when c.node = d."left" then list_transform(d.low, lambda v, i: case when i - 1 = d.property then greatest(v, d.split + 1) else v end) else d.low end,
    case when c.node = d."right" then list_transform(d.high, lambda v, i: case when i - 1 = d.property then least(v, d.split) else v end) else d.high end
  from down d join trees c on c.tree = d.tree and c.node in (d."left", d."right"))"""


@query(f"""{_BOUNDS} select tree, node, height, case when property >= 0 then low[property + 1] end as lower, case when property >= 0 then high[property + 1] end as upper,
  height <= 2048 and (property < 0 or low[property + 1] <= split and split < high[property + 1]) as valid from down""")
def mod2_valid(spark: SparkSession, sf: str) -> DataFrame:
    return trees.validated(r.trees(spark, sf))


@query(f"""{_BOUNDS}, ranges as (select tree, node, unnest(range(16)) as property, unnest(low) as lower, unnest(high) as upper from down)
select tree, node, property, lower, upper from ranges where lower > -2147483648 or upper < 2147483647""")
def mod2_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return trees.ranges(r.trees(spark, sf))[1].select("tree", "node", "property", "lower", "upper")


_PROPERTIES = f"""{_CAUSAL}, props as (select img, x, y, img % 5 as tree, [cast(2 as bigint), 7, y, x, abs(t), abs(l), t, l,
  l - coalesce(lag(l + t - tl) over (partition by img, y order by x), 0), l + t - tl, l - tl, tl - t, t - tr, t - tt, l - ll] as p from k)"""


@query(f"""with recursive {_TREES}, {_PROPERTIES}, walk as (
  select img, x, y, tree, p, cast(0 as bigint) as node from props
  union all
  select w.img, w.x, w.y, w.tree, w.p, case when w.p[t.property + 1] > t.split then t."left" else t."right" end
  from walk w join trees t on t.tree = w.tree and t.node = w.node and t.property >= 0)
select img, x, y, w.node as leaf, predictor from walk w join trees t on t.tree = w.tree and t.node = w.node where t.property < 0""")
def mod3_leaves(spark: SparkSession, sf: str) -> DataFrame:
    samples = stencils.pixel_properties(r.samples(spark, sf), "c2", 2, 7).withColumn("tree", F.col("img") % 5)
    nodes = r.trees(spark, sf)
    found = trees.leaves(samples.select("img", "x", "y", "tree", *[f"p{i}" for i in range(15)]), nodes, [f"p{i}" for i in range(15)], keep=["img", "x", "y", "tree"])
    kinds = nodes.select("tree", F.col("node").alias("leaf"), "predictor")
    return found.join(kinds, ["tree", "leaf"]).select("img", "x", "y", "leaf", "predictor")


# ---- the self-correcting predictor


def _wp_sql() -> str:
    """The serial form: one step a sample in reading order, its errors appended to lists. Rows are 16 samples wide."""
    e = range(4)
    back = lambda name, by, when: f"case when {when} then coalesce({name}[n + 1 - {by}], 0) else 0 end"
    around = ", ".join(
        f"{back(f'e{i}', 16, 'n >= 16')} + {back(f'e{i}', 1, 'x > 0')} as up{i}, {back(f'e{i}', 15, 'n >= 16')} as right{i}, {back(f'e{i}', 17, 'n >= 16')} + {back(f'e{i}', 2, 'x > 1')} as before{i}" for i in e
    )
    error = ", ".join(f"up{i} + case when x = 15 then up{i} else right{i} end + case when x = 0 then up{i} else before{i} end as err{i}" for i in e)
    shift = ", ".join(f"cast(greatest(floor(log2(err{i} + 1)) - 5, 0) as bigint) as s{i}" for i in e)
    most = (13, 12, 12, 12)
    weight = ", ".join(f"4 + (({most[i]} * (16777216 // ((err{i} >> s{i}) + 1))) >> s{i}) as q{i}" for i in e)
    scaled = ", ".join(f"q{i} >> (cast(floor(log2(q0 + q1 + q2 + q3)) as bigint) - 4) as r{i}" for i in e)
    guess = ["w8 + ne8 - n8", "n8 - cast(floor((tn + tw + tne) * 16 / 32) as bigint)", "w8 - cast(floor((tn + tw + tnw) * 10 / 32) as bigint)", "n8 - cast(floor((tnw * 7 + tn * 7 + tne * 7) / 32) as bigint)"]
    guesses = ", ".join(f"{g} as g{i}" for i, g in enumerate(guess))
    total = "(r0 + r1 + r2 + r3)"
    after = ", ".join(f"list_append(e{i}, (abs(g{i} - v * 8) + 3) // 8)" for i in e)
    return f"""vals as (select img, list(c2 order by y, x) as vals from samples group by img),
run as (
  select img, vals, cast(0 as bigint) as n, []::bigint[] as e0, []::bigint[] as e1, []::bigint[] as e2, []::bigint[] as e3, []::bigint[] as te, cast(0 as bigint) as pred, cast(0 as bigint) as prop from vals
  union all
  select img, vals, n + 1, {after}, list_append(te, mean - v * 8), cast(floor((mean + 3) / 8) as bigint), prop
  from (select *, case when xor(tn, tw) | xor(tn, tnw) > 0 then mean0 else least(greatest(mean0, least(w8, ne8, n8)), greatest(w8, ne8, n8)) end as mean
  from (select *, cast(floor((g0 * r0 + g1 * r1 + g2 * r2 + g3 * r3 + {total} // 2 - 1)::hugeint * (16777216 // {total}) / 16777216) as bigint) as mean0
  from (select *, {guesses}, {scaled}, list_reduce([tw, tn, tnw, tne], lambda a, b: case when abs(b) > abs(a) then b else a end) as prop
  from (select *, {weight} from (select *, {shift} from (select *, {error},
    case when x > 0 then te[n] else 0 end as tw, tn0 as tn, case when x = 0 then tn0 when n >= 16 then te[n - 16] else 0 end as tnw, case when x = 15 then tn0 when n >= 16 then te[n - 14] else 0 end as tne,
    8 * l as w8, 8 * t as n8, 8 * case when x < 15 and n >= 16 then vals[n - 14] else t end as ne8
  from (select *, {around}, case when n >= 16 then te[n - 15] else 0 end as tn0, case when n >= 16 then vals[n - 15] else l end as t
  from (select *, n % 16 as x, vals[n + 1] as v, case when n % 16 > 0 then vals[n] when n >= 16 then vals[n - 15] else 0 end as l
  from (select img, vals, n, e0, e1, e2, e3, te from run where n < len(vals))))))))))),
wp as (select img, (n - 1) % 16 as x, (n - 1) // 16 as y, pred as weighted, prop as property from run where n > 0)"""


@query(f"with recursive {_SAMPLES}, {_wp_sql()} select * from wp")
def mod6_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return weighted.weighted(r.samples(spark, sf), "c2")


@query(f"""with recursive {_PROPERTIES}, {_wp_sql()}
select img, x, y, {", ".join(f"p[{i + 1}] as p{i}" for i in range(15))}, property as p15 from props join wp using (img, x, y)""")
def mod4_all(spark: SparkSession, sf: str) -> DataFrame:
    rows = weighted.with_weighted(r.samples(spark, sf), "c2")
    return stencils.pixel_properties(rows, "c2", 2, 7).select("img", "x", "y", *[f"p{i}" for i in range(15)], F.col("property").alias("p15"))


@query(f"""with recursive {_CAUSAL}, {_wp_sql()} select img, x, y, cast(0 as bigint) as zero, l as "left", t as top, (l + t) // 2 as average0,
  case when abs(t - tl) < abs(l - tl) then l else t end as pick, tr as top_right, tl as top_left, ll as left_left, weighted,
  least(greatest(l + t - tl, least(l, t)), greatest(l, t)) as gradient, (l + tl) // 2 as average1, (tl + t) // 2 as average2,
  (t + tr) // 2 as average3, (6 * t - 2 * tt + 7 * l + ll + trr + 3 * tr + 8) // 16 as average4 from k join wp using (img, x, y)""")
def mod5_all(spark: SparkSession, sf: str) -> DataFrame:
    rows = stencils.causal(weighted.with_weighted(r.samples(spark, sf), "c2"), "c2")
    return rows.select("img", "x", "y", *[stencils.predict(kind, "weighted").alias(kind) for kind in stencils.PREDICTORS])


# ---- alias tables


_ALIAS = """counted as (select l_suppkey as dist, cast(l_quantity as bigint) - 1 as entry, count(*) as n from lineitem group by 1, 2),
upto as (select *, sum(n) over (partition by dist order by entry) as upto, sum(n) over (partition by dist) as total from counted),
shares as (select dist, entry, cast(upto * 4096 // total - (upto - n) * 4096 // total as bigint) as count from upto),
lists as (select dist, list_transform(range(64), lambda i: coalesce(m[i], 0)) as own from (select dist, map(list(entry), list(count)) as m from shares group by dist)),
stacks as (
  select dist, own, own as cut, list_filter(range(64), lambda i: own[i + 1] > 64) as over, list_filter(range(64), lambda i: own[i + 1] < 64) as under,
    list_transform(range(64), lambda i: cast(null as bigint)) as other, list_transform(range(64), lambda i: cast(0 as bigint)) as kept from lists
  union all
  select dist, own, new, case when left_in > 64 then over else over[1:len(over) - 1] end, case when left_in < 64 then list_append(under[1:len(under) - 1], over[-1]) else under[1:len(under) - 1] end,
    list_transform(other, lambda v, i: case when i - 1 = under[-1] then over[-1] else v end), list_transform(kept, lambda v, i: case when i - 1 = under[-1] then left_in else v end)
  from (select *, list_transform(cut, lambda v, i: case when i - 1 = over[-1] then left_in else v end) as new
    from (select *, cut[over[-1] + 1] - 64 + cut[under[-1] + 1] as left_in from stacks where len(over) > 0))),
tables as (select dist, unnest(range(64)) as entry, unnest(own) as own, unnest(cut) as cut, unnest(other) as other, unnest(kept) as kept, own as counts from stacks where len(over) = 0),
entries as (select dist, entry, case when cut = 64 then 0 else cut end as cutoff, case when cut = 64 then entry else other end as other, case when cut = 64 then 0 else kept - cut end as shift,
  own, counts[case when cut = 64 then entry else other end + 1] as its from tables)"""


@query(f"with recursive {_ALIAS} select * from entries")
def ent5_table(spark: SparkSession, sf: str) -> DataFrame:
    return alias.table(r.distributions(spark, sf))


@query(f"""with recursive {_ALIAS}, vals as (select l_orderkey as id, l_suppkey as dist, (l_partkey * 131 + l_orderkey * 31 + l_linenumber) % 4096 as value from lineitem)
select id, dist, value, case when value % 64 >= cutoff then other else entry end as symbol, case when value % 64 >= cutoff then shift else 0 end + value % 64 as place,
  case when value % 64 >= cutoff then its else own end as count from vals join entries using (dist) where entry = value // 64""")
def ent5_symbols(spark: SparkSession, sf: str) -> DataFrame:
    value = (F.col("l_partkey") * 131 + F.col("l_orderkey") * 31 + F.col("l_linenumber")) % 4096
    values = r.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("dist"), value.alias("value"))
    return alias.symbols(values, alias.table(r.distributions(spark, sf)))


# ---- window copies


@query("""with t as (select user_id as stream, event_id as idx, case when event_id % 3 = 0 then event_id * 37 % 256 end as literal, event_id * 7 % 23 + 1 as far, event_id % 9 as n from events),
s as (select stream, list([coalesce(literal, -1), far, case when literal is null then n else 1 end] order by idx) as tokens from t group by stream),
o as (select stream, list_reduce(list_prepend([]::bigint[], list_transform(tokens, lambda t: t)), lambda out, t:
  case when t[1] >= 0 then list_append(out, t[1])
       else list_reduce(list_prepend(out, list_transform(range(t[3]), lambda j: [len(out) - least(t[2], len(out)) + j + 1])), lambda a, c: list_append(a, coalesce(a[c[1]], 0))) end) as out from s)
select stream, unnest(range(len(out))) as pos, unnest(out) as v from o""")
def ent8_copies(spark: SparkSession, sf: str) -> DataFrame:
    return copies.resolved(copies.positions(r.tokens(spark, sf)))


# ---- curves


_POINTS = """pts as (select o_custkey as spline, row_number() over (partition by o_custkey order by o_orderkey) - 1 as i, (o_totalprice + o_orderkey) % 13.0::double as x, o_totalprice * 7.0::double % 11.0::double as y from orders),
quads as (select spline, i, x as x1, y as y1, lag(x) over w as x0, lag(y) over w as y0, lead(x) over w as x2, lead(y) over w as y2, lead(x, 2) over w as x3, lead(y, 2) over w as y3
  from pts window w as (partition by spline order by i)),
ext as (select spline, i, x1, y1, x2, y2, coalesce(x0, x1 + (x1 - x2)) as x0, coalesce(y0, y1 + (y1 - y2)) as y0, coalesce(x3, x2 + (x2 - x1)) as x3, coalesce(y3, y2 + (y2 - y1)) as y3 from quads),
knots as (select *, pow(pow(x1 - x0, 2) + pow(y1 - y0, 2), 0.25) as d0, pow(pow(x2 - x1, 2) + pow(y2 - y1, 2), 0.25) as d1, pow(pow(x3 - x2, 2) + pow(y3 - y2, 2), 0.25) as d2 from ext where x2 is not null),
times as (select *, d0 as t1, d0 + d1 as t2, d0 + d1 + d2 as t3, unnest(range(16)) as step from knots), tt as (select *, d0 + step / 16::double * d1 as t from times),
a as (select *, x0 + t / d0 * (x1 - x0) as ax0, y0 + t / d0 * (y1 - y0) as ay0, x1 + (t - t1) / d1 * (x2 - x1) as ax1, y1 + (t - t1) / d1 * (y2 - y1) as ay1,
  x2 + (t - t2) / d2 * (x3 - x2) as ax2, y2 + (t - t2) / d2 * (y3 - y2) as ay2 from tt),
b as (select *, ax0 + t / (d0 + d1) * (ax1 - ax0) as bx0, ay0 + t / (d0 + d1) * (ay1 - ay0) as by0, ax1 + (t - t1) / (d1 + d2) * (ax2 - ax1) as bx1, ay1 + (t - t1) / (d1 + d2) * (ay2 - ay1) as by1 from a),
line as (select spline, i * 16 + step as n, case when step = 0 then x1 else bx0 + (t - t1) / d1 * (bx1 - bx0) end as x, case when step = 0 then y1 else by0 + (t - t1) / d1 * (by1 - by0) end as y from b
  union all select spline, i * 16, x1, y1 from quads where x2 is null)"""
#: The serial walk along each line: a state of the last point drawn, the point reached, and how far it is from that one.
_WALK = f"""{_POINTS}, ln as (select spline, list(x order by n) as xs, list(y order by n) as ys from line group by spline),
walk as (
  select spline, xs, ys, cast(1 as bigint) as nxt, xs[1] as px, ys[1] as py, 0.0::double as far, true as drawn, cast(0 as bigint) as k, 1.0::double as intensity from ln
  union all
  select spline, xs, ys, case when hit or ended then nxt else nxt + 1 end, case when ended then px when hit then px + (1 - far) / gap * (xs[nxt] - px) else xs[nxt] end,
    case when ended then py when hit then py + (1 - far) / gap * (ys[nxt] - py) else ys[nxt] end, case when ended then far when hit then 0 else far + gap end, hit or ended,
    case when hit or ended then k + 1 else k end, case when ended then far else 1.0 end
  from (select *, nxt > len(xs) as ended, far + gap >= 1 as hit
    from (select *, coalesce(sqrt(pow(xs[nxt] - px, 2) + pow(ys[nxt] - py, 2)), 0) as gap from walk where nxt <= len(xs) + 1 and not (drawn and nxt > len(xs) and intensity < 1)))
  where not (ended and drawn and k > 0 and intensity < 1)),
steps as (select spline, k, px as x, py as y, intensity from walk where drawn)"""


@query(f"with {_POINTS} select spline, n, {_FIX.format('x')} as x, {_FIX.format('y')} as y from line")
def syn7_curve(spark: SparkSession, sf: str) -> DataFrame:
    return splines.curve(r.curve_points(spark, sf), strict=False).select("spline", "n", fixed("x").alias("x"), fixed("y").alias("y"))


def _stepped(spark: SparkSession, sf: str) -> DataFrame:
    return splines.stepped(splines.curve(r.curve_points(spark, sf), strict=False))


@query(f"with recursive {_WALK} select spline, k, {_FIX.format('x')} as x, {_FIX.format('y')} as y, {_FIX.format('intensity')} as intensity from steps")
def syn7_steps(spark: SparkSession, sf: str) -> DataFrame:
    return _stepped(spark, sf).select("spline", "k", *[fixed(c).alias(c) for c in ("x", "y", "intensity")])


def _series(spark: SparkSession, sf: str) -> DataFrame:
    """Made-up series of colours and widths for each spline."""
    term = F.sequence(F.lit(0).cast("bigint"), F.lit(31).cast("bigint"))
    colour = lambda c: F.transform(term, lambda j: (F.col("spline") * (j + 3) * (c + 1) % 17 - 8) / (j + 1.0))
    width = F.transform(term, lambda j: F.when(j == 0, 1.5 + F.col("spline") % 5 / 4.0).otherwise((F.col("spline") * j % 3 - 1) * 0.02))
    rows = r.curve_points(spark, sf).select("spline").distinct()
    return rows.select("spline", F.array(*[colour(c) for c in range(3)]).alias("colours"), width.alias("sigmas"))


def _series_sql(term: str) -> str:
    return f"list_sum(list_transform(range(32), lambda j: sqrt(2::double) * ({term}) * cos(pi() / 32 * j * (31 * p + 0.5))))"


@query(f"""with recursive {_WALK}, arcs as (select *, sum(intensity) over (partition by spline) - 1 as arc from steps),
prog as (select *, least(k / arc, 1) as p from arcs where arc > 0),
lit as (select *, {_series_sql('case when j = 0 then 1.5 + spline % 5 / 4::double else (spline * j % 3 - 1) * 0.02::double end')} as sigma,
  {", ".join(_series_sql(f"(spline * (j + 3) * {c + 1} % 17 - 8) / (j + 1)::double") + f" as c{c}" for c in range(3))} from prog),
far as (select *, sqrt(-2 * sigma * sigma * (ln(0.1::double) * 3 - ln(greatest(0.01::double, abs(c0 * intensity), abs(c1 * intensity), abs(c2 * intensity))))) as reach from lit)
select spline, k, channel, {_FIX.format('x')} as cx, {_FIX.format('y')} as cy, {_FIX.format('reach')} as reach, {_FIX.format('sigma')} as sigma, {_FIX.format('intensity')} as intensity, {_FIX.format('[c0, c1, c2][channel + 1]')} as colour
from far, (select unnest(range(3)) as channel) where sigma <> 0""")
def syn8_segments(spark: SparkSession, sf: str) -> DataFrame:
    found = splines.segments(_stepped(spark, sf), _series(spark, sf))
    return found.select("spline", "k", F.col("channel").cast("bigint").alias("channel"), *[fixed(c).alias(c) for c in ("cx", "cy", "reach", "sigma", "intensity", "colour")])


# ---- noise


_NOISE = """imgs as (select s_suppkey as img, 17 + s_suppkey % 30 as w, 5 + s_suppkey % 19 as h from supplier),
corners as (select *, unnest(range(0, w, 16)) as x0 from imgs), groups as (select *, unnest(range(0, h, 16)) as y0 from corners),
seeds as (select distinct x0, y0, (4294967296::uhugeint + 11400714819323198485::uhugeint) % 18446744073709551616::uhugeint as a,
  (x0::uhugeint * 4294967296::uhugeint + y0::uhugeint + 11400714819323198485::uhugeint) % 18446744073709551616::uhugeint as b from groups),
lanes as (select x0, y0, 0 as lane, {0} as s0, {1} as s1 from seeds union all select x0, y0, lane + 1, {2}, {3} from lanes where lane < 7),
run as (
  select x0, y0, lane, cast(0 as bigint) as n, s0, s1 from lanes
  union all select x0, y0, lane, n + 1, s1, xor(xor(m, s1), xor(m >> 18, s1 >> 5)) from (select *, xor(s0, s0 * 8388608::uhugeint % 18446744073709551616::uhugeint) as m from run where n < 47)),
bits as (select x0, y0, n, lane, (s0 + s1) % 18446744073709551616::uhugeint as v from run),
halves as (select x0, y0, n, 2 * lane + half as i, case when half = 0 then v % 4294967296::uhugeint else v >> 32 end as v from bits, (select unnest(range(2)) as half)),
spots as (select *, least(16, w - x0) as gw, least(16, h - y0) as gh from groups), planes as (select *, unnest(range(3)) as plane from spots), lines as (select *, unnest(range(gh)) as row from planes)"""


def _mix(z: str) -> str:
    one = f"(xor({z}, {z} >> 30) * 13787848793156543929::uhugeint % 18446744073709551616::uhugeint)"
    two = f"(xor({one}, {one} >> 27) * 10723151780598845931::uhugeint % 18446744073709551616::uhugeint)"
    return f"xor({two}, {two} >> 31)"


@query(f"""with recursive {_NOISE.format(*map(_mix, ("a", "b", "s0", "s1")))}
select img, plane, x0 + i as x, y0 + row as y, cast(v >> 9 as bigint) as v from lines join halves using (x0, y0) where n = plane * gh + row and i < gw""")
def syn2_noise(spark: SparkSession, sf: str) -> DataFrame:
    planes = noise.noise(r.noise_groups(spark, sf))
    return planes.select("img", "plane", "x", "y", ((F.col("v") - 1) * (1 << 23)).cast("bigint").alias("v"))


# ---- layouts


_PLACED = """sized as (select user_id as grp, list([[1, 1], [2, 2], [1, 2], [2, 1], [4, 4], [1, 4], [4, 1], [2, 4], [4, 2]][event_id % 9 + 1] order by event_id) as items, 4 + user_id % 5 as w from events group by user_id),
grids as (select grp, items, w, len(items) // w as h from sized),
put as (
  select grp, items, w, h, cast(0 as bigint) as n, list_transform(range(w * h), lambda c: cast(-1 as bigint)) as cells from grids
  union all
  select grp, items, w, h, n + 1, list_transform(cells, lambda v, c: case when (c - 1) % w >= x and (c - 1) % w < x + items[n + 1][1] and (c - 1) // w >= y and (c - 1) // w < y + items[n + 1][2] then n else v end)
  from (select *, (list_position(cells, -1) - 1) % w as x, (list_position(cells, -1) - 1) // w as y from put where list_position(cells, -1) > 0 and n < len(items)))"""


@query(f"""with recursive {_PLACED}, spot as (select grp, w, items, n - 1 as n, list_position(before, -1) - 1 as c from (select *, lag(cells) over (partition by grp order by n) as before from put) where n > 0)
select grp as "group", n, c % w as x, c // w as y, cast(items[n + 1][1] as bigint) as bw, cast(items[n + 1][2] as bigint) as bh from spot""")
def vdp9_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.laid_out(r.placements(spark, sf))


@query(f"""with recursive {_PLACED}, done as (select grp, w, arg_max(cells, n) as cells from put group by grp, w), c as (select grp, w, unnest(range(len(cells))) as c, unnest(cells) as n from done)
select grp as "group", c % w as x, c // w as y, n from c where n >= 0""")
def vdp9_cover(spark: SparkSession, sf: str) -> DataFrame:
    rows = r.placements(spark, sf)
    return blocks.covers(blocks.laid_out(rows), rows).select("group", "x", "y", "n")


_PLANS = """chans as (select o_orderkey as plan, o_orderkey * 131 % 3000 + 1 as w, o_orderkey * 71 % 2000 + 1 as h, unnest(range(3 + o_orderkey % 2)) as k from orders),
firsts as (select plan, list(struct_pack(w := (w + (1 << (k // 3)) - 1) // (1 << (k // 3)), h := (h + (1 << (k // 3)) - 1) // (1 << (k // 3)), hs := cast(k // 3 as bigint), vs := cast(k // 3 as bigint), component := cast(k as bigint)) order by k) as ch from chans group by plan),
lists as (select l_orderkey as plan, list(struct_pack(kind := l_partkey % 3, b := l_suppkey % 3, n := 1 + l_partkey * 7 % 3, table_size := l_partkey % 50 + 1 + l_suppkey % 4, named := l_quantity > 25, across := l_partkey % 2 = 0, in_place := l_suppkey % 2 = 0)
  order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as steps from lineitem group by 1),
st as (
  select plan, steps, cast(0 as bigint) as done, cast(0 as bigint) as meta, cast(null as varchar) as error, ch, []::struct(across boolean, in_place boolean, b bigint, n bigint)[] as pend from firsts left join lists using (plan)
  union all
  select plan, steps, case when popped then done else done + 1 end,
    case when fault is not null then meta when popped then case when q.b < meta then meta + q.n else meta end when t.kind = 1 then case when t.b >= meta then meta + 1 else meta + 2 - t.n end else meta end,
    fault,
    case when fault is not null then ch
      when popped then case when q.in_place then list_concat(ch[1:q.b], low, lost, ch[q.b + q.n + 1:]) else list_concat(ch[1:q.b], low, ch[q.b + q.n + 1:], lost) end
      when t.kind = 1 then list_concat([struct_pack(w := t.table_size, h := t.n, hs := cast(-1 as bigint), vs := cast(-1 as bigint), component := cast(null as bigint))], ch[1:t.b + 1], ch[t.b + t.n + 1:]) else ch end,
    case when popped then pend[2:] when t.kind = 2 then case when t.named then [struct_pack(across := t.across, in_place := t.in_place, b := t.b, n := t.n)] else defaults end else pend end
  from (select *, list_transform(held, lambda c: struct_pack(w := case when q.across then (c.w + 1) // 2 else c.w end, h := case when q.across then c.h else (c.h + 1) // 2 end, hs := c.hs + case when q.across then 1 else 0 end, vs := c.vs + case when q.across then 0 else 1 end, component := c.component)) as low,
      list_transform(held, lambda c: struct_pack(w := case when q.across then c.w // 2 else c.w end, h := case when q.across then c.h else c.h // 2 end, hs := c.hs + case when q.across then 1 else 0 end, vs := c.vs + case when q.across then 0 else 1 end, component := c.component)) as lost,
      case when popped then
          case when q.b + q.n > len(ch) or q.n < 1 then 'channel range' when q.b < meta and q.b + q.n > meta then 'meta and image channels' when q.b < meta and not q.in_place then 'meta residuals'
            when len(list_filter(held, lambda c: c.w = 0 or c.h = 0)) > 0 then 'empty channel' when len(list_filter(held, lambda c: c.hs > 30 or c.vs > 30)) > 0 then 'too many squeezes' end
        when t.kind < 2 then
          case when t.b + cn > len(ch) then 'channel range' when t.b < meta and t.b + cn > meta then 'meta and image channels'
            when len(list_filter(ch[t.b + 1:t.b + cn], lambda c: c.w <> ch[t.b + 1].w or c.h <> ch[t.b + 1].h or c.hs <> ch[t.b + 1].hs or c.vs <> ch[t.b + 1].vs)) > 0 then 'channels differ' end end as fault,
      list_concat(case when len(ch) - meta > 2 and ch[meta + 2].w = cw and ch[meta + 2].h = chh then [struct_pack(across := true, in_place := false, b := meta + 1, n := cast(2 as bigint)), struct_pack(across := false, in_place := false, b := meta + 1, n := cast(2 as bigint))] else [] end,
        list_transform(list_sort(list_concat(
            list_transform(list_filter(range(12), lambda i: cw > (8 << i)), lambda i: [2 * i, 1]),
            list_transform(list_filter(range(12), lambda i: chh > (8 << i)), lambda i: [case when cw > chh then 2 * i + 1 else 2 * i - 1 end, 0]))),
          lambda o: struct_pack(across := o[2] = 1, in_place := true, b := meta, n := len(ch) - meta))) as defaults
    from (select *, ch[q.b + 1:q.b + q.n] as held, case when t.kind = 0 then 3 else t.n end as cn, ch[meta + 1].w as cw, ch[meta + 1].h as chh
      from (select *, len(pend) > 0 as popped, pend[1] as q, steps[done + 1] as t from st where error is null and (len(pend) > 0 or done < len(steps))))))"""


@query(f"""with recursive {_PLANS} select plan, meta, error, unnest(range(len(ch))) as channel, unnest(list_transform(ch, lambda c: c.w)) as w, unnest(list_transform(ch, lambda c: c.h)) as h,
  unnest(list_transform(ch, lambda c: c.hs)) as hs, unnest(list_transform(ch, lambda c: c.vs)) as vs, unnest(list_transform(ch, lambda c: c.component)) as component
from st where error is not null or (len(pend) = 0 and done >= coalesce(len(steps), 0))""")
def mod9_channels(spark: SparkSession, sf: str) -> DataFrame:
    found = channels.planned(r.channel_lists(spark, sf), r.transform_lists(spark, sf))
    rows = found.select("plan", "meta", "error", F.posexplode("channels").alias("channel", "c"))
    return rows.select("plan", "meta", "error", F.col("channel").cast("bigint").alias("channel"), "c.w", "c.h", "c.hs", "c.vs", "c.component")


# ---- canvases


@query("""with f as (select cast(s_nationkey as bigint) as img, s_suppkey as frame, s_suppkey % 23 - 6 as x0, s_suppkey % 17 - 4 as y0, s_suppkey % 4 = 0 as whole, s_suppkey % 11 + 3 as pw, s_suppkey % 7 + 2 as ph from supplier),
c as (select img, x, y from (select distinct img from f), (select unnest(range(20)) as x), (select unnest(range(15)) as y)),
l as (select c.img, c.x, c.y, frame, whole, frame * 37 + (x - x0) * 11 + (y - y0) * 5 as base from c join f on c.img = f.img and x >= x0 and x < x0 + pw and y >= y0 and y < y0 + ph),
s as (select g.img, g.frame, c.x, c.y, list([base % 256, base * 3 % 256, base * 7 % 256, base * 13 % 256, case when l.whole then 1 else 0 end] order by l.frame) filter (where l.frame is not null) as layers
  from f g join c on c.img = g.img left join l on l.img = c.img and l.x = c.x and l.y = c.y and l.frame <= g.frame group by all),
d as (select img, frame, x, y, list_reduce(list_prepend([0, 0, 0, 0, 0], coalesce(layers, [])), lambda b, s: case when s[5] = 1 then s else [
    (s[1] * s[4] + b[1] * (255 - s[4]) + 127) // 255, (s[2] * s[4] + b[2] * (255 - s[4]) + 127) // 255, (s[3] * s[4] + b[3] * (255 - s[4]) + 127) // 255,
    least(s[4] + (b[4] * (255 - s[4]) + 127) // 255, 255), 0] end) as v from s)
select img, frame, x, y, v[1] as r, v[2] as g, v[3] as b, v[4] as a from d""")
def out15_canvas(spark: SparkSession, sf: str) -> DataFrame:
    return compositing.canvases(*r.rectangles_of_frames(spark, sf))


# ---- chains of transforms


@query(f"select img, y as x, x as y, v from ({ORACLE_SQL['xfm4_squeeze']})")
def xfm4_columns(spark: SparkSession, sf: str) -> DataFrame:
    """The images of ``xfm4_squeeze`` turned on their side, so that the squeeze goes down the columns."""
    rows = r.samples(spark, sf).select("img", F.col("y").alias("x"), F.col("x").alias("y"), "c0", "c1")
    low, rest = rows.select("img", "x", "y", F.col("c0").alias("v")), rows.select("img", "x", "y", (F.col("c1") - 4).alias("v"))
    return transforms.unsqueezed(low, rest, across=False)


@query(f"""with low as ({ORACLE_SQL['xfm4_squeeze']}), pal as (select p_size - 1 as i, min(p_partkey) as k from part group by 1),
q as (select img, x, y, k % 256 as a, k * 7 % 256 as b, k * 13 % 256 as c from low join pal on pal.i = least(greatest(v, 0), 49)),
t as (select img, x, y, a - (c >> 1) as t, b, c from q), rgb as (select img, x, y, [t - (b >> 1) + b, c + t, t - (b >> 1)] as v from t)
select img, x, y, cast(unnest(range(3)) as bigint) as channel, unnest(v) as v from rgb""")
def xfm1_chain(spark: SparkSession, sf: str) -> DataFrame:
    """A colour transform, then a palette, then a squeeze of its index: coded as a table, averages and residuals."""
    rows = r.samples(spark, sf)
    channel = lambda n, v: rows.select("img", F.lit(n).cast("bigint").alias("channel"), "x", "y", v.alias("v"))
    colours = r.palette(spark, sf).select(F.col("i").alias("x"), F.posexplode(F.array("r", "g", "b")).alias("y", "v"))
    table = rows.select("img").distinct().join(F.broadcast(colours.select("x", F.col("y").cast("bigint").alias("y"), "v")))  # 50 colours for each image
    coded = table.select("img", F.lit(0).cast("bigint").alias("channel"), "x", "y", "v").union(channel(1, F.col("c0"))).union(channel(2, F.col("c1") - 4))
    return transforms.undone(coded, 3, [("rct", 6, 0), ("palette", 0, 3, 50), ("squeeze", True, True, 1, 1)])


@query(f"""with {_SAMPLES} select img, x, y, (c0 * 65535 + 127) // 255 as r, (c1 * 65535 + 127) // 255 as g, (c2 * 65535 + 127) // 255 as b, (least(c1 * 36, 255) * 65535 + 127) // 255 as a from samples""")
def out4_rgba(spark: SparkSession, sf: str) -> DataFrame:
    """Interleaved with an alpha channel of its own."""
    alpha = s.clamp(F.col("c1") * 36, F.lit(0), F.lit(255))
    shown = {"r": F.col("c0"), "g": F.col("c1"), "b": F.col("c2"), "a": alpha}
    return r.samples(spark, sf).select("img", "x", "y", *[s.scale_depth(c, 8, 65535).alias(n) for n, c in shown.items()])


# ---- prefix codes, pruning by channels, names


_TURN = "list_sum(list_transform(range({w}), lambda b: (({v} >> b) & 1) << ({w} - 1 - b)))"
_PREFIX = """alphabets as (select p_partkey // 100 as grp, p_partkey as symbol, row_number() over (partition by p_partkey // 100 order by p_partkey) as k, count(*) over (partition by p_partkey // 100) as n from part),
cut as (select *, least(grp % 8, n - 1) as a, length(bin(n - least(grp % 8, n - 1))) - 1 as e from alphabets),
lens as (select grp, symbol, cast(case when k <= a then k when k - a <= (1 << cast(e + 1 as int)) - (n - a) then a + e else a + e + 1 end as int) as len from cut),
spans as (select *, coalesce(sum(1 << (15 - len)) over (partition by grp order by len, symbol rows between unbounded preceding and 1 preceding), 0) as start, 1 << (15 - len) as span from lens),
heads as (select distinct grp, range as slot, {turn8} * 128 as v from spans, range(256)),
met as (select h.grp, slot, v, max(len) as most, min(symbol) as symbol from heads h join spans s on s.grp = h.grp and s.start < v + 128 and v < s.start + s.span group by all),
placed as (select *, 256 + coalesce(sum(case when most > 8 then 1 << (most - 8) else 0 end) over (partition by grp order by v rows between unbounded preceding and 1 preceding), 0) as place from met),
inside as (select grp, place, v, most - 8 as width, unnest(range(1 << (most - 8))) as j from placed where most > 8),
turned as (select *, v + ({turnw} << (7 - width)) as spot from inside),
slots as (select grp, slot, most as bits, case when most > 8 then place else symbol end as value from placed
  union all select t.grp, place + j, len - 8, symbol from turned t join spans s on s.grp = t.grp and s.start <= spot and spot < s.start + s.span)""".format(turn8=_TURN.format(w=8, v="range"), turnw=_TURN.format(w="width", v="j"))


def _lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Complete codes: of every hundred parts the first few have codes of 1, 2, 3, ... bits, the others two lengths beyond."""
    whole = W.partitionBy("grp")
    rows = r.table(spark, sf, "part").select(s.div("p_partkey", F.lit(100)).alias("grp"), F.col("p_partkey").alias("symbol"))
    rows = rows.withColumns({"k": F.row_number().over(whole.orderBy("symbol")), "n": F.count("*").over(whole)})
    rows = rows.withColumn("a", F.least(F.col("grp") % 8, F.col("n") - 1)).withColumn("e", F.length(F.bin(F.col("n") - F.col("a"))) - 1)
    rest = F.expr("case when k - a <= shiftleft(1L, int(e + 1)) - (n - a) then a + e else a + e + 1 end")
    # the one symbol of a group has no bits to spend; any length says that it is there
    length = F.when(F.col("n") == 1, 1).when(F.col("k") <= F.col("a"), F.col("k")).otherwise(rest)
    return rows.select("grp", "symbol", length.cast("int").alias("len"))


@query(f"with {_PREFIX} select grp, cast(slot as bigint) as slot, cast(bits as int) as bits, cast(value as bigint) as value from slots")
def ent9_tables(spark: SparkSession, sf: str) -> DataFrame:
    return prefixes.tables(_lengths(spark, sf), "grp", "symbol", "len")


@query(f"""with {_PREFIX}, ahead as (select o_orderkey as id, o_orderkey % 200 as grp, o_orderkey * 7919 % 32768 as bits from orders)
select id, a.grp, a.bits as ahead, symbol, cast(len as bigint) as used from (select *, {_TURN.format(w=15, v='bits')} as code from ahead) a
  join spans s on s.grp = a.grp and s.start <= a.code and a.code < s.start + s.span""")
def ent9_symbols(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    windows = r.table(spark, sf, "orders").select(k.alias("id"), (k % 200).alias("grp"), (k * 7919 % 32768).alias("ahead"))
    return prefixes.looked_up(windows, prefixes.tables(_lengths(spark, sf), "grp", "symbol", "len"), "grp", "ahead")


@query(f"""with {_GROUPS}, c as (select *, unnest(range(3)) as channel, (frame * 31 + grp * 7) % 5 as payload from grps),
d as (select *, (frame + channel) % 4 - 1 as hs, (frame * 3 + channel) % 4 - 1 as vs from c),
k as (select *, x // pow(2, greatest(hs, 0)) * pow(2, greatest(hs, 0)) as left_, y // pow(2, greatest(vs, 0)) * pow(2, greatest(vs, 0)) as top_,
  gw // pow(2, greatest(hs, 0)) * pow(2, greatest(hs, 0)) as wide, gh // pow(2, greatest(vs, 0)) * pow(2, greatest(vs, 0)) as high from d)
select frame, grp from k where payload > 0 group by frame, grp
having bool_or(hs = -1 or vs = -1 or (left_ < 900 and left_ + wide > 300 and top_ < 700 and top_ + high > 500))""")
def roi2_channels(spark: SparkSession, sf: str) -> DataFrame:
    rows = layout.groups(layout.group_layout(r.frames(spark, sf))).withColumn("channel", F.explode(F.sequence(F.lit(0), F.lit(2))))
    rows = rows.withColumns({"hshift": (F.col("frame") + F.col("channel")) % 4 - 1, "vshift": (F.col("frame") * 3 + F.col("channel")) % 4 - 1, "payload": (F.col("frame") * 31 + F.col("grp") * 7) % 5})
    own = lambda c, by: F.expr(f"shiftright({c}, int(greatest({by}, 0)))").alias(c)
    rows = rows.select("frame", "grp", "payload", "hshift", "vshift", own("x", "hshift"), own("y", "vshift"), own("gw", "hshift"), own("gh", "vshift"))
    return layout.needed_for_channels(rows, 300, 500, 900, 700)


@query("""select event_id as id,
  case event_id % 18 when 0 then 'alpha' when 1 then 'depth' when 2 then 'spot colour' when 3 then 'selection mask' when 4 then 'black' when 5 then 'colour filter array'
    when 6 then 'thermal' when 15 then 'unknown' when 16 then 'optional' end as channel,
  case event_id % 13 when 1 then 'd65' when 2 then 'custom' when 10 then 'e' when 11 then 'dci' end as white,
  case event_id % 12 when 1 then 'srgb' when 2 then 'custom' when 9 then 'rec2100' when 11 then 'p3' end as primaries,
  case event_id % 20 when 1 then 'bt709' when 2 then 'unknown' when 8 then 'linear' when 13 then 'srgb' when 16 then 'pq' when 17 then 'dci' when 18 then 'hlg' end as transfer,
  case event_id % 5 when 0 then 'perceptual' when 1 then 'relative' when 2 then 'saturation' when 3 then 'absolute' end as intent,
  case event_id % 4 when 0 then 'xyb' when 1 then 'none' when 2 then 'ycbcr' end as transform from events""")
def hdr16_sparse(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    codes = {"channel": 18, "white": 13, "primaries": 12, "transfer": 20, "intent": 5, "transform": 4}
    return r.table(spark, sf, "events").select(k.alias("id"), *[layout.sparse_label(kind, k % n).alias(kind) for kind, n in codes.items()])
