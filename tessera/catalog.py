"""Every registered query of the raster operators, with the SQL that gives the same rows.

Where an operator ends in fractions the query rounds them to ten-thousandths as integers, in both engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import coding
from tessera.functions import samples as s
from tessera.operators import assembly, geometry, stencils, transforms
from tessera.plans import layout
from tessera.sources import rasters as r

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def fixed(c: Column | str) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) * 10000 + 0.5).cast("bigint")


_SAMPLES = """samples as (
  select img, n % 16 as x, n // 16 as y, c0, c1, c2 from (
    select l_suppkey as img, cast(l_quantity as bigint) as c0, cast(l_linenumber as bigint) as c1,
           cast(floor(l_extendedprice) as bigint) % 256 as c2,
           row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 as n
    from lineitem))"""
_BLOCKS = "blocks as (select vec_id as blk, unnest(range(64)) as k, cast(unnest(embedding) as double) as v from embeddings)"
_ANIM = """anim as (select user_id as img, event_id as frame, event_id * 37 % 256 as colour,
  cast(round(value * 100) as bigint) % 256 as alpha from events)"""
_TOC = """toc as (select user_id as frame, row_number() over (partition by user_id order by event_id) - 1 as idx,
  cast(round(value * 100) as bigint) as size from events)"""
_FRAMES = "frames as (select o_orderkey as frame, o_orderkey * 131 % 3000 + 1 as w, o_orderkey * 71 % 2000 + 1 as h from orders)"
_RECTS = """rects as (select o_orderkey as id, o_orderkey * 97 % 4000 as x0, o_orderkey * 61 % 4000 as y0,
  o_orderkey * 97 % 4000 + o_orderkey % 90 + 1 as x1, o_orderkey * 61 % 4000 + o_orderkey % 70 + 1 as y1 from orders),
regions as (select cast(n_nationkey as bigint) as region, n_nationkey * 150 as x0, n_nationkey * 130 as y0,
  n_nationkey * 150 + 400 as x1, n_nationkey * 130 + 300 as y1 from nation)"""
_LAYOUT = f"""{_FRAMES}, lay as (
  select *, 256 as group_dim, (w + 255) // 256 as groups_x, (h + 255) // 256 as groups_y,
         ((w + 7) // 8 + 255) // 256 as dc_groups_x, ((h + 7) // 8 + 255) // 256 as dc_groups_y from frames),
layout as (
  select *, case when groups_x * groups_y = 1 then 1 else 2 + dc_groups_x * dc_groups_y + groups_x * groups_y end as sections from lay)"""
_GROUPS = f"""{_LAYOUT}, gy as (select *, unnest(range(groups_y)) as gy from layout),
gxy as (select *, unnest(range(groups_x)) as gx from gy),
grps as (select frame, gy * groups_x + gx as grp, gx * 256 as x, gy * 256 as y,
  least(256, w - gx * 256) as gw, least(256, h - gy * 256) as gh from gxy)"""
_NAMES = """names as (select p_partkey as id, p_name from part),
bytes as (select id, pos, ascii(substr(p_name, pos + 1, 1)) as byte
  from (select id, p_name, unnest(range(cast(octet_length(encode(p_name)) as bigint))) as pos from names))"""
_WRAP = "((({0}) + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648"


@query(f"""with {_SAMPLES}, c as (
  select img, x - 3 as x, y - 2 as y, c0 - (c2 >> 1) as t, c1, c2 from samples where x between 3 and 12 and y between 2 and 19),
p as (select img, x, y, t - (c1 >> 1) + c1 as r, c2 + t as g, t - (c1 >> 1) as b from c)
select img, x, y, (least(greatest(r, 0), 255) * 65535 + 127) // 255 as r, (least(greatest(g, 0), 255) * 65535 + 127) // 255 as g,
       (least(greatest(b, 0), 255) * 65535 + 127) // 255 as b, cast(65535 as bigint) as a from p""")
def out4_interleave(spark: SparkSession, sf: str) -> DataFrame:
    part = geometry.crop(r.samples(spark, sf), 3, 2, 10, 18)
    rgb = s.inverse_rct(6, "c0", "c1", "c2")
    shown = [s.scale_depth(s.clamp(c, F.lit(0), F.lit(255)), 8, 65535).alias(n) for c, n in zip(rgb, "rgb")]
    return part.select("img", "x", "y", *shown, F.lit(65535).cast("bigint").alias("a"))


@query(f"""with {_SAMPLES}, t as (select *, c2 + c0 as c, c1 + ((c0 + c2 + c0) >> 1) as b, c0 - (c2 >> 1) as q from samples)
select img, x, y, c as a0, c0 as a1, b as a2, c2 + q as b0, q - (c1 >> 1) as b1, q - (c1 >> 1) + c1 as b2 from t""")
def xfm3_rct(spark: SparkSession, sf: str) -> DataFrame:
    one, two = s.inverse_rct(12, "c0", "c1", "c2"), s.inverse_rct(20, "c0", "c1", "c2")
    return r.samples(spark, sf).select("img", "x", "y", *[c.alias(f"a{i}") for i, c in enumerate(one)], *[c.alias(f"b{i}") for i, c in enumerate(two)])


@query(f"""with {_SAMPLES}, pal as (
  select p_size - 1 as i, min(p_partkey) as k from part group by 1),
q as (select img, x, y, least(greatest(c2 % 64, 0), 49) as i from samples)
select img, x, y, k % 256 as r, k * 7 % 256 as g, k * 13 % 256 as b from q left join pal using (i)""")
def xfm2_palette(spark: SparkSession, sf: str) -> DataFrame:
    idx = r.samples(spark, sf).select("img", "x", "y", (F.col("c2") % 64).alias("idx"))
    return transforms.look_up_palette(idx, r.palette(spark, sf), 50).drop("idx")


_TEND = """case when p >= a and a >= n then
    case when d1 + (d1 & 1) > 2 * (a - n) then 2 * (a - n) else d1 end
  when p <= a and a <= n then
    case when e1 - (e1 & 1) < 2 * (a - n) then 2 * (a - n) else e1 end else 0 end"""
_TEND_STEPS = """select *, (4 * p - 3 * n - a + 6) // 12 as d0, (4 * p - 3 * n - a - 6) // 12 as e0 from {0}"""
_TEND_STEPS2 = """select *, case when d0 - (d0 & 1) > 2 * (p - a) then 2 * (p - a) + 1 else d0 end as d1,
  case when e0 + (e0 & 1) < 2 * (p - a) then 2 * (p - a) - 1 else e0 end as e1 from {0}"""


@query(f"""with {_SAMPLES}, t0 as (select img, x, y, c0 as p, c1 * 7 as a, c2 % 50 as n from samples),
t1 as ({_TEND_STEPS.format('t0')}), t2 as ({_TEND_STEPS2.format('t1')})
select img, x, y, {_TEND} as tendency from t2""")
def xfm5_tendency(spark: SparkSession, sf: str) -> DataFrame:
    return r.samples(spark, sf).select("img", "x", "y", s.smooth_tendency("c0", F.col("c1") * 7, F.col("c2") % 50).alias("tendency"))


@query(f"""with recursive {_SAMPLES}, base as (
  select img, y, x, c0 as a, coalesce(lead(c0) over (partition by img, y order by x), c0) as n, c1 - 4 as res from samples),
run as (
  select img, y, x, a as p, a, n, res from base where x = 0
  union all
  select b.img, b.y, b.x, s.second as p, b.a, b.n, b.res from base b join (
    select img, y, x, first - diff as second from (
      select *, a + diff // 2 as first from (
        select *, res + {_TEND} as diff from ({_TEND_STEPS2.format('(' + _TEND_STEPS.format('run') + ')')})))) s
    on b.img = s.img and b.y = s.y and b.x = s.x + 1),
fin as (select *, a + diff // 2 as first from (
  select *, res + {_TEND} as diff from ({_TEND_STEPS2.format('(' + _TEND_STEPS.format('run') + ')')})))
select img, y, 2 * x as x, first as v from fin union all select img, y, 2 * x + 1 as x, first - diff as v from fin""")
def xfm4_squeeze(spark: SparkSession, sf: str) -> DataFrame:
    step = F.array_sort(F.collect_list(F.struct("x", F.col("c0").alias("a"), (F.col("c1") - 4).alias("r"))))
    rows = r.samples(spark, sf).groupBy("img", "y").agg(step.alias("s")).select("img", "y", F.col("s.a").alias("avg"), F.col("s.r").alias("res"))
    out = transforms.unsqueeze(rows, "avg", "res")
    return out.select("img", "y", F.posexplode("samples").alias("x", "v")).select("img", "y", F.col("x").cast("bigint").alias("x"), "v")


_CAUSAL = f"""{_SAMPLES}, h as (
  select img, x, y, c2 as v, lag(c2) over w as w1, lag(c2, 2) over w as w2, lead(c2) over w as e1, lead(c2, 2) over w as e2
  from samples window w as (partition by img, y order by x)),
u as (
  select *, lag(v) over w as n, lag(w1) over w as nw, lag(e1) over w as ne, lag(e2) over w as nee, lag(v, 2) over w as nn
  from h window w as (partition by img, x order by y)),
q as (select *, coalesce(w1, n, 0) as l from u),
c as (select img, x, y, v, l, coalesce(n, l) as t, coalesce(nw, l) as tl, coalesce(w2, l) as ll, ne, nee, nn from q),
k as (select img, x, y, v, l, t, tl, ll, coalesce(ne, t) as tr, coalesce(nee, ne, t) as trr, coalesce(nn, t) as tt from c)"""


@query(f"""with {_CAUSAL} select img, x, y, cast(2 as bigint) as p0, cast(7 as bigint) as p1, y as p2, x as p3, abs(t) as p4, abs(l) as p5, t as p6, l as p7,
  l - coalesce(lag(l + t - tl) over (partition by img, y order by x), 0) as p8, l + t - tl as p9, l - tl as p10,
  tl - t as p11, t - tr as p12, t - tt as p13, l - ll as p14 from k""")
def mod4_properties(spark: SparkSession, sf: str) -> DataFrame:
    return stencils.pixel_properties(r.samples(spark, sf), "c2", 2, 7).select("img", "x", "y", *[f"p{i}" for i in range(15)])


@query(f"""with {_CAUSAL} select img, x, y, cast(0 as bigint) as zero, l as left, t as top, (l + t) // 2 as average0,
  case when abs(t - tl) < abs(l - tl) then l else t end as pick, tr as top_right, tl as top_left, ll as left_left, x * 3 - y as weighted,
  least(greatest(l + t - tl, least(l, t)), greatest(l, t)) as gradient, (l + tl) // 2 as average1, (tl + t) // 2 as average2,
  (t + tr) // 2 as average3, (6 * t - 2 * tt + 7 * l + ll + trr + 3 * tr + 8) // 16 as average4 from k""".replace("l as left,", 'l as "left",'))
def mod5_predictors(spark: SparkSession, sf: str) -> DataFrame:
    d = stencils.causal(r.samples(spark, sf), "c2").withColumn("given", F.col("x") * 3 - F.col("y"))
    return d.select("img", "x", "y", *[stencils.predict(kind, "given").alias(kind) for kind in stencils.PREDICTORS])


@query(f"""with {_RECTS} select r.id, g.region from rects r join regions g
  on r.x0 < g.x1 and g.x0 < r.x1 and r.y0 < g.y1 and g.y0 < r.y1""")
def roi1_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.overlapping(r.rectangles(spark, sf), r.regions(spark, sf))


@query(f"""with {_GROUPS} select frame, grp, x, y, gw, gh from grps where x < 900 and x + gw > 300 and y < 700 and y + gh > 500""")
def roi2_prune(spark: SparkSession, sf: str) -> DataFrame:
    return layout.needed(layout.groups(layout.group_layout(r.frames(spark, sf))), 300, 500, 900, 700)


@query(f"with {_SAMPLES} select img, x - 5 as x, y - 4 as y, c0, c1, c2 from samples where x between 5 and 10 and y between 4 and 24")
def roi4_crop(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.crop(r.samples(spark, sf), 5, 4, 6, 21)


@query(f"""with {_RECTS} select id, x0 >> 2 as x, y0 >> 1 as y, (x1 + 3) // 4 - (x0 >> 2) as w, (y1 + 1) // 2 - (y0 >> 1) as h from rects""")
def roi5_shifted(spark: SparkSession, sf: str) -> DataFrame:
    x, y = F.shiftright("x0", 2), F.shiftright("y0", 1)
    w, h = layout.ceil_div("x1", F.lit(4)) - x, layout.ceil_div("y1", F.lit(2)) - y
    return r.rectangles(spark, sf).select("id", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


@query(f"with {_LAYOUT} select frame, groups_x, groups_y, dc_groups_x, dc_groups_y, sections from layout")
def toc1_layout(spark: SparkSession, sf: str) -> DataFrame:
    return layout.group_layout(r.frames(spark, sf)).select("frame", "groups_x", "groups_y", "dc_groups_x", "dc_groups_y", "sections")


@query(f"""with {_TOC} select frame, idx, size, cast(coalesce(sum(size) over (partition by frame order by idx
  rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset" from toc""")
def toc3_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return layout.offsets(r.sections(spark, sf))


@query(f"""with {_TOC}, t as (select frame, idx, size, count(*) over (partition by frame) as n from toc),
d as (select frame, list(size % (n - idx) order by idx) as digits from t group by frame),
p as (
  select frame, list_reduce(list_prepend([range(len(digits)), []], list_transform(digits, lambda d: [[d], []])),
    lambda acc, d: [list_concat(acc[1][1:d[1][1]], acc[1][d[1][1] + 2:]), list_append(acc[2], acc[1][d[1][1] + 1])])[2] as perm
  from d)
select frame, unnest(range(len(perm))) as idx, cast(unnest(perm) as bigint) as "to" from p""")
def toc4_lehmer(spark: SparkSession, sf: str) -> DataFrame:
    n = F.count("*").over(W.partitionBy("frame"))
    return layout.lehmer(r.sections(spark, sf).withColumn("digit", F.col("size") % (n - F.col("idx"))))


@query("""with t as (select user_id as frame, row_number() over (partition by user_id order by event_id) - 1 as idx,
  row_number() over (partition by user_id order by event_id * 7919 % 10007, event_id) - 1 as "to" from events)
select frame, "to" as idx, idx as origin from t""")
def toc5_invperm(spark: SparkSession, sf: str) -> DataFrame:
    by = W.partitionBy("user_id")
    e = r.table(spark, sf, "events")
    idx = F.row_number().over(by.orderBy("event_id")).cast("bigint") - 1
    to = F.row_number().over(by.orderBy(F.col("event_id") * 7919 % 10007, "event_id")).cast("bigint") - 1
    return layout.inverse_permutation(e.select(F.col("user_id").alias("frame"), idx.alias("idx"), to.alias("to")))


_KINDS = f"""{_LAYOUT}, i as (select frame, groups_x * groups_y as g, dc_groups_x * dc_groups_y as d, sections, unnest(range(sections)) as id from layout),
kinds as (select frame, id, g, d,
  case when sections = 1 then 'combined' when id = 0 then 'dc_global' when id <= d then 'dc_group'
       when id = d + 1 then 'ac_global' else 'ac_group' end as kind,
  case when sections > 1 and id > d + 1 then (id - d - 2) // g end as pass,
  case when sections > 1 and id > d + 1 then (id - d - 2) % g when sections > 1 and id between 1 and d then id - 1 end as grp from i)"""


def _kinds(spark: SparkSession, sf: str, *keep: str) -> DataFrame:
    rows = layout.group_layout(r.frames(spark, sf)).withColumn("id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("sections") - 1)))
    rows = rows.withColumn("g", F.col("groups_x") * F.col("groups_y")).withColumn("d", F.col("dc_groups_x") * F.col("dc_groups_y"))
    return rows.withColumn("k", layout.section_kind("id", "g", "d", "sections")).select("frame", "id", "g", "d", "k.*", *keep)


@query(f"with {_KINDS} select frame, id, kind, pass, grp from kinds")
def toc6_kind(spark: SparkSession, sf: str) -> DataFrame:
    return _kinds(spark, sf).select("frame", "id", "kind", "pass", "grp")


@query(f"""with {_GROUPS} select frame, grp, x, y, gw, gh from grps""")
def toc9_geometry(spark: SparkSession, sf: str) -> DataFrame:
    return layout.groups(layout.group_layout(r.frames(spark, sf)))


@query(f"""with {_KINDS} select frame, id, case when kind = 'dc_group' then 1 + d + grp else 1 + 3 * d + 17 + g * pass + grp end as stream
  from kinds where kind in ('dc_group', 'ac_group')""")
def toc10_stream_id(spark: SparkSession, sf: str) -> DataFrame:
    rows = _kinds(spark, sf).where("kind in ('dc_group', 'ac_group')")
    return rows.select("frame", "id", layout.stream_number("kind", "pass", "grp", "g", "d").alias("stream"))


_SIZES = "sizes as (select img, 16 as w, max(y) + 1 as h from samples group by img)"
_GRID = f"""{_SAMPLES}, {_SIZES}, gy as (select *, unnest(range(h)) as y from sizes), grid as (select img, y, unnest(range(w)) as x from gy)"""


def _sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("img").agg((F.max("y") + 1).alias("h")).withColumn("w", F.lit(16).cast("bigint"))


@query(f"""with {_GRID} select img, x, y, coalesce(s.c2, 0) as c2 from grid left join (select * from samples where (x + y) % 3 <> 0) s using (img, x, y)""")
def asm1_fill(spark: SparkSession, sf: str) -> DataFrame:
    rows = r.samples(spark, sf)
    return assembly.fill(_sizes(rows), rows.where("(x + y) % 3 <> 0").select("img", "x", "y", "c2"), "c2")


@query(f"""with {_GRID} select img, x, y from grid anti join (select * from samples where (x + y) % 5 <> 0) s using (img, x, y)""")
def asm6_holes(spark: SparkSession, sf: str) -> DataFrame:
    rows = r.samples(spark, sf)
    return assembly.holes(_sizes(rows), rows.where("(x + y) % 5 <> 0"))


@query("""select grp, pass, ord, v from (
  select user_id as grp, event_id % 4 as pass, event_id as ord, cast(round(value * 100) as bigint) as v,
         row_number() over (partition by user_id order by event_id % 4 desc, event_id desc) as n from events) where n = 1""")
def asm3_final_pass(spark: SparkSession, sf: str) -> DataFrame:
    return assembly.final_pass(_passes(spark, sf), ["grp"], "pass", "ord")


def _passes(spark: SparkSession, sf: str) -> DataFrame:
    v = F.round(F.col("value") * 100).cast("bigint").alias("v")
    return r.table(spark, sf, "events").select(F.col("user_id").alias("grp"), (F.col("event_id") % 4).alias("pass"), F.col("event_id").alias("ord"), v)


@query("""select user_id as grp, event_id as ord, cast(round(value * 100) as bigint) as v from events where event_id % 4 = 2""")
def asm4_pass(spark: SparkSession, sf: str) -> DataFrame:
    return _passes(spark, sf).where("pass = 2").select("grp", "ord", "v")


@query("""select user_id as grp, event_id % 16 as pos, cast(sum(cast(round(value * 100) as bigint)) as bigint) as v
  from events where event_id % 4 <= 2 group by 1, 2""")
def asm5_merge(spark: SparkSession, sf: str) -> DataFrame:
    return assembly.merge_passes(_passes(spark, sf).withColumn("pos", F.col("ord") % 16), ["grp", "pos"], "v", 2)


@query("""select o_orderkey as id, (o_orderkey % 1000 + 8) * case o_orderkey % 7 + 1 when 1 then 1 when 2 then 12 when 3 then 4 when 4 then 3
    when 5 then 16 when 6 then 5 else 2 end // case o_orderkey % 7 + 1 when 1 then 1 when 2 then 10 when 3 then 3 when 4 then 2
    when 5 then 9 when 6 then 4 else 1 end as width from orders""")
def hdr1_aspect(spark: SparkSession, sf: str) -> DataFrame:
    ratios = F.array(*[F.struct(F.lit(a).alias("n"), F.lit(b).alias("d")) for a, b in ((1, 1), (12, 10), (4, 3), (3, 2), (16, 9), (5, 4), (2, 1))])
    k = F.col("o_orderkey")
    rows = r.table(spark, sf, "orders").select(k.alias("id"), (k % 1000 + 8).alias("h"), F.element_at(ratios, (k % 7 + 1).cast("int")).alias("q"))
    return rows.select("id", s.div(F.col("h") * F.col("q.n"), F.col("q.d")).alias("width"))


@query("""with p as (select o_orderkey as frame, o_orderkey % 5 as last, unnest(range(o_orderkey % 5 + 1)) as pass from orders),
m as (select *, case when pass = last then 0 when (frame + pass) % 3 = 0 then cast(greatest(3 - pass, 1) as bigint) end as mark from p),
b as (select frame, pass, coalesce(last_value(mark ignore nulls) over w, 3) as min_shift from m
  window w as (partition by frame order by pass rows between unbounded preceding and current row))
select frame, pass, min_shift, coalesce(lag(min_shift) over (partition by frame order by pass) - 1, 2) as max_shift from b""")
def hdr11_bracket(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = r.table(spark, sf, "orders").select(k.alias("frame"), (k % 5).alias("last"), F.explode(F.sequence(F.lit(0).cast("bigint"), k % 5)).alias("pass"))
    mark = F.when((F.col("frame") + F.col("pass")) % 3 == 0, F.pow(F.lit(2.0), F.greatest(3 - F.col("pass"), F.lit(1))))
    return layout.pass_brackets(rows.withColumn("downsample", mark)).select("frame", "pass", "min_shift", "max_shift")


@query(f"""with {_CAUSAL}, b as (select img, x, y, v, case when n is null and w1 is null then 32 when n is null then w1 when w1 is null then n
    else (n + w1 + 1) // 2 end as predicted from q),
e as (select *, (case when v > 20 then 1 else 0 end) + (case when v > 90 then 1 else 0 end) + (case when v > 200 then 1 else 0 end) as bucket from b)
select img, x, y, predicted, cast(bucket as bigint) as bucket,
  (case when least(predicted, 64) < 8 then least(predicted, 64) else 4 + (least(predicted, 64) >> 1) end) * 15 + bucket as context from e""")
def vdp10_contexts(spark: SparkSession, sf: str) -> DataFrame:
    d = r.samples(spark, sf)
    w, n = F.lag("c2").over(W.partitionBy("img", "y").orderBy("x")), F.lag("c2").over(W.partitionBy("img", "x").orderBy("y"))
    d = d.withColumn("w", w).withColumn("n", n)
    both = s.div(F.col("n") + F.col("w") + 1, F.lit(2))
    d = d.withColumn("predicted", F.coalesce(both, "w", "n", F.lit(32).cast("bigint"))).withColumn("bucket", layout.above("c2", (20, 90, 200)))
    return d.select("img", "x", "y", "predicted", "bucket", layout.nonzero_context("predicted", "bucket", 15).alias("context"))


@query(f"""with {_GROUPS} select frame, grp, (y // 2048) * ((w + 2047) // 2048) + x // 2048 as dc_group from grps join frames using (frame)""")
def vdp12_group_lookup(spark: SparkSession, sf: str) -> DataFrame:
    rows = layout.groups(layout.group_layout(r.frames(spark, sf)), "w")
    across = layout.ceil_div("w", F.lit(2048))
    return rows.select("frame", "grp", (s.div("y", F.lit(2048)) * across + s.div("x", F.lit(2048))).alias("dc_group"))


@query("""select l_orderkey as frame, bit_or(cast(1 as bigint) << (l_partkey % 27)) as used from lineitem group by 1""")
def vdp5_used_acs(spark: SparkSession, sf: str) -> DataFrame:
    used = F.expr("bit_or(shiftleft(1L, int(l_partkey % 27)))").alias("used")
    return r.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("frame")).agg(used)


@query(f"""with {_SAMPLES}, q as (select img, x, y, c1 - 4 as q from samples)
select img, x, y, cast(floor((case when q = 0 then 0.0 when abs(q) = 1 then q * 0.92994550108251407
  else q - cast(0.145 as double) / q end) * 10000 + 0.5) as bigint) as v from q""")
def vdr1_bias(spark: SparkSession, sf: str) -> DataFrame:
    return r.samples(spark, sf).select("img", "x", "y", fixed(s.quant_bias(F.col("c1") - 4, 1 - 0.07005449891748593, 0.145)).alias("v"))


_AROUND = """h as (
  select *, coalesce(lag({0}) over w, {0}) as w1, coalesce(lead({0}) over w, {0}) as e1
  from samples window w as (partition by img, y order by x)),
u as (
  select *, coalesce(lag({0}) over w, {0}) as n1, coalesce(lead({0}) over w, {0}) as s1,
    coalesce(lag(w1) over w, w1) as nw, coalesce(lag(e1) over w, e1) as ne,
    coalesce(lead(w1) over w, w1) as sw, coalesce(lead(e1) over w, e1) as se from h window w as (partition by img, x order by y))"""


@query(f"""with {_SAMPLES}, {_AROUND.format('c2')}
select img, x, y, cast(floor((cast(1 as double) / (1 + 4 * (1.1::double * 0.104699568::double + 1.1::double * 0.055680538::double)) *
  (c2 + 1.1::double * 0.104699568::double * (n1 + s1 + w1 + e1) + 1.1::double * 0.055680538::double * (nw + ne + sw + se))) * 10000 + 0.5) as bigint) as v from u""")
def vdr10_gaborish(spark: SparkSession, sf: str) -> DataFrame:
    return stencils.gaborish(r.samples(spark, sf), "c2").select("img", "x", "y", fixed("smooth").alias("v"))


@query(f"""with {_SAMPLES}, {_AROUND.format('c2')},
i as (select *, lag(x) over r is not null and lead(x) over r is not null as inrow from u window r as (partition by img, y order by x)),
j as (select *, inrow and lag(x) over c is not null and lead(x) over c is not null as inside from i window c as (partition by img, x order by y)),
m as (select *, (1 - 4 * (0.20345139757231578::double + 0.0334829185968739::double)) * c2 + 0.20345139757231578::double * (n1 + s1 + w1 + e1)
  + 0.0334829185968739::double * (nw + ne + sw + se) as sm from j)
select img, x, y, cast(floor((case when inside then c2 + (sm - c2) * greatest(3 - 4 * greatest(0.5::double, abs((c2 - sm) / 40::double)), 0.0::double) else c2 end) * 10000 + 0.5) as bigint) as v from m""")
def vdr4_dc_smooth(spark: SparkSession, sf: str) -> DataFrame:
    return stencils.smooth_dc(r.samples(spark, sf), ["c2"], [40.0]).select("img", "x", "y", fixed("c2_smooth").alias("v"))


def _edge_sql(step: int) -> str:
    """The three steps over 7 x 7 neighbourhoods; the weights of neighbours are written out one by one."""
    name = lambda x, y: f"{'mnopqrs'[x + 3]}{y + 3}"
    cross = [(0, 0), (0, -1), (-1, 0), (1, 0), (0, 1)] if step < 2 else [(0, 0)]
    near = [(x, y) for x in range(-2, 3) for y in range(-2, 3) if 0 < abs(x) + abs(y) <= (2 if step == 0 else 1)]
    sad = lambda x, y: " + ".join(f"abs({name(i, j)} - {name(x + i, y + j)})" for i, j in cross)
    weights = ", ".join(f"greatest(1 + 0.05::double * ({sad(x, y)}) * scaled, 0) as w{n}" for n, (x, y) in enumerate(near))
    total = " + ".join(["c2", *(f"w{n} * {name(x, y)}" for n, (x, y) in enumerate(near))])
    whole = " + ".join(["1", *(f"w{n}" for n in range(len(near)))])
    own = (1.65 * 0.9, 1.65, 1.65 * 6.5)[step]
    return f"""with {_ROWS7}, {_square7()}, sg as (select *, -0.3::double - (x // 8 + y // 8) % 5 as sigma from sq7),
sc as (select *, sigma * {own!r}::double * case when x % 8 in (0, 7) or y % 8 in (0, 7) then 2 / 3::double else 1 end as scaled from sg),
wt as (select *, {weights} from sc)
select img, x, y, cast(floor((case when sigma < -3.905243::double then c2 else ({total}) / ({whole}) end) * 10000 + 0.5) as bigint) as v from wt"""


def _edge(spark: SparkSession, sf: str, step: int) -> DataFrame:
    sigma = -0.3 - (s.div("x", F.lit(8)) + s.div("y", F.lit(8))) % 5
    rows = r.samples(spark, sf).withColumn("sigma", sigma)
    return stencils.restored(rows, ["c2"], smooth=False, steps=[step], scales=[0.05], inverse_sigma="sigma").select("img", "x", "y", fixed("c2").alias("v"))


def _line7(value: str, out: str, table: str, by: str, along: str) -> str:
    """A CTE body: the seven values along an axis; samples past an end are the mirrored ones."""
    lag, lead = (lambda n: f"lag({value}, {n}) over w"), (lambda n: f"lead({value}, {n}) over w")
    def side(f, g, n):
        if n == 1:
            return f"coalesce({f(1)}, {value})"
        if n == 2:
            return f"case when {f(2)} is not null then {f(2)} when {f(1)} is not null then {f(1)} else coalesce({g(1)}, {value}) end"
        return f"case when {f(3)} is not null then {f(3)} when {f(2)} is not null then {f(2)} when {f(1)} is not null then {value} else coalesce({g(2)}, {g(1)}, {value}) end"
    columns = [side(lag, lead, n) for n in (3, 2, 1)] + [value] + [side(lead, lag, n) for n in (1, 2, 3)]
    named = ", ".join(f"{c} as {out}{i}" for i, c in enumerate(columns))
    return f"select *, {named} from {table} window w as (partition by img, {by} order by {along})"


_ROWS7 = f"{_SAMPLES}, l7 as ({_line7('c2', 'a', 'samples', 'y', 'x')})"


def _square7() -> str:
    steps, table = [], "l7"
    for i in range(7):
        steps.append(f"g{i} as ({_line7(f'a{i}', 'mnopqrs'[i], table, 'x', 'y')})")
        table = f"g{i}"
    return ", ".join(steps) + f", sq7 as (select * from {table})"


@query(_edge_sql(0))
def vdr11_step0(spark: SparkSession, sf: str) -> DataFrame:
    return _edge(spark, sf, 0)


@query(_edge_sql(1))
def vdr11_step1(spark: SparkSession, sf: str) -> DataFrame:
    return _edge(spark, sf, 1)


@query(_edge_sql(2))
def vdr11_epf(spark: SparkSession, sf: str) -> DataFrame:
    return _edge(spark, sf, 2)


@query(f"""with {_SAMPLES}, h as (
  select img, x, y, c0, coalesce(lag(c0) over w, c0) as l, coalesce(lead(c0) over w, c0) as r from samples window w as (partition by img, y order by x))
select img, 2 * x as x, y, cast(0.75 * c0 * 100 + 0.25 * l * 100 as bigint) as v from h
union all select img, 2 * x + 1 as x, y, cast(0.75 * c0 * 100 + 0.25 * r * 100 as bigint) as v from h""")
def vdr9_chroma(spark: SparkSession, sf: str) -> DataFrame:
    return stencils.widen_chroma(r.samples(spark, sf), "c0").select("img", "x", "y", (F.col("v") * 100).cast("bigint").alias("v"))


_LINE5 = """select *, coalesce(lag({0}, 2) over w, case when lag({0}) over w is not null then lag({0}) over w else coalesce(lead({0}) over w, {0}) end) as {1}0,
  coalesce(lag({0}) over w, {0}) as {1}1, {0} as {1}2, coalesce(lead({0}) over w, {0}) as {1}3,
  coalesce(lead({0}, 2) over w, case when lead({0}) over w is not null then lead({0}) over w else coalesce(lag({0}) over w, {0}) end) as {1}4
  from {2} window w as (partition by img, {3} order by {4})"""
_ROWS5 = f"{_SAMPLES}, l5 as ({_LINE5.format('c2', 'a', 'samples', 'y', 'x')})"


def _square5(value: str) -> str:
    """CTEs down to ``sq`` with columns <row letter><column>: the 5 x 5 neighbourhood."""
    steps, table = [], "l5"
    for i in range(5):
        steps.append(f"d{i} as ({_LINE5.format(f'a{i}', 'pqrst'[i], table, 'x', 'y')})")
        table = f"d{i}"
    return ", ".join(steps) + f", sq as (select * from {table})"


@query(f"""with {_ROWS5}, {_square5('c2')} select img, x, y, cast(floor((0.16::double * (
  {' + '.join(f'{c}{j}' for c in 'pqrst' for j in range(5))} - r2) - 3.84::double * r2) * 10000 + 0.5) as bigint) as v from sq""")
def syn3_convolve(spark: SparkSession, sf: str) -> DataFrame:
    return stencils.noise_filter(r.samples(spark, sf), "c2").select("img", "x", "y", fixed("noise").alias("v"))


def _enlarge_sql(factor: int, weights: str, value: str = "c2") -> str:
    """Kernels are looked up in a symmetric square that SQL builds from the upper triangle, row by row."""
    around = ", ".join(f"{c}{j}" for j in range(5) for c in "pqrst")
    half = factor // 2
    place = "case when {0} < %d then 5 * {0} + {1} else 5 * (%d - {0}) + 4 - {1} end" % (half, factor - 1)
    return f"""with {_ROWS5}, {_square5(value)},
tri as (select a.range as i, b.range as j, row_number() over (order by a.range, b.range) as n from range({5 * half}) a, range({5 * half}) b where a.range <= b.range),
sym as (select i, j, ({weights})[n] as w from tri union select j, i, ({weights})[n] from tri),
ker as (
  select ox.range as ox, oy.range as oy, list(w order by py.range, px.range) as k
  from range({factor}) ox, range({factor}) oy, range(5) px, range(5) py
  join sym on i = {place.format('ox.range', 'px.range')} and j = {place.format('oy.range', 'py.range')}
  group by 1, 2),
ar as (select img, x, y, [{around}]::double[] as ar from sq)
select img, {factor} * x + ox as x, {factor} * y + oy as y,
  cast(floor(least(greatest(list_inner_product(ar, k), list_min(ar)), list_max(ar)) * 10000 + 0.5) as bigint) as v from ar, ker"""


_DOUBLING = """[-0.017166138, -0.03451538, -0.040222168, -0.029205322, -0.0062446594, 0.14111328, 0.2890625, 0.0027866364,
  -0.016098022, 0.56640625, 0.03778076, -0.019866943, -0.031433105, -0.01184845, -0.0021362305]::double[]"""
_QUADRUPLING = """[-0.024185181, -0.034912109, -0.03692627, -0.030944824, -0.0052986145, -0.01663208, -0.035583496, -0.038879395,
  -0.03515625, -0.0098953247, 0.23657227, 0.33398438, -0.010734558, -0.013130188, -0.035552979, 0.13049316, 0.40112305,
  0.039520264, -0.020782471, 0.46923828, -0.0020923615, -0.014846802, -0.040649414, 0.18945312, 0.56298828, 0.066772461,
  -0.023361206, -0.035522461, -0.0075492859, -0.022674561, -0.023635864, 0.0031585693, -0.033996582, -0.013595581,
  -0.00091648102, -0.0033550262, -0.011634827, -0.016098022, -0.0097427368, -0.0019159317, -0.010955811, -0.031982422,
  -0.044555664, -0.027999878, -0.0064582825, 0.063903809, 0.22961426, 0.0063095093, -0.018966675, 0.67529297,
  0.084838867, -0.025344849, -0.02204895, -0.016677856, -0.0038452148]::double[]"""
_OCTUPLING = "list_transform(range(210), lambda n: ((n * 37) % 101 - 30) / 1000::double)"


@query(_enlarge_sql(2, _DOUBLING))
def vdr13_upsample(spark: SparkSession, sf: str) -> DataFrame:
    return stencils.enlarge(r.samples(spark, sf), "c2", 2, steps=10000)


def _by_row(rows: DataFrame) -> DataFrame:
    """A row of an image as its count, its sum, and its sum by place: enlarged images have very many samples."""
    return rows.groupBy("img", "y").agg(F.count("*").alias("n"), F.sum("v").alias("v"), F.sum(F.col("v") * F.col("x")).alias("by_x"))


def _rows_sql(samples: str) -> str:
    return f"select img, y, count(*) as n, cast(sum(v) as bigint) as v, cast(sum(v * x) as bigint) as by_x from ({samples}) group by all"


@query(_rows_sql(_enlarge_sql(4, _QUADRUPLING)))
def vdr13_upsample4(spark: SparkSession, sf: str) -> DataFrame:
    return _by_row(stencils.enlarge(r.samples(spark, sf), "c2", 4, steps=10000))


@query(_rows_sql(_enlarge_sql(8, _OCTUPLING)))
def vdr13_upsample8(spark: SparkSession, sf: str) -> DataFrame:
    weights = [((n * 37) % 101 - 30) / 1000 for n in range(210)]
    return _by_row(stencils.enlarge(r.samples(spark, sf), "c2", 8, weights, steps=10000))


@query(_enlarge_sql(2, _DOUBLING).replace("* 10000 + 0.5", "+ 0.5"))
def out8_alpha(spark: SparkSession, sf: str) -> DataFrame:
    return stencils.enlarge_alpha(r.samples(spark, sf), "c2", 255).select("img", "x", "y", "v")


@query(f"""with {_BLOCKS}, c as (
  select u.range as u, i.range as i, (case when u.range = 0 then sqrt(1 / 8::double) else sqrt(2 / 8::double) end) * cos((2 * i.range + 1) * u.range * pi() / 16) as w
  from range(8) u, range(8) i),
a as (select blk, k // 8 as r, i, sum(v * w) as v from blocks join c on k % 8 = u group by 1, 2, 3),
b as (select blk, c.i as y, a.i as x, sum(v * w) as v from a join c on r = u group by 1, 2, 3)
select blk, x, y, cast(floor(v * 10000 + 0.5) as bigint) as v from b""")
def vdr6_idct(spark: SparkSession, sf: str) -> DataFrame:
    return transforms.inverse_dct(r.blocks(spark, sf)).select("blk", "x", "y", fixed("v").alias("v"))


def _haar_sql(value: str = "cast(floor(unnest(embedding) * 1024) as bigint)") -> str:
    """The cascade level by level: samples of the corner become sums and differences, the others stay."""
    steps = []
    for n, table in ((1, "q0"), (2, "q1"), (4, "q2")):
        pair = f"select blk, x % {n} as cx, y % {n} as cy, max(case when x < {n} and y < {n} then v end) as a, max(case when x >= {n} and y < {n} then v end) as b, max(case when x < {n} and y >= {n} then v end) as c, max(case when x >= {n} and y >= {n} then v end) as d from {table} where x < {2 * n} and y < {2 * n} group by 1, 2, 3"
        outs = " union all ".join(f"select blk, 2 * cx + {dx} as x, 2 * cy + {dy} as y, a {'-' if dy else '+'} b {'-' if dx else '+'} c {'-' if dx != dy else '+'} d as v from ({pair})" for dx in (0, 1) for dy in (0, 1))
        steps.append(f"q{len(steps) + 1} as ({outs} union all select blk, x, y, v from {table} where x >= {2 * n} or y >= {2 * n})")
    return f"""with q0 as (select blk, k % 8 as x, k // 8 as y, v from (
  select vec_id as blk, unnest(range(64)) as k, {value} as v from embeddings)), {', '.join(steps)}
select blk, x, y, v from q3"""


@query(_haar_sql())
def vdr7_haar(spark: SparkSession, sf: str) -> DataFrame:
    rows = r.blocks(spark, sf).withColumn("v", F.floor(F.col("v").cast("float") * F.lit(1024)).cast("bigint"))
    return transforms.inverse_haar(rows).select("blk", "x", "y", F.col("v").cast("bigint").alias("v"))


@query(f"""with {_SAMPLES}, g as (select img, x, y, c1 / 4000::double as px, c0 / 60::double as py, c2 / 255::double as pb from samples),
k as (select *, -pow(0.0037930732::double, 1 / 3::double) as root from g),
m as (select img, x, y, pow(py + px - root, 3) - 0.0037930732::double as a, pow(py - px - root, 3) - 0.0037930732::double as b, pow(pb - root, 3) - 0.0037930732::double as c from k)
select img, x, y, cast(floor((11.031567::double * a - 9.866944::double * b - 0.164623::double * c) * 10000 + 0.5) as bigint) as r,
  cast(floor((-3.2541473::double * a + 4.4187703::double * b - 0.164623::double * c) * 10000 + 0.5) as bigint) as g,
  cast(floor((-3.6588514::double * a + 2.712923::double * b + 1.9459282::double * c) * 10000 + 0.5) as bigint) as b from m""")
def vdr14_xyb(spark: SparkSession, sf: str) -> DataFrame:
    rgb = s.xyb_to_linear(F.col("c1") / 4000.0, F.col("c0") / 60.0, F.col("c2") / 255.0)
    return r.samples(spark, sf).select("img", "x", "y", *[fixed(c).alias(n) for c, n in zip(rgb, "rgb")])


_SRGB = "(case when {0} <= 0.0031308 then 12.92::double * {0} else 1.055::double * pow({0}, 1 / 2.4::double) - 0.055::double end)"


@query(f"""with {_SAMPLES}, q as (select img, x, y, least(greatest((c2 - 3) / 249::double, 0::double), 1::double) as v from samples)
select img, x, y, cast(floor({_SRGB.format('v')} * 255 + 0.5) as bigint) as v8, cast(floor({_SRGB.format('v')} * 65535 + 0.5) as bigint) as v16 from q""")
def vdr15_srgb(spark: SparkSession, sf: str) -> DataFrame:
    v = (F.col("c2") - 3) / 249.0
    return r.samples(spark, sf).select("img", "x", "y", s.to_srgb(v, 255).alias("v8"), s.to_srgb(v, 65535).alias("v16"))


@query(f"""with {_SAMPLES}, q as (select img, x, y, (c0 - 25) / 100::double as cb, c2 / 255::double - 0.5 as py, (c1 - 4) / 10::double as cr from samples),
p as (select img, x, y, py + 128 / 255::double + 1.402::double * cr as r,
  py + 128 / 255::double - (0.114::double * 1.772::double / 0.587::double) * cb - (0.299::double * 1.402::double / 0.587::double) * cr as g,
  py + 128 / 255::double + 1.772::double * cb as b from q)
select img, x, y, cast(floor(least(greatest(r, 0), 1) * 255 + 0.5) as bigint) as r, cast(floor(least(greatest(g, 0), 1) * 255 + 0.5) as bigint) as g,
  cast(floor(least(greatest(b, 0), 1) * 255 + 0.5) as bigint) as b from p""")
def vdr16_ycbcr(spark: SparkSession, sf: str) -> DataFrame:
    rgb = s.ycbcr_to_rgb((F.col("c0") - 25) / 100.0, F.col("c2") / 255.0 - 0.5, (F.col("c1") - 4) / 10.0)
    return r.samples(spark, sf).select("img", "x", "y", *[s.encode(c, 255).alias(n) for c, n in zip(rgb, "rgb")])


@query(f"""with {_SAMPLES} select img, x, y, cast(floor(least(greatest((c2 - 20) / 200::double, 0), 1) * 65535 + 0.5) as bigint) as v from samples""")
def vdr17_direct(spark: SparkSession, sf: str) -> DataFrame:
    return r.samples(spark, sf).select("img", "x", "y", s.encode((F.col("c2") - 20) / 200.0, 65535).alias("v"))


@query(f"""with {_SAMPLES} select img, x, y, (c2 * 65535 + 127) // 255 as v16, (c0 * 255 + 31) // 63 as v8 from samples""")
def out6_depth(spark: SparkSession, sf: str) -> DataFrame:
    return r.samples(spark, sf).select("img", "x", "y", s.scale_depth("c2", 8, 65535).alias("v16"), s.scale_depth("c0", 6, 255).alias("v8"))


@query(f"""with {_SAMPLES}, q as (select img, x, y, c2 as v, c0 % 16 as a from samples)
select img, x, y, case when a = 0 then (case when v = 0 then 0 else 255 end)
  else least((v * 15 * 255 + (255 * a) // 2) // (255 * a), 255) end as v from q""")
def out7_unpremul(spark: SparkSession, sf: str) -> DataFrame:
    return r.samples(spark, sf).select("img", "x", "y", s.unpremultiply("c2", 8, F.col("c0") % 16, 4, 255).alias("v"))


@query(f"""with {_SAMPLES}, {_SIZES}, q as (select s.img, x, y, c2, w, h, s.img % 8 + 1 as o from samples s join sizes using (img))
select img, case o when 2 then w - 1 - x when 3 then w - 1 - x when 5 then y when 6 then h - 1 - y when 7 then h - 1 - y when 8 then y else x end as x,
  case o when 3 then h - 1 - y when 4 then h - 1 - y when 5 then x when 6 then x when 7 then w - 1 - x when 8 then w - 1 - x else y end as y, c2 from q""")
def out9_orient(spark: SparkSession, sf: str) -> DataFrame:
    rows = r.samples(spark, sf)
    turned = geometry.orient(rows.join(_sizes(rows), "img").withColumn("o", F.col("img") % 8 + 1), "o", "w", "h")
    return turned.select("img", "x", "y", "c2")


@query(f"""with {_SAMPLES}, q as (select img, x, y, c2 / 255::double as v from samples)
select img, x, y, cast(floor((case when v <= 0.04045 then v / 12.92::double else pow((v + 0.055::double) / 1.055::double, 2.4::double) end) * 10000 + 0.5) as bigint) as v from q""")
def out10_linear(spark: SparkSession, sf: str) -> DataFrame:
    return r.samples(spark, sf).select("img", "x", "y", fixed(s.from_srgb(F.col("c2") / 255.0)).alias("v"))


@query(f"with {_SAMPLES} select img, x, y, (2126 * c0 + 7152 * c1 + 722 * c2 + 5000) // 10000 as grey from samples")
def out12_gray(spark: SparkSession, sf: str) -> DataFrame:
    return r.samples(spark, sf).select("img", "x", "y", s.luma("c0", "c1", "c2").alias("grey"))


@query(f"""with {_SAMPLES} select img, x, y, 'c0' as channel, c0 as v from samples
  union all select img, x, y, 'c1', c1 from samples union all select img, x, y, 'c2', c2 from samples""")
def out13_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    return r.samples(spark, sf).unpivot(["img", "x", "y"], ["c0", "c1", "c2"], "channel", "v")


@query(f"""with recursive {_ANIM}, f as (select *, max(case when frame % 5 = 0 then frame end) over (partition by img) as start from anim),
o as (select *, row_number() over (partition by img order by frame) as n, frame = start as whole, count(*) over (partition by img) as total
  from f where start is null or frame >= start),
run as (
  select img, n, total, case when whole then colour else (colour * alpha + 127) // 255 end as c, case when whole then alpha else least(alpha, 255) end as a from o where n = 1
  union all
  select o.img, o.n, o.total, case when o.whole then o.colour else (o.colour * o.alpha + run.c * (255 - o.alpha) + 127) // 255 end,
    case when o.whole then o.alpha else least(o.alpha + (run.a * (255 - o.alpha) + 127) // 255, 255) end
  from run join o on o.img = run.img and o.n = run.n + 1)
select img, c as colour, a as alpha, total as frames from run where n = total""")
def out15_blend(spark: SparkSession, sf: str) -> DataFrame:
    return assembly.composite(r.animation(spark, sf), every=5)


@query(f"""with recursive {_ANIM}, o as (select *, row_number() over (partition by img order by frame) as n, frame % 5 = 0 as whole from anim),
run as (
  select img, n, frame, case when whole then colour else (colour * alpha + 127) // 255 end as c, alpha as a from o where n = 1
  union all
  select o.img, o.n, o.frame, case when o.whole then o.colour else (o.colour * o.alpha + run.c * (255 - o.alpha) + 127) // 255 end,
    case when o.whole then o.alpha else least(o.alpha + (run.a * (255 - o.alpha) + 127) // 255, 255) end
  from run join o on o.img = run.img and o.n = run.n + 1)
select img, frame, c as colour, a as alpha from run""")
def out15_frames(spark: SparkSession, sf: str) -> DataFrame:
    return assembly.snapshots(r.animation(spark, sf), every=5)


def _kind_sql(b: str, fine: bool) -> str:
    head = f"case when {b} between 65 and 90 or {b} between 97 and 122 then 0 when {b} between 48 and 57 or {b} in (44, 46) then 1"
    if fine:
        return f"{head} when {b} = 0 then 2 when {b} = 1 then 3 when {b} < 16 then 4 when {b} = 255 then 6 when {b} > 240 then 5 else 7 end"
    return f"{head} when {b} < 16 then 2 when {b} > 240 then 3 else 4 end"


@query(f"""with {_NAMES}, w as (select id, pos, lag(byte) over o as p1, lag(byte, 2) over o as p2 from bytes window o as (partition by id order by pos))
select id, pos, cast(case when p2 is null then 0 else 1 + {_kind_sql('p1', True)} + {_kind_sql('p2', False)} * 8 end as bigint) as context from w""")
def ent11_icc_context(spark: SparkSession, sf: str) -> DataFrame:
    o = W.partitionBy("id").orderBy("pos")
    rows = r.name_bytes(spark, sf).withColumn("p1", F.lag("byte").over(o)).withColumn("p2", F.lag("byte", 2).over(o))
    context = F.when(F.col("p2").isNull(), 0).otherwise(1 + layout.byte_kind("p1", True) + layout.byte_kind("p2", False) * 8)
    return rows.select("id", "pos", context.cast("bigint").alias("context"))


@query(f"""with {_NAMES}, w as (select id, pos, byte, lag(byte) over o as p1, lag(byte, 2) over o as p2, lag(byte, 3) over o as p3 from bytes window o as (partition by id order by pos))
select id, pos, cast((byte + p1) % 256 as bigint) as zero, cast(((byte + 2 * p1 - p2) % 256 + 256) % 256 as bigint) as one,
  cast(((byte + 3 * p1 - 3 * p2 + p3) % 256 + 256) % 256 as bigint) as two from w""")
def ent12_icc_predict(spark: SparkSession, sf: str) -> DataFrame:
    o = W.partitionBy("id").orderBy("pos")
    rows = r.name_bytes(spark, sf)
    for i in (1, 2, 3):
        rows = rows.withColumn(f"p{i}", F.lag("byte", i).over(o))
    b, p1, p2, p3 = (F.col(c) for c in ("byte", "p1", "p2", "p3"))
    guesses = {"zero": p1, "one": 2 * p1 - p2, "two": 3 * p1 - 3 * p2 + p3}
    return rows.select("id", "pos", *[F.pmod(b + g, F.lit(256)).cast("bigint").alias(n) for n, g in guesses.items()])


@query("select o_orderkey as n, case when o_orderkey % 2 = 0 then o_orderkey // 2 else -(o_orderkey // 2) - 1 end as v from orders")
def bit9_zigzag(spark: SparkSession, sf: str) -> DataFrame:
    return r.table(spark, sf, "orders").select(F.col("o_orderkey").alias("n"), s.zigzag("o_orderkey").alias("v"))


@query("""with s as (select l_suppkey as img, l_partkey % 64 as y, l_orderkey * 31 % 256 as centre, l_linenumber as reach, cast(l_quantity as bigint) as amount from lineitem),
t as (select *, unnest(range(greatest(centre - reach, 0), least(centre + reach, 255) + 1)) as x from s)
select img, y, x, cast(sum(amount * (reach + 1 - abs(x - centre))) as bigint) as v from t group by 1, 2, 3""")
def syn9_accumulate(spark: SparkSession, sf: str) -> DataFrame:
    rows = r.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("img"), (F.col("l_partkey") % 64).alias("y"), (F.col("l_orderkey") * 31 % 256).alias("centre"),
        F.col("l_linenumber").cast("bigint").alias("reach"), F.col("l_quantity").cast("bigint").alias("amount"),
    )
    return assembly.accumulate(rows, 256)


@query(f"""with {_SAMPLES} select img, min(c2) as low, max(c2) as high, cast(sum(c2) as bigint) as total, count(*) as n, count(*) filter (where c2 = 0) as zeros from samples group by img""")
def vdr19_ranges(spark: SparkSession, sf: str) -> DataFrame:
    zeros = F.count_if(F.col("c2") == 0).alias("zeros")
    return r.samples(spark, sf).groupBy("img").agg(F.min("c2").alias("low"), F.max("c2").alias("high"), F.sum("c2").alias("total"), F.count("*").alias("n"), zeros)


@query("""select o_orderkey as id, x0, y0, x0 >= 0 and y0 >= 0 and x0 + 300 <= 2000 and y0 + 200 <= 1500 as contained,
  x0 > 0 or y0 > 0 or x0 + 300 < 2000 or y0 + 200 < 1500 as partial
  from (select *, o_orderkey * 97 % 2400 - 200 as x0, o_orderkey * 61 % 1900 - 200 as y0 from orders)""")
def hdr10_rectangle(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = r.table(spark, sf, "orders").select(k.alias("id"), (k * 97 % 2400 - 200).alias("x0"), (k * 61 % 1900 - 200).alias("y0"))
    contained, partial = layout.inside_canvas("x0", "y0", F.lit(300), F.lit(200), F.lit(2000), F.lit(1500))
    return rows.select("id", "x0", "y0", contained.alias("contained"), partial.alias("partial"))


@query("""with m as (select o_orderkey as id, o_orderkey % 4 as a, o_orderkey // 4 % 4 as b, o_orderkey // 16 % 4 as c from orders),
h as (select *, [0, 1, 1, 0][a + 1] as ha, [0, 1, 1, 0][b + 1] as hb, [0, 1, 1, 0][c + 1] as hc,
  [0, 1, 0, 1][a + 1] as va, [0, 1, 0, 1][b + 1] as vb, [0, 1, 0, 1][c + 1] as vc from m)
select id, cast(greatest(ha, hb, hc) - ha as bigint) as h0, cast(greatest(ha, hb, hc) - hb as bigint) as h1, cast(greatest(ha, hb, hc) - hc as bigint) as h2,
  cast(greatest(va, vb, vc) - va as bigint) as v0, cast(greatest(va, vb, vc) - vb as bigint) as v1, cast(greatest(va, vb, vc) - vc as bigint) as v2 from h""")
def hdr13_shifts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    modes = {"a": k % 4, "b": s.div(k, F.lit(4)) % 4, "c": s.div(k, F.lit(16)) % 4}
    rows = r.table(spark, sf, "orders").select(k.alias("id"), *[c.alias(n) for n, c in modes.items()])
    found = [c.alias(f"{axis}{i}") for axis in "hv" for i, c in enumerate(layout.chroma_shifts(list(modes), axis))]
    return rows.select("id", *found)


@query("""select event_id as id, case event_id % 5 when 0 then 'replace' when 1 then 'add' when 2 then 'blend' when 3 then 'weighted add' else 'multiply' end as mode from events""")
def hdr16_labels(spark: SparkSession, sf: str) -> DataFrame:
    names = spark.createDataFrame(list(enumerate(("replace", "add", "blend", "weighted add", "multiply"))), "code long, mode string")
    rows = r.table(spark, sf, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 5).alias("code"))
    return rows.join(F.broadcast(names), "code").select("id", "mode")


@query("""with t as (select user_id as img, event_id as frame, cast(round(value * 100) as bigint) % 400 as ticks from events)
select img, frame, ticks, cast(coalesce(sum(ticks) over (partition by img order by frame rows between unbounded preceding and 1 preceding), 0) as bigint) * 1001 * 1000 // 30000 as starts_ms from t""")
def out14_timeline(spark: SparkSession, sf: str) -> DataFrame:
    ticks = F.round(F.col("value") * 100).cast("bigint") % 400
    rows = r.table(spark, sf, "events").select(F.col("user_id").alias("img"), F.col("event_id").alias("frame"), ticks.alias("ticks"))
    before = F.sum("ticks").over(W.partitionBy("img").orderBy("frame").rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("starts_ms", s.div(F.coalesce(before, F.lit(0)) * 1001 * 1000, F.lit(30000)))


@query("""with d as (select o_custkey as spline, o_orderkey as point, o_orderkey % 11 - 5 as dd from orders),
a as (select *, cast(sum(dd) over (partition by spline order by point rows unbounded preceding) as bigint) as delta from d)
select spline, point, delta, cast(sum(delta) over (partition by spline order by point rows unbounded preceding) as bigint) as position from a""")
def syn6_positions(spark: SparkSession, sf: str) -> DataFrame:
    rows = r.table(spark, sf, "orders").select(F.col("o_custkey").alias("spline"), F.col("o_orderkey").alias("point"), (F.col("o_orderkey") % 11 - 5).alias("dd"))
    upto = W.partitionBy("spline").orderBy("point").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("delta", F.sum("dd").over(upto)).withColumn("position", F.sum("delta").over(upto)).drop("dd")


@query(f"""with {_SAMPLES}, q as (select img, x, y, greatest((c2 / 200::double - 0.1::double) * 6, 0) as v from samples),
w as (select *, case when v >= 7 then 6 else cast(floor(v) as int) end as i, case when v >= 7 then 1.0 else v - floor(v) end as f,
  [0.1, 0.3, 0.2, 0.5, 0.9, 0.4, 0.6, 1.2]::double[] as t from q)
select img, x, y, cast(floor(least(greatest(t[i + 1] + (t[i + 2] - t[i + 1]) * f, 0), 1) * 10000 + 0.5) as bigint) as v from w""")
def syn4_strength(spark: SparkSession, sf: str) -> DataFrame:
    v = coding.strength(F.col("c2") / 200.0 - 0.1, (0.1, 0.3, 0.2, 0.5, 0.9, 0.4, 0.6, 1.2))
    return r.samples(spark, sf).select("img", "x", "y", fixed(v).alias("v"))


@query(f"""with {_SAMPLES}, tiles as (select img, x // 8 as tx, y // 8 as ty, min(c1) as factor from samples group by 1, 2, 3)
select s.img, s.x, s.y, cast(floor((c0 + c2 * (0.5::double + factor / 84::double)) * 10000 + 0.5) as bigint) as v
  from samples s join tiles t on s.img = t.img and s.x // 8 = t.tx and s.y // 8 = t.ty""")
def vdr2_correlation(spark: SparkSession, sf: str) -> DataFrame:
    rows = r.samples(spark, sf).withColumn("tx", s.div("x", F.lit(8))).withColumn("ty", s.div("y", F.lit(8)))
    tiles = rows.groupBy("img", "tx", "ty").agg(F.min("c1").alias("factor"))
    joined = rows.join(tiles, ["img", "tx", "ty"])
    return joined.select("img", "x", "y", fixed(F.col("c0") + F.col("c2") * (0.5 + F.col("factor") / 84.0)).alias("v"))


@query(f"""with {_SAMPLES} select img, x, y, cast(floor(1 / least(0.46::double / (0.25::double * (c0 + 1) * -1.1715729::double) * (c1 / 7::double), -0.0001::double) * 10000 + 0.5) as bigint) as v from samples""")
def vdr12_sigma(spark: SparkSession, sf: str) -> DataFrame:
    sigma = F.least(F.lit(0.46) / (0.25 * (F.col("c0") + 1) * -1.1715729) * (F.col("c1") / 7.0), F.lit(-0.0001))
    return r.samples(spark, sf).select("img", "x", "y", fixed(1 / sigma).alias("v"))


@query(f"""with {_TOC}, c as (select frame, list(size % 8 order by idx) as codes from toc group by frame),
p as (select frame, list_reduce(list_prepend([range(8), []], list_transform(codes, lambda d: [[d], []])),
    lambda acc, d: [list_concat([acc[1][d[1][1] + 1]], acc[1][1:d[1][1]], acc[1][d[1][1] + 2:]), list_append(acc[2], acc[1][d[1][1] + 1])])[2] as vals from c)
select frame, unnest(range(len(vals))) as idx, cast(unnest(vals) as bigint) as v from p""")
def ent3_move_to_front(spark: SparkSession, sf: str) -> DataFrame:
    rows = r.sections(spark, sf).groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("idx", (F.col("size") % 8).alias("c")))).alias("s"))
    out = rows.select("frame", F.col("s.c").alias("codes")).select("frame", F.posexplode(coding.move_to_front("codes", 8)).alias("idx", "v"))
    return out.select("frame", F.col("idx").cast("bigint").alias("idx"), "v")


@query("""with t as (select o_orderkey as id, o_orderkey % 120 as t from orders)
select id, case when t < 16 then 0 else 4 - 3 + ((t - 16) >> 3) end as bits, case when t < 16 then t >> 1 else ((t >> 1) & 3) + 4 end as high, t & 1 as low from t""")
def ent7_token(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    return r.table(spark, sf, "orders").select(k.alias("id"), coding.token_parts(k % 120).alias("p")).select("id", "p.*")


@query("""with l as (select p_size as grp, p_partkey as symbol, cast(p_partkey % 10 + 6 as bigint) as len from part),
c as (select *, coalesce(sum(cast(1 as bigint) << (15 - len)) over (partition by grp order by len, symbol rows between unbounded preceding and 1 preceding), 0) as start from l)
select cast(grp as bigint) as grp, symbol, len, cast(start as bigint) >> (15 - len) as code from c""")
def ent9_canonical(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = r.table(spark, sf, "part").select(F.col("p_size").cast("bigint").alias("grp"), k.alias("symbol"), (k % 10 + 6).alias("len"))
    return coding.canonical_codes(rows, "grp", "symbol", "len")
