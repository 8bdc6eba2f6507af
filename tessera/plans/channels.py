"""The channels that a list of transforms leaves: a fold over an array of channels that are resized, taken out and put in.

Transforms (plan, step, kind, begin, num, colours, deltas, squeezes) are applied in order of ``step``; kinds are rct, palette and
squeeze. ``squeezes`` is an array of struct<across, in_place, begin, num>, empty for the default ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.transforms import named

CHANNEL = "struct<w: bigint, h: bigint, hs: bigint, vs: bigint, component: bigint>"
SQUEEZE = "struct<across: boolean, in_place: boolean, begin: bigint, num: bigint>"
STATE = f"struct<channels: array<{CHANNEL}>, meta: bigint, error: string>"
#: Fixed value: a squeeze stops where a side is no longer than this.
SMALL = 8


def _state(channels: Column, meta: Column, error: Column) -> Column:
    return F.struct(channels.alias("channels"), meta.cast("bigint").alias("meta"), error.alias("error")).cast(STATE)


def _channel(w, h, hs, vs, component) -> Column:
    return F.struct(w.alias("w"), h.alias("h"), hs.alias("hs"), vs.alias("vs"), component.alias("component")).cast(CHANNEL)


def _cut(channels: Column, since, upto) -> Column:
    """Channels from ``since`` up to before ``upto``, counted from 0."""
    return F.slice(channels, (since + 1).cast("int"), F.greatest((upto - since).cast("int"), F.lit(0)))


def _rest(channels: Column, since) -> Column:
    return _cut(channels, since, F.size(channels))


def _range_error(s: Column, begin, num) -> Column:
    end, n, meta = begin + num - 1, F.size(s["channels"]), s["meta"]
    first = F.get(s["channels"], begin.cast("int"))
    unlike = lambda c: (c["w"] != first["w"]) | (c["h"] != first["h"]) | (c["hs"] != first["hs"]) | (c["vs"] != first["vs"])
    return (
        F.when((num < 1) | (begin < 0) | (end >= n), "channel range")
        .when((begin < meta) & (end >= meta), "meta and image channels")
        .when(F.exists(_cut(s["channels"], begin, begin + num), unlike), "channels differ")
    )


def _unless(error: Column, s: Column, channels: Column, meta: Column) -> Column:
    """The state with new channels, or the old ones and an error, which is worked out once."""
    return named(error, lambda e: _state(F.when(e.isNull(), channels).otherwise(s["channels"]), F.when(e.isNull(), meta).otherwise(s["meta"]), e))


def _rct(s: Column, t: Column) -> Column:
    return _state(s["channels"], s["meta"], _range_error(s, t["begin"], F.lit(3)))


def _palette(s: Column, t: Column) -> Column:
    begin, num, none = t["begin"], t["num"], F.lit(-1).cast("bigint")
    table = _channel(t["colours"] + t["deltas"], num, none, none, F.lit(None).cast("bigint"))
    channels = F.concat(F.array(table), _cut(s["channels"], F.lit(0), begin + 1), _rest(s["channels"], begin + num))
    meta = F.when(begin >= s["meta"], s["meta"] + 1).otherwise(s["meta"] + 2 - num)
    return _unless(_range_error(s, begin, num), s, channels, meta)


def _squeeze(s: Column, q: Column) -> Column:
    """One squeeze: the channels of its range are halved, and what they lose is put behind them or at the end."""
    begin, end = q["begin"], q["begin"] + q["num"]
    held = _cut(s["channels"], begin, end)
    half = lambda n: F.ceil(n / 2).cast("bigint")

    def part(c, residual):
        w, h, wide = c["w"], c["h"], q["across"]
        size = (lambda n: n - half(n)) if residual else half
        return _channel(F.when(wide, size(w)).otherwise(w), F.when(wide, h).otherwise(size(h)), F.when(wide, c["hs"] + 1).otherwise(c["hs"]), F.when(wide, c["vs"]).otherwise(c["vs"] + 1), c["component"])

    error = (
        F.when((q["num"] < 1) | (begin < 0) | (end > F.size(s["channels"])), "channel range")
        .when((begin < s["meta"]) & (end > s["meta"]), "meta and image channels")
        .when((begin < s["meta"]) & ~q["in_place"], "meta residuals")
        .when(F.exists(held, lambda c: (c["w"] == 0) | (c["h"] == 0)), "empty channel")
        .when(F.exists(held, lambda c: (c["hs"] > 30) | (c["vs"] > 30)), "too many squeezes")
    )
    before, low, lost, rest = _cut(s["channels"], F.lit(0), begin), F.transform(held, lambda c: part(c, False)), F.transform(held, lambda c: part(c, True)), _rest(s["channels"], end)
    channels = F.when(q["in_place"], F.concat(before, low, lost, rest)).otherwise(F.concat(before, low, rest, lost))
    meta = F.when(begin < s["meta"], s["meta"] + q["num"]).otherwise(s["meta"])
    return _unless(error, s, channels, meta)


def _halvings(n: Column) -> Column:
    """How often a side is halved, rounded up, until it is small: the bits of (n - 1) / 8."""
    return F.when(n > SMALL, F.least(F.length(F.bin(F.call_function("div", n - 1, F.lit(SMALL).cast("bigint")))), F.lit(32))).otherwise(0)


def default_squeezes(channels: Column, meta: Column) -> Column:
    """The squeezes of a transform that names none: colour differences first, then all channels until they are small.

    The longer side is halved first, a square's height.
    """
    n = F.size(channels) - meta
    first, second = F.get(channels, meta.cast("int")), F.get(channels, (meta + 1).cast("int"))
    one = lambda across, in_place, begin, num: F.struct(across.alias("across"), in_place.alias("in_place"), begin.alias("begin"), num.alias("num")).cast(SQUEEZE)
    none = F.array().cast(f"array<{SQUEEZE}>")
    pair = F.array(*[one(F.lit(a), F.lit(False), meta + 1, F.lit(2)) for a in (True, False)])
    pair = F.when((n > 2) & (second["w"] == first["w"]) & (second["h"] == first["h"]), pair).otherwise(none)
    whole = lambda across: one(F.lit(across), F.lit(True), meta, n)
    sides = F.struct(_halvings(first["w"]).alias("wide"), _halvings(first["h"]).alias("tall"), (first["w"] <= first["h"]).alias("upright"))

    def rounds(v):
        ahead = v["upright"] & (v["tall"] > 0)  # the height goes once before the turns begin
        wide, tall = v["wide"], v["tall"] - ahead.cast("int")
        turn = lambda k: F.concat(F.when(k < wide, F.array(whole(True))).otherwise(none), F.when(k < tall, F.array(whole(False))).otherwise(none))
        turns = F.greatest(wide, tall)
        turned = F.when(turns > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(turns, F.lit(1)) - 1), turn))).otherwise(none)
        return F.concat(F.when(ahead, F.array(whole(False))).otherwise(none), turned)

    return F.when(n < 1, none).otherwise(F.concat(pair, named(sides, rounds)))


def _squeezes(s: Column, t: Column) -> Column:
    wanted = F.when(F.size(t["squeezes"]) > 0, t["squeezes"]).otherwise(default_squeezes(s["channels"], s["meta"]))
    return F.aggregate(wanted, _state(s["channels"], s["meta"], F.lit(None)), lambda a, q: F.when(a["error"].isNotNull(), a).otherwise(named(a, lambda v: _squeeze(v, q))))


def planned(images: DataFrame, transforms: DataFrame) -> DataFrame:
    """plan, meta, error, channels: of images (plan, channels), channels an array of ``CHANNEL``, after their transforms.

    ``meta`` counts the channels at the front that hold tables, not samples. The first transform that does not fit its
    channels is an ``error``; it and later ones leave the channels as they were. A plan is one row.
    """
    step = F.struct("step", "kind", *[F.col(c).cast("bigint").alias(c) for c in ("begin", "num", "colours", "deltas")], "squeezes")
    lists = transforms.groupBy("plan").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    rows = images.join(lists, "plan", "left")

    def one(s, t):
        known = F.when(t["kind"] == "rct", _rct(s, t)).when(t["kind"] == "palette", _palette(s, t)).when(t["kind"] == "squeeze", _squeezes(s, t))
        return F.when(s["error"].isNotNull(), s).otherwise(F.coalesce(known, _state(s["channels"], s["meta"], F.lit("kind"))))

    start = _state(F.col("channels"), F.lit(0), F.lit(None).cast("string"))
    # without transforms the list is null, and so would be the fold
    return rows.select("plan", F.coalesce(F.aggregate("steps", start, one), start).alias("s")).select("plan", "s.meta", "s.error", "s.channels")
