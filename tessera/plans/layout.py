"""Planning: group layouts, section tables, stream numbers, what a region needs. All plain columns, before any sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.samples import col, div


def ceil_div(a, b) -> Column:
    return div(col(a) + col(b) - 1, b)


def group_layout(frames: DataFrame, shift: int = 1, upsampling: int = 1, passes: str | None = None) -> DataFrame:
    """Adds group_dim, groups_x, groups_y, dc_groups_x, dc_groups_y and sections. ``passes`` names their column; else 1."""
    dim = 128 << shift
    out = frames.withColumn("group_dim", F.lit(dim).cast("bigint"))
    for axis, size in (("x", "w"), ("y", "h")):
        coded = ceil_div(size, F.lit(upsampling))
        out = out.withColumn(f"groups_{axis}", ceil_div(coded, F.lit(dim))).withColumn(f"dc_groups_{axis}", ceil_div(ceil_div(coded, F.lit(8)), F.lit(dim)))
    groups, dc = F.col("groups_x") * F.col("groups_y"), F.col("dc_groups_x") * F.col("dc_groups_y")
    n = F.col(passes) if passes else F.lit(1)
    return out.withColumn("sections", F.when((groups == 1) & (n == 1), F.lit(1).cast("bigint")).otherwise(2 + dc + groups * n))


def groups(frames: DataFrame, *keep: str) -> DataFrame:
    """frame, grp, x, y, gw, gh: the groups of every frame of a layout, clipped to the frame. ``keep`` names columns of the frame to go along."""
    dim = F.col("group_dim")
    rows = frames.withColumn("gy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("groups_y") - 1)))
    rows = rows.withColumn("gx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("groups_x") - 1)))
    return rows.select(
        "frame", (F.col("gy") * F.col("groups_x") + F.col("gx")).alias("grp"), (F.col("gx") * dim).alias("x"), (F.col("gy") * dim).alias("y"),
        F.least(dim, F.col("w") - F.col("gx") * dim).alias("gw"), F.least(dim, F.col("h") - F.col("gy") * dim).alias("gh"), *keep,
    )


def needed(group_rows: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """The groups that a region touches: all that has to be read for it."""
    return group_rows.where((F.col("x") < x1) & (F.col("x") + F.col("gw") > x0) & (F.col("y") < y1) & (F.col("y") + F.col("gh") > y0))


def needed_for_channels(rows: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """(frame, grp): the groups with a payload of which any channel touches a region of the image.

    ``rows`` are (frame, grp, payload, hshift, vshift, x, y, gw, gh): what a group holds of a channel, on the channel's own
    grid. A channel of negative shifts belongs to the whole image (a palette, say), so its groups always stay.
    """
    grown = lambda c, by: F.expr(f"shiftleft(bigint({c}), int(greatest({by}, 0)))")
    x, y, w, h = grown("x", "hshift"), grown("y", "vshift"), grown("gw", "hshift"), grown("gh", "vshift")
    touches = (x < x1) & (x + w > x0) & (y < y1) & (y + h > y0)
    meta = (F.col("hshift") < 0) | (F.col("vshift") < 0)
    return rows.where((F.col("payload") != 0) & (meta | touches)).select("frame", "grp").distinct()


def offsets(sections: DataFrame) -> DataFrame:
    """Adds ``offset``: the sizes of the sections before, in file order."""
    before = W.partitionBy("frame").orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    return sections.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0).cast("bigint")))


def section_kind(number, groups_n, dc_groups_n, sections_n) -> Column:
    """struct(kind, pass, grp) of a section by its logical number."""
    i, g, d = col(number), col(groups_n), col(dc_groups_n)
    ac = i - d - 2
    none = F.lit(None).cast("bigint")
    make = lambda kind, p, n: F.struct(F.lit(kind).alias("kind"), p.alias("pass"), n.alias("grp"))
    return (
        F.when(col(sections_n) == 1, make("combined", none, none))
        .when(i == 0, make("dc_global", none, none))
        .when(i <= d, make("dc_group", none, i - 1))
        .when(i == d + 1, make("ac_global", none, none))
        .otherwise(make("ac_group", div(ac, g), ac % g))
    )


#: Streams of quantisation tables come between those of DC and AC groups. A fixed value.
QUANT_TABLES = 17


def stream_number(kind, pass_no, grp, groups_n, dc_groups_n) -> Column:
    dc = 1 + col(dc_groups_n) + col(grp)
    ac = 1 + 3 * col(dc_groups_n) + QUANT_TABLES + col(groups_n) * col(pass_no) + col(grp)
    return F.when(col(kind) == "dc_group", dc).when(col(kind) == "ac_group", ac)


def lehmer(rows: DataFrame) -> DataFrame:
    """frame, idx, to: the permutation of Lehmer codes (frame, idx, digit): each digit picks among the numbers not yet taken.

    Merged level by level: a run's picks are ranks among what it may take itself. Two neighbouring runs become one when
    each rank of the right one is counted past the left one's picks below it. If those are l0 < l1 < ..., a rank r has as
    many of them below its number as there are n with l_n - n <= r. That is a running count over both runs in order, so a
    level is two windows, and levels grow with the logarithm of the longest code. A frame's rows stay in one partition.
    """
    n = rows.agg(F.max("idx")).first()[0] or 0
    out = rows.select("frame", "idx", F.col("digit").cast("bigint").alias("to")).repartition("frame")
    for level in range(int(n).bit_length()):
        run, right = F.shiftright("idx", level + 1), F.shiftright("idx", level).bitwiseAND(1)
        both = W.partitionBy("frame", run)
        nth = F.row_number().over(W.partitionBy("frame", run, right).orderBy("to")) - 1
        keyed = out.withColumn("_r", right).withColumn("_k", F.when(right == 0, F.col("to") - nth).otherwise(F.col("to")))
        below = F.sum(1 - F.col("_r")).over(both.orderBy("_k", "_r").rowsBetween(W.unboundedPreceding, W.currentRow))
        out = keyed.select("frame", "idx", F.when(F.col("_r") == 1, F.col("to") + below).otherwise(F.col("to")).cast("bigint").alias("to"))
    return out


def inverse_permutation(rows: DataFrame) -> DataFrame:
    """(frame, idx, to) -> (frame, idx, origin): where each place's content comes from. A projection."""
    return rows.select("frame", F.col("to").alias("idx"), F.col("idx").alias("origin"))


def pass_brackets(marks: DataFrame) -> DataFrame:
    """(frame, pass, last, downsample or null) -> min_shift and max_shift of channels that each pass carries.

    A pass that completes a downsampling sets the least shift (its logarithm), the last pass 0; others keep that of the
    pass before (3 before any). The most is one under the least of the pass before, 2 in the first.
    """
    upto = W.partitionBy("frame").orderBy("pass")
    mark = F.when(F.col("pass") == F.col("last"), 0).otherwise(F.round(F.log2("downsample")).cast("int")).cast("bigint")
    rows = marks.withColumn("_m", mark).withColumn("min_shift", F.coalesce(F.last("_m", True).over(upto), F.lit(3).cast("bigint")))
    return rows.withColumn("max_shift", F.coalesce(F.lag("min_shift").over(upto) - 1, F.lit(2).cast("bigint"))).drop("_m")


# How far the three chroma modes shift each axis.
MODE_SHIFTS = {"h": (0, 1, 1, 0), "v": (0, 1, 0, 1)}


def chroma_shifts(modes: Sequence[str], axis: str) -> list[Column]:
    """Shift of each channel along an axis: the largest of the modes' less its own."""
    table = F.array(*[F.lit(v) for v in MODE_SHIFTS[axis]])
    own = [F.element_at(table, (col(m) + 1).cast("int")) for m in modes]
    return [(F.greatest(*own) - o).cast("bigint") for o in own]


def inside_canvas(x0, y0, w, h, width, height) -> list[Column]:
    """(contained, partial): whether a frame lies in the canvas, and whether it leaves some of it out."""
    x0, y0, x1, y1 = col(x0), col(y0), col(x0) + col(w), col(y0) + col(h)
    contained = (x0 >= 0) & (y0 >= 0) & (x1 <= col(width)) & (y1 <= col(height))
    return [contained, (x0 > 0) | (y0 > 0) | (x1 < col(width)) | (y1 < col(height))]


def above(value, thresholds: Sequence[int]) -> Column:
    """How many thresholds a value exceeds."""
    return sum(((col(value) > t).cast("bigint") for t in thresholds), F.lit(0).cast("bigint"))


def nonzero_context(predicted, block_context, contexts: int) -> Column:
    n = F.least(col(predicted), F.lit(64).cast("bigint"))
    return F.when(n < 8, n).otherwise(4 + F.shiftright(n, 1)) * contexts + col(block_context)


def byte_kind(byte, fine: bool) -> Column:
    """Kind of a profile byte: letters 0, digits . , 1, and ranges of control and high values."""
    b = col(byte)
    letters = b.between(65, 90) | b.between(97, 122)
    digits = b.between(48, 57) | b.isin(44, 46)
    k = F.when(letters, 0).when(digits, 1)
    if fine:
        return k.when(b == 0, 2).when(b == 1, 3).when(b < 16, 4).when(b == 255, 6).when(b > 240, 5).otherwise(7)
    return k.when(b < 16, 2).when(b > 240, 3).otherwise(4)


def size_header(small, height, ratio, width) -> list[Column]:
    """(width, height) of a size header: small heights count in eights, and a ratio of 1 to 7 stands for the width.

    A ratio of 0 has an explicit width, in eights as well where the header is small.
    """
    ratios = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(d).alias("d")) for n, d in ((1, 1), (12, 10), (4, 3), (3, 2), (16, 9), (5, 4), (2, 1))])  # fixed values
    whole = lambda v: F.when(col(small), (col(v) + 1) * 8).otherwise(col(v) + 1)
    h = whole(height)
    q = F.element_at(ratios, F.greatest(col(ratio), F.lit(1)).cast("int"))
    return [F.when(col(ratio) == 0, whole(width)).otherwise(div(h * q["n"], q["d"])), h]


def payload(body, offset, size) -> Column:
    """The bytes of a section, null where it does not lie inside the stream."""
    o, n = col(offset).cast("int"), col(size).cast("int")
    return F.when((o >= 0) & (n >= 0) & (o + n <= F.octet_length(col(body))), F.substring(col(body), o + 1, n))


#: What ``classified`` asks of a frame's layout.
LAID_OUT = ("w", "h", "group_dim", "groups_x", "groups_y", "dc_groups_x", "dc_groups_y")


def classified(kinds: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """frame, id, kind, pass, grp and the rectangle x, y, gw, gh of the sections that belong to a group.

    DC groups are eight times as long. Sections of groups that are not there drop out. A rectangle follows from the number
    of its group, so sections meet their frame's layout (an equi join by frame) and no groups; where they bring it along
    (``LAID_OUT``) there is nothing to join. Frames are few rows in Spark's eyes, but not few: they are not broadcast.
    """
    if frames is not None:
        kinds = kinds.select("frame", "id", "kind", "pass", "grp").join(frames.select("frame", *LAID_OUT).hint("merge"), "frame")
    dc = F.col("kind") == "dc_group"
    dim = F.when(dc, F.col("group_dim") * 8).otherwise(F.col("group_dim"))
    across, down = (F.when(dc, F.col(f"dc_groups_{a}")).otherwise(F.col(f"groups_{a}")) for a in "xy")
    x, y = F.col("grp") % across * dim, div("grp", across) * dim
    rows = kinds.where(F.col("kind").isin("dc_group", "ac_group") & (F.col("grp") >= 0) & (F.col("grp") < across * down))
    return rows.select("frame", "kind", "grp", "id", "pass", x.alias("x"), y.alias("y"), F.least(dim, F.col("w") - x).alias("gw"), F.least(dim, F.col("h") - y).alias("gh"))


def channel_rects(group_rows: DataFrame, channels: DataFrame | None = None, least: str = "min_shift", most: str = "max_shift") -> DataFrame:
    """frame, grp, channel, x, y, gw, gh: what a group holds of subsampled channels (frame, channel, cw, ch, shift).

    Only channels whose shift lies in the pass's bracket (columns of the groups) are in it, and only where anything is
    left of the rectangle. Without ``channels`` the groups have a row for each channel already, with its columns.
    """
    met = group_rows if channels is None else group_rows.join(channels.hint("merge"), "frame")
    met = met.where((F.col("shift") >= F.col(least)) & (F.col("shift") <= F.col(most)))
    shifted = lambda c: F.expr(f"shiftright({c}, int(shift))")
    x, y = shifted("x"), shifted("y")
    rows = met.select("frame", "grp", "channel", x.alias("x"), y.alias("y"), F.least(shifted("gw"), F.col("cw") - x).alias("gw"), F.least(shifted("gh"), F.col("ch") - y).alias("gh"))
    return rows.where("gw > 0 and gh > 0")


def coded_rect(x0, y0, x1, y1, upsampling) -> list[Column]:
    """A rectangle of the shown image in the coded one, rounded outwards."""
    u = col(upsampling)
    return [div(x0, u), div(y0, u), ceil_div(x1, u), ceil_div(y1, u)]


def dependency(rows: DataFrame) -> DataFrame:
    """What has to be decoded for a region (x, y, w, h) of an image (width, height): adds dx, dy, dw, dh.

    ``across`` and ``down`` say whether a squeeze runs that way, ``shift`` is the largest vertical shift of a channel.
    Any squeeze needs whole rows; a vertical one all rows from the top, for a region at the top only to the next
    multiple of 2**shift after it, for others to the end.
    """
    any_squeeze, down = F.col("across") | F.col("down"), F.col("down")
    unit = F.expr("shiftleft(1L, int(shift))")
    top = ceil_div(F.col("y") + F.col("h") + unit, unit) * unit
    height = F.when(~down, F.col("h")).when(F.col("y") == 0, top).otherwise(F.col("height"))
    return (
        rows.withColumn("dx", F.when(any_squeeze, 0).otherwise(F.col("x"))).withColumn("dw", F.when(any_squeeze, F.col("width")).otherwise(F.col("w")))
        .withColumn("dy", F.when(down, 0).otherwise(F.col("y")))
        .withColumn("dh", F.when(any_squeeze, F.least(height, F.col("height"))).otherwise(F.col("h")))
    )


def shifted_blocks(blocks: DataFrame, across: int, down: int) -> DataFrame:
    """Blocks (bx, by of a group wb x hb) that a subsampled channel has: those on its grid, at their places there."""
    x, y = F.shiftright("bx", across), F.shiftright("by", down)
    on = (F.shiftleft(x, across) == F.col("bx")) & (F.shiftleft(y, down) == F.col("by"))
    inside = (x < F.shiftright("wb", across)) & (y < F.shiftright("hb", down))
    return blocks.where(on & inside).withColumn("sx", x).withColumn("sy", y)


def extra_channels(frames: DataFrame, extras: DataFrame) -> DataFrame:
    """(frame, extra, cw, ch, shift, planned): extra channels (frame, extra, up) of frames (w, h, dim, up_log).

    A channel is planned for groups from the first one on that is larger than a group.
    """
    size = lambda c: ceil_div(c, F.col("up"))
    rows = extras.join(frames, "frame").withColumn("cw", size("w")).withColumn("ch", size("h"))
    large = (F.col("cw") > F.col("dim")) | (F.col("ch") > F.col("dim"))
    upto = W.partitionBy("frame").orderBy("extra")
    rows = rows.withColumn("planned", F.max(large).over(upto)).withColumn("shift", F.ceil(F.log2(F.col("up").cast("double"))).cast("bigint") - F.col("up_log"))
    return rows.select("frame", "extra", "cw", "ch", "shift", "planned")


def output_bytes(w, h, channels, bits) -> Column:
    """Bytes that a decoded image takes: one a sample up to 8 bits, else two."""
    return col(w) * col(h) * col(channels) * F.when(col(bits) <= 8, 1).otherwise(2)


# Names of the enumerations of headers, by code.
LABELS = {
    "blend": ("replace", "add", "blend", "weighted add", "multiply"),
    "frame": ("regular", "dc", "reference only", "skip progressive"),
    "encoding": ("var dct", "modular"),
    "space": ("rgb", "grey", "xyb", "unknown"),
    "orientation": ("identity", "mirror", "half turn", "flip", "transpose", "clockwise", "transpose across", "counterclockwise"),
}

# The enumerations whose codes have gaps.
SPARSE_LABELS = {
    "channel": {0: "alpha", 1: "depth", 2: "spot colour", 3: "selection mask", 4: "black", 5: "colour filter array", 6: "thermal", 15: "unknown", 16: "optional"},
    "white": {1: "d65", 2: "custom", 10: "e", 11: "dci"},
    "primaries": {1: "srgb", 2: "custom", 9: "rec2100", 11: "p3"},
    "transfer": {1: "bt709", 2: "unknown", 8: "linear", 13: "srgb", 16: "pq", 17: "dci", 18: "hlg"},
    "intent": {0: "perceptual", 1: "relative", 2: "saturation", 3: "absolute"},
    "transform": {0: "xyb", 1: "none", 2: "ycbcr"},
}


def sparse_label(kind: str, code) -> Column:
    """The name of a code of an enumeration whose codes have gaps, null for codes outside it."""
    pairs = [F.lit(v) for code_name in SPARSE_LABELS[kind].items() for v in code_name]
    return F.try_element_at(F.create_map(*pairs), col(code).cast("int"))


def label(kind: str, code, first: int = 0) -> Column:
    """The name of a code of an enumeration, null for codes outside it."""
    return F.get(F.array(*[F.lit(n) for n in LABELS[kind]]), (col(code) - first).cast("int"))


def clipped(x0, y0, w, h, width: int, height: int) -> list[Column]:
    """(x, y, w, h) of what a rectangle shares with a canvas; no width or height where that is nothing."""
    x, y = F.greatest(col(x0), F.lit(0)), F.greatest(col(y0), F.lit(0))
    return [x, y, F.greatest(F.least(col(x0) + col(w), F.lit(width)) - x, F.lit(0)), F.greatest(F.least(col(y0) + col(h), F.lit(height)) - y, F.lit(0))]


def timeline(frames: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Adds ``starts_ms``: when each frame (img, frame, ticks) is shown, at numerator / denominator ticks a second."""
    before = F.sum("ticks").over(W.partitionBy("img").orderBy("frame").rowsBetween(W.unboundedPreceding, -1))
    return frames.withColumn("starts_ms", div(F.coalesce(before, F.lit(0)) * denominator * 1000, F.lit(numerator)))
