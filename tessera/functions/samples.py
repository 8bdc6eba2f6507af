"""Column functions on samples. Integers are bigint; ``//`` here truncates towards zero, as ``div`` in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str | int | float) -> Column:
    return c if isinstance(c, Column) else F.col(c) if isinstance(c, str) else F.lit(c)


def div(a, b) -> Column:
    """Integer quotient, truncated."""
    return F.call_function("div", col(a).cast("bigint"), col(b).cast("bigint"))


def wrap32(v) -> Column:
    """What a 32-bit signed integer would hold of ``v``."""
    return F.pmod(col(v).cast("bigint") + 2147483648, F.lit(4294967296)) - 2147483648


def zigzag(n) -> Column:
    """0, 1, 2, 3, ... stand for 0, -1, 1, -2, ..."""
    n = col(n).cast("bigint")
    return F.when(n % 2 == 0, F.shiftright(n, 1)).otherwise(-F.shiftright(n, 1) - 1)


def smooth_tendency(before, average, after) -> Column:
    """Slope estimate between monotone neighbours, 0 otherwise; clamped so that no value leaves its neighbours' range."""
    p, a, n = (col(x).cast("bigint") for x in (before, average, after))
    odd = lambda d: d.bitwiseAND(F.lit(1))
    fall = div(4 * p - 3 * n - a + 6, F.lit(12))
    fall = F.when(fall - odd(fall) > 2 * (p - a), 2 * (p - a) + 1).otherwise(fall)
    fall = F.when(fall + odd(fall) > 2 * (a - n), 2 * (a - n)).otherwise(fall)
    rise = div(4 * p - 3 * n - a - 6, F.lit(12))
    rise = F.when(rise + odd(rise) < 2 * (p - a), 2 * (p - a) - 1).otherwise(rise)
    rise = F.when(rise - odd(rise) < 2 * (a - n), 2 * (a - n)).otherwise(rise)
    return F.when((p >= a) & (a >= n), fall).when((p <= a) & (a <= n), rise).otherwise(F.lit(0).cast("bigint"))


def inverse_rct(kind: int, first, second, third) -> list[Column]:
    """Three channels back from a reversible colour transform: ``kind`` is 7 * permutation + variant, 0 to 41."""
    if not 0 <= kind < 42:
        raise ValueError("kind must be from 0 to 41")
    permutation, variant = divmod(kind, 7)
    a, b, c = (col(x).cast("bigint") for x in (first, second, third))
    if variant == 6:
        rest = wrap32(a - F.shiftright(c, 1))
        green = wrap32(c + rest)
        blue = wrap32(rest - F.shiftright(b, 1))
        out = [wrap32(blue + b), green, blue]
    else:
        if variant & 1:
            c = wrap32(c + a)
        if variant >> 1 == 1:
            b = wrap32(b + a)
        elif variant >> 1 == 2:
            b = wrap32(b + F.shiftright(wrap32(a + c), 1))
        out = [a, b, c]
    places = [permutation % 3, (permutation + 1 + permutation // 3) % 3, (permutation + 2 - permutation // 3) % 3]
    return [out[places.index(i)] for i in range(3)]


def clamp(v, low, high) -> Column:
    return F.least(F.greatest(col(v), col(low)), col(high))


def scale_depth(v, bits: int, most: int) -> Column:
    """A sample of ``bits`` bits on the scale 0 to ``most``, rounded."""
    top = (1 << bits) - 1
    return F.least(div(col(v).cast("bigint") * most + top // 2, F.lit(top)), F.lit(most).cast("bigint"))


def unpremultiply(v, bits: int, alpha, alpha_bits: int, most: int) -> Column:
    """The colour before it was multiplied by alpha, on the scale 0 to ``most``."""
    v, alpha = col(v).cast("bigint"), col(alpha).cast("bigint")
    top, alpha_top = (1 << bits) - 1, (1 << alpha_bits) - 1
    under = F.lit(top).cast("bigint") * F.greatest(alpha, F.lit(1))
    shown = F.least(div(v * alpha_top * most + div(under, F.lit(2)), under), F.lit(most).cast("bigint"))
    return F.when(alpha == 0, F.when(v == 0, F.lit(0)).otherwise(F.lit(most)).cast("bigint")).otherwise(shown)


def to_srgb(linear, most: int) -> Column:
    """Linear light 0 to 1 as an sRGB integer 0 to ``most``; out-of-range light is clamped."""
    v = clamp(col(linear).cast("double"), F.lit(0.0), F.lit(1.0))
    curve = F.when(v <= 0.0031308, 12.92 * v).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)
    return F.floor(curve * most + 0.5).cast("bigint")


def from_srgb(encoded) -> Column:
    """sRGB 0 to 1 as linear light."""
    v = clamp(col(encoded).cast("double"), F.lit(0.0), F.lit(1.0))
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def luma(r, g, b) -> Column:
    """Integer grey of encoded red, green and blue, in ten-thousandths, rounded."""
    return div(2126 * col(r) + 7152 * col(g) + 722 * col(b) + 5000, F.lit(10000))


# The format's inverse opsin matrix and bias.
OPSIN = [[11.031567, -9.866944, -0.164623], [-3.2541473, 4.4187703, -0.164623], [-3.6588514, 2.712923, 1.9459282]]
OPSIN_BIAS = -0.0037930732


def xyb_to_linear(x, y, b, intensity: float = 255.0) -> list[Column]:
    """Linear red, green and blue of XYB."""
    x, y, b = (col(c).cast("double") for c in (x, y, b))
    root = -((-OPSIN_BIAS) ** (1 / 3))
    mixed = [F.pow(v - root, F.lit(3.0)) + OPSIN_BIAS for v in (y + x, y - x, b)]
    return [(255.0 / intensity) * (mixed[0] * m[0] + mixed[1] * m[1] + mixed[2] * m[2]) for m in OPSIN]


def ycbcr_to_rgb(cb, y, cr) -> list[Column]:
    """Red, green and blue (0 to 1) of centred YCbCr."""
    cb, y, cr = (col(c).cast("double") for c in (cb, y, cr))
    y = y + 128.0 / 255.0
    return [y + 1.402 * cr, y - (0.114 * 1.772 / 0.587) * cb - (0.299 * 1.402 / 0.587) * cr, y + 1.772 * cb]


def encode(v, most: int) -> Column:
    """0 to 1 as an integer 0 to ``most``, rounded, clamped."""
    return F.floor(clamp(col(v), F.lit(0.0), F.lit(1.0)) * most + 0.5).cast("bigint")


def blend(source, below, alpha) -> Column:
    """Source over what is below, in 8 bits."""
    return div(col(source) * col(alpha) + col(below) * (255 - col(alpha)) + 127, F.lit(255))


def blend_alpha(source, below) -> Column:
    return F.least(col(source) + div(col(below) * (255 - col(source)) + 127, F.lit(255)), F.lit(255).cast("bigint"))


def quant_bias(q, bias: float, fraction: float) -> Column:
    """A quantised coefficient drawn towards zero: +-1 becomes +-bias, larger ones lose fraction / q."""
    q = col(q)
    return F.when(q == 0, F.lit(0.0)).when(F.abs(q) == 1, q * F.lit(bias)).otherwise(q - F.lit(fraction) / F.when(q != 0, q))


def in_depth(v, bits: int) -> Column:
    """Whether a sample fits ``bits`` bits; one that does not is an error of its source."""
    return (col(v) >= 0) & (col(v) <= (1 << bits) - 1)


def rgba(colours: list, alpha, bits: int, alpha_bits: int, most: int) -> list[Column]:
    """Red, green, blue and alpha on the scale 0 to ``most``; one colour stands for all three, no alpha is full alpha."""
    shown = [scale_depth(c, bits, most) for c in (colours * 3 if len(colours) == 1 else colours[:3])]
    return [*shown, F.lit(most).cast("bigint") if alpha is None else scale_depth(alpha, alpha_bits, most)]


def modular_xyb(y, x, b_less_y, quant: tuple[float, float, float]) -> list[Column]:
    """X, Y and B of integer planes stored as Y, X and B - Y."""
    y, x, b_less_y = col(y), col(x), col(b_less_y)
    return [x * F.lit(quant[0]), y * F.lit(quant[1]), (b_less_y + y) * F.lit(quant[2])]


def wide_add(a, b) -> Column:
    """Sum of two bigints as 64 bits, without a carry out."""
    a, b, low = col(a), col(b), F.lit(0xFFFFFFFF)
    small = a.bitwiseAND(low) + b.bitwiseAND(low)
    large = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(small, 32)
    return F.shiftleft(large, 32).bitwiseOR(small.bitwiseAND(low))


def checksum(values: str) -> Column:
    """Order-dependent 64-bit digest of an array of integers: c * 1099511628211 + index, rotated by 11, xor the value.

    The factor is 2**40 + 435, so the product is a shift and two small products.
    """
    places = F.transform(values, lambda v, i: F.struct(i.cast("bigint").alias("i"), v.cast("bigint").alias("v")))

    def step(c, s):
        high = F.shiftleft(F.shiftrightunsigned(c, 32) * 435, 32)
        product = wide_add(F.shiftleft(c, 40), wide_add(c.bitwiseAND(F.lit(0xFFFFFFFF)) * 435, high))
        moved = wide_add(product, s["i"])
        turned = F.shiftleft(moved, 11).bitwiseOR(F.shiftrightunsigned(moved, 53))
        return turned.bitwiseXOR(s["v"].bitwiseAND(F.lit(0xFFFFFFFF)))

    return F.aggregate(places, F.lit(0).cast("bigint"), step)


def soft_step(v) -> Column:
    """The error function, by the rational approximation that the format's renderers use."""
    x = F.abs(col(v))
    # fixed values of the approximation
    d = (((x * 7.77394369e-02 + 2.05260015e-04) * x + 2.32120216e-01) * x + 2.77820801e-01) * x + 1
    whole = 1 - 1 / F.pow(d, F.lit(4.0))
    return F.when(col(v) <= 0, -whole).otherwise(whole)
