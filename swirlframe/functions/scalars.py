"""Elementwise functions of field values, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zero_small(x: Column, eps: float = 1e-5) -> Column:
    """0 where |x| < eps."""
    return F.when(F.abs(x) < eps, F.lit(0.0)).otherwise(x.cast("double"))


def magnitude(*c: Column) -> Column:
    return F.sqrt(sum((x.cast("double") * x.cast("double") for x in c[1:]), c[0].cast("double") * c[0].cast("double")))


def sign(x: Column) -> Column:
    return F.signum(x.cast("double")).cast("int")


def same_sign(*x: Column) -> Column:
    """All of one sign, which isn't 0."""
    first = sign(x[0])
    out = first != 0
    for y in x[1:]:
        out = out & (sign(y) == first)
    return out


def log_transform(x: Column) -> tuple[Column, Column, Column]:
    """(log2 of |x| with -100 for 0, whether x > 0, whether x = 0)."""
    y = x.cast("double")
    return F.when(y == 0, F.lit(-100.0)).otherwise(F.log2(F.abs(y))), y > 0, y == 0


def inverse_log(log: Column, positive: Column, zero: Column) -> Column:
    return F.when(zero, F.lit(0.0)).otherwise(F.pow(F.lit(2.0), log) * F.when(positive, 1.0).otherwise(-1.0))


def rotate(u: Column, v: Column, c: float | Column, s: float | Column) -> tuple[Column, Column]:
    c, s = (x if isinstance(x, Column) else F.lit(x) for x in (c, s))
    return c * u.cast("double") + s * v.cast("double"), c * v.cast("double") - s * u.cast("double")


def rotate_back(a: Column, b: Column, c: float | Column, s: float | Column) -> tuple[Column, Column]:
    c, s = (x if isinstance(x, Column) else F.lit(x) for x in (c, s))
    return c * a - s * b, s * a + c * b


def exponent(x: Column) -> Column:
    """The binary exponent of a double: floor(log2(|x|)), exact, from its bits; null for 0."""
    y = F.abs(x.cast("double"))
    guess = F.floor(F.log2(y))
    low = F.pow(F.lit(2.0), guess)
    return F.when(y > 0, F.when(low > y, guess - 1).when(low * 2 <= y, guess + 1).otherwise(guess)).cast("int")


def bit_length(x: Column) -> Column:
    """Binary digits of a positive bigint: exact, where a logarithm is not."""
    return F.length(F.bin(x)).cast("int")


def next_power_of_two(x: Column) -> Column:
    """The smallest power of two that is no less than a positive bigint."""
    return F.when(x <= 1, F.lit(1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), bit_length(x - 1)))


def absolute_bound(eb: float, factor: int) -> int:
    """An absolute error bound in units of fixed point, truncated."""
    return int(eb * factor)


def relative_bound(eb: float, fixed_range: int) -> int:
    """A bound relative to the range of the fixed-point values, truncated."""
    return int(eb * fixed_range)


def quantize_bound(eb: Column) -> tuple[Column, Column]:
    """(id, bound): the largest power of two within the bound, as its exponent; bounds of at most 1 are lossless, (0, 0)."""
    id_ = F.when(eb <= 1, F.lit(0)).otherwise(bit_length(eb) - 1)
    return id_, F.when(eb <= 1, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), id_))


def quantize_bound_offset(eb: Column, threshold: int = 1) -> tuple[Column, Column]:
    """(id from 1, bound): as quantize_bound() in multiples of a threshold; smaller bounds become the threshold; saturates at 63."""
    top = (1 << 63) - 1
    q = F.greatest(_div(eb, F.lit(threshold).cast("long")), F.lit(1).cast("long"))
    id_ = F.when(eb <= threshold, F.lit(1)).otherwise(F.when(bit_length(q) >= 63, 63).otherwise(bit_length(q)))
    return id_, bound_of_offset(id_, threshold) if threshold == 1 else F.when(id_ >= 63, F.lit(top)).otherwise(F.call_function("shiftleft", F.lit(threshold).cast("long"), id_ - 1))


def bound_of_offset(id_: Column, threshold: int = 1) -> Column:
    """The bound of an id of quantize_bound_offset(); 0 for ids below 1 (lossless)."""
    return F.when(id_ <= 0, F.lit(0).cast("long")).when(id_ >= 63, F.lit((1 << 63) - 1)).otherwise(F.call_function("shiftleft", F.lit(threshold).cast("long"), id_ - 1))


def quantize_linear(eb: Column, threshold: float = 1e-5) -> tuple[Column, Column]:
    """(id, bound): whole multiples of a threshold, rounded down."""
    id_ = F.floor(eb.cast("double") / threshold).cast("int")
    return id_, id_ * F.lit(threshold)


def quantize_value(x: Column, pred: Column, eb: Column, radius: int = 32768) -> tuple[Column, Column, Column]:
    """(code, value, ok): the residual in steps of twice the bound, what decoding gives, and whether it holds the bound.

    A bound of 0, or a code beyond 2 * radius, is not ok; such values are kept as they are.
    """
    step = F.when(eb > 0, eb).otherwise(F.lit(1).cast("long"))
    steps = _div(F.abs(x - pred), step) + 1
    half = _div(steps, F.lit(2).cast("long"))
    code = F.when(x < pred, -half).otherwise(half) + radius
    value = pred + 2 * (code - radius) * eb
    ok = (eb > 0) & (steps < 2 * radius) & (F.abs(value - x) <= eb)
    return code, F.when(ok, value).otherwise(x), ok


def _div(x: Column, y: Column) -> Column:
    """Whole division of bigints, towards zero."""
    return F.call_function("div", x, y)


def relax(eb: Column, factor: float = 8.0) -> Column:
    return eb * F.lit(factor)


def restrict(eb: Column) -> Column:
    return eb / F.lit(2.0)


def zigzag(x: Column) -> Column:
    """0, -1, 1, -2, ... become 0, 1, 2, 3, ..."""
    return F.when(x >= 0, 2 * x).otherwise(-2 * x - 1)


def unzigzag(z: Column) -> Column:
    return F.when(z % 2 == 0, _div(z, F.lit(2).cast("long"))).otherwise(-_div(z + 1, F.lit(2).cast("long")))


def mantissa(x: Column) -> Column:
    """x over the power of two of its exponent(): a magnitude from 1 to below 2, with x's sign; null for 0."""
    return x.cast("double") / F.pow(F.lit(2.0), exponent(x))


def shortened(x: Column, eb: float) -> Column:
    """x with the bits of its mantissa below an error bound dropped: a whole multiple of the largest power of two within eb, towards 0.

    What codecs keep of values that no code reaches.
    """
    import math

    step = 2.0 ** math.floor(math.log2(eb))
    y = x.cast("double") / F.lit(step)
    return F.when(y < 0, F.ceil(y)).otherwise(F.floor(y)).cast("double") * F.lit(step)
