"""Guarded scalar functions; each refuses outside its domain instead of giving NULL or NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .guards import col, finite, guard


def num(x) -> Column:
    return col(x).cast("double")


def sqrt(x) -> Column:
    x = num(x)
    return guard(F.sqrt(x), x >= 0, "G202: square root of a negative number")


def exp(x) -> Column:
    return finite(F.exp(num(x)), "exponential")


def floor(x) -> Column:
    return F.floor(num(x)).cast("double")


def ceil(x) -> Column:
    return F.ceil(num(x)).cast("double")


def round_half_away(x) -> Column:
    return F.round(num(x))


def ln(x) -> Column:
    x = num(x)
    return guard(F.ln(x), x > 0, "G202: logarithm of a number that is not positive")


def log10(x) -> Column:
    x = num(x)
    return guard(F.log10(x), x > 0, "G202: logarithm of a number that is not positive")


def sinr(x) -> Column:
    return F.sin(num(x))


def cosr(x) -> Column:
    return F.cos(num(x))


def tanr(x) -> Column:
    return finite(F.tan(num(x)), "tangent")


def sind(x) -> Column:
    return F.sin(F.radians(num(x)))


def cosd(x) -> Column:
    return F.cos(F.radians(num(x)))


def tand(x) -> Column:
    return finite(F.tan(F.radians(num(x))), "tangent")


def _unit_interval(x: Column, value: Column) -> Column:
    return guard(value, x.between(-1.0, 1.0), "G202: argument outside -1 to 1")


def asinr(x) -> Column:
    return _unit_interval(num(x), F.asin(num(x)))


def acosr(x) -> Column:
    return _unit_interval(num(x), F.acos(num(x)))


def asind(x) -> Column:
    return F.degrees(asinr(x))


def acosd(x) -> Column:
    return F.degrees(acosr(x))


def atanr(x) -> Column:
    return F.atan(num(x))


def atand(x) -> Column:
    return F.degrees(F.atan(num(x)))


def atan2r(y, x) -> Column:
    y, x = num(y), num(x)
    return guard(F.atan2(y, x), (y != 0) | (x != 0), "G202: atan2 of 0 and 0")


def atan2d(y, x) -> Column:
    return F.degrees(atan2r(y, x))


def deg2rad(x) -> Column:
    return F.radians(num(x))


def rad2deg(x) -> Column:
    return F.degrees(num(x))


def hypot(x, y) -> Column:
    return finite(F.hypot(num(x), num(y)), "hypotenuse")


sin, cos, tan, asin, acos, atan, atan2 = sinr, cosr, tanr, asinr, acosr, atanr, atan2r


def is_close(a, b, abs_tol: float, rel_tol: float) -> Column:
    """|a - b| <= max(abs_tol, rel_tol * max(|a|, |b|)); both tolerances are stated."""
    a, b = num(a), num(b)
    return F.abs(a - b) <= F.greatest(F.lit(float(abs_tol)), F.lit(float(rel_tol)) * F.greatest(F.abs(a), F.abs(b)))


def same_bits(a, b) -> Column:
    """IEEE bit equality; 0 and -0 differ, any two NaN are equal."""
    a, b = num(a), num(b)
    # a double's text tells every value from every other, and the two zeros
    return a.cast("string") == b.cast("string")


def minimum(*xs) -> Column:
    return F.least(*[num(x) for x in xs])


def maximum(*xs) -> Column:
    return F.greatest(*[num(x) for x in xs])
