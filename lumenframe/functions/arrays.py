"""Array and vector functions on array<double> columns, by higher-order functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .guards import col, finite, guard, let
from .math import acosr, atan2r, num

AU_M = 149597870700.0
LY_M = 9460730472580800.0
PC_M = AU_M * 648000.0 / math.pi
LIGHT = 299792458.0


def _pair(a: Column, b: Column, value: Column) -> Column:
    return guard(value, F.size(a) == F.size(b), "G203: arrays of different length")


def elementwise(op, a, b=None) -> Column:
    """op over one array, two arrays of equal length, or an array and a scalar."""
    a = col(a)
    if b is None:
        return F.transform(a, op)
    if isinstance(b, (int, float)):
        return F.transform(a, lambda x: op(x, F.lit(float(b))))
    b = col(b)
    return _pair(a, b, F.zip_with(a, b, op))


def total(a) -> Column:
    """Neumaier sum in array order."""
    state = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))

    def step(acc, x):
        t = acc["s"] + x
        lost = F.when(F.abs(acc["s"]) >= F.abs(x), acc["s"] - t + x).otherwise(x - t + acc["s"])
        return F.struct(t.alias("s"), (acc["c"] + lost).alias("c"))

    return finite(F.aggregate(col(a).cast("array<double>"), state, step, lambda acc: acc["s"] + acc["c"]), "sum")


def dot(a, b) -> Column:
    a, b = col(a), col(b)
    return _pair(a, b, total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))))


def magnitude(a) -> Column:
    return vector_norm(a)


def vector_norm(a) -> Column:
    """Euclidean norm, scaled by the largest entry so that squares neither overflow nor vanish."""
    a = col(a).cast("array<double>")
    squares = lambda top: F.aggregate(a, F.lit(0.0), lambda s, x: s + (x / top) * (x / top))
    return let(F.array_max(F.transform(a, F.abs)), lambda top: F.when(top == 0, F.lit(0.0)).otherwise(finite(top * F.sqrt(squares(top)), "norm")))


def vector_unit(a) -> Column:
    a = col(a).cast("array<double>")
    return let(vector_norm(a), lambda norm: F.transform(a, lambda x: x / guard(norm, norm > 0, "G202: the zero vector has no direction")))


def cross(a, b) -> Column:
    a, b = col(a), col(b)
    at = lambda v, i: F.element_at(v, i).cast("double")
    parts = [at(a, i) * at(b, j) - at(a, j) * at(b, i) for i, j in ((2, 3), (3, 1), (1, 2))]
    return guard(F.array(*parts), (F.size(a) == 3) & (F.size(b) == 3), "G203: a cross product needs three entries")


def append(a, v) -> Column:
    return F.array_append(col(a), col(v))


def index(a, i) -> Column:
    return F.element_at(col(a), col(i).cast("int") + 1)


def slice_of(a, i: int, j: int) -> Column:
    a = col(a)
    return guard(F.slice(a, i + 1, j - i), F.lit(0 <= i <= j) & (F.size(a) >= j), "G203: slice out of bounds")


def sort(a) -> Column:
    """Stable ascending copy; 0 and -0 keep their order."""
    return F.array_sort(col(a), lambda x, y: F.when(x < y, -1).when(x > y, 1).otherwise(0))


def ecdf(a, q) -> Column:
    a = col(a)
    return guard(F.size(F.filter(a, lambda x: x <= q)) / F.size(a), F.size(a) > 0, "G203: empty array")


def au2m(x) -> Column:
    return num(x) * AU_M


def m2au(x) -> Column:
    return num(x) / AU_M


def pc2m(x) -> Column:
    return num(x) * PC_M


def m2pc(x) -> Column:
    return num(x) / PC_M


def ly2m(x) -> Column:
    return num(x) * LY_M


def m2ly(x) -> Column:
    return num(x) / LY_M


def polar2cartesianr(r, angle) -> Column:
    r, angle = num(r), num(angle)
    return F.array(*[guard(r, r >= 0, "G202: negative radius") * f(angle) for f in (F.cos, F.sin)])


def polar2cartesiand(r, angle) -> Column:
    return polar2cartesianr(r, F.radians(num(angle)))


def spherical2cartesianr(r, inclination, azimuth) -> Column:
    r, t, p = num(r), num(inclination), num(azimuth)
    r = guard(r, (r >= 0) & t.between(0.0, math.pi), "G202: radius or inclination out of range")
    return F.array(r * F.sin(t) * F.cos(p), r * F.sin(t) * F.sin(p), r * F.cos(t))


def spherical2cartesiand(r, inclination, azimuth) -> Column:
    return spherical2cartesianr(r, F.radians(num(inclination)), F.radians(num(azimuth)))


def cartesian_radius(v) -> Column:
    return vector_norm(v)


def cartesian_azimuthr(v) -> Column:
    return atan2r(F.element_at(col(v), 2), F.element_at(col(v), 1))


def cartesian_azimuthd(v) -> Column:
    return F.degrees(cartesian_azimuthr(v))


def cartesian_inclinationr(v) -> Column:
    norm = vector_norm(v)
    return acosr(F.element_at(col(v), 3) / guard(norm, norm > 0, "G202: the origin has no direction"))


def cartesian_inclinationd(v) -> Column:
    return F.degrees(cartesian_inclinationr(v))


def velocity(distance, time) -> Column:
    t = num(time)
    return num(distance) / guard(t, t > 0, "G202: time must be positive")


def velocity_add_galilean(u, v) -> Column:
    return finite(num(u) + num(v), "velocity")


def velocity_add_relativistic_collinear(u, v) -> Column:
    u, v = num(u), num(v)
    ok = (F.abs(u) <= LIGHT) & (F.abs(v) <= LIGHT)
    # divided first, so that equal and opposite light speeds are refused and not 0 / 0
    below = 1.0 + (u / LIGHT) * (v / LIGHT)
    return guard((u + v) / guard(below, below > 0, "G202: undefined velocity sum"), ok, "G202: speed above light")


def angular_velocityr(angle, time) -> Column:
    return velocity(angle, time)


def angular_velocityd(angle, time) -> Column:
    return velocity(F.radians(num(angle)), time)


def tangential_velocity(omega, radius) -> Column:
    return num(omega) * num(radius)


def centripetal_acceleration(speed, radius) -> Column:
    r = num(radius)
    return num(speed) * num(speed) / guard(r, r > 0, "G202: radius must be positive")


def angular_momentum(inertia, omega) -> Column:
    return num(inertia) * num(omega)


def angular_momentum_from_velocity(mass, speed, radius) -> Column:
    return num(mass) * num(speed) * num(radius)
