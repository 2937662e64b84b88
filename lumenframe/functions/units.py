"""Units, constants and dimension-checked columns.

A Quantity is a Column in SI units with exponents over (kg, m, s, K, mol, A).
Dimensions belong to the column, so they are checked while the plan is built
and cost nothing at run time.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DimensionMismatch, NumericRefusal, UnknownName
from .guards import col, finite, guard

Dimension = tuple[int, int, int, int, int, int]
NONE: Dimension = (0, 0, 0, 0, 0, 0)
MASS: Dimension = (1, 0, 0, 0, 0, 0)
LENGTH: Dimension = (0, 1, 0, 0, 0, 0)
TIME: Dimension = (0, 0, 1, 0, 0, 0)
AMOUNT: Dimension = (0, 0, 0, 0, 1, 0)
CURRENT: Dimension = (0, 0, 0, 0, 0, 1)
VOLUME: Dimension = (0, 3, 0, 0, 0, 0)
AREA: Dimension = (0, 2, 0, 0, 0, 0)
SPEED: Dimension = (0, 1, -1, 0, 0, 0)
ENERGY: Dimension = (1, 2, -2, 0, 0, 0)
POWER: Dimension = (1, 2, -3, 0, 0, 0)
PRESSURE: Dimension = (1, -1, -2, 0, 0, 0)
CHARGE: Dimension = (0, 0, 1, 0, 0, 1)
VOLTAGE: Dimension = (1, 2, -3, 0, 0, -1)
RESISTANCE: Dimension = (1, 2, -3, 0, 0, -2)
CONDUCTANCE: Dimension = (-1, -2, 3, 0, 0, 2)
CAPACITANCE: Dimension = (-1, -2, 4, 0, 0, 2)
INDUCTANCE: Dimension = (1, 2, -2, 0, 0, -2)
FREQUENCY: Dimension = (0, 0, -1, 0, 0, 0)
DENSITY: Dimension = (1, -3, 0, 0, 0, 0)
DYNAMIC_VISCOSITY: Dimension = (1, -1, -1, 0, 0, 0)
KINEMATIC_VISCOSITY: Dimension = (0, 2, -1, 0, 0, 0)
FLOW: Dimension = (0, 3, -1, 0, 0, 0)
MOLAR_MASS: Dimension = (1, 0, 0, 0, -1, 0)
CONCENTRATION: Dimension = (0, -3, 0, 0, 1, 0)

# Unit name, factor to SI.
_FACTORS = {
    MASS: {"kg": 1.0, "g": 1e-3, "Da": 1.66053906892e-27},
    LENGTH: {"m": 1.0, "km": 1e3, "nm": 1e-9, "pm": 1e-12, "angstrom": 1e-10, "Å": 1e-10},
    TIME: {"s": 1.0},
    (0, 0, 0, 1, 0, 0): {"K": 1.0},
    AMOUNT: {"mol": 1.0},
    ENERGY: {"J": 1.0},
    VOLUME: {"L": 1e-3, "mL": 1e-6, "uL": 1e-9, "µL": 1e-9},
    PRESSURE: {"Pa": 1.0, "kPa": 1e3, "bar": 1e5, "atm": 101325.0},
    CURRENT: {"A": 1.0, "mA": 1e-3, "uA": 1e-6, "µA": 1e-6},
    CHARGE: {"C": 1.0},
    VOLTAGE: {"V": 1.0, "mV": 1e-3, "kV": 1e3},
    RESISTANCE: {"ohm": 1.0, "Ω": 1.0, "kohm": 1e3, "kΩ": 1e3, "Mohm": 1e6, "MΩ": 1e6},
    CAPACITANCE: {"F": 1.0, "mF": 1e-3, "uF": 1e-6, "µF": 1e-6, "nF": 1e-9, "pF": 1e-12},
    INDUCTANCE: {"H": 1.0, "mH": 1e-3, "uH": 1e-6, "µH": 1e-6},
    POWER: {"W": 1.0, "mW": 1e-3, "kW": 1e3},
    CONDUCTANCE: {"S": 1.0, "mS": 1e-3, "uS": 1e-6, "µS": 1e-6},
    FREQUENCY: {"Hz": 1.0, "kHz": 1e3, "MHz": 1e6},
}
UNITS: dict[str, tuple[float, Dimension]] = {name: (factor, dim) for dim, names in _FACTORS.items() for name, factor in names.items()}

# Constants in SI units, by id, with their aliases.
_CONSTANTS = (
    ("math.pi", ("pi", "π"), math.pi, NONE),
    ("physical.speed_of_light", ("c", "speed_of_light"), 299792458.0, SPEED),
    ("physical.planck_constant", ("h", "planck_constant"), 6.62607015e-34, (1, 2, -1, 0, 0, 0)),
    ("physical.reduced_planck_constant", ("hbar", "ħ"), 1.0545718176461565e-34, (1, 2, -1, 0, 0, 0)),
    ("physical.gravitational_constant", ("G", "gravitational_constant"), 6.67430e-11, (-1, 3, -2, 0, 0, 0)),
    ("physical.boltzmann_constant", ("k_B", "boltzmann_constant"), 1.380649e-23, (1, 2, -2, -1, 0, 0)),
    ("physical.avogadro_constant", ("N_A", "avogadro_constant"), 6.02214076e23, (0, 0, 0, 0, -1, 0)),
    ("physical.molar_gas_constant", ("R", "molar_gas_constant"), 8.31446261815324, (1, 2, -2, -1, -1, 0)),
    ("physical.atomic_mass_constant", ("m_u", "atomic_mass_constant"), 1.66053906892e-27, MASS),
)
CONSTANTS = {alias: (value, dim) for _, aliases, value, dim in _CONSTANTS for alias in aliases}
BASE_UNITS = ("kg", "m", "s", "K", "mol", "A")


def show(dim: Dimension) -> str:
    """Readable form of a dimension, such as kg·m²·s⁻²; 1 if there is none."""
    raised = str.maketrans("-0123456789", "⁻⁰¹²³⁴⁵⁶⁷⁸⁹")
    return "·".join(u + ("" if e == 1 else str(e).translate(raised)) for u, e in zip(BASE_UNITS, dim, strict=True) if e) or "1"


@dataclass(frozen=True)
class Quantity:
    column: Column
    dim: Dimension = NONE

    def _same(self, other: "Quantity", what: str) -> None:
        if self.dim != other.dim:
            raise DimensionMismatch(f"{what} of {show(self.dim)} and {show(other.dim)}")

    def __add__(self, other):
        other = quantity(other)
        self._same(other, "sum")
        return Quantity(self.column + other.column, self.dim)

    def __sub__(self, other):
        other = quantity(other)
        self._same(other, "difference")
        return Quantity(self.column - other.column, self.dim)

    def __mul__(self, other):
        other = quantity(other)
        return Quantity(self.column * other.column, tuple(a + b for a, b in zip(self.dim, other.dim, strict=True)))

    def __truediv__(self, other):
        other = quantity(other)
        return Quantity(self.column / other.column, tuple(a - b for a, b in zip(self.dim, other.dim, strict=True)))

    def __mod__(self, other):
        """Truncated remainder of exact integers without a dimension."""
        other = quantity(other).need(NONE, "remainder")
        self.need(NONE, "remainder")
        whole = lambda x: (x == F.floor(x)) & (F.abs(x) <= 2.0**53 - 1)
        return Quantity(guard(self.column % other.column, whole(self.column) & whole(other.column) & (other.column != 0), "G202: remainder needs exact integers and a divisor other than 0"))

    def __neg__(self):
        return Quantity(-self.column, self.dim)

    def __pow__(self, n: int):
        if int(n) != n:
            raise DimensionMismatch("a power needs an integer exponent")
        return Quantity(finite(F.pow(self.column, F.lit(float(n))), "power"), tuple(e * int(n) for e in self.dim))

    def sqrt(self):
        if any(e % 2 for e in self.dim):
            raise DimensionMismatch(f"square root of {show(self.dim)}")
        return Quantity(guard(F.sqrt(self.column), self.column >= 0, "G202: square root of a negative number"), tuple(e // 2 for e in self.dim))

    def compare(self, op: str, other) -> Column:
        other = quantity(other)
        self._same(other, "comparison")
        import operator

        return {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}[op](self.column, other.column)

    def need(self, dim: Dimension, what: str) -> "Quantity":
        if self.dim != dim:
            raise DimensionMismatch(f"{what} needs {show(dim)}, not {show(self.dim)}")
        return self

    def to(self, unit: str) -> Column:
        factor, dim = lookup(unit)
        return self.need(dim, f"conversion to {unit}").column / F.lit(factor)

    def alias(self, name: str) -> Column:
        return self.column.alias(name, metadata={"dim": list(self.dim), "unit_si": show(self.dim)})


def lookup(unit: str) -> tuple[float, Dimension]:
    if unit not in UNITS:
        raise UnknownName(f"unit {unit}")
    return UNITS[unit]


def quantity(x, unit: str | None = None) -> Quantity:
    """x as a quantity: a Column, column name or number, in a unit or without one."""
    if isinstance(x, Quantity):
        return x
    if isinstance(x, (int, float)) and not math.isfinite(x):
        raise NumericRefusal("a quantity must be finite")
    c = col(x) if not isinstance(x, (int, float)) else F.lit(float(x))
    if unit is None:
        return Quantity(c)
    factor, dim = lookup(unit)
    return Quantity(c * F.lit(factor), dim)


def constant(alias: str) -> Quantity:
    if alias not in CONSTANTS:
        raise UnknownName(f"constant {alias}")
    value, dim = CONSTANTS[alias]
    return Quantity(F.lit(value), dim)


def dimension_of(df: DataFrame, column: str) -> Dimension:
    return tuple(df.schema[column].metadata.get("dim", NONE))


def of_column(df: DataFrame, column: str) -> Quantity:
    """A column with the dimension its metadata states."""
    return Quantity(df[column], dimension_of(df, column))
