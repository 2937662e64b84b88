"""Chemistry, electrical and fluid formulas on quantities; dimensions are checked while the plan is built."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DataRefusal, DimensionMismatch, UnknownName
from . import units as u
from .guards import col, finite, guard
from .units import Quantity, quantity

REGISTRY = "lumenframe-elements-v1"
# Element symbol, atomic number, abridged standard atomic weight.
_ELEMENTS = """
H 1 1.0080
He 2 4.0026
Li 3 6.94
Be 4 9.0122
B 5 10.81
C 6 12.011
N 7 14.007
O 8 15.999
F 9 18.998
Ne 10 20.180
Na 11 22.990
Mg 12 24.305
Al 13 26.982
Si 14 28.085
P 15 30.974
S 16 32.06
Cl 17 35.45
Ar 18 39.95
K 19 39.098
Ca 20 40.078
Sc 21 44.956
Ti 22 47.867
V 23 50.942
Cr 24 51.996
Mn 25 54.938
Fe 26 55.845
Co 27 58.933
Ni 28 58.693
Cu 29 63.546
Zn 30 65.38
Se 34 78.971
Br 35 79.904
Mo 42 95.95
Ag 47 107.8682
Cd 48 112.414
I 53 126.90447
Xe 54 131.293
Ba 56 137.327
Pt 78 195.084
Au 79 196.96657
Hg 80 200.592
Pb 82 207.2
U 92 238.02891
"""
ELEMENTS = {s: (int(n), float(w)) for s, n, w in (line.split() for line in _ELEMENTS.split("\n") if line)}
_TOKEN = re.compile(r"([A-Z][a-z]?)|(\()|\)|([0-9]+)")


def _element(symbol: str) -> tuple[int, float]:
    if symbol not in ELEMENTS:
        raise UnknownName(f"element {symbol}")
    return ELEMENTS[symbol]


def molar_mass_of(formula: str) -> float:
    """Grams per mole of a formula with groups, such as Ca(OH)2."""
    stack: list[list[float]] = [[]]
    at, can_count = 0, False
    while at < len(formula):
        m = _TOKEN.match(formula, at)
        if not m:
            raise DataRefusal(f"formula {formula!r} at {at}")
        if m[1]:
            stack[-1].append(_element(m[1])[1])
            can_count = True
        elif m[2]:
            stack.append([])
            can_count = False
        elif m[3]:
            if not can_count or m[3].startswith("0") or len(m[3]) > 6:
                raise DataRefusal(f"count in formula {formula!r} at {at}")
            stack[-1][-1] *= int(m[3])
            can_count = False
        else:
            if len(stack) == 1 or not stack[-1]:
                raise DataRefusal(f"group in formula {formula!r} at {at}")
            group = math.fsum(stack.pop())
            stack[-1].append(group)
            can_count = True
        at = m.end()
    if len(stack) != 1 or not stack[0]:
        raise DataRefusal(f"formula {formula!r} is empty or has an open group")
    return math.fsum(stack[0])


def _molar_masses(formula: pd.Series) -> pd.Series:
    return formula.map(molar_mass_of, na_action="ignore").astype("float64")


def chem_registry_version() -> Column:
    return F.lit(REGISTRY)


def _by_symbol(symbol, which: int) -> Column:
    pairs = [x for s, v in ELEMENTS.items() for x in (F.lit(s), F.lit(float(v[which])))]
    value = F.element_at(F.create_map(*pairs), col(symbol))
    return F.when(col(symbol).isNull(), F.lit(None)).when(value.isNull(), F.raise_error(F.lit("G101: unknown element"))).otherwise(value)


def chem_atomic_number(symbol) -> Column:
    return _by_symbol(symbol, 0)


def chem_atomic_weight(symbol) -> Column:
    return _by_symbol(symbol, 1)


def chem_molar_mass(formula) -> Quantity:
    return Quantity(F.pandas_udf(_molar_masses, T.DoubleType())(col(formula)) * 1e-3, u.MOLAR_MASS)


def _arg(x, dim: u.Dimension, what: str, sign: str = "") -> Quantity:
    """x with this dimension; sign '+' needs a positive value, '0' one that is not negative, '!' one other than 0."""
    q = quantity(x).need(dim, what)
    ok = {"": F.lit(True), "+": q.column > 0, "0": q.column >= 0, "!": q.column != 0}[sign]
    return q if not sign else Quantity(guard(q.column, ok, f"G202: {what} out of range"), dim)


def _out(q: Quantity, dim: u.Dimension) -> Quantity:
    return Quantity(finite(q.column), q.need(dim, "result").dim)


def chem_moles(mass, molar_mass) -> Quantity:
    return _out(_arg(mass, u.MASS, "mass", "0") / _arg(molar_mass, u.MOLAR_MASS, "molar mass", "+"), u.AMOUNT)


def chem_mass(amount, molar_mass) -> Quantity:
    return _out(_arg(amount, u.AMOUNT, "amount", "0") * _arg(molar_mass, u.MOLAR_MASS, "molar mass", "+"), u.MASS)


def chem_concentration(amount, volume) -> Quantity:
    return _out(_arg(amount, u.AMOUNT, "amount", "0") / _arg(volume, u.VOLUME, "volume", "+"), u.CONCENTRATION)


def chem_dilution(concentration, initial, final) -> Quantity:
    before, after = _arg(initial, u.VOLUME, "initial volume", "+"), _arg(final, u.VOLUME, "final volume", "+")
    after = Quantity(guard(after.column, after.column >= before.column, "G202: the final volume is below the initial volume"), u.VOLUME)
    return _out(_arg(concentration, u.CONCENTRATION, "concentration", "0") * before / after, u.CONCENTRATION)


def ee_voltage(current, resistance) -> Quantity:
    return _out(_arg(current, u.CURRENT, "current") * _arg(resistance, u.RESISTANCE, "resistance", "0"), u.VOLTAGE)


def ee_current(voltage, resistance) -> Quantity:
    return _out(_arg(voltage, u.VOLTAGE, "voltage") / _arg(resistance, u.RESISTANCE, "resistance", "+"), u.CURRENT)


def ee_resistance(voltage, current) -> Quantity:
    r = _arg(voltage, u.VOLTAGE, "voltage") / _arg(current, u.CURRENT, "current", "!")
    return _out(_arg(r, u.RESISTANCE, "resulting resistance", "0"), u.RESISTANCE)


def ee_power(voltage, current) -> Quantity:
    return _out(_arg(voltage, u.VOLTAGE, "voltage") * _arg(current, u.CURRENT, "current"), u.POWER)


def ee_power_i2r(current, resistance) -> Quantity:
    i = _arg(current, u.CURRENT, "current")
    return _out(i * i * _arg(resistance, u.RESISTANCE, "resistance", "0"), u.POWER)


def ee_power_v2r(voltage, resistance) -> Quantity:
    v = _arg(voltage, u.VOLTAGE, "voltage")
    return _out(v * v / _arg(resistance, u.RESISTANCE, "resistance", "+"), u.POWER)


def ee_energy(power, time) -> Quantity:
    return _out(_arg(power, u.POWER, "power") * _arg(time, u.TIME, "time", "0"), u.ENERGY)


def ee_charge(current, time) -> Quantity:
    return _out(_arg(current, u.CURRENT, "current") * _arg(time, u.TIME, "time", "0"), u.CHARGE)


def _items(a, dim: u.Dimension, what: str, ok=None) -> Column:
    a = quantity(a).need(dim, what).column
    a = guard(a, F.size(a) > 0, f"G203: {what} needs a non-empty array")
    return a if ok is None else guard(a, F.forall(a, ok), f"G202: {what} out of range")


def ee_series_resistance(resistances) -> Quantity:
    a = _items(resistances, u.RESISTANCE, "resistances", lambda x: x >= 0)
    return Quantity(finite(F.aggregate(a, F.lit(0.0), lambda s, x: s + x)), u.RESISTANCE)


def ee_parallel_resistance(resistances) -> Quantity:
    a = _items(resistances, u.RESISTANCE, "resistances", lambda x: x > 0)
    least = F.array_min(a)
    return Quantity(finite(least / F.aggregate(F.transform(a, lambda x: least / x), F.lit(0.0), lambda s, x: s + x)), u.RESISTANCE)


def ee_rc_time_constant(resistance, capacitance) -> Quantity:
    return _out(_arg(resistance, u.RESISTANCE, "resistance", "0") * _arg(capacitance, u.CAPACITANCE, "capacitance", "0"), u.TIME)


def ee_capacitor_energy(capacitance, voltage) -> Quantity:
    v = _arg(voltage, u.VOLTAGE, "voltage")
    return _out(_arg(capacitance, u.CAPACITANCE, "capacitance", "0") * 0.5 * v * v, u.ENERGY)


def ee_inductor_energy(inductance, current) -> Quantity:
    i = _arg(current, u.CURRENT, "current")
    return _out(_arg(inductance, u.INDUCTANCE, "inductance", "0") * 0.5 * i * i, u.ENERGY)


def _residual(a, dim: u.Dimension, what: str) -> Quantity:
    return Quantity(finite(F.aggregate(_items(a, dim, what), F.lit(0.0), lambda s, x: s + x)), dim)


def ee_kcl_residual(currents) -> Quantity:
    return _residual(currents, u.CURRENT, "currents")


def ee_kvl_residual(voltages) -> Quantity:
    return _residual(voltages, u.VOLTAGE, "voltages")


def ee_kcl_balanced(currents, tolerance) -> Column:
    return F.abs(ee_kcl_residual(currents).column) <= _arg(tolerance, u.CURRENT, "tolerance", "0").column


def ee_kvl_balanced(voltages, tolerance) -> Column:
    return F.abs(ee_kvl_residual(voltages).column) <= _arg(tolerance, u.VOLTAGE, "tolerance", "0").column


def ee_in_unit(x, unit: str) -> Column:
    if u.lookup(unit)[1] not in (u.CURRENT, u.CHARGE, u.VOLTAGE, u.RESISTANCE, u.CAPACITANCE, u.INDUCTANCE, u.POWER, u.CONDUCTANCE, u.FREQUENCY):
        raise DimensionMismatch(f"{unit} is not an electrical unit")
    return finite(quantity(x).to(unit))


def fluid_density(mass, volume) -> Quantity:
    return _out(_arg(mass, u.MASS, "mass", "0") / _arg(volume, u.VOLUME, "volume", "+"), u.DENSITY)


def fluid_kinematic_viscosity(dynamic, density) -> Quantity:
    return _out(_arg(dynamic, u.DYNAMIC_VISCOSITY, "dynamic viscosity", "+") / _arg(density, u.DENSITY, "density", "+"), u.KINEMATIC_VISCOSITY)


def fluid_dynamic_viscosity(kinematic, density) -> Quantity:
    return _out(_arg(kinematic, u.KINEMATIC_VISCOSITY, "kinematic viscosity", "+") * _arg(density, u.DENSITY, "density", "+"), u.DYNAMIC_VISCOSITY)


def fluid_volume_flow(area, speed) -> Quantity:
    return _out(_arg(area, u.AREA, "area", "+") * _arg(speed, u.SPEED, "speed"), u.FLOW)


def fluid_flow_speed(flow, area) -> Quantity:
    return _out(_arg(flow, u.FLOW, "volume flow") / _arg(area, u.AREA, "area", "+"), u.SPEED)


def fluid_reynolds(density, speed, length, dynamic) -> Quantity:
    v = _arg(speed, u.SPEED, "speed")
    return _out(_arg(density, u.DENSITY, "density", "+") * Quantity(F.abs(v.column), v.dim) * _arg(length, u.LENGTH, "length", "+") / _arg(dynamic, u.DYNAMIC_VISCOSITY, "dynamic viscosity", "+"), u.NONE)


def fluid_dynamic_pressure(density, speed) -> Quantity:
    v = _arg(speed, u.SPEED, "speed")
    return _out(_arg(density, u.DENSITY, "density", "+") * 0.5 * v * v, u.PRESSURE)


def fluid_bernoulli_total_pressure(static, density, speed) -> Quantity:
    return _out(_arg(static, u.PRESSURE, "static pressure") + fluid_dynamic_pressure(density, speed), u.PRESSURE)


def fluid_pipe_pressure_drop(density, dynamic, length, radius, flow) -> Quantity:
    """Laminar pressure drop; refuses a Reynolds number of 2000 or more."""
    r, q = _arg(radius, u.LENGTH, "pipe radius", "+"), _arg(flow, u.FLOW, "volume flow")
    mu = _arg(dynamic, u.DYNAMIC_VISCOSITY, "dynamic viscosity", "+")
    speed = q / (r * r * math.pi)
    reynolds = fluid_reynolds(density, speed, r * 2.0, mu)
    drop = mu * 8.0 * _arg(length, u.LENGTH, "pipe length", "+") * q / (r * r * r * r * math.pi)
    return _out(Quantity(guard(drop.column, reynolds.column < 2000, "G202: the pipe's Reynolds number is 2000 or more"), drop.dim), u.PRESSURE)
