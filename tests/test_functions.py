import math

import pytest
from pyspark.sql import functions as F

from lumenframe.errors import DimensionMismatch, Refusal, UnknownName
from lumenframe.functions import arrays as A
from lumenframe.functions import domain as D
from lumenframe.functions import math as M
from lumenframe.functions import text as X
from lumenframe.functions import units as U
from lumenframe.functions.units import quantity


def test_text_round_trips(one):
    for s in ("", "Ada π", "a\tb\"c", "科学", "ß"):
        t = F.lit(s)
        assert one(X.str_from_hex(X.str_to_hex(t))) == s
        assert one(X.str_from_octal(X.str_to_octal(t))) == s
        assert one(X.str_from_binary(X.str_to_binary(t))) == s
        assert one(X.str_from_b64(X.str_to_b64(t))) == s
    assert one(X.str_upper(F.lit("straße"))) == "STRASSE"
    assert one(X.str_split(F.lit("a.b..c"), ".")) == ["a", "b", "", "c"]
    assert one(X.str_trim(F.lit(" x \t"))) == "x"
    assert one(X.str_len(F.lit("π"))) == 1 and one(X.str_bytes_len(F.lit("π"))) == 2
    assert [one(X.str_compare(F.lit(a), F.lit(b))) for a, b in (("a", "b"), ("b", "a"), ("a", "a"))] == [-1, 1, 0]


@pytest.mark.parametrize("bad", ["abc", "a===", "QQ", "QR==", "Q Q="])
def test_base64_is_canonical(one, refused, bad):
    refused(lambda: one(X.str_from_b64(F.lit(bad))))


def test_bases(one, refused):
    assert one(X.to_base(F.lit(-10), 2)) == "-1010" and one(X.from_base(F.lit("-ff"), 16)) == -255.0
    assert one(X.to_base(F.lit(0), 8)) == "0"
    for bad in ("12", "", "0b1", "1" * 54):
        refused(lambda bad=bad: one(X.from_base(F.lit(bad), 2)))
    refused(lambda: one(X.to_base(F.lit(1.5), 10)))


@pytest.mark.parametrize(("s", "v"), [(" 1.5 ", 1.5), ("-.5e3", -500.0), ("007", 7.0), ("9007199254740991", 9007199254740991.0), ("0e5", 0.0)])
def test_parse_number(one, s, v):
    assert one(X.parse_number(F.lit(s))) == v


@pytest.mark.parametrize("s", ["NaN", "inf", "0x1p3", "1d", "1e400", "1e-400", "", "1,5", "9007199254740993"])
def test_parse_number_refuses(one, refused, s):
    refused(lambda: one(X.parse_number(F.lit(s))))


def test_number_text():
    assert [X.number_text(x) for x in (1.0, 100.0, 1e15, 1e14, 1e-4, 1e-5, -0.0, 0.1, 123456.789)] == ["1", "100", "1e+15", "100000000000000", "0.0001", "1e-5", "-0", "0.1", "123456.789"]
    for x in (math.pi, 1 / 3, 5e-324, 1.7976931348623157e308, 2**53 - 1.0):
        assert float(X.number_text(x)) == x


def test_interpolation(one):
    assert one(X.interpolate("{a} is {b:.2f}!", a=F.lit("x"), b=F.lit(1.005))) in ("x is 1.00!", "x is 1.01!")


def test_printf(one):
    assert one(X.printf("%s: %.2f%% of %f", F.lit("x"), F.lit(12.345), F.lit(1))) in ("x: 12.35% of 1.000000", "x: 12.34% of 1.000000")
    for template, values in (("%d", [F.lit(1)]), ("%s", []), ("%5s", [F.lit("a")]), ("100%", [])):
        with pytest.raises(Refusal):
            X.printf(template, *values)


def test_math_domains(one, refused):
    for f, x in ((M.ln, 0.0), (M.log10, -1.0), (M.sqrt, -1.0), (M.asin, 2.0), (M.acosd, -1.5), (M.exp, 1e4)):
        refused(lambda f=f, x=x: one(f(F.lit(x))))
    refused(lambda: one(M.atan2(F.lit(0.0), F.lit(0.0))))
    assert one(M.round_half_away(F.lit(-2.5))) == -3.0 and one(M.floor(F.lit(-0.5))) == -1.0
    assert one(M.sind(F.lit(30.0))) == pytest.approx(0.5) and one(M.acosd(F.lit(0.0))) == pytest.approx(90)
    assert one(M.is_close(F.lit(1.0), F.lit(1.05), 0.0, 0.05)) and not one(M.is_close(F.lit(1.0), F.lit(1.2), 0.1, 0.0))


def test_same_bits(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, -0.0), (1.0, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(M.same_bits("a", "b")).collect()] == [True, False, True]


def test_arrays(one, refused):
    v = lambda *xs: F.array(*[F.lit(float(x)) for x in xs])
    assert one(A.total(v(1e16, 1, -1e16))) == 1.0
    refused(lambda: one(A.total(v(1.7e308, 1.7e308))))
    assert one(A.dot(v(1, 2, 3), v(4, 5, 6))) == 32.0
    assert one(A.cross(v(1, 0, 0), v(0, 1, 0))) == [0.0, 0.0, 1.0]
    refused(lambda: one(A.dot(v(1), v(1, 2))))
    refused(lambda: one(A.cross(v(1, 2), v(1, 2))))
    assert one(A.vector_norm(v(3e200, 4e200))) == pytest.approx(5e200) and one(A.vector_norm(v(0, 0))) == 0.0
    refused(lambda: one(A.vector_unit(v(0, 0))))
    assert one(A.slice_of(v(1, 2, 3), 1, 3)) == [2.0, 3.0] and one(A.index(v(1, 2), F.lit(1))) == 2.0
    refused(lambda: one(A.slice_of(v(1), 0, 2)))
    assert one(A.sort(v(3, 1, 2))) == [1.0, 2.0, 3.0] and one(A.append(v(1), F.lit(2.0))) == [1.0, 2.0]
    assert one(A.ecdf(v(2, 1, 2, 4), F.lit(2.0))) == 0.75
    refused(lambda: one(A.velocity_add_relativistic_collinear(F.lit(4e8), F.lit(0.0))))
    assert one(A.velocity_add_relativistic_collinear(F.lit(A.LIGHT), F.lit(1.0))) == pytest.approx(A.LIGHT)
    assert one(A.cartesian_inclinationd(v(0, 0, 1))) == pytest.approx(0)
    refused(lambda: one(A.polar2cartesianr(F.lit(-1.0), F.lit(0.0))))


def test_units(one):
    assert one(quantity(2.0, "km").to("m")) == 2000.0
    with pytest.raises(DimensionMismatch):
        quantity(1.0, "m") + quantity(1.0, "s")
    with pytest.raises(UnknownName):
        quantity(1.0, "furlong")
    area = quantity(3.0, "m") * quantity(2.0, "m")
    assert area.dim == U.AREA and area.sqrt().dim == U.LENGTH
    with pytest.raises(DimensionMismatch):
        quantity(3.0, "m").sqrt()
    assert U.show((1, 2, -2, 0, 0, 0)) == "kg·m²·s⁻²" and U.show(U.NONE) == "1"
    assert len(U.UNITS) == 55 and one(U.constant("c").column) == 299792458.0


def test_dimension_travels_with_the_column(spark):
    df = spark.range(1).select(quantity(1.5, "km").alias("d"))
    assert U.of_column(df, "d").dim == U.LENGTH
    with pytest.raises(DimensionMismatch):
        D.ee_current(U.of_column(df, "d"), quantity(1.0, "ohm"))


@pytest.mark.parametrize(("f", "g"), [("H2O", 18.015), ("C6H12O6", 180.156), ("Ca(OH)2", 74.092), ("Fe2(SO4)3", 399.858)])
def test_molar_mass(f, g):
    assert D.molar_mass_of(f) == pytest.approx(g, abs=5e-3)


@pytest.mark.parametrize("f", ["", "h2o", "H0", "(", "H)", "()", "2H", "Xx", "H22x"])
def test_molar_mass_refuses(f):
    with pytest.raises(Refusal):
        D.molar_mass_of(f)


def test_formulas(one, refused):
    assert one(D.ee_voltage(quantity(2.0, "A"), quantity(3.0, "ohm")).column) == 6.0
    refused(lambda: one(D.ee_current(quantity(1.0, "V"), quantity(0.0, "ohm")).column))
    refused(lambda: one(D.ee_resistance(quantity(1.0, "V"), quantity(-1.0, "A")).column))
    rs = U.Quantity(F.array(F.lit(2.0), F.lit(2.0)), U.RESISTANCE)
    assert one(D.ee_parallel_resistance(rs).column) == 1.0 and one(D.ee_series_resistance(rs).column) == 4.0
    amps = U.Quantity(F.array(F.lit(2.0), F.lit(-2.0)), U.CURRENT)
    assert one(D.ee_kcl_balanced(amps, quantity(1e-9, "A")))
    with pytest.raises(DimensionMismatch):
        D.ee_in_unit(quantity(1.0, "m"), "km")
    assert one(D.chem_atomic_number(F.lit("Fe"))) == 26.0
    refused(lambda: one(D.chem_atomic_weight(F.lit("Zz"))))
    refused(lambda: one(D.fluid_pipe_pressure_drop(U.Quantity(F.lit(1000.0), U.DENSITY), U.Quantity(F.lit(0.001), U.DYNAMIC_VISCOSITY), quantity(1.0, "m"), quantity(0.1, "m"), U.Quantity(F.lit(1.0), U.FLOW)).column))
