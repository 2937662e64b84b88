"""Registered queries of the library's operators over the driver's tables, and their SQL.

Each query runs over whole tables. Sums of doubles are rounded on both sides,
since the order of addition differs between engines.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import domain as D
from ..functions import math as M
from ..functions import text as X
from ..functions import units as U
from ..functions.units import quantity
from ..operators import compare, cube, join, matrix, random, select, stats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c, n: int = 6):
    return F.round(c, n)


@query(
    "SELECT count(*) AS selected, count(*) AS used, sum(l_quantity) AS weight_sum, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 6) AS mean FROM lineitem WHERE l_discount >= 0.02 AND l_discount < 0.06"
)
def select_stats_weighted(spark, d):
    out = select.select_stats(table(spark, d, "lineitem"), "l_discount", 0.02, 0.06, "l_extendedprice", "l_quantity")
    return out.withColumn("mean", r("mean"))


@query(
    "SELECT event_id, event_type, value FROM (SELECT event_id, nullif(event_type, 'click') AS event_type, value FROM events) WHERE coalesce(value > 50, false) AND (coalesce(event_type <> 'view', false) OR event_type IS NULL)"
)
def where_all_any(spark, d):
    ev = table(spark, d, "events").withColumn("event_type", F.nullif("event_type", F.lit("click")))
    tree = select.all_of([select.where("value", ">", 50), select.any_of([select.where("event_type", "!=", "view"), select.where("event_type", "is_null")])])
    return select.select(ev, ["event_id", "event_type", "value"], tree)


@query(
    "SELECT count(*) AS n, count(*) FILTER (coalesce(t <> 'view', false)) AS not_view, count(*) FILTER (coalesce(t = 'view', false)) AS view, count(*) FILTER (t IS NULL) AS missing FROM (SELECT nullif(event_type, 'click') AS t FROM events)"
)
def where_null_is_false(spark, d):
    ev = table(spark, d, "events").select(F.nullif("event_type", F.lit("click")).alias("t"))
    n = lambda leaf: F.count_if(select.predicate(leaf))
    return ev.agg(F.count("*").alias("n"), n(select.where("t", "!=", "view")).alias("not_view"), n(select.where("t", "==", "view")).alias("view"), n(select.where("t", "is_null")).alias("missing"))


@query("SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount >= 0.02 AND l_discount < 0.03")
def half_open_range(spark, d):
    tree = select.all_of([select.where("l_discount", ">=", 0.02), select.where("l_discount", "<", 0.03)])
    return select.select(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_discount"], tree)


@query(
    "SELECT count(*) AS \"count\", round(sum(l_extendedprice), 2) AS \"sum\", round(sum(l_extendedprice) / count(*), 6) AS mean, min(l_extendedprice) AS \"min\", max(l_extendedprice) AS \"max\" FROM lineitem"
)
def scan_stats(spark, d):
    return stats.scan_stats(table(spark, d, "lineitem"), "l_extendedprice").withColumns({"sum": r("sum", 2), "mean": r("mean")})


@query("SELECT round(sum(o_totalprice), 2) AS total FROM orders")
def compensated_sum(spark, d):
    total = stats.compensated_sum(table(spark, d, "orders"), "o_totalprice")
    return spark.createDataFrame([(round(total, 2),)], "total double")


@query("SELECT 3 * count(*) AS \"count\", count(*)::DOUBLE AS \"sum\", -1e16::DOUBLE AS \"min\", 1e16::DOUBLE AS \"max\" FROM orders")
def cancelling_sum(spark, d):
    """Each order as 1e16, 1 and -1e16: a plain sum loses the ones."""
    t = table(spark, d, "orders").select(F.explode(F.array(F.lit(1e16), F.lit(1.0), F.lit(-1e16))).alias("v"))
    return stats.scan_stats(t, "v").select("count", "sum", "min", "max")


@query(
    "SELECT count(v) AS valid_count, round(avg(v), 6) AS mean, min(v) AS \"min\", max(v) AS \"max\" FROM (SELECT CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS v FROM orders)"
)
def column_stats(spark, d):
    v = table(spark, d, "orders").select(F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).alias("v"))
    return stats.column_stats(v, "v").withColumn("mean", r("mean"))


@query(
    "SELECT round(quantile_cont(o_totalprice::DOUBLE, 0.25::DOUBLE), 6) AS q25, round(quantile_cont(o_totalprice::DOUBLE, 0.5::DOUBLE), 6) AS q50, round(quantile_cont(o_totalprice::DOUBLE, 0.9::DOUBLE), 6) AS q90 FROM orders"
)
def quantile_type7(spark, d):
    points = {f"q{int(p * 100)}": p for p in (0.25, 0.5, 0.9)}
    return stats.quantiles(table(spark, d, "orders"), "o_totalprice", points).select(*[r(c).alias(c) for c in points])


@query("SELECT o_orderpriority, round(median(o_totalprice), 6) AS middle, round(avg(o_totalprice), 6) AS mean FROM orders GROUP BY 1")
def median_by_priority(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(r(stats.median("o_totalprice")).alias("middle"), r(stats.scaled_mean("o_totalprice")).alias("mean"))


@query("SELECT round(count(*) FILTER (o_totalprice <= 100000) / count(*), 12) AS p FROM orders")
def ecdf(spark, d):
    return table(spark, d, "orders").agg(r(stats.ecdf("o_totalprice", 100000), 12).alias("p"))


@query("SELECT l_returnflag, round(stddev_pop(l_quantity), 8) AS population, round(stddev_samp(l_quantity), 8) AS sample FROM lineitem GROUP BY 1")
def standard_deviation(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(r(stats.std_population("l_quantity"), 8).alias("population"), r(stats.std_sample("l_quantity"), 8).alias("sample"))


def _covariance_sql(f: str) -> str:
    cols = ("l_quantity", "l_discount", "l_tax")
    return " UNION ALL ".join(f"SELECT {i}::INT AS i, {j}::INT AS j, round({f}({a}, {b}), 8) AS covariance FROM lineitem" for i, a in enumerate(cols) for j, b in enumerate(cols))


@query(_covariance_sql("covar_pop"))
def covariance_population(spark, d):
    return stats.covariance(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], 0).withColumn("covariance", r("covariance", 8))


@query(_covariance_sql("covar_samp"))
def covariance_sample(spark, d):
    return stats.covariance(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], 1).withColumn("covariance", r("covariance", 8))


@query("SELECT true AS __join_matched, d.doc_id AS d_doc_id, d.lang AS d_lang, l.doc_id AS l_doc_id, l.quality AS l_quality FROM documents d JOIN labels l USING (doc_id)")
def join_inner_1to1(spark, d):
    return join.join_one_to_one(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "doc_id", "inner", "d_", "l_")


@query("SELECT l.doc_id IS NOT NULL AS __join_matched, d.doc_id AS d_doc_id, d.lang AS d_lang, l.doc_id AS l_doc_id, l.quality AS l_quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def join_left_1to1(spark, d):
    return join.join_one_to_one(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "doc_id", "left", "d_", "l_")


@query(
    "WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), h AS (SELECT least(floor((o_totalprice - lo) / (hi - lo) * 20)::INT, 19) AS bin, count(*) AS n FROM orders, e GROUP BY 1) SELECT b.bin::INT AS bin, coalesce(n, 0) AS n FROM range(20) b(bin) LEFT JOIN h ON b.bin = h.bin"
)
def histogram_inclusive(spark, d):
    return stats.histogram(table(spark, d, "orders"), "o_totalprice", 20)


_ORDINAL = "SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS ord FROM orders"


@query(f"WITH t AS ({_ORDINAL}), k AS (SELECT DISTINCT (i * ((SELECT count(*) FROM t) - 1)) // 99 AS ord FROM range(100) g(i)) SELECT ord, o_orderkey, o_totalprice FROM t JOIN k USING (ord)")
def even_row_sample(spark, d):
    rows = stats.with_ordinal(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    return stats.even_rows(rows, 100).select(F.col("_ord").cast("long").alias("ord"), "o_orderkey", "o_totalprice")


@query(f"WITH t AS ({_ORDINAL}) SELECT ord, o_orderkey, o_totalprice FROM t WHERE ord >= 100 AND ord < 164")
def row_slice(spark, d):
    rows = stats.with_ordinal(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    return stats.row_slice(rows, 100, 164).select(F.col("_ord").cast("long").alias("ord"), "o_orderkey", "o_totalprice")


@query("SELECT row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS ord, p_partkey, p_retailprice FROM part")
def sort_stable(spark, d):
    rows = stats.with_ordinal(table(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", "p_partkey")
    return rows.select(F.col("_ord").cast("long").alias("ord"), "p_partkey", "p_retailprice")


@query(
    "SELECT doc_id, trim(lang) AS trimmed, contains(text, 'the') AS has, length(replace(text, 'e', '')) AS less, upper(lang) AS up, lower(source) AS low, length(text) AS chars, strlen(text) AS bytes, len(string_split(text, '. ')) AS parts, array_to_string(string_split(source, 'r'), '|') AS joined, CASE WHEN lang < source THEN -1 WHEN lang > source THEN 1 ELSE 0 END AS ordered FROM documents"
)
def text_basics(spark, d):
    t = table(spark, d, "documents")
    return t.select(
        "doc_id", X.str_trim("lang").alias("trimmed"), X.str_contains("text", "the").alias("has"), F.char_length(X.str_replace("text", "e", "")).alias("less"),
        X.str_upper("lang").alias("up"), X.str_lower("source").alias("low"), X.str_len("text").alias("chars"), X.str_bytes_len("text").alias("bytes"),
        F.size(X.str_split("text", ". ")).alias("parts"), X.str_join("|", X.str_split("source", "r")).alias("joined"), X.str_compare("lang", "source").alias("ordered"),
    )


@query("SELECT p_partkey, lower(hex(encode(p_name))) AS as_hex, to_base64(encode(p_name)) AS as_b64, p_name AS from_hex, p_name AS from_b64, p_name AS from_octal, p_name AS from_binary FROM part")
def text_encodings(spark, d):
    t = table(spark, d, "part")
    hexed, b64 = X.str_to_hex("p_name"), X.str_to_b64("p_name")
    return t.select("p_partkey", hexed.alias("as_hex"), b64.alias("as_b64"), X.str_from_hex(hexed).alias("from_hex"), X.str_from_b64(b64).alias("from_b64"), X.str_from_octal(X.str_to_octal("p_name")).alias("from_octal"), X.str_from_binary(X.str_to_binary("p_name")).alias("from_binary"))


@query("SELECT o_orderkey, lower(to_base(o_orderkey, 16)) AS hexa, '-' || to_base(o_orderkey, 2) AS bina, o_orderkey::DOUBLE AS back, -o_orderkey::DOUBLE AS back2 FROM orders WHERE o_orderkey > 0")
def text_bases(spark, d):
    t = table(spark, d, "orders").where("o_orderkey > 0")
    h, b = X.to_base("o_orderkey", 16), X.to_base(-F.col("o_orderkey"), 2)
    return t.select("o_orderkey", h.alias("hexa"), b.alias("bina"), X.from_base(h, 16).alias("back"), X.from_base(b, 2).alias("back2"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice AS parsed, l_quantity::BIGINT AS whole FROM lineitem")
def text_numbers(spark, d):
    t = table(spark, d, "lineitem")
    return t.select("l_orderkey", "l_linenumber", X.parse_number(F.concat(F.lit(" "), F.col("l_extendedprice").cast("decimal(20,4)").cast("string"), F.lit(" "))).alias("parsed"), X.parse_integer(F.col("l_quantity").cast("long").cast("string")).alias("whole"))


@query("SELECT n_nationkey, 'nation ' || n_name || ' #' || n_nationkey || ' ' || printf('%.3f', n_nationkey / 8.0) AS line FROM nation")
def text_interpolation(spark, d):
    t = table(spark, d, "nation")
    return t.select("n_nationkey", X.interpolate("nation {name} #{key} {part:.3f}", name="n_name", key="n_nationkey", part=F.col("n_nationkey") / 8.0).alias("line"))


_MATH = {
    "root": (lambda c: M.sqrt(c("l_quantity")), "sqrt(l_quantity)"),
    "e": (lambda c: M.exp(c("l_discount")), "exp(l_discount)"),
    "log_e": (lambda c: M.ln(c("l_quantity")), "ln(l_quantity)"),
    "log_10": (lambda c: M.log10(c("l_quantity")), "log10(l_quantity)"),
    "down": (lambda c: M.floor(c("l_extendedprice")), "floor(l_extendedprice)"),
    "up": (lambda c: M.ceil(c("l_extendedprice")), "ceil(l_extendedprice)"),
    "near": (lambda c: M.round_half_away(c("l_extendedprice")), "round(l_extendedprice)"),
    "sr": (lambda c: M.sinr(c("l_quantity")), "sin(l_quantity)"),
    "cr": (lambda c: M.cosr(c("l_quantity")), "cos(l_quantity)"),
    "tr": (lambda c: M.tanr(c("l_discount")), "tan(l_discount)"),
    "sd": (lambda c: M.sind(c("l_quantity")), "sin(radians(l_quantity))"),
    "cd": (lambda c: M.cosd(c("l_quantity")), "cos(radians(l_quantity))"),
    "td": (lambda c: M.tand(c("l_quantity")), "tan(radians(l_quantity))"),
    "asr": (lambda c: M.asinr(c("l_discount")), "asin(l_discount)"),
    "acd": (lambda c: M.acosd(c("l_discount")), "degrees(acos(l_discount))"),
    "atr": (lambda c: M.atanr(c("l_quantity")), "atan(l_quantity)"),
    "at2": (lambda c: M.atan2d(c("l_tax"), c("l_quantity")), "degrees(atan2(l_tax, l_quantity))"),
    "hyp": (lambda c: M.hypot(c("l_tax"), c("l_quantity")), "sqrt(l_tax * l_tax + l_quantity * l_quantity)"),
    "rad": (lambda c: M.deg2rad(c("l_quantity")), "radians(l_quantity)"),
    "deg": (lambda c: M.rad2deg(c("l_discount")), "degrees(l_discount)"),
}


@query("SELECT l_orderkey, l_linenumber, " + ", ".join(f"round({s}, 9) AS {n}" for n, (_, s) in _MATH.items()) + " FROM lineitem")
def math_functions(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[r(f(F.col), 9).alias(n) for n, (f, _) in _MATH.items()])


@query("SELECT count(*) FILTER (abs(l_discount - l_tax) <= greatest(0.005, 0.1 * greatest(abs(l_discount), abs(l_tax)))) AS close, count(*) FILTER (l_discount = l_tax) AS same_bits, sum(least(l_discount, l_tax, 0.03)) > 0 AS low, count(*) FILTER (greatest(l_discount, l_tax) > 0.05) AS high FROM lineitem")
def numeric_comparison(spark, d):
    t = table(spark, d, "lineitem").select("l_discount", "l_tax", M.same_bits("l_discount", "l_tax").alias("bits"))
    return t.agg(F.count_if(M.is_close("l_discount", "l_tax", 0.005, 0.1)).alias("close"), F.count_if("bits").alias("same_bits"), (F.sum(M.minimum("l_discount", "l_tax", F.lit(0.03))) > 0).alias("low"), F.count_if(M.maximum("l_discount", "l_tax") > 0.05).alias("high"))


_EMB = "SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, list_transform(list_reverse(embedding), lambda x: x::DOUBLE) AS f FROM embeddings"


@query(f"SELECT vec_id, round(list_dot_product(e, f), 6) AS dot, round(sqrt(list_dot_product(e, e)), 6) AS norm, round(e[1] / sqrt(list_dot_product(e, e)), 6) AS unit_first, round(e[2] * f[3] - e[3] * f[2], 6) AS cross_first, round(list_sum(e), 6) AS total, len(e) AS n, round(list_sort(e)[1], 9) AS least, round(e[5], 9) AS fifth FROM ({_EMB})")
def vector_functions(spark, d):
    t = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e")).withColumn("f", F.reverse("e"))
    x = A.cross(A.slice_of("e", 0, 3), A.slice_of("f", 0, 3))
    return t.select("vec_id", r(A.dot("e", "f")).alias("dot"), r(A.vector_norm("e")).alias("norm"), r(F.element_at(A.vector_unit("e"), 1)).alias("unit_first"), r(F.element_at(x, 1)).alias("cross_first"), r(A.total("e")).alias("total"), F.size("e").cast("long").alias("n"), r(F.element_at(A.sort("e"), 1), 9).alias("least"), r(A.index("e", F.lit(4)), 9).alias("fifth"))


@query(f"SELECT vec_id, round(list_sum(list_transform(list_zip(e, f), lambda z: z[1] * z[2] + 1)), 6) AS a, round(list_sum(list_transform(e, lambda x: abs(x))), 6) AS b, round(list_sum(list_transform(e, lambda x: x * 2)), 6) AS c FROM ({_EMB})")
def elementwise_functions(spark, d):
    t = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e")).withColumn("f", F.reverse("e"))
    return t.select("vec_id", r(A.total(A.elementwise(lambda x, y: x * y + 1, "e", "f"))).alias("a"), r(A.total(A.elementwise(F.abs, "e"))).alias("b"), r(A.total(A.elementwise(lambda x, y: x * y, "e", 2.0))).alias("c"))


@query(
    "WITH m AS (SELECT vec_id AS rw, generate_subscripts(embedding, 1) - 1 AS cl, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT a.cl::INT AS \"row\", b.cl::INT AS \"col\", round(sum(a.v * b.v), 4) AS \"value\" FROM m a JOIN m b ON a.rw = b.rw GROUP BY 1, 2"
)
def matrix_gram(spark, d):
    m = matrix.from_vectors(table(spark, d, "embeddings"), "vec_id", F.col("embedding").cast("array<double>"))
    return matrix.multiply(matrix.transpose(m), m).withColumn("value", r("value", 4))


@query("SELECT o_orderkey, (o_totalprice * 149597870700.0::DOUBLE) AS metres, (o_totalprice / 149597870700.0::DOUBLE * 1e9) AS au9, (o_totalprice / 9460730472580800.0::DOUBLE * 1e15) AS ly15, (o_totalprice / (149597870700.0::DOUBLE * 648000.0::DOUBLE / pi()) * 1e15) AS pc15, (o_totalprice / 1000.0) AS km FROM orders")
def unit_convert(spark, d):
    t = table(spark, d, "orders")
    x = F.col("o_totalprice")
    return t.select("o_orderkey", A.au2m(x).alias("metres"), (A.m2au(x) * 1e9).alias("au9"), (A.m2ly(x) * 1e15).alias("ly15"), (A.m2pc(x) * 1e15).alias("pc15"), quantity(x, "m").to("km").alias("km"))


@query(
    "SELECT l_orderkey, l_linenumber, round(l_quantity * cos(l_tax), 8) AS px, round(l_quantity * sin(radians(l_discount)), 8) AS pyd, round(l_quantity * sin(l_tax) * cos(l_discount), 8) AS sx, round(atan2(l_tax + 1, l_quantity), 8) AS az, round(l_extendedprice / l_quantity, 8) AS v, round(l_quantity * l_quantity / (l_tax + 1), 8) AS ca, round((l_quantity + l_tax) / (1 + l_quantity / 299792458.0 * (l_tax / 299792458.0)), 8) AS rel FROM lineitem"
)
def vector_mechanics(spark, d):
    t = table(spark, d, "lineitem")
    q, tax, disc = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")
    return t.select(
        "l_orderkey", "l_linenumber", r(F.element_at(A.polar2cartesianr(q, tax), 1), 8).alias("px"), r(F.element_at(A.polar2cartesiand(q, disc), 2), 8).alias("pyd"),
        r(F.element_at(A.spherical2cartesianr(q, tax, disc), 1), 8).alias("sx"), r(A.cartesian_azimuthr(F.array(q, tax + 1.0)), 8).alias("az"), r(A.velocity("l_extendedprice", q), 8).alias("v"),
        r(A.centripetal_acceleration(q, tax + 1.0), 8).alias("ca"), r(A.velocity_add_relativistic_collinear(q, tax), 8).alias("rel"),
    )


@query(
    "SELECT l_orderkey, l_linenumber, round(l_quantity * l_tax, 8) AS volts, round(l_extendedprice / l_quantity, 8) AS amps, round(l_quantity * l_quantity * l_tax, 8) AS i2r, round(0.5 * l_tax * l_quantity * l_quantity, 8) AS cap, round(1 / (1 / l_quantity + 1 / (l_quantity + 1)), 8) AS par, round(l_quantity + l_tax, 8) AS ser, round(l_quantity * 1000, 6) AS milli FROM lineitem"
)
def electrical(spark, d):
    t = table(spark, d, "lineitem")
    q, tax, p = F.col("l_quantity"), F.col("l_tax"), F.col("l_extendedprice")
    amp, ohm, volt, farad = quantity(q, "A"), quantity(tax, "ohm"), quantity(q, "V"), quantity(tax, "F")
    rs = lambda *xs: U.Quantity(F.array(*xs), U.RESISTANCE)
    return t.select(
        "l_orderkey", "l_linenumber", r(D.ee_voltage(amp, ohm).column, 8).alias("volts"), r(D.ee_current(quantity(p, "V"), quantity(q, "ohm")).column, 8).alias("amps"),
        r(D.ee_power_i2r(amp, ohm).column, 8).alias("i2r"), r(D.ee_capacitor_energy(farad, volt).column, 8).alias("cap"), r(D.ee_parallel_resistance(rs(q, q + 1.0)).column, 8).alias("par"),
        r(D.ee_series_resistance(rs(q, tax)).column, 8).alias("ser"), r(D.ee_in_unit(amp, "mA"), 6).alias("milli"),
    )


@query(
    "SELECT l_orderkey, l_linenumber, (l_extendedprice / l_quantity) AS rho, ((l_extendedprice / l_quantity) * l_tax * l_quantity / 0.001) AS re, (0.5 * (l_extendedprice / l_quantity) * l_tax * l_tax) AS pd, (1000.0 + 0.5 * (l_extendedprice / l_quantity) * l_tax * l_tax) AS total, (8 * 10.0 * l_quantity * 0.0001 / (pi() * power(0.5, 4))) AS pipe FROM lineitem"
)
def fluids(spark, d):
    t = table(spark, d, "lineitem")
    q = F.col("l_quantity")
    rho = D.fluid_density(quantity("l_extendedprice", "kg"), U.Quantity(q, U.VOLUME))
    v, mu = U.Quantity(F.col("l_tax"), U.SPEED), U.Quantity(F.lit(0.001), U.DYNAMIC_VISCOSITY)
    drop = D.fluid_pipe_pressure_drop(U.Quantity(F.lit(1.0), U.DENSITY), U.Quantity(F.lit(10.0), U.DYNAMIC_VISCOSITY), quantity(q, "m"), quantity(0.5, "m"), U.Quantity(F.lit(0.0001), U.FLOW))
    return t.select("l_orderkey", "l_linenumber", rho.column.alias("rho"), D.fluid_reynolds(rho, v, quantity(q, "m"), mu).column.alias("re"), D.fluid_dynamic_pressure(rho, v).column.alias("pd"), (D.fluid_bernoulli_total_pressure(quantity(1000.0, "Pa"), rho, v).column).alias("total"), drop.column.alias("pipe"))


@query("SELECT * FROM (VALUES ('H2O', 18.015), ('C6H12O6', 180.156), ('Ca(OH)2', 74.092), ('NaCl', 58.44)) t(formula, grams)")
def chem_molar_mass(spark, d):
    t = spark.createDataFrame([("H2O",), ("C6H12O6",), ("Ca(OH)2",), ("NaCl",)], "formula string")
    return t.select("formula", r(D.chem_molar_mass("formula").column * 1000, 3).cast("decimal(6,3)").alias("grams"))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity / 1000 / 0.018015, 8) AS moles, round(l_tax * 2 / (l_quantity + 2), 8) AS diluted FROM lineitem")
def chem_amounts(spark, d):
    t = table(spark, d, "lineitem")
    q = F.col("l_quantity")
    moles = D.chem_moles(quantity(q, "g"), U.Quantity(F.lit(0.018015), U.MOLAR_MASS))
    diluted = D.chem_dilution(U.Quantity(F.col("l_tax"), U.CONCENTRATION), U.Quantity(F.lit(2.0), U.VOLUME), U.Quantity(q + 2.0, U.VOLUME))
    return t.select("l_orderkey", "l_linenumber", r(moles.column, 8).alias("moles"), r(diluted.column, 8).alias("diluted"))


@query("SELECT round(regr_slope(l_extendedprice / 1000, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice / 1000, l_quantity), 3) AS intercept FROM lineitem")
def linear_fit(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    fit = matrix.fit_line(t, "x", "y", 100_000, 0.002)
    return spark.createDataFrame([(round(fit["slope"], 3), round(fit["intercept"], 3))], "slope double, intercept double")


@query(
    "SELECT coalesce(a.doc_id, b.doc_id) AS \"key\", CASE WHEN b.doc_id IS NULL THEN 'MISSING' WHEN a.doc_id IS NULL THEN 'ADDED' WHEN b.h IS NULL THEN 'UNREADABLE' WHEN a.h = b.h THEN 'MATCH' ELSE 'CONTENT_CHANGED' END AS status FROM (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 7 <> 0) a FULL OUTER JOIN (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS h FROM documents WHERE doc_id % 13 <> 0) b ON a.doc_id = b.doc_id"
)
def baseline_compare(spark, d):
    t = table(spark, d, "documents")
    before = t.where("doc_id % 7 <> 0").select("doc_id", F.sha2("text", 256).alias("h"))
    now = F.when(F.col("doc_id") % 11 == 0, F.lit(None)).when(F.col("doc_id") % 5 == 0, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.sha2("text", 256))
    return compare.baseline_compare(before, t.where("doc_id % 13 <> 0").select("doc_id", now.alias("h")), "doc_id", "h")


@query(
    "WITH t AS (SELECT user_id, event_id, event_id % 17 AS h, lag(event_id % 17) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events), c AS (SELECT *, CASE WHEN event_id % 50 = 0 THEN -1 ELSE p END AS prev FROM t) SELECT user_id AS \"group\", count(*) AS entries, sum(CASE WHEN prev IS NOT DISTINCT FROM p THEN 0 ELSE 1 END)::BIGINT AS broken FROM c GROUP BY 1"
)
def ledger_chain_check(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    t = table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 17).alias("h"))
    t = t.withColumn("prev", F.when(F.col("event_id") % 50 == 0, F.lit(-1)).otherwise(F.lag("h").over(w)))
    return compare.chain_check(t, "event_id", "h", "prev", "user_id")


@query("SELECT i AS pos, c.c_custkey, c.c_acctbal FROM customer c JOIN (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS i, c_custkey FROM customer) USING (c_custkey)")
def row_ordinals(spark, d):
    rows = stats.with_ordinal(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey")
    return rows.select(F.col("_ord").cast("long").alias("pos"), "c_custkey", "c_acctbal")


_CUBE = "WITH w AS (SELECT ceil(sqrt(max(vec_id) + 1))::BIGINT AS w FROM embeddings), c AS (SELECT generate_subscripts(embedding, 1) - 1 AS channel, unnest(embedding)::DOUBLE AS v, w, sqrt(pow(vec_id % w - (w - 1) / 2.0, 2) + pow(vec_id // w - (w - 1) / 2.0, 2)) AS d FROM embeddings, w), "


@query(
    _CUBE + "f AS (SELECT channel, count(*) FILTER (d < w / 4.0) AS pixels, median(v) FILTER (d >= 3 * w / 8.0 AND d < 7 * w / 12.0) AS b, sum(v) FILTER (d < w / 4.0) AS s FROM c GROUP BY 1) SELECT channel::INT AS channel, pixels, round(b, 9) AS background, round(s - pixels * b, 6) AS flux FROM f"
)
def cube_aperture(spark, d):
    """All vectors as a square field of spectra, its aperture and ring in the proportions of its width."""
    t = table(spark, d, "embeddings")
    w = math.ceil(math.sqrt(t.agg(F.max("vec_id")).first()[0] + 1))
    rows = t.select(F.posexplode(F.col("embedding").cast("array<double>")).alias("channel", "value"), (F.col("vec_id") % w).alias("x"), F.expr(f"vec_id div {w}").alias("y"))
    return cube.aperture_flux(rows, (w - 1) / 2, (w - 1) / 2, w / 4, 3 * w / 8, 7 * w / 12).withColumns({"background": r("background", 9), "flux": r("flux")})


@query()
def rng_uniform(spark, d):
    return random.uniform_frame(spark, 42, 54, 100_000)


@query()
def resample(spark, d):
    return random.resample(table(spark, d, "customer"), "c_acctbal", "c_custkey", 10_000, 42, 1)


@query()
def bootstrap_mean(spark, d):
    return random.bootstrap(table(spark, d, "supplier"), "s_acctbal", "s_suppkey", 100, "mean", 42, 2)


@query()
def bootstrap_median(spark, d):
    return random.bootstrap(table(spark, d, "supplier"), "s_acctbal", "s_suppkey", 100, "median", 42, 3)


@query()
def rng_normal_array(spark, d):
    z = random.Stream(42, 4).normals(1000)
    return spark.createDataFrame(list(enumerate(z)), "i long, z double")


@query()
def mvnormal(spark, d):
    cov = stats.covariance(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], 1).orderBy("i", "j").collect()
    draw = matrix.mvnormal([0.0, 0.0], [x["covariance"] for x in cov], 2, 1e-9, random.Stream(42, 5))
    return spark.createDataFrame([tuple(draw)], "quantity double, price double")
