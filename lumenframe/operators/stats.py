"""Column reductions that refuse empty input, and compensated sums.

``exact=True`` folds one group's values in row order with Neumaier's
compensation. The default adds per-partition compensated sums, which differs
from it in the last bits at most and scales with the partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DataRefusal, NumericRefusal
from ..functions.arrays import total
from ..session import saved


#: Values of a bin that are told apart one by one, and bins into which a larger one is cut.
BINS = 1 << 16
#: Open bins that are sent to every task, some 4 MB.
SENT_BINS = 1 << 16


def neumaier(values: np.ndarray, s: float = 0.0, c: float = 0.0) -> tuple[float, float]:
    for x in values.tolist():
        t = s + x
        c += (s - t) + x if abs(s) >= abs(x) else (x - t) + s
        s = t
    return s, c


def two_sum(values: np.ndarray) -> tuple[float, float]:
    """Pairwise error-free sum of an array: (sum, error), vectorised."""
    error = 0.0
    while len(values) > 1:
        if len(values) % 2:
            values = np.append(values, 0.0)
        a, b = values[::2], values[1::2]
        s = a + b
        z = s - a
        error += float(((a - (s - z)) + (b - z)).sum())
        values = s
    return (float(values[0]) if len(values) else 0.0), error


def compensated_sum(df: DataFrame, column: str, order: str | None = None, exact: bool = False) -> float:
    """Sum of a column without NULLs; refuses an empty input, a NULL and an overflow."""
    x = F.col(column).cast("double")
    if exact:
        if order is None:
            raise DataRefusal("an exact sum needs an order column")
        return _ordered_sum(df.select(F.col(order).alias("o"), x.alias("x")))

    rows = _partial_sums(df.select(x.alias("x"))).groupBy().agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sort_array(F.collect_list(F.struct("s", "c"))).alias("p")).first()
    _counted(rows["n"] or 0, rows["k"] or 0)
    s, c = neumaier(np.array([x for p in rows["p"] for x in (p["s"], p["c"])]))
    if not np.isfinite(s + c):
        raise NumericRefusal("the sum overflows")
    return s + c


def _partial_sums(df: DataFrame) -> DataFrame:
    """(n, k, s, c, lo, hi) of the one column of each partition: rows, values, their sum and what it lost, least and greatest value."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = k = 0
        parts: list[float] = []
        ends: list[float] = []
        for batch in batches:
            v = batch.column(0)
            n, k = n + len(v), k + len(v) - v.null_count
            v = v.drop_null().to_numpy(zero_copy_only=False)
            parts += two_sum(v)
            ends += [float(v.min()), float(v.max())] if len(v) else []
        s, c = neumaier(np.array(parts))
        lo, hi = (min(ends), max(ends)) if ends else (None, None)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([k]), pa.array([s]), pa.array([c]), pa.array([lo], pa.float64()), pa.array([hi], pa.float64())], ["n", "k", "s", "c", "lo", "hi"])

    return df.mapInArrow(part, "n long, k long, s double, c double, lo double, hi double")


def _compensated(df: DataFrame, column: str) -> DataFrame:
    """One row (n, k, sum, min, max); the partitions' sums, a few numbers each, are added with compensation."""
    parts = _partial_sums(df.select(F.col(column).cast("double").alias("x")))
    row = parts.groupBy().agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k"), F.sort_array(F.collect_list(F.array("s", "c"))).alias("p"), F.min("lo").alias("min"), F.max("hi").alias("max"))
    return row.select("n", "k", total(F.flatten("p")).alias("sum"), "min", "max")


def _ordered_sum(df: DataFrame) -> float:
    """Compensated sum of x in the order of o: the fold goes on from one range of rows to the next, each in bounded memory."""
    counts = df.agg(F.count("*").alias("n"), F.count("x").alias("k")).first()
    _counted(counts["n"], counts["k"])
    s = c = 0.0
    chunk: list[float] = []
    # one range at a time comes to the driver, which holds no more than that
    for row in df.repartitionByRange("o").sortWithinPartitions("o").select("x").toLocalIterator(prefetchPartitions=True):
        chunk.append(row["x"])
        if len(chunk) == 1 << 16:
            s, c = neumaier(np.array(chunk), s, c)
            chunk.clear()
    s, c = neumaier(np.array(chunk), s, c)
    if not np.isfinite(s + c):
        raise NumericRefusal("the sum overflows")
    return s + c


def _counted(n: int, k: int) -> None:
    if not n:
        raise DataRefusal("the input has no rows")
    if k < n:
        raise DataRefusal(f"{n - k} rows have no value")


def scan_stats(df: DataFrame, column: str) -> DataFrame:
    """One row (count, sum, mean, min, max); NULLs and an empty input are refused; the sum is compensated."""
    ok = (F.col("n") > 0) & (F.col("n") == F.col("k"))
    checked = F.when(~ok, F.raise_error(F.lit("G601: the column is empty or has rows without a value"))).otherwise(F.col("sum"))
    return _compensated(df, column).select(F.col("k").alias("count"), checked.alias("sum"), (F.col("sum") / F.nullif(F.col("k"), F.lit(0))).alias("mean"), "min", "max")


def column_stats(df: DataFrame, column: str) -> DataFrame:
    """One row (valid_count, mean, min, max) over the values that are not NULL; none is refused; the sum is compensated."""
    mean = F.when(F.col("k") == 0, F.raise_error(F.lit("G601: no valid value"))).otherwise(F.col("sum") / F.nullif(F.col("k"), F.lit(0)))
    return _compensated(df, column).select(F.col("k").alias("valid_count"), mean.alias("mean"), "min", "max")


def _nonempty(value: Column, x: Column, least: int = 1) -> Column:
    return F.when(F.count(x) < least, F.raise_error(F.lit(f"G601: fewer than {least} values"))).otherwise(value)


def _whole(value: Column, x: Column, least: int = 1) -> Column:
    """As _nonempty, and a row without a value is refused."""
    return F.when(F.count(x) < F.count(F.lit(1)), F.raise_error(F.lit("G601: rows without a value"))).otherwise(_nonempty(value, x, least))


def scaled_mean(x) -> Column:
    """Mean scaled by the largest magnitude, so that it does not overflow where the values do not."""
    x = (F.col(x) if isinstance(x, str) else x).cast("double")
    top = F.max(F.abs(x))
    # values are halved 11 times, more than enough for any count a cluster holds
    scale = F.lit(2.0**-64)
    return _nonempty(F.when(top < 1e280, F.avg(x)).otherwise(F.avg(x * scale) / scale), x)


def quantile(x, p: float) -> Column:
    """Exact type-7 quantile; one task holds the distinct values of a group, see quantiles for more of them."""
    if not 0 <= p <= 1:
        raise NumericRefusal("a quantile lies between 0 and 1")
    x = F.col(x) if isinstance(x, str) else x
    return _nonempty(F.percentile(x, F.lit(float(p))), x)


def median(x) -> Column:
    return quantile(x, 0.5)


def _sixteenth(x: Column) -> Column:
    """A number that does not fall where x grows: sixteen a power of two, none shared by both signs."""
    size = F.floor(F.log2(F.abs(x)) * 16).cast("double") + 32768.0
    return F.when(F.isnan(x), 1e6).when(F.abs(x) == float("inf"), F.signum(x) * 1e5).when(x == 0, 0.0).otherwise(F.signum(x) * size)


def quantiles(df: DataFrame, column: str, points: dict[str, float], *by: str) -> DataFrame:
    """(by, one column a point): exact type-7 quantiles of the values that are not NULL, as quantile() gives them, for any number of values.

    No task holds a group. Its values are counted by bins, then those of the bins
    with a wanted place by finer bins, until each such bin is one value. The rows
    are read once a round (about three), so a costly df is better saved first.
    """
    if not all(0 <= p <= 1 for p in points.values()):
        raise NumericRefusal("a quantile lies between 0 and 1")
    keys = [f"_by{i}" for i in range(len(by))] or ["_all"]
    x = F.col(column).cast("double") + 0.0  # one zero
    rows = df.select(*([F.col(c).alias(k) for c, k in zip(by, keys, strict=True)] if by else [F.lit(0).alias("_all")]), x.alias("_x"))
    place = {name: F.lit(float(p)) * (F.col("_total") - 1) for name, p in points.items()}
    holds = lambda at: (F.col("_before") <= at) & (at < F.col("_before") + F.col("_n"))
    counts = [F.count("_x").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")]
    wanted = F.col("_total") == 0
    for at in place.values():
        wanted = wanted | holds(F.floor(at)) | holds(F.ceil(at))

    def placed(bins: DataFrame, inside: list[str], start: Column) -> DataFrame:
        """Bins with the number of values before them, those with a wanted place only; a window holds BINS bins at most, or those of all sixteenths."""
        before = F.coalesce(F.sum("_n").over(Window.partitionBy(*inside).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return saved(bins.withColumn("_before", start + before).where(wanted).select(*keys, "_total", "_before", "_n", "_lo", "_hi"), "bins")

    first = rows.groupBy(*keys, _sixteenth(F.col("_x")).alias("_bin")).agg(*counts)
    found = placed(first.withColumn("_total", F.sum("_n").over(Window.partitionBy(*keys))), keys, F.lit(0))
    done = []
    while True:
        single = F.col("_lo").eqNullSafe(F.col("_hi"))
        done.append(found.where(single))
        left = found.where(~single).select(*[F.col(k).alias(f"{k}_") for k in keys], "_total", F.col("_before").alias("_start"), F.col("_n").alias("_size"), F.col("_lo").alias("_least"), F.col("_hi").alias("_most"))
        n = left.count()
        if not n:
            break
        inside = (F.col("_x") >= F.col("_least")) & (F.col("_x") <= F.col("_most"))
        for k in keys:
            inside = inside & F.col(k).eqNullSafe(F.col(f"{k}_"))
        cut = F.floor((F.col("_x") - F.col("_least")) / (F.col("_most") - F.col("_least")) * (BINS - 1)).cast("double")
        finer = rows.join(F.broadcast(left) if n <= SENT_BINS else left, inside).groupBy(*keys, "_total", "_start", F.when(F.col("_size") <= BINS, F.col("_x")).otherwise(cut).alias("_bin")).agg(*counts)
        found = placed(finer, [*keys, "_start"], F.col("_start"))

    values = done[0]
    for more in done[1:]:
        values = values.unionByName(more)
    values = values.groupBy(*(keys if by else [])).agg(F.coalesce(F.max("_total"), F.lit(0)).alias("_total"), *[F.max(F.when(holds(f(at)), F.col("_lo"))).alias(f"{name}_{side}") for name, at in place.items() for side, f in (("lo", F.floor), ("hi", F.ceil))])
    out = []
    for name, at in place.items():
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        value = F.when(lo == hi, lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi)
        out.append(F.when(F.col("_total") == 0, F.raise_error(F.lit("G601: fewer than 1 values"))).otherwise(value).alias(name))
    return values.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], *out)


def ecdf(x, q: float) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return _nonempty(F.count_if(x <= q) / F.count(x), x)


def std_population(x) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return _whole(F.stddev_pop(x), x)


def std_sample(x) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return _whole(F.stddev_samp(x), x, 2)


def covariance(df: DataFrame, columns: list[str], ddof: int) -> DataFrame:
    """(i, j, covariance) of every pair of columns, one aggregate over the rows."""
    if ddof not in (0, 1):
        raise NumericRefusal("ddof is 0 or 1")
    f = F.covar_pop if ddof == 0 else F.covar_samp
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    both = lambda i, j: F.when(F.col(columns[i]).isNotNull(), F.col(columns[j]))
    row = df.agg(*[_whole(f(F.col(columns[i]).cast("double"), F.col(columns[j]).cast("double")), both(i, j), 1 + ddof).alias(f"c{i}_{j}") for i, j in pairs])
    cells = [F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(f"c{i}_{j}").alias("covariance")) for i, j in pairs for a, b in {(i, j), (j, i)}]
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def histogram(df: DataFrame, column: str, bins: int, constant_middle: bool = False) -> DataFrame:
    """(bin, n) for equal-width bins, left-closed, the last one closed on both sides; empty bins included.

    A constant column is refused, or with constant_middle lands in the middle bin.
    """
    if not 2 <= bins <= 500:
        raise DataRefusal("between 2 and 500 bins")
    x = F.col(column).cast("double")
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    raw = F.floor((x - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins).cast("int")
    one = F.lit(bins // 2) if constant_middle else F.raise_error(F.lit("G202: the bins of a constant column have no width")).cast("int")
    # the ends are one row, so this join moves nothing else
    rows = df.where(x.isNotNull()).join(F.broadcast(ends)).select(F.when(F.col("lo") == F.col("hi"), one).otherwise(F.least(raw, F.lit(bins - 1))).alias("bin"))
    counts = rows.groupBy("bin").agg(F.count("*").alias("n"))
    return df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def with_ordinal(df: DataFrame, *order: str) -> DataFrame:
    """df with _ord, the 0-based place of each row in this order.

    Rows are dealt by range once and written with their place in their range;
    sizes and rows are both read from there. A second evaluation would sample
    other bounds. No task sorts more than its range.
    """
    inside = (1 << 33) - 1
    ranged = saved(df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), "ranges")
    part, place = F.shiftright("_place", 33), F.col("_place").bitwiseAND(inside)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row a partition
    starts = sizes.select("_part", before.alias("_before"))
    return ranged.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("_ord", F.col("_before") + place).drop("_part", "_place", "_before")


def even_rows(df: DataFrame, count: int) -> DataFrame:
    """The rows at i * (rows - 1) // (count - 1), from a frame that has _ord."""
    if count < 2:
        raise DataRefusal("a sample needs two rows at least")
    n = df.agg((F.max("_ord") + 1).alias("rows")).first()["rows"]
    if not n:
        raise DataRefusal("the input has no rows")
    k = min(count, n)
    if k == 1:
        return df.where("_ord = 0")
    wanted = df.sparkSession.range(k).select(F.expr(f"(id * {n - 1}) div {k - 1}").alias("_ord")).distinct()
    return df.join(wanted, "_ord", "left_semi")


def row_slice(df: DataFrame, i: int, j: int) -> DataFrame:
    return df.where((F.col("_ord") >= i) & (F.col("_ord") < j))
