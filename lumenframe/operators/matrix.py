"""Matrices: as (row, col, value) tables for size, as small dense arrays on the driver for factors."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ArrayRefusal, NumericRefusal
from ..functions.arrays import total
from .random import Stream
from .stats import neumaier

MAX_DIMENSION = 128


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of two (row, col, value) tables; cells without a common index are left out."""
    left = a.select("row", F.col("col").alias("k"), F.col("value").alias("x"))
    right = b.select(F.col("row").alias("k"), "col", F.col("value").alias("y"))
    return left.join(right, "k").groupBy("row", "col").agg(F.sum(F.col("x") * F.col("y")).alias("value"))


def multiply_compensated(a: DataFrame, b: DataFrame) -> DataFrame:
    """multiply() with each cell's products added in the order of the common index, compensated; a cell's products are held in one task."""
    left = a.select("row", F.col("col").alias("k"), F.col("value").alias("x"))
    right = b.select(F.col("row").alias("k"), "col", F.col("value").alias("y"))
    cells = left.join(right, "k").groupBy("row", "col").agg(F.sort_array(F.collect_list(F.struct("k", (F.col("x") * F.col("y")).alias("xy")))).alias("p"))
    return cells.select("row", "col", total(F.col("p.xy")).alias("value"))


def from_vectors(df: DataFrame, row: str, vector: str) -> DataFrame:
    return df.select(F.col(row).alias("row"), F.posexplode(vector).alias("col", "value"))


def _square(values: list[float], n: int) -> list[float]:
    if not 1 <= n <= MAX_DIMENSION or len(values) != n * n:
        raise ArrayRefusal(f"a matrix of {n} x {n} needs as many entries, and {MAX_DIMENSION} rows at most")
    return [float(v) for v in values]


def cholesky(values: list[float], n: int, tolerance: float) -> list[float]:
    """Lower factor, row by row; refuses asymmetry beyond the tolerance and pivots at rounding size."""
    a = np.array(_square(values, n)).reshape(n, n)
    size = np.maximum(abs(a), abs(a.T))
    with np.errstate(invalid="ignore", divide="ignore"):
        if np.nanmax(np.where(size > 0, abs(a / size - a.T / size), 0.0)) > tolerance:
            raise NumericRefusal("the matrix is not symmetric within the tolerance")
    scale = float(abs(a).max())
    if scale == 0:
        raise NumericRefusal("the matrix is zero")
    a, low = a / scale, np.zeros((n, n))
    for j in range(n):
        for i in range(j, n):
            known = sum(neumaier(low[i, :j] * low[j, :j]))
            rest = a[i, j] - known
            if i > j:
                low[i, j] = rest / low[j, j]
            elif rest <= 16 * np.finfo(float).eps * n * max(abs(a[j, j]), abs(known)):
                raise NumericRefusal(f"the matrix is not positive definite at pivot {j}")
            else:
                low[j, j] = math.sqrt(rest)
    return (low * math.sqrt(scale)).ravel().tolist()


def mvnormal(mean: list[float], covariance: list[float], n: int, tolerance: float, stream: Stream) -> list[float]:
    """One multivariate normal draw; nothing is drawn unless every input is valid."""
    low = np.array(cholesky(covariance, n, tolerance)).reshape(n, n)
    if len(mean) != n:
        raise ArrayRefusal("the mean has another size than the matrix")
    z = np.array(stream.normals(n))
    return [mean[i] + sum(neumaier(low[i, : i + 1] * z[: i + 1])) for i in range(n)]


def fit_line(df: DataFrame, x: str, y: str, steps: int, rate: float) -> dict[str, float]:
    """Slope and intercept by full-batch gradient descent on the mean squared error.

    The gradient of a line depends on the rows only through five sums, so the
    rows are read once, whatever the number of steps.
    """
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    m = df.agg(F.count("*").alias("n"), F.count_if(a.isNull() | b.isNull()).alias("bad"), F.avg(a).alias("x"), F.avg(b).alias("y"), F.avg(a * a).alias("xx"), F.avg(a * b).alias("xy"), F.avg(b * b).alias("yy")).first()
    if not m["n"] or m["bad"]:
        raise NumericRefusal("training needs rows, and both values in each")
    slope = intercept = 0.0

    def loss() -> float:
        return slope * slope * m["xx"] + 2 * slope * intercept * m["x"] + intercept * intercept - 2 * slope * m["xy"] - 2 * intercept * m["y"] + m["yy"]

    first = loss()
    for _ in range(steps):
        gi = slope * m["x"] + intercept - m["y"]
        gs = slope * m["xx"] + intercept * m["x"] - m["xy"]
        intercept, slope = intercept - rate * gi, slope - rate * gs
        if not math.isfinite(intercept + slope):
            raise NumericRefusal("training diverges; scale the data or lower the rate")
    return {"slope": slope, "intercept": intercept, "initial_mse": first, "final_mse": loss(), "rows": m["n"]}
