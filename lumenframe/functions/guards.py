"""Guards: refuse a value when it is used, or a whole input before it is used.

A guarded Column raises only if Spark evaluates it, so pruning or a pushed
filter can skip it. Operators that must refuse on what the input holds call
refuse_if, which runs one aggregate first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DataRefusal, Refusal


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def guard(value: Column, ok: Column, message: str) -> Column:
    """value where ok, an error where not; NULL where ok cannot be told, as for a NULL input."""
    return F.when(ok, value).when(ok.isNull(), F.lit(None)).otherwise(F.raise_error(F.lit(message)))


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def finite(value: Column, what: str = "result") -> Column:
    return guard(value, ~F.isnan(value) & (F.abs(value) != float("inf")), f"G202: {what} is not finite")


def refuse_if(df: DataFrame, bad: Column, message: str, kind: type[Refusal] = DataRefusal) -> None:
    """Raise if any row is bad, counting them in one pass."""
    n = df.agg(F.count_if(F.coalesce(bad, F.lit(False)))).first()[0]
    if n:
        raise kind(f"{message} ({n} rows)")


def refuse_empty(df: DataFrame, message: str = "the input has no rows") -> None:
    if df.limit(1).count() == 0:
        raise DataRefusal(message)
