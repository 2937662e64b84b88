"""Predicates whose comparisons with NULL are false, as Columns and as JSON documents."""

from __future__ import annotations

import json
import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DataRefusal, UnknownName
from ..functions.guards import refuse_if

OPERATORS = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
MAX_NODES, MAX_DEPTH = 256, 16


def where(column: str, op: str, value=None) -> str:
    """Leaf predicate as a JSON text; op is a comparison, is_null or is_valid."""
    if op in ("is_null", "is_valid"):
        return json.dumps({"column": column, "op": op})
    if op not in OPERATORS:
        raise UnknownName(f"comparison {op}")
    if not isinstance(value, (int, float, str, bool)):
        raise DataRefusal("a comparison needs a number, text or boolean")
    return json.dumps({"column": column, "op": op, "value": value})


def _group(kind: str, parts: list[str]) -> str:
    if not parts:
        raise DataRefusal("an empty group of predicates")
    tree = {kind: [json.loads(p) for p in parts]}
    _check(tree)
    return json.dumps(tree)


def all_of(parts: list[str]) -> str:
    return _group("all", parts)


def any_of(parts: list[str]) -> str:
    return _group("any", parts)


def _check(tree: dict) -> None:
    def walk(t: dict, depth: int) -> int:
        if depth > MAX_DEPTH:
            raise DataRefusal("predicates nested too deep")
        return 1 + sum(walk(x, depth + 1) for k in ("all", "any") for x in t.get(k, ()))

    if walk(tree, 1) > MAX_NODES:
        raise DataRefusal("too many predicates")


def predicate(document: str) -> Column:
    """The Column of a JSON predicate."""

    def build(t: dict) -> Column:
        for kind, join in (("all", operator.and_), ("any", operator.or_)):
            if kind in t:
                return reduce(join, [build(x) for x in t[kind]])
        c = F.col(t["column"])
        if t["op"] == "is_null":
            return c.isNull()
        if t["op"] == "is_valid":
            return c.isNotNull()
        return F.coalesce(OPERATORS[t["op"]](c, F.lit(t["value"])), F.lit(False))

    return build(json.loads(document))


def select(df: DataFrame, columns: list[str], document: str | None = None) -> DataFrame:
    """Projection of the rows that satisfy the predicate."""
    return (df if document is None else df.filter(predicate(document))).select(*columns)


def select_stats(df: DataFrame, selection: str, lower: float, upper: float, value: str, weight: str | None = None) -> DataFrame:
    """One row (selected, used, weight_sum, mean) over lower <= selection < upper.

    A selected row with a weight that is not positive is refused, as is a
    selection in which no row has both a value and a weight. The checks run
    in the same aggregate as the sums, so they cannot be pruned.
    """
    if not lower < upper:
        raise DataRefusal("a selection needs lower < upper")
    rows = df.filter((F.col(selection) >= lower) & (F.col(selection) < upper))
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    v = F.col(value).cast("double")
    both = w.isNotNull() & v.isNotNull()
    agg = rows.agg(
        F.count("*").alias("selected"),
        F.count_if(both).alias("used"),
        F.sum(F.when(both, w)).alias("weight_sum"),
        F.sum(F.when(both, w * v)).alias("weighted"),
        F.count_if(F.coalesce(w <= 0, F.lit(False))).alias("bad"),
    )
    mean = F.when(F.col("bad") > 0, F.raise_error(F.lit("G601: a selected row has a weight that is not positive"))).when(F.col("used") == 0, F.raise_error(F.lit("G601: no selected row has a value and a weight"))).otherwise(F.col("weighted") / F.col("weight_sum"))
    return agg.select("selected", "used", "weight_sum", mean.alias("mean"))


def require(df: DataFrame, document: str, message: str) -> DataFrame:
    """df, after refusing it if any row fails the predicate."""
    refuse_if(df, ~predicate(document), message)
    return df
