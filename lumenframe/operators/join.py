"""One-to-one join on exact text keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DataRefusal

MISSING = "\\N"


def _check_keys(df: DataFrame, key: str, side: str) -> None:
    """Refuse a missing or repeated key, in one aggregate by key."""
    k = F.col(key).cast("string")
    groups = df.groupBy(k.alias("k")).agg(F.count("*").alias("n"))
    bad = groups.agg(F.count_if(F.col("k").isNull() | F.col("k").isin("", MISSING)).alias("missing"), F.count_if(F.col("n") > 1).alias("repeated")).first()
    if bad["missing"]:
        raise DataRefusal(f"the {side} table has a missing key")
    if bad["repeated"]:
        raise DataRefusal(f"the {side} table has {bad['repeated']} repeated keys")


def join_one_to_one(left: DataFrame, right: DataFrame, left_key: str, right_key: str, kind: str, left_prefix: str, right_prefix: str) -> DataFrame:
    """All columns of both sides with their prefixes, and __join_matched first.

    kind is inner or left. Keys are compared as exact text; a repeated or
    missing key on either side is refused even if it would not match. Spark
    picks the physical join from the sides' sizes; no side is forced to be
    broadcast.
    """
    if kind not in ("inner", "left"):
        raise DataRefusal("a join is inner or left")
    for side, df, key in (("left", left, left_key), ("right", right, right_key)):
        if key not in df.columns:
            raise DataRefusal(f"the {side} table has no column {key}")
        _check_keys(df, key, side)
    a = left.select(*[F.col(f"`{c}`").alias(left_prefix + c) for c in left.columns], F.col(left_key).cast("string").alias("__left_key"))
    b = right.select(*[F.col(f"`{c}`").alias(right_prefix + c) for c in right.columns], F.col(right_key).cast("string").alias("__right_key"))
    clash = set(a.columns) & set(b.columns)
    if clash:
        raise DataRefusal(f"both sides would name a column {sorted(clash)[0]}")
    out = a.join(b, a["__left_key"] == b["__right_key"], kind)
    return out.select(F.col("__right_key").isNotNull().alias("__join_matched"), *[c for c in a.columns + b.columns if not c.startswith("__")])
