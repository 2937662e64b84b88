"""Comparison of two inventories, and the check of a hash chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def baseline_compare(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, status) of each entry: MATCH, CONTENT_CHANGED, MISSING, ADDED, UNREADABLE.

    An entry whose digest is NULL after the fact could not be read.
    """
    a = before.select(F.col(key).alias("key"), F.col(digest).alias("was"), F.lit(True).alias("in_a"))
    b = after.select(F.col(key).alias("key"), F.col(digest).alias("now"), F.lit(True).alias("in_b"))
    status = (
        F.when(F.col("in_b").isNull(), "MISSING")
        .when(F.col("in_a").isNull(), "ADDED")
        .when(F.col("now").isNull(), "UNREADABLE")
        .when(F.col("was").eqNullSafe(F.col("now")), "MATCH")
        .otherwise("CONTENT_CHANGED")
    )
    return a.join(b, "key", "full_outer").select("key", status.alias("status"))


def chain_check(df: DataFrame, order: str, digest: str, previous: str, group: str) -> DataFrame:
    """(group, entries, broken): rows whose previous digest is not that of the row before, by group."""
    w = Window.partitionBy(group).orderBy(order)
    rows = df.select(F.col(group).alias("group"), (~F.col(previous).eqNullSafe(F.lag(digest).over(w))).cast("long").alias("bad"))
    return rows.groupBy("group").agg(F.count("*").alias("entries"), F.sum("bad").alias("broken"))
