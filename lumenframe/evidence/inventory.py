"""Folder inventories: hash every file on the executors, notice what cannot be read or changes meanwhile, and compare with a baseline."""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 20
SCHEMA = "path string, size long, sha256 string, observation string"


def _names(folder: str) -> tuple[list[tuple[str, str]], list[str]]:
    """((path below folder, what it is), folders that could not be listed)."""
    found: list[tuple[str, str]] = []
    closed: list[str] = []

    def walk(at: str, below: str) -> None:
        try:
            entries = sorted(os.scandir(at), key=lambda e: e.name)
        except OSError:
            closed.append(below)
            return
        for e in entries:
            name = below + e.name
            if e.is_symlink():
                found.append((name, "UNSUPPORTED"))
            elif e.is_dir():
                walk(e.path, name + "/")
            else:
                found.append((name, "FILE" if e.is_file() else "UNSUPPORTED"))

    walk(folder, "")
    return found, closed


def _observe(path: str) -> tuple[int | None, str | None, str]:
    """(size, digest, observation) of a file, read in bounded pieces."""
    try:
        before = os.stat(path, follow_symlinks=False)
        if not stat.S_ISREG(before.st_mode):
            return None, None, "UNSUPPORTED"
        digest, size = hashlib.sha256(), 0
        with open(path, "rb") as f:
            while part := f.read(CHUNK):
                digest.update(part)
                size += len(part)
            opened = os.fstat(f.fileno())
        after = os.stat(path, follow_symlinks=False)
    except OSError:
        return None, None, "UNREADABLE"
    same = {(s.st_dev, s.st_ino, s.st_size, s.st_mtime_ns) for s in (before, opened, after)}
    if len(same) > 1 or size != before.st_size:
        return None, None, "UNSTABLE_DURING_READ"
    return size, digest.hexdigest(), "OBSERVED"


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, sha256, observation) of everything below a folder that driver and executors share.

    observation is OBSERVED, UNREADABLE, UNSTABLE_DURING_READ (the file
    changed while it was read), UNSUPPORTED (a link or no plain file), or
    NOT_LISTED for a folder whose content could not be listed. The names come
    from the driver; the files are read where the tasks run.
    """
    root = folder.rstrip("/")
    found, closed = _names(root)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(p, *(_observe(f"{root}/{p}") if kind == "FILE" else (None, None, kind))) for p, kind in zip(part["path"], part["kind"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "size", "sha256", "observation"]).astype({"size": "Int64"})

    names = spark.createDataFrame(found + [(p or ".", "NOT_LISTED") for p in closed], "path string, kind string")
    return names.repartition(max(1, min(len(found) // 16, spark.sparkContext.defaultParallelism))).mapInPandas(run, SCHEMA)


def check(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, status) of each path: MATCH, CONTENT_CHANGED, ADDED, MISSING, UNREADABLE, UNSTABLE_DURING_READ, UNSUPPORTED or NOT_OBSERVED.

    If some folder could not be listed, a path that is not there was not
    observed, instead of missing.
    """
    closed = F.broadcast(after.groupBy().agg(F.coalesce(F.bool_or(F.col("observation") == "NOT_LISTED"), F.lit(False)).alias("closed")))  # one row
    a = before.where("observation <> 'NOT_LISTED'").select(F.col("path").alias("key"), F.col("sha256").alias("was"), F.lit(True).alias("in_a"))
    b = after.where("observation <> 'NOT_LISTED'").select(F.col("path").alias("key"), F.col("sha256").alias("now"), "observation")
    status = (
        F.when(F.col("observation").isNull(), F.when(F.col("closed"), "NOT_OBSERVED").otherwise("MISSING"))
        .when(F.col("observation") != "OBSERVED", F.col("observation"))
        .when(F.col("in_a").isNull(), "ADDED")
        .when(F.col("was").eqNullSafe(F.col("now")), "MATCH")
        .otherwise("CONTENT_CHANGED")
    )
    return a.join(b, "key", "full_outer").join(closed).select("key", status.alias("status"))


def verdict(results: DataFrame) -> str:
    """MATCH if every path does, INCOMPLETE if one was not observed, else REVIEW_REQUIRED."""
    row = results.groupBy().agg(F.count_if(F.col("status") == "NOT_OBSERVED").alias("unseen"), F.count_if(F.col("status") != "MATCH").alias("other")).first()
    return "INCOMPLETE" if row["unseen"] else "REVIEW_REQUIRED" if row["other"] else "MATCH"
