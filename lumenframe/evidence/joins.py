"""Joins of delimited files that can be run again from what a run kept of them."""

from __future__ import annotations

import json
import os
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DataRefusal
from ..operators.join import join_one_to_one
from ..sources import delimited, sinks
from .receipts import sha256_of

RULES = "join.json"


def _joined(spark: SparkSession, folder: str, rules: dict) -> DataFrame:
    """The join in the left file's order; cells without a partner are \\N."""
    left = delimited.read(spark, os.path.join(folder, "imports", rules["left"]), rules["delimiter"])
    right = delimited.read(spark, os.path.join(folder, "imports", rules["right"]), rules["delimiter"]).drop("_ord")
    place = rules["left_prefix"] + "_ord"
    out = join_one_to_one(left, right, rules["left_key"], rules["right_key"], rules["kind"], rules["left_prefix"], rules["right_prefix"])
    return out.withColumnRenamed(place, "_ord").withColumn("__join_matched", F.col("__join_matched").cast("string"))


def join_files(spark: SparkSession, folder: str, name: str, left: str, right: str, left_key: str, right_key: str, kind: str, left_prefix: str, right_prefix: str, delimiter: str = ",") -> str:
    """Join two files into folder/name, keep copies of both below folder/imports, and the rules and digests beside them."""
    os.makedirs(os.path.join(folder, "imports"))
    kept = {}
    for side, path in (("left", left), ("right", right)):
        kept[side] = f"{side}-{os.path.basename(path)}"
        shutil.copyfile(path, os.path.join(folder, "imports", kept[side]))
    rules = kept | {"name": name, "left_key": left_key, "right_key": right_key, "kind": kind, "left_prefix": left_prefix, "right_prefix": right_prefix, "delimiter": delimiter}
    rows = _joined(spark, folder, rules)
    path = sinks.export(rows, folder, name, [c for c in rows.columns if c != "_ord"], delimiter)
    digests = {side: sha256_of(os.path.join(folder, "imports", kept[side])) for side in kept} | {"output": sha256_of(path)}
    sinks.publish(folder, RULES, [json.dumps({"rules": rules, "sha256": digests}, indent=2, sort_keys=True).encode()])
    return path


def reconstruct(spark: SparkSession, folder: str) -> None:
    """Run a kept join again; refuses if an input or the output is not byte for byte what it was."""
    with open(os.path.join(folder, RULES), encoding="utf-8") as f:
        kept = json.load(f)
    rules, digests = kept["rules"], kept["sha256"]
    for side in ("left", "right"):
        if os.path.basename(rules[side]) != rules[side] or sha256_of(os.path.join(folder, "imports", rules[side])) != digests[side]:
            raise DataRefusal(f"the {side} input is not the one that was joined")
    if sha256_of(os.path.join(folder, rules["name"])) != digests["output"]:
        raise DataRefusal("the output is not the one that was written")
    rows = _joined(spark, folder, rules)
    again = sinks.export(rows, folder, "again-" + rules["name"], [c for c in rows.columns if c != "_ord"], rules["delimiter"])
    try:
        if sha256_of(again) != digests["output"]:
            raise DataRefusal("the join gives another output")
    finally:
        os.unlink(again)
