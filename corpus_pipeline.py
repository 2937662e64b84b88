"""The corpus pipeline: quality rules, line dedup, near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; run() writes each stage's result as Parquet in the shared folder and
reads it back. All stages but the last return the columns of documents, with
n_chars the length of the text as it then is. A document that loses its last
word to line or substring dedup goes. Nulls in doc_id, lang or source and
repeated rows are allowed; a null text has no words, so the quality rules
drop it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import common as c

WORD = r"[^\x20\x09-\x0D]"
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from lumenframe.llm.quality import judge

    return judge(docs).where("kept").select("_row.*")


def _with_text(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (_row, _kept) as documents whose text is _kept; those without a word left go."""
    rows = rows.where(F.col("_kept").rlike(WORD))
    new = {"text": F.col("_kept"), "n_chars": F.length("_kept").cast("long")}
    return rows.select(*[new[x].alias(x) if x in new else F.col(f"_row.`{x}`") for x in columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from lumenframe.llm.line_dedup import dedup_lines

    return _with_text(dedup_lines(docs), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from lumenframe.llm.near_dedup import near_duplicates

    # a row is known by its doc_id and text, so rows that share a doc_id are judged apart
    keyed = docs.withColumn("_key", F.struct("doc_id", F.xxhash64("text").alias("h")))
    kept = near_duplicates(keyed.select(F.col("_key").alias("doc_id"), "text"), words=5, num=80, den=100).where("kept")
    kept = c.saved(kept.select(F.col("doc_id").alias("_key")), "kept")
    rows = keyed.join(kept.distinct(), "_key", "left_semi")
    if kept.groupBy("_key").count().where("count > 1").limit(1).count():
        rows = rows.dropDuplicates(["_key"])
    return rows.select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from lumenframe.llm.substring_dedup import cleaned

    return _with_text(cleaned(docs), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from lumenframe.llm.packing import pack

    return pack(docs.select("doc_id", "text"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", substring_dedup),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = c.saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
