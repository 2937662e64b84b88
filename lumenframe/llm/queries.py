"""The registered digest query of each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import predict, train

    docs = c.load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = train(docs.where(~held_out).select("text", "lang"))
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import measure

    return measure(c.load(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import digest

    return digest(c.load(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    docs = c.load(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    return near_duplicates(docs, words=3, num=85, den=100).select("doc_id", "n_shingles", "component_id", "kept")


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import read_media, to_media

    media = c.saved(to_media(c.load(spark, sf_dir, "documents").select("doc_id", "text")), "media")
    return read_media(media).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "samples", "rate")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_digest

    return line_digest(c.load(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import BASE, judge

    docs = c.load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return judge(docs).select("_row.doc_id", *BASE, "base_failed", "kept", "log_ppl")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    counts = count_tokens(c.load(spark, sf_dir, "documents").select("doc_id", "text"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(c.load(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filters import filter_urls

    return filter_urls(c.load(spark, sf_dir, "pages").select("page_id", "url", "html"))


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op7 that SQL can express."""
    from .quality import BASE, score

    return score(c.load(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("_row.doc_id", *BASE, "base_failed")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10 that SQL can express: host, path and the longest rule that fits."""
    return op10_url_filters(spark, sf_dir).select("page_id", "host", "path", "rule")


_BASE_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
windows AS (SELECT doc_id, i, word || ' ' || lead(word) OVER p || ' ' || lead(word, 2) OVER p AS g FROM words WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
repeated AS (SELECT doc_id, i FROM windows WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM repeated) GROUP BY 1),
b AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w)
SELECT doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
  n_words < 50 OR 100 * coalesce(n, 0) > 50 * n_words AS base_failed
FROM b LEFT JOIN covered USING (doc_id)
"""
_RULES_SQL = r"""
WITH r(rule) AS (VALUES ('org/'), ('example.org/es/'), ('example.org/en/1'), ('com/fr/'), ('com/de/')),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
f AS (SELECT page_id, arg_max(rule, length(rule)) AS rule FROM p JOIN r ON ('.' || host LIKE '%.' || split_part(rule, '/', 1)) AND starts_with(path, substr(rule, strpos(rule, '/'))) GROUP BY 1)
SELECT page_id, host, path, rule FROM p LEFT JOIN f USING (page_id)
"""

QUERIES = {f.__name__: f for f in (op1_language_id, op2_substring_dedup, op3_piece_codec, op4_near_dedup, op5_media_columns, op6_line_dedup, op7_quality_rules, op8_token_counts, op9_packing, op10_url_filters, quality_base_counts, url_rules)}
ORACLE: dict[str, str] = {"quality_base_counts": _BASE_SQL, "url_rules": _RULES_SQL}
