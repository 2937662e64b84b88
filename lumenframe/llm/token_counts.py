"""Token counts through a digest cache.

Content is keyed by the SHA-256 of its UTF-8 bytes (normalisation is left to
the tokenizer, since folding anything here could change a count) together
with a digest of the tokenizer file, its library and version. Stored counts
are joined on both; only distinct contents that miss are encoded, and their
counts are appended to the cache, a Parquet table in the shared folder.

Copies are dropped within each task before the shuffle, so a content with
very many copies sends one row a task. Defined results: null text is empty
and has 0 tokens; repeated rows each get their count; an empty table gives an
empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

CACHE_SCHEMA = "digest binary, version string, n_tokens long"
TOKENIZER = "piece_bpe_32k.model"
BATCH_CHARS = 1 << 20


@lru_cache(4)
def _tokenizer(name: str):
    import os

    import public_tokenizers as p

    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=p.path(name))
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    bpe = Tokenizer.from_file(p.path(name))
    return lambda texts: [len(x.ids) for x in bpe.encode_batch(texts, add_special_tokens=False)]


def version_digest(name: str) -> str:
    import public_tokenizers as p

    if name.endswith(".model"):
        import sentencepiece as lib
    else:
        import tokenizers as lib
    with open(p.path(name), "rb") as f:
        return hashlib.sha256(f.read() + f"|{lib.__name__}|{lib.__version__}|no specials".encode()).hexdigest()


def _first_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[bytes] = set()
    for batch in batches:
        new = []
        for i, d in enumerate(batch.column(0).to_pylist()):
            if d not in seen:
                seen.add(d)
                new.append(i)
        yield batch.take(pa.array(new, pa.int64()))


def _encode(tokenizer: str, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _tokenizer(tokenizer)
        for batch in _first_in_task(batches):
            texts, n, held = [], [], 0
            for text in batch.column(1):
                texts.append(text.as_py())
                held += len(texts[-1])
                if held >= BATCH_CHARS:
                    n += count(texts)
                    texts, held = [], 0
            n += count(texts) if texts else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], ["digest", "version", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, cache_path: str | None = None) -> DataFrame:
    """(doc_id, digest, n_bytes, n_tokens) of docs(doc_id, text); cache_path None starts an empty cache."""
    spark = docs.sparkSession
    version = version_digest(tokenizer)
    if cache_path is None:
        cache_path = f"{c.shared_dir(spark)}/lumen-token-cache-{uuid.uuid4().hex}"
        spark.createDataFrame([], CACHE_SCHEMA).write.parquet(cache_path)
    def stored() -> DataFrame:
        # two runs may have appended the same content
        return spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("version") == version).select("digest", "n_tokens").dropDuplicates(["digest"])

    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.unhex(F.sha2(text, 256))
    rows = docs.select(digest.alias("digest"), text.alias("text")).mapInArrow(_first_in_task, "digest binary, text string")
    misses = rows.join(stored().select("digest"), "digest", "left_anti")
    counted = misses.repartition(c.shuffle_width(spark), "digest").mapInArrow(_encode(tokenizer, version), CACHE_SCHEMA)
    counted.write.mode("append").option("compression", "zstd").parquet(cache_path)
    mine = docs.select("doc_id", digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    return mine.join(stored(), "digest").select("doc_id", "digest", "n_bytes", "n_tokens")
