"""Language ID: multinomial naive Bayes over hashed character n-grams.

Characters are folded to lower-case letters and blanks; n-grams of 1 to 3
characters are hashed into ``BUCKETS``. Each training task sums counts by
language, Spark adds them up, and the smoothed log-probability matrix
(languages x buckets) is broadcast. Its size is bounded by ``MAX_LANGUAGES``;
more distinct languages than that is an error, not a truncation.

Defined results: null text or text without a letter is ``und`` with score 0,
as is any text when nothing was learned; equal posteriors go to the first
language in order; repeated rows count as often as they occur; columns other
than doc_id, text and (for training) lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
MAX_LANGUAGES = 512
ALPHA = 0.5
_U = np.uint64
_FOLD: list[np.ndarray] = []


def _fold_table() -> np.ndarray:
    """Code point to its lower-case letter, or to a blank."""
    if not _FOLD:
        t = np.full(0x110000, 32, np.uint32)
        for i in range(0x110000):
            ch = chr(i)
            if ch.isalpha():
                t[i] = ord(ch.lower()[0])
        _FOLD.append(t)
    return _FOLD[0]


def features(b: c.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, bucket) of every n-gram that is not all blank, and the texts that have a letter."""
    raw = b.data.tobytes()
    try:
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        total = np.zeros(len(b.data) + 1, np.int64)
        np.cumsum((b.data & 0xC0) != 0x80, out=total[1:])
        off = total[b.off]
    except UnicodeDecodeError:
        parts = [raw[b.off[i] : b.off[i + 1]].decode("utf-8", "replace") for i in range(len(b))]
        points = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        off = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    folded = _fold_table()[points].astype(np.uint64)
    doc = np.repeat(np.arange(len(b)), np.diff(off))
    letter = folded != 32
    docs, buckets = [], []
    for n in ORDERS:
        m = len(folded) - n + 1
        if m <= 0:
            continue
        h, some = np.full(m, n, np.uint64), np.zeros(m, bool)
        for j in range(n):
            h = h * _U(0x1FFFFFFFFFFFFFE7) + folded[j : j + m]
            some |= letter[j : j + m]
        ok = some & (doc[:m] == doc[n - 1 :])
        docs.append(doc[:m][ok])
        buckets.append((c.mix64(h[ok]) >> _U(32)).astype(np.int64) % BUCKETS)
    has = np.bincount(doc[letter], minlength=len(b)) > 0
    z = np.zeros(0, np.int64)
    return np.concatenate([z, *docs]), np.concatenate([z, *buckets]), has


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    texts: dict[str, int] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, v in held.items():
            at = np.flatnonzero(v)
            # bucket -1 carries the number of texts
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1)), pa.array(np.r_[-1, at]), pa.array(np.r_[texts[lang], v[at]])], ["lang", "bucket", "n"])
        held.clear()
        texts.clear()

    for batch in batches:
        lang = np.array(batch.column(1).to_pylist(), object)
        for b in c.blocks(batch.column(0)):
            doc, bucket, _ = features(b)
            here = lang[b.rows]
            for name in set(here):
                mine = here == name
                held[name] = held.get(name, 0) + np.bincount(bucket[mine[doc]], minlength=BUCKETS)
                texts[name] = texts.get(name, 0) + int(mine.sum())
            if len(held) > 64:
                yield from flush()
    yield from flush()


def train(rows: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log priors, log probabilities) from rows(text, lang); null text or lang teaches nothing."""
    rows = rows.where("text is not null and lang is not null").select("text", F.col("lang").cast("string"))
    sums = c.saved(rows.mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "language-counts")
    languages = sorted(r["lang"] for r in sums.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    counts, prior = np.zeros((len(languages), BUCKETS)), np.ones(len(languages))
    if languages:
        table = sums.toArrow()
        row = np.searchsorted(np.array(languages, object), np.array(table.column("lang").to_pylist(), object))
        bucket, n = table.column("bucket").to_numpy(), table.column("n").to_numpy()
        prior[row[bucket < 0]] = n[bucket < 0]
        counts[row[bucket >= 0], bucket[bucket >= 0]] = n[bucket >= 0]
    p = (counts + ALPHA) / (counts.sum(1, keepdims=True) + ALPHA * BUCKETS)
    return languages, np.log(prior / prior.sum()) if languages else prior, np.log(p).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """Append lang_pred and score to docs; the column text must be there."""
    src = docs.select("*", F.col("text").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, prior, logp = shared.value
        for batch in batches:
            best, score = [], []
            for b in c.blocks(batch.column(len(keep))):
                doc, bucket, has = features(b)
                if not languages:
                    best += [None] * len(b)
                    score.append(np.zeros(len(b)))
                    continue
                s = np.stack([prior[i] + np.bincount(doc, weights=logp[i][bucket], minlength=len(b)) for i in range(len(languages))])
                top = s.argmax(0)
                p = 1 / np.exp(s - s.max(0)).sum(0)
                known = has & ~b.null
                best += [languages[t] if k else None for t, k in zip(top, known, strict=True)]
                score.append(np.where(known, p, 0.0))
            lang = pa.array([x or "und" for x in best], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], lang, pa.array(np.concatenate(score) if score else np.zeros(0), pa.float64())], [*keep, "lang_pred", "score"])

    from pyspark.sql import types as T

    return src.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
