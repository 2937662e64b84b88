"""Quality rules: text statistics and a Kneser-Ney perplexity band per language.

The language model is an interpolated modified Kneser-Ney model over
character 4-grams. Characters are lower-cased UTF-16 units, so a 4-gram fits
one 64-bit key exactly. Spark counts the 4-grams of all documents by language
and derives lower orders, discounts and backoff weights with aggregations and
joins; the result is one log probability per seen 4-gram, held as arrays
sorted by hash with an index on the leading bits. The arrays are broadcast
while they have at most ``MAX_BROADCAST_GRAMS`` entries; a larger model stays
a table and is joined to the documents' 4-gram counts. A judged text's own
counts are held out: a 4-gram that only it holds gets the probability of an
unseen one. Characters are the unit, not words, as counts of word n-grams
outgrow the disk (figures in the README): the band rejects wrong letters, a
wrong language and bare repetition, but not shuffled words.

Defined results: null or empty text has no words (all counts 0, base fails)
and no perplexity; null lang forms a language of its own, ``und``; repeated
rows are judged alike; an empty table gives an empty result. Columns other
than text and lang are carried unread, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c

MAX_BROADCAST_GRAMS = 6_000_000
#: Quartile distances beyond the quartiles, as for far outliers: of a normal distribution it cuts off 2 in a million.
FENCE = 3.0
MIN_SPREAD = 0.05
#: Counts are told apart up to this.
MOST = (1 << 31) - 1
FLUSH_UNITS = 1 << 22
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_U = np.uint64


def _repeated(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Flags of the values that the same text holds twice or more."""
    key = h ^ c.mix64(doc.astype(np.uint64) + _U(1))
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    out = np.empty(len(s), bool)
    out[order] = same[1:] | same[:-1]
    return out


def base_counts(b: c.Block) -> dict[str, np.ndarray]:
    n, size = len(b), len(b.data)
    starts, ends, doc = c.word_spans(b)

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(size + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[b.off[1:]] - total[b.off[:-1]]

    out = {
        "n_words": np.bincount(doc, minlength=n),
        "word_chars": per_text(((b.data & 0xC0) != 0x80) & ~c.SPACE[b.data]),
        "n_symbols": per_text(SYMBOLS[b.data]),
        "n_dup_lines": np.zeros(n, np.int64),
        "n_repeat_words": np.zeros(n, np.int64),
    }
    newline = np.flatnonzero(b.data == 10)
    lo = np.sort(np.concatenate([b.off[:-1], newline + 1]))
    hi = np.sort(np.concatenate([newline, b.off[1:]]))
    worded = np.searchsorted(starts, lo) < np.searchsorted(starts, hi)
    lo, hi = lo[worded], hi[worded]
    if len(lo):
        line_doc = np.searchsorted(b.off, lo, "right") - 1
        key = c.span_hashes(b.data, lo, hi) ^ c.mix64(line_doc.astype(np.uint64) + _U(1))
        _, first = np.unique(key, return_index=True)
        out["n_dup_lines"] = np.bincount(line_doc, minlength=n) - np.bincount(line_doc[first], minlength=n)
    if len(starts) >= 3:
        window = c.fold_words(c.span_hashes(b.data, starts, ends), 3)
        inside = np.flatnonzero(doc[:-2] == doc[2:])
        at = inside[_repeated(doc[inside], window[inside])]
        cover = np.zeros(len(starts), bool)
        for j in range(3):
            cover[at + j] = True
        out["n_repeat_words"] = np.bincount(doc[cover], minlength=n)
    return out


def _grams(b: c.Block) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 4-gram key) of every unit; three zero units stand before each text."""
    raw = b.data.tobytes()
    parts = [raw[b.off[i] : b.off[i + 1]].decode("utf-8", "replace").lower().replace("\0", " ") for i in range(len(b))]
    u = np.frombuffer("".join("\0\0\0" + p for p in parts).encode("utf-16-le", "surrogatepass"), np.uint16).astype(np.uint64)
    if len(u) < 4:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    real = u[3:] != 0
    key = (u[:-3] << _U(48)) | (u[1:-2] << _U(32)) | (u[2:-1] << _U(16)) | u[3:]
    doc = np.cumsum(u == 0)[3:] // 3 - 1
    return doc[real], key[real]


def _language(batch: pa.RecordBatch) -> np.ndarray:
    lang = batch.column(batch.schema.get_field_index("_lang"))
    return np.array(["und" if x is None else x for x in lang.to_pylist()], object)


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            keys, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "g", "c"])
        held.clear()

    for batch in batches:
        lang = _language(batch)
        for b in c.blocks(batch.column(batch.schema.get_field_index("_text"))):
            doc, key = _grams(b)
            size += len(key)
            here = lang[b.rows]
            for name in set(here):
                held.setdefault(name, []).append(key[(here == name)[doc]])
            if size >= FLUSH_UNITS:
                yield from flush()
                size = 0
    yield from flush()


def _with_kn(grams: DataFrame, order: int, lower: DataFrame | None) -> DataFrame:
    """Interpolated probability of each n-gram of this order from its (lang, g, c) counts."""
    context = F.shiftrightunsigned("g", 16)
    g = grams.withColumn("ctx", context)
    d = g.groupBy("lang").agg(*[F.count_if(F.col("c") == k).cast("double").alias(f"m{k}") for k in (1, 2, 3, 4)])
    y = F.when(F.col("m1") + 2 * F.col("m2") > 0, F.col("m1") / (F.col("m1") + 2 * F.col("m2"))).otherwise(0.5)

    def discount(k: int):
        raw = F.when(F.col(f"m{k}") > 0, k - (k + 1) * y * F.col(f"m{k + 1}") / F.col(f"m{k}")).otherwise(F.lit(k * 0.5))
        return F.least(F.greatest(raw, F.lit(0.05)), F.lit(k * 0.95))

    d = d.select("lang", *[discount(k).alias(f"d{k}") for k in (1, 2, 3)])
    x = g.groupBy("lang", "ctx").agg(F.sum("c").cast("double").alias("total"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2"), F.count_if(F.col("c") >= 3).alias("n3"))
    rows = g.join(x, ["lang", "ctx"]).join(d, "lang")
    own = (F.col("c") - F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))) / F.col("total")
    back = (F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * F.col("n3")) / F.col("total")
    if lower is None:
        rows = rows.withColumn("p_low", F.lit(1.0 / 65536))
    else:
        rows = rows.withColumn("low", F.col("g").bitwiseAND((1 << (16 * (order - 1))) - 1)).join(lower.select("lang", F.col("g").alias("low"), F.col("p").alias("p_low")), ["lang", "low"])
    return rows.select("lang", "g", (own + back * F.col("p_low")).alias("p"), "c", (back * F.col("p_low")).alias("b"))


def train(docs: DataFrame) -> DataFrame:
    """(lang, g, logp, c, logb) for every character 4-gram of docs(_text, _lang): log probability, count, and log probability if it were unseen."""
    raw = docs.select("_text", "_lang").mapInArrow(_counter, "lang string, g long, c long")
    four = c.saved(raw.groupBy("lang", "g").agg(F.sum("c").alias("c")), "grams4")
    counts = {4: four}
    for order in (3, 2, 1):
        mask = (1 << (16 * order)) - 1
        counts[order] = c.saved(counts[order + 1].groupBy("lang", F.col("g").bitwiseAND(mask).alias("g")).agg(F.count("*").alias("c")), f"grams{order}")
    # each order is written, as one plan of all four would hold every order's counts several times and be planned anew after each of its stages
    p = None
    for order in (1, 2, 3):
        p = c.saved(_with_kn(counts[order], order, p).select("lang", "g", "p"), f"model{order}")
    p = _with_kn(four, 4, p)
    return c.saved(p.select("lang", "g", F.log("p").cast("float").alias("logp"), F.least("c", F.lit(MOST)).cast("int").alias("c"), F.log("b").cast("float").alias("logb")), "model4")


class HashArrays:
    """Log probabilities in arrays sorted by hash, with an index on the leading bits."""

    def __init__(self, lang: list[str], code: np.ndarray, g: np.ndarray, *values: np.ndarray):
        self.seed = {name: int(s) for name, s in zip(lang, c._stream(len(lang), 99), strict=True)}
        seeds = np.array([self.seed[x] for x in lang], np.uint64) if lang else np.zeros(0, np.uint64)
        h = c.mix64(g.view(np.uint64) ^ seeds[code])
        order = np.argsort(h, kind="stable")
        self.h, self.values = h[order], [v[order] for v in values]
        self.bits = max(1, int(len(h)).bit_length())
        self.index = np.searchsorted(self.h, np.arange(1 << self.bits, dtype=np.uint64) << _U(64 - self.bits)).astype(np.int64)

    def find(self, lang: str, keys: np.ndarray) -> np.ndarray:
        """Place of each n-gram in the arrays, or -1."""
        out = np.full(len(keys), -1)
        if lang not in self.seed or not len(self.h):
            return out
        q = c.mix64(keys ^ _U(self.seed[lang]))
        at = self.index[(q >> _U(64 - self.bits)).astype(np.int64)]
        todo = np.arange(len(q))
        last = len(self.h) - 1
        while len(todo):
            here = self.h[np.minimum(at, last)]
            hit = (here == q) & (at <= last)
            out[todo[hit]] = at[hit]
            on = ~hit & (here < q) & (at < last)
            todo, at, q = todo[on], at[on] + 1, q[on]
        return out


def _scores(b: c.Block, lang: np.ndarray, model: HashArrays) -> np.ndarray:
    """Mean negative log probability of a unit, per text; NaN without one.

    A text's own counts are held out: a 4-gram that no other text of the
    language holds is unseen.
    """
    doc, key = _grams(b)
    total, n = np.zeros(len(b)), np.bincount(doc, minlength=len(b))
    order = np.argsort(key, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    doc, key = doc[order], key[order]
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])][: len(doc)])
    own = np.diff(np.r_[first, len(doc)])
    doc, key = doc[first], key[first]
    for name in set(lang):
        mine = (lang == name)[doc]
        at = model.find(name, key[mine])
        logp = np.full(len(at), np.log(1 / 65536))
        seen = at >= 0
        held, count, low = (v[at[seen]] for v in model.values) if len(model.h) else (np.zeros(0),) * 3
        logp[seen] = np.where(np.minimum(own[mine][seen], MOST) < count, held, low)
        total += np.bincount(doc[mine], weights=logp * own[mine], minlength=len(b))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.round(np.where(n > 0, -total / n, np.nan), 6)


def _unit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """4-gram counts of each text, for a model that stays a table."""
    for batch in batches:
        lang = _language(batch)
        digest = batch.column(batch.schema.get_field_index("_digest")).to_pylist()
        for b in c.blocks(batch.column(batch.schema.get_field_index("_text"))):
            doc, key = _grams(b)
            for i in range(len(b)):
                keys, n = np.unique(key[doc == i], return_counts=True)
                r = b.rows.start + i
                yield pa.RecordBatch.from_arrays([pa.array([lang[r]] * len(keys), pa.string()), pa.array([digest[r]] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "_digest", "g", "c"])


def score(docs: DataFrame, max_broadcast: int = MAX_BROADCAST_GRAMS) -> DataFrame:
    """Append the base counts, base_failed and log_ppl to every row of docs.

    The input row is kept whole in the struct column _row; _lang is its
    language with null as ``und``.
    """
    spark = docs.sparkSession
    src = docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text"), F.col("lang").cast("string").alias("_lang"))
    model = train(src)
    small = model.count() <= max_broadcast
    if small:
        table = model.toArrow()
        code = table.column("lang").combine_chunks().dictionary_encode()
        names = code.dictionary.to_pylist() if len(table) else []
        arrays = HashArrays(names, code.indices.to_numpy(), *(table.column(x).to_numpy() for x in ("g", "logp", "c", "logb")))
        shared = spark.sparkContext.broadcast(arrays)
    keep = [f.name for f in src.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = _language(batch)
            cols: dict[str, list] = {k: [] for k in (*BASE, "log_ppl")}
            for b in c.blocks(batch.column(batch.schema.get_field_index("_text"))):
                for k, v in base_counts(b).items():
                    cols[k].append(v)
                cols["log_ppl"].append(_scores(b, lang[b.rows], shared.value) if small else np.full(len(b), np.nan))
            extra = [pa.array(np.concatenate(v) if v else np.zeros(0), pa.float64() if k == "log_ppl" else pa.int64()) for k, v in cols.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *extra], [*keep, *cols])

    schema = T.StructType([*src.schema.fields, *[T.StructField(k, T.LongType()) for k in BASE], T.StructField("log_ppl", T.DoubleType())])
    out = src.mapInArrow(run, schema)
    if not small:
        keyed = src.select("_text", "_lang", F.sha2(F.coalesce("_text", F.lit("")), 256).alias("_digest"))
        parts = keyed.mapInArrow(_unit_counts, "lang string, _digest string, g long, c long").distinct()
        held = model.withColumnRenamed("c", "all")
        logp = F.when(F.least("c", F.lit(MOST)) < F.col("all"), F.col("logp")).otherwise(F.col("logb"))
        ppl = parts.join(held, ["lang", "g"]).groupBy("lang", "_digest").agg(F.round(-F.sum(F.col("c") * logp) / F.sum("c"), 6).alias("joined"))
        ppl = ppl.withColumnRenamed("lang", "_key")
        out = out.withColumns({"_key": F.coalesce("_lang", F.lit("und")), "_digest": F.sha2(F.coalesce("_text", F.lit("")), 256)})
        out = out.join(ppl, ["_key", "_digest"], "left").withColumn("log_ppl", F.col("joined")).drop("_key", "_digest", "joined")
    fails = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    log_ppl = F.when(F.isnan("log_ppl"), F.lit(None)).otherwise(F.col("log_ppl"))
    return out.withColumns({"_lang": F.coalesce("_lang", F.lit("und")), "base_failed": fails, "log_ppl": log_ppl}).drop("_text")


def bands(scored: DataFrame, fence: float = FENCE) -> DataFrame:
    """(_lang, low, high): quartiles of the rows that pass the base, widened by fence times their distance.

    Quartiles are read from a histogram of log perplexity in steps of 0.001,
    so they are the same however the rows are dealt out.
    """
    from pyspark.sql import Window

    cells = scored.where("not base_failed and log_ppl is not null").groupBy("_lang", F.round("log_ppl", 3).alias("v")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("_lang")
    cells = cells.withColumns({"upto": F.sum("n").over(w.orderBy("v")), "all": F.sum("n").over(w)})
    q = cells.groupBy("_lang").agg(F.min(F.when(F.col("upto") * 4 >= F.col("all"), F.col("v"))).alias("q1"), F.min(F.when(F.col("upto") * 4 >= 3 * F.col("all"), F.col("v"))).alias("q3"))
    spread = F.greatest(F.col("q3") - F.col("q1"), F.lit(MIN_SPREAD)) * fence
    return q.select("_lang", (F.col("q1") - spread).alias("low"), (F.col("q3") + spread).alias("high"))


def judge(docs: DataFrame, fence: float = FENCE) -> DataFrame:
    """score() with kept: base passed and log perplexity within its language's band."""
    scored = c.saved(score(docs), "scored")
    band = scored.join(bands(scored, fence), "_lang", "left")
    return band.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(True)))
