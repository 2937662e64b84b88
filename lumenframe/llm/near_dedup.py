"""MinHash near-dedup by bottom-k sketches from one hash function.

Each document's set is its distinct word shingles, hashed once; the ``SKETCH``
smallest values are its sketch. Equal sets are one node. Two sets whose
Jaccard similarity reaches the threshold share at least half of their sketch
values (for 48 values and a similarity of 0.8 the chance of fewer is about
1e-7), so by the prefix principle they share one of the rarest values of
either sketch, where each sketch leaves out as many of its most frequent
values as half its size less one. Inverted lists of those values give the
overlaps; values of frequent lines and passages are used only by sets that
consist of them by half. Pairs pass the estimate from the sketch of the union
and are then confirmed on the full sets of both texts.

Defined results: null text, or text without words, has an empty set, no
links, and is its own component; texts below the shingle width are one
shingle; of rows with one doc_id each has the component of its own text; a
null doc_id links like any other, but a component is named by the smallest
doc_id that is not null (null if there is none);
repeated rows repeat their result; an empty table gives an empty result;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from .linking import components, sample

SKETCH = 48
SLACK = 0.3
_U = np.uint64


def _block_sets(b: c.Block, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted 63-bit sets of a block: values, first position of each non-empty text, and its number."""
    doc, h = c.shingle_hashes(b, words)
    doc, h = c.sorted_sets(doc, h >> _U(1))
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
    return h, first, doc[first]


def _digests(h: np.ndarray, first: np.ndarray, seed: int = 0x5851F42D4C957F2D) -> np.ndarray:
    """One order-free 63-bit digest of each set."""
    if not len(first):
        return np.zeros(0, np.int64)
    return (c.mix64(np.add.reduceat(c.mix64(h + _U(seed)), first)) >> _U(1)).view(np.int64)


def sketches(docs: DataFrame, words: int, id_bits: int = 63) -> DataFrame:
    """(doc_id, th, n_shingles, set_id, other, sketch) of docs(doc_id, text); empty sets have null set_id.

    th is a hash of the text, other a second digest of the set.
    """
    mask = (1 << id_bits) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in c.blocks(batch.column(1)):
                h, first, which = _block_sets(b, words)
                size = np.diff(np.r_[first, len(h)])
                n, has = np.zeros(len(b), np.int64), np.zeros(len(b), bool)
                set_id, other = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
                n[which], set_id[which], has[which] = size, _digests(h, first) & mask, True
                other[which] = _digests(h, first, 0x14057B7EF767814F)
                kept = np.zeros(len(b), np.int64)
                kept[which] = np.minimum(size, SKETCH)
                place = np.arange(len(h)) - np.repeat(first, size)
                values = pa.array(h[place < SKETCH].view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(kept)].astype(np.int32)), values)
                own = [batch.column(i).slice(b.rows.start, len(b)) for i in (0, 2)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n), pa.array(set_id, mask=~has), pa.array(other, mask=~has), lists], ["doc_id", "th", "n_shingles", "set_id", "other", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(run, f"doc_id {kind}, th long, n_shingles long, set_id long, other long, sketch array<long>")


def _sets(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, sets): unequal sets never share a set_id; one that another has taken by chance is drawn anew."""

    def grouped(rows: DataFrame) -> DataFrame:
        one = [F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("least_doc"), F.min(F.struct("doc_id", "th")).alias("at")]
        return c.saved(rows.where("set_id is not null").groupBy("set_id").agg(*one, F.min("other").alias("least"), F.max("other").alias("most")), "sets")

    sets = grouped(rows)
    while sets.where("least <> most").limit(1).count():
        taken = sets.where("least <> most").select("set_id", "least")
        fresh = F.shiftrightunsigned(F.xxhash64("set_id", "other"), 1)
        rows = c.saved(rows.join(taken, "set_id", "left").withColumn("set_id", F.when(F.col("other") != F.col("least"), fresh).otherwise(F.col("set_id"))).select(rows.columns), "sketches")
        sets = grouped(rows)
    return rows, sets


def _inverted_lists(sets: DataFrame) -> DataFrame:
    values = sets.select(F.col("set_id").alias("node"), F.size("sketch").alias("m"), F.explode("sketch").alias("key"))
    frequency = values.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    shared = values.join(frequency, "key").groupBy("node", "m").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("v"))
    need = F.ceil(F.col("m") / 2).cast("int")
    shared = shared.where(F.size("v") >= need)
    return shared.select("node", F.explode(F.slice("v", F.lit(1), F.size("v") - need + 1)).alias("v")).select(F.col("v.key").alias("key"), "node")


def _confirm(texts: DataFrame, sets: DataFrame, words: int, num: int, den: int):
    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            known: dict[int, np.ndarray] = {}

            def sets_of(ids: list[int], texts: pa.Array) -> None:
                for block in c.blocks(texts):
                    h, first, which = _block_sets(block, words)
                    for i, part in zip(which, np.split(h, first[1:]), strict=True):
                        known[ids[block.rows.start + i]] = part

            yes = []
            for lo in range(0, len(a), 256):
                known.clear()
                sets_of(a[lo : lo + 256], batch.column(2).slice(lo, 256))
                sets_of(b[lo : lo + 256], batch.column(3).slice(lo, 256))
                for x, y in zip(a[lo : lo + 256], b[lo : lo + 256], strict=True):
                    both = np.intersect1d(known[x], known[y], assume_unique=True).size
                    yes.append(den * both >= num * (len(known[x]) + len(known[y]) - both))
            mask = pa.array(yes, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    def verify(pairs: DataFrame) -> DataFrame:
        side = {s: sets.select(F.col("set_id").alias(s), F.col("n").alias(f"n{s}"), F.col("sketch").alias(f"s{s}")) for s in "ab"}
        rows = pairs.join(side["a"], "a").join(side["b"], "b").where((F.least("na", "nb") * den >= F.greatest("na", "nb") * num))
        union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, SKETCH)
        estimate = F.size(F.array_intersect(union, F.array_intersect("sa", "sb"))) / F.size(union)
        likely = c.saved(rows.where(estimate >= num / den - SLACK).select("a", "b"), "likely")
        ta, tb = (texts.select(F.col("set_id").alias(s), F.col("text").alias(f"t{s}")) for s in "ab")
        return likely.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb").mapInArrow(exact, "a long, b long")

    return verify


def _listed_texts(docs: DataFrame, sets: DataFrame, lists: DataFrame) -> DataFrame:
    """(set_id, text): one text of every set that stands in a list."""
    where = lists.select(F.col("node").alias("set_id")).distinct().join(sets.select("set_id", F.col("at.doc_id").alias("_of"), F.col("at.th").alias("_th")), "set_id")
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    found = keyed.join(where, keyed["doc_id"].eqNullSafe(where["_of"]) & (keyed["th"] == where["_th"])).select("set_id", "text")
    return c.saved(found.dropDuplicates(["set_id"]), "texts")


def _samples(texts: DataFrame, words: int):
    """nodes -> nodes with (level, held): a sample of each node's full set, see linking.sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = [batch.column(i) for i in range(3)]
            for b in c.blocks(batch.column(3)):
                h, first, which = _block_sets(b, words)
                sets = np.split(h, first[1:]) if len(first) else []
                level, held = zip(*map(sample, sets), strict=True) if sets else ((), ())
                at = pa.array(b.rows.start + which)
                yield pa.RecordBatch.from_arrays([*[x.take(at) for x in nodes], pa.array(level, pa.int32()), pa.array([x.view(np.int64) for x in held], pa.list_(pa.int64()))], ["node", "comp", "block", "level", "held"])

    return lambda nodes: texts.withColumnRenamed("set_id", "node").join(nodes, "node").select("node", "comp", "block", "text").mapInArrow(run, "node long, comp long, block long, level int, held array<long>")


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_bits: int = 63) -> DataFrame:
    """(doc_id, set_id, n_shingles, component_id, kept) where a link is den * intersection >= num * union."""
    docs = docs.select("doc_id", "text")
    rows, sets = _sets(c.saved(sketches(docs, words, id_bits), "sketches"))
    lists = c.saved(_inverted_lists(sets), "inverted")
    texts = _listed_texts(docs, sets, lists)
    label = components(lists, _confirm(texts, sets, words, num, den), _samples(texts, words), num, den)
    owner = sets.select("set_id", "least_doc").join(label.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("comp", F.coalesce("comp", "set_id"))
    least = owner.groupBy("comp").agg(F.min("least_doc").alias("component_id"))
    of_set = c.saved(owner.join(least, "comp").select("set_id", "component_id"), "components")
    out = rows.select("doc_id", "set_id", "n_shingles").join(of_set, "set_id", "left")
    return out.withColumn("component_id", F.coalesce("component_id", "doc_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
