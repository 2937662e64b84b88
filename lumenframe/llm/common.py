"""Shared plumbing: durable cuts, Arrow text blocks and vectorised hashing."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import saved, shared_dir  # noqa: F401

BLOCK_BYTES = 1 << 20
ROWS_PER_PART = 25_000
#: Links that one task joins in memory, 16 bytes each; a round of jobs for each step of a label costs the driver far more.
TASK_LINKS = 1 << 21
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def narrow(df: DataFrame, rows: int) -> DataFrame:
    """df in as many partitions as this many small rows are worth, if it would have more."""
    parts = 1 + rows // ROWS_PER_PART
    return df.coalesce(parts) if parts < shuffle_width(df.sparkSession) else df


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalising mixer on uint64, in place."""
    h ^= h >> _U(30)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def _stream(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=np.uint64) * _U(_BASE) + _U(seed))


BYTE_CODE = _stream(256, 17)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First n powers of the odd hash base modulo 2**64, and of its inverse."""
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]), BLOCK_BYTES)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            _POWERS[i] = p
    return _POWERS[0][:n], _POWERS[1][:n]


class Block:
    """Some whole texts as one byte array: text r is data[off[r]:off[r+1]], row rows[r]."""

    def __init__(self, data: np.ndarray, off: np.ndarray, rows: slice, null: np.ndarray):
        self.data, self.off, self.rows, self.null = data, off, rows, null

    def __len__(self) -> int:
        return len(self.off) - 1


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets and null flags of a string or binary column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, bool)
    null = np.asarray(column.is_null())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if null.any():
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0], null


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a column into runs of whole texts of about limit bytes; a longer text stands alone."""
    data, off, null = text_buffers(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield Block(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], slice(lo, hi), null[lo:hi])
        lo = hi


def word_spans(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the words [^\\x20\\x09-\\x0D]+."""
    if not len(b.data):
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~SPACE[b.data]
    before = np.empty_like(solid)
    before[0] = False
    before[1:] = solid[:-1]
    edge = b.off[:-1][b.off[:-1] < len(b.data)]
    before[edge] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty_like(solid)
    after[-1] = False
    after[:-1] = solid[1:]
    after[b.off[1:][b.off[1:] > 0] - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(b.off, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[start:end]; equal content gives equal hashes wherever it stands."""
    n = len(data)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * up[:n], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix64(h + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def fold_words(hashes: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hash of every k consecutive word hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.full(n, k, np.uint64)
    for j in range(k):
        acc = mix64(acc * _U(_BASE) + hashes[j : j + n])
    return acc


def shingle_hashes(b: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each k-word shingle of ASCII-lower-cased words.

    A text with 1 to k-1 words has its whole sequence as its one shingle; a
    text without words has none. Repeats within a text are left in.
    """
    starts, ends, doc = word_spans(b)
    h = span_hashes(LOWER[b.data], starts, ends)
    acc = fold_words(h, k)
    inside = doc[: len(acc)] == doc[k - 1 :] if len(acc) else np.zeros(0, bool)
    docs, values = [doc[: len(acc)][inside]], [acc[inside]]
    if len(doc):
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        count = np.diff(np.r_[first, len(doc)])
        for m in range(1, k):
            at = first[count == m]
            short = np.full(len(at), m, np.uint64)
            for j in range(m):
                short = mix64(short * _U(_BASE) + h[at + j])
            docs.append(doc[at])
            values.append(short)
    return np.concatenate(docs), np.concatenate(values)


def sorted_sets(doc: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, value) pairs ordered by text, then value."""
    order = np.argsort(values, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    doc, values = doc[order], values[order]
    if len(doc):
        new = np.r_[True, (doc[1:] != doc[:-1]) | (values[1:] != values[:-1])]
        doc, values = doc[new], values[new]
    return doc, values


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, comp) of all links (a, b), in memory: roots hook to smaller ones until every link lies within one."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if len(b)]
    if not held:
        return
    ends = np.concatenate([x[0] for x in held] + [x[1] for x in held])
    held.clear()
    nodes, at = np.unique(ends, return_inverse=True)
    x, y = np.split(at, 2)
    up = np.arange(len(nodes))
    while len(x):
        p, q = up[x], up[y]
        apart = p != q
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(up, np.maximum(p, q), np.minimum(p, q))
        while (up[up] != up).any():
            up = up[up]
    for lo in range(0, len(nodes), ROWS_PER_PART):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[lo : lo + ROWS_PER_PART]), pa.array(nodes[up[lo : lo + ROWS_PER_PART]])], ["node", "comp"])


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node for every node of an undirected edge table (a, b).

    Up to TASK_LINKS links are joined in the memory of one task. Beyond, each
    round takes the least label among a node's neighbours and then jumps
    to that label's own label; labels are written to the shared folder, so
    the loop has short lineage and needs nothing on the driver. Labels only
    get smaller: it ends after at most as many rounds as the longest shortest
    path has links, and far sooner where jumps help.
    Rows with a null end or a = b add no link.
    """
    edges = saved(edges.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")), "edges")
    if edges.count() <= TASK_LINKS:
        return saved(edges.coalesce(1).mapInArrow(_joined, "node long, comp long"), "labels")
    both = saved(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    size = both.count()
    first = narrow(both.groupBy("a").agg(F.min("b").alias("least")), size)
    labels = saved(first.select(F.col("a").alias("node"), F.least("a", "least").alias("comp")), "labels0")
    for i in itertools.count(1):
        near = narrow(both.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("other")), "b"), size).groupBy("a").agg(F.min("other").alias("other"))
        new = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("comp", "other").alias("comp"), F.col("comp").alias("was"))
        new = narrow(new, size)
        root = new.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        step = saved(narrow(new.join(root, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp"), "was"), size), f"labels{i}")
        if step.where("comp <> was").limit(1).count() == 0:
            return step.select("node", "comp")
        labels = step.select("node", "comp")
