"""Seeded random streams (PCG32), their array form, and resampling on top of them.

A stream is a linear congruential generator, so a task can jump to any draw:
word i comes from the state i steps on. Draws of a large sample are therefore
made in parallel and are the ones that a serial run makes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import RandomRefusal
from .stats import with_ordinal

MULTIPLIER = 6364136223846793005
MASK = (1 << 64) - 1
SAFE = 2**53 - 1
MAX_STREAMS = 1024
#: Rows of a place and a number that are sent to every task, some 20 MB; more meet the other side by shuffle.
TASK_ROWS = 1 << 19


def jump(state: int, increment: int, steps: int) -> int:
    """The state that many steps on, by squaring the affine map."""
    mul, add, total_mul, total_add = MULTIPLIER, increment, 1, 0
    while steps:
        if steps & 1:
            total_mul, total_add = total_mul * mul & MASK, (total_add * mul + add) & MASK
        mul, add, steps = mul * mul & MASK, (mul + 1) * add & MASK, steps >> 1
    return (state * total_mul + total_add) & MASK


class Stream:
    def __init__(self, seed: int, stream: int = 0):
        self.increment = (stream << 1 | 1) & MASK
        self.state = jump((self.increment + seed) & MASK, self.increment, 1)

    def word(self) -> int:
        old, self.state = self.state, (self.state * MULTIPLIER + self.increment) & MASK
        x, r = ((old >> 18 ^ old) >> 27) & 0xFFFFFFFF, old >> 59
        return (x >> r | x << (-r & 31)) & 0xFFFFFFFF

    def words(self, n: int) -> np.ndarray:
        """The next n words, computed by doubling."""
        s = np.empty(n, np.uint64)
        if n:
            s[0] = self.state
        done, mul, add = 1, MULTIPLIER, self.increment
        while done < n:
            k = min(done, n - done)
            s[done : done + k] = s[:k] * np.uint64(mul) + np.uint64(add)
            mul, add, done = mul * mul & MASK, (mul + 1) * add & MASK, done * 2
        self.state = jump(self.state, self.increment, n)
        x = (((s >> np.uint64(18)) ^ s) >> np.uint64(27)).astype(np.uint32)
        r = (s >> np.uint64(59)).astype(np.uint32)
        return (x >> r) | (x << ((np.uint32(32) - r) & np.uint32(31)))

    def uniform(self) -> float:
        return ((self.word() >> 5) << 26 | self.word() >> 6) / 2.0**53

    def uniforms(self, n: int) -> np.ndarray:
        w = self.words(2 * n).astype(np.uint64)
        return (((w[::2] >> np.uint64(5)) << np.uint64(26)) | (w[1::2] >> np.uint64(6))) / 2.0**53

    def integer(self, low: int, high: int) -> int:
        """low <= result < high, without bias."""
        if not (low < high and abs(low) <= SAFE and abs(high) <= SAFE):
            raise RandomRefusal("a draw needs low < high in the exact range")
        width, before = high - low, self.state
        reject = (1 << 64) % width
        for _ in range(64):
            w = self.word() << 32 | self.word()
            if w >= reject:
                return low + w % width
        self.state = before
        raise RandomRefusal("too many rejected words")

    def indices(self, n: int, size: int) -> np.ndarray:
        """n draws below size, the same as n calls of integer(0, size)."""
        before = self.state
        w = self.words(2 * n).astype(np.uint64)
        wide = (w[::2] << np.uint64(32)) | w[1::2]
        if (wide < np.uint64((1 << 64) % size)).any():
            self.state = before
            return np.array([self.integer(0, size) for _ in range(n)], np.int64)
        return (wide % np.uint64(size)).astype(np.int64)

    def normal(self) -> float:
        first, second = self.uniform(), self.uniform()
        return math.sqrt(-2.0 * math.log(1.0 - first)) * math.cos(2.0 * math.pi * second)

    def normals(self, n: int) -> list[float]:
        return [self.normal() for _ in range(n)]


class Streams:
    """The streams of a run; a stream is seeded once and never again."""

    def __init__(self):
        self.by_id: dict[int, Stream] = {}

    def seed(self, seed: int, stream: int = 0) -> None:
        if stream in self.by_id:
            raise RandomRefusal(f"stream {stream} is already seeded")
        if len(self.by_id) >= MAX_STREAMS or not (0 <= seed <= MASK and 0 <= stream <= MASK >> 1):
            raise RandomRefusal("seed, stream or number of streams out of range")
        self.by_id[stream] = Stream(seed, stream)

    def __getitem__(self, stream: int) -> Stream:
        if stream not in self.by_id:
            raise RandomRefusal(f"stream {stream} is not seeded")
        return self.by_id[stream]


def uniform_frame(spark: SparkSession, seed: int, stream: int, n: int, chunk: int = 1 << 16) -> DataFrame:
    """(i, u): n uniforms of a stream, each chunk drawn by the task that holds it."""
    start = Stream(seed, stream)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in batch.column(0).to_pylist():
                own = Stream(seed, stream)
                own.state = jump(start.state, start.increment, 2 * lo)
                k = min(chunk, n - lo)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + k)), pa.array(own.uniforms(k))], ["i", "u"])

    return spark.range(0, n, chunk).mapInArrow(run, "i long, u double")


def index_frame(spark: SparkSession, seed: int, stream: int, n: int, size: int, chunk: int = 1 << 16) -> DataFrame:
    """(i, idx): n draws below size, each chunk drawn by the task that holds it.

    A rejected word moves all later draws by one. That has a chance of size in
    2**64 a draw, so that the places of such words are few: every task gets them.
    """
    start, reject = Stream(seed, stream), (1 << 64) % size

    def words(m: int, skipped: np.ndarray) -> DataFrame:
        """The first m words as draws, numbered without those that are skipped."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in batch.column(0).to_pylist():
                    own = Stream(seed, stream)
                    own.state = jump(start.state, start.increment, 2 * lo)
                    k = min(chunk, m - lo)
                    w = own.words(2 * k).astype(np.uint64)
                    wide = (w[::2] << np.uint64(32)) | w[1::2]
                    i = np.arange(lo, lo + k)
                    yield pa.RecordBatch.from_arrays([pa.array(i - np.searchsorted(skipped, i)), pa.array((wide % np.uint64(size)).astype(np.int64)), pa.array(wide < np.uint64(reject))], ["i", "idx", "rejected"])

        return spark.range(0, m, chunk).mapInArrow(run, "i long, idx long, rejected boolean")

    m, skipped = n, np.empty(0, np.int64)
    while True:
        skipped = np.array(sorted(r["i"] for r in words(m, skipped[:0]).where("rejected").select("i").collect()), np.int64)
        if m == n + len(skipped):
            return words(m, skipped).where("not rejected").select("i", "idx")
        m = n + len(skipped)


def selections(spark: SparkSession, seed: int, stream: int, reps: int, size: int) -> DataFrame:
    """(rep, pos, idx): reps samples of size draws with replacement."""
    drawn = index_frame(spark, seed, stream, reps * size, size)
    return drawn.select(F.expr(f"i div {size}").alias("rep"), (F.col("i") % size).alias("pos"), "idx")


def _looked_up(picks: DataFrame, rows: DataFrame, sent: str) -> DataFrame:
    """picks with the row at each place; the planner takes draws for as few rows as they have chunks, so the side that is sent is set here: picks, rows or neither."""
    if sent == "rows":
        return picks.join(F.broadcast(rows), "_ord")
    return (F.broadcast(picks) if sent == "picks" else picks.hint("merge")).join(rows, "_ord")


def resample(df: DataFrame, column: str, order: str, n: int, seed: int, stream: int = 0) -> DataFrame:
    """(pos, value): n draws with replacement from the rows in this order."""
    rows = with_ordinal(df.select(order, column), order)
    size = rows.count()
    if not size:
        raise RandomRefusal("nothing to draw from")
    picks = index_frame(df.sparkSession, seed, stream, n, size).select(F.col("i").alias("pos"), F.col("idx").alias("_ord"))
    return _looked_up(picks, rows, "picks" if n <= TASK_ROWS else "neither").select("pos", F.col(column).alias("value"))


def bootstrap(df: DataFrame, column: str, order: str, reps: int, statistic: str, seed: int, stream: int = 0) -> DataFrame:
    """(rep, value): mean or median of each of reps resamples of the whole input."""
    rows = with_ordinal(df.select(order, column), order)
    size = rows.count()
    if not size:
        raise RandomRefusal("nothing to draw from")
    picks = selections(df.sparkSession, seed, stream, reps, size).select("rep", F.col("idx").alias("_ord"))
    drawn = _looked_up(picks, rows.select("_ord", column), "rows" if size <= TASK_ROWS else "neither")
    f = {"mean": F.avg, "median": F.median}[statistic]
    return drawn.groupBy("rep").agg(f(column).alias("value"))
