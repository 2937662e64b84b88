"""Packing: token pieces laid into fixed-length sequences, shortest pack first over the length histogram.

Every text is tokenised once; its ids and one closing id are cut into pieces
of at most ``width`` ids. Only the histogram of piece lengths (at most
``width`` counters) goes to the driver, where lengths are placed longest
first, always into the packs with the fewest ids so far; packs of one pattern
are handled as one group with a count. What results are placement ranges
(length, first rank, count, first sequence, offset). Pieces get a rank among
those of their length from bucket counts, so that no length is ranked in one
task, and find their range by binary search.

Defined results: null or empty text is the closing id alone; repeated rows
are packed as often as they occur; an empty table gives an empty result;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

WIDTH = 2048
RANK_BUCKETS = 1024
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Texts outside this plain range, or that may spell a special token, take the reference tokenizer.
_ODD = re.compile("[^\t\n\r\x20-\x7e¡-ɏ‐-‧€]|<\\|")


@lru_cache(4)
def _reference(name: str):
    import os

    import public_tokenizers as p
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(p.path(name))


@lru_cache(4)
def _twin(name: str):
    """The faster library with the same vocabulary, if there is a file for it."""
    import os

    import public_tokenizers as p

    twin = p.path(name.removesuffix(".json") + ".tiktoken")
    if not os.path.exists(twin):
        return None
    import base64

    import tiktoken

    with open(twin, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("twin", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, tokenizer: str) -> list[int]:
    """Ids as tokenizers gives them without added special tokens.

    Plain Latin text goes through the faster library that holds the same
    vocabulary; any other text through tokenizers itself.
    """
    if _ODD.search(text) or _twin(tokenizer) is None:
        return _reference(tokenizer).encode(text, add_special_tokens=False).ids
    return _twin(tokenizer).encode_ordinary(text)


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, width: int = WIDTH) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or "", tokenizer), end_id], "<u4")
                for at in range(0, len(ids), width):
                    part = ids[at : at + width]
                    out.append((doc_id, at, len(part), zlib.crc32(part.tobytes()), len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 5, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def place(histogram: dict[int, int], width: int = WIDTH) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, count, first sequence, offset) ranges that place every piece once."""
    by_room: list[list[tuple[int, int]]] = [[] for _ in range(width + 1)]
    out: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        room = width
        while left:
            while room >= length and not by_room[room]:
                room -= 1
            if room < length:
                first, count = sequences, left
                sequences += count
                group_room = width
            else:
                first, count = by_room[room].pop()
                group_room = room
                if count > left:
                    by_room[room].append((first + left, count - left))
                    count = left
            out.append((length, rank, count, first, width - group_room))
            if group_room > length:
                by_room[group_room - length].append((first, count))
                # what was just filled may still be the emptiest pack
                room = max(room, group_room - length)
            rank += count
            left -= count
    return out


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 1, width: int = WIDTH) -> DataFrame:
    """Pieces of docs(doc_id, text) with sequence_id and offset."""
    spark = docs.sparkSession
    cut = c.saved(pieces(docs, tokenizer, end_id, width), "pieces").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(RANK_BUCKETS)))
    counts = cut.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = c.saved(counts.withColumn("before", F.coalesce(before, F.lit(0))), "ranks")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    ranges = np.array(place(histogram, width), np.int64).reshape(-1, 5)
    ranges = ranges[np.lexsort((ranges[:, 1], ranges[:, 0]))]
    shared = spark.sparkContext.broadcast((ranges[:, 0] * (1 << 42) + ranges[:, 1], ranges[:, 1], ranges[:, 3], ranges[:, 4]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first_rank, first_seq, offset = shared.value
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(k)).to_numpy() for k in ("length", "rank"))
            at = np.searchsorted(keys, length * (1 << 42) + rank, "right") - 1
            seq = first_seq[at] + rank - first_rank[at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(offset[at])], [*batch.schema.names[:5], "sequence_id", "offset"])

    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32"))
    ranked = cut.withColumn("inside", inside).join(counts, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("inside") - 1)
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("rank").cast("long")).mapInArrow(run, PIECES + ", sequence_id long, offset long")
