"""Spark columns of MPEG audio streams: write texts as streams, read features back.

See mpeg_audio for the format and for nulls, empty and broken streams.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import mpeg_audio as m

TRACK = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, samples long, rate long, seek_offsets array<long>, bad_checksums long, skipped long, feature string"


def to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                raw = [x.as_py() or b"" for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([m.wrap(m.pad(x)) for x in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def track_row(data: bytes | None) -> tuple:
    data = data or b""
    t = m.read(data)
    payload = t.payload
    seek = zlib.crc32(struct.pack(f"<{len(t.offsets)}Q", *t.offsets))
    ms = 1000 * t.samples // t.rate if t.rate else 0
    feature = f"frames={len(t.offsets)};table={t.table.get('frames', -1)};samples={t.samples};rate={t.rate};ms={ms};kbps={sum(t.kbps)};seek_crc={seek};bad={t.bad_checksums};skipped={t.skipped}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), t.samples, t.rate, t.offsets, t.bad_checksums, t.skipped, feature


def read_media(media: DataFrame) -> DataFrame:
    """Append what the streams in column media hold; a null stream reads as an empty one."""
    from pyspark.sql import types as T

    keep = [n for n in media.columns if n != "media"]
    src = media.select(*keep, "media")
    fields = T._parse_datatype_string(TRACK).fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            rows = [track_row(x.as_py()) for x in batch.column(len(keep))]
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.array(v, k) for v, k in zip(cols, kinds, strict=True)]], [*keep, *[f.name for f in fields]])

    return src.mapInArrow(run, T.StructType([*[media.schema[n] for n in keep], *fields]))
