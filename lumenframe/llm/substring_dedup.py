"""Suffix-array dedup: remove every byte covered by a LENGTH-byte string that also starts elsewhere.

Texts are cut at content-defined anchors: of the GRAM-byte strings in every
LENGTH-byte window the least by hash is its anchor, so equal windows have the
same anchor at the same offset. Windows whose anchor string occurs once
cannot repeat. The others are sent as snippets (all windows of one anchor),
each distinct snippet once per task, to the partition of their anchor string.
There the right contexts of the snippets form shards; each shard's
Burrows-Wheeler transform is built and the transforms are merged by
interleave refinement (module bwt). The merged order and common prefixes give
the intervals of equal right context of any length, which are joined with
equal left context to find each window that stands in two places.

Which anchor strings occur twice is kept in a bitmap of BITMAP_BITS bits with
a fixed size; a fuller bitmap lets more snippets pass but loses none.

Defined results: null text is empty; texts below LENGTH bytes keep
everything; matches never cross documents; rows with equal text share their
result and are copies of each other; an empty table gives an empty result;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bwt
from . import common as c

LENGTH = 200
GRAM = 104
WINDOWS = LENGTH - GRAM + 1
BITMAP_BITS = 27
SHARDS = 2
CHUNK = 1 << 14
SYMBOL = 25
POSITION_BITS = 28
_U = np.uint64


def anchors(b: c.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor position, anchor string's 63-bit hash) of each run of windows with one anchor."""
    n = len(b.data)
    none = np.zeros(0, np.int64)
    sized = np.flatnonzero(np.diff(b.off) >= LENGTH)
    if not len(sized):
        return none, none, none, np.zeros(0, np.uint64)
    at = np.arange(n - GRAM + 1)
    h = c.span_hashes(b.data, at, at + GRAM)
    low = (h >> _U(POSITION_BITS) << _U(POSITION_BITS)) | at.astype(np.uint64)
    span = 1
    while span * 2 <= WINDOWS:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[: len(low) - (WINDOWS - span)], low[WINDOWS - span :])
    valid = np.zeros(len(low) + 1, np.int64)
    valid[b.off[sized]] += 1
    np.add.at(valid, b.off[sized + 1] - LENGTH + 1, -1)
    start = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
    p = (low[start] & _U((1 << POSITION_BITS) - 1)).astype(np.int64)
    new = np.r_[True, (p[1:] != p[:-1]) | (start[1:] != start[:-1] + 1)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(start)] - 1
    return start[first], start[last], p[first], h[p[first]] >> _U(1)


def _distinct_texts(batch: pa.RecordBatch, seen: set[int]) -> pa.RecordBatch:
    keep = []
    for i, t in enumerate(batch.column(0).to_pylist()):
        if t not in seen:
            seen.add(t)
            keep.append(i)
    return batch if len(keep) == batch.num_rows else batch.take(pa.array(keep, pa.int64()))


def _anchor_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in batches:
        batch = _distinct_texts(batch, seen)
        for b in c.blocks(batch.column(1)):
            _, _, _, key = anchors(b)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], ["key"])


def _snippets(bitmap):
    """Occurrences (tid, lo, sid) and, at most once a flush, contents (sid, key, a, g, n, snippet)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        seen: set[int] = set()
        held: dict[int, list] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                key, a, g, n, text = zip(*held.values(), strict=True)
                yield _rows([None] * len(held), [None] * len(held), list(held), key, a, g, n, text)
                held.clear()

        for batch in batches:
            batch = _distinct_texts(batch, seen)
            tid = batch.column(0).to_numpy()
            for b in c.blocks(batch.column(1)):
                lo, hi, p, key = anchors(b)
                slot = key & _U((1 << BITMAP_BITS) - 1)
                hot = np.flatnonzero((bits[(slot >> _U(6)).astype(np.int64)] >> (slot & _U(63))) & _U(1))
                if not len(hot):
                    continue
                lo, hi, p, key = lo[hot], hi[hot], p[hot], key[hot]
                doc = np.searchsorted(b.off, lo, "right") - 1
                sid = (c.mix64(c.span_hashes(b.data, lo, hi + LENGTH) + (p - lo).astype(np.uint64)) >> _U(1)).astype(np.int64)
                raw = b.data.tobytes()
                for s, k, x, y, q in zip(sid.tolist(), key.tolist(), lo.tolist(), hi.tolist(), p.tolist(), strict=True):
                    if s in held:
                        held[s][3] += 1
                    else:
                        held[s] = [k, q - x, y - x + 1, 1, raw[x : y + LENGTH]]
                m = len(hot)
                yield _rows(tid[b.rows][doc], lo - b.off[doc], sid, *[[None] * m] * 5)
                if len(held) >= 1 << 16:
                    yield from flush()
        yield from flush()

    return run


_SNIPPET = "tid long, lo long, sid long, key long, a int, g int, n long, snippet binary"


def _rows(*cols) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in _SNIPPET.split(", ")])


def _repeated(values: np.ndarray) -> np.ndarray:
    order = np.argsort(values)
    s = values[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    out = np.empty(len(s), bool)
    out[order] = same[1:] | same[:-1]
    return out


def repeated_windows(text: np.ndarray, a: np.ndarray, g: np.ndarray, shards: int = SHARDS) -> np.ndarray:
    """Flags (snippet, window) of the windows that another snippet also holds.

    Row i of text is a snippet padded with zeros; its windows start at 0 to
    g[i] - 1 and its anchor at a[i].
    """
    count = len(a)
    out = np.zeros((count, WINDOWS), bool)
    if count < 2:
        return out
    need = LENGTH - (a - g + 1)
    right = np.zeros((count, LENGTH), np.uint8)
    for x in np.unique(a):
        mine = a == x
        right[mine] = text[mine, x : x + LENGTH]
    right[np.arange(LENGTH) >= need[:, None]] = 0
    _, words = np.unique(np.ascontiguousarray(right).view(f"S{SYMBOL}"), return_inverse=True)
    words = words.reshape(count, LENGTH // SYMBOL) + 1
    cuts = np.array_split(np.arange(count), min(shards, count))
    merged = bwt.build(words[cuts[0]], cuts[0])
    for part in [*cuts[1:]] or [np.zeros(0, np.int64)]:
        merged = bwt.merge(merged, bwt.build(words[part], part))
    order, symbols = bwt.first_suffixes(merged)
    differ = np.minimum(symbols, LENGTH // SYMBOL - 1)
    x, y = right[order[:-1]], right[order[1:]]
    at = differ[1:, None] * SYMBOL + np.arange(SYMBOL)
    unlike = np.take_along_axis(x, at, 1) != np.take_along_axis(y, at, 1)
    shared = np.where(unlike.any(1), differ[1:] * SYMBOL + unlike.argmax(1), LENGTH)
    # A shorter right context is filled up and may stand between two equal longer ones; what lies between rows
    # that agree in their first bytes agrees in them too, so the filled-up rows' common bytes part no interval wrongly.
    place = np.empty(count, np.int64)
    place[order] = np.arange(count)
    left = np.full(count, 1, np.uint64)
    every = np.arange(count)
    for o in range(int(a.max()) + 1):
        if o:
            far = every[a >= o]
            left[far] = c.mix64(left[far] * _U(0x9E3779B97F4A7C15) + text[far, a[far] - o].astype(np.uint64) + _U(1))
        live = every[(a >= o) & (a - g + 1 <= o)]
        if len(live) < 2:
            continue
        interval = np.r_[0, np.cumsum(shared < LENGTH - o)][place[live]].astype(np.uint64)
        both = _repeated(left[live] ^ c.mix64(interval + _U(0x2545F4914F6CDD1D)))
        hit = live[both]
        out[hit, a[hit] - o] = True
    return out


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sid, flags) of snippets with a repeated window; rows come sorted by key, then sid."""

    def finish(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        by_sid: dict[int, list] = {}
        for sid, _, a, g, n, text in rows:
            if sid in by_sid:
                by_sid[sid][0] += n
            else:
                by_sid[sid] = [n, a, g, text]
        sids = list(by_sid)
        n, a, g = (np.array([by_sid[s][j] for s in sids], np.int64) for j in range(3))
        text = np.zeros((len(sids), 2 * LENGTH), np.uint8)
        sizes = np.array([len(by_sid[s][3]) for s in sids])
        flat = np.frombuffer(b"".join(by_sid[s][3] for s in sids), np.uint8)
        text[np.arange(2 * LENGTH) < sizes[:, None]] = flat
        flags = repeated_windows(text, a, g)
        flags |= (n > 1)[:, None]
        flags &= np.arange(WINDOWS) < g[:, None]
        some = np.flatnonzero(flags.any(1))
        bits = np.packbits(flags, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array([sids[i] for i in some], pa.int64()), pa.array([bits[i].tobytes() for i in some], pa.binary())], ["sid", "flags"])

    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
            if len(rows) >= CHUNK and row[1] != rows[-1][1]:
                yield from finish(rows)
                rows = []
            rows.append(row)
    if rows:
        yield from finish(rows)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(tid, copies, windows): for each text with a repeated window, by xxhash64 of the text."""
    spark = docs.sparkSession
    texts = docs.where("text is not null").select(F.xxhash64("text").alias("tid"), F.col("text").cast("binary").alias("text"))
    copies = texts.groupBy("tid").agg(F.count("*").alias("copies")).where("copies > 1")
    keys = texts.mapInArrow(_anchor_keys, "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    slot = F.col("key").bitwiseAND((1 << BITMAP_BITS) - 1)
    # slots wrap to 64-bit words; at most 2**(BITMAP_BITS - 6) rows come back
    table = keys.select(F.shiftright(slot, 6).alias("word"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("bit"))
    table = table.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    bits[table.column("word").to_numpy()] = table.column("bits").to_numpy()
    found = c.saved(texts.mapInArrow(_snippets(spark.sparkContext.broadcast(bits.view(np.uint64))), _SNIPPET), "snippets")
    contents = found.where("snippet is not null").select("sid", "key", "a", "g", "n", "snippet")
    judged = contents.repartition(c.shuffle_width(spark), "key").sortWithinPartitions("key", "sid").mapInArrow(_judge, "sid long, flags binary")
    windows = found.where("snippet is null").select("tid", "lo", "sid").join(judged, "sid").groupBy("tid").agg(F.collect_set(F.struct("lo", "flags")).alias("windows"))
    return c.saved(windows.join(copies, "tid", "full_outer").select("tid", F.coalesce("copies", F.lit(1)).alias("copies"), "windows"), "repeats")


def removed(size: int, copies: int | None, windows: list | None) -> list[tuple[int, int]]:
    """Maximal removed runs [start, end) of a text of this many bytes."""
    if size < LENGTH or copies is None:
        return []
    if copies > 1:
        return [(0, size)]
    change = np.zeros(size + 1, np.int32)
    for w in windows or ():
        at = w["lo"] + np.flatnonzero(np.unpackbits(np.frombuffer(w["flags"], np.uint8)))
        np.add.at(change, at, 1)
        np.add.at(change, at + LENGTH, -1)
    cover = np.r_[False, np.cumsum(change[:-1]) > 0, False]
    edge = np.flatnonzero(cover[1:] != cover[:-1])
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def with_spans(docs: DataFrame) -> DataFrame:
    """Every row of docs as struct _row, with its text as bytes in _text and its repeats."""
    spans = repeated_spans(docs)
    rows = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("_text"), F.xxhash64("text").alias("tid"))
    return rows.join(spans, "tid", "left").select("_row", "_text", F.col("copies").cast("long"), "windows")


def cut(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for lo, hi in runs:
        kept.append(text[at:lo])
        at = hi
    kept.append(text[at:])
    return b"".join(kept)


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, copies, windows in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3), strict=True):
                raw = text.as_py()
                runs = removed(len(raw), copies, windows.as_py())
                rows.append((len(raw), sum(h - l for l, h in runs), len(runs), hashlib.sha256(cut(raw, runs)).hexdigest()))
            n, r, s, k = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(s, pa.int64()), pa.array(k, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = with_spans(docs.select("doc_id", "text")).select("_row.doc_id", "_text", "copies", "windows")
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cleaned(docs: DataFrame) -> DataFrame:
    """(_row, _kept): each row with its text less the removed runs; characters cut in half go too; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, copies, windows in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3), strict=True):
                raw = text.as_py()
                runs = removed(len(raw), copies, windows.as_py())
                out.append(cut(raw, runs).decode("utf-8", "ignore" if runs else "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["_row", "_kept"])

    from pyspark.sql import types as T

    rows = with_spans(docs)
    kept = rows.mapInArrow(run, T.StructType([rows.schema["_row"], T.StructField("_kept", T.StringType())]))
    return kept.withColumn("_kept", F.when(F.col("_row.text").isNotNull(), F.col("_kept")))
