"""Line dedup: fuzzy lines by MinHash, one line kept per component.

A line is a part of a text between line feeds; its content is what is left
after outer white space is trimmed and A-Z lower-cased. Blank lines are not
judged. Equal contents are one node. A content's set is its distinct
``SHINGLE``-character strings; a shorter content links with equal ones only.
Contents of fewer than ``MANY`` shingles get ``BANDS`` x ``ROWS`` MinHash
values from as many functions; larger sets get them from one function, as the
least value in each of ``BINS`` ranges (sets near the bound get both kinds, so
that no pair is told apart by it). Bands of ``ROWS`` values are the list keys:
a pair at the threshold shares one with probability 0.999. Candidates
are confirmed on the exact Jaccard similarity of both lines, and components
come from a distributed union-find. The line with the smallest (doc_id, hash
of the text, line number) of a component stays.

List keys travel in blobs, dealt by the key. Members of a list that one task
already finds together need not meet again: one of them stands for all, so a
list that a third of all lines share sends one entry for each window of a task.
Contents of listed lines are read where they stand, by broadcast bits of their
hashes and a join of what these let through; whole texts are not moved.

Defined results: a row is known by its doc_id and text, so rows that share a
doc_id are judged apart, and of equal rows one only keeps judged lines; null
text has no lines and stays null, empty text stays empty; a null doc_id sorts
first; an empty table gives an empty result; columns other than doc_id and
text are carried unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c
from .linking import components, sample

SHINGLE = 8
BANDS = 14
ROWS = 4
BIN_BITS = 6
BINS = 1 << BIN_BITS
MANY = 128
NUM, DEN = 80, 100
WINDOW = 1 << 19
TRIMS = 8
#: As a power of two, most bits that tell lines which may be wanted from others (16 MB).
MARKS = 27
BLOCK = 1 << 18
_U = np.uint64
_MUL = ((c._stream(BANDS * ROWS, 61) >> _U(32)) | _U(1)).astype(np.uint32)
_FEW = -(-MANY * NUM // DEN)
_EMPTY = _U(1 << 48)


def line_spans(b: c.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number, line number) of every trimmed line that has a word."""
    newline = np.flatnonzero(b.data == 10)
    lo = np.sort(np.concatenate([b.off[:-1], newline + 1]))
    hi = np.sort(np.concatenate([newline, b.off[1:]]))
    s, e = lo.copy(), hi.copy()
    todo = np.flatnonzero(s < e)
    for _ in range(TRIMS):
        todo = todo[c.SPACE[b.data[s[todo]]]]
        s[todo] += 1
        todo = todo[s[todo] < e[todo]]
    back = np.flatnonzero(s < e)
    for _ in range(TRIMS):
        back = back[c.SPACE[b.data[e[back] - 1]]]
        e[back] -= 1
        back = back[s[back] < e[back]]
    if len(todo) or len(back):
        # more blanks than that: from the words' ends
        starts, ends, _ = c.word_spans(b)
        first, stop = np.searchsorted(starts, lo), np.searchsorted(starts, hi)
        s, e = lo.copy(), lo.copy()
        some = first < stop
        s[some], e[some] = starts[first[some]], ends[stop[some] - 1]
    worded = s < e
    s, e, lo = s[worded], e[worded], lo[worded]
    doc = np.searchsorted(b.off, s, "right") - 1
    return s, e, doc, np.searchsorted(newline, lo) - np.searchsorted(newline, b.off[:-1])[doc]


def lowered(b: c.Block) -> np.ndarray:
    return np.frombuffer(b.data.tobytes().lower(), np.uint8)


def content_ids(low: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    raw, digest = low.tobytes(), xxhash.xxh3_64_intdigest
    return np.fromiter((digest(raw[x:y]) >> 1 for x, y in zip(s.tolist(), e.tolist(), strict=True)), np.int64, len(s))


def _points(low: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code point of each character, first character of each span, character after it)."""
    if len(low) and low.max() < 128:
        return low, s, e
    upto = np.zeros(len(low) + 1, np.int64)
    np.cumsum((low & 0xC0) != 0x80, out=upto[1:])
    points = np.frombuffer(low.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    # what is not UTF-8 is taken by bytes
    return (points, upto[s], upto[e]) if len(points) == upto[-1] else (low, s, e)


def shingles(low: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): every SHINGLE-character string of each line, lines being apart; a shorter line has none."""
    points, a, z = _points(low, s, e)
    size = np.maximum(z - a - SHINGLE + 1, 0)
    bounds = np.r_[0, np.cumsum(size)]
    n = len(points) - SHINGLE + 1
    if n <= 0 or not bounds[-1]:
        return np.zeros(0, np.uint64), bounds
    # a polynomial of the characters, by doubling the width
    h, power = points.astype(np.uint64), 0x9E3779B97F4A7C15
    for width in (1, 2, 4):
        left = h[:-width] * _U(power)
        left += h[width:]
        h, power = left, power * power % (1 << 64)
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    h *= _U(0xBF58476D1CE4E5B9)
    some = size > 0
    inside = np.zeros(n + 1, np.int8)
    inside[a[some]] += 1
    np.add.at(inside, z[some] - SHINGLE + 1, -1)
    return h[np.cumsum(inside[:-1], dtype=np.int8).view(bool)], bounds


def _fold(values: np.ndarray, family: int) -> np.ndarray:
    """A key for each band of ROWS columns."""
    key = np.empty((len(values), BANDS), np.uint64)
    key[:] = np.arange(1, BANDS + 1, dtype=np.uint64) + _U(family * BANDS)
    for r in range(ROWS):
        key = c.mix64(key * _U(0x9E3779B97F4A7C15) + values[:, r : BANDS * ROWS : ROWS])
    return key


def band_keys(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, key) for every list that a line stands in; the lowest bit of a key is 0."""
    size = np.diff(bounds)
    lines, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    few = np.flatnonzero((size > 0) & (size < MANY))
    if len(few):
        h = (hashes[np.repeat((size > 0) & (size < MANY), size)] >> _U(32)).astype(np.uint32)
        start = np.r_[0, np.cumsum(size[few])[:-1]]
        values, work = np.empty((len(few), BANDS * ROWS), np.uint64), np.empty_like(h)
        for r in range(BANDS * ROWS):
            np.multiply(h, _MUL[r], out=work)
            values[:, r] = np.minimum.reduceat(work, start)
        lines.append(np.repeat(few, BANDS))
        keys.append(_fold(values, 0).ravel())
    many = np.flatnonzero(size >= _FEW)
    # 16 bits hold a line's number
    for part in np.split(many, range(1 << 16, len(many), 1 << 16)) if len(many) else []:
        packed = hashes if len(part) == len(size) else hashes[np.repeat(np.isin(np.arange(len(size)), part, assume_unique=True), size)]
        packed = packed >> _U(16)
        packed |= np.repeat(np.arange(len(part), dtype=np.uint64) << _U(48), size[part])
        packed.sort()
        place = packed >> _U(48 - BIN_BITS)
        new = np.r_[True, place[1:] != place[:-1]]
        values = np.full(len(part) * BINS, _EMPTY, np.uint64)
        values[place[new].astype(np.int64)] = packed[new] & _U((1 << 48) - 1)
        values = values.reshape(-1, BINS)
        some = (values[:, : BANDS * ROWS] != _EMPTY).reshape(-1, BANDS, ROWS).any(2).ravel()
        lines.append(np.repeat(part, BANDS)[some])
        keys.append(_fold(values, 1).ravel()[some])
    return np.concatenate(lines), np.concatenate(keys) & ~_U(1)


LINES = "_id {kind}, th long, line int, node long"


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_id, th, line, node) of each judged line, and a row with line -1 for each text."""
    for batch in batches:
        ids, th = batch.column(0), batch.column(2)
        for b in c.blocks(batch.column(1)):
            s, e, doc, line = line_spans(b)
            node = content_ids(lowered(b), s, e)
            every = np.arange(len(b))
            at = pa.array(b.rows.start + np.r_[every, doc])
            nodes = pa.array(np.r_[np.zeros(len(b), np.int64), node], mask=np.r_[np.ones(len(b), bool), np.zeros(len(s), bool)])
            yield pa.RecordBatch.from_arrays([ids.take(at), th.take(at), pa.array(np.r_[np.full(len(b), -1), line].astype(np.int32)), nodes], ["_id", "th", "line", "node"])


def _runs(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct entries in the order of key and node, the first entry of each key, and the entries of each."""
    order = np.argsort(nodes, kind="stable")
    order = order[np.argsort(keys[order], kind="stable")]
    keys, nodes = keys[order], nodes[order]
    if not len(keys):
        return order, order, order
    first = np.r_[True, keys[1:] != keys[:-1]]
    new = first | np.r_[True, nodes[1:] != nodes[:-1]]
    at = np.flatnonzero(first[new])
    return order[new], at, np.diff(np.r_[at, int(new.sum())])


def _postings(width: int):
    """(part, known, entries): list entries as blobs of (key, node), dealt to width parts.

    Of a key's nodes within one window one is sent by key, with the key's
    lowest bit set if there are others; those others are known to belong to
    a list and go anywhere.
    """

    def pack(known: bool, part: np.ndarray, keys: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(part, kind="stable")
        part, flat = part[order], np.stack([keys[order], nodes[order].view(np.uint64)], 1)
        start = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        raw, stop = flat.tobytes(), np.r_[start[1:], len(part)]
        return pa.RecordBatch.from_arrays([pa.array(part[start].astype(np.int32)), pa.array([known] * len(start)), pa.array([raw[16 * x : 16 * y] for x, y in zip(start.tolist(), stop.tolist(), strict=True)], pa.binary())], ["part", "known", "entries"])

    def flush(keys: list, nodes: list) -> Iterator[pa.RecordBatch]:
        k, v = np.concatenate(keys), np.concatenate(nodes)
        order, at, count = _runs(k, v)
        if not len(order):
            return
        k, v = k[order], v[order]
        head = np.zeros(len(k), bool)
        head[at] = True
        sent = k[at] | (count > 1).astype(np.uint64)
        yield pack(False, (sent >> _U(1)) % _U(width), sent, v[at])
        if len(at) < len(k):
            yield pack(True, np.arange(len(k) - len(at)) % width, k[~head], v[~head])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        keys, nodes, held = [], [], 0
        for batch in batches:
            for b in c.blocks(batch.column(0), BLOCK):
                s, e, _, _ = line_spans(b)
                low = lowered(b)
                node = content_ids(low, s, e)
                new = []
                for i, x in enumerate(node.tolist()):
                    if x not in seen:
                        seen.add(x)
                        new.append(i)
                if len(seen) > WINDOW:
                    seen.clear()
                if new:
                    line, key = band_keys(*shingles(low, s[new], e[new]))
                    keys.append(key)
                    nodes.append(node[new][line])
                    held += len(key)
                if held >= WINDOW:
                    yield from flush(keys, nodes)
                    keys, nodes, held = [], [], 0
        if keys:
            yield from flush(keys, nodes)

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node) of the lists with more than one node."""

    def out(keys: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array((keys >> _U(1)).astype(np.int64)), pa.array(nodes.view(np.int64))], ["key", "node"])

    held = [np.zeros((0, 2), np.uint64)]
    for batch in batches:
        for known, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            entry = np.frombuffer(raw, np.uint64).reshape(-1, 2)
            if known:
                yield out(entry[:, 0], entry[:, 1])
            else:
                held.append(entry)
    entry = np.concatenate(held)
    del held
    key, node = entry[:, 0] & ~_U(1), entry[:, 1]
    order, at, count = _runs(key, node)
    if not len(order):
        return
    # a key of one node here still is a list if some task saw others beside it
    full = np.argsort(key, kind="stable")
    flag = np.maximum.reduceat((entry[:, 0] & _U(1))[full], np.flatnonzero(np.r_[True, np.diff(key[full]) != 0]))
    keep = np.repeat((count > 1) | (flag > 0), count)
    yield out(key[order][keep], node[order][keep])


def _marks(nodes: DataFrame):
    """Broadcast bits, a bounded number, of which those that the nodes end in are set."""
    size = 1 << max(15, min(MARKS, (32 * nodes.count()).bit_length()))
    place = F.col("node").bitwiseAND(F.lit(size - 1)) + 1
    rows = nodes.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    bits = np.zeros((size >> 15, 1 << 12), np.uint8)
    for row in rows.toArrow().to_batches():
        for bucket, raw in zip(row.column(0).to_pylist(), row.column(1).to_pylist(), strict=True):
            bits[bucket - 1] = np.frombuffer(raw, np.uint8)
    return nodes.sparkSession.sparkContext.broadcast(bits.ravel())


def _texts(marks):
    """(node, content) of the lines of texts that may be wanted, once for each window of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = marks.value, set()
        for batch in batches:
            for b in c.blocks(batch.column(0)):
                s, e, _, _ = line_spans(b)
                low = lowered(b)
                node = content_ids(low, s, e)
                place = node & (8 * len(bits) - 1)
                hit = np.flatnonzero(bits[place >> 3] >> (place & 7).astype(np.uint8) & 1)
                hit = hit[np.sort(np.unique(node[hit], return_index=True)[1])]
                new = [i for i, x in zip(hit.tolist(), node[hit].tolist(), strict=True) if x not in seen]
                seen.update(node[new].tolist())
                if len(seen) > WINDOW:
                    seen.clear()
                raw = low.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(node[new]), pa.array([raw[x:y] for x, y in zip(s[new].tolist(), e[new].tolist(), strict=True)], pa.binary())], ["node", "content"])

    return run


def _spans(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of contents, with repeats, and their bounds."""
    low = np.frombuffer(b"\n".join(contents), np.uint8)
    size = np.array([len(x) for x in contents], np.int64)
    e = np.cumsum(size + 1) - 1
    return shingles(low, e - size, e)


def _distinct(packed: np.ndarray) -> np.ndarray:
    packed.sort()
    return packed[np.r_[True, packed[1:] != packed[:-1]][: len(packed)]]


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sets are similar; within a pair, 48 bits tell shingles apart."""
    for batch in batches:
        yes = [np.zeros(0, bool)]
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            sides = []
            for i in (2, 3):
                h, bounds = _spans(part.column(i).to_pylist())
                sides.append(_distinct(np.repeat(np.arange(len(part), dtype=np.uint64) << _U(48), np.diff(bounds)) | (h >> _U(16))))
            every = np.bincount((np.concatenate(sides) >> _U(48)).astype(np.int64), minlength=len(part))
            union = _distinct(np.concatenate(sides))
            union = np.bincount((union >> _U(48)).astype(np.int64), minlength=len(part))
            yes.append((every > union) & (DEN * (every - union) >= NUM * union))
        mask = pa.array(np.concatenate(yes), pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            h, bounds = _spans(batch.column(1).slice(lo, 512).to_pylist())
            level, held = zip(*[sample(np.unique(x)) for x in np.split(h >> _U(1), bounds[1:-1])], strict=True)
            nodes = [batch.column(i).slice(lo, 512) for i in (0, 2, 3)]
            yield pa.RecordBatch.from_arrays([*nodes, pa.array(level, pa.int32()), pa.array([x.view(np.int64) for x in held], pa.list_(pa.int64()))], ["node", "comp", "block", "level", "held"])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("_id"), "text", F.xxhash64("text").alias("th"))


def dropped_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, dropped): all judged lines, and (_id, th, line) of those that do not stay, rows being known by (_id, th)."""
    keyed = _keyed(docs)
    kind = keyed.schema["_id"].dataType.simpleString()
    lines = c.saved(keyed.mapInArrow(_lines, LINES.format(kind=kind)), "lines")
    width = c.shuffle_width(docs.sparkSession)
    blobs = docs.where("text is not null").select("text").mapInArrow(_postings(width), "part int, known boolean, entries binary")
    lists = c.saved(blobs.repartitionById(width, F.col("part")).mapInArrow(_meet, "key long, node long"), "postings")
    judged = lines.where("line >= 0")
    place = c.saved(judged.groupBy("node").agg(F.min(F.struct("_id", "th", "line")).alias("at"), F.count("*").alias("n")), "places")
    wanted = c.saved(lists.select("node").distinct(), "wanted")
    found = docs.where("text is not null").select("text").mapInArrow(_texts(_marks(wanted)), "node long, content binary")
    texts = c.saved(found.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "line-texts")

    def verify(pairs: DataFrame) -> DataFrame:
        ta, tb = (texts.select(F.col("node").alias(s), F.col("content").alias(f"t{s}")) for s in "ab")
        return pairs.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb").mapInArrow(_confirm, "a long, b long")

    def values(nodes: DataFrame) -> DataFrame:
        return texts.join(nodes, "node").select("node", "content", "comp", "block").mapInArrow(_samples, "node long, comp long, block long, level int, held array<long>")

    label = components(lists, verify, values, NUM, DEN)
    # a content stands for itself unless a component holds it; the first line of each component stays
    node = place.join(label, "node", "left").where("n > 1 or comp is not null").select("node", "at", F.coalesce("comp", "node").alias("comp"))
    first = node.groupBy("comp").agg(F.min("at").alias("first"))
    keeper = c.saved(node.join(first, "comp").select("node", "first"), "keepers")
    stay = F.col("_id").eqNullSafe(F.col("first._id")) & (F.col("th") == F.col("first.th")) & (F.col("line") == F.col("first.line"))
    return lines, judged.join(keeper, "node").where(~stay).select("_id", "th", "line")


def _repeats(lines: DataFrame) -> bool:
    """Whether any rows are equal in doc_id and text."""
    return lines.where("line = -1").groupBy("_id", "th").count().where("count > 1").limit(1).count() > 0


def _numbered(rows: DataFrame, repeats: bool) -> DataFrame:
    """rows with the number _copy of each among rows of equal (_id, th), from 1."""
    if not repeats:
        return rows.withColumn("_copy", F.lit(1))
    return rows.withColumn("_copy", F.row_number().over(Window.partitionBy("_id", "th").orderBy(F.lit(1))))


def kept_text(text: str, gone: set[int]) -> str:
    return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone) if gone else text


def _judged(text: str) -> list[int]:
    return [i for i, x in enumerate(text.split("\n")) if x.strip(" \t\n\v\f\r")]


def dedup_lines(docs: DataFrame) -> DataFrame:
    """(_row, _kept, n_lines, n_dropped): every row of docs with its text less the dropped lines."""
    lines, dropped = dropped_lines(docs)
    gone = dropped.distinct().groupBy("_id", "th").agg(F.collect_list("line").alias("gone")).select(F.col("_id").alias("_of"), F.col("th").alias("_th"), "gone")
    rows = docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("th"))
    rows = rows.join(gone, rows["_id"].eqNullSafe(gone["_of"]) & (rows["th"] == gone["_th"]), "left")
    rows = _numbered(rows, _repeats(lines)).select("_row", "_text", "gone", "_copy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n, m = [], [], []
            for text, lines, copy in zip(batch.column(1), batch.column(2), batch.column(3).to_pylist(), strict=True):
                raw, out = text.as_py(), set(lines.as_py() or ())
                if copy > 1 and raw is not None:
                    out = set(_judged(raw))
                kept.append(None if raw is None else kept_text(raw, out))
                n.append(0 if raw is None else raw.count("\n") + 1)
                m.append(len(out))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(m, pa.int64())], ["_row", "_kept", "n_lines", "n_dropped"])

    return rows.mapInArrow(run, T.StructType([rows.schema["_row"], T.StructField("_kept", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]))


def line_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_judged, n_dropped, dropped_lines): per row, without moving any text."""
    lines, dropped = dropped_lines(docs)
    repeats = _repeats(lines)
    judged = lines.where("line >= 0")
    if repeats:
        judged = judged.distinct()
    every = F.sort_array(F.collect_list("line")) if repeats else F.lit(None).cast("array<int>")
    judged = judged.groupBy("_id", "th").agg(F.count("*").alias("n_judged"), every.alias("every"))
    gone = dropped.distinct().groupBy("_id", "th").agg(F.sort_array(F.collect_list("line")).alias("dropped_lines"))

    def beside(rows: DataFrame, part: DataFrame) -> DataFrame:
        part = part.withColumnsRenamed({"_id": "_of", "th": "_th"})
        return rows.join(part, rows["_id"].eqNullSafe(part["_of"]) & (rows["th"] == part["_th"]), "left").drop("_of", "_th")

    out = _numbered(beside(beside(lines.where("line = -1").select("_id", "th"), judged), gone), repeats)
    dropped_lines_ = F.coalesce(F.when(F.col("_copy") > 1, F.col("every")).otherwise(F.col("dropped_lines")), F.array().cast("array<int>"))
    return out.select(F.col("_id").alias("doc_id"), F.coalesce("n_judged", F.lit(0)).alias("n_judged"), F.size(dropped_lines_).cast("long").alias("n_dropped"), dropped_lines_.cast("array<long>").alias("dropped_lines"))
