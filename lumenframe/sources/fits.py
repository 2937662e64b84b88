"""FITS images and binary tables, read in row or pixel ranges.

Headers are read on the driver; each partition seeks to its own range, so a
file of any size is read in parallel with bounded memory. Paths must be
visible to all executors. Variable-length, bit, complex and tile-compressed
data are laid out but refused when read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..errors import DataRefusal
from ..operators import select, stats

BLOCK = 2880
CHUNK_BYTES = 8 << 20
SAFE = 2**53 - 1
# Fixed values of the format: code, bytes per element, numpy type, Spark type.
CODES = {
    "L": (1, "u1", T.BooleanType()),
    "B": (1, "u1", T.ShortType()),
    "I": (2, ">i2", T.ShortType()),
    "J": (4, ">i4", T.IntegerType()),
    "K": (8, ">i8", T.LongType()),
    "E": (4, ">f4", T.DoubleType()),
    "D": (8, ">f8", T.DoubleType()),
    "A": (1, "S", T.StringType()),
}
UNREADABLE = {"X": 0, "C": 8, "M": 16, "P": 8, "Q": 16}


@dataclass
class Column:
    name: str
    code: str
    repeat: int
    offset: int
    width: int
    unit: str | None
    scale: float
    zero: float
    null: int | None

    @property
    def scaled(self) -> bool:
        return self.scale != 1.0 or self.zero != 0.0

    @property
    def spark_type(self):
        base = CODES[self.code][2]
        if self.scaled and self.code != "A":
            base = T.DoubleType()
        return base if self.code == "A" or self.repeat == 1 else T.ArrayType(base)


@dataclass
class Hdu:
    index: int
    kind: str
    cards: dict
    data_offset: int
    data_bytes: int
    bitpix: int
    axes: list[int]
    columns: list[Column] = field(default_factory=list)

    @property
    def rows(self) -> int:
        return self.axes[1] if self.kind == "table" else 0

    @property
    def row_bytes(self) -> int:
        return self.axes[0]

    @property
    def pixels(self) -> int:
        return math.prod(self.axes) if self.axes else 0

    def column(self, name: str) -> Column:
        found = [x for x in self.columns if x.name.lower() == name.lower()]
        if len(found) != 1:
            raise DataRefusal(f"{len(found)} columns are named {name}")
        if found[0].code in UNREADABLE:
            raise DataRefusal(f"column {name} has an unsupported format")
        return found[0]


def _card_value(text: str):
    text = text.strip()
    if text.startswith("'"):
        m = re.match(r"'((?:[^']|'')*)'", text)
        if not m:
            raise DataRefusal("a header text has no closing quote")
        return m[1].replace("''", "'").rstrip()
    text = text.split("/")[0].strip()
    if text in ("T", "F"):
        return text == "T"
    if re.fullmatch(r"[+-]?\d+", text):
        return int(text)
    if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([EDed][+-]?\d+)?", text):
        return float(text.upper().replace("D", "E"))
    return None


def _header(f, at: int, end: int) -> tuple[dict, int]:
    cards: dict = {}
    while True:
        if at + BLOCK > end:
            raise DataRefusal("a header is cut short")
        f.seek(at)
        block = f.read(BLOCK)
        at += BLOCK
        try:
            text = block.decode("ascii")
        except UnicodeDecodeError:
            raise DataRefusal("a header is not ASCII") from None
        for i in range(0, BLOCK, 80):
            card = text[i : i + 80]
            key = card[:8].strip()
            if key == "END":
                return cards, at
            if card[8:10] == "= " and key not in cards:
                cards[key] = _card_value(card[10:])


def _whole(cards: dict, key: str, default=None) -> int:
    v = cards.get(key, default)
    if not isinstance(v, int) or isinstance(v, bool):
        raise DataRefusal(f"{key} is not an integer")
    return v


def _columns(cards: dict, row_bytes: int) -> list[Column]:
    out, at = [], 0
    for i in range(1, _whole(cards, "TFIELDS", 0) + 1):
        form = cards.get(f"TFORM{i}")
        m = re.match(r"(\d*)([A-Z])", str(form).strip().upper()) if form else None
        if not m or (m[2] not in CODES and m[2] not in UNREADABLE):
            raise DataRefusal(f"column {i} has no known format")
        repeat, code = int(m[1] or 1), m[2]
        size = (repeat + 7) // 8 if code == "X" else repeat * (CODES[code][0] if code in CODES else UNREADABLE[code])
        null = cards.get(f"TNULL{i}")
        if null is not None and (not isinstance(null, int) or isinstance(null, bool)):
            raise DataRefusal(f"TNULL{i} is not an integer")
        name = (cards.get(f"TTYPE{i}") or "").strip() or f"COL{i}"
        scale, zero = float(cards.get(f"TSCAL{i}", 1.0)), float(cards.get(f"TZERO{i}", 0.0))
        out.append(Column(name, code, repeat, at, size, cards.get(f"TUNIT{i}"), scale, zero, null))
        at += size
        if at > row_bytes:
            raise DataRefusal("the columns are wider than a row")
    return out


def hdus(path: str) -> list[Hdu]:
    out: list[Hdu] = []
    with open(path, "rb") as f:
        end = f.seek(0, 2)
        at = 0
        while at < end:
            cards, data = _header(f, at, end)
            if not out and cards.get("SIMPLE") is not True:
                raise DataRefusal("the first header does not state SIMPLE = T")
            bitpix = _whole(cards, "BITPIX")
            if bitpix not in (8, 16, 32, 64, -32, -64):
                raise DataRefusal(f"BITPIX {bitpix}")
            axes = [_whole(cards, f"NAXIS{i}") for i in range(1, _whole(cards, "NAXIS") + 1)]
            if any(a < 0 for a in axes) or cards.get("GROUPS") is True:
                raise DataRefusal("negative axes and random groups are refused")
            pcount, gcount = _whole(cards, "PCOUNT", 0), _whole(cards, "GCOUNT", 1)
            size = ((math.prod(axes) if axes else 0) + pcount) * gcount * abs(bitpix) // 8
            kind = "image"
            columns: list[Column] = []
            if out:
                ext = str(cards.get("XTENSION", "")).strip().upper()
                kind = {"IMAGE": "image", "BINTABLE": "table", "TABLE": "ascii"}.get(ext, "unknown")
                if kind == "table":
                    if cards.get("ZIMAGE") is True:
                        raise DataRefusal("tile-compressed images are refused")
                    columns = _columns(cards, axes[0])
            nxt = data + -(-size // BLOCK) * BLOCK
            if nxt > end:
                raise DataRefusal(f"the data of unit {len(out)} are cut short")
            out.append(Hdu(len(out), kind, cards, data, size, bitpix, axes, columns))
            at = nxt
    if not out:
        raise DataRefusal(f"{path} has no units")
    return out


def unit(path: str, index: int, kind: str | None = None) -> Hdu:
    found = hdus(path)
    if not 0 <= index < len(found) or (kind and found[index].kind != kind):
        raise DataRefusal(f"unit {index} of {path} is not a {kind or 'unit'}")
    return found[index]


def _decode(c: Column, raw: np.ndarray) -> pa.Array:
    """Column of rows (n, row_bytes) as Arrow; nulls where the format says so."""
    part = np.ascontiguousarray(raw[:, c.offset : c.offset + c.width])
    n = len(part)
    if c.code == "A":
        texts = [bytes(x).split(b"\0")[0].rstrip(b" ") for x in part]
        return pa.array([t.decode("ascii") for t in texts], pa.string())
    values = part.reshape(-1).view(CODES[c.code][1])
    if c.code == "L":
        if not np.isin(values, np.frombuffer(b"TF?\0", np.uint8)).all():
            raise DataRefusal(f"column {c.name} has a byte that is not T, F or ?")
        flat = pa.array(values == ord("T"), mask=~np.isin(values, np.frombuffer(b"TF", np.uint8)))
    elif c.code in "ED":
        null = np.isnan(values)
        v = values.astype(np.float64) * c.scale + c.zero
        flat = pa.array(v, pa.float64(), mask=null)
    else:
        null = values == c.null if c.null is not None else np.zeros(len(values), bool)
        kind = {"B": pa.int16(), "I": pa.int16(), "J": pa.int32(), "K": pa.int64()}[c.code]
        if c.scaled:
            if c.code == "K":
                raise DataRefusal(f"column {c.name} scales 64-bit integers")
            flat = pa.array(values.astype(np.float64) * c.scale + c.zero, pa.float64(), mask=null)
        else:
            flat = pa.array(values.astype(values.dtype.newbyteorder("=")), mask=null).cast(kind)
    if c.repeat == 1:
        return flat
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * c.repeat), flat)


class _Range(InputPartition):
    def __init__(self, first: int, count: int):
        self.first, self.count = first, count


class _RangeReader(DataSourceReader):
    """Rows or pixels by number; a condition on the number narrows the ranges that are read."""

    place = "_ord"

    def _span(self, size: int, per_part: int) -> None:
        self.lo, self.hi, self.per_part = 0, size, per_part

    def pushFilters(self, filters):
        for f in filters:
            value = getattr(f, "value", None)
            whole = getattr(f, "attribute", None) == (self.place,) and isinstance(value, int) and not isinstance(value, bool)
            if whole and isinstance(f, EqualTo):
                self.lo, self.hi = max(self.lo, value), min(self.hi, value + 1)
            elif whole and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.lo = max(self.lo, value + isinstance(f, GreaterThan))
            elif whole and isinstance(f, (LessThan, LessThanOrEqual)):
                self.hi = min(self.hi, value + isinstance(f, LessThanOrEqual))
            else:
                yield f

    def partitions(self):
        return [_Range(lo, min(self.per_part, self.hi - lo)) for lo in range(self.lo, self.hi, self.per_part)] or [_Range(0, 0)]


class _TableReader(_RangeReader):
    def __init__(self, path: str, h: Hdu, columns: list[Column], schema: T.StructType, per_part: int):
        self.path, self.h, self.columns, self.names = path, h, columns, schema.names
        self._span(h.rows, per_part)

    def read(self, part):
        step = max(1, CHUNK_BYTES // max(1, self.h.row_bytes))
        with open(self.path, "rb") as f:
            for lo in range(part.first, part.first + part.count, step):
                n = min(step, part.first + part.count - lo)
                f.seek(self.h.data_offset + lo * self.h.row_bytes)
                raw = np.frombuffer(f.read(n * self.h.row_bytes), np.uint8).reshape(n, self.h.row_bytes)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + n)), *[_decode(c, raw) for c in self.columns]], self.names)


class _ImageReader(_RangeReader):
    place = "pixel_index"

    def __init__(self, path: str, h: Hdu, per_part: int):
        self.path, self.h = path, h
        self._span(h.pixels, per_part)

    def read(self, part):
        width = abs(self.h.bitpix) // 8
        kind = {8: "u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}[self.h.bitpix]
        scale, zero, blank = float(self.h.cards.get("BSCALE", 1.0)), float(self.h.cards.get("BZERO", 0.0)), self.h.cards.get("BLANK")
        step = CHUNK_BYTES // width
        with open(self.path, "rb") as f:
            for lo in range(part.first, part.first + part.count, step):
                n = min(step, part.first + part.count - lo)
                f.seek(self.h.data_offset + lo * width)
                raw = np.frombuffer(f.read(n * width), kind)
                null = np.isnan(raw) if self.h.bitpix < 0 else (raw == blank if blank is not None else np.zeros(n, bool))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + n)), pa.array(raw.astype(np.float64) * scale + zero, mask=null)], ["pixel_index", "value"])


class _Unpushed(DataSourceReader):
    """A reader for sessions that push no filters, which refuse a reader that takes them."""

    def __init__(self, reader: _RangeReader):
        self.reader = reader

    def partitions(self):
        return self.reader.partitions()

    def read(self, part):
        return self.reader.read(part)


class FitsSource(DataSource):
    """Options path, hdu, columns (tab-separated), bytes_per_partition, first and count of rows or pixels, pushdown."""

    @classmethod
    def name(cls):
        return "lumen_fits"

    def _unit(self):
        h = unit(self.options["path"], int(self.options.get("hdu", "0")))
        if h.kind not in ("table", "image"):
            raise DataRefusal(f"unit {h.index} is neither an image nor a binary table")
        wanted = self.options.get("columns")
        cols = [h.column(n) for n in (wanted.split("\t") if wanted else [c.name for c in h.columns])]
        return h, cols

    def schema(self):
        h, cols = self._unit()
        if h.kind == "image":
            return T.StructType([T.StructField("pixel_index", T.LongType(), False), T.StructField("value", T.DoubleType())])
        meta = lambda c: {"unit": c.unit or "", "scale": c.scale, "zero": c.zero}
        return T.StructType([T.StructField("_ord", T.LongType(), False), *[T.StructField(c.name, c.spark_type, True, meta(c)) for c in cols]])

    def reader(self, schema):
        h, cols = self._unit()
        size = int(self.options.get("bytes_per_partition", str(64 << 20)))
        if h.kind == "image":
            found = _ImageReader(self.options["path"], h, max(1, size * 8 // abs(h.bitpix)))
        else:
            found = _TableReader(self.options["path"], h, cols, schema, max(1, size // max(1, h.row_bytes)))
        if "first" in self.options:
            first = int(self.options["first"])
            found.lo, found.hi = max(found.lo, first), min(found.hi, first + int(self.options["count"]))
        return found if self.options.get("pushdown") == "true" else _Unpushed(found)


def cell_as_text(v) -> str:
    """Exact text of a cell: integers in full, shortest decimals, T or F, null as \\N."""
    if v is None:
        return "\\N"
    if isinstance(v, bool):
        return "T" if v else "F"
    return repr(v) if isinstance(v, float) else str(v)


def text_rows(path: str, h: Hdu, columns: list[Column]):
    """Rows of a table as texts, one chunk of rows in memory at a time."""
    reader = _TableReader(path, h, columns, T.StructType([T.StructField("_ord", T.LongType())] + [T.StructField(c.name, c.spark_type) for c in columns]), h.rows or 1)
    for batch in reader.read(_Range(0, h.rows)):
        for row in zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True):
            yield [cell_as_text(v) for v in row]


def read(spark: SparkSession, path: str, hdu: int = 0, columns: list[str] | None = None, bytes_per_partition: int = 64 << 20, only: int | None = None) -> DataFrame:
    """All rows or pixels of a unit, or the one numbered only; conditions narrow what is read if the session pushes filters."""
    spark.dataSource.register(FitsSource)
    r = spark.read.format("lumen_fits").option("path", path).option("hdu", str(hdu)).option("bytes_per_partition", str(bytes_per_partition))
    r = r.option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false").lower())
    if only is not None:
        r = r.option("first", str(only)).option("count", "1")
    return (r if columns is None else r.option("columns", "\t".join(columns))).load()


def header(path: str, key: str, hdu: int = 0):
    value = unit(path, hdu).cards.get(key.upper())
    if value is None:
        raise DataRefusal(f"no card {key}")
    return value


def axis(path: str, n: int, hdu: int = 0) -> int:
    axes = unit(path, hdu).axes
    if not 1 <= n <= len(axes):
        raise DataRefusal(f"no axis {n}")
    return axes[n - 1]


def count(path: str, hdu: int = 0) -> int:
    return unit(path, hdu, "image").pixels


def hdu_count(path: str) -> int:
    return len(hdus(path))


def rows(path: str, hdu: int) -> int:
    return unit(path, hdu, "table").rows


def columns(path: str, hdu: int) -> int:
    return len(unit(path, hdu, "table").columns)


def _one(df: DataFrame, what: str):
    found = df.take(1)
    if not found or found[0][-1] is None:
        raise DataRefusal(f"{what} has no value")
    return found[0][-1]


def pixel(spark, path: str, i: int, hdu: int = 0) -> float:
    return _one(read(spark, path, hdu, only=i), f"pixel {i}")


def mean(spark, path: str, hdu: int = 0) -> float:
    return stats.column_stats(read(spark, path, hdu), "value").first()["mean"]


def cell(spark, path: str, hdu: int, name: str, row: int, element: int | None = None):
    c = unit(path, hdu, "table").column(name)
    df = read(spark, path, hdu, [name], only=row).select(F.col(f"`{c.name}`") if element is None else F.col(f"`{c.name}`")[element])
    value = _one(df, f"{name} in row {row}")
    if isinstance(value, int) and not isinstance(value, bool) and abs(value) > SAFE:
        raise DataRefusal(f"{name} in row {row} is outside the exact range; read it as text")
    return value


def cell_text(spark, path: str, hdu: int, name: str, row: int) -> str:
    c = unit(path, hdu, "table").column(name)
    return _one(read(spark, path, hdu, [name], only=row).select(F.col(f"`{c.name}`").cast("string")), f"{name} in row {row}")


def column_stats(spark, path: str, hdu: int, name: str) -> DataFrame:
    return stats.column_stats(read(spark, path, hdu, [name]), unit(path, hdu, "table").column(name).name)


def select_stats(spark, path: str, hdu: int, selection: str, lower: float, upper: float, value: str, weight: str | None = None) -> DataFrame:
    names = list(dict.fromkeys([selection, value, *([weight] if weight else [])]))
    return select.select_stats(read(spark, path, hdu, names), selection, lower, upper, value, weight)


def info(path: str) -> list[dict]:
    return [{"hdu": h.index, "kind": h.kind, "axes": h.axes, "bitpix": h.bitpix, "rows": h.rows if h.kind == "table" else None, "columns": [c.name for c in h.columns]} for h in hdus(path)]


def select_rows(spark, path: str, hdu: int, columns: list[str], document: str | None = None) -> DataFrame:
    """(_ord, columns) of the rows that satisfy a JSON predicate."""
    h = unit(path, hdu, "table")
    used = list(dict.fromkeys([*columns, *re.findall(r'"column": "([^"]+)"', document or "")]))
    df = read(spark, path, hdu, used)
    return (df if document is None else df.filter(select.predicate(document))).select("_ord", *[f"`{h.column(c).name}`" for c in columns])
