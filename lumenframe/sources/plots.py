"""Line, scatter and histogram plots as deterministic SVG or PNG, by the file's name.

The exact data stand in a JSON sidecar, and their digest in the image itself
(metadata of an SVG, a text chunk of a PNG), so that an image tells which
data it shows.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DataRefusal
from ..operators import stats
from .sinks import publish

WIDTH, HEIGHT, MARGIN = 640, 400, 56
MAX_POINTS = 100_000


def _scale(lo: float, hi: float, a: float, b: float):
    span = hi - lo or 1.0
    return lambda v: round(a + (v - lo) / span * (b - a), 2)


def _svg(shapes: list[tuple], title: str, xl: str, yl: str, xb, yb, provenance: str) -> bytes:
    e = html.escape
    text = lambda x, y, s, anchor="middle": f'<text x="{x}" y="{y}" font-size="12" text-anchor="{anchor}">{e(s)}</text>'
    body = []
    for kind, *v in shapes:
        if kind == "path":
            body.append('<polyline fill="none" stroke="black" points="' + " ".join(f"{a},{b}" for a, b in v[0]) + '"/>')
        elif kind == "dot":
            body.append(f'<circle cx="{v[0]}" cy="{v[1]}" r="2"/>')
        else:
            body.append(f'<rect x="{v[0]}" y="{v[1]}" width="{v[2]}" height="{v[3]}" fill="grey" stroke="black"/>')
    parts = [
        f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{HEIGHT}" viewBox="0 0 {WIDTH} {HEIGHT}">',
        f"<metadata>{e(provenance)}</metadata>",
        f'<rect width="{WIDTH}" height="{HEIGHT}" fill="white"/>',
        f'<path d="M{MARGIN} {MARGIN}V{HEIGHT - MARGIN}H{WIDTH - MARGIN}" fill="none" stroke="black"/>',
        text(WIDTH // 2, 24, title), text(WIDTH // 2, HEIGHT - 12, xl), text(8, 40, yl, "start"),
        text(MARGIN, HEIGHT - 36, f"{xb[0]:g}"), text(WIDTH - MARGIN, HEIGHT - 36, f"{xb[1]:g}"),
        text(MARGIN - 4, HEIGHT - MARGIN, f"{yb[0]:g}", "end"), text(MARGIN - 4, MARGIN, f"{yb[1]:g}", "end"),
        *body, "</svg>",
    ]
    return ("\n".join(parts) + "\n").encode()


def _stroke(canvas: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> None:
    n = int(max(abs(x1 - x0), abs(y1 - y0))) + 2
    canvas[np.rint(np.linspace(y0, y1, n)).astype(int), np.rint(np.linspace(x0, x1, n)).astype(int)] = 0


def _png(shapes: list[tuple], title: str, xl: str, yl: str, xb, yb, provenance: str) -> bytes:
    """A grey-scale image; its words stand in text chunks."""
    canvas = np.full((HEIGHT, WIDTH), 255, np.uint8)
    _stroke(canvas, MARGIN, MARGIN, MARGIN, HEIGHT - MARGIN)
    _stroke(canvas, MARGIN, HEIGHT - MARGIN, WIDTH - MARGIN, HEIGHT - MARGIN)
    for kind, *v in shapes:
        if kind == "path":
            for a, b in zip(v[0], v[0][1:], strict=False):
                _stroke(canvas, *a, *b)
        elif kind == "dot":
            x, y = round(v[0]), round(v[1])
            canvas[y - 1 : y + 2, x - 2 : x + 3] = 0
            canvas[y - 2 : y + 3, x - 1 : x + 2] = 0
        else:
            x, y, w, h = (round(t) for t in v)
            canvas[y : y + h + 1, x : x + w + 1] = 128
            for c in ((x, y, x + w, y), (x, y, x, y + h), (x + w, y, x + w, y + h)):
                _stroke(canvas, *c)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    words = {"Title": title, "Description": f"{xl} {xb[0]:g} to {xb[1]:g}; {yl} {yb[0]:g} to {yb[1]:g}", "Source": provenance}
    rows = np.concatenate([np.zeros((HEIGHT, 1), np.uint8), canvas], 1).tobytes()
    texts = b"".join(chunk(b"iTXt", k.encode() + b"\0\0\0\0\0" + v.encode()) for k, v in words.items())
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, HEIGHT, 8, 0, 0, 0, 0)) + texts + chunk(b"IDAT", zlib.compress(rows, 9)) + chunk(b"IEND", b"")


def bits(values: list[float]) -> list[str]:
    return [struct.pack(">d", float(v)).hex() for v in values]


def _write(folder: str, name: str, shapes: list[tuple], title: str, xl: str, yl: str, xb, yb, data: dict) -> str:
    """The image, whose data's digest it carries, and the data beside it."""
    digest = hashlib.sha256(json.dumps(data, sort_keys=True).encode()).hexdigest()
    draw = _png if name.endswith(".png") else _svg
    image = draw(shapes, title, xl, yl, xb, yb, json.dumps({"data_sha256": digest, "kind": data["kind"]}, sort_keys=True))
    path = publish(folder, name, [image])
    publish(folder, name + ".json", [(json.dumps(data | {"data_sha256": digest, "image_sha256": hashlib.sha256(image).hexdigest()}, indent=2, sort_keys=True) + "\n").encode()])
    return path


def provenance(path: str) -> dict:
    """What an image says of its data; refuses one that says nothing or whose data beside it are others."""
    with open(path, "rb") as f:
        raw = f.read()
    found = re.search(rb"Source\0\0\0\0\0({.*?})" if raw[:4] == b"\x89PNG" else rb"<metadata>(.*?)</metadata>", raw, re.DOTALL)
    if not found:
        raise DataRefusal(f"{path} carries no provenance")
    told = json.loads(html.unescape(found[1].decode()))
    with open(path + ".json", encoding="utf-8") as f:
        data = json.load(f)
    body = {k: v for k, v in data.items() if k not in ("data_sha256", "image_sha256")}
    if told["data_sha256"] != hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest():
        raise DataRefusal(f"{path} shows other data than those beside it")
    return told


def _points(kind: str, folder: str, name: str, x: list[float], y: list[float], title: str, xl: str, yl: str) -> str:
    if len(x) != len(y) or not x or len(x) > MAX_POINTS:
        raise DataRefusal("a plot needs two equal, non-empty arrays of at most 100000 points")
    xb, yb = (min(x), max(x)), (min(y), max(y))
    sx, sy = _scale(*xb, MARGIN, WIDTH - MARGIN), _scale(*yb, HEIGHT - MARGIN, MARGIN)
    at = [(sx(a), sy(b)) for a, b in zip(x, y, strict=True)]
    shapes = [("path", at)] if kind == "line" else [("dot", a, b) for a, b in at]
    return _write(folder, name, shapes, title, xl, yl, xb, yb, {"kind": kind, "x_bits": bits(x), "y_bits": bits(y), "title": title})


def line(folder, name, x, y, title, xl, yl) -> str:
    return _points("line", folder, name, x, y, title, xl, yl)


def scatter(folder, name, x, y, title, xl, yl) -> str:
    return _points("scatter", folder, name, x, y, title, xl, yl)


def histogram(df: DataFrame, column: str, bins: int, folder: str, name: str, title: str, xl: str, constant_middle: bool = False) -> str:
    """Bins are counted in Spark; only their counts come to the driver."""
    counts = [r["n"] for r in stats.histogram(df, column, bins, constant_middle).orderBy("bin").collect()]
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    xb, yb = (float(ends["lo"]), float(ends["hi"])), (0.0, float(max(counts)))
    w = (WIDTH - 2 * MARGIN) / bins
    sy = _scale(*yb, HEIGHT - MARGIN, MARGIN)
    shapes = [("bar", round(MARGIN + i * w, 2), sy(n), round(w, 2), round(HEIGHT - MARGIN - sy(n), 2)) for i, n in enumerate(counts)]
    return _write(folder, name, shapes, title, xl, "count", xb, yb, {"kind": "histogram", "counts": counts, "ends_bits": bits(list(xb)), "title": title})


def sampled_scatter(df: DataFrame, x: str, y: str, count: int, folder: str, name: str, title: str) -> str:
    """Scatter of an even sample of the rows, by _ord, in which both values are there."""
    if count > MAX_POINTS:
        raise DataRefusal("at most 100000 points")
    rows = stats.even_rows(df.select("_ord", x, y), count).where(F.col(x).isNotNull() & F.col(y).isNotNull()).orderBy("_ord").collect()
    return scatter(folder, name, [float(r[x]) for r in rows], [float(r[y]) for r in rows], title, x, y)


def fits_histogram(spark, path: str, hdu: int, column: str, bins: int, count: int, folder: str, name: str, title: str) -> str:
    """Histogram of an even sample of a table's rows; a constant sample lands in the middle bin."""
    from . import fits

    rows = stats.even_rows(fits.read(spark, path, hdu, [column]), count)
    label = fits.unit(path, hdu, "table").column(column).name
    return histogram(rows.where(F.col(f"`{label}`").isNotNull()), label, bins, folder, name, title, label, constant_middle=True)


def fits_scatter(spark, path: str, hdu: int, x: str, y: str, count: int, folder: str, name: str, title: str) -> str:
    from . import fits

    h = fits.unit(path, hdu, "table")
    return sampled_scatter(fits.read(spark, path, hdu, [x, y]), h.column(x).name, h.column(y).name, count, folder, name, title)
