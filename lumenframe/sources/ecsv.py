"""ECSV 1.0, the scalar subset: declared types and units, SI values on numeric reads; masks and mixins refused."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DataRefusal, UnknownName
from ..functions.units import NONE, Dimension, lookup
from .delimited import records

TYPES = {"bool": "boolean", "string": "string", **{f"int{n}": "decimal(20,0)" for n in (8, 16, 32, 64)}, **{f"uint{n}": "decimal(20,0)" for n in (8, 16, 32, 64)}, "float32": "double", "float64": "double"}
BOUNDS = {f"int{n}": (-(2 ** (n - 1)), 2 ** (n - 1) - 1) for n in (8, 16, 32, 64)} | {f"uint{n}": (0, 2**n - 1) for n in (8, 16, 32, 64)}
_FIELD = re.compile(r"\s*(\w+):\s*('[^']*'|\"[^\"]*\"|[^,{}]*)\s*(?:,|$)")


def unit_factor(text: str) -> tuple[float, Dimension]:
    """SI factor and dimension of a unit expression with products, quotients, groups and integer powers."""
    tokens = re.findall(r"\*\*|[()*/^]|[+-]?\d+|[^\W\d]+", text)
    if "".join(tokens) != re.sub(r"\s+", "", text):
        raise DataRefusal(f"unit {text!r}")
    at = 0

    def peek() -> str:
        return tokens[at] if at < len(tokens) else ""

    def product() -> tuple[float, Dimension]:
        nonlocal at
        f, d = power()
        while peek() not in ("", ")"):
            sign = 1
            if peek() in ("*", "/"):
                sign = -1 if peek() == "/" else 1
                at += 1
            g, e = power()
            f, d = f * g**sign, tuple(a + sign * b for a, b in zip(d, e, strict=True))
        return f, d

    def power() -> tuple[float, Dimension]:
        nonlocal at
        t = peek()
        at += 1
        if t == "(":
            f, d = product()
            if peek() != ")":
                raise DataRefusal(f"open group in unit {text!r}")
            at += 1
        elif t == "1":
            f, d = 1.0, NONE
        elif t and t[0].isalpha():
            try:
                f, d = lookup(t)
            except UnknownName:
                raise DataRefusal(f"unsupported unit {t!r}") from None
        else:
            raise DataRefusal(f"unit {text!r}")
        if peek() in ("**", "^") or re.fullmatch(r"[+-]?\d+", peek()):
            if peek() in ("**", "^"):
                at += 1
            if not re.fullmatch(r"[+-]?\d+", peek()):
                raise DataRefusal(f"power in unit {text!r}")
            n = int(peek())
            at += 1
            f, d = f**n, tuple(n * x for x in d)
        return f, d

    return product() if tokens else (1.0, NONE)


class Ecsv:
    """The declared columns and the text cells of one file."""

    def __init__(self, text: str):
        lines = text.splitlines(keepends=True)
        if not lines or lines[0].strip() != "# %ECSV 1.0":
            raise DataRefusal("not ECSV 1.0")
        self.columns: dict[str, dict[str, str]] = {}
        delimiter, n = " ", 1
        marker = False
        while n < len(lines) and lines[n].startswith("#"):
            s = lines[n][1:].strip()
            n += 1
            if s == "---":
                marker = True
            elif s.startswith("- "):
                fields = {k: v.strip().strip("'\"") for k, v in _FIELD.findall(s[2:].strip().removeprefix("{").removesuffix("}"))}
                if not {"name", "datatype"} <= set(fields) or set(fields) - {"name", "datatype", "unit", "description", "format"} or fields["datatype"] not in TYPES:
                    raise DataRefusal(f"unsupported column {s}")
                if fields["name"] in self.columns:
                    raise DataRefusal(f"column {fields['name']} is declared twice")
                unit_factor(fields.get("unit", ""))
                self.columns[fields["name"]] = fields
            elif s.startswith("delimiter:"):
                delimiter = s.split(":", 1)[1].strip().strip("'\"")
            elif s and s not in ("datatype:", "schema: astropy-2.0"):
                raise DataRefusal(f"unsupported header {s}")
        if not marker or delimiter not in (" ", ","):
            raise DataRefusal("the header has no marker or another delimiter")
        rows = list(records(iter(["".join(lines[n:])]), delimiter))
        if not rows or rows[0] != list(self.columns):
            raise DataRefusal("the column names do not match their declaration")
        self.rows = rows[1:]
        for i, row in enumerate(self.rows):
            if len(row) != len(self.columns):
                raise DataRefusal(f"row {i + 1} has {len(row)} cells")
            for cell, (name, c) in zip(row, self.columns.items(), strict=True):
                kind = c["datatype"]
                if kind == "bool" and cell not in ("True", "False") or kind != "string" and cell == "":
                    raise DataRefusal(f"row {i + 1} of {name} is masked or malformed")
                if kind in BOUNDS and not (re.fullmatch(r"[+-]?\d+", cell) and BOUNDS[kind][0] <= int(cell) <= BOUNDS[kind][1]):
                    raise DataRefusal(f"row {i + 1} of {name} is not {kind}")

    @classmethod
    def open(cls, path: str) -> "Ecsv":
        with open(path, "rb") as f:
            raw = f.read((16 << 20) + 1)
        if len(raw) > 16 << 20:
            raise DataRefusal("an ECSV file may have 16 MiB")
        return cls(raw.decode("utf-8"))

    def headers(self) -> list[str]:
        return list(self.columns)

    def dtype(self, name: str) -> str:
        return self._of(name)["datatype"]

    def unit(self, name: str) -> str:
        return self._of(name).get("unit", "")

    def _of(self, name: str) -> dict[str, str]:
        if name not in self.columns:
            raise DataRefusal(f"no column {name}")
        return self.columns[name]

    def frame(self, spark: SparkSession) -> DataFrame:
        """_ord and the declared columns in their own types; units stand in the metadata, values as written."""
        raw = T.StructType([T.StructField("_ord", T.LongType()), *[T.StructField(n, T.StringType()) for n in self.columns]])
        df = spark.createDataFrame([(i, *row) for i, row in enumerate(self.rows)], raw)
        return df.select("_ord", *[F.col(f"`{n}`").cast(TYPES[c["datatype"]]).alias(n, metadata={"unit": c.get("unit", ""), "datatype": c["datatype"]}) for n, c in self.columns.items()])

    def numbers(self, spark: SparkSession, name: str) -> DataFrame:
        """(_ord, value) in SI units, with the dimension in the metadata."""
        if self.dtype(name) in ("bool", "string"):
            raise DataRefusal(f"{name} is not numeric")
        factor, dim = unit_factor(self.unit(name))
        value: Column = F.col(f"`{name}`").cast("double") * factor
        return self.frame(spark).select("_ord", value.alias("value", metadata={"dim": list(dim)}))
