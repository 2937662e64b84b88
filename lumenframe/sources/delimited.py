"""Strict CSV and TSV: every cell is text, and anything ambiguous is refused.

A quote must wrap a whole field, lines end in LF or CRLF, NUL and invalid
UTF-8 are refused, headers are unique and not empty, and each record has as
many cells as the header. A table is one file or a folder of files with the
same header; each file is one partition, parsed record by record, so memory
does not grow with the file. Paths must be visible to all executors.
"""

from __future__ import annotations

import codecs
import glob
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import DataRefusal
from ..functions.text import parse_number
from ..operators import stats

MAX_COLUMNS = 1024
MAX_RECORD = 1 << 20
CHUNK = 1 << 16


def characters(path: str) -> Iterator[str]:
    """Decoded text in chunks, without a leading byte order mark."""
    decoder, first = codecs.getincrementaldecoder("utf-8")("strict"), True
    with open(path, "rb") as f:
        try:
            while raw := f.read(CHUNK):
                text = decoder.decode(raw)
                if first and text:
                    text, first = text.removeprefix("﻿"), False
                yield text
            yield decoder.decode(b"", True)
        except UnicodeDecodeError:
            raise DataRefusal(f"{path} is not UTF-8") from None


def records(chunks: Iterator[str], delimiter: str) -> Iterator[list[str]]:
    """Records of a delimited text, by a state machine over its characters."""
    row: list[str] = []
    cell: list[str] = []
    state, size, n, pending_cr = "start", 0, 0, False
    for chunk in chunks:
        for ch in chunk:
            size += 1
            if size > MAX_RECORD:
                raise DataRefusal(f"record {n + 1} is longer than {MAX_RECORD} characters")
            if ch == "\0":
                raise DataRefusal(f"NUL in record {n + 1}")
            if state == "quoted":
                if ch == '"':
                    state = "closed"
                else:
                    cell.append(ch)
                continue
            if pending_cr and ch != "\n":
                raise DataRefusal(f"carriage return without line feed in record {n + 1}")
            if ch == '"':
                if state == "closed":
                    cell.append('"')
                    state = "quoted"
                elif state == "start":
                    state = "quoted"
                else:
                    raise DataRefusal(f"quote inside an open field in record {n + 1}")
            elif ch == delimiter:
                row.append("".join(cell))
                cell, state = [], "start"
            elif ch == "\r":
                pending_cr = True
            elif ch == "\n":
                row.append("".join(cell))
                yield row
                row, cell, state, size, n, pending_cr = [], [], "start", 0, n + 1, False
            elif state == "closed":
                raise DataRefusal(f"text after a closing quote in record {n + 1}")
            else:
                cell.append(ch)
                state = "open"
    if state == "quoted":
        raise DataRefusal(f"record {n + 1} has an open quote")
    if pending_cr:
        raise DataRefusal(f"carriage return without line feed in record {n + 1}")
    if row or cell or state != "start":
        row.append("".join(cell))
        yield row


def header_of(path: str, delimiter: str) -> list[str]:
    head = next(records(characters(path), delimiter), None)
    if head is None:
        raise DataRefusal(f"{path} has no header")
    if len(head) > MAX_COLUMNS or "" in head or len(set(head)) < len(head):
        raise DataRefusal(f"the header of {path} is empty, repeated or too wide")
    return head


def files_of(path: str) -> list[str]:
    found = sorted(p for p in glob.glob(os.path.join(path, "*")) if os.path.isfile(p) and not os.path.basename(p).startswith((".", "_"))) if os.path.isdir(path) else [path]
    for p in found:
        if os.path.islink(p) or not os.path.isfile(p):
            raise DataRefusal(f"{p} is not an ordinary file")
    if not found:
        raise DataRefusal(f"{path} has no files")
    return found


class _File(InputPartition):
    def __init__(self, index: int, path: str):
        self.index, self.path = index, path


class _Reader(DataSourceReader):
    def __init__(self, paths, delimiter, head, columns):
        self.paths, self.delimiter, self.head, self.columns = paths, delimiter, head, columns

    def partitions(self):
        return [_File(i, p) for i, p in enumerate(self.paths)]

    def read(self, part):
        at = [self.head.index(c) for c in self.columns]
        rows = records(characters(part.path), self.delimiter)
        if next(rows, None) != self.head:
            raise DataRefusal(f"{part.path} has another header")
        for i, row in enumerate(rows):
            if len(row) != len(self.head):
                raise DataRefusal(f"row {i + 1} of {part.path} has {len(row)} cells, not {len(self.head)}")
            yield ((part.index << 40) + i, *[row[j] for j in at])


class DelimitedSource(DataSource):
    """Options path, delimiter, and columns (a tab-separated list) for projection before the rows leave Python."""

    @classmethod
    def name(cls):
        return "lumen_delimited"

    def _parts(self):
        delimiter = self.options.get("delimiter", ",")
        paths = files_of(self.options["path"])
        head = header_of(paths[0], delimiter)
        wanted = self.options.get("columns")
        columns = head if wanted is None else wanted.split("\t")
        for name in columns:
            if name not in head:
                raise DataRefusal(f"no column {name}")
        return paths, delimiter, head, columns

    def schema(self):
        return T.StructType([T.StructField("_ord", T.LongType(), False), *[T.StructField(c, T.StringType(), False) for c in self._parts()[3]]])

    def reader(self, schema):
        return _Reader(*self._parts())


def read(spark: SparkSession, path: str, delimiter: str = ",", columns: list[str] | None = None) -> DataFrame:
    """_ord and the text columns; _ord orders the rows by file, then place."""
    spark.dataSource.register(DelimitedSource)
    r = spark.read.format("lumen_delimited").option("path", path).option("delimiter", delimiter)
    return (r if columns is None else r.option("columns", "\t".join(columns))).load()


def rows(spark, path, delimiter=",") -> int:
    return read(spark, path, delimiter).count()


def columns(path, delimiter=",") -> int:
    return len(header_of(files_of(path)[0], delimiter))


def headers(path, delimiter=",") -> list[str]:
    return header_of(files_of(path)[0], delimiter)


def column(spark, path, name, delimiter=",") -> DataFrame:
    return read(spark, path, delimiter, [name])


def numbers(spark, path, name, delimiter=",") -> DataFrame:
    """(_ord, value); the first cell that is not a number is refused with its row when the rows are used."""
    return column(spark, path, name, delimiter).select("_ord", parse_number(name).alias("value"))


def scan_stats(spark, path, name, delimiter=",") -> DataFrame:
    return stats.scan_stats(numbers(spark, path, name, delimiter), "value")
