"""File outputs: exclusive, complete or absent; tables of any size as a folder of parts."""

from __future__ import annotations

import json
import os
import re
import tempfile
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ArtifactRefusal
from ..functions.units import Dimension, show

NULL_TEXT = "\\N"
_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,127}")


def quote(cell: str, delimiter: str) -> str:
    return '"' + cell.replace('"', '""') + '"' if any(c in cell for c in (delimiter, '"', "\n", "\r")) else cell


def publish(folder: str, name: str, chunks: Iterable[bytes], limit: int = 64 << 20) -> str:
    """Write chunks to a new file: under another name first, so that a failed run leaves none."""
    if not _NAME.fullmatch(name):
        raise ArtifactRefusal(f"file name {name!r}")
    path = os.path.join(folder, name)
    if os.path.exists(path):
        raise ArtifactRefusal(f"{path} exists")
    fd, temporary = tempfile.mkstemp(dir=folder, prefix=".partial-")
    try:
        with os.fdopen(fd, "wb") as f:
            size = 0
            for c in chunks:
                size += len(c)
                if size > limit:
                    raise ArtifactRefusal(f"{name} is larger than {limit} bytes")
                f.write(c)
            f.flush()
            os.fsync(f.fileno())
        os.link(temporary, path)
    except FileExistsError:
        raise ArtifactRefusal(f"{path} exists") from None
    finally:
        os.unlink(temporary)
    return path


def write_text(folder: str, name: str, lines: list[str]) -> str:
    return publish(folder, name, [(x + "\n").encode() for x in lines])


def _table(folder: str, name: str, columns: int, cells: list[str], delimiter: str, clean) -> str:
    if columns < 1 or len(cells) % columns:
        raise ArtifactRefusal("the cells do not fill whole rows")
    rows = (cells[i : i + columns] for i in range(0, len(cells), columns))
    return publish(folder, name, ((delimiter.join(clean(x) for x in r) + "\n").encode() for r in rows))


def write_csv(folder: str, name: str, columns: int, cells: list[str]) -> str:
    return _table(folder, name, columns, cells, ",", lambda x: quote(x, ","))


def write_tsv(folder: str, name: str, columns: int, cells: list[str]) -> str:
    """Tabs and line breaks in cells become blanks."""
    return _table(folder, name, columns, cells, "\t", lambda x: re.sub(r"[\t\r\n]", " ", x))


def write_json(folder: str, name: str, pairs: list[tuple[str, object]]) -> str:
    keys = [k for k, _ in pairs]
    if len(set(keys)) < len(keys):
        raise ArtifactRefusal("repeated keys")
    return publish(folder, name, [(json.dumps(dict(pairs), indent=2, ensure_ascii=False, allow_nan=False) + "\n").encode()])


def quantity_json(value: float, dim: Dimension) -> dict:
    return {"value_si": value, "dimension": show(dim)}


def export(df: DataFrame, folder: str, name: str, columns: list[str], delimiter: str = ",", limit: int = 64 << 20) -> str:
    """One file of the rows in the order of _ord, NULL as \\N, streamed partition by partition."""
    rows = df.orderBy("_ord").select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(NULL_TEXT)).alias(f"c{i}") for i, c in enumerate(columns)])

    def chunks():
        yield (delimiter.join(quote(c, delimiter) for c in columns) + "\n").encode()
        for r in rows.toLocalIterator(prefetchPartitions=True):
            yield (delimiter.join(quote(x, delimiter) for x in r) + "\n").encode()

    return publish(folder, name, chunks(), limit)


def write_parts(df: DataFrame, path: str, delimiter: str = ",") -> None:
    """A table of any size: parts written by the executors, complete once _SUCCESS is there."""
    df.fillna(NULL_TEXT).write.option("header", True).option("sep", delimiter).option("quote", '"').option("escape", '"').option("emptyValue", "").mode("errorifexists").csv(path)
