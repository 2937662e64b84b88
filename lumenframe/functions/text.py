"""Text functions as Columns; bad input raises where Spark would return NULL or guess."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DataRefusal
from .guards import col, guard, let

SAFE = 2**53 - 1
_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_DIGITS = {2: "[01]", 8: "[0-7]", 10: "[0-9]", 16: "[0-9a-fA-F]"}


def str_trim(s) -> Column:
    return F.regexp_replace(col(s), r"(?U)^\s+|\s+$", "")


def str_contains(s, part: str) -> Column:
    return F.contains(col(s), F.lit(part))


def str_replace(s, old: str, new: str) -> Column:
    if old == "":
        raise DataRefusal("an empty search text")
    return F.replace(col(s), F.lit(old), F.lit(new))


def str_split(s, separator: str) -> Column:
    if separator == "":
        raise DataRefusal("an empty separator")
    return F.split(col(s), re.escape(separator), -1)


def str_join(separator: str, parts) -> Column:
    return F.array_join(col(parts), separator)


def str_upper(s) -> Column:
    return F.upper(col(s))


def str_lower(s) -> Column:
    return F.lower(col(s))


def str_len(s) -> Column:
    return F.char_length(col(s))


def str_bytes_len(s) -> Column:
    return F.octet_length(col(s))


def str_compare(a, b) -> Column:
    a, b = col(a), col(b)
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def _byte_groups(s, base: int, width: int) -> Column:
    """UTF-8 bytes of s, each as width digits in base."""
    none = F.array().cast("array<int>")

    def groups(code: Column) -> Column:
        pairs = F.when(F.length(code) > 0, F.sequence(F.lit(1), F.length(code) - 1, F.lit(2))).otherwise(none)
        return F.array_join(F.transform(pairs, lambda i: F.lpad(F.conv(F.substring(code, i, F.lit(2)), 16, base), width, "0")), "")

    return let(F.hex(F.encode(col(s), "UTF-8")), groups)


def str_to_hex(s) -> Column:
    return F.lower(F.hex(F.encode(col(s), "UTF-8")))


def str_to_octal(s) -> Column:
    return _byte_groups(s, 8, 3)


def str_to_binary(s) -> Column:
    return _byte_groups(s, 2, 8)


def _from_groups(s, base: int, width: int, pattern: str, name: str) -> Column:
    none = F.array().cast("array<int>")

    def plain(t: Column) -> Column:
        at = F.when(F.length(t) > 0, F.sequence(F.lit(1), F.length(t) - width + 1, F.lit(width))).otherwise(none)
        code = F.array_join(F.transform(at, lambda i: F.lpad(F.conv(F.substring(t, i, F.lit(width)), base, 16), 2, "0")), "")
        return F.decode(F.unhex(code), "UTF-8")

    return let(col(s), lambda s: let(guard(s, s.rlike(pattern), f"G601: {name} needs whole byte groups"), plain))


def str_from_hex(s) -> Column:
    s = col(s)
    return F.decode(F.unhex(guard(s, s.rlike("^([0-9a-fA-F]{2})*$"), "G601: hexadecimal text needs whole byte groups")), "UTF-8")


def str_from_octal(s) -> Column:
    return _from_groups(s, 8, 3, "^([0-3][0-7]{2})*$", "octal text")


def str_from_binary(s) -> Column:
    return _from_groups(s, 2, 8, "^([01]{8})*$", "binary text")


def str_to_b64(s) -> Column:
    return F.replace(F.base64(F.encode(col(s), "UTF-8")), F.lit("\r\n"), F.lit(""))


def str_from_b64(s) -> Column:
    """Canonical base64 only: decoding and encoding again gives the same text."""
    form = r"^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"

    def checked(s: Column) -> Column:
        raw = F.unbase64(guard(s, s.rlike(form), "G601: base64 text is malformed"))
        return let(raw, lambda r: guard(F.decode(r, "UTF-8"), F.replace(F.base64(r), F.lit("\r\n"), F.lit("")) == s, "G601: base64 text is not canonical"))

    return let(col(s), checked)


def to_base(n, base: int) -> Column:
    if base not in _DIGITS:
        raise DataRefusal("a base must be 2, 8, 10 or 16")
    n = col(n).cast("double")
    n = guard(n, (n == F.floor(n)) & (F.abs(n) <= SAFE), "G202: to_base needs an exact integer")
    digits = F.lower(F.conv(F.abs(n).cast("long").cast("string"), 10, base))
    return F.concat(F.when(n < 0, "-").otherwise(""), digits)


def from_base(s, base: int) -> Column:
    if base not in _DIGITS:
        raise DataRefusal("a base must be 2, 8, 10 or 16")
    s = col(s)
    ok = s.rlike(f"^[+-]?{_DIGITS[base]}{{1,53}}$")
    magnitude = F.conv(F.regexp_replace(guard(s, ok, f"G601: not a number in base {base}"), "^[+-]", ""), base, 10).cast("decimal(20,0)")
    value = F.when(s.startswith("-"), -magnitude).otherwise(magnitude)
    return guard(value, F.abs(value) <= SAFE, "G202: number outside the exact range").cast("double")


def parse_number(s) -> Column:
    """Strict decimal text to double: no NaN, infinity, hexadecimal, suffix, overflow or underflow."""
    s = str_trim(s)
    value = guard(s, s.rlike(_NUMBER), "G601: not a decimal number").try_cast("double")
    mantissa = F.regexp_replace(s, "[eE].*$", "")
    whole = s.rlike("^[+-]?[0-9]+$")
    ok = (F.abs(value) < float("inf")) & ~((value == 0) & mantissa.rlike("[1-9]")) & (~whole | (F.abs(value) <= SAFE))
    return guard(value, ok, "G202: number out of range")


def parse_integer(s) -> Column:
    s = str_trim(s)
    value = guard(s, s.rlike("^[+-]?[0-9]{1,18}$"), "G601: not an integer").cast("long")
    return guard(value, F.abs(value) <= SAFE, "G202: integer outside the exact range")


def number_text(x: float) -> str:
    """Shortest decimal that reads back as x; exponent form from 1e15 up and below 1e-4."""
    if x != x or x in (float("inf"), float("-inf")):
        raise DataRefusal("only finite numbers have a text")
    if x == 0:
        return "-0" if str(x).startswith("-") else "0"
    digits, exponent = f"{abs(x):.17e}".split("e")
    for n in range(17):
        digits, exponent = f"{abs(x):.{n}e}".split("e")
        if float(f"{digits}e{exponent}") == abs(x):
            break
    e, sign = int(exponent), "-" if x < 0 else ""
    if e >= 15 or e < -4:
        return f"{sign}{digits}e{e:+d}"
    plain = digits.replace(".", "")
    if e < 0:
        return f"{sign}0.{'0' * (-e - 1)}{plain}"
    whole, part = plain[: e + 1].ljust(e + 1, "0"), plain[e + 1 :]
    return f"{sign}{whole}.{part}" if part else sign + whole


def _number_texts(x: pd.Series) -> pd.Series:
    return x.map(number_text, na_action="ignore")


def to_text(x) -> Column:
    return F.pandas_udf(_number_texts, T.StringType())(col(x).cast("double"))


def interpolate(template: str, **columns) -> Column:
    """Text with {name} and {name:.3f} filled from columns."""
    parts, at = [], 0
    for m in re.finditer(r"\{(\w+)(?::\.(\d+)f)?\}", template):
        parts.append(F.lit(template[at : m.start()]))
        value = col(columns[m[1]])
        parts.append(F.format_string(f"%.{m[2]}f", value.cast("double")) if m[2] else value.cast("string"))
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def printf(template: str, *columns) -> Column:
    """Text from a template with %s, %f, %.Nf and %%; any other directive is refused."""
    kinds = re.findall(r"%(?:%|s|(?:\.\d{1,2})?f|.?)", template)
    if any(not re.fullmatch(r"%(%|s|(\.\d{1,2})?f)", k) for k in kinds):
        raise DataRefusal(f"unsupported directive in {template!r}")
    wanted = [k for k in kinds if k != "%%"]
    if len(wanted) != len(columns):
        raise DataRefusal(f"{len(wanted)} directives for {len(columns)} values")
    values = [col(c).cast("double") if k.endswith("f") else col(c).cast("string") for k, c in zip(wanted, columns, strict=True)]
    return F.format_string(template, *values)
