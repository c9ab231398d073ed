"""printf, code points, archives: text forms of values."""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_SPEC = re.compile(r"%([-+ 0,#!]*)(\*|\d+)?(?:\.(\d+))?(?:l{0,2})([diuxXofeEgGcszqQwp%n])")


def _padded(x: Column, flags: str, width) -> Column:
    """Spaces up to a width that may be a column; longer texts stay whole."""
    if width is None:
        return x
    w = width if isinstance(width, Column) else F.lit(int(width))
    side = F.rpad if "-" in flags else F.lpad
    return F.when(F.length(x) >= w, x).otherwise(side(x, w, F.lit(" ")))


def _general(x: Column, precision: int, upper: bool) -> Column:
    """Shortest of fixed and exponent form at so many digits, without trailing zeros."""
    p = max(1, precision)
    sci = F.format_string(f"%.{p - 1}e", x)
    exponent = F.regexp_extract(sci, r"e([+-]\d+)$", 1).cast("int")
    fixed = F.call_function("format_string", F.concat(F.lit("%."), F.greatest(F.lit(p - 1) - exponent, F.lit(0)).cast("string"), F.lit("f")), x)
    fixed = F.regexp_replace(fixed, r"(\.\d*?)0+$", "$1")
    out = F.when((exponent < -4) | (exponent >= p), F.regexp_replace(F.regexp_replace(sci, r"(\.\d*?)0+e", "$1e"), r"\.e", "e")).otherwise(F.regexp_replace(fixed, r"\.$", ""))
    return F.upper(out) if upper else out


def printf(pattern: str, *values: Column) -> Column:
    """The pattern with values in their places; missing values are null, which prints as 0 or as nothing.
    Native: the pattern is read when the plan is made."""
    left = list(values)
    take = lambda: left.pop(0) if left else F.lit(None).cast("string")
    parts: list[Column] = []
    at = 0
    for m in _SPEC.finditer(pattern):
        parts.append(F.lit(pattern[at : m.start()]))
        at = m.end()
        flags, width, precision, kind = m.groups()
        if kind == "%":
            parts.append(F.lit("%"))
            continue
        if kind == "n":
            continue
        if width == "*":
            width = take().cast("int")
        x = take()
        if kind in "diuxXop":
            number = F.coalesce(x.cast("bigint"), F.lit(0).cast("bigint"))
            zero = "0" in flags and "-" not in flags and isinstance(width, str)
            spec = "".join(f for f in "+ ," if f in flags and kind in "diu") + (f"0{width}" if zero else "")
            out = F.format_string("%" + spec + {"i": "d", "u": "d", "p": "X"}.get(kind, kind), number)
        elif kind in "feE":
            out = F.format_string("%" + "".join(f for f in "+ ," if f in flags and (f != "," or kind == "f")) + (f"0{width}" if "0" in flags and "-" not in flags and isinstance(width, str) else "") + f".{precision or 6}" + kind, F.coalesce(x.cast("double"), F.lit(0.0)))
        elif kind in "gG":
            out = _general(F.coalesce(x.cast("double"), F.lit(0.0)), int(precision or 6), kind == "G")
        else:
            text = x.cast("string")
            if kind == "c":
                out = F.coalesce(F.substring(text, 1, 1), F.lit(""))
            elif kind == "Q":
                out = F.coalesce(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))
            elif kind in "qw":
                mark = "'" if kind == "q" else '"'
                out = F.coalesce(F.replace(text, F.lit(mark), F.lit(mark * 2)), F.lit("(NULL)"))
            else:
                out = F.coalesce(text, F.lit(""))
                if precision is not None:
                    out = F.substring(out, 1, int(precision))
        parts.append(_padded(out, flags, width))
    return F.concat(*parts, F.lit(pattern[at:]))


def char(*points: Column) -> Column:
    """Text of code points, beyond 255 as well; null counts as 0."""

    @F.pandas_udf("string")
    def run(found: pd.Series) -> pd.Series:
        return pd.Series(["".join(chr(p) if 0 <= p < 0x110000 and not 0xD800 <= p < 0xE000 else "�" for p in row) for row in found], dtype=object)

    return run(F.array(*(F.coalesce(p.cast("int"), F.lit(0)) for p in points)))


_ESCAPE = re.compile(r"\\(?:\\|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|\+([0-9A-Fa-f]{6})|([0-9A-Fa-f]{4}))")


def unistr(x: Column) -> Column:
    r"""\XXXX, \uXXXX, \+XXXXXX and \UXXXXXXXX become characters, \\ a backslash."""

    @F.pandas_udf("string")
    def run(found: pd.Series) -> pd.Series:
        put = lambda m: chr(int(h, 16)) if (h := next(filter(None, m.groups()), None)) else "\\"
        return pd.Series([None if t is None else _ESCAPE.sub(put, t) for t in found], dtype=object)

    return run(x)


def storage_class(x: Column) -> Column:
    """null, integer, real, text or blob."""
    kind = F.typeof(x)
    named = F.when(kind.isin("tinyint", "smallint", "int", "bigint", "boolean"), "integer").when(kind.isin("float", "double") | kind.startswith("decimal"), "real")
    return F.when(x.isNull(), "null").otherwise(named.when(kind == "binary", "blob").otherwise("text"))


def zeroblob(n: Column) -> Column:
    return F.unhex(F.repeat(F.lit("00"), F.greatest(n.cast("int"), F.lit(0))))


def soundex(x: Column) -> Column:
    """`?000` for text without a letter and for null."""
    letters = F.regexp_replace(x, "[^A-Za-z]", "")
    return F.when(F.length(letters) > 0, F.soundex(letters)).otherwise(F.lit("?000"))


def compress(x: Column) -> Column:
    """zlib, unless that isn't smaller."""

    @F.pandas_udf("binary")
    def run(found: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else min(zlib.compress(b), bytes(b), key=len) for b in found], dtype=object)

    return run(x.cast("binary"))


def uncompress(x: Column, size: Column) -> Column:
    """Of what compress() gave for so many bytes."""

    @F.pandas_udf("binary")
    def run(found: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else bytes(b) if len(b) == n else zlib.decompress(b) for b, n in zip(found, sizes)], dtype=object)

    return run(x.cast("binary"), size)
