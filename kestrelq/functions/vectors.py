"""Vector functions over arrays of numbers, native throughout and in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ZERO = 0.0


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(_ZERO), lambda a, b: a + b)


def dims(v: Column) -> Column:
    return F.size(v)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def l1(a: Column, b: Column) -> Column:
    return _total(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y)))


def cosine_distance(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, 1 - dot(a, b) / n).otherwise(F.lit(1.0))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x - y)


def multiply(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x * y)


def normalised(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(doubles(a), lambda x: x / n)).otherwise(doubles(a))


def truncated(a: Column, width: int) -> Column:
    """The first components, made unit length again."""
    return normalised(F.slice(a, 1, width))


def bits(a: Column) -> Column:
    """One bit for each positive component."""
    return F.transform(a, lambda x: F.when(x > 0, 1).otherwise(0))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x != y, 1).otherwise(0)), F.lit(0), lambda x, y: x + y)


def jaccard(a: Column, b: Column) -> Column:
    both = F.aggregate(F.zip_with(a, b, lambda x, y: F.when((x > 0) & (y > 0), 1).otherwise(0)), F.lit(0), lambda x, y: x + y)
    either = F.aggregate(F.zip_with(a, b, lambda x, y: F.when((x > 0) | (y > 0), 1).otherwise(0)), F.lit(0), lambda x, y: x + y)
    return F.when(either > 0, 1 - both / either).otherwise(F.lit(0.0))


def int8(a: Column) -> Column:
    """Components scaled so that the largest is 127."""
    top = F.array_max(F.transform(doubles(a), lambda x: F.abs(x)))
    return F.transform(doubles(a), lambda x: F.when(top > 0, F.round(x * 127 / top)).otherwise(0).cast("tinyint"))


def from_text(x: Column, width: int | None = None) -> Column:
    """'[1, 2.5]' as a vector; null for other text and, with a width, for vectors of another one."""
    v = F.from_json(F.when(x.rlike(r"^\s*\[.*\]\s*$"), x), "array<double>")
    v = F.when(F.forall(v, lambda y: y.isNotNull()), v)
    return v if width is None else F.when(F.size(v) == width, v)


def checked(v: Column, width: int) -> Column:
    """The vector; an error where it has another width. Null stays null."""
    wrong = F.raise_error(F.concat(F.lit(f"expected {width} dimensions, not "), F.size(v).cast("string"))).cast("array<double>")
    return F.when(v.isNull() | (F.size(v) == width), doubles(v)).otherwise(wrong)


def concat(a: Column, b: Column) -> Column:
    return F.concat(doubles(a), doubles(b))


def subvector(a: Column, start: int, width: int) -> Column:
    """width components from the start-th (from 1) on."""
    return F.slice(doubles(a), start, width)


def half(a: Column) -> Column:
    """Components rounded to 16-bit floating point: 11 significant bits, to even, 2^-24 at least; beyond 65504 infinite."""
    scale = lambda x: F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(x))), F.lit(-14)) - 10)
    rounded = lambda x: F.rint(x / scale(x)) * scale(x)
    sign = lambda x: F.when(x < 0, F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.transform(doubles(a), lambda x: F.when(x == 0, x).when(F.abs(rounded(x)) > 65504, sign(x)).otherwise(rounded(x)))


def sparse(a: Column) -> Column:
    """place (from 1) -> component, without zeros."""
    return F.map_from_entries(F.filter(F.transform(doubles(a), lambda x, i: F.struct((i + 1).alias("key"), x.alias("value"))), lambda e: e["value"] != 0))


def dense(a: Column, width: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.coalesce(F.try_element_at(a, i), F.lit(0.0)))


def sparse_dot(a: Column, b: Column) -> Column:
    return _total(F.transform(F.map_entries(a), lambda e: e["value"] * F.coalesce(F.try_element_at(b, e["key"]), F.lit(0.0))))
