"""Polygons as arrays of (x, y) corners, without a repeated last corner; native throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_POINT = "struct<x:double,y:double>"


def polygon(*corners: tuple[Column, Column]) -> Column:
    return F.array(*(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in corners))


def from_json(text: Column) -> Column:
    """`[[x,y],...]`; a closing corner equal to the first goes. Null unless at least three corners remain."""
    p = F.transform(F.from_json(text, "array<array<double>>"), lambda c: F.struct(c[0].alias("x"), c[1].alias("y")))
    p = F.when((F.size(p) > 1) & (p[0] == F.element_at(p, -1)), F.slice(p, 1, F.size(p) - 1)).otherwise(p)
    return F.when(F.size(p) >= 3, p)


def to_json(p: Column) -> Column:
    """Closed by the first corner."""
    closed = F.concat(p, F.slice(p, 1, 1))
    return F.to_json(F.transform(closed, lambda c: F.array(c["x"], c["y"])))


def _next(p: Column) -> Column:
    return F.concat(F.slice(p, 2, F.size(p) - 1), F.slice(p, 1, 1))


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def signed_area(p: Column) -> Column:
    return _sum(F.zip_with(p, _next(p), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])) / 2


def area(p: Column) -> Column:
    return F.abs(signed_area(p))


def ccw(p: Column) -> Column:
    """Corners counter-clockwise, the first one kept."""
    return F.when(signed_area(p) < 0, F.concat(F.slice(p, 1, 1), F.reverse(F.slice(p, 2, F.size(p) - 1)))).otherwise(p)


def _ends(p: Column) -> tuple[Column, ...]:
    xs, ys = F.transform(p, lambda c: c["x"]), F.transform(p, lambda c: c["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def bbox(p: Column) -> Column:
    x0, y0, x1, y1 = _ends(p)
    return polygon((x0, y0), (x1, y0), (x1, y1), (x0, y1))


def group_bbox(p: Column) -> Column:
    """Aggregate: the box around all polygons."""
    x0, y0, x1, y1 = _ends(p)
    low, high = (F.min(x0), F.min(y0)), (F.max(x1), F.max(y1))
    return polygon(low, (high[0], low[1]), high, (low[0], high[1]))


def regular(x: Column, y: Column, r: Column, n: int) -> Column:
    """n corners on a circle."""
    turn = lambda i: i * F.lit(2.0) * F.pi() / F.lit(float(n))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((x + r * F.cos(turn(i))).cast("double").alias("x"), (y + r * F.sin(turn(i))).cast("double").alias("y")))


def xform(p: Column, a: float, b: float, c: float, d: float, e: float, f: float) -> Column:
    """x' = a x + b y + e, y' = c x + d y + f."""
    return F.transform(p, lambda q: F.struct((q["x"] * a + q["y"] * b + e).alias("x"), (q["x"] * c + q["y"] * d + f).alias("y")))


def contains_point(p: Column, x: Column, y: Column) -> Column:
    """2 inside, 1 on the edge, 0 outside."""
    edges = F.zip_with(p, _next(p), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def on(e: Column) -> Column:
        a, b = e["a"], e["b"]
        level = (b["x"] - a["x"]) * (y - a["y"]) == (b["y"] - a["y"]) * (x - a["x"])
        return level & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    def crossed(e: Column) -> Column:
        a, b = e["a"], e["b"]
        at = a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / F.nullif(b["y"] - a["y"], F.lit(0.0))
        return ((a["y"] > y) != (b["y"] > y)) & (x < at)

    inside = F.size(F.filter(edges, lambda e: F.coalesce(crossed(e), F.lit(False)))) % 2 == 1
    return F.when(p.isNull() | x.isNull() | y.isNull(), None).when(F.exists(edges, on), 1).when(inside, 2).otherwise(0)
