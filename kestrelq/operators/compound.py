"""Compound selects: chains of set operations that bind to the left, and rows of mixed classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_KINDS = {
    "union": lambda a, b: a.union(b).distinct(),
    "union all": lambda a, b: a.union(b),
    "except": lambda a, b: a.subtract(b),
    "intersect": lambda a, b: a.intersect(b),
}


def compound(first: DataFrame, *arms: tuple[str, DataFrame], order: list[Column] | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """((first op arm) op arm) ...: all operators bind alike, to the left. Names are those of the first arm; ORDER BY
    and LIMIT belong to the whole."""
    out = first
    for kind, arm in arms:
        out = _KINDS[kind.lower()](out, arm.toDF(*first.columns))
    if order:
        out = out.orderBy(*order)
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def by_class(x: Column, kind: str) -> Column:
    """A value of its storage class, for columns that mix classes: numbers compare by value whether integer or real,
    text with text, blobs with blobs, and no class equals another."""
    number = x.cast("double") if kind in ("integer", "real") else F.lit(None).cast("double")
    text = x.cast("string") if kind == "text" else F.lit(None).cast("string")
    blob = x.cast("binary") if kind == "blob" else F.lit(None).cast("binary")
    rank = F.when(x.isNull(), 0).otherwise({"integer": 1, "real": 1, "text": 2, "blob": 3}[kind])
    return F.struct(rank.alias("class"), number.alias("number"), text.alias("text"), blob.alias("blob"))
