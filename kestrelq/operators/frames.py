"""Window frames of every mode (ROWS, RANGE, GROUPS) and exclusion (CURRENT ROW, GROUP, TIES) for any aggregate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Aggregates over the array of a frame's values in order, nulls included.
AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "count": lambda v: F.size(F.filter(v, lambda x: x.isNotNull())).cast("long"),
    "sum": lambda v: F.aggregate(v, F.lit(None).cast("double"), lambda a, x: F.when(x.isNull(), a).otherwise(F.coalesce(a, F.lit(0.0)) + x)),
    "total": lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0))),
    "avg": lambda v: AGGREGATES["sum"](v) / F.nullif(AGGREGATES["count"](v), F.lit(0)),
    "min": lambda v: F.array_min(v),
    "max": lambda v: F.array_max(v),
    "first_value": lambda v: F.get(v, F.lit(0)),
    "last_value": lambda v: F.get(v, F.size(v) - 1),
    "group_concat": lambda v: F.when(F.exists(v, lambda x: x.isNotNull()), F.array_join(v, ",")),
}
_ENDS = {"unbounded preceding": Window.unboundedPreceding, "unbounded following": Window.unboundedFollowing, "current row": 0}


def framed(rows: DataFrame, value: str, aggregate: str, partition: list[str], order: list[str], mode: str = "range", low: int | str = "unbounded preceding", high: int | str = "current row", exclude: str | None = None, name: str = "result") -> DataFrame:
    """rows with an aggregate of value over a frame. low and high: offsets (negative for preceding), or the names of
    ends. GROUPS frames are ranges over the number of the peer group. Without an exclusion, sums, counts and extremes
    are Spark's own running aggregates; with one, the frame's values are gathered for each row, so work is the rows
    times their frames. A sum is a double."""
    ends = [_ENDS.get(x, x) if isinstance(x, str) else x for x in (low, high)]
    by = Window.partitionBy(*partition).orderBy(*order)
    rows = rows.withColumn("_group", F.dense_rank().over(by)).withColumn("_row", F.row_number().over(by))
    window = Window.partitionBy(*partition)
    if mode == "rows":
        window = window.orderBy("_row").rowsBetween(*ends)
    elif mode == "groups":
        window = window.orderBy("_group").rangeBetween(*ends)
    else:
        window = window.orderBy(*order).rangeBetween(*ends)
    native = {"count": F.count, "min": F.min, "max": F.max, "sum": lambda v: F.sum(F.col(v).cast("double")), "avg": F.avg}
    if exclude is None and aggregate in native:
        out = rows.withColumn(name, native[aggregate](value).over(window))
    else:
        # a struct is never null, so a null value keeps its place
        seen = F.collect_list(F.struct(F.col("_row").alias("r"), F.col("_group").alias("g"), F.col(value).alias("v"))).over(window)
        rows = rows.withColumn("_seen", seen)
        keep = {
            None: lambda x: F.lit(True),
            "current row": lambda x: x["r"] != F.col("_row"),
            "group": lambda x: x["g"] != F.col("_group"),
            "ties": lambda x: (x["g"] != F.col("_group")) | (x["r"] == F.col("_row")),
        }[exclude]
        kept = F.transform(F.array_sort(F.filter("_seen", keep)), lambda x: x["v"])
        out = rows.withColumn(name, AGGREGATES[aggregate](kept)).drop("_seen")
    return out.drop("_group", "_row")
