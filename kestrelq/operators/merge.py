"""Changes to tables as pure functions: the table after the statement, or the rows that it returns.

A key with a null matches no other key, as in a unique index. Rows to add are taken in the order of `order`
(by their own values, where none is given), so that the first or the last of equal keys is defined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _known(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out


def _one(rows: DataFrame, keys: list[str], order: list[str] | None, last: bool) -> DataFrame:
    """One row of each key, all rows of keys with a null."""
    by = [F.desc(c) if last else F.asc(c) for c in (order or rows.columns)]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
    return rows.where(_known(keys)).withColumn("_place", place).where("_place = 1").drop("_place").unionByName(rows.where(~_known(keys)))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], order: list[str] | None = None, update: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """Rows replace those with equal keys; the others are added. Of rows with equal keys the last one counts.
    update: only these columns change, by expressions of `old` and `excluded` (the row that was to be added), and
    only where the condition holds."""
    new = _one(rows.select(*dict.fromkeys([*table.columns, *(order or [])])), keys, order, True).select(table.columns)
    if update is None and where is None:
        return table.join(new, keys, "left_anti").select(table.columns).unionByName(new)
    old, excluded = table.alias("old"), new.withColumn("_new", F.lit(True)).alias("excluded")
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(f"old.{k}") == F.col(f"excluded.{k}"))
    met = F.col("excluded._new").isNotNull() & F.coalesce(F.lit(True) if where is None else where, F.lit(False))
    change = update or {c: F.col(f"excluded.{c}") for c in table.columns if c not in keys}
    kept = old.join(excluded, on, "left").select(*(F.when(met, change[c]).otherwise(F.col(f"old.{c}")).alias(c) if c in change else F.col(f"old.{c}") for c in table.columns))
    return kept.unionByName(new.join(table, keys, "left_anti").select(table.columns))


def insert_or_ignore(table: DataFrame, rows: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows whose keys the table lacks are added; of rows with equal keys the first one."""
    return table.unionByName(inserted(table, rows, keys, order))


def inserted(table: DataFrame, rows: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """What insert_or_ignore adds, as RETURNING gives it."""
    new = _one(rows.select(*dict.fromkeys([*table.columns, *(order or [])])), keys, order, False)
    return new.join(table, keys, "left_anti").select(table.columns)


def with_defaults(rows: DataFrame, table: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """rows with the table's columns that they lack: their defaults, or null."""
    types = {f.name: f.dataType for f in table.schema}
    return rows.select(*(F.col(c).cast(t) if c in rows.columns else F.coalesce(defaults.get(c, F.lit(None)), F.lit(None)).cast(t).alias(c) for c, t in types.items()))


def delete(table: DataFrame, keys_gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(keys_gone.select(keys).distinct(), keys, "left_anti").select(table.columns)


def first_rows(table: DataFrame, where: Column, order: list[Column], limit: int, keys: list[str]) -> DataFrame:
    """The rows that a DELETE or UPDATE with ORDER BY and LIMIT touches, as RETURNING gives them."""
    return table.where(where).orderBy(*order, *keys).limit(limit)


def violations(child: DataFrame, columns: list[str], parent: DataFrame, parent_columns: list[str]) -> DataFrame:
    """Child rows without a parent; a null in a column is no violation."""
    known = parent.select(*(F.col(p).alias(f"_p{i}") for i, p in enumerate(parent_columns))).distinct()
    on = [F.col(c) == F.col(f"_p{i}") for i, c in enumerate(columns)]
    return child.dropna(subset=columns).join(known, on, "left_anti")


def constraint_violations(table: DataFrame, not_null: list[str] = (), unique: list[list[str]] = (), check: dict[str, Column] | None = None) -> DataFrame:
    """The table's rows with the name of each constraint that they break. A check that is null holds; a unique key
    with a null is never broken."""
    out = None
    found = [(f"not null {c}", table.where(F.col(c).isNull())) for c in not_null]
    found += [(f"check {n}", table.where(~F.coalesce(x, F.lit(True)))) for n, x in (check or {}).items()]
    for keys in unique:
        many = table.where(_known(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_many")).where("_many > 1").drop("_many")
        found.append((f"unique {', '.join(keys)}", table.join(many, keys, "left_semi").select(table.columns)))
    for name, rows in found:
        part = rows.select("*", F.lit(name).alias("constraint_name"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else table.limit(0).withColumn("constraint_name", F.lit(""))
