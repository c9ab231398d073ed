"""Rows as lines of text, ready for `write.text`; native, one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _literal(df: DataFrame, name: str) -> Column:
    x = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, _NUMBERS):
        return F.coalesce(x.cast("string"), F.lit("NULL"))
    if isinstance(df.schema[name].dataType, T.BinaryType):
        return F.coalesce(F.concat(F.lit("X'"), F.hex(x), F.lit("'")), F.lit("NULL"))
    return F.coalesce(F.concat(F.lit("'"), F.replace(x.cast("string"), F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))


def _shown(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def lines(df: DataFrame, mode: str, table: str = "t") -> DataFrame:
    """line: one for each row in mode insert, quote, json, tabs, list, markdown, html or csv. Null is NULL in
    literals, null in JSON, and empty elsewhere."""
    names = df.columns
    if mode == "insert":
        target = table.replace('"', '""')
        line = F.concat(F.lit(f'INSERT INTO "{target}" VALUES('), F.concat_ws(",", *(_literal(df, n) for n in names)), F.lit(");"))
    elif mode == "quote":
        line = F.concat_ws(",", *(_literal(df, n) for n in names))
    elif mode == "json":
        line = F.to_json(F.struct(*(F.col(f"`{n}`") for n in names)), {"ignoreNullFields": "false"})
    elif mode in ("tabs", "list"):
        line = F.concat_ws("\t" if mode == "tabs" else "|", *map(_shown, names))
    elif mode == "markdown":
        cells = (F.replace(_shown(n), F.lit("|"), F.lit("\\|")) for n in names)
        line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    elif mode == "html":
        escape = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        line = F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), escape(_shown(n)), F.lit("</td>")) for n in names), F.lit("</tr>"))
    elif mode == "csv":
        line = F.to_csv(F.struct(*(F.col(f"`{n}`") for n in names)))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return df.select(line.alias("line"))
