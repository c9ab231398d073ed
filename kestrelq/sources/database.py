"""Tables of SQLite files as a data source: `spark.read.format("sqlite_file")` with path and table.

The rowid range is cut into parts, so tasks read side by side; the path must be one that every
executor sees. Tables without a rowid are read in one part. Values that don't fit the declared
column type come as null.
"""

from __future__ import annotations

import math
import sqlite3

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def _named(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def spark_type(declared: str) -> str:
    """From a declared type's name."""
    d = declared.upper()
    if "INT" in d:
        return "long"
    if any(x in d for x in ("CHAR", "CLOB", "TEXT")):
        return "string"
    if not d or "BLOB" in d:
        return "binary" if d else "string"
    return "double"


def fitted(value, kind: str):
    if value is None:
        return None
    try:
        if kind == "long":
            return int(value) if not isinstance(value, float) or value.is_integer() else None
        if kind == "double":
            return float(value)
        if kind == "binary":
            return value if isinstance(value, bytes) else str(value).encode()
        return value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)
    except ValueError:
        return None


class _Span(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, options: dict, columns: list[tuple[str, str]]):
        self.path, self.table, self.columns = options["path"], options["table"], columns
        self.parts = int(options.get("numpartitions", 8))

    def partitions(self) -> list[InputPartition]:
        with _open(self.path) as con:
            try:
                low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_named(self.table)}").fetchone()
            except sqlite3.OperationalError:
                return [_Span(None, None)]
        if low is None:
            return [_Span(0, 0)]
        step = max(1, math.ceil((high - low + 1) / self.parts))
        return [_Span(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, part: _Span):
        names = ", ".join(_named(c) for c, _ in self.columns)
        where = "" if part.low is None else f" WHERE rowid >= {part.low} AND rowid < {part.high}"
        with _open(self.path) as con:
            for row in con.execute(f"SELECT {names} FROM {_named(self.table)}{where}"):
                yield tuple(fitted(v, k) for v, (_, k) in zip(row, self.columns))


class SqliteFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_file"

    def _columns(self) -> list[tuple[str, str]]:
        with _open(self.options["path"]) as con:
            found = con.execute(f"PRAGMA table_info({_named(self.options['table'])})").fetchall()
        if not found:
            raise ValueError(f"no table {self.options['table']!r}")
        return [(name, spark_type(declared)) for _, name, declared, *_ in found]

    def schema(self) -> str:
        return ", ".join(f"`{n}` {k}" for n, k in self._columns())

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options), self._columns())


def sqlite_table(spark: SparkSession, path: str, table: str, parts: int = 8):
    spark.dataSource.register(SqliteFile)
    return spark.read.format("sqlite_file").option("table", table).option("numpartitions", str(parts)).load(path)
