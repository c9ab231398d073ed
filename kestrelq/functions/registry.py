"""Functions of the user's own, by name and number of arguments: scalar, aggregate and table functions in SQL.

A scalar function takes and returns pandas series (Arrow batches, no call for each row); an aggregate takes series
and returns one value; a table function is a class with `eval`. Several scalar functions may share a name, if they
differ in the number of arguments.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_SCALARS: dict[str, dict[int, Callable]] = {}


def scalar(spark: SparkSession, name: str, function: Callable, result: str) -> None:
    """Overloads of one name must share the result type."""
    known = _SCALARS.setdefault(name.lower(), {})
    known[len(inspect.signature(function).parameters)] = function
    by_arity = dict(known)

    def call(*columns: pd.Series) -> pd.Series:
        if len(columns) not in by_arity:
            raise ValueError(f"wrong number of arguments to function {name}()")
        return by_arity[len(columns)](*columns)

    spark.udf.register(name, F.pandas_udf(call, result, F.PandasUDFType.SCALAR))


def aggregate(spark: SparkSession, name: str, function: Callable, result: str) -> None:
    """Of one or more columns, also over windows. A group's values meet in one task: split large groups first."""
    spark.udf.register(name, F.pandas_udf(function, result, F.PandasUDFType.GROUPED_AGG))


def table(spark: SparkSession, name: str, handler: type, result: str) -> None:
    """A table function for FROM, also LATERAL."""
    spark.udtf.register(name, F.udtf(handler, returnType=result))
