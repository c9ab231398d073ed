"""Every registered query against its SQL on the same tables."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from kestrelq.functions import lenient
from kestrelq.plans import registry

registry.load()
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in registry.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 4) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x.replace(tzinfo=None) if hasattr(x, "tzinfo") else x


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SMALL)
    got = df.collect()
    if name in registry.ORACLES:
        want = duck.execute(registry.ORACLES[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(df.columns)
        assert rows(df.columns, got) == rows(names, want.fetchall())
    else:
        assert got


def over(spark, folder, name, **tables):
    """The query's rows and those of its SQL over tables given as SQL."""
    con = duckdb.connect()
    for t, text in tables.items():
        con.execute(f"COPY ({text}) TO '{folder}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = registry.QUERIES[name](spark, str(folder))
    want = con.execute(registry.ORACLES[name])
    return rows(df.columns, df.collect()), rows([d[0] for d in want.description], want.fetchall())


def test_boxes_at_their_edges(spark, tmp_path):
    odd = "SELECT * FROM (VALUES {}) v(k, b)".format(", ".join(f"({1000000 + i}, {x}::DOUBLE)" for i, x in enumerate(("'inf'", "'-inf'", "'nan'", "NULL", "1e17", "1e17 + 16", "-0.0"))))
    balances = "SELECT range AS k, round(range * {} % 9000 / 100, 2)::DOUBLE AS b FROM range({}) UNION ALL " + odd
    customer = f"SELECT k AS c_custkey, CASE WHEN k = 3 THEN NULL ELSE k % 3 // 2 END::INTEGER AS c_nationkey, b AS c_acctbal FROM ({balances.format(7, 900)})"
    supplier = f"SELECT k AS s_suppkey, (k % 2)::INTEGER AS s_nationkey, b AS s_acctbal FROM ({balances.format(11, 300)})"
    got, want = over(spark, tmp_path, "rtree_boxes", customer=customer, supplier=supplier)
    assert len(want) > 10000 and got == want


def test_numbers_past_the_year_9999(spark, tmp_path):
    keys = (0, 1, 2921938, 2921939, 2921940, 2932896, 2932897, 2932898, 2932932, 2932938, 8999999, 30000000, -365, -600000)
    orders = "SELECT k::BIGINT AS o_orderkey FROM (VALUES (NULL), {}) v(k)".format(", ".join(f"({k})" for k in keys))
    got, want = over(spark, tmp_path, "time_from_numbers", orders=orders)
    assert got == want


def test_far_years_only_where_asked(spark):
    row = spark.range(1).select(
        lenient.datetime(F.lit(5373484)).alias("a"), lenient.datetime(F.lit(5373485)).alias("b"), lenient.datetime(F.lit(5373485), far=True).alias("c"),
        lenient.datetime(F.lit(253402300800), "unixepoch").alias("d"), lenient.date(F.lit(253402300800), "unixepoch", far=True).alias("e"),
        lenient.datetime(F.lit(-62167219201), "unixepoch", far=True).alias("f"), lenient.datetime(F.lit("1e30")).alias("g"), lenient.datetime(F.lit(10**18), far=True).alias("h"), lenient.datetime(F.lit(10**18), "unixepoch", far=True).alias("i"),
    )
    assert tuple(row.first()) == ("9999-12-31 12:00:00", None, "10000-01-01 12:00:00", None, "10000-01-01", "-1-12-31 23:59:59", None, None, None)
