"""Edge cases of the dialect's operators: nulls, repeated keys, open ends, refused input, golden values."""

import pytest
from pyspark.sql import functions as F

from kestrelq.functions import collation, jsonedit, lenient, vectors
from kestrelq.functions import registry as functions
from kestrelq.operators import compound, frames, fulltext, joins, merge, ranking, recursion


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_repeated_and_null_keys(spark):
    table = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    rows = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (None, "m", 3), (1, "b", 4)], "k int, v string, at int")
    got = lambda d: sorted(map(tuple, d.collect()), key=repr)
    assert got(merge.upsert(table, rows, ["k"], ["at"])) == sorted([(1, "b"), (2, "y"), (None, "n"), (None, "m")], key=repr)
    assert got(merge.insert_or_ignore(table, rows, ["k"], ["at"])) == sorted([(1, "a"), (2, "x"), (None, "n"), (None, "m")], key=repr)
    assert got(merge.inserted(table, rows, ["k"], ["at"])) == sorted([(2, "x"), (None, "m")], key=repr)
    changed = merge.upsert(table, rows, ["k"], ["at"], {"v": F.concat("old.v", "excluded.v")}, F.col("excluded.v") > F.lit("a"))
    assert got(changed) == sorted([(1, "ab"), (2, "y"), (None, "n"), (None, "m")], key=repr)
    assert merge.constraint_violations(table, ["k"], [["k"]], {"v": F.col("v") == "a"}).count() == 2


def test_fixpoint_with_nulls_ends(spark):
    seed = spark.sql("SELECT CAST(NULL AS INT) AS n, 'a' AS t")
    found = recursion.fixpoint(seed, lambda d: d.selectExpr("CASE WHEN n IS NULL THEN 1 END AS n", "CAST(NULL AS STRING) AS t"))
    assert {tuple(r) for r in found.collect()} == {(None, "a"), (1, None), (None, None)}


def test_asof_null_keys_ties_and_hot_key(spark):
    left = spark.createDataFrame([(1, None, 5), (2, "a", 5), (3, "a", None), (4, "b", 5), (5, "a", 0)], "id int, k string, s int").withColumn("t", F.timestamp_seconds("s"))
    right = spark.createDataFrame([(None, 1, 10), ("a", 1, 20), ("a", 3, 21), ("a", 3, 22), ("a", 9, 23), ("b", None, 30)], "k string, s int, v int").select("k", F.timestamp_seconds("s").alias("at"), "v")
    for buckets in (2, 200):
        got = {r.id: r.v for r in joins.asof(left, right, "t", "at", ("k",), buckets).collect()}
        assert got == {1: None, 2: 22, 3: None, 4: None, 5: None}
        plan = joins.asof(left, right, "t", "at", ("k",), buckets)._jdf.queryExecution().toString()
        assert "SinglePartition" not in plan.split("Physical Plan")[-1]
    assert {r.v for r in joins.asof(left, right.limit(0), "t", "at", ("k",)).collect()} == {None}


def test_interval_without_an_end(spark):
    spans = spark.createDataFrame([(1, 0.0, float("inf")), (2, -1e15, 1e15), (3, 5.0, 5.0), (4, None, 2.0), (5, 3.0, 1.0)], "s int, lo double, hi double")
    points = spark.createDataFrame([(5.0,), (-3.0,), (1e17,), (None,)], "p double")
    got = sorted((r.p, r.s) for r in joins.interval(points, spans, "p", "lo", "hi", 0.5).collect())
    assert got == [(-3.0, 2), (5.0, 1), (5.0, 2), (5.0, 3), (1e17, 1)]


def test_interval_of_many_endless_spans(spark):
    points = spark.range(20000).select(F.col("id").alias("i"), (F.col("id") % 5000 / 2).alias("p"))
    spans = spark.range(60).select(F.col("id").alias("s"), (F.col("id") * 10).cast("double").alias("lo"), F.lit(float("inf")).alias("hi"))
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")  # as for large tables
    try:
        tasks = [r["count"] for r in joins.interval(points, spans, "p", "lo", "hi", 1).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set(key, before)
    assert sum(tasks) == sum(4 * (5000 - 20 * s) for s in range(60))
    assert max(tasks) < 0.5 * sum(tasks)  # not all points of one bucket in one task


def test_interval_against_all_pairs(spark):
    far, nan = float("inf"), float("nan")
    values = [7.0] * 300 + [k / 8 for k in range(-400, 400)] + [far, -far, nan, 0.0, -0.0]
    ends = [(-far, far), (7.0, 7.0), (6.9, 7.1), (nan, nan), (3.0, nan), (50.0, 60.0), (-90.0, -50.0), (2.0, 1.0), *((k / 3, k / 3 + 2.0 ** (k % 9 - 2)) for k in range(-150, 150))]
    points = spark.createDataFrame(list(enumerate(values)), "i int, p double")
    spans = spark.createDataFrame([(k, *e) for k, e in enumerate(ends)], "s int, lo double, hi double")
    want = sorted(map(tuple, points.join(spans, F.col("p").between(F.col("lo"), F.col("hi"))).select("i", "s").collect()))
    for size in ({}, {"buckets": 7, "rows": 10}, {"buckets": 1, "rows": 1}):
        assert sorted(map(tuple, joins.interval(points, spans, "p", "lo", "hi", **size).select("i", "s").collect())) == want
    assert joins.interval(points.limit(0), spans, "p", "lo", "hi").count() == joins.interval(points, spans.limit(0), "p", "lo", "hi").count() == 0


def test_quantifiers_over_nothing_and_nulls(spark):
    outer = spark.createDataFrame([(1, 5), (2, 5), (3, 5), (4, None)], "k int, v int")
    inner = spark.createDataFrame([(1, 4), (1, None), (2, 4)], "k int, x int")
    keys = lambda c, q: sorted(r.k for r in joins.quantified(outer, "v", c, q, inner, "x", [("k", "k")]).collect())
    assert keys(">", "ALL") == [2, 3, 4] and keys(">", "ANY") == [1, 2]
    with pytest.raises(ValueError):
        keys("=", "ANY")


def test_frames_with_nulls(spark):
    rows = spark.createDataFrame([("a", 1, 10), ("a", 2, None), ("a", 2, 30), ("b", 1, None)], "g string, o int, v int")
    got = lambda agg, **x: sorted(((r.g, r.o, r.v, r.result) for r in frames.framed(rows, "v", agg, ["g"], ["o"], **x).collect()), key=repr)
    assert got("sum", mode="groups", low=-1, high=0, exclude="group") == sorted([("a", 1, 10, None), ("a", 2, None, 10.0), ("a", 2, 30, 10.0), ("b", 1, None, None)], key=repr)
    assert got("count", mode="range", exclude="ties") == sorted([("a", 1, 10, 1), ("a", 2, None, 1), ("a", 2, 30, 2), ("b", 1, None, 0)], key=repr)
    assert got("avg", mode="range", low=-1, high=0, exclude="current row") == sorted([("a", 1, 10, None), ("a", 2, None, 20.0), ("a", 2, 30, 10.0), ("b", 1, None, None)], key=repr)
    assert got("total", mode="rows", low="unbounded preceding", high="unbounded following", exclude="current row") == sorted([("a", 1, 10, 30.0), ("a", 2, None, 40.0), ("a", 2, 30, 10.0), ("b", 1, None, 0.0)], key=repr)


def test_recursion_limit_and_compound_binding(spark):
    twice = recursion.rounds(spark.sql("SELECT 1 AS n"), lambda d: d.select((F.col("n") + 1).alias("n")), limit=7)
    assert [r.n for r in twice.orderBy("n").collect()] == list(range(1, 8))
    v = lambda *x: spark.createDataFrame([(i,) for i in x], "n int")
    assert [r.n for r in compound.compound(v(1, 2), ("union", v(3)), ("except", v(1)), ("union all", v(3)), order=[F.col("n")]).collect()] == [2, 3, 3]


def test_time_values(spark):
    cases = {
        ("2024-02-30",): "2024-03-01 00:00:00", ("2024-01-31 10:00Z",): "2024-01-31 10:00:00", ("2024-01-31T10:00:30.5+02:00",): "2024-01-31 08:00:30",
        ("12:30",): "2000-01-01 12:30:00", ("2440587.5",): "1970-01-01 00:00:00", ("0", "unixepoch"): "1970-01-01 00:00:00", ("1700000000", "auto"): "2023-11-14 22:13:20",
        ("2024-01-31", "+1 month"): "2024-03-02 00:00:00", ("2024-01-31", "+1 month", "floor"): "2024-02-29 00:00:00", ("2024-05-15 10:11:12", "start of month", "-1 day"): "2024-04-30 00:00:00",
        ("25:00",): None, ("2024-13-01",): None, ("x",): None, ("",): None, ("abc", "unixepoch"): None, ("2024-01-01 10",): None,
    }
    for (text, *modifiers), want in cases.items():
        assert one(spark, lenient.datetime(F.lit(text), *modifiers)) == want, text
    assert one(spark, lenient.time(F.lit("10:11:12.345"), "subsec")) == "10:11:12.345"
    assert one(spark, lenient.datetime(F.lit(None).cast("string"))) is None
    assert one(spark, lenient.datetime(F.lit("2024-07-01 12:00"), "localtime", "utc")) == "2024-07-01 12:00:00"
    with pytest.raises(ValueError):
        lenient.date(F.lit("2024-01-01"), "+1 fortnight")


def test_json_numbers_and_constants(spark):
    rows = spark.createDataFrame([('{"a":1.10,"b":1e5,"c":12345678901234567890}',), ('{"a":NaN}',), (None,)], "j string")
    got = [r.x for r in rows.select(jsonedit.json_set(F.col("j"), "$.d", F.lit(2)).alias("x")).collect()]
    assert got == ['{"a":1.10,"b":1e5,"c":12345678901234567890,"d":2}', None, None]
    assert jsonedit.rendered(jsonedit.parsed('{"a":[1.50,{"b":[]}],"c":{}}')) == '{"a":[1.50,{"b":[]}],"c":{}}'
    assert jsonedit.rendered(jsonedit.parsed('{"a":[1.50]}'), 2) == '{\n  "a": [\n    1.50\n  ]\n}'
    where = spark.createDataFrame([("[1,]",), ("{}",), (None,), ('{"a":NaN}',)], "j string").select(jsonedit.json_error_position("j").alias("x"))
    assert [r.x for r in where.collect()][1:3] == [0, None] and all(r.x for r in where.collect()[::3])
    assert one(spark, jsonedit.json_quote(F.lit('a"b'))) == '"a\\"b"'


def test_highlight_and_query_language(spark):
    assert one(spark, fulltext.highlight(F.lit("the end of The"), "the", "$1\\", "$")) == "$1\\the$ end of $1\\The$"
    docs = spark.createDataFrame([(1, "a b c d", "x"), (2, "d x x b a", "y z"), (3, None, "b")], "id int, t string, s string")
    ids = lambda q: [r.id for r in docs.where(fulltext.Query(q).predicate(F.col("t"), F.col("s"), names=("t", "s"))).orderBy("id").collect()]
    assert ids("b") == [1, 2, 3] and ids("t: b") == [1, 2] and ids("- t: b") == [3] and ids("{s}: (x OR z)") == [1, 2] and ids("t: d AND s: y") == [2]
    assert ids("NEAR(a b d, 1)") == [1] and ids("NEAR(a b d, 2)") == [1, 2] and ids('"b c"') == [1]
    with pytest.raises(ValueError):
        ids("nothing: b")
    assert fulltext.plain_words("Release-notes for v2") == ["release", "notes", "for", "v2"]
    for bad in ('"a b"', "a AND b", "x*", "text: a", "NEAR(a b)", "a -b"):
        with pytest.raises(ValueError):
            fulltext.plain_words(bad)
    assert one(spark, fulltext.folded(F.lit("Éàñ ß ø"))) == "Ean ß ø"


def test_stored_index_ranks_as_the_scan(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    fulltext.write_index(docs, str(tmp_path / "index"), buckets=16)
    found = fulltext.search_index(spark, str(tmp_path / "index"), ["the", "les", "nowhere"])
    want = {r.doc_id: round(r.score, 9) for r in fulltext.bm25(docs, ["the", "les"]).collect()}
    assert {r.id: round(r.score, 9) for r in found.collect()} == want
    assert "PartitionFilters: [bucket" in found._jdf.queryExecution().toString() or "bucket#" in found._jdf.queryExecution().toString()
    assert fulltext.search_index(spark, str(tmp_path / "index"), ["the"], 3).count() == 3


def test_vector_forms(spark):
    v = lambda *x: F.array(*(F.lit(float(i)) for i in x))
    assert one(spark, vectors.from_text(F.lit("[1, 2.5]"))) == [1.0, 2.5] and one(spark, vectors.from_text(F.lit("[1,2]"), 3)) is None
    assert one(spark, vectors.half(v(0, 1, 0.1, 2049, 70000, -1e-9))) == [0.0, 1.0, 0.0999755859375, 2048.0, float("inf"), -0.0]
    assert one(spark, vectors.dense(vectors.sparse(v(0, 3, 0, -1)), 4)) == [0.0, 3.0, 0.0, -1.0]
    with pytest.raises(Exception, match="expected 3 dimensions"):
        spark.range(1).select(vectors.checked(v(1, 2), 3)).collect()


def test_signals(spark):
    scores = lambda *x: spark.createDataFrame([(i, float(s)) for i, s in enumerate(x)], "id int, score double")
    apart = lambda *x: ranking.separation(scores(*x)).first()[0]
    assert apart(4, 1, 1) == 0.75 and apart(2, 2) == 0.0 and apart(5) == 0.0 and apart(-1, -2) == 0.0
    assert ranking.separation(scores(1).limit(0)).first()[0] == 0.0
    weight = lambda *x: round(one(spark, ranking.adaptive_weight(*map(F.lit, map(float, x)))), 6)
    assert weight(0, 0, 0, 0, 0) == 0.35 and weight(1, 0, 1, 0, 0) == 0.55 and weight(0, 1, 0, 1, 1) == 0.05
    assert ranking.exact_first(1000, 10**9) and not ranking.exact_first(10**6, 10**6)
    with pytest.raises(ValueError):
        ranking.one_sided("id")
    only = ranking.one_sided("id", word_scores=scores(3, 1), ceiling=4.0).orderBy("id").collect()
    assert [round(r.confidence, 4) for r in only] == [0.4875, 0.1625]


def test_user_functions(spark):
    functions.scalar(spark, "kq_one", lambda x: x + 1, "long")
    functions.aggregate(spark, "kq_top", lambda x: float(x.max()), "double")
    assert spark.sql("SELECT kq_one(id) AS x FROM range(3)").agg(F.sum("x")).first()[0] == 6
    with pytest.raises(Exception, match="wrong number of arguments"):
        spark.sql("SELECT kq_one(id, id) FROM range(3)").collect()
    assert spark.sql("SELECT kq_top(CAST(id AS DOUBLE)) AS x FROM range(5)").first().x == 4.0
    collation.register("length", F.length)
    assert one(spark, collation.collated(F.lit("abc"), "length")) == 3
    with pytest.raises(ValueError):
        collation.collated(F.lit("a"), "klingon")
