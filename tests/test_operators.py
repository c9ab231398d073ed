"""Operators and functions on small tables with golden answers, nulls, ties and empty inputs."""

import zipfile

import pytest
from pyspark.sql import functions as F

from kestrelq.functions import lenient, vectors
from kestrelq.operators import chunking, fulltext, joins, merge, ranking, recursion, stemming
from kestrelq.sources import readers
from kestrelq.streaming import windows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_vector_functions(spark):
    v = lambda *x: F.array(*(F.lit(float(i)) for i in x))
    assert one(spark, vectors.l1(v(1, 2), v(4, 0))) == 5
    assert one(spark, vectors.l2(v(0, 0), v(3, 4))) == 5
    assert one(spark, vectors.dot(v(1, 2), v(3, 4))) == 11
    assert one(spark, vectors.cosine_distance(v(1, 0), v(0, 1))) == 1
    assert one(spark, vectors.hamming(vectors.bits(v(1, -1, 1)), vectors.bits(v(-1, 1, 1)))) == 2
    assert one(spark, vectors.jaccard(v(1, 1, 0), v(1, 0, 0))) == 0.5
    assert one(spark, vectors.normalised(v(3, 4))) == [0.6, 0.8]
    assert one(spark, vectors.normalised(v(0, 0))) == [0, 0]
    assert one(spark, vectors.int8(v(1, -2))) == [64, -127]
    assert one(spark, vectors.truncated(v(3, 4, 9), 2)) == [0.6, 0.8]
    assert one(spark, vectors.multiply(v(1, 2), v(3, 4))) == [3, 8] and one(spark, vectors.subtract(v(1, 2), v(3, 4))) == [-2, -2]


def test_vector_table(spark):
    table = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [5.0, 5.0]), (4, [1.0, 1.0]), (5, None)], "vec_id int, embedding array<double>")
    assert [r.vec_id for r in ranking.nearest(table, [1.0, 0.1], 2, "l2").collect()] == [1, 4]


def test_text_functions(spark):
    x = F.lit("hello")
    for start, length, want in ((1, 3, "hel"), (-3, None, "llo"), (0, 3, "he"), (2, None, "ello"), (-3, 2, "ll"), (4, -2, "el"), (9, 2, ""), (-9, 6, "he")):
        assert one(spark, lenient.substr(x, start, length)) == want, (start, length)
    assert one(spark, lenient.upper(F.lit("aé"))) == "Aé" and one(spark, lenient.lower(F.lit("AÉ"))) == "aÉ"
    for text, pattern, want in (("abc", "a*", True), ("abc", "a?", False), ("a.c", "a[.]c", True), ("abc", "a[^x]c", True), ("ABC", "a*", False), ("a\nb", "a*b", True)):
        assert one(spark, lenient.glob(F.lit(text), pattern)) is want
    assert one(spark, lenient.like(F.lit("ABC"), "a_c")) and one(spark, lenient.like(F.lit("5%"), "5!%", "!"))
    assert one(spark, lenient.to_integer(F.lit("12abc"))) == 12 and one(spark, lenient.to_integer(F.lit("x"))) == 0
    assert one(spark, lenient.to_real(F.lit(" -1.5e2z"))) == -150.0
    assert one(spark, lenient.divide(F.lit(-7), F.lit(2))) == -3 and one(spark, lenient.divide(F.lit(1), F.lit(0))) is None
    assert one(spark, lenient.quote(F.lit("it's"))) == "'it''s'" and one(spark, lenient.quote(F.lit(None).cast("string"))) == "NULL"
    assert one(spark, lenient.greatest(F.lit(1), F.lit(None).cast("int"))) is None and one(spark, lenient.least(F.lit(1), F.lit(2))) == 1


def test_dates(spark):
    t = F.to_timestamp(F.lit("2024-01-31 10:00:00"))
    text = lambda *m: str(one(spark, lenient.modified(t, *m)))
    assert text("+1 month") == "2024-03-02 10:00:00" and text("start of month", "-1 day") == "2023-12-31 00:00:00"
    assert text("weekday 0") == "2024-02-04 10:00:00" and text("+1.5 hours") == "2024-01-31 11:30:00"
    assert one(spark, lenient.julianday(F.to_timestamp(F.lit("2000-01-01 12:00:00")))) == 2451545.0
    with pytest.raises(ValueError):
        lenient.modified(t, "+1 fortnight")


def test_chunks(spark):
    cut = lambda t, *x: [t[a:b] for a, b in chunking.chunk_spans(t, *x)]
    assert chunking.chunk_spans("aaaa bbbb cccc dddd", 9, 0) == [(0, 5), (5, 10), (10, 19)]
    assert cut("a" * 8 + "\n\n" + "b" * 20, 10, 0)[0] == "a" * 8 + "\n\n"
    assert cut("aaaaaaa. bbbbbbbbbbbb", 10, 0)[0] == "aaaaaaa. " and cut("aa bb cc dd ee ff", 10, 0)[0] == "aa bb cc "
    assert cut("abcdefghijkl", 5, 0) == ["abcde", "fghij", "kl"] and cut("", 5, 0) == []
    text = "The fox.  Jumps over\nthe dog!\n\nA new one? Yes. Others run on without stopping for a long while."
    for size in range(1, 60):
        for overlap in range(0, size, 3):
            spans = chunking.chunk_spans(text, size, overlap)
            assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(b[0] <= a[1] and a[0] < b[0] <= b[1] and b[1] - b[0] <= size for a, b in zip(spans, spans[1:]))
    headed = chunking.chunk_text(spark.createDataFrame([(1, "ab cd")], "doc_id long, text string"), size=5, heading="H").first()
    assert headed.chunk == "H\n\nab cd" and (headed.start, headed.length) == (0, 5)
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "word " * 500)], "doc_id long, text string")
    got = chunking.chunk_text(docs, size=50).collect()
    assert {r.id for r in got} == {3} and "".join(r.chunk.replace(" ", "") for r in got) == "word" * 500
    with pytest.raises(ValueError):
        chunking.chunk_text(docs, size=0)


def test_query_language(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox"), (2, "a slow brown dog"), (3, "Quick the-fox"), (4, None), (5, "")], "doc_id int, text string")
    ids = lambda q: {r.doc_id for r in fulltext.search(docs, q).collect()}
    assert ids("brown") == {1, 2} and ids("brown NOT dog") == {1} and ids("fox OR dog") == {1, 2, 3}
    assert ids('"quick brown"') == {1} and ids("qu*") == {1, 3} and ids("^quick") == {3} and ids("quick fox") == {1, 3}
    assert ids("NEAR(quick fox, 1)") == {1, 3} and ids("(fox OR dog) AND brown") == {1, 2} and ids("slow OR quick NOT brown") == {2, 3}
    for bad in ("(a", "AND", "a OR", ")"):
        with pytest.raises(ValueError):
            fulltext.Query(bad)
    assert one(spark, fulltext.highlight(F.lit("The fox, then"), "the")) == "[The] fox, then"
    assert one(spark, fulltext.trigrams(F.lit("abcd"))) == ["abc", "bcd"] and one(spark, fulltext.trigrams(F.lit("ab"))) == []


def test_asof_and_interval(spark):
    left = spark.createDataFrame([("a", 1, "2024-01-05"), ("a", 2, "2024-06-01"), ("a", 3, "2023-01-01"), ("b", 4, "2024-06-01"), ("a", 5, None)], "k string, id int, d string").select("k", "id", F.to_timestamp("d").alias("t"))
    right = spark.createDataFrame([("a", 10, "2024-01-01"), ("a", 11, "2024-01-05"), ("b", 12, "2024-07-01")], "k string, v int, d string").select("k", "v", F.to_timestamp("d").alias("u"))
    got = {r.id: r.v for r in joins.asof(left, right, "t", "u", ("k",)).collect()}
    assert got == {1: 11, 2: 11, 3: None, 4: None, 5: None}
    spans = spark.createDataFrame([(1, 0.0, 5.0), (2, 4.0, 100.0), (3, 9.0, 1.0)], "s int, lo double, hi double")
    points = spark.createDataFrame([(0.0,), (5.0,), (50.0,), (-1.0,), (None,)], "p double")
    assert sorted((r.p, r.s) for r in joins.interval(points, spans, "p", "lo", "hi", 7).collect()) == [(0.0, 1), (5.0, 1), (5.0, 2), (50.0, 2)]


def test_fixpoint_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6)], "a int, b int")
    seed = spark.createDataFrame([(1,)], "n int")
    assert {r.n for r in recursion.fixpoint(seed, lambda d: d.join(edges, d.n == edges.a).select(F.col("b").alias("n"))).collect()} == {1, 2, 3}


def test_changes(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    rows = spark.createDataFrame([(2, "x"), (3, "y")], "k int, v string")
    as_dict = lambda d: {r.k: r.v for r in d.collect()}
    assert as_dict(merge.upsert(table, rows, ["k"])) == {1: "a", 2: "x", 3: "y"}
    assert as_dict(merge.insert_or_ignore(table, rows, ["k"])) == {1: "a", 2: "b", 3: "y"}
    assert as_dict(merge.delete(table, rows, ["k"])) == {1: "a"}
    assert [r.k for r in merge.violations(rows, ["k"], table, ["k"]).collect()] == [3]


def test_fusion(spark):
    a = spark.createDataFrame([(1, 0.9), (2, 0.1)], "id int, score double")
    b = spark.createDataFrame([(2, 5.0), (3, 5.0)], "id int, score double")
    got = {r.id: (round(r.score, 3), r.origin) for r in ranking.minmax(a, b, "id").collect()}
    assert got == {1: (0.35, "vector"), 2: (0.65, "both"), 3: (0.65, "lexical")}


def test_streams_and_tables_agree(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp"))
    q = windows.windowed(stream, ["event_type"]).writeStream.outputMode("complete").format("memory").queryName("windows_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda d: sorted((r.event_type, str(r.start), r.n) for r in d.collect())
    assert key(spark.table("windows_out")) == key(windows.windowed(events.withColumn("ts", F.col("ts").cast("timestamp")), ["event_type"]))


def test_readers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    readers.write_csv(df, str(tmp_path / "c"))
    assert sorted(r.k for r in readers.csv(spark, str(tmp_path / "c"), "k int, v string").collect()) == [1, 2]
    df.write.json(str(tmp_path / "j"))
    assert readers.json_lines(spark, str(tmp_path / "j"), "k int, v string").count() == 2
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("one.txt", "hello")
    assert [(r.name, bytes(r.data)) for r in readers.zip_entries(spark, str(tmp_path / "z.zip")).collect()] == [("one.txt", b"hello")]
    assert readers.files(spark, str(tmp_path)).count() >= 3


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_registered_index_query_recalls_nine_of_ten(spark, size):
    from kestrelq.plans import registry, retrieval

    registry.load()
    table = spark.read.parquet(f"/root/testdata/{size}/embeddings.parquet")
    want = {r.vec_id for r in ranking.nearest(table, retrieval.QUERY_VECTOR, 10, "l2").collect()}
    got = {r.vec_id for r in registry.QUERIES["vec_ivf_topk"](spark, f"/root/testdata/{size}").collect()}
    assert len(want) == 10 and len(want & got) >= 9


def test_stems_and_snippets_run_over_documents(spark):
    from kestrelq.plans import registry

    registry.load()
    small = "/root/testdata/sf0.001"
    found = registry.QUERIES["fts_snippet"](spark, small)
    assert {r.doc_id for r in found.collect()} == {r.doc_id for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id").collect()}
    documents = spark.read.parquet(f"{small}/documents.parquet")
    want = stemming.stem_vocabulary(documents, "doc_id").collect()
    assert sorted(map(tuple, registry.QUERIES["fts_porter_vocab"](spark, small).collect())) == sorted(map(tuple, want))
