"""JSON editing, formatted text, polygons, stems, inverted lists, exports and SQLite files on small inputs."""

import json
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrelq.functions import formatting, geopoly, jsonedit, lenient
from kestrelq.operators import fulltext, ivf, ranking, stemming
from kestrelq.sources import database, export


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_json_edits(spark):
    x = F.lit('{"a":[1,2],"b":{"c":"d"}}')
    for got, want in (
        (jsonedit.json_set(x, "$.a[0]", F.lit(9)), '{"a":[9,2],"b":{"c":"d"}}'),
        (jsonedit.json_set(x, "$.a[#]", F.lit(3)), '{"a":[1,2,3],"b":{"c":"d"}}'),
        (jsonedit.json_set(x, "$.n.m", F.lit(True)), '{"a":[1,2],"b":{"c":"d"},"n":{"m":true}}'),
        (jsonedit.json_set(x, "$.a[7]", F.lit(3)), '{"a":[1,2],"b":{"c":"d"}}'),
        (jsonedit.json_insert(x, "$.b.c", F.lit("z")), '{"a":[1,2],"b":{"c":"d"}}'),
        (jsonedit.json_replace(x, '$."b"', F.lit(None).cast("int")), '{"a":[1,2],"b":null}'),
        (jsonedit.json_remove(x, "$.a[#-1]", "$.b"), '{"a":[1]}'),
        (jsonedit.json_remove(x, "$"), None),
        (jsonedit.json_array_insert(x, "$.a[1]", F.lit(7)), '{"a":[1,7,2],"b":{"c":"d"}}'),
        (jsonedit.json_extract(x, "$.a[#-1]"), "2"),
        (jsonedit.json_extract(x, "$.none"), None),
        (jsonedit.json_type(x, "$.b.c"), "text"),
        (jsonedit.json_type(F.lit("[1.5]"), "$[0]"), "real"),
        (jsonedit.json_array_length(x, "$.a"), 2),
        (jsonedit.json_array_length(x), 0),
        (jsonedit.json_set(F.lit("{bad"), "$.a", F.lit(1)), None),
        (jsonedit.json_set(F.lit(None).cast("string"), "$.a", F.lit(1)), None),
        (jsonedit.json_patch(x, F.lit('{"a":null,"b":{"e":1}}')), '{"b":{"c":"d","e":1}}'),
        (jsonedit.json_valid(F.lit("[")), False),
        (jsonedit.json_valid(F.lit(None).cast("string")), None),
        (jsonedit.json_pretty(F.lit('{"a":1}')), '{\n    "a": 1\n}'),
    ):
        assert one(spark, got) == want, want
    with pytest.raises(ValueError):
        jsonedit.steps("a.b")


def test_json_tree(spark):
    table = spark.createDataFrame([(1, '{"a":[1,{"x y":null}]}'), (2, None), (3, "no"), (4, "5")], "id int, j string")
    rows = jsonedit.json_tree(table.withColumnRenamed("id", "doc"), "j", "doc").collect()
    assert [(r.doc, r.fullkey, r.type, r.id, r.parent) for r in rows if r.doc == 4] == [(4, "$", "integer", 0, None)]
    assert sorted((r.fullkey, r.type, r.path) for r in rows if r.doc == 1) == [("$", "object", "$"), ("$.a", "array", "$"), ("$.a[0]", "integer", "$.a"), ("$.a[1]", "object", "$.a"), ('$.a[1]."x y"', "null", "$.a[1]")]
    assert not [r for r in rows if r.doc in (2, 3)]


def test_printf(spark):
    null = F.lit(None).cast("string")
    for pattern, values, want in (
        ("%d-%i%%", (F.lit(5), F.lit(-3)), "5--3%"),
        ("[%5d|%-5d|%05d|%+d]", (F.lit(42),) * 4, "[   42|42   |00042|+42]"),
        ("[%*d]", (F.lit(4), F.lit(7)), "[   7]"),
        ("%x %X %o", (F.lit(255),) * 3, "ff FF 377"),
        ("%.3f %10.2f|", (F.lit(3.14159), F.lit(2.5)), "3.142       2.50|"),
        ("%g %g %g %g", (F.lit(100000.0), F.lit(1e6), F.lit(0.0001), F.lit(0.00001)), "100000 1e+06 0.0001 1e-05"),
        ("%s|%.2s|%c", (F.lit("ab"), F.lit("xyz"), F.lit("qr")), "ab|xy|q"),
        ("%q %Q %w %Q", (F.lit("it's"), F.lit("it's"), F.lit('a"b'), null), "it''s 'it''s' a\"\"b NULL"),
        ("%d|%s|", (null, null), "0||"),
        ("plain", (), "plain"),
        ("%,d", (F.lit(1234567),), "1,234,567"),
    ):
        assert one(spark, formatting.printf(pattern, *values)) == want, pattern


def test_codes_and_blobs(spark):
    assert one(spark, formatting.char(F.lit(72), F.lit(8364))) == "H€"
    assert one(spark, formatting.unistr(F.lit("\\0041\\u00e9\\\\\\U0001F600"))) == "Aé\\😀"
    assert bytes(one(spark, formatting.zeroblob(F.lit(3)))) == b"\0\0\0"
    assert one(spark, formatting.soundex(F.lit("Robert"))) == "R163" and one(spark, formatting.soundex(F.lit(""))) == "?000"
    for text in ("a", "a" * 500, ""):
        packed = formatting.compress(F.lit(text))
        assert bytes(one(spark, formatting.uncompress(packed, F.lit(len(text))))).decode() == text
        assert len(one(spark, packed)) <= len(text)


def test_timediff(spark):
    for a, b, want in (
        ("2023-03-01 00:00:00", "2023-01-31 00:00:00", "+0000-00-29 00:00:00.000"),
        ("2024-02-29 12:00:01.5", "2023-02-28 11:00:00", "+0001-00-01 01:00:01.500"),
        ("2023-01-01 00:00:00", "2023-02-15 00:00:00", "-0000-01-14 00:00:00.000"),
        ("2023-01-01 00:00:00", "2023-01-01 00:00:00", "+0000-00-00 00:00:00.000"),
        ("2022-12-31 23:59:59", "2023-01-01 00:00:00", "-0000-00-00 00:00:01.000"),
        (None, "2023-01-01 00:00:00", None),
    ):
        assert one(spark, lenient.timediff(F.lit(a).cast("timestamp"), F.lit(b).cast("timestamp"))) == want, (a, b)


def test_polygons(spark):
    square = geopoly.from_json(F.lit("[[0,0],[4,0],[4,3],[0,3],[0,0]]"))
    assert one(spark, geopoly.area(square)) == 12
    assert json.loads(one(spark, geopoly.to_json(square))) == [[0, 0], [4, 0], [4, 3], [0, 3], [0, 0]]
    for x, y, want in ((1, 1, 2), (4, 1, 1), (0, 0, 1), (5, 1, 0), (2, 3, 1), (-1, 0, 0)):
        assert one(spark, geopoly.contains_point(square, F.lit(float(x)), F.lit(float(y)))) == want, (x, y)
    back = geopoly.from_json(F.lit("[[0,0],[0,3],[4,3],[4,0]]"))
    assert one(spark, geopoly.signed_area(back)) == -12 and one(spark, geopoly.signed_area(geopoly.ccw(back))) == 12
    assert one(spark, geopoly.from_json(F.lit("[[0,0],[1,1]]"))) is None
    assert one(spark, geopoly.area(geopoly.from_json(F.lit(None).cast("string")))) is None


def test_stems(spark):
    # published examples of the rules
    want = dict(
        caresses="caress", ponies="poni", ties="ti", cats="cat", feed="feed", agreed="agre", plastered="plaster", bled="bled", motoring="motor", sing="sing",
        conflated="conflat", troubled="troubl", sized="size", hopping="hop", tanned="tan", falling="fall", hissing="hiss", fizzed="fizz", failing="fail", filing="file",
        happy="happi", sky="sky", relational="relat", conditional="condit", rational="ration", digitizer="digit", vietnamization="vietnam", operator="oper", feudalism="feudal",
        decisiveness="decis", hopefulness="hope", formaliti="formal", sensitiviti="sensit", triplicate="triplic", formative="form", formalize="formal", electrical="electr",
        goodness="good", revival="reviv", allowance="allow", inference="infer", airliner="airlin", adjustable="adjust", replacement="replac", adoption="adopt", communism="commun",
        effective="effect", probate="probat", rate="rate", cease="ceas", controll="control", roll="roll", generalizations="gener", oscillators="oscil",
    )
    assert {w: stemming.stem(w) for w in want} == want
    assert stemming.stem("été") == "été" and stemming.stem("is") == "is"
    docs = spark.createDataFrame([(1, "Hopping, hopped: hop!"), (2, "none"), (3, None)], "doc_id int, text string")
    assert [(r.doc_id, r.hits) for r in stemming.search(docs, "hops").collect()] == [(1, 3)]
    vocab = {r.stem: (r.forms, r.hits) for r in stemming.stem_vocabulary(docs).collect()}
    assert vocab == {"hop": (3, 3), "none": (1, 1)}


def test_snippet(spark):
    text = "one two three four five six. Seven eight nine ten fox dog eleven"
    cut = lambda t, *words, n=3: one(spark, stemming.snippet(F.lit(t).cast("string"), list(words), size=n))
    assert cut(text, "fox", "dog") == "...[fox] [dog] eleven"
    assert cut(text, "fox") == "...ten [fox] dog..."  # a hit stands in the middle
    assert cut(text, "fox", n=5) == "...Seven eight nine ten [fox]..."  # a sentence's begin that reaches the hit is worth more
    assert cut(text, "nine", n=5) == "...Seven eight [nine] ten fox..."  # from the sentence's begin
    assert cut(text, "three", "five", n=5) == "one two [three] four [five]..."
    assert cut("What? yes! no, maybe so: here it stands now and then", "it", n=4) == "...here [it] stands now..."
    assert cut("x y x z w v x x q", "x", n=3) == "[x] y [x]..."
    assert cut(text, "absent") == "one two three..."
    assert cut("a b", "b") == "a [b]" and cut("", "b") == "" and cut(None, "b") is None


def test_inverted_lists(spark):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(6, 8)) * 5
    points = [(i, (centres[i % 6] + draw.normal(size=8)).tolist()) for i in range(600)] + [(900, None), (901, [1.0])]
    table = spark.createDataFrame(points, "vec_id long, embedding array<double>")
    learned = ivf.train(table.where("size(embedding) = 8"), 6)
    index = ivf.assigned(table, learned).cache()
    assert index.count() == 602 and index.where("list is null").count() == 2
    exact = [r.vec_id for r in ranking.nearest(table, points[7][1], 10, "l2").collect()]
    assert [r.vec_id for r in ivf.search(index, learned, points[7][1], 10, probes=6).collect()] == exact
    assert len(set(exact) & {r.vec_id for r in ivf.search(index, learned, points[7][1], 10, probes=2).collect()}) >= 9
    index.unpersist()


def test_diversified(spark):
    rows = [(0, 1, 1.0, [1.0, 0.0]), (0, 2, 0.99, [1.0, 0.0]), (0, 3, 0.8, [0.0, 1.0]), (1, 4, 0.5, [1.0, 0.0]), (1, 5, 0.4, None)]
    table = spark.createDataFrame(rows, "g int, id long, s double, v array<double>")
    pick = lambda **o: sorted((r.g, r["rank"], r.id) for r in ranking.diversified(table, "g", "id", "s", "v", **o).collect())
    assert pick(k=2, balance=0.5) == [(0, 1, 1), (0, 2, 3), (1, 1, 4)]
    assert pick(k=2, balance=1.0) == [(0, 1, 1), (0, 2, 2), (1, 1, 4)]
    assert not ranking.diversified(table.limit(0), "g", "id", "s", "v").collect()


def test_nearest_each(spark):
    table = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(5)] + [(9, [2.0, 0.0]), (10, None), (11, [1.0])], "vec_id long, embedding array<double>")
    got = ranking.nearest_each(table, F.col("vec_id") == 2, 3).collect()
    assert [(r.query_id, r.vec_id, r.distance) for r in sorted(got, key=lambda r: r["rank"])] == [(2, 9, 0.0), (2, 1, 1.0), (2, 3, 1.0)]


def test_confidence_scale(spark):
    docs = spark.createDataFrame([(1, "fox fox"), (2, "dog"), (3, "cat"), (4, "cow")], "doc_id int, text string")
    top = fulltext.ceiling(docs, ["fox", "absent"]).first().ceiling
    assert top == pytest.approx(np.log(3.5 / 1.5) * 2.2)
    assert one(spark, ranking.confidence(F.lit(2.0), F.lit(None).cast("double"), F.lit(0.0), 0.4)) == pytest.approx(0.4)


def test_export(spark):
    table = spark.createDataFrame([(1, "it's", 1.5), (2, None, None)], "a int, b string, c double")
    mode = lambda m: [r.line for r in export.lines(table, m, "t").collect()]
    assert mode("insert") == ['INSERT INTO "t" VALUES(1,\'it\'\'s\',1.5);', 'INSERT INTO "t" VALUES(2,NULL,NULL);']
    assert mode("json") == ['{"a":1,"b":"it\'s","c":1.5}', '{"a":2,"b":null,"c":null}']
    assert mode("list") == ["1|it's|1.5", "2||"] and mode("markdown")[0] == "| 1 | it's | 1.5 |"
    assert mode("html")[1] == "<tr><td>2</td><td></td><td></td></tr>" and mode("csv")[0] == "1,it's,1.5"
    with pytest.raises(ValueError):
        export.lines(table, "none")


def test_sqlite_file(spark, tmp_path):
    path = str(tmp_path / "a.db")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE t(id INTEGER PRIMARY KEY, name TEXT, x REAL, raw BLOB, odd INTEGER)")
        con.executemany("INSERT INTO t VALUES(?,?,?,?,?)", [(i, f"n{i}", i / 2, b"\1", "text" if i == 3 else i) for i in range(1, 101)])
        con.execute("CREATE TABLE w(k TEXT PRIMARY KEY, v INTEGER) WITHOUT ROWID")
        con.execute("INSERT INTO w VALUES('a', 1)")
        con.execute("CREATE TABLE empty(x INTEGER)")
    found = database.sqlite_table(spark, path, "t", parts=4)
    assert found.dtypes == [("id", "bigint"), ("name", "string"), ("x", "double"), ("raw", "binary"), ("odd", "bigint")]
    assert found.rdd.getNumPartitions() == 4 and found.agg(F.sum("id")).first()[0] == 5050
    assert found.where("id = 3").first().odd is None
    assert [tuple(r) for r in database.sqlite_table(spark, path, "w").collect()] == [("a", 1)]
    assert database.sqlite_table(spark, path, "empty").count() == 0
