"""JSON editing, formatted text, time differences, polygons, exported lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formatting, geopoly, jsonedit, lenient
from ..sources import export
from .registry import query

_K = "json_extract_string(props, '$.k')"


@query("json_set", f"SELECT event_id, '{{\"k\":' || {_K} || ',\"z\":' || event_id || '}}' AS a, '{{\"k\":\"x\"}}' AS b FROM events", "events")
def _set(events):
    return events.select("event_id", jsonedit.json_set(F.col("props"), "$.z", F.col("event_id")).alias("a"), jsonedit.json_set(F.col("props"), "$.k", F.lit("x")).alias("b"))


@query("json_insert_replace", f"SELECT event_id, '{{\"k\":' || {_K} || '}}' AS a, '{{\"k\":' || {_K} || ',\"t\":\"' || event_type || '\"}}' AS b, '{{\"k\":0}}' AS c, '{{\"k\":' || {_K} || '}}' AS d FROM events", "events")
def _insert(events):
    p = F.col("props")
    return events.select(
        "event_id", jsonedit.json_insert(p, "$.k", F.lit(0)).alias("a"), jsonedit.json_insert(p, "$.t", F.col("event_type")).alias("b"),
        jsonedit.json_replace(p, "$.k", F.lit(0)).alias("c"), jsonedit.json_replace(p, "$.none", F.lit(0)).alias("d"),
    )


@query("json_remove", "SELECT event_id, '{}' AS a, CAST(json_merge_patch(props, '{}') AS VARCHAR) AS b FROM events", "events")
def _remove(events):
    return events.select("event_id", jsonedit.json_remove(F.col("props"), "$.k").alias("a"), jsonedit.json_remove(F.col("props"), "$.none").alias("b"))


@query("json_patch", "SELECT event_id, CAST(json_merge_patch(props, '{\"n\":1}') AS VARCHAR) AS a, CAST(json_merge_patch(props, '{\"k\":null,\"n\":{\"m\":2}}') AS VARCHAR) AS b FROM events", "events")
def _patch(events):
    p = F.col("props")
    return events.select("event_id", jsonedit.json_patch(p, F.lit('{"n":1}')).alias("a"), jsonedit.json_patch(p, F.lit('{"k":null,"n":{"m":2}}')).alias("b"))


@query("json_types", "SELECT event_id, lower(json_type(props)) AS a, CASE json_type(props, '$.k') WHEN 'UBIGINT' THEN 'integer' END AS b, json_valid(props) AS c, json_valid(event_type) AS d, CAST(json_array_length('[1,[2,3]]', '$[1]') AS BIGINT) AS e FROM events", "events")
def _types(events):
    p = F.col("props")
    return events.select("event_id", jsonedit.json_type(p).alias("a"), jsonedit.json_type(p, "$.k").alias("b"), jsonedit.json_valid(p).alias("c"), jsonedit.json_valid(F.col("event_type")).alias("d"), jsonedit.json_array_length(F.lit("[1,[2,3]]"), "$[1]").alias("e"))


@query("json_tree", "SELECT event_id, t.key, t.fullkey, t.path, CAST(t.atom AS VARCHAR) AS atom FROM (SELECT event_id, '{\"a\":[' || event_id || ',{\"b\":null}],\"c\":' || props || '}' AS j FROM events), json_tree(j) t", "events")
def _tree(events):
    docs = events.select("event_id", F.concat(F.lit('{"a":['), F.col("event_id").cast("string"), F.lit(',{"b":null}],"c":'), F.col("props"), F.lit("}")).alias("j"))
    return jsonedit.json_tree(docs, "j", "event_id").select("event_id", "key", "fullkey", "path", "atom")


@query("printf_forms", """
SELECT p_partkey, printf('%05d|%.2f|%x|%-30s|', p_size, p_retailprice, p_partkey, p_name) AS a, printf('%,d of %e', p_partkey * 1000, p_retailprice) AS b,
  '''' || replace(p_name, '''', '''''') || '''' || left(p_brand, 3) || '%' AS c FROM part""", "part")
def _printf(part):
    size, price, key, name = map(F.col, ("p_size", "p_retailprice", "p_partkey", "p_name"))
    return part.select(
        "p_partkey", formatting.printf("%05d|%.2f|%x|%-30s|", size, price, key, name).alias("a"),
        formatting.printf("%,d of %e", key * 1000, price).alias("b"), formatting.printf("%Q%.3s%%", name, F.col("p_brand")).alias("c"),
    )


@query("storage_classes", "SELECT p_partkey, 'integer' AS a, 'real' AS b, 'text' AS c, CASE WHEN p_size > 25 THEN 'integer' ELSE 'null' END AS d FROM part", "part")
def _classes(part):
    c = formatting.storage_class
    return part.select("p_partkey", c(F.col("p_partkey")).alias("a"), c(F.col("p_retailprice")).alias("b"), c(F.col("p_name")).alias("c"), c(F.when(F.col("p_size") > 25, F.col("p_size"))).alias("d"))


@query("timediff", """
WITH t AS (SELECT l_orderkey, l_linenumber, l_shipdate AS a, o_orderdate AS b, 12 * (year(l_shipdate) - year(o_orderdate)) + month(l_shipdate) - month(o_orderdate) AS m
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate),
s AS (SELECT *, date_trunc('month', b) AS first, b - date_trunc('month', b) AS inside FROM t),
n AS (SELECT *, CASE WHEN first + m * INTERVAL 1 MONTH + inside <= a THEN m WHEN first + (m - 1) * INTERVAL 1 MONTH + inside <= a THEN m - 1 ELSE m - 2 END AS k FROM s),
r AS (SELECT *, epoch_us(a) - epoch_us(first + k * INTERVAL 1 MONTH + inside) AS us FROM n)
SELECT l_orderkey, l_linenumber, printf('+%04d-%02d-%02d %02d:%02d:%02d.000', k // 12, k % 12, us // 86400000000, us // 3600000000 % 24, us // 60000000 % 60, us // 1000000 % 60) AS d FROM r""", "lineitem", "orders")
def _timediff(lineitem, orders):
    both = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate >= o_orderdate")
    return both.select("l_orderkey", "l_linenumber", lenient.timediff(F.col("l_shipdate"), F.col("o_orderdate")).alias("d"))


@query("geopoly_functions", """
SELECT n_nationkey, round(3 * r * r * sin(pi() / 3), 6) AS area, n_nationkey + r AS right_edge, CASE WHEN r > 2.25 THEN 2 ELSE 0 END AS inside, round(12 * r * r * sin(pi() / 3), 6) AS grown
FROM (SELECT n_nationkey, n_regionkey + 1.0::DOUBLE AS r FROM nation)""", "nation")
def _geopoly(nation):
    x, r = F.col("n_nationkey"), F.col("n_regionkey") + 1.0
    p = geopoly.regular(x, F.lit(0.0), r, 6)
    return nation.select(
        "n_nationkey", F.round(geopoly.area(p), 6).alias("area"), F.round(geopoly.bbox(p)[2]["x"], 6).alias("right_edge"),
        geopoly.contains_point(p, x + 2.25, F.lit(0.0)).alias("inside"), F.round(geopoly.area(geopoly.xform(p, 2, 0, 0, 2, 5, 5)), 6).alias("grown"),
    )


@query("geopoly_group_bbox", "SELECT n_regionkey, CAST(min(n_nationkey) - 1 AS DOUBLE) AS x0, CAST(max(n_nationkey) + 1 AS DOUBLE) AS x1 FROM nation GROUP BY n_regionkey", "nation")
def _group_bbox(nation):
    p = geopoly.regular(F.col("n_nationkey"), F.lit(0.0), F.lit(1.0), 4)
    box = nation.groupBy("n_regionkey").agg(geopoly.group_bbox(p).alias("box"))
    return box.select("n_regionkey", F.round(F.col("box")[0]["x"], 6).alias("x0"), F.round(F.col("box")[2]["x"], 6).alias("x1"))


@query("export_insert", "SELECT 'INSERT INTO \"nation\" VALUES(' || n_nationkey || ',''' || replace(n_name, '''', '''''') || ''',' || n_regionkey || ');' AS line FROM nation", "nation")
def _export_insert(nation):
    return export.lines(nation.select("n_nationkey", "n_name", "n_regionkey"), "insert", "nation")


@query("export_json", "SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS line FROM region", "region")
def _export_json(region):
    return export.lines(region.select("r_regionkey", "r_name"), "json")


@query("export_markdown", "SELECT '| ' || n_nationkey || ' | ' || n_name || ' |' AS line FROM nation", "nation")
def _export_markdown(nation):
    return export.lines(nation.select("n_nationkey", "n_name"), "markdown")
