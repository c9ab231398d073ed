"""Text, number, date and JSON functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lenient
from ..streaming import windows
from .registry import query, sql_query

sql_query("text_functions", "SELECT p_partkey, CAST(length(p_name) AS BIGINT) AS n, upper(p_name) AS u, replace(p_name, 'a', 'A') AS r, CAST(instr(p_name, 'e') AS BIGINT) AS i, trim(p_name) AS t, concat_ws('-', p_brand, p_type) AS c, reverse(p_name) AS rev, lpad(p_brand, 12, '*') AS lp FROM part")
sql_query("text_codes", "SELECT p_partkey, hex(p_name) AS h, ascii(p_name) AS a, char(65 + p_size % 26) AS c, repeat('ab', p_size % 4) AS r FROM part", "SELECT p_partkey, hex(p_name) AS h, ascii(p_name) AS a, chr(65 + p_size % 26) AS c, repeat('ab', p_size % 4) AS r FROM part")
sql_query("number_functions", "SELECT p_partkey, round(sqrt(p_retailprice), 6) AS sq, CAST(ceil(p_retailprice) AS BIGINT) AS up, CAST(floor(-p_retailprice) AS BIGINT) AS down, round(ln(p_retailprice), 6) AS l, round(log10(p_retailprice), 6) AS l10, round(power(p_size, 1.5D), 4) AS pw, CAST(sign(p_retailprice - 1000) AS DOUBLE) AS sg FROM part", "SELECT p_partkey, round(sqrt(p_retailprice), 6) AS sq, CAST(ceil(p_retailprice) AS BIGINT) AS up, CAST(floor(-p_retailprice) AS BIGINT) AS down, round(ln(p_retailprice), 6) AS l, round(log10(p_retailprice), 6) AS l10, round(power(p_size, 1.5::DOUBLE), 4) AS pw, CAST(sign(p_retailprice - 1000) AS DOUBLE) AS sg FROM part")
sql_query("trigonometry", "SELECT p_partkey, round(sin(p_size), 6) AS s, round(atan2(p_size, 3), 6) AS a, round(degrees(p_size), 4) AS d, round(tanh(p_size / 50.0D), 6) AS t, round(pi(), 6) AS pi FROM part", "SELECT p_partkey, round(sin(p_size), 6) AS s, round(atan2(p_size, 3), 6) AS a, round(degrees(p_size), 4) AS d, round(tanh(p_size / 50.0::DOUBLE), 6) AS t, round(pi(), 6) AS pi FROM part")
sql_query("date_parts", "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(dayofyear(o_orderdate) AS BIGINT) AS j, CAST(quarter(o_orderdate) AS BIGINT) AS q, CAST(weekofyear(o_orderdate) AS BIGINT) AS w FROM orders")
sql_query("strftime_formats", "SELECT event_id, date_format(ts, 'yyyy-MM-dd HH:mm:ss') AS full_text, date_format(ts, 'DDD') AS day_of_year FROM events", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS full_text, strftime(ts, '%j') AS day_of_year FROM events")
sql_query("date_difference", "SELECT l_orderkey, l_linenumber, CAST(datediff(l_shipdate, o_orderdate) AS BIGINT) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey", "SELECT l_orderkey, l_linenumber, date_diff('day', o_orderdate, l_shipdate) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
sql_query("unixepoch", "SELECT event_id, unix_timestamp(ts) AS s FROM events", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events")
sql_query("json_extract", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, get_json_object(props, '$.none') AS none FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS none FROM events")
sql_query("json_keys", "SELECT k, count(*) AS n FROM (SELECT explode(json_object_keys(props)) AS k FROM events) GROUP BY k", "SELECT k, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY k")
sql_query("json_each", "SELECT event_id, key, value FROM (SELECT event_id, explode(from_json(props, 'map<string,string>')) AS (key, value) FROM events)", "SELECT event_id, key, json_extract_string(props, '$.' || key) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)")
sql_query("json_build", "SELECT n_nationkey, to_json(named_struct('id', n_nationkey, 'name', n_name)) AS j FROM nation", "SELECT n_nationkey, CAST(json_object('id', n_nationkey, 'name', n_name) AS VARCHAR) AS j FROM nation")
sql_query("conditional_functions", "SELECT o_orderkey, if(o_totalprice > 100000, 'hi', 'lo') AS b, coalesce(nullif(o_orderstatus, 'P'), 'pending') AS s, greatest(o_totalprice, 100000) AS g, least(o_totalprice, 100000) AS l FROM orders")
sql_query("generate_series", "SELECT id AS n FROM range(1, 101, 3)", "SELECT n FROM generate_series(1, 100, 3) t(n)")
sql_query("url_parts", "SELECT page_id, parse_url(url, 'HOST') AS host FROM pages", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages")
sql_query("html_text", "SELECT page_id, CAST(length(regexp_replace(html, '<[^>]*>', '')) AS BIGINT) AS n FROM pages", "SELECT page_id, CAST(length(regexp_replace(html, '<[^>]*>', '', 'g')) AS BIGINT) AS n FROM pages")
sql_query("conversation_turns", "SELECT conv_id, turn, lag(role) OVER w AS before, CAST(length(text) AS BIGINT) AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")


@query("substr_forms", "SELECT p_partkey, substr(p_name, 2, 3) AS a, right(p_name, 4) AS b, substr(p_name, 1, 2) AS c FROM part", "part")
def _substr(part):
    x = F.col("p_name")
    return part.select("p_partkey", lenient.substr(x, 2, 3).alias("a"), lenient.substr(x, -4).alias("b"), lenient.substr(x, 0, 3).alias("c"))


@query("glob_function", "SELECT p_partkey FROM part WHERE p_brand GLOB 'Brand?[1-3]*'", "part")
def _glob(part):
    return part.where(lenient.glob(F.col("p_brand"), "Brand?[1-3]*")).select("p_partkey")


@query("lenient_casts", "SELECT p_partkey, coalesce(TRY_CAST(regexp_extract(p_brand || ' x', '^\\s*([+-]?[0-9]+)', 1) AS BIGINT), 0) AS a, CAST(p_size AS BIGINT) AS b FROM part", "part")
def _casts(part):
    return part.select("p_partkey", lenient.to_integer(F.col("p_brand")).alias("a"), lenient.to_integer(F.concat(F.col("p_size").cast("string"), F.lit(" units"))).alias("b"))


@query("julianday", "SELECT event_id, epoch_us(ts) / 86400e6::DOUBLE + 2440587.5::DOUBLE AS j FROM events", "events")
def _julian(events):
    return events.select("event_id", lenient.julianday(F.col("ts")).alias("j"))


@query("date_modifiers", "SELECT o_orderkey, date_trunc('month', o_orderdate) + INTERVAL 1 MONTH - INTERVAL 1 DAY AS last, o_orderdate + INTERVAL 36 HOUR AS later, date_trunc('year', o_orderdate) AS y FROM orders", "orders")
def _modifiers(orders):
    t = F.col("o_orderdate")
    m = lambda *x: lenient.modified(t, *x).cast(orders.schema["o_orderdate"].dataType)
    return orders.select("o_orderkey", m("start of month", "+1 month", "-1 day").alias("last"), m("+1.5 days").alias("later"), m("start of year").alias("y"))


@query("stream_tumbling", "SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type, date_trunc('hour', ts)", "events")
def _tumbling(events):
    out = windows.windowed(events, ["event_type"]).withColumn("total", F.round("total", 4))
    return out.withColumn("start", F.col("start").cast(events.schema["ts"].dataType))


@query("stream_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""", "events")
def _sessions(events):
    out = windows.sessions(events, ["user_id"]).select("user_id", "start", "n")
    return out.withColumn("start", F.col("start").cast(events.schema["ts"].dataType))
