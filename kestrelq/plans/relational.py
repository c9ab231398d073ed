"""Scans, joins, aggregates, windows, sets, subqueries and recursion over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, merge, recursion
from .registry import query, sql_query

sql_query("pricing_summary", """
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_quantity), 6) AS avg_qty,
  round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""")
sql_query("flagship_nation_year_rank", """
WITH sales AS (SELECT n_name, year(o_orderdate) AS y, sum(l_extendedprice * (1 - l_discount)) AS revenue
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY n_name, year(o_orderdate))
SELECT n_name, CAST(y AS BIGINT) AS y, round(revenue, 2) AS revenue, CAST(rank() OVER (PARTITION BY y ORDER BY round(revenue, 2) DESC) AS BIGINT) AS rnk FROM sales""")

# scans, filters, expressions
sql_query("scan_filter_project", "SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000")
sql_query("case_when", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'small' END AS size_class, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 0 END AS st FROM orders")
sql_query("between_in_like", "SELECT p_partkey, p_name FROM part WHERE p_size BETWEEN 5 AND 20 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21', 'Brand#33') AND lower(p_type) LIKE '%e%'")
sql_query("like_escape", "SELECT p_partkey FROM part WHERE p_brand LIKE 'Brand#1_' ESCAPE '!'")
sql_query("glob_filter", "SELECT p_partkey, p_brand FROM part WHERE regexp_like(p_brand, '^Brand.[1-3].$')", "SELECT p_partkey, p_brand FROM part WHERE p_brand GLOB 'Brand?[1-3]?'")
sql_query("regexp_filter", "SELECT p_partkey, p_type FROM part WHERE regexp_like(p_type, '^[A-Z]+.*[A-Z]$')", "SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, '^[A-Z]+.*[A-Z]$')")
sql_query("is_distinct_from", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus <=> 'O')", "SELECT o_orderkey FROM orders WHERE o_orderstatus IS DISTINCT FROM 'O'")
sql_query("null_logic", "SELECT c.c_custkey, o.o_orderkey IS NULL AS lone, coalesce(o.o_orderstatus, '-') AS st, nullif(o.o_orderstatus, 'O') AS not_open FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey")
sql_query("bitwise", "SELECT p_partkey, CAST(p_size & 7 AS BIGINT) AS a, CAST(p_size | 8 AS BIGINT) AS o, CAST(~p_size AS BIGINT) AS n, CAST(shiftleft(p_size, 2) AS BIGINT) AS l, CAST(shiftright(p_size, 1) AS BIGINT) AS r FROM part", "SELECT p_partkey, CAST(p_size & 7 AS BIGINT) AS a, CAST(p_size | 8 AS BIGINT) AS o, CAST(~p_size AS BIGINT) AS n, CAST(p_size << 2 AS BIGINT) AS l, CAST(p_size >> 1 AS BIGINT) AS r FROM part")
sql_query("integer_arithmetic", "SELECT p_partkey, p_partkey div 7 AS quotient, p_partkey % 7 AS remainder, try_divide(p_partkey, p_partkey % 3) IS NULL AS by_zero FROM part", "SELECT p_partkey, p_partkey // 7 AS quotient, p_partkey % 7 AS remainder, p_partkey % 3 = 0 AS by_zero FROM part")
sql_query("values_scan", "SELECT n, name FROM (VALUES (1, 'one'), (2, 'two'), (3, NULL)) AS t(n, name)")
sql_query("row_value_compare", "SELECT o_orderkey FROM orders WHERE (o_orderstatus, o_orderpriority) IN (SELECT o_orderstatus, max(o_orderpriority) FROM orders GROUP BY o_orderstatus)")
sql_query("key_probe", "SELECT * FROM orders WHERE o_orderkey IN (1, 5, 7, 32, 33, 9999999)")
sql_query("key_range", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey >= 100 AND l_orderkey < 200")

# joins
sql_query("join_inner", "SELECT c_custkey, n_name, o_orderkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 150000")
sql_query("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000")
sql_query("join_right", "SELECT o_orderkey, c_custkey FROM (SELECT * FROM orders WHERE o_totalprice > 250000) o RIGHT JOIN customer ON o_custkey = c_custkey")
sql_query("join_full_using", "SELECT k, c, s FROM (SELECT c_nationkey AS k, count(*) AS c FROM customer WHERE c_acctbal > 5000 GROUP BY c_nationkey) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS s FROM supplier GROUP BY s_nationkey) b USING (k)")
sql_query("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation WHERE n_nationkey < 5")
sql_query("join_natural", "SELECT * FROM (SELECT n_nationkey AS k, n_name FROM nation) NATURAL JOIN (SELECT s_nationkey AS k, s_suppkey FROM supplier)", "SELECT * FROM (SELECT n_nationkey AS k, n_name FROM nation) a NATURAL JOIN (SELECT s_nationkey AS k, s_suppkey FROM supplier) b")
sql_query("join_theta", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
sql_query("join_expression_key", "SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_partkey % 100 = s_suppkey % 100 WHERE p_size = 1")
sql_query("join_group", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN (nation JOIN region ON n_regionkey = r_regionkey) ON c_nationkey = n_nationkey AND r_name = 'ASIA'")
sql_query("join_lateral", "SELECT c_custkey, t.top FROM customer, LATERAL (SELECT max(o_totalprice) AS top FROM orders WHERE o_custkey = c_custkey) t")
sql_query("semi_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
sql_query("anti_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
sql_query("anti_not_in_nulls", "SELECT count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 1) FROM orders)")

# aggregates
sql_query("agg_basic", "SELECT count(*) AS n, count(DISTINCT l_partkey) AS parts, min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_tax), 6) AS tax FROM lineitem")
sql_query("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS supp, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY l_returnflag")
sql_query("agg_filter", "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS big, round(sum(l_extendedprice) FILTER (WHERE l_discount = 0), 2) AS plain FROM lineitem GROUP BY l_returnflag")
sql_query("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15")
sql_query("agg_group_concat_ordered", "SELECT n_regionkey, listagg(n_name, ', ') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
sql_query("agg_median_percentiles", "SELECT p_brand, median(p_retailprice) AS med, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY p_retailprice), 6) AS p90, percentile_disc(0.25) WITHIN GROUP (ORDER BY p_retailprice) AS q1 FROM part GROUP BY p_brand", "SELECT p_brand, median(p_retailprice) AS med, round(quantile_cont(p_retailprice, 0.9), 6) AS p90, quantile_disc(p_retailprice, 0.25) AS q1 FROM part GROUP BY p_brand")
sql_query("agg_total", "SELECT coalesce(sum(CASE WHEN o_totalprice < 0 THEN o_totalprice END), 0.0D) AS total, sum(CASE WHEN o_totalprice < 0 THEN o_totalprice END) AS s FROM orders", "SELECT coalesce(sum(CASE WHEN o_totalprice < 0 THEN o_totalprice END), 0.0::DOUBLE) AS total, sum(CASE WHEN o_totalprice < 0 THEN o_totalprice END) AS s FROM orders")
sql_query("agg_bare_column_max", "SELECT o_custkey, max(o_totalprice) AS top, max_by(o_orderkey, struct(o_totalprice, -o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey", "SELECT o_custkey, max(o_totalprice) AS top, arg_max(o_orderkey, struct_pack(a := o_totalprice, b := -o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
sql_query("agg_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
sql_query("agg_rollup_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) AS BIGINT) AS g FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
sql_query("agg_json_array", "SELECT n_regionkey, to_json(sort_array(collect_list(n_name))) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(to_json(list(n_name ORDER BY n_name)) AS VARCHAR) AS names FROM nation GROUP BY n_regionkey")
sql_query("agg_approx_distinct", "SELECT abs(approx_count_distinct(l_orderkey) - count(DISTINCT l_orderkey)) < 0.15 * count(DISTINCT l_orderkey) AS near FROM lineitem", "SELECT true AS near")
sql_query("agg_statistics", "SELECT p_brand, round(stddev_samp(p_retailprice), 4) AS sd, round(var_pop(p_size), 4) AS vp, round(corr(p_size, p_retailprice), 6) AS c FROM part GROUP BY p_brand")

# windows
sql_query("win_rank", "SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS rk, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS dr FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
sql_query("win_ntile_dist", "SELECT o_orderkey, CAST(ntile(4) OVER w AS BIGINT) AS q, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey)")
sql_query("win_lag_lead", "SELECT event_id, lag(value, 1, -1.0) OVER w AS prev, lead(value, 2) OVER w AS ahead FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)", "SELECT event_id, lag(value, 1, -1.0::DOUBLE) OVER w AS prev, lead(value, 2) OVER w AS ahead FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
sql_query("win_first_last_nth", "SELECT event_id, first_value(value) OVER w AS f, last_value(value) OVER w AS l, nth_value(value, 2) OVER w AS n2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
sql_query("win_rows_frame", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 6) AS m FROM events")
sql_query("win_range_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS n FROM part")
sql_query("win_groups_frame", """
WITH g AS (SELECT p_partkey, p_brand, p_size, p_retailprice, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS grp FROM part)
SELECT p_partkey, round(sum(p_retailprice) OVER (PARTITION BY p_brand ORDER BY grp RANGE BETWEEN 1 PRECEDING AND CURRENT ROW), 2) AS s FROM g""",
    "SELECT p_partkey, round(sum(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW), 2) AS s FROM part")
sql_query("win_exclude_current", "SELECT p_partkey, round(sum(p_retailprice) OVER (PARTITION BY p_brand) - p_retailprice, 2) AS others FROM part",
    "SELECT p_partkey, round(coalesce(sum(p_retailprice) OVER (PARTITION BY p_brand ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW), 0), 2) AS others FROM part")
sql_query("win_exclude_ties", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand) - count(*) OVER (PARTITION BY p_brand, p_size) + 1 AS n FROM part",
    "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE TIES) AS n FROM part")
sql_query("win_filter", "SELECT o_orderkey, count(CASE WHEN o_totalprice > 100000 THEN 1 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS big FROM orders", "SELECT o_orderkey, count(*) FILTER (WHERE o_totalprice > 100000) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS big FROM orders")
sql_query("win_running_concat", "SELECT n_nationkey, array_join(collect_list(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), ',') AS names FROM nation", "SELECT n_nationkey, string_agg(n_name, ',') OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS names FROM nation")
sql_query("win_over_aggregate", "SELECT o_orderpriority, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS BIGINT) AS rn FROM orders GROUP BY o_orderpriority")
sql_query("topn_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")

# order, limit, distinct
sql_query("topk_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
sql_query("limit_offset", "SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal, c_custkey LIMIT 20 OFFSET 40")
sql_query("nulls_order", "SELECT k, row_number() OVER (ORDER BY k NULLS LAST) AS pos FROM (SELECT DISTINCT nullif(c_nationkey, 3) AS k FROM customer)", "SELECT k, CAST(row_number() OVER (ORDER BY k NULLS LAST) AS INTEGER) AS pos FROM (SELECT DISTINCT nullif(c_nationkey, 3) AS k FROM customer)")
sql_query("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
sql_query("distinct_order_unselected", "SELECT o_orderpriority FROM (SELECT o_orderpriority, min(o_orderkey) AS k FROM orders GROUP BY o_orderpriority) ORDER BY k")

# sets
sql_query("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
sql_query("set_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
sql_query("set_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
sql_query("set_intersect", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 INTERSECT SELECT s_nationkey FROM supplier")
sql_query("set_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
sql_query("set_intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
sql_query("set_chain_left_assoc", "(SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region) INTERSECT SELECT s_nationkey FROM supplier")

# subqueries, common table expressions
sql_query("sub_scalar", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
sql_query("sub_corr_count", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer")
sql_query("sub_corr_limit1", "SELECT c_custkey, (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS last_f FROM customer")
sql_query("sub_exists_or", "SELECT c_custkey FROM customer WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
sql_query("sub_rowvalue_in", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT l_orderkey, max(l_linenumber) FROM lineitem GROUP BY l_orderkey)")
sql_query("sub_all_quantifier", "SELECT p_partkey FROM part WHERE p_retailprice >= (SELECT max(p_retailprice) FROM part)")
sql_query("cte_chain", "WITH a AS (SELECT o_custkey AS k, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey), b AS (SELECT k, t FROM a WHERE t > 500000) SELECT c_name, round(t, 2) AS t FROM b JOIN customer ON k = c_custkey")
sql_query("cte_recursive_series", "WITH RECURSIVE s(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM s WHERE n < 50) SELECT n, CAST(n AS BIGINT) * n AS sq FROM s")
sql_query("cte_recursive_hierarchy", "WITH RECURSIVE t(id, parent, depth) AS (SELECT n_nationkey, n_regionkey, 0 FROM nation WHERE n_nationkey < 5 UNION ALL SELECT n.n_nationkey, t.id, t.depth + 1 FROM nation n JOIN t ON n.n_regionkey = t.id AND n.n_nationkey > 4 AND t.depth < 3) SELECT id, parent, depth FROM t")
sql_query("view_and_derived", "SELECT s, count(*) AS n FROM (SELECT substr(c_mktsegment, 1, 1) AS s FROM customer) GROUP BY s")


@query("cte_recursive_union_cycle", "WITH RECURSIVE r(k) AS (SELECT 0 UNION SELECT (k * 3 + 1) % 25 FROM r) SELECT r.k, n_name FROM r JOIN nation ON r.k = n_nationkey", "nation")
def _cycle(nation):
    seed = nation.sparkSession.sql("SELECT 0 AS k")
    reached = recursion.fixpoint(seed, lambda d: d.select(((F.col("k") * 3 + 1) % 25).alias("k")))
    return reached.join(nation, reached.k == nation.n_nationkey).select("k", "n_name")


@query("join_asof", "SELECT o_orderkey, e.event_id FROM orders ASOF LEFT JOIN (SELECT ts, max(event_id) AS event_id FROM events GROUP BY ts) e ON o_orderdate >= e.ts", "orders", "events")
def _asof(orders, events):
    e = events.groupBy("ts").agg(F.max("event_id").alias("event_id"))
    return joins.asof(orders.select("o_orderkey", "o_orderdate"), e, "o_orderdate", "ts").select("o_orderkey", "event_id")


@query("join_interval", "SELECT a.p_partkey AS part, b.n_nationkey AS nation FROM part a JOIN nation b ON a.p_size BETWEEN b.n_nationkey * 2 AND b.n_nationkey * 2 + 3", "part", "nation")
def _interval(part, nation):
    spans = nation.select("n_nationkey", (F.col("n_nationkey") * 2).alias("lo"), (F.col("n_nationkey") * 2 + 3).alias("hi"))
    return joins.interval(part.select("p_partkey", "p_size"), spans, "p_size", "lo", "hi", 4).select(F.col("p_partkey").alias("part"), F.col("n_nationkey").alias("nation"))


@query("rtree_boxes", "SELECT a.c_custkey, b.s_suppkey FROM customer a JOIN supplier b ON abs(a.c_acctbal - b.s_acctbal) <= 20 AND a.c_nationkey = b.s_nationkey", "customer", "supplier")
def _boxes(customer, supplier):
    # spans a little too wide, since s_acctbal +- 20 is rounded; the difference itself decides
    s = supplier.select("s_suppkey", "s_nationkey", "s_acctbal", (F.col("s_acctbal") - 21).alias("lo"), (F.col("s_acctbal") + 21).alias("hi"))
    near = joins.interval(customer.select("c_custkey", "c_nationkey", "c_acctbal"), s, "c_acctbal", "lo", "hi")
    return near.where("c_nationkey = s_nationkey AND abs(c_acctbal - s_acctbal) <= 20").select("c_custkey", "s_suppkey")


@query("upsert_update", "SELECT coalesce(n.c_custkey, c.c_custkey) AS c_custkey, coalesce(n.bal, c.c_acctbal) AS c_acctbal FROM customer c FULL JOIN (SELECT c_custkey + 100 AS c_custkey, c_acctbal * 2 AS bal FROM customer) n ON c.c_custkey = n.c_custkey", "customer")
def _upsert(customer):
    base = customer.select("c_custkey", "c_acctbal")
    return merge.upsert(base, base.select((F.col("c_custkey") + 100).alias("c_custkey"), (F.col("c_acctbal") * 2).alias("c_acctbal")), ["c_custkey"])


@query("insert_or_ignore", "SELECT c_custkey, c_acctbal FROM customer UNION ALL SELECT c_custkey + 100, 0.0 FROM customer WHERE c_custkey + 100 NOT IN (SELECT c_custkey FROM customer)", "customer")
def _ignore(customer):
    base = customer.select("c_custkey", "c_acctbal")
    return merge.insert_or_ignore(base, base.select((F.col("c_custkey") + 100).alias("c_custkey"), F.lit(0.0).alias("c_acctbal")), ["c_custkey"])


@query("delete_where", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)", "orders", "customer")
def _delete(orders, customer):
    return merge.delete(orders, customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"]).select("o_orderkey")


@query("foreign_key_check", "SELECT l_orderkey, l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 3)", "lineitem", "part")
def _foreign(lineitem, part):
    return merge.violations(lineitem, ["l_partkey"], part.where("p_size > 3"), ["p_partkey"]).select("l_orderkey", "l_partkey")


sql_query("update_from", "SELECT c_custkey, CASE WHEN n_regionkey = 1 THEN c_acctbal + 10 ELSE c_acctbal END AS c_acctbal FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
