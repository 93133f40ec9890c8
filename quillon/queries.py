"""The query catalogue: each name with its Spark form and the SQL text that states what it must return.

Queries of the core operators are built with them; the rest of the relational surface is SQL text that Spark and the
oracle both run. Ranks and counts are bigint on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import operators as ops
from quillon.catalog import Catalog
from quillon.functions import register_pure
from quillon.operators import AggSpec
from quillon.sources import sample_table
from quillon.streaming import session_counts, windowed_counts

Build = Callable[[Catalog], DataFrame]


def _decimal_sum(c: Catalog) -> DataFrame:
    exact = c.table("lineitem").withColumn("x", F.col("l_extendedprice").cast("decimal(18,2)"))
    return ops.aggregate(exact, ["l_returnflag"], [AggSpec("sum", "x", "s")]).withColumn("s", F.col("s").cast("double"))


def _asof(c: Catalog) -> DataFrame:
    """Each event with the last purchase of the same user up to then."""
    events = c.table("events")
    bought = ops.filter_rows(events, "event_type", "=", "purchase").select("user_id", "ts", F.col("event_id").alias("bought"))
    return ops.asof_join(events.select("event_id", "user_id", "ts"), bought, ["user_id"], "ts", ["bought"]).select("event_id", "bought")


def _registered(c: Catalog) -> DataFrame:
    register_pure(c.spark, "quillon_twice", "bigint", lambda s: s * 2)
    return c.sql("SELECT p_partkey, quillon_twice(CAST(p_size AS BIGINT)) AS v FROM part")


def _text(column: str) -> F.Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def _sliding(c: Catalog) -> DataFrame:
    found = windowed_counts(c.table("events"), "ts", ["event_type"], width="1 hour", slide="30 minutes")
    return found.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


def _sessions(c: Catalog) -> DataFrame:
    found = session_counts(c.table("events"), "ts", ["user_id"], gap="1 hour")
    return found.withColumns({"session_start": _text("session_start"), "session_end": _text("session_end")})


def _count_by(c: Catalog, table: str, *keys: str) -> DataFrame:
    return ops.aggregate(c.table(table), keys, [AggSpec("count")])


def _min_max(c: Catalog, table: str, key: str, column: str) -> DataFrame:
    return ops.aggregate(c.table(table), [key], [AggSpec("min", column, "lo"), AggSpec("max", column, "hi")])


def _filtered(c: Catalog, table: str, column: str, op: str, value: object, *keep: str) -> DataFrame:
    return ops.project(ops.filter_rows(c.table(table), column, op, value), *keep)


#: Built with operators: name -> (builder, SQL).
BUILT: dict[str, tuple[Build, str]] = {
    "scan_all": (lambda c: c.table("nation"), "SELECT * FROM nation"),
    "project_cols": (
        lambda c: ops.project(c.table("lineitem"), "l_orderkey", "l_returnflag"),
        "SELECT l_orderkey, l_returnflag FROM lineitem",
    ),
    "project_alias": (
        lambda c: ops.project(c.table("nation"), F.col("n_name").alias("x"), F.lit(1).cast("bigint").alias("one"), (F.col("n_regionkey") > 1).alias("big")),
        "SELECT n_name AS x, CAST(1 AS BIGINT) AS one, n_regionkey > 1 AS big FROM nation",
    ),
    "filter_gt_double": (
        lambda c: _filtered(c, "lineitem", "l_extendedprice", ">", 50000, "l_orderkey", "l_extendedprice"),
        "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_extendedprice > 50000",
    ),
    "filter_lt_double": (
        lambda c: _filtered(c, "lineitem", "l_quantity", "<", 5, "l_orderkey", "l_linenumber"),
        "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 5",
    ),
    "filter_eq_str": (
        lambda c: _filtered(c, "orders", "o_orderstatus", "=", "F", "o_orderkey"),
        "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'",
    ),
    "filter_ne_str": (
        lambda c: _filtered(c, "orders", "o_orderstatus", "<>", "F", "o_orderkey"),
        "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'",
    ),
    "filter_le_int": (
        lambda c: _filtered(c, "part", "p_size", "<=", 10, "p_partkey", "p_size"),
        "SELECT p_partkey, p_size FROM part WHERE p_size <= 10",
    ),
    "filter_ge_int": (
        lambda c: _filtered(c, "part", "p_size", ">=", 40, "p_partkey", "p_size"),
        "SELECT p_partkey, p_size FROM part WHERE p_size >= 40",
    ),
    "filter_sample": (
        lambda c: ops.project(ops.filter_rows(sample_table(c.spark), "amount", ">", 100000), "id", "name"),
        "SELECT range AS id, printf('name_%05d', range) AS name FROM range(100000) WHERE range * 1.5 + 0.01 > 100000",
    ),
    "partition_filter": (
        lambda c: ops.project(ops.partition_filter(c.table("orders"), "o_orderkey", 1, 4), "o_orderkey"),
        "SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 1",
    ),
    "hash_exchange": (
        lambda c: ops.hash_exchange(c.table("supplier"), 4, "s_nationkey"),
        "SELECT * FROM supplier",
    ),
    "round_robin": (lambda c: ops.round_robin(c.table("region"), 3), "SELECT * FROM region"),
    "gather": (lambda c: ops.gather(c.table("region")), "SELECT * FROM region"),
    "broadcast_join": (
        lambda c: ops.project(
            c.table("supplier").join(ops.broadcast_small(c.table("nation")), F.col("s_nationkey") == F.col("n_nationkey")), "s_suppkey", "n_name"
        ),
        "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    ),
    "count_star_group": (
        lambda c: _count_by(c, "lineitem", "l_returnflag"),
        "SELECT l_returnflag, count(*) AS count FROM lineitem GROUP BY l_returnflag",
    ),
    "count_col_group": (
        lambda c: ops.aggregate(c.table("events"), ["event_type"], ops.parse_specs("count:value")),
        "SELECT event_type, count(value) AS count_value FROM events GROUP BY event_type",
    ),
    "sum_int": (
        lambda c: ops.aggregate(c.table("lineitem"), ["l_returnflag"], ops.parse_specs("sum:l_orderkey")),
        "SELECT l_returnflag, CAST(sum(l_orderkey) AS BIGINT) AS sum_l_orderkey FROM lineitem GROUP BY l_returnflag",
    ),
    "sum_double_dec": (
        _decimal_sum,
        "SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS s FROM lineitem GROUP BY l_returnflag",
    ),
    "sum_double_round": (
        lambda c: ops.aggregate(c.table("lineitem"), ["l_returnflag"], [AggSpec("sum", "l_extendedprice", "s")]).withColumn("s", F.round("s", 2)),
        "SELECT l_returnflag, round(sum(l_extendedprice), 2) AS s FROM lineitem GROUP BY l_returnflag",
    ),
    "min_max_int": (
        lambda c: _min_max(c, "lineitem", "l_returnflag", "l_orderkey"),
        "SELECT l_returnflag, min(l_orderkey) AS lo, max(l_orderkey) AS hi FROM lineitem GROUP BY l_returnflag",
    ),
    "min_max_double": (
        lambda c: _min_max(c, "lineitem", "l_returnflag", "l_extendedprice"),
        "SELECT l_returnflag, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY l_returnflag",
    ),
    "min_max_str": (
        lambda c: _min_max(c, "nation", "n_regionkey", "n_name"),
        "SELECT n_regionkey, min(n_name) AS lo, max(n_name) AS hi FROM nation GROUP BY n_regionkey",
    ),
    "multi_key": (
        lambda c: _count_by(c, "lineitem", "l_returnflag", "l_linestatus"),
        "SELECT l_returnflag, l_linestatus, count(*) AS count FROM lineitem GROUP BY l_returnflag, l_linestatus",
    ),
    "double_key": (
        lambda c: _count_by(c, "lineitem", "l_discount"),
        "SELECT l_discount, count(*) AS count FROM lineitem GROUP BY l_discount",
    ),
    "high_card": (
        lambda c: _count_by(c, "orders", "o_custkey"),
        "SELECT o_custkey, count(*) AS count FROM orders GROUP BY o_custkey",
    ),
    "group_only": (
        lambda c: ops.aggregate(c.table("orders"), ["o_orderpriority"]),
        "SELECT o_orderpriority FROM orders GROUP BY o_orderpriority",
    ),
    "key_not_selected": (
        lambda c: ops.project(_count_by(c, "orders", "o_orderpriority"), "count"),
        "SELECT count(*) AS count FROM orders GROUP BY o_orderpriority",
    ),
    "global_count": (
        lambda c: ops.aggregate(c.table("lineitem"), specs=[AggSpec("count")]),
        "SELECT count(*) AS count FROM lineitem",
    ),
    "global_multi": (
        lambda c: ops.aggregate(c.table("orders"), specs=[AggSpec("count", alias="n"), AggSpec("min", "o_orderkey", "lo"), AggSpec("max", "o_orderkey", "hi")]),
        "SELECT count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders",
    ),
    "filter_then_agg": (
        lambda c: ops.aggregate(ops.filter_rows(c.table("lineitem"), "l_quantity", ">", 25), ["l_returnflag"], [AggSpec("count")]),
        "SELECT l_returnflag, count(*) AS count FROM lineitem WHERE l_quantity > 25 GROUP BY l_returnflag",
    ),
    "inner_join": (
        lambda c: ops.project(ops.join(c.table("nation"), c.table("region"), F.col("n_regionkey") == F.col("r_regionkey")), "n_name", "r_name"),
        "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    ),
    "full_join": (
        lambda c: ops.project(ops.join(c.table("supplier"), c.table("customer"), F.col("s_suppkey") == F.col("c_custkey"), "full"), "s_suppkey", "c_custkey"),
        "SELECT s_suppkey, c_custkey FROM supplier FULL OUTER JOIN customer ON s_suppkey = c_custkey",
    ),
    "right_join": (
        lambda c: ops.project(ops.join(c.table("supplier"), c.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "right"), "s_suppkey", "n_nationkey"),
        "SELECT s_suppkey, n_nationkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey",
    ),
    "union_all": (
        lambda c: ops.union(c.table("nation").select(F.col("n_regionkey").alias("k")), c.table("region").select("r_regionkey"), all_rows=True),
        "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region",
    ),
    "intersect": (
        lambda c: ops.intersect(c.table("customer").select(F.col("c_nationkey").alias("k")), c.table("supplier").select("s_nationkey")),
        "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    ),
    "except_balance": (
        lambda c: ops.except_(c.table("orders").select(F.col("o_custkey").alias("k")), ops.filter_rows(c.table("customer"), "c_acctbal", "<", 0).select("c_custkey")),
        "SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0",
    ),
    "distinct": (
        lambda c: ops.distinct(c.table("lineitem"), "l_returnflag", "l_linestatus"),
        "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    ),
    "topk": (
        lambda c: ops.top_k(c.table("orders").select("o_orderkey", "o_totalprice"), 10, F.desc("o_totalprice"), "o_orderkey"),
        "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    ),
    "offset": (
        lambda c: ops.limit(c.table("orders").select("o_orderkey"), 5, 10, ["o_orderkey"]),
        "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5 OFFSET 10",
    ),
    "rank_cast": (
        lambda c: ops.ranked(c.table("orders"), ["o_custkey"], ["o_orderkey"], alias="rn").select("o_orderkey", "rn"),
        "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders",
    ),
    "rank_price": (
        lambda c: ops.ranked(c.table("orders"), ["o_orderpriority"], ["o_totalprice"], "rank", "rk").select("o_orderkey", "rk"),
        "SELECT o_orderkey, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS rk FROM orders",
    ),
    "dense_rank": (
        lambda c: ops.ranked(c.table("orders"), ["o_orderpriority"], ["o_orderstatus"], "dense_rank", "dr").select("o_orderkey", "dr"),
        "SELECT o_orderkey, dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus) AS dr FROM orders",
    ),
    "lag_lead": (
        lambda c: ops.lag_lead(c.table("events"), ["user_id"], ["ts", "event_id"], "event_id", "p", "n").select("event_id", "p", "n"),
        "SELECT event_id, lag(event_id) OVER w AS p, lead(event_id) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    ),
    "first_last": (
        lambda c: ops.first_last(c.table("events"), ["user_id"], ["ts", "event_id"], "event_id", "f", "l").select("event_id", "f", "l"),
        "SELECT event_id, first_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f, last_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM events",
    ),
    "windowed_counts": (
        lambda c: windowed_counts(c.table("events"), "ts", ["event_type"]).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")),
        "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS count FROM events GROUP BY 1, 2",
    ),
    "sliding_counts": (
        _sliding,
        "WITH e AS (SELECT event_type, time_bucket(INTERVAL '30 minutes', ts) AS b FROM events), "
        "w AS (SELECT event_type, b FROM e UNION ALL SELECT event_type, b - INTERVAL '30 minutes' FROM e) "
        "SELECT strftime(b, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS count FROM w GROUP BY 1, 2",
    ),
    "session_counts": (
        _sessions,
        "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL '1 hour' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), "
        "s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g) "
        "SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start, strftime(max(ts) + INTERVAL '1 hour', '%Y-%m-%d %H:%M:%S.%f') AS session_end, "
        "user_id, count(*) AS count FROM s GROUP BY user_id, n",
    ),
    "asof_join": (
        _asof,
        "SELECT e.event_id, b.event_id AS bought FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') b ON e.user_id = b.user_id AND e.ts >= b.ts",
    ),
    "registered_udf": (_registered, "SELECT p_partkey, CAST(p_size AS BIGINT) * 2 AS v FROM part"),
    "semi_op": (
        lambda c: ops.semi_join(c.table("customer").select("c_custkey"), c.table("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey"),
        "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    ),
    "anti_op": (
        lambda c: ops.anti_join(c.table("customer").select("c_custkey"), c.table("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey"),
        "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)",
    ),
    "intersect_all": (
        lambda c: ops.intersect(c.table("customer").select(F.col("c_nationkey").alias("k")), c.table("supplier").select("s_nationkey"), all_rows=True),
        "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    ),
    "except_all": (
        lambda c: ops.except_(c.table("customer").select(F.col("c_nationkey").alias("k")), c.table("supplier").select("s_nationkey"), all_rows=True),
        "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    ),
}

#: One SQL text for both engines, or a pair (Spark, oracle).
SQL: dict[str, str | tuple[str, str]] = {
    "pushdown_project": "SELECT k FROM (SELECT l_orderkey AS k, l_quantity AS q FROM lineitem) t WHERE q > 45",
    "pushdown_agg": "SELECT f, n FROM (SELECT l_returnflag AS f, count(*) AS n FROM lineitem GROUP BY l_returnflag) t WHERE f = 'A'",
    "filter_on_agg_output": "SELECT f, n FROM (SELECT o_custkey AS f, count(*) AS n FROM orders GROUP BY o_custkey) t WHERE n > 15",
    "nested_agg": "SELECT n, count(*) AS c FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) t GROUP BY n",
    "having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15",
    "left_join": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "semi": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    "anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    "corr_scalar": "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT max(o2.o_totalprice) * 0.95 FROM orders o2 WHERE o2.o_orderpriority = o.o_orderpriority)",
    "cte": "WITH x AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT max(n) AS m FROM x",
    "union": "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region",
    "avg_round": "SELECT l_returnflag, round(avg(l_quantity), 4) AS a FROM lineitem GROUP BY l_returnflag",
    "count_distinct": "SELECT o_orderpriority, count(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderpriority",
    "preds": "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 15 AND p_brand IN ('Brand#11','Brand#22') OR p_name LIKE '%1%' AND p_type IS NOT NULL",
    "case_when": "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS c FROM part",
    "str_order": "SELECT n_nationkey FROM nation WHERE n_name > 'NATION_15'",
    "cast_floor_all": "SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders",
    "filter_ge_ts": "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00'",
    "array_agg_sorted": (
        "SELECT n_regionkey, array_join(array_sort(array_agg(n_name)), ',') AS names FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, array_to_string(list_sort(array_agg(n_name)), ',') AS names FROM nation GROUP BY n_regionkey",
    ),
    "rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "agg_filter": "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS n FROM lineitem GROUP BY l_returnflag",
    "median_exact": "SELECT l_returnflag, median(l_quantity) AS m FROM lineitem GROUP BY l_returnflag",
    "ntile": (
        "SELECT o_orderkey, CAST(ntile(4) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS BIGINT) AS q FROM orders",
        "SELECT o_orderkey, ntile(4) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS q FROM orders",
    ),
    "running_count": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS n FROM events",
    "three_way_join": "SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "star_and_more": "SELECT *, n_nationkey > 3 AS later FROM nation",
    "literal_op_column": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE 45 < l_quantity",
    "column_op_column": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < l_linenumber",
    "bare_boolean": "SELECT o_orderkey FROM (SELECT o_orderkey, o_totalprice > 100000 AS big FROM orders) t WHERE big",
    "null_literal": "SELECT n_nationkey, CAST(NULL AS BIGINT) AS nothing FROM nation WHERE n_nationkey = 3 OR CAST(NULL AS BOOLEAN)",
    "boolean_literal": "SELECT n_nationkey, TRUE AS yes, FALSE AS no FROM nation WHERE TRUE",
    "is_null": "SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NULL",
    "unary_minus": "SELECT o_orderkey, -o_totalprice AS v FROM orders WHERE -o_totalprice < -300000",
    "group_by_expression": "SELECT CAST(floor(l_quantity / 10) AS BIGINT) AS b, count(*) AS n FROM lineitem GROUP BY CAST(floor(l_quantity / 10) AS BIGINT)",
    "group_by_all": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL",
    "grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "within_group": "SELECT o_orderpriority, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY o_totalprice), 4) AS q FROM orders GROUP BY o_orderpriority",
    "ignore_nulls": (
        "SELECT event_id, last_value(CASE WHEN value > 20 THEN value END) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM events",
        "SELECT event_id, last_value(CASE WHEN value > 20 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM events",
    ),
    "subquery_in_aggregate": "SELECT CAST(sum(CASE WHEN o_totalprice > (SELECT avg(o_totalprice) FROM orders) THEN 1 ELSE 0 END) AS BIGINT) AS n FROM orders",
    "range_frame": "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_totalprice RANGE BETWEEN 50000 PRECEDING AND CURRENT ROW) AS n FROM orders",
    "percent_rank": "SELECT o_orderkey, round(percent_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice), 9) AS p FROM orders",
    "sum_over": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS s FROM orders",
    "theta_join": "SELECT r_regionkey, count(*) AS n FROM region JOIN nation ON n_regionkey < r_regionkey GROUP BY r_regionkey",
    "range_join": "SELECT n_nationkey, count(*) AS n FROM nation JOIN region ON n_nationkey BETWEEN r_regionkey * 5 AND r_regionkey * 5 + 6 GROUP BY n_nationkey",
    "order_by": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey",
    "string_functions": (
        "SELECT p_partkey, upper(p_name) AS u, CAST(length(p_name) AS BIGINT) AS n, substring(p_name, 2, 3) AS s, concat(p_brand, '-', p_type) AS c, "
        "replace(p_name, 'e', '') AS r, lpad(p_brand, 12, '*') AS l, CAST(instr(p_name, 'r') AS BIGINT) AS i FROM part"
    ),
    "date_functions": "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS d, CAST(quarter(o_orderdate) AS BIGINT) AS q FROM orders",
    "math_functions": "SELECT o_orderkey, round(sqrt(o_totalprice), 6) AS r, CAST(ceil(o_totalprice) AS BIGINT) AS c, abs(o_totalprice - 150000) AS a, o_orderkey % 7 AS m, round(ln(o_totalprice + 1), 6) AS l FROM orders",
    "json_functions": (
        "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events",
        "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    ),
    "array_functions": (
        "SELECT n_regionkey, CAST(size(array_agg(n_name)) AS BIGINT) AS n, array_contains(array_agg(n_nationkey), 3) AS has, element_at(array_sort(array_agg(n_name)), 1) AS first FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, len(array_agg(n_name)) AS n, list_contains(array_agg(n_nationkey), 3) AS has, list_sort(array_agg(n_name))[1] AS first FROM nation GROUP BY n_regionkey",
    ),
    "map_functions": (
        "SELECT o_orderkey, element_at(map('O', 'open', 'F', 'filled'), o_orderstatus) AS s FROM orders WHERE o_orderstatus IN ('O', 'F')",
        "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' ELSE 'filled' END AS s FROM orders WHERE o_orderstatus IN ('O', 'F')",
    ),
    "recursive_cte": "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT CAST(n AS BIGINT) AS n FROM t",
    "lateral": "SELECT n_name, x.c FROM nation, LATERAL (SELECT count(*) AS c FROM supplier WHERE s_nationkey = n_nationkey) x",
    "pivot": (
        "SELECT * FROM (SELECT l_returnflag, l_linestatus, l_orderkey FROM lineitem) PIVOT (count(l_orderkey) FOR l_linestatus IN ('F' AS f, 'O' AS o))",
        "SELECT l_returnflag, nullif(count(*) FILTER (WHERE l_linestatus = 'F'), 0) AS f, nullif(count(*) FILTER (WHERE l_linestatus = 'O'), 0) AS o FROM lineitem GROUP BY l_returnflag",
    ),
    "approx_distinct": (
        "SELECT o_orderpriority, abs(approx_count_distinct(o_custkey, 0.02) - count(DISTINCT o_custkey)) <= 0.1 * count(DISTINCT o_custkey) AS close FROM orders GROUP BY o_orderpriority",
        "SELECT DISTINCT o_orderpriority, TRUE AS close FROM orders",
    ),
    # An approximate percentile of accuracy 10,000 is exact in rank on groups this small: the least value of at least that rank.
    "approx_percentile": (
        "SELECT l_returnflag, approx_percentile(l_quantity, 0.5, 1000000) AS m FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, quantile_disc(l_quantity, 0.5) AS m FROM lineitem GROUP BY l_returnflag",
    ),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: (lambda spark, d, f=build: f(Catalog(spark, d))) for name, (build, _) in BUILT.items()}
    for name, text in SQL.items():
        out[name] = lambda spark, d, t=text if isinstance(text, str) else text[0]: Catalog(spark, d).sql(t)
    return out


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, s) in BUILT.items()} | {n: s if isinstance(s, str) else s[1] for n, s in SQL.items()}
