"""Queries over the SQL service and the frame algebra: projections, filters, joins, aggregates, windows, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators import profile
from millrace.operators.frame import LazyFrame
from millrace.operators.joins import asof_join, range_join
from millrace.plans.registry import Tables, query
from millrace.plans.sqlservice import SqlService

_OLAP = """SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_extendedprice), 2) AS avg_price,
       round(100 * avg(CASE WHEN l_discount > 0.05 THEN 1e0 ELSE 0e0 END), 2) AS discounted_pct
FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10 ORDER BY l_returnflag, l_linestatus LIMIT 100"""


@query(_OLAP)
def sql_olap_guarded(t: Tables) -> DataFrame:
    return SqlService(t.spark).olap(_OLAP, {"lineitem": t.lineitem})


_TOP = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 100"


@query(_TOP)
def sql_filter_order_limit(t: Tables) -> DataFrame:
    return SqlService(t.spark, max_rows=1000).olap(_TOP, {"orders": t.orders})


_CONCAT = "SELECT o_orderstatus || '-' || o_orderpriority AS route, count(*) AS n, round(avg(o_totalprice), 2) AS avg_price FROM orders GROUP BY o_orderstatus || '-' || o_orderpriority HAVING count(*) > 5"


@query(_CONCAT)
def sql_concat_key_having(t: Tables) -> DataFrame:
    return SqlService(t.spark).olap(_CONCAT, {"orders": t.orders})


_YEAR_MONTH = "SELECT extract(year FROM o_orderdate) AS y, extract(month FROM o_orderdate) AS m, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY extract(year FROM o_orderdate), extract(month FROM o_orderdate)"


@query(_YEAR_MONTH)
def sql_group_year_month(t: Tables) -> DataFrame:
    return SqlService(t.spark).olap(_YEAR_MONTH, {"orders": t.orders})


_JOIN = """SELECT r_name, c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY r_name, c_mktsegment"""


@query(_JOIN)
def sql_join_many(t: Tables) -> DataFrame:
    return SqlService(t.spark).query(_JOIN, {"orders": t.orders, "customer": t.customer, "nation": t.nation, "region": t.region})


_CTE = """WITH per AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey)
SELECT n, count(*) AS customers, round(avg(total), 4) AS avg_total FROM per WHERE total > (SELECT avg(total) FROM per) GROUP BY n"""


@query(_CTE)
def sql_cte_subquery(t: Tables) -> DataFrame:
    return SqlService(t.spark).query(_CTE, {"orders": t.orders})


_MARKED = "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AND c_acctbal BETWEEN 0 AND 5000 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_name LIKE '%1%'"


@query(_MARKED)
def sql_exists_in_like_between(t: Tables) -> DataFrame:
    return SqlService(t.spark).query(_MARKED, {"customer": t.customer, "orders": t.orders})


@query("SELECT * EXCLUDE (rn) FROM (SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn = 1")
def sql_materialized_like_top(t: Tables) -> DataFrame:
    return LazyFrame(t.customer.select("c_nationkey", "c_custkey", "c_acctbal")).first_by(["c_nationkey"], "c_acctbal", desc=True).df


# --- the frame ---------------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_quantity * 2 AS doubled FROM lineitem")
def frame_select_with_columns(t: Tables) -> DataFrame:
    frame = LazyFrame(t.lineitem).with_columns({"net": "l_extendedprice * (1 - l_discount)", "doubled": F.col("l_quantity") * 2})
    return frame.select("l_orderkey", "l_linenumber", "net", "doubled").df


@query("SELECT * EXCLUDE (p_type, p_size) FROM part")
def frame_exclude(t: Tables) -> DataFrame:
    return LazyFrame(t.part).exclude("p_type", "p_size").df


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 200000 AND o_orderstatus <> 'F' AND o_custkey IS NOT NULL")
def frame_filters(t: Tables) -> DataFrame:
    steps = [{"column": "o_totalprice", "op": "gte", "value": 200000}, {"column": "o_orderstatus", "op": "ne", "value": "F"}, {"column": "o_custkey", "op": "is_not_null"}]
    return LazyFrame(t.orders).filters(steps).select("o_orderkey", "o_totalprice").df


@query("SELECT id, coalesce(source, 'none') AS source, modality FROM unified_records WHERE filename IS NOT NULL")
def frame_null_handling(t: Tables) -> DataFrame:
    return LazyFrame(t.unified_records.select("id", "source", "modality", "filename")).drop_null("filename").fill_null("none", "source").exclude("filename").df


@query("SELECT p_brand, count(*) AS n, sum(p_size) AS sizes, round(avg(p_retailprice), 4) AS price, min(p_name) AS first_name, max(p_name) AS last_name, round(stddev_samp(p_retailprice), 4) AS sd, round(var_samp(p_retailprice), 2) AS v FROM part GROUP BY p_brand")
def frame_groupby_agg(t: Tables) -> DataFrame:
    grouped = LazyFrame(t.part).groupby("p_brand").agg(n=("p_partkey", "count"), sizes=("p_size", "sum"), price=("p_retailprice", "mean"), first_name=("p_name", "min"), last_name=("p_name", "max"), sd=("p_retailprice", "stddev"), v=("p_retailprice", "var"))
    return grouped.with_columns({"price": F.round("price", 4), "sd": F.round("sd", 4), "v": F.round("v", 2)}).df


@query("SELECT p_brand, sum(p_partkey) AS p_partkey, sum(p_size) AS p_size, round(sum(p_retailprice), 2) AS p_retailprice FROM part GROUP BY p_brand")
def frame_group_sum_all(t: Tables) -> DataFrame:
    return LazyFrame(t.part).groupby("p_brand").sum().with_column("p_retailprice", F.round("p_retailprice", 2)).df


@query("SELECT n_regionkey, count(*) AS rows, count(n_nationkey) AS n_nationkey, count(n_name) AS n_name FROM nation GROUP BY n_regionkey")
def frame_group_count(t: Tables) -> DataFrame:
    return LazyFrame(t.nation).groupby("n_regionkey").count().df


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def frame_distinct(t: Tables) -> DataFrame:
    return LazyFrame(t.orders).select("o_orderstatus", "o_orderpriority").distinct().df


@query("SELECT o_orderstatus, round(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END), 2) AS urgent, round(sum(CASE WHEN o_orderpriority = '5-LOW' THEN o_totalprice END), 2) AS low FROM orders GROUP BY o_orderstatus")
def frame_pivot(t: Tables) -> DataFrame:
    wide = LazyFrame(t.orders).pivot(["o_orderstatus"], "o_orderpriority", "o_totalprice", "sum", ["1-URGENT", "5-LOW"]).df
    return wide.select("o_orderstatus", F.round("1-URGENT", 2).alias("urgent"), F.round("5-LOW", 2).alias("low"))


@query("SELECT l_orderkey, l_linenumber, variable, value FROM lineitem UNPIVOT (value FOR variable IN (l_discount, l_tax))")
def frame_unpivot(t: Tables) -> DataFrame:
    return LazyFrame(t.lineitem).unpivot(["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"]).df


@query("SELECT vertex_id, unnest(source_chunk) AS source_chunk FROM entity_graph WHERE source_chunk IS NOT NULL AND len(source_chunk) > 0")
def frame_explode(t: Tables) -> DataFrame:
    return LazyFrame(t.entity_graph.select("vertex_id", "source_chunk")).explode("source_chunk", ignore_empty=True).df


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 50 OFFSET 10")
def frame_sort_limit_offset(t: Tables) -> DataFrame:
    return LazyFrame(t.customer.select("c_custkey", "c_acctbal").orderBy(F.desc_nulls_last("c_acctbal"), "c_custkey")).offset(10).limit(50).df


@query()
def frame_sample_exact(t: Tables) -> DataFrame:
    return LazyFrame(t.orders).sample(size=500, seed=3, key="o_orderkey").df


@query("SELECT c_custkey, c_name, n_name, n_regionkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def frame_join_prefixed(t: Tables) -> DataFrame:
    return LazyFrame(t.customer).join_on(LazyFrame(t.nation), "c_nationkey", "n_nationkey", "left").select("c_custkey", "c_name", "n_name", "n_regionkey").df


@query("SELECT c_custkey, c_name FROM customer ANTI JOIN (SELECT o_custkey AS c_custkey FROM orders) o USING (c_custkey)")
def frame_join_anti(t: Tables) -> DataFrame:
    orders = LazyFrame(t.orders.select(F.col("o_custkey").alias("c_custkey")))
    return LazyFrame(t.customer).join(orders, "c_custkey", "anti").select("c_custkey", "c_name").df


@query("SELECT p_partkey, p_name FROM part SEMI JOIN (SELECT l_partkey AS p_partkey FROM lineitem WHERE l_quantity > 45) l USING (p_partkey)")
def frame_join_semi(t: Tables) -> DataFrame:
    lines = LazyFrame(t.lineitem.where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")))
    return LazyFrame(t.part).join(lines, "p_partkey", "semi").select("p_partkey", "p_name").df


@query("SELECT coalesce(a.k, b.k) AS k, a.customers, b.suppliers FROM (SELECT c_nationkey AS k, count(*) AS customers FROM customer WHERE c_acctbal > 9000 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier WHERE s_acctbal > 9000 GROUP BY 1) b ON a.k = b.k")
def frame_join_outer(t: Tables) -> DataFrame:
    customers = t.customer.where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    suppliers = t.supplier.where("s_acctbal > 9000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return LazyFrame(customers).join(LazyFrame(suppliers), "k", "outer").df


@query("SELECT name, kind, count(*) AS n FROM (SELECT s_name AS name, 's' AS kind FROM supplier UNION ALL SELECT c_name, NULL FROM customer) GROUP BY name, kind")
def frame_union_evolving(t: Tables) -> DataFrame:
    left = LazyFrame(t.supplier.select(F.col("s_name").alias("name"), F.lit("s").alias("kind")))
    return left.union(LazyFrame(t.customer.select(F.col("c_name").alias("name")))).df.groupBy("name", "kind").agg(F.count("*").alias("n"))


@query("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def frame_except_all(t: Tables) -> DataFrame:
    return LazyFrame(t.customer.select(F.col("c_nationkey").alias("k"))).except_all(LazyFrame(t.supplier.select(F.col("s_nationkey").alias("k")))).df


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def frame_intersect(t: Tables) -> DataFrame:
    return LazyFrame(t.customer.select(F.col("c_nationkey").alias("k"))).intersect(LazyFrame(t.supplier.select(F.col("s_nationkey").alias("k")))).df


@query("WITH x AS (SELECT o_custkey, o_totalprice, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r FROM orders) SELECT o_custkey, o_totalprice FROM x WHERE r = 1")
def frame_sql(t: Tables) -> DataFrame:
    return LazyFrame(t.orders).sql("WITH x AS (SELECT o_custkey, o_totalprice, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r FROM self) SELECT o_custkey, o_totalprice FROM x WHERE r = 1").df


@query("SELECT o_orderstatus, sum(o_totalprice)::DECIMAL(20,2)::DOUBLE AS total FROM orders WHERE o_orderpriority = '2-HIGH' GROUP BY o_orderstatus ORDER BY total DESC LIMIT 2")
def frame_pipeline(t: Tables) -> DataFrame:
    steps = {"filters": [{"column": "o_orderpriority", "op": "eq", "value": "2-HIGH"}], "groupby": ["o_orderstatus"], "aggregates": {"total": ("o_totalprice", "sum")}, "sort": {"column": "total", "desc": True}, "limit": 2}
    return LazyFrame(t.orders).run(steps).with_column("total", F.round("total", 2)).df


@query("SELECT column_name, lower(replace(replace(replace(replace(column_type, 'VARCHAR', 'string'), 'INTEGER', 'int'), 'TIMESTAMP', 'timestamp_ntz'), 'DOUBLE', 'double')) AS column_type FROM (DESCRIBE SELECT * FROM orders)")
def frame_schema(t: Tables) -> DataFrame:
    return LazyFrame(t.orders).schema()


# --- aggregates ----------------------------------------------------------------------------------------------------------


@query("SELECT p_brand, p_type, count(*) AS n, GROUPING(p_brand) AS g_brand, GROUPING(p_type) AS g_type FROM part GROUP BY CUBE (p_brand, p_type)")
def agg_cube(t: Tables) -> DataFrame:
    return t.part.cube("p_brand", "p_type").agg(F.count("*").alias("n"), F.grouping("p_brand").cast("bigint").alias("g_brand"), F.grouping("p_type").cast("bigint").alias("g_type"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def agg_rollup(t: Tables) -> DataFrame:
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("q"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def agg_grouping_sets(t: Tables) -> DataFrame:
    return t.orders.groupingSets([["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("""SELECT 'l_quantity' AS column_name, min(l_quantity) AS min, max(l_quantity) AS max, count(l_quantity) AS count, round(100.0 * (count(*) - count(l_quantity)) / count(*), 4) AS null_pct, round(avg(l_quantity), 4) AS mean, round(stddev_samp(l_quantity), 4) AS std FROM lineitem
UNION ALL SELECT 'l_extendedprice', min(l_extendedprice), max(l_extendedprice), count(l_extendedprice), round(100.0 * (count(*) - count(l_extendedprice)) / count(*), 4), round(avg(l_extendedprice), 4), round(stddev_samp(l_extendedprice), 4) FROM lineitem
UNION ALL SELECT 'l_discount', min(l_discount), max(l_discount), count(l_discount), round(100.0 * (count(*) - count(l_discount)) / count(*), 4), round(avg(l_discount), 4), round(stddev_samp(l_discount), 4) FROM lineitem""")
def agg_summarize(t: Tables) -> DataFrame:
    found = profile.summarize(t.lineitem.select("l_quantity", "l_extendedprice", "l_discount"))
    return found.select("column_name", F.col("min").cast("double").alias("min"), F.col("max").cast("double").alias("max"), "count", "null_pct", "mean", "std")


@query("""WITH b AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)
SELECT least(CAST(floor((p_retailprice - lo) / (hi - lo) * 10) AS INTEGER) + 1, 10) AS bin, count(*) AS n FROM part, b GROUP BY 1""")
def agg_histogram(t: Tables) -> DataFrame:
    return profile.histogram(t.part, "p_retailprice", 10)


@query("""SELECT 'source' AS column_name, count(*) - count(source) AS nulls, count(DISTINCT source) AS distinct_values FROM documents UNION ALL
SELECT 'title', count(*) - count(title), count(DISTINCT title) FROM documents UNION ALL SELECT 'category', count(*) - count(category), count(DISTINCT category) FROM documents""")
def agg_profile(t: Tables) -> DataFrame:
    return profile.profile(t.documents.select("source", "title", "category")).select("column_name", "nulls", "distinct_values")


@query("SELECT round(1.0 - ((count(*) - count(source)) + (count(*) - count(title)) + (count(*) - count(category)))::DOUBLE / (3 * count(*)), 6) AS completeness FROM documents")
def agg_profile_score(t: Tables) -> DataFrame:
    return profile.completeness(t.documents.select("source", "title", "category"))


# --- windows ---------------------------------------------------------------------------------------------------------------

_BY = "(PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"


@query(f"SELECT o_orderkey, row_number() OVER {_BY} AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr, ntile(3) OVER {_BY} AS nt FROM orders")
def win_ranks(t: Tables) -> DataFrame:
    by, prio = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return t.orders.select("o_orderkey", F.row_number().over(by).alias("rn"), F.rank().over(prio).alias("rk"), F.dense_rank().over(prio).alias("dr"), F.ntile(3).over(by).alias("nt"))


@query(f"SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS total, round(sum(o_totalprice) OVER {_BY}, 2) AS running, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving FROM orders")
def win_sums(t: Tables) -> DataFrame:
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    total, moving = F.sum("o_totalprice").over(Window.partitionBy("o_custkey")), F.avg("o_totalprice").over(by.rowsBetween(-2, 0))
    return t.orders.select("o_orderkey", F.round(total, 2).alias("total"), F.round(F.sum("o_totalprice").over(by), 2).alias("running"), F.round(moving, 4).alias("moving"))


@query(f"SELECT o_orderkey, lag(o_orderkey, 1) OVER {_BY} AS before, lead(o_orderkey, 2) OVER {_BY} AS after, first_value(o_orderkey) OVER {_BY} AS first, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM orders")
def win_lag_lead(t: Tables) -> DataFrame:
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return t.orders.select("o_orderkey", F.lag("o_orderkey", 1).over(by).alias("before"), F.lead("o_orderkey", 2).over(by).alias("after"), F.first("o_orderkey").over(by).alias("first"), F.last("o_orderkey").over(whole).alias("last"))


@query("SELECT c_custkey, round(percent_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal), 6) AS pr, round(cume_dist() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal), 6) AS cd FROM customer")
def win_distribution(t: Tables) -> DataFrame:
    by = Window.partitionBy("c_nationkey").orderBy("c_acctbal")
    return t.customer.select("c_custkey", F.round(F.percent_rank().over(by), 6).alias("pr"), F.round(F.cume_dist().over(by), 6).alias("cd"))


# --- joins on ranges and times ------------------------------------------------------------------------------------------------


@query("""SELECT e.event_id, o.event_id AS error_id FROM (SELECT * FROM events WHERE event_type = 'click') e
ASOF LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS n FROM events WHERE event_type = 'error') WHERE n = 1) o ON e.user_id = o.user_id AND e.ts >= o.ts""")
def join_asof(t: Tables) -> DataFrame:
    clicks, errors = t.events.where("event_type = 'click'"), t.events.where("event_type = 'error'").select("user_id", "ts", F.col("event_id").alias("error_id"))
    return asof_join(clicks, errors, "ts", ["user_id"], ["error_id"]).select("event_id", "error_id")


@query("""SELECT p.p_partkey, b.band FROM part p JOIN (VALUES (1, 900.0, 1000.0), (2, 950.0, 1100.0), (3, 1050.0, 1e9)) AS b (band, lo, hi) ON p.p_retailprice >= b.lo AND p.p_retailprice < b.hi""")
def join_range(t: Tables) -> DataFrame:
    bands = t.spark.createDataFrame([(1, 900.0, 1000.0), (2, 950.0, 1100.0), (3, 1050.0, 1e9)], "band int, lo double, hi double")
    return range_join(t.part.select("p_partkey", "p_retailprice"), bands, "p_retailprice", "lo", "hi").select("p_partkey", "band")
