"""Queries over access, lineage and audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import governance
from millrace.plans.registry import Tables, query


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n, min(left(c_name, 2) || repeat('*', length(c_name) - 4) || right(c_name, 2)) AS first_name FROM customer WHERE c_acctbal >= 1000 GROUP BY ALL")
def acl_governed_source(t: Tables) -> DataFrame:
    seen = governance.govern(t.customer, governance.Access(frozenset({"c_nationkey", "c_mktsegment", "c_name"}), "c_acctbal >= 1000", {"c_name": "partial"}))
    return seen.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"), F.min("c_name").alias("first_name"))


@query("SELECT c_custkey FROM customer WHERE false")
def acl_fails_closed(t: Tables) -> DataFrame:
    return governance.govern(t.customer, governance.Access(rows="no_such_column == 1")).select("c_custkey")


def _log(t: Tables) -> DataFrame:
    """Every line, order and customer as an event: orders are made from parts and suppliers, customers' accounts from orders, nations' totals from accounts."""
    ref = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.col(key))
    listed = lambda *names: F.concat(F.lit('["'), F.concat_ws('", "', *names), F.lit('"]'))
    event = lambda df, ident, made, op, sources: df.select(F.concat_ws("-", *ident).alias("event_id"), made.alias("dataset_name"), F.lit(op).alias("operation"), sources.alias("source_datasets"))
    lines = event(t.lineitem, [F.lit("l"), "l_orderkey", "l_linenumber"], ref("order", "l_orderkey"), "join", listed(ref("part", "l_partkey"), ref("supplier", "l_suppkey")))
    accounts = event(t.orders, [F.lit("o"), "o_orderkey"], ref("customer", "o_custkey"), "clean", listed(ref("order", "o_orderkey")))
    nations = event(t.customer, [F.lit("c"), "c_custkey"], ref("nation", "c_nationkey"), "export", listed(ref("customer", "c_custkey")))
    return lines.unionByName(accounts).unionByName(nations)


_EDGES = """(SELECT DISTINCT * FROM (SELECT 'part:' || l_partkey AS src, 'order:' || l_orderkey AS dst, 'join' AS operation FROM lineitem UNION ALL SELECT 'supplier:' || l_suppkey, 'order:' || l_orderkey, 'join' FROM lineitem
UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'clean' FROM orders UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'export' FROM customer))"""
_DOWN = f"WITH RECURSIVE e AS MATERIALIZED {_EDGES}, down AS (SELECT '{{start}}' AS id, 0 AS depth UNION SELECT e.dst, d.depth + 1 FROM down d JOIN e ON e.src = d.id WHERE d.depth < 10)"
_AROUND = _DOWN.format(start="customer:1") + """, up AS (SELECT 'customer:1' AS id, 0 AS depth UNION SELECT e.src, u.depth + 1 FROM up u JOIN e ON e.dst = u.id WHERE u.depth < 10),
x AS MATERIALIZED (SELECT id, min(depth) AS depth, CASE WHEN min(depth) = 0 THEN 'target' WHEN bool_or(up) THEN 'source' ELSE 'derived' END AS type FROM (SELECT *, true AS up FROM up UNION ALL SELECT *, false FROM down) GROUP BY id)"""


@query(f"SELECT src, dst FROM {_EDGES}")
def lineage_edge_list(t: Tables) -> DataFrame:
    return governance.lineage_edges(_log(t))


@query(f"SELECT DISTINCT src AS dataset FROM {_EDGES} WHERE dst = 'nation:3'")
def lineage_upstream(t: Tables) -> DataFrame:
    return governance.one_hop(_log(t), "nation:3", "upstream")


@query(_DOWN.format(start="part:1") + " SELECT id AS dataset, min(depth) AS depth FROM down WHERE depth > 0 GROUP BY id ORDER BY 2, 1 LIMIT 500")
def lineage_impact(t: Tables) -> DataFrame:
    return governance.impact(_log(t), "part:1")


@query(_AROUND + " SELECT id, depth, type FROM x ORDER BY depth, id LIMIT 500")
def lineage_nodes(t: Tables) -> DataFrame:
    return governance.lineage_graph(_log(t), "customer:1")[0]


@query(_AROUND + ", k AS (SELECT id FROM x ORDER BY depth, id LIMIT 500) SELECT src, dst, operation FROM e WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)")
def lineage_around(t: Tables) -> DataFrame:
    return governance.lineage_graph(_log(t), "customer:1")[1]


@query(f"SELECT (SELECT count(*) FROM lineitem) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer) AS events, (SELECT count(DISTINCT dst) FROM {_EDGES}) AS datasets")
def lineage_stats(t: Tables) -> DataFrame:
    return governance.lineage_statistics(_log(t))


def _entries(t: Tables) -> DataFrame:
    return t.events.select(F.col("event_id").cast("string").alias("entry_id"), "event_type", F.lit("events").alias("dataset_name"), F.col("user_id").cast("string").alias("actor"), F.col("props").alias("details"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


_KEY = b"audit-key"
_PADS = [bytes(b ^ p for b in _KEY.ljust(64, b"\0")).hex() for p in (0x36, 0x5C)]


@query(f"""WITH b AS (SELECT event_id::VARCHAR AS entry_id, '{{"actor":"' || user_id || '","created_at":"' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '","dataset_name":"events","details":"' || replace(props, '"', '\\"') || '","entry_id":"' || event_id || '","event_type":"' || event_type || '"}}' AS body FROM events)
SELECT entry_id, sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode(body)))) AS hmac_hash FROM b""")
def audit_signed(t: Tables) -> DataFrame:
    return governance.signed(_entries(t), _KEY).select("entry_id", "hmac_hash")


@query("SELECT event_type, count(*) AS n, 0 AS invalid FROM events GROUP BY event_type")
def audit_verified(t: Tables) -> DataFrame:
    checked = governance.verified(governance.signed(_entries(t), _KEY), _KEY)
    return checked.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(~F.col("valid")).alias("invalid"))


@query("SELECT event_id FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'")
def audit_filtered(t: Tables) -> DataFrame:
    rows = t.events.withColumn("dataset_name", F.lit("events"))
    return governance.audit_query(rows, "events", "click", F.lit("2024-01-10").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz"), "ts").select("event_id")


@query("""WITH h AS (SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY ALL), z AS (SELECT *, round((n - avg(n) OVER (PARTITION BY event_type)) / stddev_samp(n) OVER (PARTITION BY event_type), 6) AS z FROM h)
SELECT event_type, strftime(hour, '%Y-%m-%d %H') AS hour, n, z FROM z WHERE z >= 2""")
def audit_hourly_anomalies(t: Tables) -> DataFrame:
    return governance.hourly_anomalies(t.events, "ts", ["event_type"], 2.0).withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH"))


@query("WITH a AS (SELECT user_id AS actor, count(*) AS n FROM events GROUP BY user_id), z AS (SELECT *, round((n - (SELECT avg(n) FROM a)) / (SELECT stddev_samp(n) FROM a), 6) AS z FROM a) SELECT * FROM z WHERE z >= 1.5")
def audit_actor_anomalies(t: Tables) -> DataFrame:
    return governance.actor_anomalies(t.events, "user_id", 1.5)


@query("SELECT user_id AS actor, count(*) AS n FROM events WHERE hour(ts) BETWEEN 0 AND 6 GROUP BY user_id HAVING count(*) >= 10")
def audit_off_hours(t: Tables) -> DataFrame:
    return governance.off_hours(t.events, "ts", "user_id")


@query("""WITH h AS (SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY ALL), z AS (SELECT *, round((n - avg(n) OVER (PARTITION BY event_type)) / stddev_samp(n) OVER (PARTITION BY event_type), 6) AS z FROM h),
a AS (SELECT user_id AS actor, count(*) AS n FROM events GROUP BY user_id), y AS (SELECT *, round((n - (SELECT avg(n) FROM a)) / (SELECT stddev_samp(n) FROM a), 6) AS z FROM a)
SELECT 'hour' AS kind, event_type || '/' || strftime(hour, '%Y-%m-%d %H') AS subject, n, z FROM z WHERE z >= 2 UNION ALL SELECT 'actor', actor::VARCHAR, n, z FROM y WHERE z >= 2
UNION ALL SELECT 'off_hours', user_id::VARCHAR, count(*), NULL FROM events WHERE hour(ts) BETWEEN 0 AND 6 GROUP BY user_id HAVING count(*) >= 10""")
def audit_anomalies(t: Tables) -> DataFrame:
    return governance.anomalies(t.events, "ts", ["event_type"], "user_id", 2.0)


@query("SELECT event_id::VARCHAR AS entry_id FROM events WHERE event_type = 'click' AND CAST(json_extract_string(props, '$.k') AS BIGINT) <= 50")
def audit_replayed(t: Tables) -> DataFrame:
    entries = t.events.select(F.col("event_id").cast("string").alias("entry_id"), F.col("event_type").alias("dataset_name"), F.from_json("props", "k bigint")["k"].alias("version"), F.col("ts").alias("created_at"))
    return governance.replay(entries, "click", 50).select("entry_id")
