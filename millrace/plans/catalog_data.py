"""Queries over sources, sinks, versioned tables and time windows."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.registry import Tables, query
from millrace.plans.sqlservice import SqlService
from millrace.session import shared_dir
from millrace.sources import readers, sinks
from millrace.sources.store import Store
from millrace.streaming import windows


def _folder(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/millrace/{name}-{uuid.uuid4().hex}"


def _store(t: Tables) -> Store:
    return Store(t.spark, _folder(t, "store"))


# --- versioned tables --------------------------------------------------------------------------------------------------------


@query("SELECT s_suppkey AS id, s_name AS name, NULL::DOUBLE AS balance FROM supplier UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer")
def store_append_evolving(t: Tables) -> DataFrame:
    store = _store(t)
    store.create("people", t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))
    return store.append("people", t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")))


@query("SELECT blob_key, doc_id, n_chars FROM documents WHERE blob_key NOT IN (SELECT blob_key FROM documents WHERE lang = 'zh') UNION ALL SELECT blob_key, doc_id, -n_chars FROM documents WHERE lang = 'zh'")
def store_append_documents(t: Tables) -> DataFrame:
    store = _store(t)
    docs = t.documents.select("blob_key", "doc_id", "n_chars")
    store.create("docs", docs)
    again = t.documents.where("lang = 'zh'").select("blob_key", "doc_id", (-F.col("n_chars")).alias("n_chars"))
    return store.append("docs", again, "blob_key")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debtor' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer UNION ALL SELECT s_suppkey + 10000000, 'supplier', s_acctbal FROM supplier")
def store_upsert(t: Tables) -> DataFrame:
    store = _store(t)
    rows = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal")
    store.upsert("accounts", rows, "c_custkey")
    fresh = t.supplier.select((F.col("s_suppkey") + 10_000_000).alias("c_custkey"), F.lit("supplier").alias("c_mktsegment"), F.col("s_acctbal").alias("c_acctbal"))
    return store.upsert("accounts", rows.where("c_acctbal < 0").withColumn("c_mktsegment", F.lit("debtor")).unionByName(fresh), "c_custkey")


@query("SELECT p_partkey, CASE WHEN p_size > 40 THEN p_retailprice * 2 ELSE p_retailprice END AS p_retailprice, p_size FROM part WHERE NOT (p_brand = 'Brand#1')")
def store_update_delete(t: Tables) -> DataFrame:
    store = _store(t)
    store.create("parts", t.part.select("p_partkey", "p_retailprice", "p_size", "p_brand"))
    store.update("parts", "p_size > 40", {"p_retailprice": "p_retailprice * 2"})
    store.delete("parts", "p_brand = 'Brand#1'")
    return store.read("parts", columns=["p_partkey", "p_retailprice", "p_size"])


@query("SELECT 'first' AS at, count(*) AS n FROM nation UNION ALL SELECT 'tagged', count(*) FROM nation WHERE n_regionkey <> 0 UNION ALL SELECT 'head', count(*) FROM nation")
def store_time_travel(t: Tables) -> DataFrame:
    store = _store(t)
    store.create("nations", t.nation)
    store.delete("nations", "n_regionkey = 0")
    store.tag("nations", "without_africa")
    store.delete("nations", "n_regionkey = 1")
    store.rollback("nations", 1)
    counts = [store.read("nations", v).agg(F.lit(at).alias("at"), F.count("*").alias("n")) for at, v in (("first", 1), ("tagged", "without_africa"), ("head", None))]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("SELECT (SELECT count(*) FROM part WHERE p_size > 40) AS added, (SELECT count(*) FROM part WHERE p_size > 40) AS removed, 0 AS net_added, 0 AS net_removed")
def store_diff(t: Tables) -> DataFrame:
    store = _store(t)
    store.create("parts", t.part.select("p_partkey", "p_size"))
    store.update("parts", "p_size > 40", {"p_size": "p_size + 100"})
    return store.diff("parts", 1, 2).select("added", "removed", "net_added", "net_removed")


@query("SELECT 1 AS version, 'create' AS op, (SELECT count(*) FROM region) AS num_rows, false AS is_head UNION ALL SELECT 2, 'append', 2 * (SELECT count(*) FROM region), false UNION ALL SELECT 3, 'compact', 2 * (SELECT count(*) FROM region), true")
def store_versions(t: Tables) -> DataFrame:
    store = _store(t)
    store.create("regions", t.region)
    store.append("regions", t.region)
    store.compact("regions")
    return store.versions("regions").select(F.col("version").cast("int").alias("version"), "op", "num_rows", "is_head")


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def sql_materialized_view(t: Tables) -> DataFrame:
    service = SqlService(t.spark, _folder(t, "views"))
    return service.materialize("per_region", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey", {"nation": t.nation}, now=time.time())


# --- sources and sinks -----------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def source_csv_round_trip(t: Tables) -> DataFrame:
    path = _folder(t, "out") + ".csv"
    sinks.export(t.customer, path)
    return readers.read_files(t.spark, path, ["c_custkey", "c_name", "c_acctbal"], "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")


@query("SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def source_json_promoted(t: Tables) -> DataFrame:
    path = _folder(t, "out") + ".json"
    sinks.export(t.events.select("event_id", "event_type", "props"), path)
    read = readers.read_files(t.spark, path, schema="event_id bigint, event_type string, props string")
    return readers.decode_json(read, "props", "k bigint", ["event_id", "event_type"])


@query("SELECT doc_id, vec, n FROM (SELECT id AS doc_id, len(text_embedding) AS vec, image_width AS n FROM unified_records)")
def sink_parquet_round_trip(t: Tables) -> DataFrame:
    path = _folder(t, "out") + ".parquet"
    sinks.export(t.unified_records, path, columns=["id", "text_embedding", "image_width"])
    read = readers.read_files(t.spark, path)
    return read.select(F.col("id").alias("doc_id"), F.when(F.col("text_embedding").isNotNull(), F.size("text_embedding").cast("bigint")).alias("vec"), F.col("image_width").alias("n"))


@query("SELECT id, source, image_width, image_height, exif_make FROM unified_records WHERE modality = 'image'")
def unified_modality(t: Tables) -> DataFrame:
    return readers.modality_view(t.unified_records, "image").select("id", "source", "image_width", "image_height", "exif_make")


@query("SELECT 'text' AS modality, count(*) AS n, count(DISTINCT text) AS ids FROM documents WHERE text IS NOT NULL")
def unified_from_text(t: Tables) -> DataFrame:
    made = readers.unified(t.documents.where("text is not null").select(F.col("text").alias("text_content")), "text")
    return made.groupBy("modality").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


@query("SELECT n_regionkey, count(*) AS n, NULL::VARCHAR AS _error FROM nation GROUP BY n_regionkey")
def sink_foreach_partition(t: Tables) -> DataFrame:
    copied = sinks.foreach_partition(t.nation, lambda pdf: pdf[["n_nationkey", "n_regionkey"]], "n_nationkey int, n_regionkey int", 3)
    return copied.groupBy("n_regionkey").agg(F.count("*").alias("n"), F.max("_error").alias("_error"))


# --- time windows -----------------------------------------------------------------------------------------------------------------


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def window_tumbling(t: Tables) -> DataFrame:
    found = windows.windowed(t.events, "ts", "1 hour", None, ["event_type"], [F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")])
    return found.select("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", "total")


@query("SELECT time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS window_start, count(*) AS n FROM events, (VALUES (0), (1)) AS s (k) GROUP BY ALL")
def window_sliding(t: Tables) -> DataFrame:
    found = windows.windowed(t.events, "ts", "1 hour", "30 minutes", [], [F.count("*").alias("n")])
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


_GAPS = "SELECT event_id, user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS gap FROM events"


@query(f"SELECT event_id, user_id, CAST(sum(gap) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) + 1 AS BIGINT) AS session_no FROM ({_GAPS})")
def window_session_ids(t: Tables) -> DataFrame:
    return windows.session_ids(t.events, "ts", 6 * 3600, ["user_id"]).select("event_id", "user_id", "session_no")


@query(f"SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (SELECT *, sum(gap) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM ({_GAPS})) GROUP BY user_id, s")
def window_sessions(t: Tables) -> DataFrame:
    found = windows.sessions(t.events, "ts", "6 hours", ["user_id"], [F.count("*").alias("n")])
    return found.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_to_table(t: Tables) -> DataFrame:
    """The events as a stream, each id once, into a table."""
    folder = _folder(t, "stream")
    t.events.repartition(3).write.parquet(f"{folder}/in")
    stream = windows.read_stream(t.events, f"{folder}/in").withColumn("at", F.col("ts").cast("timestamp"))
    windows.run_to_table(windows.without_repeats(stream, ["event_id"], "at", "60 days"), f"{folder}/out", f"{folder}/checkpoint")
    return t.spark.read.parquet(f"{folder}/out").groupBy("event_type").agg(F.count("*").alias("n"))
