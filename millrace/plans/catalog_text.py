"""Queries over text preparation: cleaning, transforms, rules, filters, duplicates, chunks, scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import exprs
from millrace.operators import chunking, dedup, models, quality
from millrace.operators.transforms import apply_transforms, clean
from millrace.plans.registry import Tables, query
from millrace.session import materialize


@query("""SELECT doc_id, upper(trim(coalesce(source, 'none'))) AS source, concat_ws(' / ', category, lang) AS label, split_part(blob_key, '/', 2) AS blob_key_2,
CASE category WHEN 'db' THEN 'database' WHEN 'legal' THEN 'law' END AS category FROM (SELECT * FROM documents WHERE n_chars >= 100)""")
def clean_steps(t: Tables) -> DataFrame:
    steps = [
        {"op": "fillna", "column": "source", "value": "none"}, {"op": "trim", "column": "source"}, {"op": "upper", "column": "source"},
        {"op": "concat", "columns": ["category", "lang"], "sep": " / ", "as": "label"}, {"op": "split", "column": "blob_key", "sep": "/", "index": 2},
        {"op": "case", "column": "category", "mapping": {"db": "database", "legal": "law"}}, {"op": "drop", "columns": ["title", "text", "lang", "blob_key", "created_at", "n_chars"]},
    ]
    return clean(t.documents, steps, [{"column": "n_chars", "op": ">=", "value": 100}])


@query("SELECT p_partkey, regexp_replace(p_name, '(a|e)', '<\\1>') AS p_name, CAST(p_retailprice AS INTEGER) AS p_retailprice, CAST(p_size AS VARCHAR) AS size FROM part")
def clean_regex_cast(t: Tables) -> DataFrame:
    steps = [{"op": "regex_replace", "column": "p_name", "pattern": "(a|e)", "replacement": r"<\1>"}, {"op": "cast", "column": "p_retailprice", "dtype": "INTEGER"}, {"op": "cast", "column": "p_size", "dtype": "VARCHAR"}, {"op": "rename", "column": "p_size", "to": "size"}, {"op": "drop", "columns": ["p_brand", "p_type"]}]
    return clean(t.part, steps)


@query("""SELECT key, price, kind FROM (SELECT o_custkey AS key, CAST(o_totalprice AS FLOAT) AS price, 'order' AS kind, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n
FROM orders WHERE o_orderstatus = 'F') WHERE n = 1""")
def transform_list(t: Tables) -> DataFrame:
    orders = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    steps = [
        {"op": "filter", "column": "o_orderstatus", "operator": "==", "value": "F"}, {"op": "deduplicate", "columns": ["o_custkey"], "order_by": "o_totalprice", "desc": True},
        {"op": "rename", "from": "o_custkey", "to": "key"}, {"op": "rename", "from": "o_totalprice", "to": "price"}, {"op": "cast", "column": "price", "dtype": "float32"},
        {"op": "add_constant", "column": "kind", "value": "order"}, {"op": "select", "columns": ["key", "price", "kind"]},
    ]
    return apply_transforms(orders, steps)


@query("""SELECT doc_id, length(text) AS n, CASE WHEN regexp_matches(text, '[\\x{3040}-\\x{30ff}\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}]') THEN CAST(floor(length(text) / 1.5) AS BIGINT) ELSE length(text) // 4 END AS tokens,
substr(sha256(text), 1, 16) AS hash, substr(sha1(text), 1, 16) AS short_hash FROM documents WHERE text IS NOT NULL""")
def text_scalars(t: Tables) -> DataFrame:
    text = F.col("text")
    return t.documents.where("text is not null").select("doc_id", F.char_length(text).alias("n"), exprs.token_estimate(text).alias("tokens"), exprs.content_hash(text, 16).alias("hash"), F.substr(F.sha1(text.cast("binary")), F.lit(1), F.lit(16)).alias("short_hash"))


@query("SELECT c_custkey, lower(trim(regexp_replace(c_name, '\\s+', ' ', 'g'))) AS norm, 'kg_' || substr(regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 48) AS artifact FROM customer")
def text_names(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", exprs.normalized_name(F.col("c_name")).alias("norm"), exprs.artifact_name(F.col("c_name")).alias("artifact"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, date_part('hour', ts) AS h, strftime(ts, '%Y-%m-%d') AS d, dayofweek(ts) AS dow, date_trunc('hour', ts) AS hour_start, round(epoch_us(ts) / 1e6, 3) AS epoch FROM events")
def json_and_dates(t: Tables) -> DataFrame:
    ts = F.col("ts")
    return t.events.select("event_id", F.from_json("props", "k int")["k"].alias("k"), F.hour(ts).cast("bigint").alias("h"), F.date_format(ts, "yyyy-MM-dd").alias("d"), (F.dayofweek(ts) - 1).cast("bigint").alias("dow"), F.date_trunc("hour", ts).cast("timestamp_ntz").alias("hour_start"), F.round(F.unix_micros(ts.cast("timestamp")) / 1e6, 3).alias("epoch"))


@query("""SELECT c_custkey, regexp_replace(c_name, '[^\\n]', '*', 'g') AS redacted, CASE WHEN length(c_name) <= 4 THEN '****' ELSE left(c_name, 2) || repeat('*', length(c_name) - 4) || right(c_name, 2) END AS partial,
substr(sha256(unhex('3731ae3a3d3f7d5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c5c') || unhex(sha256(unhex('5d5bc450575517363636363636363636363636363636363636363636363636363636363636363636363636363636363636363636363636363636363636363636') || encode(c_name)))), 1, 32) AS hashed, NULL::VARCHAR AS nothing FROM customer""")
def mask_values(t: Tables) -> DataFrame:
    name = F.col("c_name")
    return t.customer.select("c_custkey", exprs.mask(name, "redact").alias("redacted"), exprs.mask(name, "partial").alias("partial"), exprs.mask(name, "hash", bytes.fromhex("6b6df266616321")).alias("hashed"), exprs.mask(name, "nullify").alias("nothing"))


# --- rules and filters ------------------------------------------------------------------------------------------------

_RULES = [
    quality.Rule("short", "text", "length", "reject", {"min": 200}), quality.Rule("size", "n_chars", "range", "flag", {"max": 2000}),
    quality.Rule("code", "text", "regex", "flag", {"pattern": "`[^`]+`"}), quality.Rule("copy", "text", "duplicate", "remove"), quality.Rule("gone", "no_such_column", "length", "reject", {"min": 1}),
]


@query("""SELECT * FROM (SELECT 'short' AS rule, 'reject' AS action, count(*) FILTER (length(text) < 200) AS violations FROM documents UNION ALL SELECT 'size', 'flag', count(*) FILTER (n_chars > 2000) FROM documents UNION ALL
SELECT 'code', 'flag', count(*) FILTER (regexp_matches(text, '`[^`]+`')) FROM documents UNION ALL SELECT 'copy', 'remove', count(*) FILTER (n > 1) FROM (SELECT row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents WHERE text <> '')) WHERE violations > 0""")
def rules_report(t: Tables) -> DataFrame:
    return quality.evaluate_rules(t.documents, _RULES, ["doc_id"])


@query("SELECT doc_id FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE coalesce(length(text) >= 200, true) AND NOT (n > 1 AND coalesce(text, '') <> '')")
def rules_applied(t: Tables) -> DataFrame:
    return quality.apply_rules(t.documents, _RULES, ["doc_id"]).select("doc_id")


_FILTERS = [quality.text_length("text_content", 50, 5000), quality.image_resolution(128, 128)]


@query("""WITH j AS (SELECT coalesce(length(text_content) BETWEEN 50 AND 5000, true) AS a, coalesce(image_width >= 128 AND image_height >= 128, true) AS b FROM unified_records)
SELECT 'text_length' AS filter, count(*) AS seen, count(*) FILTER (a) AS passed, count(*) FILTER (NOT a) AS rejected FROM j UNION ALL
SELECT 'image_resolution', count(*) FILTER (a), count(*) FILTER (a AND b), count(*) FILTER (a AND NOT b) FROM j""")
def filters_report(t: Tables) -> DataFrame:
    return quality.filter_report(t.unified_records, _FILTERS)


@query("""SELECT id, CASE WHEN NOT coalesce(length(text_content) BETWEEN 50 AND 5000, true) THEN 'text_content is shorter than 50 or longer than 5000' WHEN NOT coalesce(image_width >= 128 AND image_height >= 128, true) THEN 'smaller than 128x128' END AS reason FROM unified_records""")
def filters_all(t: Tables) -> DataFrame:
    return quality.judged(t.unified_records, _FILTERS).select("id", F.col("_rejection_reason").alias("reason"))


@query("SELECT count(*) AS passed FROM unified_records WHERE coalesce(length(text_content) BETWEEN 50 AND 5000, true) OR coalesce(image_width >= 128 AND image_height >= 128, true)")
def filters_any(t: Tables) -> DataFrame:
    return quality.judged(t.unified_records, _FILTERS, "any").where("_passed").agg(F.count("*").alias("passed"))


@query("""WITH q AS (SELECT least(1.0, coalesce(length(text_content), 0) / 1000.0)::DOUBLE AS a, CASE WHEN regexp_matches(lower(text_content), 'nsfw|porn|xxx|nude|explicit|sexual|adult content') THEN 0.9 ELSE 0.0 END::DOUBLE AS n,
least(1.0, coalesce(image_width::DOUBLE * image_height, 0) / 16777216)::DOUBLE AS e FROM unified_records) SELECT round(avg(a), 6) AS text_quality, round(avg(n), 6) AS nsfw, round(avg(e), 6) AS aesthetic, round(avg((a + 1 - n + e) / 3), 6) AS composite FROM q""")
def heuristic_scores(t: Tables) -> DataFrame:
    scored = quality.heuristic_scores(t.unified_records)
    return scored.agg(*[F.round(F.avg(c), 6).alias(c) for c in ("text_quality", "nsfw", "aesthetic", "composite")])


_TARGET = T.StructType([T.StructField("doc_id", T.LongType(), False), T.StructField("source", T.StringType(), False), T.StructField("lang", T.StringType()), T.StructField("n_chars", T.IntegerType())])


@query("SELECT CASE WHEN source IS NULL THEN 'schema' WHEN length(text) < 300 THEN 'filter' ELSE 'passed' END AS stage, count(*) AS n FROM documents GROUP BY 1")
def gate_stages(t: Tables) -> DataFrame:
    gated = quality.gate(t.documents, _TARGET, [quality.text_length("text", 300)])
    return gated.groupBy(F.col("_stage").alias("stage")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN source IS NULL THEN 'null in source' ELSE 'text is shorter than 300' END AS reason, CASE WHEN source IS NULL THEN 'gate:schema' ELSE 'gate:filter' END AS filter_name FROM documents WHERE source IS NULL OR length(text) < 300")
def dead_letter_rows(t: Tables) -> DataFrame:
    letters = quality.dead_letters(quality.gate(t.documents, _TARGET, [quality.text_length("text", 300)]))
    return letters.select("doc_id", F.col("_rejection_reason").alias("reason"), F.col("_filter_name").alias("filter_name"))


@query("SELECT doc_id, source, lang, CAST(n_chars AS INTEGER) AS n_chars FROM documents WHERE source IS NOT NULL")
def schema_valid_rows(t: Tables) -> DataFrame:
    return quality.validate(t.documents, _TARGET)[0]


# --- duplicates ------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1 OR text IS NULL OR text = ''")
def dedup_exact(t: Tables) -> DataFrame:
    return dedup.exact(t.documents.select("doc_id", "text"), ["text"], ["doc_id"]).select("doc_id")


@query("SELECT doc_id, coalesce(text <> '', false) AND row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS is_duplicate FROM documents")
def dedup_exact_flag(t: Tables) -> DataFrame:
    return dedup.exact(t.documents.select("doc_id", "text"), ["text"], ["doc_id"], "flag").select("doc_id", "is_duplicate")


@query("WITH s AS (SELECT DISTINCT text FROM documents WHERE source = 'web_crawl' AND text IS NOT NULL) SELECT min(doc_id) AS doc_id FROM documents WHERE text NOT IN (SELECT text FROM s) AND text <> '' GROUP BY text")
def dedup_incremental(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "source", "text").where("text <> ''")
    seen = docs.where("source = 'web_crawl'").select(dedup.content_key(["text"]).alias("hash"))
    return dedup.incremental(docs, seen, ["text"], ["doc_id"])[0].select("doc_id")


@query()
def dedup_perceptual(t: Tables) -> DataFrame:
    """Fingerprints of texts stand in for those of images; the threshold is the operator's own, 10 bits."""
    prints = materialize(t.documents.select("doc_id", dedup.simhash(F.col("text")).alias("bits")), "prints")
    return dedup.perceptual(prints, "bits", ["doc_id"], action="flag").select("doc_id", "is_duplicate")


@query()
def dedup_near(t: Tables) -> DataFrame:
    return dedup.near(t.documents.select("doc_id", "text"), "text", "doc_id")


@query("SELECT count(*) FILTER (n = 1) AS unique_rows, count(*) FILTER (n > 1) AS duplicates FROM (SELECT row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents WHERE text <> '')")
def dedup_split(t: Tables) -> DataFrame:
    unique, again = dedup.split(t.documents.where("text <> ''").select("doc_id", "text"), ["text"], ["doc_id"])
    return unique.agg(F.count("*").alias("unique_rows")).join(again.agg(F.count("*").alias("duplicates")))


@query("SELECT source, doc_id, n_chars FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n = 1")
def dedup_keep_best(t: Tables) -> DataFrame:
    return dedup.keep_best(t.documents.select("source", "doc_id", "n_chars"), ["source"], "n_chars", "doc_id")


# --- chunks --------------------------------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda p: trim(p)), lambda p: p <> '') AS ps FROM documents)
SELECT doc_id, CAST(generate_subscripts(ps, 1) - 1 AS BIGINT) AS chunk_index, unnest(ps) AS text FROM p""")
def chunk_paragraphs(t: Tables) -> DataFrame:
    return chunking.chunk(t.documents.select("doc_id", F.lit(1).alias("page_number"), "text"), "paragraph").drop("page_number")


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(generate_series(0, greatest(len(ws) - 17, 0), 112)) AS pos FROM w WHERE len(ws) > 0)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS BIGINT) AS chunk_index, array_to_string(ws[pos + 1 : pos + 128], ' ') AS text FROM s""")
def chunk_word_windows(t: Tables) -> DataFrame:
    return chunking.chunk(t.documents.select("doc_id", F.lit(1).alias("page_number"), "text"), "words", 512, 64).drop("page_number")


@query()
def chunk_recursive(t: Tables) -> DataFrame:
    return chunking.chunk(t.documents.select("doc_id", F.lit(1).alias("page_number"), "text"), "recursive", 512, 64).drop("page_number")


@query("SELECT doc_id, CAST(0 AS BIGINT) AS chunk_index, trim(text) AS text FROM documents WHERE trim(text) <> ''")
def chunk_pages(t: Tables) -> DataFrame:
    return chunking.chunk(t.documents.select("doc_id", F.lit(1).alias("page_number"), "text"), "page").drop("page_number")


# --- model columns ------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, text IS NULL AS missing, CASE WHEN text IS NOT NULL THEN 1.0::DOUBLE END AS length FROM documents")
def embed_texts(t: Tables) -> DataFrame:
    made = models.embed(t.documents.select("doc_id", "text"), "text", "vector", lambda: models.hashing_encoder(32), 32)
    return made.select("doc_id", F.col("vector").isNull().alias("missing"), F.round(F.sqrt(exprs.dot(F.col("vector"), F.col("vector"))), 3).alias("length"))


@query("SELECT CASE WHEN regexp_matches(text, '(?i)\\b(court|statutory)\\b') THEN 'law' WHEN regexp_matches(text, '(?i)\\b(tender|bid)\\b') THEN 'procurement' ELSE 'general' END AS label, count(*) AS n FROM documents GROUP BY 1")
def route_documents(t: Tables) -> DataFrame:
    label = models.classify_by_words(F.col("text"), [("law", ["court", "statutory"]), ("procurement", ["tender", "bid"])])
    return t.documents.groupBy(label.alias("label")).agg(F.count("*").alias("n"))
