"""Queries over retrieval and the assembly of contexts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import rag, search
from millrace.plans.registry import Tables, query
from millrace.session import materialize, shared_dir


def _q(t: Tables) -> list[float]:
    return search.query_vector(t.embeddings, "embedding", F.col("vec_id") == 0)


_VEC = "SELECT e.vec_id, round({d}, 5) + 0 AS d FROM embeddings e, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) WHERE len(e.embedding) = len(q) {w} ORDER BY {d}, e.vec_id LIMIT 10"


@query(_VEC.format(d="1 - list_cosine_similarity(e.embedding::DOUBLE[], q::DOUBLE[])", w=""))
def vector_cosine(t: Tables) -> DataFrame:
    return search.vector_search(t.embeddings, _q(t), 10, "cosine", "embedding", key="vec_id").select("vec_id", (F.round("_distance", 5) + F.lit(0.0)).alias("d"))


@query(_VEC.format(d="list_distance(e.embedding::DOUBLE[], q::DOUBLE[]) ** 2", w="AND label IN (1, 2, 3)"))
def vector_l2_filtered(t: Tables) -> DataFrame:
    return search.vector_search(t.embeddings, _q(t), 10, "l2", "embedding", "label IN (1, 2, 3)", "vec_id").select("vec_id", (F.round("_distance", 5) + F.lit(0.0)).alias("d"))


@query(_VEC.format(d="1 - list_dot_product(e.embedding::DOUBLE[], q::DOUBLE[])", w=""))
def vector_dot(t: Tables) -> DataFrame:
    return search.vector_search(t.embeddings, _q(t), 10, "dot", "embedding", key="vec_id").select("vec_id", (F.round("_distance", 5) + F.lit(0.0)).alias("d"))


@query(_VEC.format(d="1 - list_cosine_similarity(e.embedding::DOUBLE[], q::DOUBLE[])", w=""))
def vector_ivf_all_probes(t: Tables) -> DataFrame:
    centers = search.ivf_fit(t.embeddings, "embedding", 16, key="vec_id")
    folder = f"{shared_dir(t.spark)}/millrace/ivf-{uuid.uuid4().hex}"
    index = search.ivf_build(t.embeddings, folder, "embedding", centers)
    return search.ivf_search(index, centers, _q(t), 10, 16, vector="embedding", key="vec_id").select("vec_id", (F.round("_distance", 5) + F.lit(0.0)).alias("d"))


def _terms_sql(text: str) -> str:
    """The list of a text's terms: runs of letters and digits, those with Han or kana as overlapping pairs."""
    cjk = "[\\x{3040}-\\x{30ff}\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}]"
    words = f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return f"flatten(list_transform({words}, lambda w: CASE WHEN regexp_matches(w, '{cjk}') THEN list_transform(generate_series(1, greatest(length(w) - 1, 1)), lambda i: substr(w, i, 2)) ELSE [w] END))"


_INDEX = f"""d AS MATERIALIZED (SELECT * FROM (SELECT doc_id, {_terms_sql("text")} AS ws FROM documents WHERE text IS NOT NULL) WHERE len(ws) > 0), n AS (SELECT count(*) AS docs, avg(len(ws)) AS mean FROM d),
p AS MATERIALIZED (SELECT doc_id, w, count(*) AS tf, any_value(len) AS len FROM (SELECT doc_id, len(ws) AS len, unnest(ws) AS w FROM d) GROUP BY doc_id, w)"""
_WEIGHT = "ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))"
_BM25 = f"""WITH {_INDEX}, f AS (SELECT w, count(*) AS df FROM p WHERE w IN ('hash', 'joins', 'annex', '向量', '量索', '索引') GROUP BY w)
SELECT doc_id, round(sum({_WEIGHT}), 6) AS score FROM p JOIN f USING (w), n GROUP BY doc_id"""
_ASKED = "Hash joins, annex 向量索引"


@query(_BM25)
def fts_bm25_scores(t: Tables) -> DataFrame:
    index = materialize(search.postings(t.documents, "text", "doc_id"), "index")
    return search.bm25(index, _ASKED, None, key="doc_id").select("doc_id", F.round("_score", 6).alias("score"))


@query(f"SELECT doc_id, score FROM ({_BM25}) ORDER BY score DESC, doc_id LIMIT 20")
def fts_top(t: Tables) -> DataFrame:
    scored = search.matches(t.documents, _ASKED, "text", "doc_id").select("doc_id", F.round("_score", 6).alias("score"))
    return scored.orderBy(F.desc("score"), "doc_id").limit(20)


@query("SELECT doc_id FROM documents WHERE contains(text, '向量索引')")
def fts_cjk_pairs(t: Tables) -> DataFrame:
    """Texts with all pairs of a term in Han characters; a check for the term itself follows."""
    index = search.postings(t.documents, "text", "doc_id")
    asked = ["向量", "量索", "索引"]
    hits = index.where(F.col("term").isin(asked)).groupBy("doc_id").agg(F.countDistinct("term").alias("k")).where(F.col("k") == len(asked))
    return t.documents.select("doc_id", "text").join(hits, "doc_id", "left_semi").where(F.col("text").contains("向量索引")).select("doc_id")


_RANKED = """v AS (SELECT vec_id, row_number() OVER (ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), vec_id) AS r FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)),
u AS (SELECT vec_id, row_number() OVER (ORDER BY list_distance(embedding::DOUBLE[], q::DOUBLE[]) ** 2, vec_id) AS r FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 7))"""


@query(f"WITH {_RANKED} SELECT CAST(vec_id AS VARCHAR) AS vec_id, round(sum(1.0 / (60 + r)), 6) AS score FROM (SELECT * FROM v WHERE r <= 30 UNION ALL SELECT * FROM u WHERE r <= 30) GROUP BY vec_id ORDER BY score DESC, CAST(vec_id AS VARCHAR) LIMIT 10")
def fusion_rrf(t: Tables) -> DataFrame:
    other = search.query_vector(t.embeddings, "embedding", F.col("vec_id") == 7)
    lists = [(search.ranked(search.vector_search(t.embeddings, q, 30, m, "embedding", key="vec_id"), "_distance", True, "vec_id"), 1.0) for q, m in ((_q(t), "cosine"), (other, "l2"))]
    return search.fuse(lists, 10, "vec_id", "score")


@query(f"WITH {_RANKED} SELECT CAST(vec_id AS VARCHAR) AS vec_id, round(sum(w / (60 + r)), 6) AS score FROM (SELECT *, 0.7 AS w FROM v WHERE r <= 30 UNION ALL SELECT *, 0.3 FROM u WHERE r <= 30) GROUP BY vec_id ORDER BY score DESC, CAST(vec_id AS VARCHAR) LIMIT 10")
def fusion_weighted(t: Tables) -> DataFrame:
    other = search.query_vector(t.embeddings, "embedding", F.col("vec_id") == 7)
    lists = [(search.ranked(search.vector_search(t.embeddings, q, 30, m, "embedding", key="vec_id"), "_distance", True, "vec_id"), w) for q, m, w in ((_q(t), "cosine", 0.7), (other, "l2", 0.3))]
    return search.fuse(lists, 10, "vec_id", "score")


@query()
def hybrid_top(t: Tables) -> DataFrame:
    records = t.unified_records.where("text_content is not null").dropDuplicates(["id"])
    vector = search.query_vector(records.where("size(text_embedding) = 384"), "text_embedding", F.forall("text_embedding", lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists("text_embedding", lambda x: x != 0))
    return search.hybrid_search(records.select("id", "source", "text_content", "text_embedding"), "vector indexes and passage scores", vector, 20).select("id", "source", "_rrf_score")


@query()
def ensemble_top(t: Tables) -> DataFrame:
    both = t.embeddings.withColumn("backwards", F.reverse("embedding"))
    return search.ensemble_search(both, _q(t), {"embedding": 0.8, "backwards": 0.2}, 10, "vec_id").select("vec_id", "label", "_ensemble_score")


@query("""SELECT facet, value, n FROM (SELECT 'p_brand' AS facet, p_brand AS value, count(*) AS n FROM part WHERE p_size > 10 GROUP BY p_brand UNION ALL SELECT 'p_type', p_type, count(*) FROM part WHERE p_size > 10 GROUP BY p_type)""")
def facets_counted(t: Tables) -> DataFrame:
    return search.faceted_search(t.part, ["p_brand", "p_type"], where="p_size > 10", key="p_partkey")[1]


# --- contexts -------------------------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT source, doc_id, n_chars // 4 AS tokens, sum(n_chars // 4) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents WHERE source IS NOT NULL)
SELECT source, doc_id, tokens FROM c WHERE used <= 2000 AND n <= 20""")
def context_budget(t: Tables) -> DataFrame:
    chunks = t.documents.where("source is not null").select("source", "doc_id", F.col("n_chars").alias("score"), F.floor(F.col("n_chars") / 4).alias("tokens"))
    return rag.context_window(chunks, ["source"], 2000, "score", "doc_id", "tokens", 20).select("source", "doc_id", "tokens")


@query("""SELECT source, string_agg('[' || n || '] ' || title, chr(10) ORDER BY n) AS context FROM (SELECT source, title, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents WHERE source IS NOT NULL AND title IS NOT NULL) WHERE n <= 5 GROUP BY source""")
def context_assembled(t: Tables) -> DataFrame:
    rows = t.documents.where("source is not null and title is not null").select("source", "doc_id", "title", F.col("n_chars").alias("score"))
    return rag.assemble(rows, ["source"], "title", "score", "doc_id", 5)


@query("""WITH a AS (SELECT doc_id, replace(text, '. ', ' [' || doc_id % 5 || ']. ') AS text FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), '([。！？])', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 6)) AS x FROM a),
c AS (SELECT doc_id, count(*) AS sentences, count(*) FILTER (regexp_matches(x, '\\[[1-3]\\]')) AS supported FROM s GROUP BY doc_id) SELECT doc_id, coalesce(sentences, 0) AS sentences, coalesce(supported, 0) AS supported FROM a LEFT JOIN c USING (doc_id)""")
def citations_verified(t: Tables) -> DataFrame:
    """Every text as an answer whose sentences refer to a source by number; there are three sources."""
    answers = t.documents.where("text is not null").select("doc_id", F.replace("text", F.lit(". "), F.concat(F.lit(" ["), F.col("doc_id") % 5, F.lit("]. "))).alias("text"))
    return rag.verify(answers, "doc_id", "text", 3).select("doc_id", "sentences", "supported")


@query("""WITH r AS (SELECT doc_id, lang, text, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS turn FROM documents WHERE lang IS NOT NULL), b AS (SELECT *, sum(length(text) // 4) OVER (PARTITION BY lang ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM r WHERE turn > (SELECT max(turn) FROM r x WHERE x.lang = r.lang) - 6)
SELECT lang, turn, doc_id FROM b WHERE used <= 800""")
def history_budget(t: Tables) -> DataFrame:
    turns = t.documents.where("lang is not null").select("lang", "doc_id", F.floor(F.char_length("text") / 4).alias("tokens"), "n_chars")
    return rag.history(turns, ["lang"], [F.desc("n_chars"), F.asc("doc_id")], 4000, 0.2, 6).select("lang", "turn", "doc_id")


@query(f"""WITH {_INDEX}, q AS (SELECT DISTINCT item_id, unnest({_terms_sql("item_text")}) AS w FROM eval_items), f AS (SELECT w, count(*) AS df FROM p GROUP BY w),
s AS (SELECT item_id, doc_id, round(sum({_WEIGHT}), 6) AS _score FROM q JOIN f USING (w) JOIN p USING (w), n GROUP BY item_id, doc_id)
SELECT item_id, doc_id, _score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY _score DESC, doc_id) AS rank FROM s) WHERE rank <= 3""")
def batch_retrieval(t: Tables) -> DataFrame:
    questions = t.eval_items.select("item_id", F.col("item_text").alias("question"))
    return rag.batch_retrieve(questions, materialize(search.postings(t.documents, "text", "doc_id"), "index"), 3)
