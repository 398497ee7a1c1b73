"""Queries over graphs and knowledge graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import exprs
from millrace.operators import graph, knowledge
from millrace.plans.registry import Tables, query
from millrace.plans.sqlservice import SqlService

def _trade(t: Tables) -> DataFrame:
    """Customers and the suppliers of what they ordered: vertices are numbers, suppliers negative."""
    lines = t.lineitem.select("l_orderkey", "l_suppkey").join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    return lines.select(F.col("o_custkey").alias("src"), (-F.col("l_suppkey") - 1).alias("dst")).distinct()


_TRADE = "(SELECT DISTINCT o_custkey AS src, -l_suppkey - 1 AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query(f"SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree, count(*) AS degree FROM (SELECT src AS id, 0 AS i, 1 AS o FROM {_TRADE} UNION ALL SELECT dst, 1, 0 FROM {_TRADE}) GROUP BY id")
def graph_degrees(t: Tables) -> DataFrame:
    return graph.degrees(_trade(t))


@query(f"WITH RECURSIVE e AS MATERIALIZED {_TRADE}, b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), k1 AS (SELECT DISTINCT dst AS id FROM b WHERE src = -1), k2 AS (SELECT DISTINCT b.dst AS id FROM b JOIN k1 ON b.src = k1.id) SELECT -1::BIGINT AS id, 0 AS depth UNION ALL SELECT id, 1 FROM k1 UNION ALL SELECT id, 2 FROM k2 WHERE id <> -1 AND id NOT IN (SELECT id FROM k1)")
def graph_k_neighbours(t: Tables) -> DataFrame:
    return graph.neighbours(_trade(t), t.spark.createDataFrame([(-1,)], "id bigint"), 2)


def _chains(t: Tables) -> DataFrame:
    """Orders linked to the customer's next one: a chain per customer."""
    from pyspark.sql.window import Window

    after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return t.orders.select(F.col("o_orderkey").alias("src"), after.alias("dst")).where("dst is not null")


@query("SELECT o_orderkey AS id, min(o_orderkey) OVER (PARTITION BY o_custkey) AS component FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE n > 1")
def graph_components(t: Tables) -> DataFrame:
    return graph.components(_chains(t))


def _rank_sql(rounds: int, edges: str) -> str:
    steps = [f"WITH e AS MATERIALIZED {edges}, v AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e), o AS (SELECT src, count(*) AS out FROM e GROUP BY src), r0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM v) AS rank FROM v)"]
    for k in range(1, rounds + 1):
        p = f"r{k - 1}"
        steps.append(f"r{k} AS MATERIALIZED (SELECT v.id, 0.15::DOUBLE / (SELECT count(*) FROM v) + 0.85 * (coalesce(f.flow, 0) + (SELECT coalesce(sum(rank), 0) FROM {p} WHERE id NOT IN (SELECT src FROM o)) / (SELECT count(*) FROM v)) AS rank FROM v LEFT JOIN (SELECT e.dst AS id, sum(p.rank / o.out) AS flow FROM {p} p JOIN e ON p.id = e.src JOIN o ON o.src = e.src GROUP BY e.dst) f ON f.id = v.id)")
    return ", ".join(steps) + f" SELECT id, round(rank, 9) AS rank FROM r{rounds}"


@query(_rank_sql(6, _TRADE))
def graph_pagerank(t: Tables) -> DataFrame:
    return graph.pagerank(_trade(t), 6).select("id", F.round("rank", 9).alias("rank"))


_TRADE_BOTH = f"e AS MATERIALIZED {_TRADE}, b AS MATERIALIZED (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)"


def _label_sql(rounds: int) -> str:
    steps = [f"WITH {_TRADE_BOTH}, l0 AS (SELECT DISTINCT src AS id, src AS label FROM b)"]
    for k in range(1, rounds + 1):
        steps.append(f"l{k} AS MATERIALIZED (SELECT id, arg_min(label, (-n, label)) AS label FROM (SELECT b.src AS id, l.label, count(*) AS n FROM b JOIN l{k - 1} l ON l.id = b.dst GROUP BY ALL) GROUP BY id)")
    return ", ".join(steps) + f" SELECT id, label FROM l{rounds}"


@query(_label_sql(5))
def graph_label_propagation(t: Tables) -> DataFrame:
    return graph.label_propagation(_trade(t), 5)


@query()
def graph_k_core(t: Tables) -> DataFrame:
    return graph.k_core(_trade(t), 12)


# --- knowledge graphs --------------------------------------------------------------------------------------------------

_NORM = "lower(trim(regexp_replace(name, '\\s+', ' ', 'g')))"


@query(f"""SELECT {_NORM} AS norm, arg_min(name, vertex_id) AS name, arg_min(definition, (-coalesce(length(definition), -1), vertex_id)) AS definition, arg_min(entity_type, vertex_id) FILTER (trim(entity_type) <> '') AS type, count(*) AS mentions
FROM entity_graph GROUP BY 1""")
def kg_merge_entities(t: Tables) -> DataFrame:
    rows = t.entity_graph.select(F.col("vertex_id").alias("ord"), F.lit(0).alias("pos"), "name", F.col("entity_type").alias("type"), "definition", F.lit("c").alias("chunk_id"))
    return knowledge.merge_entities(rows).drop("chunks")


@query("""WITH c AS (SELECT doc_id, blob_key, row_number() OVER (PARTITION BY blob_key ORDER BY doc_id) - 1 AS n FROM documents)
SELECT 'contains_chunk' AS label, blob_key AS src, doc_id::VARCHAR AS dst FROM c UNION ALL SELECT 'next_chunk', a.doc_id::VARCHAR, b.doc_id::VARCHAR FROM c a JOIN c b ON a.blob_key = b.blob_key AND b.n = a.n + 1""")
def kg_document_graph(t: Tables) -> DataFrame:
    chunks = t.documents.select(F.col("doc_id").cast("string").alias("id"), F.col("blob_key").alias("document"), F.col("doc_id").alias("chunk_index"))
    return knowledge.document_graph(chunks)[1].select("label", "src", "dst")


@query("SELECT doc_id::VARCHAR AS id, substr(sha1(text), 1, 16) AS hash FROM documents WHERE text IS NOT NULL AND (n_chars >= 1000 OR source IS NULL)")
def kg_changed_chunks(t: Tables) -> DataFrame:
    chunks = t.documents.where("text is not null").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"), "n_chars", "source")
    before = chunks.where("n_chars < 1000 and source is not null").select("id", F.substr(F.sha1(F.col("content").cast("binary")), F.lit(1), F.lit(16)).alias("hash"))
    return knowledge.changed_chunks(chunks, before).select("id", "hash")


_VERB_OF = (("person", "works_at"), ("organization", "located_in"), ("event", "causes"), ("concept", "part_of"))


@query("WITH k AS (SELECT vertex_id AS id, lower(entity_type) AS kind FROM entity_graph), r (verb, s, t) AS (VALUES " + ", ".join(f"('{v}','{s}','{t}')" for v, own in knowledge.VERB_PAIRS.items() for s, t in own) + "), p AS (SELECT e.src, e.dst, a.kind AS sk, b.kind AS tk, CASE " + " ".join(f"WHEN a.kind = '{k}' THEN '{v}'" for k, v in _VERB_OF) + """ ELSE 'knows' END AS type FROM (SELECT DISTINCT a.id AS src, b.id AS dst FROM (SELECT DISTINCT vertex_id AS id, unnest(source_chunk) AS c FROM entity_graph) a JOIN (SELECT DISTINCT vertex_id AS id, unnest(source_chunk) AS c FROM entity_graph) b ON a.c = b.c AND a.id < b.id) e JOIN k a ON a.id = e.src JOIN k b ON b.id = e.dst),
j AS (SELECT *, type IN (SELECT verb FROM r) AND sk IN (SELECT s FROM r UNION SELECT t FROM r) AND tk IN (SELECT s FROM r UNION SELECT t FROM r) AND NOT EXISTS (SELECT 1 FROM r WHERE verb = type AND (s = '*' OR s = sk) AND (t = '*' OR t = tk)) AS bad FROM p)
SELECT src AS source, dst AS target, CASE WHEN bad THEN 'related_to' ELSE type END AS type, CASE WHEN bad THEN type END AS original_type, CASE WHEN bad THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM j""")
def kg_validate_relations(t: Tables) -> DataFrame:
    """Entities of one chunk, joined by the verb their first one's type suggests."""
    kinds = t.entity_graph.select(F.col("vertex_id").alias("id"), F.col("entity_type").alias("type")).distinct()
    verb = exprs.case_map(F.lower("type"), dict(_VERB_OF), "knows")
    related = _together(t).join(kinds.select(F.col("id").alias("src"), verb.alias("verb")), "src").select(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("verb").alias("type"))
    return knowledge.validate_relations(related, kinds)


@query("SELECT CASE WHEN regexp_matches(lower(entity_type), 'person|people') THEN 'Person' WHEN regexp_matches(lower(entity_type), 'org|company') THEN 'Organization' WHEN regexp_matches(lower(entity_type), 'place|location') THEN 'Place' ELSE 'Entity' END AS label, count(*) AS n FROM entity_graph GROUP BY 1")
def kg_route_types(t: Tables) -> DataFrame:
    rules = [("person|people", "Person"), ("org|company", "Organization"), ("place|location", "Place")]
    return t.entity_graph.groupBy(knowledge.route(F.col("entity_type"), rules, "Entity").alias("label")).agg(F.count("*").alias("n"))


@query("SELECT coalesce(entity_type, 'none') AS type, count(*) AS n FROM concept_graph GROUP BY 1")
def kg_type_counts(t: Tables) -> DataFrame:
    return t.concept_graph.groupBy(F.coalesce("entity_type", F.lit("none")).alias("type")).agg(F.count("*").alias("n"))


_MENTION = "(SELECT DISTINCT vertex_id AS id, unnest(source_chunk) AS chunk_id FROM entity_graph)"
_TOGETHER = f"SELECT DISTINCT a.id AS src, b.id AS dst FROM {_MENTION} a JOIN {_MENTION} b ON a.chunk_id = b.chunk_id AND a.id < b.id"


def _mentions(t: Tables) -> DataFrame:
    return t.entity_graph.select(F.col("vertex_id").alias("id"), F.explode("source_chunk").alias("chunk_id")).distinct()


def _together(t: Tables) -> DataFrame:
    m = _mentions(t)
    return m.select(F.col("id").alias("src"), "chunk_id").join(m.select(F.col("id").alias("dst"), "chunk_id"), "chunk_id").where("src < dst").select("src", "dst").distinct()


@query(_TOGETHER)
def kg_cooccurrence(t: Tables) -> DataFrame:
    return _together(t)


def _hub(t: Tables) -> tuple[int, int]:
    """The entity with most neighbours, and one farthest from it within five steps; the lesser id of equals."""
    edges = _together(t)
    hub = graph.degrees(edges).orderBy(F.desc("degree"), "id").first()["id"]
    far = graph.neighbours(edges, t.spark.createDataFrame([(hub,)], "id bigint"), 5).orderBy(F.desc("depth"), "id").first()["id"]
    return hub, far


def _joined(path: str) -> Column:
    return F.array_join(F.col(path).cast("array<string>"), ">").alias("path")


_LINKED = f"e AS MATERIALIZED ({_TOGETHER}), b AS MATERIALIZED (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)"
_HUB = f"WITH RECURSIVE {_LINKED}, hub AS MATERIALIZED (SELECT src AS id FROM b GROUP BY src ORDER BY count(*) DESC, src LIMIT 1)"
_FAR = """, reach AS (SELECT id, 0 AS depth FROM hub UNION SELECT b.dst, r.depth + 1 FROM reach r JOIN b ON b.src = r.id WHERE r.depth < 5), near AS MATERIALIZED (SELECT id, min(depth) AS depth FROM reach GROUP BY id),
far AS MATERIALIZED (SELECT id FROM near ORDER BY depth DESC, id LIMIT 1)"""
_PATHS = ", walk AS (SELECT 0 AS depth, id AS node, [id] AS path FROM hub UNION ALL SELECT w.depth + 1, b.dst, list_append(w.path, b.dst) FROM walk w JOIN b ON b.src = w.node WHERE w.depth < 5 AND NOT list_contains(w.path, b.dst))"


@query(_HUB + _PATHS + " SELECT depth, node::VARCHAR AS node, array_to_string(path, '>') AS path FROM walk WHERE depth <= 3")
def graph_sql_paths(t: Tables) -> DataFrame:
    edges = _together(t)
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return SqlService(t.spark).paths(both, str(_hub(t)[0]), 3).select("depth", "node", F.array_join("path", ">").alias("path"))


@query(_HUB + _PATHS + " SELECT depth, array_to_string(path, '>') AS path FROM walk")
def graph_simple_paths(t: Tables) -> DataFrame:
    return graph.simple_paths(_together(t), _hub(t)[0], 5, direction="both").select("depth", _joined("path"))


@query(_HUB + _FAR + _PATHS + " SELECT array_to_string(path, '>') AS path FROM walk WHERE node = (SELECT id FROM far) AND depth = (SELECT depth FROM near WHERE id = (SELECT id FROM far))")
def graph_all_shortest(t: Tables) -> DataFrame:
    return graph.all_shortest_paths(_together(t), *_hub(t), direction="both", depth=5).select(_joined("path"))


@query(_HUB + f""", w AS MATERIALIZED (SELECT a.id AS src, c.id AS dst, count(*)::DOUBLE AS w FROM {_MENTION} a JOIN {_MENTION} c ON a.chunk_id = c.chunk_id AND a.id <> c.id GROUP BY ALL),
best AS (SELECT id, 0::DOUBLE AS distance FROM hub UNION SELECT w.dst, r.distance + w.w FROM best r JOIN w ON w.src = r.id WHERE r.distance < 200) SELECT id, min(distance) AS distance FROM best GROUP BY id""")
def graph_weighted_shortest(t: Tables) -> DataFrame:
    """Weights are the numbers of chunks that two entities share."""
    m = _mentions(t)
    edges = m.select(F.col("id").alias("src"), "chunk_id").join(m.select(F.col("id").alias("dst"), "chunk_id"), "chunk_id").where("src < dst").groupBy("src", "dst").agg(F.count("*").alias("w"))
    return graph.shortest_distances(edges, t.spark.createDataFrame([(_hub(t)[0],)], "id bigint"), "w", "both").select("id", "distance")


@query(_HUB + _PATHS + " SELECT array_to_string(path, '>') AS path, depth + 1 AS depth FROM walk WHERE depth BETWEEN 1 AND 4 AND node IN (SELECT src FROM b WHERE dst = (SELECT id FROM hub))")
def graph_rings(t: Tables) -> DataFrame:
    return graph.rings(_together(t), _hub(t)[0], 5, "both").select(_joined("path"), "depth")


@query(_HUB + _PATHS + " SELECT array_to_string(path, '>') AS path FROM walk WHERE depth > 0 AND path NOT IN (SELECT path[:-2] FROM walk WHERE depth > 1)")
def graph_rays(t: Tables) -> DataFrame:
    return graph.rays(_together(t), _hub(t)[0], 5, "both").select(_joined("path"))


@query(_HUB + _FAR + """, back AS (SELECT id, 0 AS depth FROM far UNION SELECT b.dst, r.depth + 1 FROM back r JOIN b ON b.src = r.id WHERE r.depth < 3)
SELECT DISTINCT back.id FROM back JOIN near USING (id) WHERE near.depth <= 3 AND id <> (SELECT id FROM hub) AND id <> (SELECT id FROM far)""")
def graph_crosspoints(t: Tables) -> DataFrame:
    return graph.crosspoints(_together(t), *_hub(t), 3, "both")


@query(f"WITH {_LINKED} SELECT x.src AS id, count(*) AS triangles FROM b x JOIN b y ON x.src = y.src AND x.dst < y.dst JOIN b z ON z.src = x.dst AND z.dst = y.dst GROUP BY x.src")
def graph_triangles(t: Tables) -> DataFrame:
    return graph.triangles(_together(t))


#: All pairs of a component with their distance, and the number of shortest ways between them.
_ALL = f"WITH RECURSIVE {_LINKED}, r AS (SELECT DISTINCT src AS s, src AS t, 0 AS d FROM b UNION SELECT r.s, b.dst, r.d + 1 FROM r JOIN b ON b.src = r.t WHERE r.d < 20), far AS MATERIALIZED (SELECT s, t, min(d) AS d FROM r GROUP BY s, t)"


@query(_ALL + " SELECT s AS id, round(count(*) / sum(d), 6)::DOUBLE AS closeness FROM far WHERE d > 0 GROUP BY s")
def graph_closeness(t: Tables) -> DataFrame:
    return graph.closeness(_together(t))


@query(_ALL + """, walk AS (SELECT s, s AS t, 0 AS d FROM far WHERE d = 0 UNION ALL SELECT w.s, b.dst, w.d + 1 FROM walk w JOIN b ON b.src = w.t JOIN far f ON f.s = w.s AND f.t = b.dst AND f.d = w.d + 1),
g AS MATERIALIZED (SELECT s, t, d, count(*) AS n FROM walk GROUP BY s, t, d)
SELECT v.s AS id, round(coalesce(sum(x.n::DOUBLE * y.n / z.n), 0) / 2, 6) AS betweenness FROM (SELECT DISTINCT s FROM g) v LEFT JOIN (g x JOIN g y ON x.t = y.s AND x.d > 0 AND y.d > 0 JOIN g z ON z.s = x.s AND z.t = y.t AND z.d = x.d + y.d) ON x.t = v.s GROUP BY v.s""")
def graph_betweenness(t: Tables) -> DataFrame:
    return graph.betweenness(_together(t))


@query()
def graph_louvain(t: Tables) -> DataFrame:
    return graph.louvain(_together(t), rounds=4)


@query(f"""WITH e AS ({_TOGETHER}), v AS (SELECT DISTINCT vertex_id AS id FROM entity_graph), l AS (SELECT src AS id FROM e UNION SELECT dst FROM e)
SELECT (SELECT count(*) FROM v) AS vertices, (SELECT count(*) FROM e) AS edges, round((SELECT count(*) FROM v WHERE id NOT IN (SELECT id FROM l))::DOUBLE / (SELECT count(*) FROM v), 6) AS orphan_rate, round(2.0 * (SELECT count(*) FROM e) / (SELECT count(*) FROM v), 6)::DOUBLE AS avg_degree""")
def kg_quality(t: Tables) -> DataFrame:
    return knowledge.graph_quality(t.entity_graph.select(F.col("vertex_id").alias("id")), _together(t))


@query(f"WITH e AS ({_TOGETHER}), n AS (SELECT src AS id, 0 AS way, dst AS other FROM e UNION ALL SELECT dst, 1, src FROM e) SELECT id, way, other, place FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY way, other) AS place FROM n) WHERE place <= 6")
def kg_neighbour_context(t: Tables) -> DataFrame:
    anchors = t.entity_graph.select(F.col("vertex_id").alias("id"))
    return knowledge.neighbour_context(anchors, _together(t).withColumn("label", F.lit("together"))).select("id", "way", "other", "place")


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 5) AS cosine FROM e a JOIN e b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.95""")
def kg_similar_entities(t: Tables) -> DataFrame:
    found = knowledge.similar_entities(t.embeddings.select(F.col("vec_id").alias("norm"), "embedding"), least=0.95)
    return found.select("a", "b", F.round("cosine", 5).alias("cosine"))


@query()
def kg_find_entities(t: Tables) -> DataFrame:
    return knowledge.find_entities(t.entity_graph.select("name").distinct(), "Which office handles the checksum scans?", limit=20)


@query()
def kg_resolved(t: Tables) -> DataFrame:
    """Names of the same letters: merged through components, the longest spelling stands for all."""
    names = t.entity_graph.select(exprs.normalized_name(F.col("name")).alias("norm")).distinct()
    letters = F.array_join(F.array_sort(F.split(F.regexp_replace("norm", r"[^\p{L}]", ""), "")), "")
    keyed = names.withColumn("letters", letters)
    first = keyed.groupBy("letters").agg(F.min("norm").alias("src"))  # each name is linked to the first of its letters, not to all
    return knowledge.canonical_names(names, graph.components(keyed.join(first, "letters").select("src", F.col("norm").alias("dst"))))


@query("""WITH r AS (SELECT DISTINCT unnest(source_chunk) AS src, vertex_id AS dst FROM entity_graph) SELECT src, dst, 'references' AS label FROM r WHERE src IS NOT NULL""")
def kg_references(t: Tables) -> DataFrame:
    return knowledge.reference_edges(_mentions(t))


_KINDS = (("person|people", "Person"), ("org|company", "Organization"), ("place|location", "Place"))


@query("""SELECT label, count(DISTINCT norm) AS n FROM (SELECT lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) AS norm, lower(entity_type) AS k FROM entity_graph WHERE name IS NOT NULL), (VALUES ('Entity', ''), ('Person', 'person|people'), ('Organization', 'org|company'), ('Place', 'place|location')) AS l (label, p)
WHERE p = '' OR regexp_matches(coalesce(k, ''), p) AND NOT (label = 'Organization' AND regexp_matches(k, 'person|people')) AND NOT (label = 'Place' AND regexp_matches(k, 'person|people|org|company')) GROUP BY label""")
def kg_typed_vertices(t: Tables) -> DataFrame:
    named = t.entity_graph.where("name is not null").select(exprs.normalized_name(F.col("name")).alias("norm"), F.col("entity_type").alias("type"), F.col("source_chunk").alias("chunks"))
    none = t.spark.createDataFrame([], "source string, target string, type string")
    return knowledge.typed_graph(named, none, _KINDS, ())[0].groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS chunk_index FROM documents")
def kg_chunks_numbered(t: Tables) -> DataFrame:
    return knowledge.normalize_chunks(t.documents.select(F.col("text").alias("text_content"), F.col("doc_id").alias("id"), "doc_id"), "documents", ["doc_id"]).select(F.col("id").cast("bigint").alias("doc_id"), "chunk_index")
