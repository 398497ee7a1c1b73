"""Building property graphs from documents and extractions, and measuring and searching them."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import exprs
from millrace.session import materialize

# --- extractions -------------------------------------------------------------------------------------------------------

EXTRACTION = "entities array<struct<name:string,type:string,definition:string,confidence:double>>, relations array<struct<source:string,target:string,type:string,confidence:double>>"


#: What an answer that was cut off may lack at its end.
ENDINGS = ("", "}", "]}", "}]}", '"}', '"}]}', '"]}')


def answer_struct(answer: Column, schema: str) -> Column:
    """The JSON object in a model's answer: without thoughts and fences, from its first brace to its last; an answer that was cut off is completed."""
    said = F.regexp_replace(answer, r"(?s)<think.*?</think\s*>|^\s*```[a-z]*\s*|```\s*$", "")
    whole, cut = F.regexp_extract(said, r"(?s)(\{.*\})", 1), F.regexp_extract(said, r"(?s)(\{.*)$", 1)
    names = [c.split()[0] for c in re.split(r",\s*(?![^<]*>)", schema)]
    tried = []
    for text in (whole, *[F.concat(cut, F.lit(end)) for end in ENDINGS]):
        read = F.from_json(text, schema)
        held = F.coalesce(*[read[n].isNotNull() for n in names]) if len(names) == 1 else F.greatest(*[read[n].isNotNull() for n in names])
        tried.append(F.when(held, read))
    return F.coalesce(*tried)


def normalize_chunks(df: DataFrame, dataset: str, order: Sequence[str]) -> DataFrame:
    """``id``, ``document_name``, ``chunk_index``, ``content``: what is missing is made up: the text from ``text_content`` or the first column, an id of
    its content and place, the dataset's name, and numbers in an order."""
    text = "content" if "content" in df.columns else "text_content" if "text_content" in df.columns else df.columns[0]
    content = F.col(f"`{text}`").cast("string")
    place = F.concat_ws("\u0001", *[F.col(f"`{c}`").cast("string") for c in order], content)
    made = df.select(
        (F.col("id").cast("string") if "id" in df.columns else F.substr(F.sha2(place, 256), F.lit(1), F.lit(32))).alias("id"),
        (F.col("document_name") if "document_name" in df.columns else F.lit(dataset)).alias("document_name"),
        (F.col("chunk_index").cast("bigint") if "chunk_index" in df.columns else F.lit(None).cast("bigint")).alias("chunk_index"),
        content.alias("content"), F.struct(*[F.col(f"`{c}`") for c in order]).alias("__order"),
    )
    if "chunk_index" in df.columns:
        return made.drop("__order")
    if "document_name" in df.columns:
        number = F.row_number().over(Window.partitionBy("document_name").orderBy("__order", "id")) - 1
        return made.withColumn("chunk_index", number.cast("bigint")).drop("__order")
    # one document: numbered by ranges, so that no task orders it as a whole
    ranged = materialize(made.repartitionByRange("__order", "id").withColumn("__part", F.spark_partition_id()), "ranged")
    before = ranged.groupBy("__part").agg(F.count("*").alias("n"))
    before = before.withColumn("__before", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")  # a row per range
    number = F.row_number().over(Window.partitionBy("__part").orderBy("__order", "id")) - 1
    return ranged.withColumn("__n", number).join(before, "__part").withColumn("chunk_index", (F.col("__n") + F.col("__before")).cast("bigint")).select("id", "document_name", "chunk_index", "content")


def parse_extractions(chunks: DataFrame, answer: str, least: float = 0.7, stop: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of model answers: the outermost braces are read as JSON, whatever stands around them (:func:`answer_struct`).

    Entities below the confidence (a missing one counts as 1), without a name, of one character or on the stop list are
    dropped, and so are relations without two entities of their chunk.
    """
    read = chunks.select("chunk_id", "ord", answer_struct(F.col(answer), EXTRACTION).alias("x"))
    entities = read.select("chunk_id", "ord", F.posexplode("x.entities").alias("pos", "e")).select("chunk_id", "ord", "pos", "e.*")
    name = F.trim("name")
    entities = entities.where((F.coalesce("confidence", F.lit(1.0)) >= least) & (F.char_length(name) > 1) & ~F.lower(name).isin(*[s.lower() for s in stop])).withColumn("name", name)
    relations = read.select("chunk_id", "ord", F.posexplode("x.relations").alias("pos", "r")).select("chunk_id", "ord", "pos", "r.*").where(F.coalesce("confidence", F.lit(1.0)) >= least)
    known = entities.select("chunk_id", exprs.normalized_name(F.col("name")).alias("norm")).distinct()
    for end in ("source", "target"):
        relations = relations.join(known.select("chunk_id", F.col("norm").alias("__n")), (relations["chunk_id"] == known["chunk_id"]) & (exprs.normalized_name(F.col(end)) == F.col("__n")), "left_semi")
    return entities, relations


def merge_entities(entities: DataFrame, key: Column | None = None) -> DataFrame:
    """One row per name: first display name, longest definition (the first of those), first type that isn't empty, its chunks in order."""
    place = F.struct("ord", "pos")
    norm = key if key is not None else exprs.normalized_name(F.col("name"))
    kind = F.when(F.trim("type") != "", F.col("type"))
    longest = F.min_by("definition", F.struct((-F.coalesce(F.char_length("definition"), F.lit(-1))).alias("n"), place.alias("p")))
    merged = entities.groupBy(norm.alias("norm")).agg(F.min_by("name", place).alias("name"), longest.alias("definition"), F.min_by(kind, F.when(kind.isNotNull(), place)).alias("type"), F.array_sort(F.collect_set(F.struct("ord", "chunk_id"))).alias("c"), F.count("*").alias("mentions"))
    return merged.select("norm", "name", "definition", "type", F.transform("c", lambda x: x["chunk_id"]).alias("chunks"), "mentions")


def merge_relations(relations: DataFrame, canonical: DataFrame | None = None) -> DataFrame:
    """``source``, ``target``, ``type``: names normalised (and mapped to their canonical ones), loops dropped, each once."""
    found = relations.select(exprs.normalized_name(F.col("source")).alias("source"), exprs.normalized_name(F.col("target")).alias("target"), "type")
    if canonical is not None:
        for end in ("source", "target"):
            to = canonical.select(F.col("norm").alias(end), F.col("canonical").alias("__c"))
            found = found.join(to, end, "left").withColumn(end, F.coalesce("__c", end)).drop("__c")
    return found.where("source <> target").distinct()


def similar_entities(entities: DataFrame, vector: str = "embedding", key: str = "norm", least: float = 0.86, recall: float = 0.999, planes: int = 6, seed: int = 3) -> DataFrame:
    """``a`` < ``b``, ``cosine``: pairs of embeddings at least so similar, found in shared buckets of random planes.

    There are as many tables of ``planes`` planes as bring a pair of the least similarity together with a chance of ``recall``. Only keys go
    through the buckets; vectors follow once per pair, and every pair that met is compared. Rows of equal vectors meet as one and
    are paired with the first of them, so that copies give a star and not all pairs.
    """
    width = entities.select(F.size(vector)).where(F.size(vector) > 0).first()
    kind = entities.schema[key].dataType.simpleString()
    if width is None:
        return entities.sparkSession.createDataFrame([], f"a {kind}, b {kind}, cosine double")
    apart = 1 - math.acos(min(least, 1.0)) / math.pi
    tables = math.ceil(math.log(1 - recall) / math.log(1 - min(apart**planes, 1 - 1e-9)))
    rng = np.random.default_rng(seed)
    normals = rng.standard_normal((tables * planes, width[0]))

    def codes(vectors: pd.Series) -> pd.Series:
        x = np.stack(vectors.to_numpy()).astype(np.float64) @ normals.T > 0
        packed = (x.reshape(len(x), tables, planes) * (1 << np.arange(planes))).sum(axis=2) + (np.arange(tables) << planes)
        return pd.Series(list(packed.astype(np.int64)))

    codes.__annotations__ = {"vectors": pd.Series, "return": pd.Series}
    usable = entities.where(F.size(vector) == width[0]).select(F.col(key).alias("k"), F.col(vector).alias("v")).where("k is not null and not exists(v, x -> x is null or isnan(x)) and exists(v, x -> x <> 0)")
    groups = materialize(usable.groupBy(F.xxhash64("v").alias("h")).agg(F.min("k").alias("k"), F.min_by("v", "k").alias("v")), "vectors")
    coded = materialize(groups.select("k", F.explode(F.pandas_udf(codes, "array<bigint>")("v")).alias("code")), "codes")
    met = coded.alias("l").join(coded.alias("r"), F.expr("l.code = r.code and l.k < r.k")).select(F.col("l.k").alias("a"), F.col("r.k").alias("b")).distinct()
    both = met.join(groups.select(F.col("k").alias("a"), F.col("v").alias("va")), "a").join(groups.select(F.col("k").alias("b"), F.col("v").alias("vb")), "b")
    near = both.select("a", "b", F.round(exprs.cosine(F.col("va"), F.col("vb")), 6).alias("cosine")).where(F.col("cosine") >= least)
    copies = usable.select(F.col("k").alias("b"), F.xxhash64("v").alias("h")).join(groups.select("h", F.col("k").alias("a")), "h").where("a < b").select("a", "b", F.lit(1.0).alias("cosine"))
    return near.unionByName(copies.distinct())


def canonical_names(entities: DataFrame, groups: DataFrame, most: int = 40) -> DataFrame:
    """``norm``, ``canonical``: of each group (``id``, ``component``) the longest name, the first of those; larger groups stay apart."""
    sized = groups.join(groups.groupBy("component").agg(F.count("*").alias("n")), "component").where(F.col("n") <= most)
    named = sized.join(entities.select(F.col("norm").alias("id")), "id")
    best = named.groupBy("component").agg(F.min_by("id", F.struct((-F.char_length("id")).alias("n"), "id")).alias("canonical"))
    return named.join(best, "component").select(F.col("id").alias("norm"), "canonical")


# --- structure ---------------------------------------------------------------------------------------------------------------


def document_graph(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of documents and their chunks: ``contains_chunk`` and ``next_chunk``; needs ``id``, ``document``, ``chunk_index``."""
    docs = chunks.select(F.col("document").alias("id")).distinct().withColumn("label", F.lit("document"))
    nodes = docs.unionByName(chunks.select("id").distinct().withColumn("label", F.lit("chunk")))
    following = F.lead("id").over(Window.partitionBy("document").orderBy("chunk_index", "id"))
    contains = chunks.select(F.col("document").alias("src"), F.col("id").alias("dst"), F.lit("contains_chunk").alias("label"))
    after = chunks.select(F.col("id").alias("src"), following.alias("dst"), F.lit("next_chunk").alias("label")).where("dst is not null")
    return nodes, contains.unionByName(after)


def reference_edges(mentions: DataFrame) -> DataFrame:
    """``src``, ``dst``, ``label``: from each chunk (``chunk_id``) to the entities (``id``) it names, once."""
    return mentions.where("chunk_id is not null and id is not null").select(F.col("chunk_id").alias("src"), F.col("id").alias("dst"), F.lit("references").alias("label")).distinct()


def typed_graph(entities: DataFrame, relations: DataFrame, vertex_rules: Sequence[tuple[str, str]], edge_rules: Sequence[tuple[str, str]], generic: str = "Entity") -> tuple[DataFrame, DataFrame]:
    """(vertices, edges), each entity as a generic vertex and, where a rule knows its type, as a typed one too.

    ``entities`` has ``norm``, ``type`` and ``chunks``; ``relations`` ``source``, ``target`` and ``type``. An edge has the label of the first rule that
    fits its type, else ``related_to``; the typed edge joins the typed vertices, and where one end has none it is the generic ``related_to``.
    Vertices of one name and label are one, with the chunks of all.
    """
    label = route(F.coalesce("type", F.lit("")), vertex_rules, generic)
    one = entities.select(F.col("norm").alias("id"), label.alias("label"), F.coalesce("chunks", F.array().cast("array<string>")).alias("chunks"))
    every = one.withColumn("label", F.lit(generic)).unionByName(one.where(F.col("label") != generic))
    nodes = every.groupBy("id", "label").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("chunks")))).alias("chunks"))
    kinds = one.where(F.col("label") != generic).groupBy("id").agg(F.min("label").alias("label"))
    ends = relations.select("source", "target", route(F.coalesce("type", F.lit("")), edge_rules, DEFAULT_VERB).alias("label"))
    found = ends.join(kinds.select(F.col("id").alias("source"), F.col("label").alias("source_label")), "source", "left").join(kinds.select(F.col("id").alias("target"), F.col("label").alias("target_label")), "target", "left")
    typed = F.col("source_label").isNotNull() & F.col("target_label").isNotNull()
    edges = found.select("source", "target", F.when(typed, F.col("label")).otherwise(F.lit(DEFAULT_VERB)).alias("label"), F.when(typed, F.col("source_label")).otherwise(F.lit(generic)).alias("source_label"), F.when(typed, F.col("target_label")).otherwise(F.lit(generic)).alias("target_label"))
    return nodes, edges.distinct()


def changed_chunks(chunks: DataFrame, checkpoint: DataFrame, text: str = "content") -> DataFrame:
    """Chunks whose text isn't the one of the last build, with the ``hash`` to remember."""
    hashed = chunks.withColumn("hash", F.substr(F.sha1(F.col(text).cast("binary")), F.lit(1), F.lit(16)))
    return hashed.join(checkpoint.select("id", "hash"), ["id", "hash"], "left_anti")


#: Verbs with the types they may join; * stands for any type.
VERB_PAIRS = {
    "works_at": (("person", "organization"),), "located_in": (("organization", "location"), ("event", "location"), ("location", "location"), ("person", "location")), "part_of": (("organization", "organization"), ("concept", "concept"), ("location", "location")),
    "causes": (("event", "event"), ("concept", "concept"), ("event", "concept")), "participates_in": (("person", "event"), ("organization", "event")), "produces": (("organization", "concept"), ("person", "concept")), "related_to": (("*", "*"),),
}
DEFAULT_VERB = "related_to"


def validate_relations(relations: DataFrame, types: DataFrame, pairs: Mapping[str, Sequence[tuple[str, str]]] = VERB_PAIRS, mode: str = "degrade") -> DataFrame:
    """Relations whose verb joins the types of its ends; others are dropped or degraded to the default verb at weight 0.4.

    ``types`` has ``id`` and ``type``; verbs and types that aren't known pass. The rules are a small literal table.
    """
    spark = relations.sparkSession
    rules = spark.createDataFrame([(v, s, t) for v, own in pairs.items() for s, t in own], "verb string, s string, t string")
    known = spark.createDataFrame([(x,) for x in sorted({x for own in pairs.values() for p in own for x in p if x != "*"})], "known string")
    kind = types.select("id", F.lower("type").alias("kind"))
    found = relations.join(kind.select(F.col("id").alias("source"), F.col("kind").alias("s_kind")), "source", "left").join(kind.select(F.col("id").alias("target"), F.col("kind").alias("t_kind")), "target", "left")
    legal = rules.select(F.col("verb").alias("type"), "s", "t")
    fits = found.join(legal, "type").where("(s = '*' or s = s_kind) and (t = '*' or t = t_kind)").select("source", "target", "type").distinct().withColumn("__ok", F.lit(True))
    checkable = found.join(rules.select(F.col("verb").alias("type")).distinct(), "type", "left_semi").join(known.select(F.col("known").alias("s_kind")), "s_kind", "left_semi").join(known.select(F.col("known").alias("t_kind")), "t_kind", "left_semi").select("source", "target", "type").distinct().withColumn("__check", F.lit(True))
    judged = found.drop("s_kind", "t_kind").join(fits, ["source", "target", "type"], "left").join(checkable, ["source", "target", "type"], "left")
    bad = F.col("__check").isNotNull() & F.col("__ok").isNull()
    if mode == "drop":
        return judged.where(~bad).select(*relations.columns)
    return judged.select(*[c for c in relations.columns if c != "type"], F.when(bad, F.lit(DEFAULT_VERB)).otherwise(F.col("type")).alias("type"), F.when(bad, F.col("type")).alias("original_type"), F.when(bad, 0.4).otherwise(1.0).alias("weight"))


def route(column: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """A label by the first pattern that a text matches."""
    found = None
    for pattern, label in rules:
        test = F.lower(column).rlike(pattern)
        found = F.when(test, label) if found is None else found.when(test, label)
    return (found if found is not None else F.when(F.lit(False), default)).otherwise(default)


def snap(column: Column, vocabulary: Sequence[str], default: str, least: float = 0.4) -> Column:
    """The vocabulary's closest word by edit distance over length, or the default; a word of the vocabulary stays."""
    word = F.lower(F.trim(column))
    scored = F.array(*[F.struct((1 - F.levenshtein(word, F.lit(v)) / F.greatest(F.char_length(word), F.lit(len(v)))).alias("s"), F.lit(-k).alias("k"), F.lit(v).alias("v")) for k, v in enumerate(vocabulary)])
    best = F.array_max(scored)
    return F.when(best["s"] >= least, best["v"]).otherwise(default)


def link_orphans(vertices: DataFrame, edges: DataFrame, mentions: DataFrame, least: float = 0.75, partners: int = 3, most: int = 500) -> DataFrame:
    """``src``, ``dst``, ``cosine``: vertices without an edge to at most three others that share a chunk with them and are similar.

    ``vertices`` has ``id`` and ``embedding``, ``mentions`` has ``id`` and ``chunk_id``. The total cap is a documented
    feature of the operator: the most similar links come first.
    """
    linked = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    orphans = vertices.join(linked, "id", "left_anti")
    together = mentions.join(orphans.select("id"), "id", "left_semi").select(F.col("id").alias("src"), "chunk_id").join(mentions.select(F.col("id").alias("dst"), "chunk_id"), "chunk_id").where("src <> dst").select("src", "dst").distinct()
    scored = together.join(vertices.select(F.col("id").alias("src"), F.col("embedding").alias("a")), "src").join(vertices.select(F.col("id").alias("dst"), F.col("embedding").alias("b")), "dst")
    near = scored.select("src", "dst", F.round(exprs.cosine(F.col("a"), F.col("b")), 6).alias("cosine")).where(F.col("cosine") >= least)
    best = Window.partitionBy("src").orderBy(F.desc("cosine"), "dst")
    return near.withColumn("__n", F.row_number().over(best)).where(F.col("__n") <= partners).drop("__n").orderBy(F.desc("cosine"), "src", "dst").limit(most)


# --- measures and retrieval ------------------------------------------------------------------------------------------------


def graph_quality(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``vertices``, ``edges``, ``orphan_rate``, ``avg_degree``: one row."""
    linked = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct().withColumn("__l", F.lit(1))
    v = vertices.select("id").distinct().join(linked, "id", "left").agg(F.count("*").alias("vertices"), F.count_if(F.col("__l").isNull()).alias("orphans"))
    return v.join(edges.agg(F.count("*").alias("edges"))).select("vertices", "edges", F.round(F.try_divide("orphans", "vertices"), 6).alias("orphan_rate"), F.round(F.try_divide(2 * F.col("edges"), F.col("vertices")), 6).alias("avg_degree"))


def find_entities(entities: DataFrame, text: str, least: float = 0.6, limit: int = 10) -> DataFrame:
    """Entities named in a question, or else those that share enough of its characters: ``name``, ``match``."""
    asked = sorted(set(re.sub(r"\s+", "", text.lower())))
    chars = F.array_distinct(F.split(F.regexp_replace(F.lower("name"), r"\s+", ""), ""))
    share = F.size(F.array_intersect(chars, F.array(*[F.lit(c) for c in asked]))) / F.greatest(F.size(chars), F.lit(1))
    match = F.when(F.lit(text.lower()).contains(F.lower("name")), 1.0).otherwise(F.when(share >= least, share * 0.9))
    return entities.where(F.char_length("name") > 0).withColumn("match", match).where("match is not null").orderBy(F.desc("match"), "name").limit(limit)


def triplets(anchors: DataFrame, edges: DataFrame, most: int = 50) -> DataFrame:
    """``source``, ``relation``, ``target`` around anchors (column ``id``), both ways."""
    near = edges.join(anchors.select("id").distinct(), (F.col("src") == F.col("id")) | (F.col("dst") == F.col("id")))
    return near.select(F.col("src").alias("source"), F.coalesce("label", F.lit(DEFAULT_VERB)).alias("relation"), F.col("dst").alias("target")).distinct().orderBy("source", "relation", "target").limit(most)


def neighbour_context(anchors: DataFrame, edges: DataFrame, most: int = 6) -> DataFrame:
    """Per anchor (``id``) at most six relations, outgoing first."""
    out = edges.join(anchors.select(F.col("id").alias("src")).distinct(), "src").select(F.col("src").alias("id"), F.lit(0).alias("way"), "label", F.col("dst").alias("other"))
    back = edges.join(anchors.select(F.col("id").alias("dst")).distinct(), "dst").select(F.col("dst").alias("id"), F.lit(1).alias("way"), "label", F.col("src").alias("other"))
    order = Window.partitionBy("id").orderBy("way", "label", "other")
    return out.unionByName(back).distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def to_json(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """A graph as lines of JSON: ``kind``, ``body``."""
    one = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*df.columns)).alias("body"))
    return one(vertices, "vertex").unionByName(one(edges, "edge"))


def from_json(lines: DataFrame, vertex_schema: str, edge_schema: str) -> tuple[DataFrame, DataFrame]:
    read = lambda kind, schema: lines.where(F.col("kind") == kind).select(F.from_json("body", schema).alias("x")).select("x.*")
    return read("vertex", vertex_schema), read("edge", edge_schema)


def upsert_vertices(old: DataFrame, new: DataFrame, keys: Sequence[str], unions: Sequence[str] = ()) -> DataFrame:
    """New vertices replace old ones of the same key; list columns in ``unions`` keep what the old ones had."""
    kept = old.join(new.select(*keys), list(keys), "left_anti")
    before = old.select(*keys, *[F.col(c).alias(f"__{c}") for c in unions])
    merged = new.join(before, list(keys), "left").select(*[F.array_sort(F.array_union(F.coalesce(F.col(c), F.array()), F.coalesce(F.col(f"__{c}"), F.array()))).alias(c) if c in unions else F.col(c) for c in new.columns])
    return kept.unionByName(merged, allowMissingColumns=True)


def answer_json(entities: Sequence[Mapping], relations: Sequence[Mapping]) -> str:
    """An answer as a model would give it, for tests and stubs."""
    return json.dumps({"entities": list(entities), "relations": list(relations)}, ensure_ascii=False)
