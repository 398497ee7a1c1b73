"""The pN_ queries: each problem's operator over its whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import chunking, language, leakage, mixing, names, nearduplicates, neighbours, scans, subjects
from millrace.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.find_noise(table(spark, d, "unified_records"), table(spark, d, "document_config"))


def p1_text(spark: SparkSession, d: str) -> DataFrame:
    return scans.repair(table(spark, d, "unified_records"), table(spark, d, "document_config"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, d, "unified_records"))


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.most_similar(table(spark, d, "unified_records")).select("id", "other", "rank", F.round("cosine", 3).alias("cosine"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return chunking.find_oversized(table(spark, d, "unified_records"), table(spark, d, "document_config"))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunking.split_oversized(table(spark, d, "unified_records"), table(spark, d, "document_config"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return names.linked_pairs(table(spark, d, "entity_graph"), table(spark, d, "concept_graph"))


def p4_entities(spark: SparkSession, d: str) -> DataFrame:
    return names.link_names(table(spark, d, "entity_graph"), table(spark, d, "concept_graph"))


def _subject_model(spark: SparkSession, d: str) -> subjects.Model:
    return subjects.fit(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "subject_areas"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.assign(table(spark, d, "documents"), _subject_model(spark, d))


def p5_composition(spark: SparkSession, d: str) -> DataFrame:
    """The corpus by subject: documents about it and the sum of their shares."""
    found = subjects.shares(table(spark, d, "documents"), _subject_model(spark, d)).where(F.col("share") >= 1 / 3 - 1e-6)
    return found.groupBy("subject_area").agg(F.countDistinct("doc_id").alias("documents"), F.round(F.sum("share"), 3).alias("share"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return nearduplicates.duplicate_pairs(table(spark, d, "unified_records"))


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    return nearduplicates.duplicate_classes(table(spark, d, "unified_records"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return language.relabel(documents, language.fit(documents))


def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return language.segments(documents, language.fit(documents))


def p9_languages(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return language.languages(documents, language.fit(documents))


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit()}
