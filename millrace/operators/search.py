"""Retrieval: vectors, full text, fusion of ranked lists, facets."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import exprs
from millrace.operators.guards import Rejected, check_where
from millrace.session import materialize


def check_vector(query: Sequence[float], dimensions: int | None = None) -> list[float]:
    """A query vector's numbers, if it has any and all are finite."""
    found = [float(x) for x in query]
    if not found:
        raise Rejected("an empty query vector")
    if not all(map(math.isfinite, found)):
        raise Rejected("a query vector has finite numbers")
    if dimensions is not None and len(found) != dimensions:
        raise Rejected(f"{len(found)} dimensions, not {dimensions}")
    return found


def vector_search(df: DataFrame, query: Sequence[float], top_k: int = 10, metric: str = "cosine", vector: str = "text_embedding", where: str | None = None, key: str = "id") -> DataFrame:
    """The ``top_k`` nearest rows with ``_distance``, ascending, ties by key; the filter comes first.

    ``cosine`` is 1 less the cosine, ``l2`` the squared distance, ``dot`` 1 less the inner product. Rows whose vector is
    null or of another length take no part. The plan keeps the best k of each task: nothing is sorted as a whole.
    """
    if not 1 <= top_k <= 10_000:
        raise Rejected("top_k is between 1 and 10000")
    numbers = check_vector(query)
    target = F.array(*[F.lit(x) for x in numbers])
    rows = df.where(F.expr(check_where(where))) if where else df
    rows = rows.where(F.size(vector) == len(numbers))
    return rows.withColumn("_distance", exprs.DISTANCES[metric](F.col(vector), target)).where(F.col("_distance").isNotNull() & ~F.isnan("_distance")).orderBy("_distance", key).limit(top_k)


# --- an inverted file of vectors -----------------------------------------------------------------------------------


def partitions_for(rows: int, base: int = 256) -> int:
    """How many lists an index over so many rows has."""
    if rows < 65_536:
        return max(1, min(int(4 * math.sqrt(rows)), base))
    return base if rows < 1_000_000 else min(int(math.sqrt(rows)), 4096)


def probes_for(requested: int | None, most: int, partitions: int) -> int:
    return max(1, min(requested or 20, most, partitions))


def ivf_fit(df: DataFrame, vector: str, partitions: int, sample: int = 20_000, seed: int = 1, key: str = "id") -> np.ndarray:
    """Centroids from a sample of at most about ``sample`` rows, drawn by a hash of the key."""
    share = min(1.0, sample / max(df.count(), 1))
    drawn = df.where((F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20))) & F.col(vector).isNotNull()).select(vector).limit(2 * sample)
    x = np.array([r[0] for r in drawn.toLocalIterator()], dtype=np.float64)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), min(partitions, len(x)), replace=False)]
    for _ in range(10):
        own = (x @ centers.T).argmax(axis=1)
        for c in range(len(centers)):
            if (own == c).any():
                centers[c] = x[own == c].mean(axis=0)
        centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
    return centers


def _nearest(vector: Column, centers: np.ndarray) -> Column:
    """The list of a vector, by batches: the centers, at most 4096 rows of numbers, go along with the function."""

    def own(vectors: pd.Series) -> pd.Series:
        found = np.full(len(vectors), -1, dtype=np.int32)
        good = np.array([v is not None and len(v) == centers.shape[1] for v in vectors], dtype=bool)
        if good.any():
            found[good] = (np.stack(vectors[good].to_numpy()).astype(np.float64) @ centers.T).argmax(axis=1)
        return pd.Series(found)

    own.__annotations__ = {"vectors": pd.Series, "return": pd.Series}
    return F.pandas_udf(own, "int")(vector)


def ivf_build(df: DataFrame, path: str, vector: str, centers: np.ndarray) -> DataFrame:
    """Write the rows partitioned by list, so that a search reads only the folders it probes; the centers stand beside them.

    Rows without a vector of the centers' width are in list -1, which no search probes.
    """
    df.withColumn("list_no", _nearest(F.col(vector), centers)).write.mode("overwrite").partitionBy("list_no").parquet(f"{path}/lists")
    rows = [(k, [float(x) for x in c], vector) for k, c in enumerate(centers)]
    df.sparkSession.createDataFrame(rows, "list_no int, center array<double>, vector string").coalesce(1).write.mode("overwrite").parquet(f"{path}/centers")
    return df.sparkSession.read.parquet(f"{path}/lists")


def ivf_open(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray, str]:
    """(rows by list, centers, vector column) of an index that was built."""
    rows = spark.read.parquet(f"{path}/centers").orderBy("list_no").collect()  # at most 4096
    return spark.read.parquet(f"{path}/lists"), np.array([r.center for r in rows]), rows[0].vector


def ivf_info(spark: SparkSession, path: str) -> DataFrame:
    """What an index holds: ``index_type``, ``vector``, ``dimensions``, ``lists``, ``rows``, ``largest_list``."""
    index, centers, vector = ivf_open(spark, path)
    sizes = index.where("list_no >= 0").groupBy("list_no").agg(F.count("*").alias("n"))
    return sizes.agg(F.lit("IVF_FLAT").alias("index_type"), F.lit(vector).alias("vector"), F.lit(centers.shape[1]).alias("dimensions"), F.lit(len(centers)).alias("lists"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.max("n"), F.lit(0)).alias("largest_list"))


def ivf_drop(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True))


def ivf_search(index: DataFrame, centers: np.ndarray, query: Sequence[float], top_k: int = 10, nprobe: int | None = None, **search: object) -> DataFrame:
    """As :func:`vector_search` over the lists nearest to the query; over all of them the result is exact."""
    q = np.array(check_vector(query))
    order = np.argsort(-(centers @ (q / max(np.linalg.norm(q), 1e-12))))[: probes_for(nprobe, 256, len(centers))]
    return vector_search(index.where(F.col("list_no").isin([int(k) for k in order])), query, top_k, **search).drop("list_no")


# --- full text -------------------------------------------------------------------------------------------------------

K1, B = 1.2, 0.75


def postings(df: DataFrame, text: str = "text_content", key: str = "id", stop: Sequence[str] = (), positions: bool = False) -> DataFrame:
    """``key``, ``term``, ``length``, ``tf``: an index of a text column, a row per term of a text, all of a text in one task.

    Terms in ``stop`` aren't indexed, though they count in a text's length; with ``positions`` there is a list of places
    (from 0), which :func:`phrase_search` needs. A null text and one without terms have no rows; texts of one key count as one.
    """
    own = df.select(key, exprs.terms(F.col(text)).alias("terms"))
    each = own.select(key, F.size("terms").alias("length"), F.posexplode("terms").alias("at", "term"))
    each = each.where(~F.col("term").isin(*stop)) if stop else each
    lists = [F.array_sort(F.collect_list("at")).alias("positions")] if positions else []
    # shuffled by key alone: what is joined and added up by text afterwards needs no further shuffle
    return each.repartition(key).groupBy(key, "term", "length").agg(F.count("*").alias("tf"), *lists)


def asked_terms(query: str, spark: SparkSession) -> list[str]:
    """The distinct terms of a query."""
    return spark.range(1).select(F.array_distinct(exprs.terms(F.lit(query))).alias("t")).first()["t"]


def _part(tf: Column, df: Column, length: Column, docs: Column, mean: Column) -> Column:
    return F.log(1 + (docs - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def bm25(index: DataFrame, query: str, top_k: int | None = 10, offset: int = 0, key: str = "id") -> DataFrame:
    """``key``, ``_score``, descending, ties by key: BM25 over postings. A query without terms finds nothing."""
    if top_k is not None and top_k < 1:
        raise Rejected("top_k is at least 1")
    asked = asked_terms(query, index.sparkSession)
    texts = index.groupBy(key).agg(F.first("length").alias("length"))
    whole = texts.agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))  # one row
    hits = index.where(F.col("term").isin(*asked) if asked else F.lit(False))
    rarity = hits.groupBy("term").agg(F.count("*").alias("df"))  # a row per term of the query
    scored = hits.join(rarity, "term").join(whole)
    part = _part(F.col("tf"), F.col("df"), F.col("length"), F.col("docs"), F.col("mean"))
    found = scored.groupBy(key).agg(F.sum(part).alias("_score")).orderBy(F.desc("_score"), key)
    return found.offset(offset).limit(top_k) if top_k is not None else found


def matches(df: DataFrame, query: str, text: str = "text_content", key: str = "id") -> DataFrame:
    """``key``, ``_score`` of all texts with a term of the query, without an index: BM25 in one pass over the texts.

    A text is cut into terms where it is read; only the numbers of the query's terms in it leave that task, and the
    statistics of the whole table are a few sums. Keys are unique.
    """
    asked = asked_terms(query, df.sparkSession)
    if not asked:
        return df.select(key, F.lit(0.0).alias("_score")).limit(0)
    own = df.select(key, exprs.terms(F.col(text)).alias("terms"))
    # only the terms asked for are counted one by one
    kept = own.select(key, F.size("terms").alias("length"), F.filter("terms", lambda w: w.isin(*asked)).alias("hit"))
    times = lambda q: F.size(F.filter("hit", lambda w: w == F.lit(q)))
    tf = F.array(*[times(q) for q in asked])
    counted = materialize(kept.select(key, "length", F.when(F.size("hit") > 0, tf).alias("tf")), "hits")
    counted = counted.where("length > 0")
    sums = counted.agg(F.count("*").alias("docs"), F.avg("length").alias("mean"), *[F.count_if(F.get("tf", F.lit(k)) > 0).alias(f"d{k}") for k in range(len(asked))])  # one row
    parts = [F.when(F.get("tf", F.lit(k)) > 0, _part(F.get("tf", F.lit(k)), F.col(f"d{k}"), F.col("length"), F.col("docs"), F.col("mean"))).otherwise(0.0) for k in range(len(asked))]
    return counted.where("tf is not null").join(sums).select(key, reduce(lambda a, b: a + b, parts).alias("_score"))


def text_search(df: DataFrame, query: str, top_k: int = 10, text: str = "text_content", where: str | None = None, offset: int = 0, key: str = "id") -> DataFrame:
    """Rows with ``_score``; the statistics are those of the filtered rows."""
    if top_k < 1:
        raise Rejected("top_k is at least 1")
    rows = df.where(F.expr(check_where(where))) if where else df
    best = matches(rows, query, text, key).orderBy(F.desc("_score"), key).offset(offset).limit(top_k)
    return rows.join(best, key)


def phrase_search(index: DataFrame, phrase: str, key: str = "id") -> DataFrame:
    """``key``, ``times``: texts in which the phrase's terms follow each other, by an index with positions."""
    asked = index.sparkSession.range(1).select(exprs.terms(F.lit(phrase)).alias("t")).first()["t"]
    if not asked:
        return index.select(key, F.lit(0).cast("bigint").alias("times")).limit(0)
    at = {q: [k for k, x in enumerate(asked) if x == q] for q in asked}
    shifted = F.explode(F.map_from_entries(F.array(*[F.struct(F.lit(q), F.array(*[F.lit(k) for k in ks])) for q, ks in at.items()]))[F.col("term")])
    starts = index.where(F.col("term").isin(*at)).select(key, "positions", shifted.alias("shift")).select(key, F.explode("positions").alias("p"), "shift")
    begun = starts.groupBy(key, (F.col("p") - F.col("shift")).alias("start")).agg(F.count("*").alias("n")).where((F.col("n") == len(asked)) & (F.col("start") >= 0))
    return begun.groupBy(key).agg(F.count("*").alias("times"))


# --- fusion -------------------------------------------------------------------------------------------------------------

K_RRF = 60


def ranked(found: DataFrame, score: str, ascending: bool, key: str = "id") -> DataFrame:
    """``key``, ``rank`` from 1. The lists are top-k results: a few rows, in one window."""
    return found.select(key, F.row_number().over(Window.orderBy(F.asc(score) if ascending else F.desc(score), key)).alias("rank"))


def fuse(lists: Sequence[tuple[DataFrame, float]], top_k: int, key: str = "id", score: str = "_rrf_score", k_rrf: int = K_RRF) -> DataFrame:
    """Weighted reciprocal rank fusion: ``key``, score, descending, ties by key."""
    parts = [r.select(F.col(key).cast("string").alias(key), (F.lit(w) / (k_rrf + F.col("rank"))).alias("part")) for r, w in lists]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy(key).agg(F.round(F.sum("part"), 6).alias(score)).orderBy(F.desc(score), key).limit(top_k)


def hybrid_search(df: DataFrame, query: str, vector_query: Sequence[float], top_k: int = 10, vector: str = "text_embedding", text: str = "text_content", where: str | None = None, key: str = "id", k_rrf: int = K_RRF) -> DataFrame:
    """Vector and text search of three times ``top_k`` each, fused; if the plan of one can't be made, the other's result."""
    failed: list[Exception] = []
    lists: list[tuple[DataFrame, float]] = []
    for make in (lambda: ranked(vector_search(df, vector_query, 3 * top_k, vector=vector, where=where, key=key), "_distance", True, key), lambda: ranked(text_search(df, query, 3 * top_k, text, where, key=key), "_score", False, key)):
        try:
            lists.append((make(), 1.0))
        except Rejected as e:
            failed.append(e)
    if not lists:
        raise failed[0]
    found = fuse(lists, top_k, key, k_rrf=k_rrf)
    return df.withColumn(key, F.col(key).cast("string")).join(found, key)


def ensemble_search(df: DataFrame, query: Sequence[float], columns: Mapping[str, float] | None = None, top_k: int = 10, key: str = "id") -> DataFrame:
    """Several vector columns with weights, fused by rank: ``_ensemble_score``, also for a single column.

    Without ``columns``, all array columns whose first vector has the query's length take part.
    """
    if columns is None:
        arrays = [c for c, kind in df.dtypes if kind in ("array<float>", "array<double>")]
        first = df.select(*[F.max(F.size(c)).alias(c) for c in arrays]).first() if arrays else None
        columns = {c: 1.0 for c in arrays if first[c] == len(query)}
    if not columns:
        raise Rejected("no vector column of that length")
    many = 3 if len(columns) > 1 else 1
    lists = [(ranked(vector_search(df, query, many * top_k, vector=c, key=key), "_distance", True, key), w) for c, w in columns.items()]
    return df.withColumn(key, F.col(key).cast("string")).join(fuse(lists, top_k, key, "_ensemble_score"), key)


def reranked(found: DataFrame, scorer: Callable[[Column], Column], text: str, top_k: int, key: str = "id") -> DataFrame:
    """The rows in the order of an injected scorer of their text: ``_rerank_score``."""
    return found.withColumn("_rerank_score", scorer(F.col(text))).orderBy(F.desc("_rerank_score"), key).limit(top_k)


# --- facets ---------------------------------------------------------------------------------------------------------------


def facet_counts(df: DataFrame, facets: Sequence[str], most: int = 100) -> DataFrame:
    """``facet``, ``value``, ``n``: the most frequent values of each facet, in one pass (a grouping set per facet)."""
    counted = df.groupingSets([[f] for f in facets], *facets).agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))
    full = (1 << len(facets)) - 1
    which = F.coalesce(*[F.when(F.col("gid") == full - (1 << (len(facets) - 1 - k)), F.lit(f)) for k, f in enumerate(facets)])
    value = F.coalesce(*[F.when(F.col("gid") == full - (1 << (len(facets) - 1 - k)), F.col(f).cast("string")) for k, f in enumerate(facets)])
    rows = counted.select(which.alias("facet"), value.alias("value"), "n").where("value is not null")
    top = Window.partitionBy("facet").orderBy(F.desc("n"), "value")
    return rows.withColumn("__n", F.row_number().over(top)).where(F.col("__n") <= most).drop("__n")


def faceted_search(df: DataFrame, facets: Sequence[str], query: Sequence[float] | None = None, top_k: int = 10, vector: str = "text_embedding", where: str | None = None, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows, facet counts) under one filter; rows by similarity where there is a query vector, else by key."""
    rows = df.where(F.expr(check_where(where))) if where else df
    found = vector_search(rows, query, top_k, vector=vector, key=key) if query is not None else rows.orderBy(key).limit(top_k)
    return found, facet_counts(rows, facets)


def facet_index_plan(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """How columns are made quick to filter by: few values sort well (``bitmap``), others have bounds (``btree``); missing ones are skipped."""
    kinds = dict(df.dtypes)
    return {c: "skipped" if c not in kinds else "bitmap" if kinds[c] in ("string", "boolean") else "btree" for c in columns}


def write_for_filters(df: DataFrame, path: str, columns: Sequence[str], bloom: Sequence[str] = ()) -> None:
    """A copy sorted within its files by the columns filtered on, so that row groups are skipped; bloom filters on request."""
    writer = df.sortWithinPartitions(*columns).write.mode("overwrite")
    for c in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.parquet(path)


def query_vector(df: DataFrame, vector: str, where: Column) -> list[float]:
    """The vector of a single row, as a query."""
    row = df.where(where).select(vector).first()
    return check_vector(row[0] if row else [])


def cross_modal(spark: SparkSession, text: str, encoder: Callable[[str], Sequence[float]]) -> list[float]:
    """A query vector from an injected encoder."""
    return check_vector(encoder(text))
