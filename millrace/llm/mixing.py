"""Problem 8: combine documents by source to target shares of the tokens, by systematic sampling."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.session import materialize

#: How the byte-level vocabulary splits a text before it merges bytes.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def token_counter(vocabulary: str = VOCABULARY):  # noqa: ANN201
    """A column function: tokens of a text under a public byte-level vocabulary (a file of base64 words and ranks)."""

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            yield pd.Series([len(encoding.encode_ordinary(t)) if isinstance(t, str) else 0 for t in batch], dtype="int64")

    return count


def source_key(source: Column) -> Column:
    """A source's name however it is written: lower case, no space around it, one underscore between words."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s_-]+", "_")


def measured(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id``, ``source_name``, ``n_tokens`` of the documents of the sources with a target, as a table of its own.

    Tokens are counted once; everything after reads this narrow table.
    """
    named = documents.select("doc_id", source_key(F.col("source")).alias("source_name"), "text")
    wanted = targets.select(source_key(F.col("source_name")).alias("source_name")).distinct()
    counted = named.join(wanted, "source_name", "left_semi").select("doc_id", "source_name", token_counter(vocabulary)("text").alias("n_tokens"))
    return materialize(counted.where("n_tokens > 0"), "tokens")


def _rates(sizes: DataFrame, targets: DataFrame, total: int | None) -> DataFrame:
    """Per source its target, its size, and how many copies of each document are expected.

    Without a ``total``, it is the largest for which every source that has documents can give its share.
    """
    wanted = targets.groupBy(source_key(F.col("source_name")).alias("source_name")).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    own = sizes.groupBy("source_name").agg(F.sum("n_tokens").alias("size"), F.count("*").alias("documents"))
    both = wanted.join(own, "source_name", "left")
    most = F.when(F.col("target_share") > 0, F.col("max_repeats") * F.col("size") / F.col("target_share"))
    total_column = F.lit(float(total)) if total is not None else F.min(most).over(Window.partitionBy())  # one row per target
    rated = both.withColumn("total", total_column)
    rate = F.least(F.col("max_repeats").cast("double"), F.col("target_share") * F.col("total") / F.col("size"))
    return rated.withColumn("rate", F.when(F.col("size") > 0, rate))


#: Documents of a source stand in the order of their size, so that every stretch of it is drawn from alike.
SALTS = 64


def plan(sizes: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 11) -> DataFrame:
    """How often each document goes into the mix: ``doc_id``, ``source_name``, ``n_tokens``, ``copies`` (0 rows left out).

    Every document of a source expects the same number of copies, ``rate``. The expectations are summed up along the
    source in the order of size, from one random offset, and a document comes out once for each integer its stretch of
    the sum crosses: ``floor(rate)`` or one more times, never more than ``max_repeats``.
    No source is ordered as a whole: it is cut into cells by size and a salt, of which only the counts are summed.
    Null, empty and unlisted sources and texts without tokens stay out; a target without documents stays unmet, and
    the others keep their shares of ``total``.
    """
    step = F.floor(F.log2(F.col("n_tokens") + 1) * 16).cast("int")
    cells = sizes.withColumn("step", step).withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(SALTS)))
    key = ["source_name", "step", "salt"]
    before = Window.partitionBy("source_name").orderBy("step", "salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.groupBy(*key).count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    rates = _rates(sizes, targets, total).select("source_name", "rate")
    placed = cells.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("n_tokens", "doc_id")))
    placed = placed.join(starts, key).join(rates, "source_name")
    at = F.col("before") + F.col("place")
    offset = F.pmod(F.xxhash64("source_name", F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0
    crossed = F.floor(F.col("rate") * at + offset) - F.floor(F.col("rate") * (at - 1) + offset)
    return placed.select("doc_id", "source_name", "n_tokens", crossed.cast("int").alias("copies")).where("copies > 0")


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, vocabulary: str = VOCABULARY, seed: int = 11) -> DataFrame:
    """The mixed corpus: ``doc_id``, ``source_name``, ``copy_no`` (from 1), ``n_tokens`` and ``text``, a row per copy."""
    drawn = plan(measured(documents, targets, vocabulary), targets, total, seed)
    return drawn.join(documents.select("doc_id", "text"), "doc_id").select("doc_id", "source_name", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"), "n_tokens", "text")


def shares(documents: DataFrame, targets: DataFrame, total: int | None = None, vocabulary: str = VOCABULARY, seed: int = 11) -> DataFrame:
    """What came of each target: its share, the share it got, tokens, documents used and the most copies of one."""
    sizes = measured(documents, targets, vocabulary)
    got = plan(sizes, targets, total, seed).groupBy("source_name").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents_used"), F.sum("copies").alias("copies"), F.max("copies").alias("most_repeats")
    )
    report = _rates(sizes, targets, total).select("source_name", "target_share", "max_repeats", F.round("rate", 6).alias("rate")).join(got, "source_name", "left")
    report = report.fillna(0, ["tokens", "documents_used", "copies", "most_repeats"])
    return report.withColumn("actual_share", F.round(F.coalesce(F.try_divide("tokens", F.sum("tokens").over(Window.partitionBy())), F.lit(0.0)), 6))  # one row per target
