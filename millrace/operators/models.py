"""Columns made by models: the model is an injected function over batches, and what it fails on doesn't stop the rest."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import exprs

Encoder = Callable[[list[str]], Sequence[Sequence[float]]]


def hashing_encoder(dimensions: int = 64) -> Encoder:
    """A deterministic encoder for tests: words hashed into signed dimensions."""

    def encode(texts: list[str]) -> list[list[float]]:
        found = np.zeros((len(texts), dimensions))
        for k, text in enumerate(texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                found[k, h % dimensions] += 1 if h >> 32 & 1 else -1
        return found.tolist()

    return encode


def embed(df: DataFrame, text: str, vector: str, load: Callable[[], Encoder], dimensions: int, nulls: str = "null") -> DataFrame:
    """A column of unit vectors; ``load`` runs once per task. Null texts give null, or zeros with ``nulls="zero"``."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for batch in batches:
            given = batch.notna()
            out = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            if given.any():
                x = np.asarray(encode(batch[given].tolist()), dtype=np.float32)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                out[given] = pd.Series(list(x), index=batch.index[given])
            yield out

    # postponed annotations are text; the engine needs the types themselves
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    made = F.pandas_udf(run, "array<float>")
    zero = F.array_repeat(F.lit(0.0).cast("float"), dimensions)
    return df.withColumn(vector, F.coalesce(made(F.col(text)), zero) if nulls == "zero" else made(F.col(text)))


def backfill(df: DataFrame, text: str, vector: str, load: Callable[[], Encoder], dimensions: int) -> DataFrame:
    """Only rows without a vector are encoded."""
    missing = df.where(F.col(vector).isNull() & F.col(text).isNotNull())
    rest = df.where(~(F.col(vector).isNull() & F.col(text).isNotNull()))
    return rest.unionByName(embed(missing.drop(vector), text, vector, load, dimensions).select(*df.columns))


def enrich(df: DataFrame, text: str, column: str, ask: Callable[[str], str], most: int = 5000) -> DataFrame:
    """An injected model's answer per row, empty where it fails; more rows than ``most`` are refused before any is asked."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows")

    def answer(texts: pd.Series) -> pd.Series:
        found = []
        for t in texts:
            try:
                found.append(ask(t) if isinstance(t, str) else "")
            except Exception:
                found.append("")
        return pd.Series(found)

    answer.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return df.withColumn(column, F.pandas_udf(answer, "string")(F.col(text)))


def classify_by_words(text: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str = "general") -> Column:
    """The first label of which a word stands in the text; a model may be asked where the default comes out."""
    found = None
    for label, words in rules:
        test = F.coalesce(text.rlike("(?i)" + "|".join(rf"\b{w}\b" for w in words)), F.lit(False))
        found = F.when(test, label) if found is None else found.when(test, label)
    return F.lit(default) if found is None else found.otherwise(default)


def similarity_to(df: DataFrame, vector: str, query: Sequence[float]) -> DataFrame:
    return df.withColumn("similarity", F.round(exprs.cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query])), 6))
