"""Chunks of documents: by page, paragraph, sentence packing or word windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.exprs import sentences


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")


def word_windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of ``size // 4`` words, each beginning ``max(1, overlap // 4)`` words before the end of the one before."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    width, back = max(size // 4, 1), max(1, overlap // 4)
    if back >= width:
        raise ValueError("the overlap must be smaller than the size")
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - back - 1, F.lit(0)), F.lit(width - back))
    return F.when(F.size(words) > 0, F.transform(starts, lambda s: F.array_join(F.slice(words, s + 1, F.lit(width)), " "))).otherwise(F.array().cast("array<string>"))


def packed(parts: Column, size: int, overlap: int = 0) -> Column:
    """Neighbouring parts joined by spaces while they fit into ``size`` characters; each piece begins with the last
    ``overlap`` characters of the one before. A part longer than that is a piece of its own."""
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the size")
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(state: Column, part: Column) -> Column:
        joined = F.when(state["open"] == "", part).otherwise(F.concat(state["open"], F.lit(" "), part))
        tail = F.right(state["open"], F.lit(overlap)) if overlap else F.lit("")
        again = F.when(tail == "", part).otherwise(F.concat(tail, F.lit(" "), part))
        fits = (F.char_length(joined) <= size) | (state["open"] == "")
        return F.struct(F.when(fits, state["done"]).otherwise(F.array_append(state["done"], state["open"])).alias("done"), F.when(fits, joined).otherwise(again).alias("open"))

    return F.aggregate(parts, zero, add, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.array_append(s["done"], s["open"])))


def recursive(text: Column, size: int = 512, overlap: int = 64) -> Column:
    """Sentences packed to ``size``; a text that is one long sentence is cut into word windows."""
    parts = sentences(text)
    return F.when((F.size(parts) <= 1) & (F.char_length(text) > size), word_windows(text, size, overlap)).otherwise(packed(parts, size, overlap))


STRATEGIES = {"page": lambda t, size, overlap: F.array(F.trim(t)), "paragraph": lambda t, size, overlap: paragraphs(t), "recursive": recursive, "words": word_windows}


def chunk(pages: DataFrame, strategy: str = "recursive", size: int = 512, overlap: int = 64, document: str = "doc_id", page: str = "page_number", text: str = "text") -> DataFrame:
    """``document``, ``page``, ``chunk_index`` (from 0 over all of a document's pages), ``text``; blank pieces are left out.

    Strategies that need a library that isn't there fall back to ``recursive``.
    """
    cut = STRATEGIES.get(strategy, recursive)(F.col(text), size, overlap)
    pieces = pages.select(document, page, F.posexplode(cut).alias("pos", "piece")).where(F.trim("piece") != "")
    index = F.row_number().over(Window.partitionBy(document).orderBy(page, "pos")) - 1
    return pieces.select(document, page, index.cast("bigint").alias("chunk_index"), F.col("piece").alias("text"))
