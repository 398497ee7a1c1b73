"""Problem 3: cut oversized texts at natural boundaries, by bounded-quantifier regular expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.config import with_settings

#: White space of this project's texts, and what divides paragraphs.
SPACE = r" \t\n\x0B\f\r"
BLANK = rf"\n[{SPACE}]*\n"


def stripped(text: Column) -> Column:
    """``text`` without white space at both ends."""
    return F.regexp_replace(text, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def extraction(limit: Column) -> Column:
    """The pattern whose successive matches are the pieces of a text.

    Alternatives stand in the order of boundary strength: the whole rest, a paragraph, a sentence, a line, a clause,
    a word. Each takes as many characters as it can, at most ``limit``, and at least a quarter of it, so that a
    strong boundary right at the start makes no tiny piece. The last alternative takes ``limit`` characters of a
    stretch with no place to cut. Every character belongs to one match: the pieces joined are the text.
    """
    least = F.greatest(F.lit(1), F.floor(limit / 4)).cast("int").cast("string")
    most = limit.cast("string")
    ends = [
        rf"(?={BLANK})",
        r"(?:(?<=[.!?…][\"”’»)\]]?)(?=\s)|(?<=[。！？][”’」』）]?))",
        r"(?=\n)",
        r"(?:(?<=[,;:])(?=\s)|(?<=[，；：、]))",
        r"(?=[ \t])",
    ]
    parts: list[Column] = [F.lit(r"[\s\S]{1,"), most, F.lit(r"}\z")]
    for end in ends:
        parts += [F.lit(r"|[\s\S]{"), least, F.lit(","), most, F.lit("}" + end)]
    parts += [F.lit(r"|[\s\S]{1,"), most, F.lit("}")]
    return F.concat(*parts)


def _pieces(text: Column, limit: Column) -> Column:
    return F.regexp_extract_all(text, extraction(limit), F.lit(0))


def _is_cut(text: Column, limit: Column) -> Column:
    """Whether a text gives more than one piece: its first ``limit`` characters are followed by another."""
    return F.regexp_like(text, F.concat(F.lit(r"\A[\s\S]{"), limit.cast("string"), F.lit(r"}[\s\S]")))


def _oversized(records: DataFrame, config: DataFrame) -> DataFrame:
    sized = with_settings(records.select("id", "source", "text_content"), config, "chunk_size", "chunk_overlap")
    limit = F.greatest(F.col("cfg_chunk_size"), F.lit(1))
    texts = sized.select("id", stripped(F.col("text_content")).alias("text"), limit.alias("size"), F.greatest("cfg_chunk_overlap", F.lit(0)).alias("overlap"))
    # char_length before the regular expression: most texts fit, and it is cheap
    cut = texts.where((F.char_length("text") > F.col("size")) & _is_cut(F.col("text"), F.col("size")))
    return cut.groupBy("id").agg(F.max(F.struct("text", "size", "overlap")).alias("r")).select("id", "r.*")


def find_oversized(records: DataFrame, config: DataFrame) -> DataFrame:
    """Which texts and which of their paragraphs have to be cut: ``id``, ``para_no`` (0: the text as a whole).

    A null, empty or short text gives no row; rows of one id delivered twice count once.
    """
    paras = F.filter(F.transform(F.split("text", BLANK), stripped), lambda p: p != "")
    numbered = F.transform(paras, lambda p, i: F.struct((i + 1).cast("bigint").alias("para_no"), _is_cut(p, F.col("size")).alias("cut")))
    hit = F.concat(F.array(F.lit(0).cast("bigint")), F.filter(numbered, lambda p: p["cut"])["para_no"])
    return _oversized(records, config).select("id", F.explode(hit).alias("para_no"))


def split_oversized(records: DataFrame, config: DataFrame) -> DataFrame:
    """Cut every text longer than its source's ``chunk_size`` into pieces no longer than that.

    Returns ``id``, ``piece_no`` (from 1), ``overlap_chars`` and ``piece``. Each piece after the first begins with
    about ``chunk_overlap`` characters of the one before, from a word's start where there is one; without those
    ``overlap_chars`` the pieces joined are the text as stripped. An overlap of half the size or more counts as just
    under half. Null and empty texts, and texts within the limit, give no rows.
    """
    cut = _oversized(records, config)
    back = F.least(F.col("overlap"), F.floor((F.col("size") - 1) / 2)).cast("int")
    cut = cut.select("id", back.alias("back"), _pieces(F.col("text"), F.col("size") - back).alias("own"))
    # the lookback: the last characters of the piece before, from the first word that starts within them
    last = lambda p: F.substr(p, F.greatest(F.char_length(p) - F.col("back") + 1, F.lit(1)), F.col("back"))
    looked = F.transform("own", lambda p: F.regexp_replace(last(p), r"\A\S{0,40}\s+(?=\S)", ""))
    cut = cut.withColumn("looked", F.concat(F.array(F.lit("")), looked))
    each = F.transform("own", lambda p, i: F.struct((i + 1).cast("bigint").alias("piece_no"), F.char_length(F.get("looked", i)).cast("bigint").alias("overlap_chars"), F.concat(F.get("looked", i), p).alias("piece")))
    return cut.select("id", F.explode(each).alias("p")).select("id", "p.*")
