"""Scalar expressions, all built from Spark's own functions so that they stay inside generated code."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- text -----------------------------------------------------------------------------------------------------------


def replace_first(text: Column, pattern: str, replacement: str) -> Column:
    """Replace the first match only; ``\\1`` in the replacement is the pattern's first group. A null stays null."""
    if len(pattern) > 200:
        raise ValueError("a pattern has at most 200 characters")
    re.compile(pattern)
    java = re.sub(r"\\(\d)", lambda m: f"${int(m[1]) + 1}", replacement.replace("$", r"\$"))
    return F.regexp_replace(text, F.lit(f"(?s)^(.*?)(?:{pattern})"), F.lit("$1" + java))


def split_part(text: Column, separator: str, index: int) -> Column:
    """Part number ``index`` (from 1, negative from the end); empty where there is none, and for index 0."""
    return F.when(text.isNotNull(), F.lit("")) if index == 0 else F.split_part(text, F.lit(separator), F.lit(index))


def normalized_name(name: Column) -> Column:
    """Lower case, no space at the ends, single spaces within."""
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


def artifact_name(name: Column, prefix: str = "kg_", most: int = 48) -> Column:
    """A name for a derived artifact: lower case letters, digits and single underscores."""
    safe = F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9_]+", "_"), r"^_+|_+$", "")
    return F.concat(F.lit(prefix), F.substr(safe, F.lit(1), F.lit(most)))


CJK = r"[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]"


def has_cjk(text: Column) -> Column:
    return F.coalesce(text.rlike(CJK), F.lit(False))


def terms(text: Column) -> Column:
    """Search terms: letters and digits in lower case; a run of CJK characters gives its overlapping pairs."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(w) - 1, F.lit(1))), lambda i: F.substr(w, i, F.lit(2)))
    paired = F.flatten(F.transform(words, lambda w: F.when(w.rlike(CJK), pairs(w)).otherwise(F.array(w))))
    return F.when(text.rlike(CJK), paired).otherwise(words)  # most texts needn't be looked at word by word


def sentences(text: Column) -> Column:
    """Pieces between closing marks followed by white space; of CJK text, after its own marks."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|(?<=[。！？])"), lambda s: F.trim(s)), lambda s: s != "")


def token_estimate(text: Column) -> Column:
    """A rough number of tokens: two for three characters where there is CJK, else one for four."""
    n = F.char_length(text)
    return F.when(text.rlike(CJK), F.floor(n / 1.5)).otherwise(F.floor(n / 4)).cast("bigint")


def citation_refs(text: Column) -> Column:
    """The numbers in square brackets, in order, as integers."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))


#: Phrases that try to change a model's instructions.
INJECTIONS = (r"ignore (?:all |any )?(?:previous|prior|above) instructions", r"disregard (?:all |the )?(?:previous|above)[^.]*", r"you are now [^.]*", r"system prompt", r"</?(?:system|assistant|user)>")


def without_injections(text: Column, marker: str = "[filtered]") -> Column:
    return F.regexp_replace(text, "(?i)" + "|".join(INJECTIONS), marker)


def html_text(html: Column) -> Column:
    """Readable text of markup: without scripts, styles, comments and tags, with the common entities resolved."""
    found = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    found = F.regexp_replace(found, r"(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr)\b[^>]*>", "\n")
    found = F.regexp_replace(found, r"<[^>]+>", " ")
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        found = F.replace(found, F.lit(entity), F.lit(plain))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(found, r"[ \t]+", " "), r"\s*\n\s*", "\n"), r"^\s+|\s+$", "")


# --- numbers and types ------------------------------------------------------------------------------------------------

#: Names of types that a cast may name, and what they are here.
SQL_TYPES = {
    "DOUBLE": "double", "FLOAT": "float", "DECIMAL": "decimal(18,3)", "INTEGER": "int", "BIGINT": "bigint", "SMALLINT": "smallint", "TINYINT": "tinyint",
    "VARCHAR": "string", "TEXT": "string", "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz",
}
ARROW_TYPES = {
    "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)",
    "float32": "float", "float64": "double", "bool": "boolean", "string": "string", "utf8": "string", "date": "date", "timestamp": "timestamp_ntz",
}
_INTEGERS = ("tinyint", "smallint", "int", "bigint")


def cast_sql(value: Column, source: str, target: str) -> Column:
    """Cast as the reference's SQL does: numbers with a fraction are rounded to integers, halves to even.

    ``source`` is the column's Spark type. A text that isn't a number gives null rather than an error.
    """
    to = SQL_TYPES[target.upper()]
    if to in _INTEGERS and source in ("float", "double"):
        return F.rint(value).cast(to)
    if to in _INTEGERS and source == "string":
        return F.rint(value.try_cast("double")).cast(to)
    return value.try_cast(to)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is all zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """The vector at length 1; zeros stay zeros."""
    norm = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))


DISTANCES = {"cosine": lambda a, b: 1 - cosine(a, b), "l2": squared_distance, "dot": lambda a, b: 1 - dot(a, b)}


def histogram_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin from 1; the last bin holds its upper end. All in bin 1 where every value is the same."""
    return F.when(high > low, F.least(F.floor((value - low) / (high - low) * bins) + 1, F.lit(bins))).otherwise(F.when(value.isNotNull(), F.lit(1))).cast("int")


def case_map(value: Column, mapping: Mapping[object, object], default: object = None) -> Column:
    found = None
    for key, result in mapping.items():
        test = value == F.lit(key)
        found = F.when(test, F.lit(result)) if found is None else found.when(test, F.lit(result))
    return F.lit(default) if found is None else found.otherwise(F.lit(default))


# --- hashes and masks ---------------------------------------------------------------------------------------------------


def content_hash(value: Column, digits: int = 64) -> Column:
    return F.substr(F.sha2(value.cast("binary"), 256), F.lit(1), F.lit(digits))


def hmac_sha256(message: Column, key: bytes) -> Column:
    """HMAC of a text in plain expressions: the inner and outer pads are constants."""
    import hashlib

    padded = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ p for b in padded).hex())) for p in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def mask(value: Column, how: str, key: bytes = b"") -> Column:
    """``redact`` every character but line ends, ``partial`` keeps two at each end, ``hash`` is keyed, ``nullify``."""
    text = value.cast("string")
    if how == "redact":
        return F.regexp_replace(text, r"[^\n]", "*")
    if how == "partial":
        n = F.char_length(text)
        return F.when(n <= 4, F.lit("****")).otherwise(F.concat(F.left(text, F.lit(2)), F.repeat(F.lit("*"), n - 4), F.right(text, F.lit(2))))
    if how == "hash":
        return F.substr(hmac_sha256(text, key), F.lit(1), F.lit(32))
    if how == "nullify":
        return F.lit(None).cast("string")
    raise ValueError(f"unknown mask: {how}")


def concat_present(columns: Sequence[Column], separator: str = " ") -> Column:
    return F.concat_ws(separator, *columns)
