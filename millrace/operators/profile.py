"""Statistics of a table: each column's in one pass over the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.exprs import histogram_bin


def _plain(df: DataFrame) -> list[T.StructField]:
    return [f for f in df.schema if isinstance(f.dataType, (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType))]


def summarize(df: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """Per column: type, min, max, approximate number of values, mean, sample deviation, quartiles, count, null share.

    One aggregation over the table; its single row is then turned on its side.
    """
    each = []
    for f in _plain(df):
        number = isinstance(f.dataType, T.NumericType)
        value = F.col(f"`{f.name}`")
        stats = {
            "column_name": F.lit(f.name), "column_type": F.lit(f.dataType.simpleString()), "min": F.min(value).cast("string"), "max": F.max(value).cast("string"), "approx_unique": F.approx_count_distinct(value),
            "mean": F.round(F.avg(value), 4) if number else F.lit(None).cast("double"), "std": F.round(F.stddev_samp(value), 4) if number else F.lit(None).cast("double"),
            "quartiles": F.percentile_approx(value.cast("double"), [0.25, 0.5, 0.75], accuracy) if number else F.lit(None).cast("array<double>"),
            "count": F.count(value), "null_pct": F.round(100.0 * (F.count("*") - F.count(value)) / F.count("*"), 4),
        }
        each.append(F.struct(*[c.alias(k) for k, c in stats.items()]).alias(f"s{len(each)}"))
    row = df.agg(*each)
    return row.select(F.inline(F.array(*[F.col(c) for c in row.columns])))


def profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """Per column: nulls, null share, number of distinct values, min and max."""
    distinct = F.count_distinct if exact else F.approx_count_distinct
    each = []
    for f in _plain(df):
        value = F.col(f"`{f.name}`")
        each.append(F.struct(F.lit(f.name).alias("column_name"), (F.count("*") - F.count(value)).alias("nulls"), F.round((F.count("*") - F.count(value)) / F.count("*"), 6).alias("null_share"), distinct(value).alias("distinct_values"), F.min(value).cast("string").alias("min"), F.max(value).cast("string").alias("max")).alias(f"s{len(each)}"))
    row = df.agg(*each)
    return row.select(F.inline(F.array(*[F.col(c) for c in row.columns])))


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """``bin``, ``n`` between the column's least and greatest value; the last bin is closed. Nulls don't count."""
    bounds = df.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))  # one row
    return df.select(column).where(F.col(column).isNotNull()).join(bounds).groupBy(histogram_bin(F.col(column), F.col("__lo"), F.col("__hi"), bins).alias("bin")).agg(F.count("*").alias("n"))


def completeness(df: DataFrame) -> DataFrame:
    """1 less the share of null cells: ``completeness``."""
    nulls = reduce(lambda a, b: a + b, [F.count("*") - F.count(f"`{c}`") for c in df.columns])
    return df.agg(F.round(1 - nulls / (F.count("*") * len(df.columns)), 6).alias("completeness"))


def table_statistics(df: DataFrame, large: int = 1_000_000) -> DataFrame:
    """``rows``, ``columns``, ``is_large``."""
    return df.agg(F.count("*").alias("rows")).select("rows", F.lit(len(df.columns)).alias("columns"), (F.col("rows") >= large).alias("is_large"))


def storage_statistics(df: DataFrame, large_rows: int = 1_000_000, large_mb: float = 1024) -> DataFrame:
    """``rows``, ``columns``, ``files``, ``size_mb``, ``is_large`` of a table that is read from files; no data is read for the size."""
    jvm, sizes = df.sparkSession._jvm, []
    for f in df.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(f)
        sizes.append(path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getFileStatus(path).getLen())
    mb = round(sum(sizes) / 2**20, 3)
    return df.agg(F.count("*").alias("rows")).select("rows", F.lit(len(df.columns)).alias("columns"), F.lit(len(sizes)).alias("files"), F.lit(mb).alias("size_mb"), ((F.col("rows") >= large_rows) | F.lit(mb >= large_mb)).alias("is_large"))


def suggest_limit(rows: int, requested: int | None = None) -> int | None:
    """The limit asked for, or ten thousand for a table of more than a hundred thousand rows."""
    return requested if requested is not None else 10_000 if rows > 100_000 else None
