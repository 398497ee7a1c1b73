"""Per-source document settings with the row ``default`` filling whatever is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Used where neither the source's row nor the row ``default`` has a setting.
FALLBACK = {"chunk_size": 512, "chunk_overlap": 64, "pdf_parse_mode": "auto"}


def with_settings(records: DataFrame, config: DataFrame, *settings: str) -> DataFrame:
    """Add the columns ``cfg_<setting>`` to ``records`` by its ``source``.

    A null or unlisted source, and a null setting, take the value of the row ``default``, and where that is missing
    too, the value of ``FALLBACK``. Several rows of one source count as the one with the greatest ``config_id``.
    The settings are one row per source, so the planner broadcasts them by their known size or shuffles beyond it.
    """
    last = lambda s: F.max_by(s, F.coalesce("config_id", F.lit(-1)))
    rows = config.groupBy(F.col("source").alias("__source")).agg(*[last(s).alias(f"__{s}") for s in settings])
    named = rows.where("__source is not null and __source <> 'default'")
    default = config.where("source = 'default'").agg(*[last(s).alias(f"__default_{s}") for s in settings])
    found = records.join(named, F.col("source") == F.col("__source"), "left").join(default, how="left")
    value: dict[str, Column] = {f"cfg_{s}": F.coalesce(f"__{s}", f"__default_{s}", F.lit(FALLBACK.get(s))) for s in settings}
    return found.select(*[records[c] for c in records.columns], *[v.alias(k) for k, v in value.items()])
