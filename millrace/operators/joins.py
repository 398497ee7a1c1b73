"""Joins that SQL engines have and DataFrames don't."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof_join(left: DataFrame, right: DataFrame, time: str, keys: Sequence[str], values: Sequence[str], cuts: int = 16) -> DataFrame:
    """Each left row with the ``values`` of the last right row of its keys at or before its time (null where none).

    One union and one window, over stretches of time of about as many right rows each, so that a key that most rows have
    is no single task's; what a stretch takes over from those before it is a row per key and stretch. Of right rows at the
    same time the one with the greatest values counts. Rows with a null key or time find nothing. ``cuts`` 0 leaves the time
    whole, as does a time that is no number, date or timestamp.
    """
    own = [F.col(c) for c in left.columns]
    right = right.dropna(subset=[time, *keys])
    number = _as_number(right, time)
    bounds = []
    if cuts and number is not None:
        bounds = right.select(F.percentile_approx(number, [(k + 1) / (cuts + 1) for k in range(cuts)])).first()[0] or []
    stretch = lambda df: sum((F.when(_as_number(df, time) >= b, 1).otherwise(0) for b in sorted(set(bounds))), F.lit(0))
    a = left.select(F.struct(*own).alias("__row"), *keys, time, F.lit(1).alias("__side"), F.lit(None).cast(right.select(F.struct(*values).alias("s")).schema["s"].dataType).alias("__value"), stretch(left).alias("__stretch"))
    b = right.select(F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), *keys, time, F.lit(0).alias("__side"), F.struct(*values).alias("__value"), stretch(right).alias("__stretch"))
    order = Window.partitionBy(*keys, "__stretch").orderBy(F.asc_nulls_first(time), "__side", F.asc_nulls_first("__value"))
    last = F.last("__value", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    usable = F.col(time).isNotNull()
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    every = a.unionByName(b).withColumn("__last", last).where("__side = 1")
    if bounds:
        ends = b.groupBy(*keys, "__stretch").agg(F.max(F.struct(time, "__value")).alias("__end"))
        # the stretches after one that has values, up to the next that has: a key has at most as many rows as there are stretches
        following = F.lead("__stretch").over(Window.partitionBy(*keys).orderBy("__stretch"))
        reach = ends.withColumn("__to", F.coalesce(following, F.lit(len(bounds)))).where(F.col("__to") > F.col("__stretch"))
        carried = reach.select(*keys, F.explode(F.sequence(F.col("__stretch") + 1, "__to")).alias("__stretch"), F.col("__end.__value").alias("__carried"))
        every = every.join(carried, [*keys, "__stretch"], "left").withColumn("__last", F.coalesce("__last", "__carried"))
    found = every.withColumn("__found", F.when(usable, F.col("__last")))
    return found.select("__row.*", *[F.col(f"__found.{v}").alias(v) for v in values])


def _as_number(df: DataFrame, time: str) -> Column | None:
    kind = dict(df.dtypes)[time]
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.unix_micros(F.col(time).cast("timestamp"))
    return F.col(time).cast("double") if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal") else None


def range_join(left: DataFrame, ranges: DataFrame, value: str, low: str, high: str) -> DataFrame:
    """Left rows with each range that holds their value, ``low <= value < high``.

    A condition without equality: the planner sends the smaller side to all tasks while it is small; use
    :func:`binned_range_join` where both sides are large.
    """
    return left.join(ranges, (F.col(value) >= F.col(low)) & (F.col(value) < F.col(high)))


def binned_range_join(left: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """The same for two large sides: ranges are spread over bins of ``width`` they touch, and the bins join by equality."""
    bins = F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width)))
    placed = ranges.withColumn("__bin", bins)
    found = left.withColumn("__bin", F.floor(F.col(value) / width)).join(placed, "__bin")
    return found.where((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("__bin")
