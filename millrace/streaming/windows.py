"""Extensions beyond the reference: time windows and sessions, over tables and streams alike, and streams with state."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window


def windowed(events: DataFrame, time: str, width: str, slide: str | None, keys: Sequence[str], aggregates: Sequence[Column], late: str | None = None) -> DataFrame:
    """Tumbling or sliding windows; with ``late``, a stream's windows close that long after their end and later rows are dropped."""
    source = events.withWatermark(time, late) if late else events
    grouped = source.groupBy(F.window(time, width, slide) if slide else F.window(time, width), *keys).agg(*aggregates)
    return grouped.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in grouped.columns if c != "window"])


def sessions(events: DataFrame, time: str, gap: str, keys: Sequence[str], aggregates: Sequence[Column], late: str | None = None) -> DataFrame:
    """Runs of a key's rows with no longer gap between two of them."""
    source = events.withWatermark(time, late) if late else events
    grouped = source.groupBy(F.session_window(time, gap), *keys).agg(*aggregates)
    return grouped.select(F.col("session_window.start").alias("session_start"), *[c for c in grouped.columns if c != "session_window"])


def session_ids(events: DataFrame, time: str, gap_s: int, keys: Sequence[str]) -> DataFrame:
    """Each row with the number of its session, from 1, in its key's order of time."""
    order = Window.partitionBy(*keys).orderBy(time)
    gap = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(order).cast("timestamp"))
    return events.withColumn("session_no", F.sum(F.when(gap > gap_s * 1_000_000, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)) + 1)


def read_stream(batch: DataFrame, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder's Parquet files as a stream, in the schema of a batch over it."""
    return batch.sparkSession.readStream.schema(batch.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def without_repeats(stream: DataFrame, keys: Sequence[str], time: str, late: str) -> DataFrame:
    """Each key once within the watermark's time; the state holds no more keys than that."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Everything that is there now, into a Parquet table, exactly once."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Everything that is there now, batch by batch, through a function of the batch and its number."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
