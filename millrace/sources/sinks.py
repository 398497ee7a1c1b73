"""Sinks: exports with checks, batches of results, errors kept beside the data."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.guards import Rejected

ROWS_PER_FILE = 100_000


def export_format(path: str, chosen: str | None = None) -> str:
    found = chosen or (m[1] if (m := re.search(r"\.(parquet|csv|json)$", path.lower())) else None)
    if found not in ("parquet", "csv", "json"):
        raise Rejected(f"no export format: {path}")
    return found


def export(df: DataFrame, path: str, format: str | None = None, columns: Sequence[str] | None = None, overwrite: bool = False, compression: str = "zstd", delimiter: str = ",", rows: int | None = None) -> None:
    """Write a frame; CSV leaves out binary and list columns. Paths don't climb, unknown columns are rejected.

    Given the number of rows, there is a file for every hundred thousand of them; otherwise as many as the plan's tasks.
    """
    if ".." in path.split("/"):
        raise Rejected(f"a path that climbs: {path}")
    kind = export_format(path, format)
    if unknown := set(columns or ()) - set(df.columns):
        raise Rejected(f"no such column: {sorted(unknown)}")
    out = df.select(*columns) if columns else df
    if rows is not None:
        out = out.repartition(max(1, -(-rows // ROWS_PER_FILE)))
    writer = lambda d: d.write.mode("overwrite" if overwrite else "errorifexists")
    if kind == "csv":
        flat = [f.name for f in out.schema if not isinstance(f.dataType, (T.BinaryType, T.ArrayType, T.MapType, T.StructType))]
        if not flat:
            raise Rejected("no column can be written as CSV")
        writer(out.select(*flat)).csv(path, header=True, sep=delimiter)
    elif kind == "json":
        writer(out).json(path)
    else:
        writer(out).option("compression", compression).parquet(path)


def export_table(df: DataFrame, url: str, table: str, mode: str = "append") -> None:
    """Rows into a database by JDBC."""
    df.write.format("jdbc").option("url", url).option("dbtable", table).mode(mode).save()


def batches(df: DataFrame, size: int = 10_000) -> Iterator[list]:
    """A finished frame in lists of rows; one partition at a time comes to the driver."""
    held: list = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def events(df: DataFrame, size: int = 10_000) -> Iterator[str]:
    """Server-sent events: the schema, then batches (Arrow, base64), then the number of rows."""
    import pyarrow as pa

    yield f"event: schema\ndata: {df.schema.json()}\n\n"
    total = 0
    for rows in batches(df, size):
        table = pa.Table.from_pylist([r.asDict(recursive=True) for r in rows])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        total += len(rows)
        yield f"event: batch\ndata: {base64.b64encode(sink.getvalue().to_pybytes()).decode()}\n\n"
    yield f"event: done\ndata: {json.dumps({'rows': total})}\n\n"


def foreach_partition(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, partitions: int = 8, retries: int = 1) -> DataFrame:
    """``fn`` over the batches of so many partitions; a batch that still fails gives a row with its ``_error`` and nulls."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for left in range(retries, -1, -1):
                try:
                    yield fn(batch).assign(_error=None)
                    break
                except Exception as e:
                    if not left:
                        yield pd.DataFrame([[None] * len(names) + [str(e)[:500]]], columns=[*names, "_error"])

    return df.repartition(partitions).mapInPandas(run, f"{schema}, _error string")


def with_comments(df: DataFrame, comments: dict[str, str]) -> DataFrame:
    """Comments in the columns' metadata, which Parquet keeps."""
    return df.select(*[F.col(f"`{c}`").alias(c, metadata={"comment": comments[c]}) if c in comments else F.col(f"`{c}`") for c in df.columns])


def comments_of(df: DataFrame) -> dict[str, str]:
    return {f.name: f.metadata["comment"] for f in df.schema if f.metadata and "comment" in f.metadata}
