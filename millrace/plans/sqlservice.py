"""Guarded read-only SQL over named tables, with materialized results, a result cache and bounded graph traversal."""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from collections import OrderedDict
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millrace.operators.guards import Rejected, bound_limit, check_name, check_sql, check_where


class SqlService:
    """Queries see the tables given to them as temporary views, which go as soon as the plan is made."""

    def __init__(self, spark: SparkSession, root: str | None = None, max_rows: int = 100_000, joins: bool = True, cache_size: int = 100, cache_s: float = 60) -> None:
        self.spark, self.root, self.max_rows, self.joins = spark, root, max_rows, joins
        self.cache_size, self.cache_s = cache_size, cache_s
        self._cache: OrderedDict[str, tuple[float, DataFrame, set[str]]] = OrderedDict()
        self._lock = threading.Lock()

    def _run(self, query: str, tables: Mapping[str, DataFrame], args: Mapping[str, object] | None = None) -> DataFrame:
        for name, df in tables.items():
            df.createOrReplaceTempView(check_name(name))
        try:
            return self.spark.sql(query, args=dict(args)) if args else self.spark.sql(query)
        finally:
            for name in tables:
                self.spark.catalog.dropTempView(name)

    def olap(self, sql: str, tables: Mapping[str, DataFrame], max_rows: int | None = None) -> DataFrame:
        """A single SELECT, its limit lowered to ``max_rows``; lazy."""
        return self._run(bound_limit(check_sql(sql, joins=self.joins), max_rows or self.max_rows), tables)

    def query(self, sql: str, tables: Mapping[str, DataFrame], args: Mapping[str, object] | None = None) -> DataFrame:
        """A single SELECT or WITH, without a limit of ours; ``:name`` in it stands for the value in ``args``."""
        return self._run(check_sql(sql, joins=self.joins, ctes=True), tables, args)

    @staticmethod
    def relational(df: DataFrame, columns: Sequence[str] = (), where: str | None = None, limit: int = 1000) -> DataFrame:
        """Some columns of the rows that a filter lets through, at most ``limit``."""
        rows = df.where(F.expr(check_where(where))) if where else df
        return (rows.select(*[check_name(c) for c in columns]) if columns else rows).limit(limit)

    def within(self, seconds: float, df: DataFrame) -> list:
        """The rows of a query whose Spark jobs are cancelled when they take longer than that."""
        tag = f"within-{uuid.uuid4().hex}"
        self.spark.addTag(tag)
        timer = threading.Timer(seconds, lambda: self.spark.interruptTag(tag))
        timer.start()
        try:
            return df.collect()
        finally:
            timer.cancel()
            self.spark.removeTag(tag)

    def explain(self, sql: str, tables: Mapping[str, DataFrame]) -> DataFrame:
        """The plan's lines: ``line_no``, ``line``."""
        query = check_sql(sql, joins=self.joins, ctes=True)
        text = self._run(f"EXPLAIN FORMATTED {query}", tables).first()[0]
        return self.spark.createDataFrame(list(enumerate(text.split("\n"), 1)), "line_no bigint, line string")

    def analyze(self, sql: str, tables: Mapping[str, DataFrame]) -> DataFrame:
        """Run a query and say how it went: ``line_no``, ``line`` of seconds, rows, and the plan as it was carried out."""
        df = self.query(sql, tables)
        seen = Observation()
        counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
        began = time.perf_counter()
        counted.write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - began
        lines = [f"seconds: {took:.3f}", f"rows: {seen.get['rows']}", *str(df._jdf.queryExecution().executedPlan().toString()).rstrip().split("\n")]
        return self.spark.createDataFrame(list(enumerate(lines, 1)), "line_no bigint, line string")

    def cached(self, sql: str, tables: Mapping[str, DataFrame], versions: Mapping[str, int]) -> DataFrame:
        """As :meth:`olap`, with the result persisted; the key holds the versions of all tables, not just their names."""
        query = bound_limit(check_sql(sql, joins=self.joins), self.max_rows)
        key = hashlib.sha256(json.dumps([query, sorted(versions.items())]).encode()).hexdigest()
        with self._lock:
            found = self._cache.get(key)
            if found and time.monotonic() - found[0] < self.cache_s:
                self._cache.move_to_end(key)
                return found[1]
            df = self._run(query, tables).persist()
            self._cache[key] = (time.monotonic(), df, set(tables))
            while len(self._cache) > self.cache_size:
                self._cache.popitem(last=False)[1][1].unpersist()
        return df

    def invalidate(self, table: str) -> int:
        with self._lock:
            gone = [k for k, (_, _, names) in self._cache.items() if table in names]
            for k in gone:
                self._cache.pop(k)[1].unpersist()
        return len(gone)

    # materialized results
    def _views(self) -> str:
        if not self.root:
            raise Rejected("no folder for materialized results")
        return f"{self.root}/_mv"

    def materialize(self, name: str, sql: str, tables: Mapping[str, DataFrame], budget: int = 1_000_000, ttl_s: int = 7 * 86_400, now: float | None = None) -> DataFrame:
        """Write a query's rows as a table with a record of when it expires; more rows than the budget are rejected."""
        df = self.query(sql, tables)
        if df.limit(budget + 1).count() > budget:
            raise Rejected(f"more than {budget} rows")
        path = f"{self._views()}/{check_name(name)}"
        df.write.mode("overwrite").parquet(f"{path}/data")
        now = time.time() if now is None else float(now)
        record = [(name, sql, now, now + ttl_s, self.spark.read.parquet(f"{path}/data").count())]
        self.spark.createDataFrame(record, "name string, query string, created double, expires double, num_rows bigint").coalesce(1).write.mode("overwrite").json(f"{path}/record")
        return self.spark.read.parquet(f"{path}/data")

    def materialized(self) -> DataFrame:
        schema = "name string, query string, created double, expires double, num_rows bigint"
        try:
            return self.spark.read.schema(schema).json(f"{self._views()}/*/record")
        except Exception:  # nothing there yet
            return self.spark.createDataFrame([], schema)

    def drop_materialized(self, name: str) -> bool:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self._views()}/{check_name(name)}")
        return bool(path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True))

    def cleanup_materialized(self, now: float | None = None) -> list[str]:
        now = time.time() if now is None else now
        gone = [r.name for r in self.materialized().where(f"expires < {now}").select("name").toLocalIterator()]
        for name in gone:
            self.drop_materialized(name)
        return gone

    # graphs
    def paths(self, edges: DataFrame, source: str, depth: int = 3, src: str = "src", dst: str = "dst", weight: str | None = None, directed: bool = True) -> DataFrame:
        """Every simple path from a node: ``depth``, ``node``, ``path`` and, with weights, ``cost``. Depth is 1 to 10."""
        depth = max(1, min(depth, 10))
        cost = f"coalesce(cast({check_name(weight)} as double), 0D)" if weight else "0D"
        one = f"SELECT cast({check_name(src)} as string) AS s, cast({check_name(dst)} as string) AS t, {cost} AS w FROM edges_of_paths"
        both = one if directed else f"{one} UNION ALL SELECT t AS s, s AS t, w FROM ({one})"
        query = f"""
            WITH RECURSIVE e AS ({both}), walk (depth, node, path, cost) AS (
              SELECT 0, :source, array(:source), 0D
              UNION ALL
              SELECT walk.depth + 1, e.t, array_append(walk.path, e.t), walk.cost + e.w
              FROM walk JOIN e ON e.s = walk.node WHERE walk.depth < {depth} AND NOT array_contains(walk.path, e.t))
            SELECT depth, node, path{', cost' if weight else ''} FROM walk"""
        edges.createOrReplaceTempView("edges_of_paths")
        try:
            return self.spark.sql(query, args={"source": source})
        finally:
            self.spark.catalog.dropTempView("edges_of_paths")
