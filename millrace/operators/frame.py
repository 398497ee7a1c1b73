"""A lazy frame with a small, checked algebra; every method adds nodes to one logical plan."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.dedup import best_of, last_of
from millrace.operators.guards import Rejected, check_name, check_sql, check_where

_AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum, "mean": F.avg, "count": F.count, "min": F.min, "max": F.max, "first": F.first, "last": F.last, "stddev": F.stddev_samp, "var": F.var_samp,
}
_OPERATORS: dict[str, Callable[[Column, object], Column]] = {
    "eq": lambda c, v: c == v, "ne": lambda c, v: c != v, "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v,
    "is_null": lambda c, v: c.isNull(), "is_not_null": lambda c, v: c.isNotNull(),
}
_OPERATORS |= {"==": _OPERATORS["eq"], "=": _OPERATORS["eq"], "!=": _OPERATORS["ne"], ">": _OPERATORS["gt"], ">=": _OPERATORS["gte"], "<": _OPERATORS["lt"], "<=": _OPERATORS["lte"]}


def compare(column: str, op: str, value: object = None) -> Column:
    """A predicate by operator name or sign; unknown operators are rejected."""
    if op not in _OPERATORS:
        raise Rejected(f"unknown operator: {op}")
    return _OPERATORS[op](F.col(check_name(column)), value)


class LazyFrame:
    def __init__(self, df: DataFrame, hard_limit: int = 1_000_000) -> None:
        self.df, self.hard_limit = df, hard_limit

    def _with(self, df: DataFrame) -> LazyFrame:
        return LazyFrame(df, self.hard_limit)

    def _known(self, *columns: str) -> list[str]:
        for c in columns:
            if check_name(c) not in self.df.columns:
                raise Rejected(f"no such column: {c}")
        return list(columns)

    # projections
    def select(self, *columns: str) -> LazyFrame:
        return self._with(self.df.select(*self._known(*columns)))

    def with_column(self, name: str, expression: Column | str) -> LazyFrame:
        return self.with_columns({name: expression})

    def with_columns(self, expressions: Mapping[str, Column | str]) -> LazyFrame:
        return self._with(self.df.withColumns({check_name(k): F.expr(check_where(v)) if isinstance(v, str) else v for k, v in expressions.items()}))

    def exclude(self, *columns: str) -> LazyFrame:
        return self._with(self.df.drop(*self._known(*columns)))

    # filters
    def filter(self, condition: Column | str) -> LazyFrame:
        return self._with(self.df.where(F.expr(check_where(condition)) if isinstance(condition, str) else condition))

    def filters(self, steps: Sequence[Mapping]) -> LazyFrame:
        """Steps of column, op and value, all of which must hold."""
        found = self
        for step in steps:
            found = found.filter(compare(step["column"], step["op"], step.get("value")))
        return found

    def drop_null(self, *columns: str) -> LazyFrame:
        return self._with(self.df.dropna(subset=self._known(*columns) or None))

    def fill_null(self, value: object, column: str | None = None) -> LazyFrame:
        """One value for one column or for all that can hold it."""
        if column:
            return self.with_column(*self._known(column), F.coalesce(F.col(column), F.lit(value)))
        return self._with(self.df.fillna(value))

    # order and limits
    def sort(self, column: str, desc: bool = False) -> LazyFrame:
        """Nulls come last either way."""
        self._known(column)
        return self._with(self.df.orderBy(F.desc_nulls_last(column) if desc else F.asc_nulls_last(column)))

    def limit(self, n: int) -> LazyFrame:
        if n < 1:
            raise Rejected("a limit is at least 1")
        return self._with(self.df.limit(n))

    def offset(self, n: int) -> LazyFrame:
        if n < 0:
            raise Rejected("an offset is at least 0")
        return self._with(self.df.offset(n))

    def sample(self, fraction: float | None = None, size: int | None = None, seed: int = 0, key: str | None = None) -> LazyFrame:
        """A share of the rows, or an exact number: those with the least hashes of ``key`` (of all columns without one)."""
        if size is not None:
            return self._with(self.df.orderBy(F.xxhash64(F.lit(seed), *([key] if key else self.df.columns))).limit(size))
        return self._with(self.df.sample(fraction=fraction, seed=seed))

    # aggregates
    def groupby(self, *columns: str) -> GroupedFrame:
        return GroupedFrame(self, self._known(*columns))

    def distinct(self, *columns: str) -> LazyFrame:
        return self._with(self.df.dropDuplicates(self._known(*columns)) if columns else self.df.distinct())

    def first_by(self, columns: Sequence[str], order_by: str, desc: bool = False) -> LazyFrame:
        """One row per key, the first in an order; ties by all columns, so that it is always the same row; nulls come last either way."""
        self._known(*columns, order_by)
        return self._with(best_of(self.df, columns, F.struct(F.col(order_by).isNull().alias("n"), order_by)) if not desc else last_of(self.df, columns, order_by))

    def pivot(self, group_by: Sequence[str], pivot_col: str, value_col: str, agg_fn: str = "sum", names: Sequence | None = None) -> LazyFrame:
        """``names`` spares the pass that finds the values."""
        self._known(*group_by, pivot_col, value_col)
        return self._with(self.df.groupBy(*group_by).pivot(pivot_col, list(names) if names else None).agg(_AGGREGATES[agg_fn](F.col(value_col))))

    def unpivot(self, ids: Sequence[str], values: Sequence[str], variable_name: str = "variable", value_name: str = "value") -> LazyFrame:
        return self._with(self.df.unpivot(self._known(*ids), self._known(*values), check_name(variable_name), check_name(value_name)))

    def explode(self, *columns: str, ignore_empty: bool = False) -> LazyFrame:
        """Lists side by side, to the length of the longest; an empty or null list gives one row with null unless ignored."""
        self._known(*columns)
        take = F.inline if ignore_empty else F.inline_outer
        others = [c for c in self.df.columns if c not in columns]
        exploded = self.df.select(*others, take(F.arrays_zip(*[F.coalesce(F.col(c), F.array()) if len(columns) > 1 else F.col(c) for c in columns])).alias(*columns))
        return self._with(exploded.select(*self.df.columns))

    # several frames
    def join(self, other: LazyFrame, on: str, how: str = "inner") -> LazyFrame:
        if how not in ("inner", "left", "outer", "semi", "anti"):
            raise Rejected(f"unknown join: {how}")
        return self._with(self.df.join(other.df, on, {"semi": "left_semi", "anti": "left_anti"}.get(how, how)))

    def join_on(self, other: LazyFrame, left_on: str, right_on: str, how: str = "left", prefix: str = "right_") -> LazyFrame:
        """Keys of different names; columns of the other frame that clash get a prefix."""
        renamed = other.df.select(*[F.col(c).alias(prefix + c if c in self.df.columns else c) for c in other.df.columns])
        key = prefix + right_on if right_on in self.df.columns else right_on
        return self._with(self.df.join(renamed, F.col(left_on) == F.col(key), how))

    def union(self, *others: LazyFrame) -> LazyFrame:
        df = self.df
        for other in others:
            df = df.unionByName(other.df, allowMissingColumns=True)
        return self._with(df)

    def merge(self, other: LazyFrame) -> LazyFrame:
        """Rows of both; the schemas must be the same."""
        if [(f.name, f.dataType) for f in self.df.schema] != [(f.name, f.dataType) for f in other.df.schema]:
            raise Rejected("the schemas differ")
        return self._with(self.df.unionByName(other.df))

    def except_all(self, other: LazyFrame) -> LazyFrame:
        return self._with(self.df.exceptAll(other.df))

    def intersect(self, other: LazyFrame) -> LazyFrame:
        return self._with(self.df.intersect(other.df))

    def sql(self, query: str) -> LazyFrame:
        """SQL with the frame as the table ``self``."""
        query = check_sql(query, ctes=True, most=10_000)
        view = "self"
        session = self.df.sparkSession
        self.df.createOrReplaceTempView(view)
        try:
            return self._with(session.sql(query))
        finally:
            session.catalog.dropTempView(view)

    # looking at it
    def schema(self) -> DataFrame:
        """Column names and types, as the frame's description."""
        return self.df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in self.df.schema], "column_name string, column_type string")

    def count_rows(self) -> int:
        return self.df.count()

    def check_size(self, warn_at: int = 500_000) -> str:
        """``ok``, ``large``, or an error beyond the hard limit; counts no further than that."""
        n = self.df.limit(self.hard_limit + 1).count()
        if n > self.hard_limit:
            raise Rejected(f"more than {self.hard_limit} rows; aggregate or limit first")
        return "large" if n > warn_at else "ok"

    def collect(self, max_rows: int = 100_000) -> DataFrame:
        return self.df.limit(max_rows) if max_rows else self.df

    def run(self, steps: Mapping) -> LazyFrame:
        """A pipeline given as data, in a fixed order; a sort is applied last again where its column is still there."""
        found = self
        if steps.get("filters"):
            found = found.filters(steps["filters"])
        if steps.get("join"):
            found = found.join(*steps["join"])
        if steps.get("groupby"):
            found = found.groupby(*steps["groupby"]).agg(**steps.get("aggregates", {}))
        if steps.get("sql"):
            found = found.sql(steps["sql"])
        if steps.get("pivot"):
            found = found.pivot(**steps["pivot"])
        if steps.get("explode"):
            found = found.explode(*steps["explode"])
        if steps.get("sample"):
            found = found.sample(**steps["sample"])
        if steps.get("distinct"):
            found = found.distinct()
        if steps.get("sort") and steps["sort"]["column"] in found.df.columns:
            found = found.sort(**steps["sort"])
        if steps.get("select"):
            found = found.select(*steps["select"])
        if steps.get("offset"):
            found = found.offset(steps["offset"])
        return found.limit(steps["limit"]) if steps.get("limit") else found


class GroupedFrame:
    def __init__(self, frame: LazyFrame, keys: list[str]) -> None:
        self.frame, self.keys = frame, keys

    def _numeric(self) -> list[str]:
        return [f.name for f in self.frame.df.schema if isinstance(f.dataType, T.NumericType) and f.name not in self.keys]

    def _all(self, function: Callable[[Column], Column], columns: list[str]) -> LazyFrame:
        return self.frame._with(self.frame.df.groupBy(*self.keys).agg(*[function(F.col(c)).alias(c) for c in columns]))

    def agg(self, *expressions: Column, **named: tuple[str, str]) -> LazyFrame:
        """Columns, or ``name=(column, function)``."""
        made = [_AGGREGATES[f](F.col(c)).alias(k) for k, (c, f) in named.items()]
        return self.frame._with(self.frame.df.groupBy(*self.keys).agg(*expressions, *made))

    def sum(self) -> LazyFrame:
        return self._all(F.sum, self._numeric())

    collect = sum

    def mean(self) -> LazyFrame:
        return self._all(F.avg, self._numeric())

    def min(self) -> LazyFrame:
        return self._all(F.min, [c for c in self.frame.df.columns if c not in self.keys])

    def max(self) -> LazyFrame:
        return self._all(F.max, [c for c in self.frame.df.columns if c not in self.keys])

    def stddev(self, sample: bool = True) -> LazyFrame:
        return self._all(F.stddev_samp if sample else F.stddev_pop, self._numeric())

    def var(self, sample: bool = True) -> LazyFrame:
        return self._all(F.var_samp if sample else F.var_pop, self._numeric())

    def count(self) -> LazyFrame:
        """Values that aren't null, per column; ``rows`` counts the group's rows."""
        own = [c for c in self.frame.df.columns if c not in self.keys]
        return self.frame._with(self.frame.df.groupBy(*self.keys).agg(F.count("*").alias("rows"), *[F.count(c).alias(c) for c in own]))
