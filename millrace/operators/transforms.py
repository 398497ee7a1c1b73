"""Data-driven preparation: transform lists, and cleaning steps as one projection."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import exprs
from millrace.operators.frame import LazyFrame, compare
from millrace.operators.guards import Rejected, check_name

Model = Callable[[Column], Column]


def _deduplicate(df: DataFrame, step: Mapping) -> DataFrame:
    columns = list(step["columns"])
    return LazyFrame(df).first_by(columns, step.get("order_by", columns[0]), step.get("desc", False)).df


def apply_transforms(df: DataFrame, steps: Sequence[Mapping], models: Mapping[str, Model] | None = None) -> DataFrame:
    """Steps in order: rename, select, filter, cast, add_constant, deduplicate, drop_null, fill_null, resize, and model columns.

    Models (classify_text, classify_image, llm_generate, prompt, embed) are columns made by injected functions of a
    column; without one the step is rejected.
    """
    for step in steps:
        kind = step["op"]
        if kind == "rename":
            df = df.withColumnRenamed(step["from"], check_name(step["to"]))
        elif kind == "select":
            df = df.select(*step["columns"])
        elif kind == "filter":
            df = df.where(compare(step["column"], step["operator"], step.get("value")))
        elif kind == "cast":
            df = df.withColumn(step["column"], F.col(step["column"]).try_cast(exprs.ARROW_TYPES[step["dtype"].lower()]))
        elif kind == "add_constant":
            value = F.lit(step["value"])
            df = df.withColumn(check_name(step["column"]), value.cast(exprs.ARROW_TYPES[step["dtype"].lower()]) if step.get("dtype") else value)
        elif kind == "deduplicate":
            df = _deduplicate(df, step)
        elif kind == "drop_null":
            df = df.dropna(subset=step.get("columns"))
        elif kind == "fill_null":
            df = df.fillna(step["value"], subset=step.get("columns"))
        elif models and kind in models:
            df = df.withColumn(check_name(step.get("as", kind)), models[kind](F.col(step["column"])))
        else:
            raise Rejected(f"unknown transform: {kind}")
    return df


def clean(df: DataFrame, steps: Sequence[Mapping], filters: Sequence[Mapping] = (), limit: int | None = None) -> DataFrame:
    """Cleaning as one projection over the filtered raw rows.

    Filters see the raw columns. Steps work on the column as left by the steps before. Columns that survive keep their
    order; renamed and new columns follow in the order of the steps.
    """
    for f in filters:
        df = df.where(compare(f["column"], f["op"], f.get("value")))
    types = dict(df.dtypes)
    made: dict[str, Column] = {c: F.col(c) for c in df.columns}
    for step in steps:
        kind = step["op"]
        names = step.get("columns") or [step["column"]]
        if missing := [c for c in names if c not in made]:
            raise Rejected(f"no such column: {', '.join(missing)}")
        name = names[0]
        if kind in ("trim", "lower", "upper"):
            made[name] = getattr(F, kind)(made[name])
        elif kind == "fillna":
            made[name] = F.coalesce(made[name], F.lit(step["value"]))
        elif kind == "cast":
            made[name], types[name] = exprs.cast_sql(made[name], types[name], step["dtype"]), exprs.SQL_TYPES[step["dtype"].upper()]
        elif kind == "regex_replace":
            made[name] = exprs.replace_first(made[name], step["pattern"], step.get("replacement", ""))
        elif kind == "case":
            made[name] = exprs.case_map(made[name], step["mapping"], step.get("default"))
        elif kind == "drop":
            for c in names:
                del made[c]
        elif kind == "rename":
            to = check_name(step["to"])
            made[to], types[to] = made.pop(name), types[name]
        elif kind == "concat":
            made[check_name(step.get("as", "_concat"))] = F.concat_ws(step.get("sep", " "), *[made[c].cast("string") for c in names])
        elif kind == "split":
            made[check_name(step.get("as", f"{name}_{step['index']}"))] = exprs.split_part(made[name], step["sep"], step["index"])
        else:
            raise Rejected(f"unknown step: {kind}")
    found = df.select(*[c.alias(k) for k, c in made.items()])
    return found.limit(limit) if limit else found
