"""Quality rules, filters, the ingestion gate, scores and schema validation, as predicates over rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.dedup import last_of, later


# --- rules: what violates them --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """``kind`` length, range, regex or duplicate; ``action`` reject, remove or flag."""

    name: str
    column: str
    kind: str
    action: str = "flag"
    params: Mapping = field(default_factory=dict)

    def violated(self) -> Column:
        """True where a row violates the rule; a null never does. Duplicates have been marked by :func:`_marked`."""
        value = F.col(self.column)
        low, high = self.params.get("min"), self.params.get("max")
        if self.kind in ("length", "range"):
            measured = F.char_length(value) if self.kind == "length" else value
            tests = [measured < low] * (low is not None) + [measured > high] * (high is not None)
            found = reduce(lambda a, b: a | b, tests) if tests else F.lit(False)
        elif self.kind == "regex":
            found = value.rlike(self.params["pattern"])
            found = ~found if self.params.get("invert") else found
        elif self.kind == "duplicate":
            found = F.col(f"__later_{self.column}")
        else:
            raise ValueError(f"unknown rule: {self.kind}")
        return F.coalesce(found, F.lit(False))


def _marked(df: DataFrame, rules: Sequence[Rule], order: Sequence[str]) -> DataFrame:
    """``df`` with a mark of later rows in ``order`` for each column with a duplicate rule; empty values are never duplicates."""
    for column in dict.fromkeys(r.column for r in rules if r.kind == "duplicate"):
        keyed = df.withColumn("__value", F.when(F.col(column).cast("string") != "", F.col(column)))
        df = later(keyed, "__value", order, f"__later_{column}").drop("__value")
    return df


def evaluate_rules(df: DataFrame, rules: Sequence[Rule], order: Sequence[str]) -> DataFrame:
    """``rule``, ``action``, ``violations`` of each rule with any; rules on columns that aren't there are left out.

    One pass for all rules but duplicates, of which each column's are values less distinct values: an aggregation.
    """
    usable = [r for r in rules if r.column in df.columns]
    if not usable:
        return df.sparkSession.createDataFrame([], "rule string, action string, violations bigint")
    name = lambda r: [F.lit(r.name).alias("rule"), F.lit(r.action).alias("action")]
    plain = [r for r in usable if r.kind != "duplicate"]
    parts = []
    if plain:
        counted = df.agg(*[F.count_if(r.violated()).alias(f"r{k}") for k, r in enumerate(plain)])
        parts.append(counted.select(F.inline(F.array(*[F.struct(*name(r), F.col(f"r{k}").alias("violations")) for k, r in enumerate(plain)]))))
    for r in usable:
        if r.kind == "duplicate":
            value = F.when(F.col(r.column).cast("string") != "", F.col(r.column))
            parts.append(df.groupBy(value.alias("v")).agg(F.count("*").alias("n")).where("v is not null").agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations")).select(*name(r), "violations"))
    return reduce(DataFrame.unionByName, parts).where("violations > 0")


def apply_rules(df: DataFrame, rules: Sequence[Rule], order: Sequence[str]) -> DataFrame:
    """Rows that no rejecting or removing rule hits; those that only flag stay."""
    hard = [r for r in rules if r.action in ("reject", "remove") and r.column in df.columns]
    hit = reduce(lambda a, b: a | b, [r.violated() for r in hard], F.lit(False))
    return _marked(df, hard, order).where(~hit).select(*df.columns)


# --- filters: what passes them ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Filter:
    name: str
    passes: Callable[[DataFrame], Column]
    reason: str


def text_length(column: str = "text_content", least: int = 1, most: int | None = None) -> Filter:
    """Null texts pass."""

    def passes(df: DataFrame) -> Column:
        n = F.char_length(column)
        ok = n >= least
        return F.coalesce(ok & (n <= most) if most is not None else ok, F.lit(True))

    return Filter("text_length", passes, f"{column} is shorter than {least}" + (f" or longer than {most}" if most is not None else ""))


def image_resolution(width: int = 64, height: int = 64) -> Filter:
    """Rows without a size pass."""
    return Filter("image_resolution", lambda df: F.coalesce((F.col("image_width") >= width) & (F.col("image_height") >= height), F.lit(True)), f"smaller than {width}x{height}")


class Registry:
    """Filters by name, switched on by a comma-separated list."""

    def __init__(self, *filters: Filter) -> None:
        self.filters = {f.name: f for f in filters}

    def active(self, names: str) -> list[Filter]:
        return [self.filters[n.strip()] for n in names.split(",") if n.strip()]


def judged(df: DataFrame, filters: Sequence[Filter], mode: str = "all") -> DataFrame:
    """The rows with ``_passed`` and ``_rejection_reason``.

    In mode ``all`` a row fails at its first failing filter; in mode ``any`` it passes with the first passing one.
    """
    verdict = F.lit(None).cast("string")
    for f in reversed(filters):
        verdict = F.when(f.passes(df), verdict).otherwise(F.lit(f.reason))
    if mode == "any" and filters:
        passed = reduce(lambda a, b: a | b, [f.passes(df) for f in filters])
        verdict = F.when(~passed, F.lit("; ".join(f.reason for f in filters)))
    return df.withColumn("_rejection_reason", verdict).withColumn("_passed", F.col("_rejection_reason").isNull())


def filter_report(df: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    """``filter``, ``seen``, ``passed``, ``rejected``: each filter sees the survivors of those before. One pass."""
    alive, counts = F.lit(True), []
    for k, f in enumerate(filters):
        ok = f.passes(df)
        counts += [F.count_if(alive).alias(f"s{k}"), F.count_if(alive & ok).alias(f"p{k}")]
        alive = alive & ok
    row = df.agg(*counts)
    return row.select(F.inline(F.array(*[F.struct(F.lit(f.name).alias("filter"), F.col(f"s{k}").alias("seen"), F.col(f"p{k}").alias("passed"), (F.col(f"s{k}") - F.col(f"p{k}")).alias("rejected")) for k, f in enumerate(filters)])))


def quality_score(df: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    """``quality_score``: 1 for rows that pass all filters, else 1 less a fifth per filter, not below 0."""
    ok = reduce(lambda a, b: a & b, [f.passes(df) for f in filters], F.lit(True))
    return df.withColumn("quality_score", F.when(ok, 1.0).otherwise(max(0.0, 1 - min(1.0, 0.2 * len(filters)))))


#: Words that mark unsafe content.
UNSAFE = ("nsfw", "porn", "xxx", "nude", "explicit", "sexual", "adult content")


def heuristic_scores(df: DataFrame, text: str = "text_content", parity: bool = False) -> DataFrame:
    """``text_quality``, ``nsfw``, ``aesthetic`` and their mean ``composite``; unsafe content lowers it, in parity mode it adds."""
    quality = F.least(F.lit(1.0), F.coalesce(F.char_length(text), F.lit(0)) / 1000)
    unsafe = F.when(F.coalesce(F.lower(text).rlike("|".join(UNSAFE)), F.lit(False)), 0.9).otherwise(0.0)
    aesthetic = F.least(F.lit(1.0), F.coalesce(F.col("image_width").cast("double") * F.col("image_height"), F.lit(0.0)) / 16_777_216)
    scored = df.withColumns({"text_quality": quality, "nsfw": unsafe, "aesthetic": aesthetic})
    safe = F.col("nsfw") if parity else 1 - F.col("nsfw")
    return scored.withColumn("composite", (F.col("text_quality") + safe + F.col("aesthetic")) / 3)


# --- schema validation and the gate -------------------------------------------------------------------------------------


def schema_errors(df: DataFrame, target: T.StructType, strict: bool = False) -> Column:
    """What is wrong with a row against a schema: missing values, values that can't be cast, and, if strict, unknown columns."""
    have = {f.name: f.dataType for f in df.schema}
    found: list[Column] = []
    for f in target:
        if f.name not in have:
            found += [F.lit(f"missing column {f.name}")] * (not f.nullable)
            continue
        value = F.col(f"`{f.name}`")
        if not f.nullable:
            found.append(F.when(value.isNull(), F.lit(f"null in {f.name}")))
        if have[f.name] != f.dataType:
            found.append(F.when(value.isNotNull() & value.try_cast(f.dataType).isNull(), F.lit(f"{f.name} is no {f.dataType.simpleString()}")))
    if strict:
        found += [F.lit(f"unknown column {c}") for c in have if c not in target.names]
    return F.filter(F.array(*found), lambda e: e.isNotNull()) if found else F.array().cast("array<string>")


def validate(df: DataFrame, target: T.StructType, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(valid rows in the target's columns and types, rejected rows with ``_rejection_reason``)."""
    marked = df.withColumn("__errors", schema_errors(df, target, strict))
    valid = marked.where(F.size("__errors") == 0).select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in target])
    rejected = marked.where(F.size("__errors") > 0).withColumn("_rejection_reason", F.array_join("__errors", "; ")).drop("__errors")
    return valid, rejected


def gate(df: DataFrame, target: T.StructType | None, filters: Sequence[Filter], least_score: float = 0.0, parent_version: int = 0) -> DataFrame:
    """Every row with where it ended: ``_stage`` passed, schema, filter or score, ``_rejection_reason`` and ``_parent_version``.

    Schema first, then filters, then the score; a row stops at the first that rejects it.
    """
    errors = schema_errors(df, target) if target is not None else F.array().cast("array<string>")
    scored = quality_score(judged(df.withColumn("__errors", errors), filters), filters)
    stage = F.when(F.size("__errors") > 0, "schema").when(~F.col("_passed"), "filter").when(F.col("quality_score") < least_score, "score").otherwise("passed")
    reason = F.when(F.size("__errors") > 0, F.array_join("__errors", "; ")).when(~F.col("_passed"), F.col("_rejection_reason")).when(F.col("quality_score") < least_score, F.lit(f"score below {least_score}"))
    return scored.withColumn("_stage", stage).withColumn("_rejection_reason", reason).withColumn("_parent_version", F.lit(parent_version)).drop("__errors", "_passed")


def dead_letters(gated: DataFrame, filter_name: str = "gate", at: Column | None = None) -> DataFrame:
    """The rejected rows of a gate in the form of a dead-letter table."""
    rejected = gated.where("_stage <> 'passed'").withColumn("_filter_name", F.concat(F.lit(filter_name + ":"), "_stage"))
    return rejected.withColumn("_rejected_at", at if at is not None else F.current_timestamp()).drop("_stage", "quality_score")


def latest_letters(log: DataFrame, key: str = "key", time: str = "at", most_retries: int = 3) -> DataFrame:
    """The last state of each key of an append-only log (of one time the greatest by its columns), with ``can_retry``."""
    return last_of(log, [key], time).withColumn("can_retry", (F.col("state") == "pending") & (F.col("retries") < most_retries))


def confidence_gate(parsed: DataFrame, grade: str = "grade", least: float = 0.5, attempts: str = "attempts", most: int = 2) -> DataFrame:
    """Parsed documents with ``_parse``: accepted, retry (while fewer than ``most`` attempts were made) or low_confidence; a missing grade is low."""
    good = F.coalesce(F.col(grade) >= least, F.lit(False))
    return parsed.withColumn("_parse", F.when(good, "accepted").when(F.coalesce(F.col(attempts), F.lit(0)) < most, "retry").otherwise("low_confidence"))
