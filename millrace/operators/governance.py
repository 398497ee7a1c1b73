"""Access rules, masks, lineage and audit."""

from __future__ import annotations

import contextlib
import json
import re
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import exprs
from millrace.session import materialize
from millrace.sources.store import Store

# --- access --------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Access:
    """What one user may see of a dataset. No columns named: all are visible. ``rows`` is one comparison."""

    columns: frozenset[str] = frozenset()
    rows: str | None = None
    masks: Mapping[str, str] = field(default_factory=dict)
    admin: bool = False


def decide(user: Mapping, dataset: str, schema: str = "default") -> bool:
    """Whether a user may read: admin, then denials, then grants by dataset, by schema and by role; what fails denies."""
    try:
        if user.get("admin"):
            return True
        if dataset in user.get("denied", ()) or dataset in user.get("acl_denied", ()) or schema in user.get("denied_schemas", ()):
            return False
        if dataset in user.get("granted", ()) or schema in user.get("granted_schemas", ()):
            return True
        return bool(user.get("role_default", False))
    except Exception:
        return False


_COMPARISON = re.compile(r"\s*([A-Za-z_]\w*)\s*(==|!=|<=|>=|<|>)\s*(.+?)\s*")


def row_predicate(df: DataFrame, rule: str) -> Column:
    """One comparison of a column with a literal; false for what can't be read, missing columns and values of another type."""
    m = _COMPARISON.fullmatch(rule or "")
    if not m or m[1] not in df.columns:
        return F.lit(False)
    column, op, literal = m.groups()
    kind = dict(df.dtypes)[column]
    text = literal[1:-1] if literal[:1] in "'\"" and literal[-1:] == literal[:1] and len(literal) > 1 else literal
    if kind in ("int", "bigint", "smallint", "tinyint", "float", "double") or kind.startswith("decimal"):
        try:
            value = F.lit(float(text))
        except ValueError:
            return F.lit(False)
        left = F.col(column).cast("double")
    else:
        left, value = F.col(column).cast("string"), F.lit(text)
    test = {"==": left == value, "!=": left != value, "<": left < value, "<=": left <= value, ">": left > value, ">=": left >= value}[op]
    return F.coalesce(test, F.lit(False))


def govern(df: DataFrame, access: Access, key: bytes = b"") -> DataFrame:
    """The source as a user sees it. It wraps the source, not a result: aggregates see only the rows and values allowed.

    Columns named of which none is there leave no rows; an unknown mask is an error before anything runs.
    """
    if access.admin:
        return df
    rows = df.where(row_predicate(df, access.rows)) if access.rows else df
    masked = rows.withColumns({c: exprs.mask(F.col(c), how, key) for c, how in access.masks.items() if c in df.columns})
    if not access.columns:
        return masked
    kept = [c for c in df.columns if c in access.columns]
    return masked.select(*kept) if kept else masked.limit(0)


def access_by_tags(columns: Mapping[str, Sequence[str]], visible_to: Mapping[str, Sequence[str]], role: str) -> frozenset[str]:
    """Columns a role sees when every tag of a column must be visible to it; untagged columns are visible."""
    return frozenset(c for c, tags in columns.items() if all(role in visible_to.get(t, ()) for t in tags))


# --- lineage -----------------------------------------------------------------------------------------------------------------

EVENT = "event_id string, dataset_name string, operation string, source_datasets string, actor string, version bigint, metadata string, column_lineage string, created_at string"


def lineage_edges(log: DataFrame) -> DataFrame:
    """``src`` (what was read), ``dst`` (what was written), each once, out of the events' JSON lists."""
    sources = F.explode(F.from_json("source_datasets", "array<string>"))
    return log.select(sources.alias("src"), F.col("dataset_name").alias("dst")).where("src is not null and src <> dst").distinct()


def lineage_history(log: DataFrame, dataset: str) -> DataFrame:
    return log.where(F.col("dataset_name") == dataset).orderBy(F.desc("created_at"), F.desc("event_id"))


def one_hop(log: DataFrame, dataset: str, direction: str) -> DataFrame:
    """``dataset``: producers (``upstream``) or consumers (``downstream``)."""
    here, there = ("dst", "src") if direction == "upstream" else ("src", "dst")
    return lineage_edges(log).where(F.col(here) == dataset).select(F.col(there).alias("dataset")).distinct()


def impact(log: DataFrame, dataset: str, direction: str = "downstream", depth: int = 10, most: int = 500) -> DataFrame:
    """``dataset``, ``depth`` of all that depends on one (or that it depends on), at the least depth; the first ``most``."""
    return _reached(materialize(lineage_edges(log), "edges"), dataset, direction, depth, most)


def _reached(edges: DataFrame, dataset: str, direction: str, depth: int, most: int) -> DataFrame:
    from millrace.operators.graph import neighbours

    start = edges.sparkSession.range(1).select(F.lit(dataset).alias("id"))
    found = start.withColumn("depth", F.lit(0))
    for k in range(0, depth, 5):  # a walk of five steps at a time, from the farthest reached
        front = found.where(F.col("depth") == k).select("id")
        more = neighbours(edges, front, min(5, depth - k), "out" if direction == "downstream" else "in").where("depth > 0")
        found = found.unionByName(more.withColumn("depth", F.col("depth") + k).join(found.select("id"), "id", "left_anti"))
        if depth <= k + 5 or found.where(F.col("depth") == k + 5).isEmpty():
            break
    return found.where("depth > 0").select(F.col("id").alias("dataset"), "depth").orderBy("depth", "dataset").limit(most)


def lineage_graph(log: DataFrame, dataset: str, depth: int = 10, most: int = 500) -> tuple[DataFrame, DataFrame, bool]:
    """(nodes, edges, whether nodes were left out) around a dataset, both ways: ``id``, ``depth``, ``type`` (target, source or derived); ``src``, ``dst``, ``operation``.

    What lies both before and after it is a source, at the lesser depth. The first ``most`` nodes by depth and name are kept.
    """
    pairs = log.select(F.explode(F.from_json("source_datasets", "array<string>")).alias("src"), F.col("dataset_name").alias("dst"), "operation").where("src <> dst").distinct()
    pairs = materialize(pairs, "edges")
    up, down = (_reached(pairs.select("src", "dst"), dataset, way, depth, most + 1).withColumn("type", F.lit(kind)) for way, kind in (("upstream", "source"), ("downstream", "derived")))
    target = log.sparkSession.range(1).select(F.lit(dataset).alias("id"), F.lit(0).alias("depth"), F.lit("target").alias("type"))
    both = up.unionByName(down).select(F.col("dataset").alias("id"), "depth", "type").groupBy("id").agg(F.min("depth").alias("depth"), F.max("type").alias("type"))
    nodes = materialize(target.unionByName(both.where(F.col("id") != dataset)).orderBy("depth", "id").limit(most + 1), "nodes")
    cut = nodes.count() > most
    kept = nodes.orderBy("depth", "id").limit(most)
    ids = kept.select("id")
    inner = pairs.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return kept, inner.select("src", "dst", "operation"), cut


class Lineage:
    """The event log as a table of a store; recording never makes the recorded action fail."""

    NAME = "_lineage_events"

    def __init__(self, store: Store) -> None:
        self.store = store

    def log(self) -> DataFrame:
        return self.store.read(self.NAME) if self.store.exists(self.NAME) else self.store.spark.createDataFrame([], EVENT)

    def record(self, dataset: str, operation: str, sources: Sequence[str] = (), actor: str = "system", version: int | None = None, metadata: Mapping | None = None, columns: Mapping[str, Sequence[str]] | None = None, at: str = "") -> str:
        """Add an event, with the columns each column was made from where they are known; its id."""
        event = uuid.uuid4().hex
        row = [(event, dataset, operation, json.dumps(list(sources)), actor, version, json.dumps(dict(metadata or {}), sort_keys=True), json.dumps({k: list(v) for k, v in (columns or {}).items()}, sort_keys=True), at)]
        df = self.store.spark.createDataFrame(row, EVENT)
        self.store.append(self.NAME, df) if self.store.exists(self.NAME) else self.store.create(self.NAME, df)
        return event

    def record_row(self, dataset: str, row: str, sources: Sequence[tuple[str, str]], operation: str = "derive", actor: str = "system", at: str = "") -> str:
        """From which rows (dataset, row) a row was made."""
        return self.record(dataset, operation, sorted({d for d, _ in sources}), actor, metadata={"level": "row", "row_id": row, "source_rows": [list(x) for x in sources]}, at=at)

    def after(self, action: Callable[[], DataFrame], dataset: str, operation: str, sources: Sequence[str] = (), **event: object) -> DataFrame:
        """Do something and record it; what goes wrong with the record is swallowed, what goes wrong with the action isn't."""
        done = action()
        with contextlib.suppress(Exception):
            self.record(dataset, operation, sources, **event)
        return done


def row_history(log: DataFrame, dataset: str, row: str) -> DataFrame:
    """``source_dataset``, ``source_row`` of the rows a row was made from."""
    body = F.from_json("metadata", "level string, row_id string, source_rows array<array<string>>")
    own = log.where(F.col("dataset_name") == dataset).select(body.alias("m")).where((F.col("m.level") == "row") & (F.col("m.row_id") == row))
    return own.select(F.explode("m.source_rows").alias("s")).select(F.col("s")[0].alias("source_dataset"), F.col("s")[1].alias("source_row")).distinct()


def lineage_statistics(log: DataFrame) -> DataFrame:
    """``events``, ``datasets`` of the whole log."""
    return log.agg(F.count("*").alias("events"), F.count_distinct("dataset_name").alias("datasets"))


def to_mermaid(edges: DataFrame, most: int = 500) -> str:
    """A small graph as text for drawing."""
    pairs = edges.orderBy("src", "dst").limit(most).collect()
    names = {n: f"n{k}" for k, n in enumerate(sorted({x for p in pairs for x in (p.src, p.dst)}))}
    return "\n".join(["graph LR", *[f'  {v}["{k}"]' for k, v in names.items()], *[f"  {names[p.src]} --> {names[p.dst]}" for p in pairs]])


def to_dot(edges: DataFrame, most: int = 500) -> str:
    return "\n".join(["digraph lineage {", *[f'  "{p.src}" -> "{p.dst}";' for p in edges.orderBy("src", "dst").limit(most).collect()], "}"])


# --- audit ---------------------------------------------------------------------------------------------------------------------

AUDITED = ("entry_id", "event_type", "dataset_name", "actor", "details", "created_at")


def signed(entries: DataFrame, key: bytes) -> DataFrame:
    """Entries with ``hmac_hash`` over their JSON with sorted keys."""
    body = F.to_json(F.struct(*[F.col(c) for c in sorted(AUDITED)]), {"ignoreNullFields": "false"})
    return entries.withColumn("hmac_hash", exprs.hmac_sha256(body, key))


def verified(entries: DataFrame, key: bytes) -> DataFrame:
    """Entries with ``valid``; without a key none is."""
    if not key:
        return entries.withColumn("valid", F.lit(False))
    again = signed(entries.withColumnRenamed("hmac_hash", "__said"), key)
    return again.withColumn("valid", F.coalesce(F.col("hmac_hash") == F.col("__said"), F.lit(False))).drop("hmac_hash").withColumnRenamed("__said", "hmac_hash")


def audit_query(entries: DataFrame, dataset: str | None = None, event_type: str | None = None, start: Column | None = None, end: Column | None = None, time: str = "created_at") -> DataFrame:
    """Entries by dataset, type and time, the end excluded."""
    found = entries
    for column, value in (("dataset_name", dataset), ("event_type", event_type)):
        found = found.where(F.col(column) == value) if value is not None else found
    found = found.where(F.col(time) >= start) if start is not None else found
    return found.where(F.col(time) < end) if end is not None else found


def replay(entries: DataFrame, dataset: str, version: int, version_column: str = "version", time: str = "created_at") -> DataFrame:
    """A dataset's entries up to a version, in the order of time; entries without a version aren't part of it."""
    return entries.where((F.col("dataset_name") == dataset) & (F.col(version_column) <= version)).orderBy(time, "entry_id")


def anomalies(events: DataFrame, time: str, keys: Sequence[str], actor: str, threshold: float = 3.0, least: int = 10) -> DataFrame:
    """``kind`` (hour, actor, off_hours), ``subject``, ``n``, ``z`` of all three detectors together."""
    subject = F.concat_ws("/", *keys, F.date_format("hour", "yyyy-MM-dd HH"))
    hours = hourly_anomalies(events, time, keys, threshold).select(F.lit("hour").alias("kind"), subject.alias("subject"), "n", "z")
    actors = actor_anomalies(events, actor, threshold).select(F.lit("actor").alias("kind"), F.col("actor").cast("string").alias("subject"), "n", "z")
    off = off_hours(events, time, actor, least=least).select(F.lit("off_hours").alias("kind"), F.col("actor").cast("string").alias("subject"), "n", F.lit(None).cast("double").alias("z"))
    return hours.unionByName(actors).unionByName(off)


def hourly_anomalies(events: DataFrame, time: str, keys: Sequence[str], threshold: float = 3.0) -> DataFrame:
    """Hours with unusually many events of their kind: ``keys``, ``hour``, ``n``, ``z`` against the kind's own hours."""
    hours = events.groupBy(*keys, F.date_trunc("hour", time).alias("hour")).agg(F.count("*").alias("n"))
    own = Window.partitionBy(*keys)  # one row per hour
    z = F.try_divide(F.col("n") - F.avg("n").over(own), F.stddev_samp("n").over(own))
    return hours.withColumn("z", F.round(z, 6)).where(F.col("z") >= threshold)


def actor_anomalies(events: DataFrame, actor: str, threshold: float = 3.0) -> DataFrame:
    """Actors with unusually many events: ``actor``, ``n``, ``z`` against all actors."""
    each = events.groupBy(F.col(actor).alias("actor")).agg(F.count("*").alias("n"))
    whole = each.agg(F.avg("n").alias("mean"), F.stddev_samp("n").alias("sd"))  # one row
    return each.join(whole).withColumn("z", F.round(F.try_divide(F.col("n") - F.col("mean"), F.col("sd")), 6)).where(F.col("z") >= threshold).select("actor", "n", "z")


def off_hours(events: DataFrame, time: str, actor: str, first: int = 0, last: int = 6, least: int = 10) -> DataFrame:
    """Actors with at least so many events between two hours (UTC): ``actor``, ``n``."""
    return events.where(F.hour(time).between(first, last)).groupBy(F.col(actor).alias("actor")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def expired(rows: DataFrame, time: str, days: int, now: Column) -> DataFrame:
    """Rows older than a retention period."""
    return rows.where(F.datediff(now, F.col(time)) > days)
