"""Versioned tables: immutable Parquet folders and a manifest per table.

``<root>/<name>/_manifest.json`` has the versions, each a list of folders; an append only writes its own rows, while an
update, upsert or delete writes a new folder. Branches, tags and rollbacks are edits of the manifest.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.guards import Rejected, check_name, check_where

PROTECTED = "sys_"
_WIDER = {("byte", "short"), ("byte", "integer"), ("byte", "long"), ("short", "integer"), ("short", "long"), ("integer", "long"), ("float", "double"), ("integer", "double")}


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    # files
    def _fs(self, path: str):  # noqa: ANN202
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _manifest(self, name: str) -> dict:
        fs, p = self._fs(f"{self.root}/{check_name(name)}/_manifest.json")
        if not fs.exists(p):
            raise Rejected(f"no such table: {name}")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.java.lang.String(stream.readAllBytes(), "UTF-8"))
        finally:
            stream.close()

    def _save(self, name: str, manifest: dict) -> None:
        """Written beside the old one, then renamed over it."""
        fs, p = self._fs(f"{self.root}/{name}/_manifest.json")
        _, new = self._fs(f"{self.root}/{name}/_manifest-{uuid.uuid4().hex}.json")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if fs.exists(p):
            fs.delete(p, False)
        if not fs.rename(new, p):
            raise OSError(f"the manifest of {name} can't be replaced")

    # catalog
    def exists(self, name: str) -> bool:
        fs, p = self._fs(f"{self.root}/{check_name(name)}/_manifest.json")
        return fs.exists(p)

    def names(self, admin: bool = False) -> list[str]:
        fs, p = self._fs(self.root)
        found = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(n for n in found if self._fs(f"{self.root}/{n}/_manifest.json")[0].exists(self._fs(f"{self.root}/{n}/_manifest.json")[1]) and (admin or n[:1] != "_"))

    def catalog(self, admin: bool = False) -> DataFrame:
        """``name``, ``version``, ``num_rows``, ``num_columns``, ``created_at``, ``updated_at``."""
        rows = []
        for n in self.names(admin):
            m = self._manifest(n)
            head = self._version(m)
            rows.append((n, head["id"], head["rows"], len(T.StructType.fromJson(head["schema"])), m["versions"][0]["ts"], head["ts"]))
        return self.spark.createDataFrame(rows, "name string, version bigint, num_rows bigint, num_columns int, created_at double, updated_at double")

    @staticmethod
    def _version(manifest: dict, version: int | str | None = None) -> dict:
        if isinstance(version, str):
            version = manifest["tags"].get(version, manifest["branches"].get(version))
            if version is None:
                raise Rejected("no such tag or branch")
        wanted = manifest["head"] if version is None else version
        for v in manifest["versions"]:
            if v["id"] == wanted:
                return v
        raise Rejected(f"no such version: {wanted}")

    def _load(self, version: dict) -> DataFrame:
        schema = T.StructType.fromJson(version["schema"])
        parts = [self.spark.read.parquet(p) for p in version["folders"]]
        if not parts:
            return self.spark.createDataFrame([], schema)
        same = [p.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name, metadata=f.metadata) if f.name in p.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]) for p in parts]
        return reduce(DataFrame.unionByName, same)

    def read(self, name: str, version: int | str | None = None, columns: Sequence[str] | None = None, where: str | None = None) -> DataFrame:
        """The table at its head, a version, a tag or a branch; columns and filter reach the files."""
        df = self._load(self._version(self._manifest(name), version))
        df = df.where(F.expr(check_where(where))) if where else df
        return df.select(*columns) if columns else df

    def _commit(self, name: str, df: DataFrame | None, op: str, keep: Sequence[str] = (), schema: T.StructType | None = None, manifest: dict | None = None) -> DataFrame:
        m = manifest or {"head": 0, "versions": [], "tags": {}, "branches": {}}
        new = max([v["id"] for v in m["versions"]], default=0) + 1
        folders, rows = list(keep), 0
        if df is not None:
            folder = f"{self.root}/{name}/v{new}-{uuid.uuid4().hex[:8]}"
            df.write.parquet(folder)
            folders.append(folder)
        record = {"id": new, "ts": time.time(), "op": op, "folders": folders, "schema": json.loads((schema or df.schema).json()), "rows": 0}
        record["rows"] = sum(self.spark.read.parquet(f).count() for f in folders)  # the footers have it
        m["versions"].append(record)
        m["head"] = new
        self._save(name, m)
        return self._load(record)

    # writing
    def create(self, name: str, df: DataFrame) -> DataFrame:
        if self.exists(name):
            raise Rejected(f"there is a table {name} already")
        return self._commit(check_name(name), df, "create")

    def append(self, name: str, df: DataFrame, document: str | None = None) -> DataFrame:
        """Rows are added; their new columns are null before, columns they lack are null in them.

        Given the name of a document column, the rows of documents that come again replace those before.
        """
        m = self._manifest(name)
        head = self._version(m)
        old = T.StructType.fromJson(head["schema"])
        schema = T.StructType([*old.fields, *[f for f in df.schema if f.name not in old.names]])
        aligned = df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
        if document and document in old.names:
            kept = self._load(head).join(df.select(document).distinct(), document, "left_anti")
            return self._commit(name, kept.unionByName(aligned, allowMissingColumns=True).select(*schema.names), "append", schema=schema, manifest=m)
        return self._commit(name, aligned, "append", head["folders"], schema, m)

    def upsert(self, name: str, df: DataFrame, key: str) -> DataFrame:
        """Rows of known keys replace the old ones, others are added; the table is created where there is none."""
        if not self.exists(name):
            return self.create(name, df)
        m = self._manifest(name)
        old = self._load(self._version(m))
        kept = old.join(df.select(key), key, "left_anti")
        return self._commit(name, kept.unionByName(df, allowMissingColumns=True), "upsert", manifest=m)

    def delete(self, name: str, where: str) -> int:
        m = self._manifest(name)
        old = self._load(self._version(m))
        hit = F.coalesce(F.expr(check_where(where)), F.lit(False))
        before = self._version(m)["rows"]
        self._commit(name, old.where(~hit), "delete", manifest=m)
        return before - self._version(self._manifest(name))["rows"]

    def update(self, name: str, where: str, values: Mapping[str, str]) -> DataFrame:
        """Values are SQL expressions of the old row."""
        m = self._manifest(name)
        old = self._load(self._version(m))
        hit = F.coalesce(F.expr(check_where(where)), F.lit(False))
        if missing := set(values) - set(old.columns):
            raise Rejected(f"no such column: {sorted(missing)}")
        kinds = {f.name: f.dataType for f in old.schema}
        changed = old.select(*[F.when(hit, F.expr(check_where(values[c])).cast(kinds[c])).otherwise(F.col(f"`{c}`")).alias(c) if c in values else F.col(f"`{c}`") for c in old.columns])
        return self._commit(name, changed, "update", manifest=m)

    def overwrite(self, name: str, df: DataFrame) -> DataFrame:
        return self._commit(name, df, "restore", manifest=self._manifest(name))

    # columns
    def add_column(self, name: str, column: str, default: str) -> DataFrame:
        old = self.read(name)
        if check_name(column) in old.columns:
            raise Rejected(f"there is a column {column} already")
        return self.overwrite(name, old.withColumn(column, F.expr(check_where(default))))

    def add_columns(self, name: str, extra: DataFrame, key: str) -> DataFrame:
        """Columns made elsewhere, matched by a key."""
        return self.overwrite(name, self.read(name).join(extra, key, "left"))

    def alter_column(self, name: str, column: str, kind: str) -> DataFrame:
        """Only to a wider type."""
        old = self.read(name)
        now, new = old.schema[column].dataType, T._parse_datatype_string(kind)
        if now != new and (now.typeName(), new.typeName()) not in _WIDER:
            raise Rejected(f"{now.simpleString()} can't become {kind} without loss")
        return self.overwrite(name, old.withColumn(column, F.col(column).cast(new)))

    def drop_column(self, name: str, column: str, indexed: Sequence[str] = ()) -> DataFrame:
        old = self.read(name)
        if column not in old.columns:
            raise Rejected(f"no such column: {column}")
        if column in indexed:
            raise Rejected(f"an index needs {column}")
        return self.overwrite(name, old.drop(column))

    def comment(self, name: str, comments: Mapping[str, str]) -> None:
        m = self._manifest(name)
        for f in self._version(m)["schema"]["fields"]:
            if f["name"] in comments:
                f["metadata"] = {**f.get("metadata", {}), "comment": comments[f["name"]]}
        self._save(name, m)

    # versions
    def versions(self, name: str) -> DataFrame:
        m = self._manifest(name)
        return self.spark.createDataFrame([(v["id"], v["op"], v["ts"], v["rows"], v["id"] == m["head"]) for v in m["versions"]], "version bigint, op string, ts double, num_rows bigint, is_head boolean")

    def tag(self, name: str, label: str, version: int | None = None) -> None:
        self._mark(name, "tags", label, version)

    def branch(self, name: str, label: str, version: int | None = None) -> None:
        self._mark(name, "branches", label, version)

    def _mark(self, name: str, kind: str, label: str, version: int | None) -> None:
        m = self._manifest(name)
        if label in m[kind]:
            raise Rejected(f"{label} is taken")
        m[kind][label] = self._version(m, version)["id"]
        self._save(name, m)

    def unmark(self, name: str, kind: str, label: str) -> None:
        m = self._manifest(name)
        if m[kind].pop(label, None) is None:
            raise Rejected(f"no such label: {label}")
        self._save(name, m)

    def marks(self, name: str, kind: str = "tags") -> dict[str, int]:
        return self._manifest(name)[kind]

    def checkpoint(self, name: str) -> str:
        head = self._manifest(name)["head"]
        label = f"pre-step-v{head}"
        if label not in self.marks(name):
            self.tag(name, label)
        return label

    def rollback(self, name: str, version: int | str) -> DataFrame:
        """The head points to an old version again; nothing is copied or lost."""
        m = self._manifest(name)
        m["head"] = self._version(m, version)["id"]
        self._save(name, m)
        return self.read(name)

    def diff(self, name: str, old: int | str, new: int | str) -> DataFrame:
        """``added``, ``removed`` (rows by content), ``net_added``, ``net_removed`` (by count), ``columns_added``, ``columns_removed``."""
        a, b = self.read(name, old), self.read(name, new)
        shared = [c for c in a.columns if c in b.columns]
        plus, minus = b.select(*shared).exceptAll(a.select(*shared)), a.select(*shared).exceptAll(b.select(*shared))
        counts = plus.agg(F.count("*").alias("added")).join(minus.agg(F.count("*").alias("removed")))
        m = self._manifest(name)
        net = self._version(m, new)["rows"] - self._version(m, old)["rows"]
        lists = [F.array(*[F.lit(c) for c in x]).cast("array<string>") for x in ([c for c in b.columns if c not in a.columns], [c for c in a.columns if c not in b.columns])]
        return counts.select("added", "removed", F.lit(max(0, net)).alias("net_added"), F.lit(max(0, -net)).alias("net_removed"), lists[0].alias("columns_added"), lists[1].alias("columns_removed"))

    def cleanup(self, name: str, older_s: float, dry_run: bool = False, now: float | None = None) -> list[int]:
        """Versions older than that go, unless they are the head, tagged or branched; folders no version needs are deleted."""
        m = self._manifest(name)
        now = time.time() if now is None else now
        safe = {m["head"], *m["tags"].values(), *m["branches"].values()}
        gone = [v for v in m["versions"] if v["ts"] < now - older_s and v["id"] not in safe]
        if not dry_run and gone:
            m["versions"] = [v for v in m["versions"] if v not in gone]
            kept = {f for v in m["versions"] for f in v["folders"]}
            self._save(name, m)
            for f in {f for v in gone for f in v["folders"]} - kept:
                fs, p = self._fs(f)
                fs.delete(p, True)
        return [v["id"] for v in gone]

    def compact(self, name: str, rows_per_file: int = 1_000_000) -> dict[str, int]:
        """The head's rows in as few files as they need; how many folders there were."""
        m = self._manifest(name)
        head = self._version(m)
        before = len(head["folders"])
        self._commit(name, self._load(head).repartition(max(1, -(-head["rows"] // rows_per_file))), "compact", manifest=m)
        return {"folders_before": before, "folders_after": 1}

    def maintain(self, fragments: int = 20, retention_s: float = 7 * 86_400) -> dict[str, list[str]]:
        done: dict[str, list[str]] = {}
        for n in self.names(admin=True):
            if len(self._version(self._manifest(n))["folders"]) > fragments:
                self.compact(n)
                done.setdefault(n, []).append("compacted")
            if self.cleanup(n, retention_s):
                done.setdefault(n, []).append("cleaned")
        return done

    # whole tables
    def drop(self, name: str, cascade: Sequence[str] = ()) -> None:
        if name.startswith(PROTECTED):
            raise Rejected(f"{name} is protected")
        for n in (name, *[c for c in cascade if self.exists(c)]):
            fs, p = self._fs(f"{self.root}/{check_name(n)}")
            fs.delete(p, True)

    def rename(self, name: str, to: str) -> None:
        self.copy(name, to)
        self.drop(name)

    def copy(self, name: str, to: str, version: int | str | None = None) -> DataFrame:
        return self.create(to, self.read(name, version))

    def merge(self, names: Sequence[str], to: str) -> DataFrame:
        """Rows of tables with the same schema."""
        parts = [self.read(n) for n in names]
        if any(p.schema != parts[0].schema for p in parts):
            raise Rejected("the schemas differ")
        return self.create(to, reduce(DataFrame.unionByName, parts))

    def backup(self, name: str, path: str) -> DataFrame:
        """A copy of the head with a list of its files and their hashes: ``path``, ``sha256``."""
        self.read(name).write.mode("errorifexists").parquet(f"{path}/data")
        files = self.file_hashes(f"{path}/data")
        files.coalesce(1).write.json(f"{path}/hashes")
        return self.spark.read.json(f"{path}/hashes")

    def file_hashes(self, path: str) -> DataFrame:
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
        return files.select(F.element_at(F.split("path", "/"), -1).alias("path"), F.sha2("content", 256).alias("sha256"))

    def verify_backup(self, path: str) -> bool:
        said = self.spark.read.schema("path string, sha256 string").json(f"{path}/hashes")
        return self.file_hashes(f"{path}/data").exceptAll(said).isEmpty() and said.exceptAll(self.file_hashes(f"{path}/data")).isEmpty()

    def restore(self, name: str, path: str) -> DataFrame:
        if not self.verify_backup(path):
            raise Rejected("the backup's files aren't what they were")
        data = self.spark.read.parquet(f"{path}/data")
        return self.overwrite(name, data) if self.exists(name) else self.create(name, data)


def schema_diff(spark: SparkSession, old: T.StructType, new: T.StructType) -> DataFrame:
    """``column``, ``change`` (added, removed, type), ``old_type``, ``new_type``."""
    a, b = ({f.name: f.dataType.simpleString() for f in s} for s in (old, new))
    rows = [(c, "added", None, b[c]) for c in b if c not in a] + [(c, "removed", a[c], None) for c in a if c not in b] + [(c, "type", a[c], b[c]) for c in a if c in b and a[c] != b[c]]
    return spark.createDataFrame(rows, "column string, change string, old_type string, new_type string")


def null_embeddings(df: DataFrame, column: str) -> Column:
    """Rows still to be embedded."""
    return F.col(column).isNull() | (F.size(column) == 0)
