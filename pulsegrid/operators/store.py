"""Tables kept as bucketed Parquet versions behind one commit point.

Rows lie in buckets of the hash of a key column. A commit writes new versions of the touched buckets only, of as many
tables as it changes, and then one small manifest that names all live versions; the newest complete manifest is the
state. Whatever stops before the manifest leaves the state as it was, and what was written is named by nothing until
``vacuum`` removes it. Each writer numbers its batches, and a batch that the state already holds is not applied again,
so a replay neither rotates rows into the history twice nor appends them twice. One writer at a time.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .merge import dedupe, upsert

MANIFEST = "name string, bucket int, version string, rows long, schema string"
BUCKETS = 64


@dataclass
class Replace:
    """Rows of the keys in ``scope`` give way to ``rows``; with ``history`` they move to that table first."""

    name: str
    rows: DataFrame
    scope: DataFrame
    by: str = "repo_id"
    history: str | None = None


@dataclass
class Merge:
    """Upsert by ``keys``; the last of several new rows of a key, by ``order``, counts. Null keys equal nothing.

    ``scope`` may name the values of ``by`` in the rows, and more, where that is cheaper than to work out the rows.
    """

    name: str
    rows: DataFrame
    keys: list[str]
    by: str = "repo_id"
    order: list[Column] | None = None
    keep_if_null: tuple[str, ...] = ()
    update: list[str] | None = None
    scope: DataFrame | None = None


@dataclass
class Append:
    """New rows beside the old ones."""

    name: str
    rows: DataFrame
    by: str = "repo_id"


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root, buckets

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, *parts: str) -> list[tuple[str, int]]:
        """Names and times of a folder's entries."""
        fs, path = self._path(*parts)
        return [(f.getPath().getName(), f.getModificationTime()) for f in fs.listStatus(path)] if fs.exists(path) else []

    def commits(self) -> list[int]:
        """Numbers of the complete commits; one that was cut short does not count."""

        def whole(number: str) -> bool:
            fs, path = self._path("_commits", number, "_SUCCESS")
            return fs.exists(path)

        return sorted(int(n) for n, _ in self._names("_commits") if n.isdigit() and whole(n))

    def manifest(self, number: int | None = None) -> list:
        """Rows of a commit, of the newest if none is named: metadata, a row for each bucket's live version."""
        number = max(self.commits(), default=None) if number is None else number
        return [] if number is None else self.spark.read.schema(MANIFEST).json(f"{self.root}/_commits/{number:012d}").collect()

    def _rows(self, live: list, name: str, buckets: set[int] | None = None, like: DataFrame | None = None) -> DataFrame | None:
        """The table's rows in the buckets (all, if None), with the columns of ``like`` if given; None if unknown."""
        schema = next((StructType.fromJson(json.loads(r.schema)) for r in live if r.name == name and r.bucket == -1), None)
        if schema is None:
            return None if like is None else self.spark.createDataFrame([], like.schema)
        paths = [f"{self.root}/{name}/{r.version}/bucket={r.bucket}" for r in live if r.name == name and r.bucket >= 0 and (buckets is None or r.bucket in buckets)]
        out = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        for f in like.schema if like is not None else ():
            if f.name not in out.columns:
                out = out.withColumn(f.name, F.lit(None).cast(f.dataType))
        return out

    def table(self, name: str, number: int | None = None) -> DataFrame:
        """A table as the newest commit has it, or as that of the number had it."""
        rows = self._rows(self.manifest(number), name)
        if rows is None:
            raise ValueError(f"no table {name}")
        return rows

    def _bucket(self, by: str) -> Column:
        return F.pmod(F.xxhash64(F.col(by).cast("string")), F.lit(self.buckets)).cast("int")

    def _touched(self, rows: DataFrame, by: str) -> set[int]:
        """Buckets of the rows: at most as many as there are buckets."""
        return {r.b for r in rows.select(self._bucket(by).alias("b")).distinct().collect()}

    def _write(self, name: str, rows: DataFrame, by: str) -> list[tuple]:
        """Writes a version and gives its manifest rows. Buckets are rebalanced: large ones part, small ones share a task."""
        version = uuid.uuid4().hex
        rows.withColumn("bucket", self._bucket(by)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.root}/{name}/{version}")
        found = [int(n.split("=")[1]) for n, _ in self._names(name, version) if n.startswith("bucket=")]
        return [(name, b, version, None, None) for b in found]

    def _publish(self, rows: list[tuple]) -> None:
        number = max(self.commits(), default=-1) + 1
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self.root}/_commits/{number:012d}")

    def applied(self, writer: str, batch: int, live: list | None = None) -> bool:
        return any(r.name == f"__writer {writer}" and r.rows >= batch for r in (self.manifest() if live is None else live))

    def commit(self, changes: list[Replace | Merge | Append], writer: str = "", batch: int | None = None) -> bool:
        """Applies all changes at once. False: the state already holds the writer's batch."""
        live = self.manifest()
        if batch is not None and self.applied(writer, batch, live):
            return False
        now = {(r.name, r.bucket, r.version): tuple(r) for r in live}
        schemas: dict[str, StructType] = {}

        def put(name: str, rows: DataFrame, by: str, instead_of: set[int]) -> None:
            for key in [k for k in now if k[0] == name and k[1] in instead_of]:
                del now[key]
            now.update({(n, b, v): (n, b, v, k, s) for n, b, v, k, s in self._write(name, rows, by)})
            schemas[name] = rows.schema

        for c in changes:
            if isinstance(c, Append):
                old = self._rows(live, c.name, set(), c.rows)
                put(c.name, old.unionByName(c.rows, allowMissingColumns=True), c.by, set())
                continue
            touched = self._touched(c.rows if c.scope is None else c.scope, c.by)
            old = self._rows(live, c.name, touched, c.rows)
            if isinstance(c, Merge):
                new = dedupe(c.rows, c.keys, c.order or [F.lit(0)])
                new = new.select(*c.keys, *(x for x in c.rows.columns if x not in c.keys))
                for f in old.schema:
                    if f.name not in new.columns:
                        new = new.withColumn(f.name, F.lit(None).cast(f.dataType))
                put(c.name, upsert(old, new, c.keys, c.update, c.keep_if_null), c.by, touched)
                continue
            scope = c.scope.select(c.by).distinct()
            fresh = c.rows.join(scope, c.by, "left_semi")
            put(c.name, old.join(scope, c.by, "left_anti").unionByName(fresh, allowMissingColumns=True), c.by, touched)
            if c.history:
                put(c.history, old.join(scope, c.by, "left_semi"), c.by, set())
        for name, schema in schemas.items():
            for key in [k for k in now if k[0] == name and k[1] == -1]:
                del now[key]
            now[name, -1, ""] = (name, -1, "", None, schema.json())
        if batch is not None:
            now[f"__writer {writer}", -2, ""] = (f"__writer {writer}", -2, "", batch, None)
        self._publish(list(now.values()))
        return True

    def vacuum(self, keep: int = 1, grace: float = 3600) -> list[str]:
        """Removes commits but the newest ``keep`` and versions that none of these names.

        What is younger than ``grace`` seconds stays: it may belong to a commit under way.
        """
        numbers, before, gone = self.commits(), (time.time() - grace) * 1000, []
        kept = numbers[-max(1, keep) :]
        named = {(r.name, r.version) for n in kept for r in self.manifest(n) if r.bucket >= 0}
        for n, at in self._names("_commits"):
            if at <= before and n.isdigit() and int(n) not in kept and (not kept or int(n) < kept[-1]):
                gone.append(f"_commits/{n}")
        for name, _ in self._names():
            gone += [f"{name}/{v}" for v, at in self._names(name) if name != "_commits" and at <= before and (name, v) not in named]
        for g in gone:
            fs, path = self._path(g)
            fs.delete(path, True)
        return gone


def purge_staged(spark: SparkSession, folder: str, done: DataFrame, days: float = 7, now: float | None = None) -> list[str]:
    """Removes staged files older than so many days that ``done`` (path) names as processed; gives their names."""
    store, old = Store(spark, folder), ((now or time.time()) - days * 86_400) * 1000
    listed = [(n, at) for n, at in store._names() if not n.startswith(("_", ".")) and at <= old]
    if not listed:
        return []
    names = spark.createDataFrame(listed, "name string, at long").select("name")
    gone = sorted(r.name for r in names.join(done.select(F.element_at(F.split("path", "/"), -1).alias("name")), "name", "left_semi").collect())
    for n in gone:
        fs, path = store._path(n)
        fs.delete(path, True)
    return gone


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.conf.get("spark.master", "").split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        base = f"file://{tempfile.gettempdir()}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
