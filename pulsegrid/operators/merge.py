"""Merge semantics on DataFrames: upsert, null-preserving upsert, insert-if-absent, history and dedupe.

The results are new tables; swapping them in is the sink's business and is not transactional.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], update: list[str] | None = None, keep_if_null: tuple[str, ...] = ()) -> DataFrame:
    """Rows by key: ``update`` columns (all, if None) come from ``new``, others from the first row seen.

    A column in ``keep_if_null`` keeps its old value where the new one is null. ``new`` holds a key once.
    """
    a, b = old.withColumn("__old", F.lit(True)).alias("a"), new.withColumn("__new", F.lit(True)).alias("b")
    both = a.join(b, keys, "full_outer")

    def pick(c: str):
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        if c in keep_if_null:
            return F.coalesce(y, x).alias(c)
        if update is None or c in update:
            return F.when(F.col("__new"), y).otherwise(x).alias(c)
        return F.when(F.col("__old"), x).otherwise(y).alias(c)

    return both.select(*keys, *(pick(c) for c in old.columns if c not in keys))


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def dedupe(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def latest(history: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row per key, by one aggregation."""
    rest = [c for c in history.columns if c not in keys]
    best = history.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def merge_contributors(rows: DataFrame) -> DataFrame:
    """Per login: longest address, first non-empty name and company (by seq), all identities."""
    first = lambda c: F.min_by(F.nullif(F.trim(c), F.lit("")), F.when(F.trim(c) != "", F.col("seq"))).alias(c)
    return rows.groupBy("login").agg(F.max_by("email", F.struct(F.length("email"), "email")).alias("email"), first("name"), first("company"), F.array_sort(F.collect_set("identity")).alias("identities"))


def resolve_parents(edges: DataFrame, commits: DataFrame) -> DataFrame:
    """Commit parents by hash within the repository; unknown parents are left out."""
    c = commits.select("repo_id", "hash").distinct()
    return edges.join(c.withColumnRenamed("hash", "parent_hash"), ["repo_id", "parent_hash"], "left_semi").join(c, ["repo_id", "hash"], "left_semi")


def backfill(rows: DataFrame, lookup: DataFrame, key: str, column: str) -> DataFrame:
    """Fill missing or empty values of a column from a lookup that may repeat keys (smallest value wins)."""
    one = lookup.groupBy(key).agg(F.min(column).alias("__v"))
    return rows.join(one, key, "left").withColumn(column, F.coalesce(F.nullif(F.col(column), F.lit("")), F.col("__v"))).drop("__v")
