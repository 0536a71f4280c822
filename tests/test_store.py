"""The store: replace with history, merge, several tables in one commit, crashes, replays, retention."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators.store import Append, Merge, Replace, Store, purge_staged, scratch

INFO = "repo_id long, stars int"


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


@pytest.fixture
def store(spark):
    return Store(spark, scratch(spark, "store"), buckets=4)


def info(spark, *values):
    return spark.createDataFrame(list(values), INFO)


def rotate(spark, store, batch, *values):
    new = info(spark, *values)
    return store.commit([Replace("info", new, new, history="info_history")], "info", batch)


def test_rotation_keeps_the_newest_snapshot_and_all_before(spark, store):
    assert rotate(spark, store, 0, (1, 10), (2, 20))
    assert rotate(spark, store, 1, (2, 21), (3, 30))
    assert rotate(spark, store, 2, (2, 22))
    assert rows(store.table("info")) == [(1, 10), (2, 22), (3, 30)]
    assert rows(store.table("info_history")) == [(2, 20), (2, 21)]
    assert not rotate(spark, store, 2, (2, 22)) and not rotate(spark, store, 1, (2, 21), (3, 30))  # replays
    assert rows(store.table("info_history")) == [(2, 20), (2, 21)]
    assert rows(store.table("info", 0)) == [(1, 10), (2, 20)]


def test_a_stop_between_both_writes_leaves_the_state_and_a_rerun_completes_it(spark, store, monkeypatch):
    rotate(spark, store, 0, (1, 10), (2, 20))
    write, left = Store._write, [1]

    def stops(self, name, rows_, by):
        if not left[0]:
            raise RuntimeError("lost")
        left[0] -= 1
        return write(self, name, rows_, by)

    monkeypatch.setattr(Store, "_write", stops)
    with pytest.raises(RuntimeError):
        rotate(spark, store, 1, (1, 11))
    assert rows(store.table("info")) == [(1, 10), (2, 20)] and rows(store.table("info_history")) == []
    monkeypatch.setattr(Store, "_write", write)
    publish = Store._publish
    monkeypatch.setattr(Store, "_publish", lambda self, r: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        rotate(spark, store, 1, (1, 11))
    assert rows(store.table("info")) == [(1, 10), (2, 20)] and rows(store.table("info_history")) == []
    monkeypatch.setattr(Store, "_publish", publish)
    assert rotate(spark, store, 1, (1, 11))
    assert rows(store.table("info")) == [(1, 11), (2, 20)] and rows(store.table("info_history")) == [(1, 10)]
    before = len(store._names("info"))
    gone = store.vacuum(grace=-5)
    assert any(g.startswith("info/") for g in gone) and len(store._names("info")) < before
    assert rows(store.table("info")) == [(1, 11), (2, 20)] and rows(store.table("info_history")) == [(1, 10)]


def test_an_incomplete_commit_does_not_count(spark, store):
    rotate(spark, store, 0, (1, 10))
    number = max(store.commits()) + 1
    info(spark, (9, 9)).write.json(f"{store.root}/_commits/{number:012d}")
    fs, path = store._path("_commits", f"{number:012d}", "_SUCCESS")
    fs.delete(path, False)
    assert rows(store.table("info")) == [(1, 10)]
    rotate(spark, store, 1, (1, 11))
    assert rows(store.table("info")) == [(1, 11)]


def test_snapshot_replace_clears_keys_without_rows_and_ignores_rows_out_of_scope(spark, store):
    store.commit([Replace("deps", info(spark, (1, 1), (1, 2), (2, 3)), info(spark, (1, 0), (2, 0)))])
    store.commit([Replace("deps", info(spark, (3, 9)), info(spark, (1, 0)))])
    assert rows(store.table("deps")) == [(2, 3)]


def test_only_touched_buckets_are_written(spark, store):
    many = spark.range(1_000).select(F.col("id").alias("repo_id"), F.lit(1).alias("stars"))
    store.commit([Replace("info", many, many)])
    first = {(r.bucket, r.version) for r in store.manifest() if r.name == "info" and r.bucket >= 0}
    store.commit([Replace("info", info(spark, (5, 2)), info(spark, (5, 2)))])
    second = {(r.bucket, r.version) for r in store.manifest() if r.name == "info" and r.bucket >= 0}
    assert len(first) == len(second) == 4 and len(first & second) == 3
    assert store.table("info").filter("stars = 2").count() == 1 and store.table("info").count() == 1_000


def test_merge_of_several_tables_in_one_commit_with_new_columns(spark, store):
    frame = spark.createDataFrame
    store.commit([Merge("m", frame([(1, "a", "old"), (1, "b", "old")], "repo_id int, k string, v string"), ["repo_id", "k"]), Append("log", info(spark, (1, 1)))])
    new = frame([(1, "a", None, 1, 7), (1, "a", "new", 0, 8), (1, "c", "x", 0, None)], "repo_id int, k string, v string, seq int, w int")
    store.commit([Merge("m", new, ["repo_id", "k"], order=[F.desc("seq")], keep_if_null=("v",)), Append("log", info(spark, (1, 1)))])
    assert rows(store.table("m").drop("seq").na.fill({"w": -1})) == [(1, "a", "old", 7), (1, "b", "old", -1), (1, "c", "x", -1)]
    assert rows(store.table("log")) == [(1, 1), (1, 1)]


def test_vacuum_spares_what_is_young_and_what_a_kept_commit_names(spark, store):
    for i in range(3):
        rotate(spark, store, i, (1, i))
    assert store.vacuum() == []
    store.vacuum(keep=2, grace=-5)
    assert rows(store.table("info", store.commits()[0])) == [(1, 1)] and rows(store.table("info")) == [(1, 2)]
    with pytest.raises(ValueError, match="no table"):
        store.table("none")


def test_staged_files_go_once_processed_and_old(spark, tmp_path):
    for name, age in (("a.json", 8), ("b.json", 8), ("c.json", 1)):
        (tmp_path / name).write_text("{}")
        os.utime(tmp_path / name, (1e9 - age * 86_400,) * 2)
    done = spark.createDataFrame([(f"file:{tmp_path}/a.json",), (f"file:{tmp_path}/c.json",)], "path string")
    assert purge_staged(spark, f"file://{tmp_path}", done, now=1e9) == ["a.json"]
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["b.json", "c.json"]
