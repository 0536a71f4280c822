"""References resolved before a diff, cursors, landscape trees."""

from __future__ import annotations

import json

import pytest

from pulsegrid.functions import scalars as S
from pulsegrid.operators import cursors, diff
from pulsegrid.operators.store import Store, scratch
from pulsegrid.sources import scans


def test_parents_come_first_and_cycles_are_refused():
    a, b, c = diff.Spec("a", ["k"], "id", {"p": "b"}), diff.Spec("b", ["k"], "id", {"q": "c", "self": "elsewhere"}), diff.Spec("c", ["k"], "id")
    assert [s.name for s in diff.in_order([a, b, c])] == ["c", "b", "a"]
    with pytest.raises(ValueError, match="cycle"):
        diff.in_order([diff.Spec("a", ["k"], "id", {"p": "b"}), diff.Spec("b", ["k"], "id", {"p": "a"})])


def test_same_rows_with_other_ids_are_equal(spark):
    frame = spark.createDataFrame
    specs = [diff.Spec("pulls", ["repo", "number"], "id", {"repo": "repos", "author": "people"}), diff.Spec("repos", ["git"], "id"), diff.Spec("people", ["login"], "id")]
    copy = lambda k, title="t": {
        "repos": frame([(k, "g")], "id int, git string"), "people": frame([(k, "ann")], "id int, login string"),
        "pulls": frame([(k, k, 1, k, title), (k + 1, k, 2, None, "u"), (k + 2, k, 3, 99, "v")], "id int, repo int, number int, author int, title string"),
    }
    assert diff.compare(copy(1), copy(7), specs).collect() == []
    assert [tuple(r) for r in diff.compare(copy(1), copy(7, "other"), specs).collect()] == [("pulls", "g|1", "content")]
    lost = copy(7) | {"people": frame([], "id int, login string")}
    assert sorted(tuple(r) for r in diff.compare(copy(1), lost, specs).collect()) == [("people", "ann", "missing"), ("pulls", "g|1", "content")]
    assert [r.author for r in diff.resolve(copy(1), specs)["pulls"].orderBy("number").collect()] == ["ann", None, "<missing:author=99>"]


def test_appending_is_idempotent_and_never_looks_behind_the_mark(spark):
    store = Store(spark, scratch(spark, "cursor"), buckets=2)
    events = lambda *rows: spark.createDataFrame([(i, a, f"2024-01-{d:02d}") for i, a, d in rows], "id long, who string, at string")
    put = lambda batch, *rows: cursors.append_new(store, "ev", events(*rows), "id", "who", "at", "w", batch)
    assert put(0, (1, "a", 1), (2, "a", 3), (3, "b", 2), (3, "b", 2))
    assert not put(0, (1, "a", 1))
    assert put(1, (9, "a", 2), (2, "a", 3), (4, "a", 3), (5, "b", 9), (6, "c", 1))
    assert sorted(r.id for r in store.table("ev").collect()) == [1, 2, 3, 4, 5, 6]  # 9 is behind the mark, 2 was there
    assert {r.who: r.at for r in store.table("ev_marks").collect()} == {"a": "2024-01-03", "b": "2024-01-09", "c": "2024-01-01"}
    assert put(2) and store.table("ev").count() == 6


def test_bad_times(spark):
    rows = spark.sql("select timestamp_ntz'1969-12-31 00:00:00' as a, timestamp_ntz'1970-01-01 00:00:00' as b, cast(null as timestamp_ntz) as c")
    assert [x is None for x in S.without_bad_times(rows, ["a", "b", "c"]).first()] == [True, False, True]
    now = spark.sql("select timestamp_ntz'2024-01-01 00:00:00' as n").first().n
    from pyspark.sql import functions as F

    assert [x == now for x in S.without_bad_times(rows, ["a", "c"], instead=F.lit(now)).select("a", "c").first()] == [True, False]


def test_landscape(spark):
    item = lambda **x: {"name": "n", "homepage_url": "h"} | x
    tree = {
        "landscape": [
            {"category": 1, "subcategories": [{"items": [item(project="sandbox", repo_url="https://github.com/A/B.git", additional_repos=[{"repo_url": ""}, {"repo_url": "https://github.com/a/c/"}]), item(project="archived", repo_url="https://github.com/x/y"), item(repo_url="https://github.com/x/z")]}]},
            {"subcategories": [{"items": [item(project="graduated", name=7, repo_url=None), item(project="graduated", name="g", repo_url=" ", additional_repos=[{"repo_url": "https://github.com/q/r"}]), item(project="incubating", repo_url="https://github.com/k/k", additional_repos="no list")]}, {"items": None}]},
        ]
    }
    rows = scans.landscape_projects(spark.createDataFrame([(json.dumps(tree),), ("{broken",), (None,), ("{}",)], "json string")).collect()
    got = sorted((r.status, r.name, len(r.repos)) for r in rows)
    assert got == [("graduated", "g", 1), ("incubating", "n", 1), ("sandbox", "n", 2)]
