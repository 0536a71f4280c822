"""Repositories and what hangs on them, on authored rows; the JDBC read on its projection."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from pulsegrid.functions import scalars as S
from pulsegrid.operators import catalog
from pulsegrid.operators.store import Store, scratch
from pulsegrid.sources import bundles, manifests

REPO = "repo_id long, repo_group_id long, repo_git string, repo_name string, repo_owner string, repo_description string, primary_language string, forked_from string, repo_archived boolean, created_at timestamp_ntz, updated_at timestamp_ntz"
GROUP = "repo_group_id long, rg_name string, rg_type string, rg_website string, rg_description string"


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def test_numbers_are_unique_stable_and_above_the_old_ones(spark):
    old, new = spark.range(7).withColumnRenamed("id", "n"), spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    once = {r["key"]: r["n"] for r in catalog.numbered(new, old, "n", "key").collect()}
    again = {r["key"]: r["n"] for r in catalog.numbered(new.repartition(13), old, "n", "key").collect()}
    assert once == again and len(set(once.values())) == 20_000 and min(once.values()) > 6
    assert catalog.numbered(new.limit(0), old, "n", "key").count() == 0
    assert rows(catalog.numbered(new.limit(1), old.limit(0), "n", "key"), "n")[0][0] > 0


def test_groups_are_made_once_by_name_and_type(spark):
    old = spark.createDataFrame([(4, "g", "org", "w", "d")], GROUP)
    wanted = spark.createDataFrame([("g", "org", "x"), ("g", "user", "b"), ("g", "user", "a"), ("h", None, None), ("h", "", "z"), (None, "org", "")], "rg_name string, rg_type string, rg_website string")
    got = catalog.add_groups(old, wanted)
    assert rows(got.filter("rg_name = 'g'"), "rg_type", "rg_website", "rg_description") == [("org", "w", "d"), ("user", "a", "Auto-created from a")]
    assert got.filter("repo_group_id > 4").count() == got.count() - 1
    assert catalog.add_groups(got, wanted).count() == got.count()


def test_repositories_keep_id_and_group_and_lose_the_suffix(spark):
    groups = spark.createDataFrame([(9, catalog.DEFAULT_GROUP, "", "", "")], GROUP)
    old = spark.createDataFrame([(1, 3, "u1", "a", "o", "old", "C", None, False, None, None)], REPO)
    new = spark.createDataFrame(
        [(0, "u1", "a.git", "o", "new", "Go", None, True, None, None, 1), (0, "u2", "b.git/", "o", None, None, None, False, None, None, 1), (5, "u2", "c", "p", None, None, None, False, None, None, 2), (None, "u3", " d ", "o", None, None, None, None, None, None, 1), (1, None, "e", "o", None, None, None, None, None, None, 1)],
        REPO.replace("repo_id long, ", "") + ", seq long",
    )
    got = catalog.add_repos(old, new, groups)
    assert rows(got, "repo_git", "repo_group_id", "repo_name", "repo_owner") == [("u1", 3, "a", "o"), ("u2", 5, "c", "p"), ("u3", 9, "d", "o")]
    one = got.filter("repo_git = 'u1'").first()
    assert (one["repo_id"], one["repo_description"], one["primary_language"], one["repo_archived"]) == (1, "new", "Go", True)
    moved = catalog.move_repos(got, spark.createDataFrame([(1, "https://h/x/y/z.git/"), (77, "https://h/n/o")], "repo_id long, url string"))
    assert rows(moved.filter("repo_id = 1"), "repo_git", "repo_owner", "repo_name") == [("https://h/x/y/z", "x/y", "z")]
    assert rows(catalog.move_repos(old, spark.createDataFrame([(1, "short")], "repo_id long, url string")), "repo_git", "repo_owner", "repo_name") == [("short", "", "")]
    gone = spark.createDataFrame([(1,), (1,)], "repo_id long")
    assert rows(catalog.archive(old, gone), "repo_id", "repo_archived") == [(1, True)] and catalog.dequeue(old, gone).count() == 0


def test_status_keeps_what_a_change_leaves_empty(spark):
    store = Store(spark, scratch(spark, "status"), buckets=2)
    schema = "repo_id long, " + ", ".join(f"{p}_status string, {p}_task_id string, {p}_data_last_collected timestamp_ntz" for p in catalog.PHASES) + ", seq long"
    row = lambda core, ml: spark.createDataFrame([(1, core, None, None, "", None, None, "", None, None, ml, None, None, 1)], schema)
    for batch, args in enumerate((("Success", None), ("", "Error"))):
        store.commit([catalog.status_changes(row(*args))], "s", batch)
    got = catalog.collection_status(spark.createDataFrame([(1,), (2,)], "repo_id long"), store.table("collection_status"))
    assert rows(got, "repo_id", "core_status", "facade_status", "ml_status", "ml_task_id") == [(1, "Success", "Pending", "Error", ""), (2, "Pending", "Pending", "Pending", "")]


def test_release_merge_replays_to_the_same_table(spark):
    store = Store(spark, scratch(spark, "releases"), buckets=2)
    schema = "repo_id long, release_id long, release_name string, release_description string, release_author string, updated_at timestamp_ntz, seq long"
    make = lambda *r: catalog.releases(spark.createDataFrame(list(r), schema))
    assert store.commit([make((1, 5, "a\x00", None, "x", None, 1), (1, 5, "b", "d", "y", None, 2))], "r", 0)
    assert store.commit([make((1, 5, "c", "e", "z", None, 1), (2, 5, "q", None, "z", None, 1))], "r", 1)
    assert not store.commit([make((1, 5, "lost", "e", "z", None, 1))], "r", 1)
    assert rows(store.table("releases").fillna(""), "repo_id", "release_name", "release_description", "release_author") == [(1, "c", "e", "y"), (2, "q", "", "z")]


def test_profiles_that_cannot_be_found_are_not_asked_again(spark):
    people = spark.createDataFrame([("1", "a", "", None, None, None, None), ("2", "b", "C", "", "", None, None), ("3", "", "", "", None, None, None), ("4", "d", None, "", "k@x", None, None)], "cntrb_id string, login string, company string, location string, canonical string, enriched_at timestamp_ntz, collected_at timestamp_ntz")
    now = "2024-06-01 00:00:00"
    asked = catalog.thin_profiles(people, now, 10)
    assert rows(asked) == [("a",), ("d",)] and rows(catalog.missing_canonical(people, now, 10), "login") == [("a",), ("b",)]
    found = spark.createDataFrame([("a", "New", "", "1+a@users.NoReply.example.com")], "login string, company string, location string, email string")
    out = catalog.enrich(people, catalog.Answers(asked, found), now)
    assert rows(out.filter("login = 'a'"), "company", "location") == [("New", None)] and not catalog.thin_profiles(out, now, 10).count()
    assert rows(catalog.thin_profiles(out, "2024-07-02 00:00:00", 10)) == [("d",)]
    assert rows(catalog.enrich(people, catalog.Answers(asked, found), now, True).filter("login = 'a'"), "canonical") == [(None,)]


def test_search_and_case(spark):
    queue, repos = spark.createDataFrame([(1,), (2,)], "repo_id long"), spark.createDataFrame([(1, "Org", "one"), (2, "other", "TWO")], "repo_id long, repo_owner string, repo_name string")
    assert rows(catalog.search_queue(queue, repos, "oRg")) == [(1,)] and rows(catalog.search_queue(queue, repos, "w")) == [(2,)] and catalog.search_queue(queue, repos, "").count() == 2
    commits = spark.createDataFrame([("A@x",), ("a@X",), ("b@noreply",), ("",), (None,)], "author_email string")
    people = spark.createDataFrame([("a@x", "C"), ("b@noreply", "D"), ("a@x", "None")], "email string, company string")
    assert rows(catalog.seen_companies(commits, people)) == [("A@x", "C"), ("a@X", "C")]


def test_listing_is_split_by_one_parse(spark):
    page = {"repository": {"issues": {"nodes": [{"number": 1, "state": "OPEN", "title": "i", "comments": {"nodes": [{"databaseId": 5, "body": "hi"}, {"body": "no id"}]}}, {"title": "no number"}, None]}, "pullRequests": {"nodes": [{"number": 2, "state": "CLOSED", "mergedAt": "2024-01-01T00:00:00Z", "title": "p"}]}}}
    later = {"repository": {"issues": {"nodes": [{"number": 1, "state": "CLOSED", "title": "i"}]}, "pullRequests": None}}
    staged = spark.createDataFrame([(1, 7, json.dumps(page)), (2, 7, json.dumps(later)), (3, 7, "{broken"), (4, 7, None)], "seq long, repo_id long, payload string")
    split = bundles.split_listing(staged)
    assert rows(bundles.listed(split, "issues"), "number", "state") == [(1, "closed")]
    assert rows(bundles.listed(split, "pull_requests"), "number", "state") == [(2, "merged")]
    assert rows(bundles.listed(split, "issue_messages"), "number", "msg_id", "msg_text") == [(1, 5, "hi")]


def test_classifiers_errors_and_legacy_rows(spark):
    at = lambda c: spark.range(1).select(c).first()[0]
    osi = "License :: OSI Approved :: "
    tell = lambda *c: at(S.classifier_licence(F.array(*map(F.lit, c)).cast("array<string>")))
    assert [tell("Topic", osi + n) for n in ("MIT License", "GNU General Public License v3 (GPLv3)", "GNU Lesser General Public License v2", "Python Software Foundation License", "European Union Public Licence")] == ["MIT", "GPL-3.0", "LGPL", "Python Software Foundation", "European Union Public Licence"]
    assert tell() == "" and tell(osi + "BSD License", osi + "MIT License") == "BSD"
    kinds = spark.createDataFrame([(None,), ("Gone",), ("deadline exceeded",), ("all keys invalidated",), ("not modified",), ("odd",)], "k string")
    assert [r[0] for r in kinds.select(S.error_class(F.col("k"))).collect()] == ["ok", "skip", "transient", "auth", "not_modified", "fatal"]
    registry = spark.createDataFrame([("pypi", " unknown ", [osi + "ISC License (ISCL)"]), ("npm", "", [osi + "MIT"]), ("pypi", "BSD", None), ("pypi", None, None)], "manager string, licence string, classifiers array<string>")
    assert [r["licence"] for r in manifests.with_classifiers(registry).collect()] == ["ISC", "", "BSD", ""]
    legacy = spark.createDataFrame([(1, "u", None), (2, "", "x"), (3, None, "y")], "repo_id long, repo_git string, repo_name string")
    assert rows(catalog.legacy_repos(legacy)) == [(1, "u", "")]
