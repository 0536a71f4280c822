"""Nested pull requests: one parse, all child tables in one commit, replays and later bundles."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from pulsegrid.operators.store import Store, scratch
from pulsegrid.sources import bundles
from pulsegrid.streaming import ingest


def nodes(*rows):
    return {"nodes": list(rows)}


def pull(number, **more):
    ann, bob = {"databaseId": 1, "login": "ann"}, {"databaseId": 2, "login": "bob"}
    return {
        "number": number, "state": "OPEN", "title": "T", "createdAt": "2024-01-01T00:00:00Z", "author": ann, "headRefName": "topic", "headRefOid": "h1", "baseRefName": "", "baseRefOid": None,
        "headRepository": {"databaseId": 5, "nameWithOwner": "ann/x"}, "labels": nodes({"id": "L1", "name": "bug", "color": "f00"}, None), "assignees": nodes(bob), "reviewRequests": nodes({"requestedReviewer": bob}, {"requestedReviewer": None}),
        "reviews": nodes({"databaseId": 70, "state": "APPROVED", "body": "ok\\u0000", "submittedAt": "2024-01-02T00:00:00Z", "author": None, "commit": {"oid": "h1"}}),
        "commits": nodes({"commit": {"oid": "c1", "message": "m", "committedDate": "2024-01-01T00:00:00Z", "author": {"email": "a@x", "name": "A", "user": None}}}),
        "files": nodes({"path": "a.py", "additions": 3, "deletions": 1}), "comments": nodes({"databaseId": 900, "body": "hi", "createdAt": "2024-01-03T00:00:00Z", "author": bob}),
    } | more


def staged(spark, *records):
    rows = [(seq, repo, "pull_request_bundle", json.dumps({"repository": {f"pr{i}": p for i, p in enumerate(pulls)}}) if pulls is not None else "{broken") for seq, repo, pulls in records]
    return spark.createDataFrame(rows, ingest.STAGED)


def plain(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_children_of_one_parse(spark):
    rows = bundles.fan_out(staged(spark, (1, 1, [pull(7), None, pull(None)]), (2, None, [pull(8)]), (3, 1, None)))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") + plan.count("JsonToStructs") <= 2 and plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
    counts = {r.entity: r["count"] for r in rows.groupBy("entity").count().collect()}
    assert counts == {"pull_requests": 1, "pr_labels": 1, "pr_assignees": 1, "pr_reviewers": 2, "pr_reviews": 1, "pr_commits": 1, "pr_files": 1, "pr_meta": 1, "pr_repos": 1, "messages": 1, "pr_message_refs": 1}
    assert plain(bundles.child(rows, "pr_reviewers"), "repo_id", "number", "user_id", "login") == [(1, 7, 2, "bob")]  # one without a reviewer
    assert plain(bundles.child(rows, "pr_meta"), "head_or_base", "ref", "meta_sha") == [("head", "topic", "h1")]
    assert plain(bundles.child(rows, "pr_reviews"), "review_id", "state", "author", "sha") == [(70, "APPROVED", None, "h1")]
    assert plain(bundles.child(rows, "pr_commits"), "sha", "author_email", "author") == [("c1", "a@x", None)]


def test_state(spark):
    rows = spark.createDataFrame([("OPEN", None), ("CLOSED", None), ("CLOSED", "2024-01-01"), (None, None)], "s string, m string")
    assert [r[0] for r in rows.select(bundles.pr_state(F.col("s"), F.col("m"))).collect()] == ["open", "closed", "merged", None]


def test_empty_bundles_and_missing_children(spark):
    rows = bundles.fan_out(staged(spark, (1, 1, [{"number": 3, "state": "CLOSED"}])))
    assert plain(rows, "entity", "name") == [("pull_requests", "closed")]
    for entity in bundles.CHILDREN:
        assert bundles.child(bundles.fan_out(spark.createDataFrame([], ingest.STAGED)), entity).count() == 0


def test_message_and_bridge_in_one_commit_and_later_bundles_win(spark):
    store = Store(spark, scratch(spark, "bundles"), buckets=2)
    first = bundles.fan_out(staged(spark, (1, 1, [pull(7), pull(8, comments=nodes({"databaseId": 900, "body": "old", "createdAt": None, "author": None}))])))
    assert store.commit(bundles.changes(first), "w", 0) and len(store.commits()) == 1
    assert plain(store.table("pr_message_refs"), "number", "msg_id") == [(7, 900), (8, 900)] and store.table("messages").count() == 1
    later = bundles.fan_out(staged(spark, (2, 1, [pull(7, state="CLOSED", mergedAt="2024-02-01T00:00:00Z", comments=nodes({"databaseId": 900, "body": "edited", "createdAt": None, "author": None}, {"databaseId": 901, "body": "more", "createdAt": None, "author": None}))])))
    assert store.commit(bundles.changes(later), "w", 1) and not store.commit(bundles.changes(later), "w", 1)
    assert plain(store.table("pull_requests"), "number", "state") == [(7, "merged"), (8, "open")]
    assert plain(store.table("messages"), "msg_id", "msg_text") == [(900, "edited"), (901, "more")]
    assert plain(store.table("pr_message_refs"), "number", "msg_id") == [(7, 900), (7, 901), (8, 900)]
    assert plain(store.table("pr_files"), "number", "path", "added") == [(7, "a.py", 3), (8, "a.py", 3)]


def test_stream_of_bundles_stopped_before_its_commit_is_replayed(spark, tmp_path, monkeypatch):
    folder, root, check = tmp_path / "staged", str(tmp_path / "out"), str(tmp_path / "check")
    folder.mkdir()
    for k, (state, title) in enumerate((("OPEN", "one"), ("CLOSED", "two"))):
        row = {"seq": k, "repo_id": 1, "entity_type": "pull_request_bundle", "payload": json.dumps({"repository": {"pr0": pull(7, state=state, title=title)}})}
        bad = {"seq": 9, "repo_id": 1, "entity_type": "pull_request_bundle", "payload": "[1"}
        (folder / f"{k}.json").write_text("\n".join(map(json.dumps, [row, bad])))
        os.utime(folder / f"{k}.json", (1_700_000_000 + 60 * k,) * 2)
    publish, calls = Store._publish, []

    def stops(self, rows):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return publish(self, rows)

    monkeypatch.setattr(Store, "_publish", stops)
    try:
        ingest.drain(ingest.staged_stream(spark, str(folder)), root, check)
        raise AssertionError("the second batch should have failed")
    except Exception as e:
        assert "lost" in str(e)
    assert plain(ingest.table(spark, root, "pull_requests"), "state", "title") == [("open", "one")]
    ingest.drain(ingest.staged_stream(spark, str(folder)), root, check)
    assert plain(ingest.table(spark, root, "pull_requests"), "state", "title") == [("closed", "two")]
    assert ingest.table(spark, root, "messages").count() == 1
    assert spark.read.json(f"{root}/quarantine/*").count() == 2
    removed = Store(spark, root).vacuum(grace=-5)
    assert removed and ingest.table(spark, root, "pr_files").count() == 1
