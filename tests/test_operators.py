"""Scalar functions, merges and streaming ingest on authored rows."""

from __future__ import annotations

import json
import os
import random
from types import SimpleNamespace

import duckdb
import pytest
from conftest import assert_same
from pyspark.sql import functions as F

from pulsegrid.functions import scalars as S
from pulsegrid.operators import merge, metrics, views
from pulsegrid.streaming import ingest

CASES = [
    (S.spdx, "mit license", "MIT"),
    (S.spdx, "  ", "Unknown"),
    (S.spdx, None, "Unknown"),
    (S.spdx, "NOASSERTION", "Unknown"),
    (S.spdx, "My own terms", "My own terms"),
    (S.spdx, "Permission is hereby granted, free of charge, to any person. The software is provided \"as is\", without warranty.", "MIT"),
    (S.email_domain, "A@B.Org", "b.org"),
    (S.email_domain, "nobody", ""),
    (S.noreply_login, "12+me@users.noreply.github.com", "me"),
    (S.noreply_login, "me@example.org", None),
    (S.noreply_id, "12+me@users.noreply.github.com", 12),
    (S.noreply_id, "me@users.noreply.github.com", None),
    (S.company, "@acme", "Acme"),
    (S.company, "None", ""),
    (S.version_clean, ">=1.2, <2", "1.2"),
    (S.version_pad, "1", "1.0.0"),
    (S.version_pad, "1.2-rc", "1.2-rc"),
    (S.repo_url, " https://h/o/r.git/ ", "https://h/o/r"),
    (S.url_owner, "https://h/a/b/r.git", "a/b"),
    (S.url_repo, "https://h/a/b/r.git", "r"),
    (S.safe_git_url, "https://h/o/r", True),
    (S.safe_git_url, "ext::sh -c x", False),
    (S.sanitise, "a\x00b\x07\tc\x85", "ab\tc"),
    (S.strip_json_nul, r"a\u0000b\\u0000", r"ab\\u0000"),
    (S.trailing_number, "https://h/o/r/issues/42", 42),
    (S.trailing_number, "https://h/o/r", None),
    (S.first_copyright, '[{"value": "A"}, {"value": "B"}]', "A (+1 more)"),
    (S.first_copyright, "[]", ""),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_scalar(spark, i):
    function, raw, want = CASES[i]
    assert spark.createDataFrame([(raw,)], "x string").select(function(F.col("x"))).first()[0] == want


def test_scalars_of_two_columns(spark):
    one = spark.range(1)
    at = lambda c: one.select(c).first()[0]
    assert at(S.libyear(F.lit("2020-01-01T00:00:00Z"), F.lit("2021-01-01 00:00:00"))) == pytest.approx(366 / 365)
    assert at(S.libyear(F.lit("2020"), F.lit("2021-01-01 00:00:00"))) == 0
    assert at(S.gap_percent(F.lit(50), F.lit(0))) == 0 and at(S.gap_percent(F.lit(50), F.lit(100))) == 50
    assert at(S.shard_count(F.lit(0), F.lit(10))) == 1 and at(S.shard_count(F.lit(21), F.lit(10))) == 3 and at(S.shard_count(F.lit(5), F.lit(0))) == 1
    assert at(S.person_uuid(F.lit(1), F.lit(255))) == "01000000-ff00-0000-0000-000000000000"
    assert at(S.cvss_label(S.cvss_score(F.lit("CVSS:3.1/AV:N/AC:L/C:H/I:H/A:H")))) == "CRITICAL"


def test_upsert_keeps_old_values_where_new_ones_are_null(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id int, s string, n int")
    new = spark.createDataFrame([(2, "c", None), (3, None, 7)], "id int, s string, n int")
    rows = {r["id"]: (r["s"], r["n"]) for r in merge.upsert(old, new, ["id"], None, ("n",)).collect()}
    assert rows == {1: ("a", 5), 2: ("c", 6), 3: (None, 7)}


def test_insert_absent_and_latest(spark):
    old = spark.createDataFrame([(1, "a")], "id int, s string")
    assert sorted(merge.insert_absent(old, spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "id int, s string"), ["id"]).collect()) == [(1, "a"), (2, "y")]
    history = spark.createDataFrame([(1, 1, "old"), (1, 2, None), (2, 1, "only")], "id int, at int, s string")
    assert {(r["id"], r["s"]) for r in merge.latest(history, ["id"], ["at"]).collect()} == {(1, None), (2, "only")}


def test_stream_drains_by_entity_and_replays_to_the_same_tables(spark, tmp_path):
    staged = tmp_path / "staged"
    staged.mkdir()
    issue = lambda seq, number, state: {"seq": seq, "repo_id": 1, "entity_type": "issue", "payload": json.dumps({"number": number, "title": "t", "state": state})}
    event = lambda seq, number, k: {"seq": seq, "repo_id": 1, "entity_type": "issue_event", "payload": json.dumps({"number": number, "event_id": k, "action": "closed"})}
    batches = [[event(1, 7, 1), issue(2, 7, "open"), event(3, 99, 2)], [issue(4, 7, "closed"), issue(5, 8, "open"), {"seq": 6, "repo_id": 1, "entity_type": "issue", "payload": "{broken"}]]
    for k, rows in enumerate(batches):
        (staged / f"{k}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(staged / f"{k}.json", (1_700_000_000 + 60 * k,) * 2)  # the source takes files by age
    for check in ("one", "two"):  # the second run replays everything
        ingest.drain(ingest.staged_stream(spark, str(staged)), str(tmp_path / "out"), str(tmp_path / check))
        assert {(r["number"], r["state"]) for r in ingest.table(spark, str(tmp_path / "out"), "issue").collect()} == {(7, "closed"), (8, "open")}
        assert [(r["number"], r["event_id"]) for r in ingest.table(spark, str(tmp_path / "out"), "issue_event").collect()] == [(7, 1)]
    assert ingest.quarantine(spark.read.schema(ingest.STAGED).json(str(staged))).count() == 1
    assert spark.read.json(f"{tmp_path}/out/quarantine/*").count() == 1
    # A crash between new versions and their commit: the half-written commit does not count.
    before = ingest.table(spark, str(tmp_path / "out"), "issue").count()
    (tmp_path / "out" / "_commits" / "000000000099").mkdir()
    assert ingest.table(spark, str(tmp_path / "out"), "issue").count() == before
    ingest.drain(ingest.staged_stream(spark, str(staged)), str(tmp_path / "out"), str(tmp_path / "three"))
    assert ingest.table(spark, str(tmp_path / "out"), "issue").count() == before


def test_scalars_of_reports(spark):
    at = lambda c: spark.range(1).select(c).first()[0]
    assert at(S.is_bot(F.lit("x[bot]@y"))) and not at(S.is_bot(F.lit("1+me@users.noreply.github.com")))
    assert at(S.pick_cve(F.array(F.lit("G"), F.lit("CVE-2")))) == "CVE-2" and at(S.pick_cve(F.array(F.lit("G")))) == ""
    assert at(S.ellipsis(F.lit("abcdef"), 3)) == "abc..." and at(S.ellipsis(F.lit("abc"), 3)) == "abc"
    assert at(S.diff_counts(F.lit("+++ b\n+x\n-y\n+z"), "+")) == 2 and len(at(S.package_id(F.lit("a"), F.lit("1")))) == 16
    assert at(S.licence_cut(F.lit("First line\nmore"))) == "First line"
    assert at(S.version_clean(F.lit("~> 1.2"))) == "1.2" and at(S.version_clean(F.lit("^1 || ^2"))) == "1" and at(S.version_clean(F.lit("!=1.0"))) == "1.0"


def test_merge_contributors_parents_and_backfill(spark):
    people = spark.createDataFrame([("a", 1, "a@x", "", "C", "i1"), ("a", 2, "long@x", "Ann", "", "i2")], "login string, seq int, email string, name string, company string, identity string")
    row = merge.merge_contributors(people).first()
    assert (row["email"], row["name"], row["company"], row["identities"]) == ("long@x", "Ann", "C", ["i1", "i2"])
    commits = spark.createDataFrame([(1, "h1"), (1, "h2")], "repo_id int, hash string")
    edges = spark.createDataFrame([(1, "h2", "h1"), (1, "h2", "gone"), (2, "h2", "h1")], "repo_id int, hash string, parent_hash string")
    assert [(r["hash"], r["parent_hash"]) for r in merge.resolve_parents(edges, commits).collect()] == [("h2", "h1")]
    rows = spark.createDataFrame([("k", ""), ("k", "v"), ("z", None)], "key string, who string")
    lookup = spark.createDataFrame([("k", "b"), ("k", "a")], "key string, who string")
    assert sorted((r["key"], r["who"] or "") for r in merge.backfill(rows, lookup, "key", "who").collect()) == [("k", "a"), ("k", "v"), ("z", "")]


VIEW_COUNTS = "assigned review_requested labeled unlabeled subscribed mentioned referenced closed head_ref_force_pushed head_ref_deleted milestoned merged".split()


def test_pr_rollups_as_the_view_defines_them(spark):
    rng = random.Random(8)
    sha = lambda: rng.choice(["a", "b", "c", "d", None])
    tables = {
        "pulls": ("id long, repo_id long, merge_sha string", [(i, i % 3, sha()) for i in range(30)]),
        "pr_commits": ("id long, sha string", [(rng.randrange(30), sha()) for _ in range(150)]),
        "pr_meta": ("id long, meta_sha string", [(rng.randrange(30), sha()) for _ in range(60)]),
        "commits": ("repo_id long, hash string, filename string, added long, removed long", [(r, h, f, rng.randrange(50), rng.randrange(50)) for r in range(3) for h in "abc" for f in "xyz"[: rng.randrange(1, 4)]]),
    }
    con = duckdb.connect()
    frames = {}
    for name, (schema, rows) in tables.items():
        frames[name] = spark.createDataFrame(rows, schema)
        con.execute(f"create table {name} ({schema.replace('long', 'bigint')})")
        con.executemany(f"insert into {name} values ({', '.join('?' * len(rows[0]))})", rows)
    sql = """
        with x as (select c.id, c.sha, p.repo_id from pr_commits c, pulls p, pr_meta m
                   where p.id = c.id and p.id = m.id and c.sha <> p.merge_sha and c.sha <> m.meta_sha),
        n as (select id, count(distinct sha) as commit_count from x group by id),
        l as (select id, sum(added) as lines_added, sum(removed) as lines_removed, count(distinct filename) as file_count
              from x join commits k on k.repo_id = x.repo_id and k.hash = x.sha group by id)
        select id, commit_count, cast(lines_added as bigint) as lines_added, cast(lines_removed as bigint) as lines_removed, file_count from n left join l using (id)"""
    assert len(con.execute(sql).fetchall()) > 5
    assert_same(views.pr_rollups(**frames), con, sql)


def test_pr_response_counts_all_actions_of_the_view(spark):
    frame = spark.createDataFrame
    t = SimpleNamespace(
        repos=frame([(1, "r", 2)], "repo_id long, repo_name string, repo_group_id long"), repo_groups=frame([(2, "g")], "repo_group_id long, rg_name string"),
        pull_requests=frame([(7, 1, "open")], "id long, repo_id long, state string").selectExpr("*", "timestamp_ntz'2024-01-01 00:00:00' as created_at", "cast(null as timestamp_ntz) as closed_at"),
        item_events=frame([(7, a) for i, a in enumerate(VIEW_COUNTS) for _ in range(i + 1)], "item_id long, action string"),
        messages=frame([(7, 1), (7, 2)], "item_id long, h int").selectExpr("item_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, h) as msg_timestamp"),
    )
    row = views.pr_response_times(t, actions=views.VIEW_ACTIONS).first()
    assert [row[f"{a}_count"] for a in VIEW_COUNTS] == [2 * (i + 1) for i in range(12)]
    row = views.pr_response_times(t, True, views.VIEW_ACTIONS).first()
    assert [row[f"{a}_count"] for a in VIEW_COUNTS] == [i + 1 for i in range(12)]


def test_period_aggregates_shuffle_rows_once(spark):
    rows = [(1, "a@x", " ", "2020-01-01", "f", 7, 2, 1, 0), (1, "a@x", None, "2020-02-01", "f", 8, None, 1, 0), (1, "a@x", None, "2020-03-01", "g", None, 3, 1, 0), (1, "a@x", "A", None, "g", 9, 3, 1, 0)]
    commits = spark.createDataFrame(rows, "repo_id long, author_email string, affiliation string, authored_at string, filename string, hash long, added long, removed long, whitespace long")
    out = metrics.period_aggregates(commits.withColumn("authored_at", F.col("authored_at").cast("timestamp_ntz")), "year")
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert [tuple(r) for r in out.collect()] == [(1, "a@x", "(Unknown)", 2020, 5, 3, 0, 2, 2)]
