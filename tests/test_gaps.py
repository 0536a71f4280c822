"""Gaps, their neighbours and the plan to fill them, against loops over authored and random numbers."""

from __future__ import annotations

import random

import pytest

from pulsegrid.operators import reports

SCHEMA = "repo_id long, number long"


def by_loop(expected, collected, edge):
    out, run = set(), []
    for n in [*sorted(expected), None]:
        if n is not None and n not in collected:
            run.append(n)
            continue
        if run:
            out.update(range(run[0], run[-1] + 1), [c for c in sorted(collected) if c < run[0]][-edge:], [c for c in sorted(collected) if c > run[-1]][:edge])
        run = []
    return out


@pytest.mark.parametrize("span", [4, 1 << 16])
def test_edges_and_shards(spark, monkeypatch, span):
    monkeypatch.setattr(reports, "SPAN", span)
    rng, expected, collected = random.Random(5), {}, {}
    for repo in range(6):
        expected[repo] = set(rng.sample(range(1, 90), 50))
        collected[repo] = {n for n in range(1, 95) if rng.random() < repo / 5}  # some that are not expected, too; none in the first
    frame = lambda d: spark.createDataFrame([(r, n) for r, v in d.items() for n in v] * 2, SCHEMA)
    e, c = frame(expected), frame(collected)
    want = {(r, n) for r in expected for n in by_loop(expected[r], collected[r], 2)}
    found = reports.gaps(e, c)
    assert {tuple(r) for r in reports.gap_edges(found, c).collect()} == want
    told = spark.createDataFrame([(r, 100) for r in range(5)] + [(5, 0)], "repo_id long, n long")
    plan = reports.fill_plan(e, c, told, 7)
    rows = plan.collect()
    assert {(r["repo_id"], r["number"]) for r in rows} == {x for x in want if x[0] < 5} and len(rows) == len({(r["repo_id"], r["number"]) for r in rows})
    for repo in range(5):
        mine = sorted((r["number"], r["shard"]) for r in rows if r["repo_id"] == repo)
        sizes = [sum(s == k for _, s in mine) for k in range(1, max(s for _, s in mine) + 1)]
        assert [s for _, s in mine] == sorted(s for _, s in mine) and max(sizes) <= 7 and max(sizes) - min(sizes) <= 1
        assert len(sizes) == -(-len(mine) // 7)
    staged = plan.filter("shard > 1").select("repo_id", "number")
    assert {tuple(r) for r in reports.missed(plan, staged).collect()} == {(r["repo_id"], r["number"]) for r in rows if r["shard"] == 1}
    assert reports.fill_plan(e.limit(0), c.limit(0), told, 7).count() == 0
