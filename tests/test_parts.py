"""Tasks follow the rows of the input: what one task holds does not grow with it, and the results stay."""

from __future__ import annotations

import pytest
from conftest import DATA, assert_same, duck
from pyspark.sql import functions as F

from pulsegrid import registry
from pulsegrid.operators.store import Merge, Store, scratch
from pulsegrid.plans import binding

#: Query: steps that are dealt out by the number of rows.
STEPS = {"repo_aggregates_year": 2, "repo_aggregates_month": 2, "repo_aggregates_week": 2, "group_aggregates_month": 2, "new_contributors": 5, "contributors_per_file": 3}


@pytest.mark.parametrize("name", STEPS)
def test_tasks_follow_the_rows(name, spark, monkeypatch):
    monkeypatch.setattr(binding, "TASK_ROWS", 300)
    n = binding.Tables(spark, f"{DATA}/sf0.001").parts("lineitem")
    df = registry.QUERIES[name](spark, f"{DATA}/sf0.001")
    assert n > 8 and df._jdf.queryExecution().executedPlan().toString().count(f", {n}), REPARTITION_BY_NUM") == STEPS[name]
    assert_same(df, duck("sf0.001"), registry.ORACLE_SQL[name])


def test_bundles_are_dealt_out_by_request(spark, monkeypatch):
    few = {tuple(r) for r in binding.Tables(spark, f"{DATA}/sf0.001").pr_bundles.select("seq", F.length("payload")).collect()}
    monkeypatch.setattr(binding, "TASK_ROWS", 300)
    t = binding.Tables(spark, f"{DATA}/sf0.001")
    many = t.pr_bundles.select("seq", F.length("payload"))
    assert many._jdf.queryExecution().executedPlan().toString().count(f", {t.parts('lineitem')}), REPARTITION_BY_NUM") == 5
    assert {tuple(r) for r in many.collect()} == few


def test_a_merge_finds_its_buckets_without_its_rows(spark):
    store, old = Store(spark, scratch(spark, "scoped"), buckets=4), spark.createDataFrame([(k, "old") for k in range(40)], "repo_id long, v string")
    store.commit([Merge("x", old, ["repo_id"])])
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        seen.add(1)
        yield from batches

    new = spark.createDataFrame([(3, "new")], "repo_id long, v string").coalesce(1)
    store.commit([Merge("x", new.mapInArrow(counted, new.schema), ["repo_id"], scope=spark.createDataFrame([(3,), (77,)], "repo_id long"))])
    assert seen.value == 1  # the rows are worked out once, for writing
    assert {(r.repo_id, r.v) for r in store.table("x").collect()} == {(k, "new" if k == 3 else "old") for k in range(40)}
