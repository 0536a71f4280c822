"""What Python workers hold between tasks of different kinds."""

from __future__ import annotations

import os

import pyarrow as pa

from pulsegrid.llm import common, decontam, ngram_join, packing
from pulsegrid.llm.queries import tokenizer_path


def test_tasks_of_one_kind_keep_nothing_of_another(spark):
    docs = spark.createDataFrame([(k, f"word{k} plinth. text of some words") for k in range(64)], "doc_id long, text string").repartition(1)

    def both(batches):
        list(batches)
        kept = [len(common.caches.get(kind, ())) for kind in ("tokens", "words")]
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (os.getpid(), *kept)], ["pid", "tokens", "words"])

    def held():
        return {r.pid: (r.tokens, r.words) for r in spark.range(0, 64, 1, 64).mapInArrow(both, "pid long, tokens long, words long").collect()}

    assert packing.token_pieces(docs, tokenizer_path(), 4096, 1).count() == 64
    assert any(t for t, _ in held().values())
    many = docs.repartition(64)
    assert ngram_join.sketch(many).count() == 64
    after = held()
    assert any(p for _, p in after.values()) and not any(t and p for t, p in after.values()), after
    assert packing.token_pieces(many, tokenizer_path(), 4096, 1).count() == 64
    after = held()
    assert any(t for t, _ in after.values()) and not any(t and p for t, p in after.values())


def test_an_empty_table_needs_no_python(spark):
    schema = "a long, b long, far double, link boolean"
    rows = common.empty(spark, schema)
    assert rows.schema == spark.createDataFrame([], schema).schema and rows.collect() == []
    assert "ExistingRDD" not in (plan := rows._jdf.queryExecution().executedPlan().toString()) and "Local" in plan
    for state in (ngram_join._Graph(spark, rows).measured, ngram_join._Graph(spark, rows).state, common.components(spark.range(0).selectExpr("id a", "id b"))):
        assert "ExistingRDD" not in state._jdf.queryExecution().executedPlan().toString()


def test_decontamination_reads_no_list(spark, monkeypatch):
    words = " ".join(f"w{k}" for k in range(20))
    docs = common.table(spark.createDataFrame([(1, f"a b {words} c"), (2, "nothing of it")], "doc_id long, text string"), "docs")
    bench = common.table(spark.createDataFrame([("x", words), ("y", "nothing")], "item_id string, text string"), "bench")

    def refuse(*_, **__):
        raise AssertionError("a list that Python processes of their own would read")

    monkeypatch.setattr(type(spark), "createDataFrame", refuse)
    rows = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontam.decontaminate(docs, bench).collect()}
    assert rows == {1: (23, 20, 1, True), 2: (3, 1, 1, True)}
