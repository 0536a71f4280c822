"""Similarity join and top-k search against brute force."""

from __future__ import annotations

import random
import re
from pathlib import Path

import numpy as np
import pytest
from conftest import DATA, assert_same, duck
from pyspark.sql import functions as F

from pulsegrid.llm import kdtree, ngram_join, queries
from pulsegrid.llm.common import shared_dir, table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_groups(rows):
    """{doc_id: (n_shingles, component)}."""
    sets = {}
    for doc, text in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        n = max(1, len(words) - 4) if words else 0
        sets[doc] = {tuple(words[i : i + 5]) for i in range(n)}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= 75 * (len(sets[a]) + len(sets[b]) - inter):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in sets}


def near_copies(seed: int, n: int):
    """Originals with exact copies, chains of edits about the threshold, and shared passages."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    rows, bases = [], []
    for doc in range(n):
        kind = rng.random()
        if bases and kind < 0.25:
            words = list(rng.choice(bases))
        elif bases and kind < 0.7:
            words = list(rng.choice(bases))
            for _ in range(rng.choice((1, 1, 1, 2, 3))):
                at = rng.randrange(max(1, len(words)))
                words[at : at + 1] = rng.choice(([], ["new"], [rng.choice(vocabulary), "x"]))
            bases.append(words or ["w"])
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice((1, 3, 5, 6, 20, 40, 80)))]
            if rng.random() < 0.3:
                words += passage
            bases.append(words)
        rows.append((doc * 3 + 1, rng.choice((" ", "\t", "\n ")).join(words).replace("w1", "W1")))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_brute_force(spark, seed):
    rows = [*near_copies(seed, 220), (2, None), (5, ""), (8, " \n\t"), (11, "Same four words here"), (14, "same FOUR words here"), (17, "É a b c d e"), (20, "é a b c d e")]
    want = brute_groups(rows)
    # A repeated row, and a column whose name the operator uses inside.
    frame = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string").selectExpr("*", "'x' as component_id", "1 as n")
    out = ngram_join.ngram_join(frame.repartition(5)).collect()
    assert len(out) == len(want)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == want
    assert len({c for _, c in want.values()}) < len(want) - 20


def test_join_of_nothing(spark):
    assert ngram_join.ngram_join(spark.createDataFrame([], SCHEMA)).count() == 0


def test_join_on_the_table_equals_brute_force(spark):
    docs = queries.read(spark, f"{DATA}/sf0.001", "documents")
    want = brute_groups([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op7_ngram_join(spark, f"{DATA}/sf0.001").collect()}
    assert got == want


def brute_top(vectors, asked, k=5):
    whole = {}
    for i, v in vectors:
        if v and all(x is not None and np.isfinite(x) for x in v):
            whole.setdefault(i, []).append(np.floor(256 * np.array(v, np.float64)).astype(np.int64))
    out = []
    for q in sorted({i for i, _ in asked} & whole.keys()):
        x = min(whole[q], key=tuple)
        found = sorted((-int(x @ y), i) for i, vs in whole.items() if i != q for y in vs if len(y) == len(x))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


def test_top_k_edges(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.integers(-2, 3, 4) / 4]) for i in range(700)]  # many ties
    rows += [(700, None), (701, []), (702, [1.0, None, 1.0, 1.0]), (703, [float("nan")] * 4), (704, [float("inf")] * 4), (750, [1.0, 2.0]), (751, [1.0, -1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'clash' as score", "0 as rank")
    asked = frame.filter("vec_id % 50 = 0")
    got = kdtree.top_k(frame, asked, 5)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, [r for r in rows if r[0] % 50 == 0])


def test_top_k_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert kdtree.top_k(empty, empty).count() == 0


def test_top_k_oracle(spark):
    assert_same(queries.op5_topk(spark, f"{DATA}/sf0.01"), duck("sf0.01"), queries.ORACLE_SQL["op5_topk"])


def test_template_pages_that_cannot_link_meet_in_no_block(spark, monkeypatch):
    """Pages of one template with words of their own: pairs measured grow with the number of pages, links stay exact."""
    r, template, own, rows = random.Random(5), [f"t{i}" for i in range(400)], [], []
    for i in range(400):
        if i % 20 == 19:  # a near copy of the page before
            own = [*own[:50], f"copy{i}", *own[51:]]
        else:
            own = [f"w{r.randrange(10**9)}" for _ in range(100)]
        rows.append((i, " ".join(template + own)))
    met, measured = [], []
    blocks, measure = ngram_join._join_blocks, ngram_join.measure
    monkeypatch.setattr(ngram_join, "_join_blocks", lambda graph, x: (met.append(x.count()), blocks(graph, x))[1])
    monkeypatch.setattr(ngram_join, "measure", lambda sets, members, pivots: (measured.append(members.count()), measure(sets, members, pivots))[1])
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_groups(rows)
    assert sum(met) == 0 and sum(measured) < len(rows)


def test_join_leaves_no_shuffle_files_and_no_sketch(spark, tmp_path):
    env = spark._jvm.org.apache.spark.SparkEnv.get()
    dirs = [Path(str(d)) for d in env.blockManager().diskBlockManager().localDirs()]
    shuffles = lambda: {f.name for d in dirs for f in d.glob("*/shuffle_*.data")}
    scratch = Path(shared_dir(spark).removeprefix("file://"))
    before, sketches = shuffles(), set(scratch.glob("ngram-sketch-*"))
    rows = near_copies(3, 60)
    out = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id"))
    assert not shuffles() - before
    assert not set(scratch.glob("ngram-sketch-*")) - sketches
    assert out.count() == len({doc for doc, _ in rows})


def test_join_holds_texts_and_not_their_shingles(spark, monkeypatch):
    rows, write, held = near_copies(5, 150), ngram_join.table, []

    def noted(df, name):
        out = write(df, name)
        if name == "ngram-sets":
            held.extend((f.stat().st_size, out.columns) for x in out.inputFiles() for f in [Path(x.removeprefix("file://"))])
        return out

    monkeypatch.setattr(ngram_join, "table", noted)
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    long = [(10_000 + k, " ".join(f"{(k // 2) * 3000 + j:x}" for j in range(2000 + k % 2))) for k in range(40)]
    out = ngram_join.ngram_join(spark.createDataFrame([*rows, *long], "doc_id long, text string").repartition(2)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute_groups([*rows, *long])
    shingles = 8 * sum(len(x.split()) for _, x in long)
    assert held and sum(n for n, _ in held) < 0.7 * shingles, held


def test_large_cells_are_joined_a_part_of_the_blocks_at_a_time(spark, monkeypatch):
    rows = [(k, " ".join(f"{(k // 2) * 100 + j:x}" for j in range(40 + k % 2))) for k in range(300)]
    docs = table(spark.createDataFrame(rows, "doc_id long, text string"), "docs")
    cell = table(ngram_join.sketch(docs).select("c", "doc_id", "n"), "cell").cache()
    graph = ngram_join._Graph(spark, table(ngram_join._sets(docs, cell.select("c", "doc_id")), "sets"))
    small, seats = ngram_join._small, []
    monkeypatch.setattr(ngram_join, "_small", lambda df: (seats.append(df.count()) if "own" in df.columns else None, small(df))[1])
    monkeypatch.setattr(ngram_join, "MOVED_SHINGLES", 1, raising=False)
    ngram_join._join_blocks(graph, cell.selectExpr("0L as cell", "c", "n", "c as name"))
    assert len(seats) == 5 and sum(seats) == 5 * len(rows) and max(seats) < 3 * len(rows), seats
    pairs = graph.named(cell.select("c", "doc_id")).groupBy("name").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).collect()
    assert {(r.lo, r.hi, r.n) for r in pairs} == {(k, k + 1, 2) for k in range(0, 300, 2)}
