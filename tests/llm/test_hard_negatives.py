"""Hard negatives against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from conftest import DATA, assert_same, duck

from pulsegrid.llm import hard_negatives, queries

SCHEMA = "vec_id long, label int, embedding array<double>"


def brute(rows, k=5, m=10, low=30, high=90):
    fine = [(i, lab, [int(np.floor(256 * x)) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    asks = {}
    for i, lab, v in fine:
        if i % 100 == 0:
            asks[i] = min(asks.get(i, (v, lab)), (v, lab))
    out = []
    for a, (q, lab) in asks.items():
        scored = sorted(((-sum(x * y for x, y in zip(q, v)), i, other) for i, other, v in fine if i != a and len(v) == len(q)))
        for s, p, _ in [x for x in scored if x[2] == lab][:k]:
            found = [x for x in scored if x[2] != lab and low * -s <= 100 * -x[0] <= high * -s][:m]
            out += [(a, p, r, i, -s, -t) for r, (t, i, _) in enumerate(found, 1)]
    return sorted(out)


def mined(spark, rows, schema=SCHEMA):
    from pyspark.sql import functions as F

    return sorted(tuple(r) for r in hard_negatives.mine(spark.createDataFrame(rows, schema), F.col("vec_id") % 100 == 0).collect())


def clustered(seed, n, d, labels, scale=1.0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(labels, d))
    kind = r.integers(0, labels, n)
    return [(int(i), int(k), [float(x) for x in scale * (centres[k] * r.uniform(0.1, 1) + r.normal(size=d) * 0.4)]) for i, k in enumerate(kind)]


@pytest.mark.parametrize("block", [16, 2_048])
def test_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    rows = clustered(1, 1_200, 12, 4)
    assert mined(spark, rows) == brute(rows)


def test_blocks_are_pruned(monkeypatch):
    """Anchors of one cluster do not score rows of far ones, and lose nothing by it."""
    r = random.Random(2)
    sample = [[r.choice([-9, 9]) * (j == i % 6) + r.randint(-1, 1) for j in range(6)] for i in range(60)]
    refs = hard_negatives.directions(sample)
    assert 6 <= len(refs[6]) <= hard_negatives.DIRECTIONS
    group = hard_negatives._Group(np.array([0]), np.array([0]), np.array([[900, 0, 0, 0, 0, 0]]), refs, "")
    theta, norm = hard_negatives._angles(np.array([[-900, 5, 0, 0, 0, 0], [0, 900, 3, 0, 0, 0], [900, 1, 0, 0, 0, 0]]), refs)
    least, greatest = group._bounds({"n": np.ones(3), "near": theta, "far": theta, "short": norm, "long": norm})
    exact = np.array([-810_000, 0, 810_000])
    assert (least[0] <= exact).all() and (exact <= greatest[0]).all() and greatest[0, 0] < 0


def test_odd_rows(spark):
    """Nulls, zero vectors, ties, repeated rows, other dimensions, extreme components, extra columns."""
    r = random.Random(3)
    rows = [(i, r.randint(0, 2), [r.choice([0.0, 0.25, 0.5, -0.5]) for _ in range(4)]) for i in range(300)]
    rows += [(None, 1, [1.0] * 4), (7, None, [1.0] * 4), (8, 1, None), (9, 1, []), (10, 1, [1.0, None, 1.0, 1.0]), (11, 1, [float("nan")] * 4), (12, 1, [float("inf")] * 4)]
    rows += [(i, 1, [0.5, 0.25]) for i in range(400, 412)] + [(i, 2, [0.25, 0.25]) for i in range(420, 426)] + [(100, 1, [0.5] * 4), (33, 1, [0.5] * 4), (33, 1, [0.5] * 4), (700, 1, [1.0] * 3)]
    rows += [(500 + i, i % 2, [1e6 + i, 2e6, -1e6 * i, 3e6]) for i in range(5)]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, [(*x, 1, "x") for x in rows], SCHEMA + ", cell int, angle string") == brute(rows)
    assert mined(spark, []) == []


def test_too_long_vectors_are_refused(spark):
    with pytest.raises(Exception, match="too long"):
        mined(spark, [(0, 1, [1e9, 1e9]), (1, 1, [1e9, 1e9]), (2, 2, [1e9, 1e9])])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_query_against_sql(spark, sf):
    assert_same(queries.op13_hard_negatives(spark, f"{DATA}/{sf}"), duck(sf), queries.ORACLE_SQL["op13_hard_negatives"])
