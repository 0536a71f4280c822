"""The hidden Markov model's recursions over long texts in blocks, against sums over all state paths."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from pulsegrid.llm import hmm_lm


def by_paths(b, a, start, classes):
    """Likelihood and expected counts, from every path of states."""
    k = len(start)
    total, emit, moves, first = 0.0, np.zeros((b.shape[0], k)), np.zeros((k, k)), np.zeros(k)
    for path in itertools.product(range(k), repeat=len(classes)):
        p = start[path[0]] * b[classes[0], path[0]]
        for x, y, c in zip(path, path[1:], classes[1:], strict=False):
            p *= a[x, y] * b[c, y]
        total += p
        first[path[0]] += p
        for s, c in zip(path, classes, strict=True):
            emit[c, s] += p
        for x, y in itertools.pairwise(path):
            moves[x, y] += p
    return total, emit / total, moves / total, first / total


@pytest.mark.parametrize("block", [1, 2, 3, 8, 1024])
def test_blocks_give_the_sums_over_all_paths(monkeypatch, block):
    monkeypatch.setattr(hmm_lm, "BLOCK", block)
    rng = np.random.default_rng(3)
    b, a, start = rng.random((5, 2)), rng.random((2, 2)), np.array([0.7, 0.3])
    b, a = b / b.sum(0), a / a.sum(1, keepdims=True)
    texts = [rng.integers(0, 5, n) for n in (1, 9, 2, 8, 3, 7)]
    at = np.r_[0, np.cumsum([len(t) for t in texts])]
    want = [by_paths(b, a, start, t) for t in texts]
    logs, parts = hmm_lm._forward(b, a, start, np.concatenate(texts), at)
    assert logs == pytest.approx(np.log10([w[0] for w in want])) and parts.sum() == pytest.approx(logs.sum())
    for got, i in zip(hmm_lm._expected(b, a, start, np.concatenate(texts), at), (1, 2, 3), strict=True):
        assert got == pytest.approx(sum(w[i] for w in want))


def test_a_very_long_text_takes_few_steps(monkeypatch):
    rng = np.random.default_rng(4)
    b, a, start = rng.random((64, 4)), rng.random((4, 4)) + 0.01, np.full(4, 0.25)
    b, a = b / b.sum(0), a / a.sum(1, keepdims=True)
    classes, at = rng.integers(0, 64, 40_000), np.array([0, 40_000])
    logs = hmm_lm._forward(b, a, start, classes, at)[0]
    emit, moves, first = hmm_lm._expected(b, a, start, classes, at)
    assert emit.sum() == pytest.approx(40_000) and moves.sum() == pytest.approx(39_999) and first.sum() == pytest.approx(1)
    monkeypatch.setattr(hmm_lm, "BLOCK", 1 << 20)  # one block: step by step
    assert logs == pytest.approx(hmm_lm._forward(b, a, start, classes, at)[0])
    for x, y in zip((emit, moves, first), hmm_lm._expected(b, a, start, classes, at), strict=True):
        assert x == pytest.approx(y)
