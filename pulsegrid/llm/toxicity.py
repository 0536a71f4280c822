"""Toxicity by a factorization machine over hashed terms.

Terms are a text's distinct words and the five-letter beginnings of longer words, hashed to ``BUCKETS``. The
machine scores ``b + sum w_i + sum_{i<j} <v_i, v_j>`` over the terms present: the pair term learns that two
terms together (an insult and a mention of a group) say more than their sum.

The machine is fitted in the driver on a bounded sample of at most about ``SAMPLE`` labelled rows, taken by
hash; terms are kept that occur in ``LEAST`` sampled texts or more, the ``KEPT`` most telling of them, and terms that tell in
pairs only. Scoring
runs over every whole text in tasks.

Null and empty texts have no terms and get the bias alone. Repeated rows give a row each. Without labels of
both kinds the score is 0.5 everywhere. Rows with a null label are not learned from.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import least_hash, positive_hash, slices, texts

BUCKETS, SAMPLE, LEAST, KEPT, FACTORS, PREFIX = 1 << 22, 12_000, 5, 1 << 14, 8, 5
#: Least log-likelihood ratio of a kept term; chance terms would add up over long texts.
TELLING = 8.0
#: With fewer toxic rows than this no term can tell so much, and the least ratio falls in proportion.
ENOUGH = 100
#: A pair of the ``FREQUENT`` commonest terms keeps both, whatever they tell alone, if it tells so much more than the better of them.
FREQUENT, PAIR_TELLING = 1_024, 40.0
MEMO = 400_000
#: ASCII letters lowered; all other ASCII is blank.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_memo: dict[bytes, tuple[int, ...]] = {}


def terms(text: bytes | None) -> set[int]:
    words = set((text or b"").translate(LETTERS).split())
    if len(_memo) > MEMO:
        _memo.clear()
    out: set[int] = set()
    for w in words:
        t = _memo.get(w)
        if t is None:
            t = (zlib.crc32(w) % BUCKETS,)
            if len(w) > PREFIX:
                t += (zlib.crc32(b"^" + w[:PREFIX]) % BUCKETS,)
            _memo[w] = t
        out.update(t)
    return out


def _pair_terms(x: np.ndarray, labels: np.ndarray, share: float) -> np.ndarray:
    """Columns of x (texts by terms, 0 or 1) that stand in a pair that tells more than either term."""
    both, toxic = x.T @ x, x[labels == 1].T @ x[labels == 1]
    n, p = np.diag(both), (np.diag(toxic) + share) / (np.diag(both) + 1)
    tell = n * (p * np.log(p / share) + (1 - p) * np.log((1 - p) / (1 - share)))
    base = np.where(tell[:, None] > tell[None, :], p[:, None], p[None, :])
    base = np.clip(base, 1e-4, 1 - 1e-4)
    q = (toxic + base) / (both + 1)
    more = both * (q * np.log(np.maximum(q, 1e-12) / base) + (1 - q) * np.log(np.maximum(1 - q, 1e-12) / (1 - base)))
    np.fill_diagonal(more, 0)
    return np.flatnonzero(more.max(1, initial=0) > PAIR_TELLING)


class Machine:
    """bias, w (n), v (n, FACTORS) of the kept buckets."""

    def __init__(self, buckets: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray):
        self.index = dict(zip(buckets.tolist(), range(len(buckets)), strict=True))
        self.bias, self.w, self.v = bias, w, v

    def score(self, found: set[int]) -> float:
        i = [self.index[t] for t in found & self.index.keys()]
        v = self.v[i]
        z = self.bias + self.w[i].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit(rows: list[np.ndarray], labels: np.ndarray, rounds: int = 25, rate: float = 0.2, decay: float = 1e-5) -> Machine:
    """rows: the buckets present in each text."""
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    if not len(flat) or labels.min() == labels.max():
        return Machine(np.zeros(0, np.int64), 0.0, np.zeros(0), np.zeros((0, FACTORS)))
    owner = np.repeat(labels, [len(r) for r in rows])
    all_, inverse = np.unique(flat, return_inverse=True)
    n = np.bincount(inverse)
    pos = np.bincount(inverse, owner)
    share = labels.mean()
    p = (pos + share) / (n + 1)
    tell = n * (p * np.log(p / share) + (1 - p) * np.log((1 - p) / (1 - share)))
    kept = np.flatnonzero(n >= LEAST)
    kept = np.sort(kept[np.argsort(-tell[kept], kind="stable")[:KEPT]])
    kept = kept[tell[kept] > TELLING * min(1.0, labels.sum() / ENOUGH)]
    place = np.full(len(all_), -1)
    common = np.sort(np.argsort(-n, kind="stable")[:FREQUENT])
    common = common[n[common] >= LEAST]
    place[common] = np.arange(len(common))
    present = np.zeros((len(rows), len(common)), np.float32)
    column, row = place[inverse], np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    present[row[column >= 0], column[column >= 0]] = 1
    kept = np.union1d(kept, common[_pair_terms(present, labels, share)])
    place[:] = -1
    place[kept] = np.arange(len(kept))
    at = np.r_[0, np.cumsum([len(r) for r in rows])]
    x = [(lambda t: t[t >= 0])(place[inverse[a:b]]) for a, b in zip(at[:-1], at[1:], strict=True)]
    rng = np.random.default_rng(3)
    odds = np.log((p[kept] + 1e-3) / (1 - p[kept] + 1e-3)) - np.log(share / (1 - share))
    # Start from the terms' own odds, so that a term need not come in pairs to tell.
    w, v, bias = 0.8 * np.clip(odds, -2, 4), rng.normal(0, 0.01, (len(kept), FACTORS)), float(np.log(share / (1 - share)))
    gw, gv, gb = np.full(len(kept), 1e-6), np.full((len(kept), FACTORS), 1e-6), 1e-6
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    weight = weight / weight.mean()
    for _ in range(rounds):
        for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
            idx = np.concatenate([x[i] for i in part])
            row = np.repeat(np.arange(len(part)), [len(x[i]) for i in part])
            sums = np.zeros((len(part), FACTORS))
            np.add.at(sums, row, v[idx])
            squares = np.bincount(row, (v[idx] ** 2).sum(1), len(part))
            z = bias + np.bincount(row, w[idx], len(part)) + 0.5 * ((sums**2).sum(1) - squares)
            err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[part]) * weight[part] / len(part)
            dw, dv = np.zeros_like(w), np.zeros_like(v)
            np.add.at(dw, idx, err[row])
            np.add.at(dv, idx, err[row, None] * (sums[row] - v[idx]))
            seen = np.unique(idx)
            dw[seen] += decay * w[seen]
            dv[seen] += decay * v[seen]
            gw[seen] += dw[seen] ** 2
            gv[seen] += dv[seen] ** 2
            gb += err.sum() ** 2
            w[seen] -= rate * dw[seen] / np.sqrt(gw[seen])
            v[seen] -= 0.1 * rate * dv[seen] / np.sqrt(gv[seen])
            bias -= rate * err.sum() / np.sqrt(gb)
    return Machine(all_[kept], bias, w, v)


def learn(labelled: DataFrame, sample: int = SAMPLE) -> Machine:
    """labelled: doc_id, text, label (0 or 1)."""
    known = labelled.filter(F.col("label").isNotNull())
    n = known.count()
    chosen = positive_hash("doc_id", F.lit("toxicity")) <= least_hash(sample, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [np.fromiter(sorted(terms(t)), np.int32).tobytes() for t in texts(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(found, pa.binary())], ["doc_id", "label", "terms"])

    # Bounded: about ``sample`` rows.
    got = known.filter(chosen).select("doc_id", "text", F.col("label").cast("int").alias("label")).mapInArrow(run, "doc_id long, label int, terms binary")
    got = got.toPandas().sort_values(["doc_id", "label"])
    return fit([np.frombuffer(t, np.int32) for t in got["terms"]], got["label"].to_numpy(np.float64))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [machine.score(terms(t)) for t in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
