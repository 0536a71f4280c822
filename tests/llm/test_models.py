"""Learned operators: held-out accuracy, and exact sums against brute force."""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
from conftest import DATA

from pulsegrid.llm import hmm_lm, langid, queries, toxicity

SF = f"{DATA}/sf0.01"
EDGES = [(1, None), (2, ""), (3, "12 34 !"), (4, "word " * 100_000), (5, "same text"), (5, "same text")]


def held(doc_id: int, n: int, k: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % n == k


def edges(spark):
    return spark.createDataFrame(EDGES, "doc_id long, text string").selectExpr("*", "'x' as score", "'de' as lang_pred")


def test_toxicity_held_out(spark):
    sf = f"{DATA}/sf0.1"  # sf0.01 has only 33 toxic rows to learn from
    label = {r["doc_id"]: r["toxic"] for r in queries.read(spark, sf, "labels").collect()}
    rows = queries.op1_toxicity(spark, sf).collect()
    assert len(rows) == queries.read(spark, sf, "documents").count()
    for r in rows:
        assert r["held_out"] == held(r["doc_id"], 3, 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    mine = [(r["score"], label[r["doc_id"]]) for r in rows if r["held_out"] and label.get(r["doc_id"]) is not None]
    good = [(a > b) + 0.5 * (a == b) for (a, x), (b, y) in itertools.product(mine, mine) if x == 1 and y == 0]
    assert np.mean(good) > 0.9


def test_toxicity_held_out_of_few_rows(spark):
    label = {r["doc_id"]: r["toxic"] for r in queries.read(spark, SF, "labels").collect()}
    rows = queries.op1_toxicity(spark, SF).collect()
    assert len(rows) == queries.read(spark, SF, "documents").count()
    for r in rows:
        assert r["held_out"] == held(r["doc_id"], 3, 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    mine = [(r["score"], label[r["doc_id"]]) for r in rows if r["held_out"] and label.get(r["doc_id"]) is not None]
    good = [(a > b) + 0.5 * (a == b) for (a, x), (b, y) in itertools.product(mine, mine) if x == 1 and y == 0]
    assert np.mean(good) > 0.9


def test_toxicity_edges(spark):
    none = toxicity.learn(spark.createDataFrame([], "doc_id long, text string, label int"))
    assert {r["score"] for r in toxicity.score(edges(spark), none).collect()} == {0.5}
    taught = spark.createDataFrame([(i, "vile idiot" if i % 2 else "kind words", i % 2) for i in range(200)] + [(900, None, 1), (901, "a", None)], "doc_id long, text string, label int")
    rows = toxicity.score(edges(spark), toxicity.learn(taught)).collect()
    assert len(rows) == len(EDGES) and all(0 <= r["score"] <= 1 for r in rows)


def test_pairs_tell_more_than_their_sum():
    rows = [np.array(sorted(x)) for x in ([1], [2], [1, 2], []) for _ in range(200)]
    labels = np.repeat([0.0, 0.0, 1.0, 0.0], 200)
    m = toxicity.fit(rows, labels, rounds=60)
    assert m.score({1, 2}) > 0.7 > max(m.score({1}), m.score({2}), m.score(set()))


def test_language_held_out(spark):
    want = {r["doc_id"]: (r["lang"], r["text"]) for r in queries.read(spark, SF, "documents").collect()}
    rows = queries.op10_language(spark, SF).collect()
    assert len(rows) == len(want)
    right = [want[r["doc_id"]][0] == r["lang_pred"] for r in rows if r["held_out"] and r["lang_pred"] != "und"]
    assert np.mean(right) > 0.95
    for r in rows:
        text = want[r["doc_id"]][1]
        assert (r["lang_pred"] == "und") == (not text or not any(c.isalpha() for c in text)) and 0 <= r["score"] <= 1


def test_language_edges(spark):
    none = langid.learn(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r["lang_pred"] for r in langid.identify(edges(spark), none).collect()} == {"und"}
    taught = spark.createDataFrame([(i, "der die das und nicht" if i % 2 else "the of and that not", "de" if i % 2 else "en") for i in range(50)] + [(99, "x", None)], "doc_id long, text string, lang string")
    rows = [(r["doc_id"], r["lang_pred"]) for r in langid.identify(edges(spark), langid.learn(taught)).collect()]
    assert len(rows) == len(EDGES) and {(1, "und"), (2, "und"), (3, "und")} <= set(rows)
    assert {v for d, v in rows if d > 3} <= {"de", "en"}


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")), None]


def check_base(rows, texts, train):
    c = Counter(t for text in train for t in tokens(text))
    n, v = sum(c.values()), len(c)
    for r in rows:
        mine = tokens(texts[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(mine), sum(c[t] > 0 for t in mine), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[t] + 1) / (n + v + 1)) for t in mine), rel_tol=1e-9, abs_tol=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0


def test_language_model_base_counts(spark):
    texts = {r["doc_id"]: r["text"] for r in queries.read(spark, SF, "documents").collect()}
    rows = queries.op8_hmm(spark, SF).collect()
    assert len(rows) == len(texts) and all(r["held_out"] == held(r["doc_id"], 7, 2) for r in rows)
    check_base(rows, texts, [t for d, t in texts.items() if not held(d, 7, 2)])
    outside = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in outside) > sum(r["base_score"] for r in outside)


def test_language_model_edges_and_rare_tokens(spark):
    frame = edges(spark)
    train = spark.createDataFrame([(i, f"word same w{i} A b") for i in range(30)], "doc_id long, text string")
    rows = hmm_lm.score(frame, train).collect()
    assert len(rows) == len(EDGES)
    check_base(rows, dict(EDGES), [f"word same w{i} A b" for i in range(30)])
    few = hmm_lm.score(frame, train, frequent=3).collect()  # all but the most frequent by the join
    key = lambda r: (r["doc_id"], r["n_known"], round(r["base_score"], 6), round(r["score"], 4))
    assert sorted(map(key, few)) == sorted(map(key, rows))
    assert len(hmm_lm.score(frame, train.limit(0)).collect()) == len(EDGES)


def test_forward_sums_all_paths():
    rng = np.random.default_rng(1)
    a, b, start = rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T, rng.dirichlet(np.ones(3))
    seqs = [[0, 4, 2], [1], [3, 3, 0, 1]]
    at = np.r_[0, np.cumsum([len(s) for s in seqs])]
    got, _ = hmm_lm._forward(b, a, start, np.concatenate(seqs), at)
    for s, g in zip(seqs, got, strict=True):
        total = 0.0
        for path in itertools.product(range(3), repeat=len(s)):
            p = start[path[0]] * b[s[0], path[0]]
            for i in range(1, len(s)):
                p *= a[path[i - 1], path[i]] * b[s[i], path[i]]
            total += p
        assert math.isclose(g, math.log10(total), rel_tol=1e-9)


def test_a_round_of_baum_welch_does_not_lower_the_likelihood(spark):
    train = spark.createDataFrame([(i, " ".join(f"t{(i * j) % 7}" for j in range(30))) for i in range(40)], "doc_id long, text string")
    values = [r["text"].encode() for r in train.collect()]

    def likelihood(m):
        return sum(hmm_lm._forward(m.b, m.a, m.start, hmm_lm._class_of(t), at)[0].sum() for t, at in hmm_lm.token_hashes(values))

    one, three = (hmm_lm.train_hmm(train, states=2, rounds=k) for k in (1, 3))
    assert likelihood(three) >= likelihood(one) - 1
