"""Cases that earlier versions got wrong: pair-only terms, large scores, letters, huge counts, many unlinked near copies."""

from __future__ import annotations

import random

import numpy as np
import pytest

from pulsegrid.llm import common, kdtree, langid, licences, ngram_join, pii, toxicity


def test_terms_that_tell_in_pairs_only():
    rng = np.random.default_rng(4)
    a, b = rng.random(1200) < 0.5, rng.random(1200) < 0.5
    labels = (a ^ b).astype(float)
    rows = [np.unique(np.r_[[1] * int(x), [2] * int(y), rng.integers(10, 400, 12)]).astype(np.int32) for x, y in zip(a, b, strict=True)]
    machine = toxicity.fit(rows, labels)
    score = np.array([machine.score({int(t) for t in r}) for r in rows])
    assert ((score > 0.5) == (labels == 1)).mean() > 0.95


def test_scores_beyond_doubles(spark):
    big = 3e8 / 256
    rows = [(0, [big, big])] + [(i, [big + i / 256, big + (i * 7 % 5) / 256]) for i in range(1, 120)]
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    out = kdtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), spark.createDataFrame(rows[:1], "vec_id long, embedding array<double>"), 5).collect()
    want = sorted((-sum(x * y for x, y in zip(whole[0], v, strict=True)), i) for i, v in whole.items() if i)[:5]
    assert [(-r["score"], r["vec_id"]) for r in sorted(out, key=lambda r: r["rank"])] == want and -want[0][0] > 2**53


def test_no_letter_is_und(spark):
    docs = spark.createDataFrame([(i, t, t and lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 20)], "doc_id long, text string, lang string")
    model = langid.learn(docs)
    odd = spark.createDataFrame([(1, "²½Ⅷ 12"), (2, None), (3, ""), (4, "the dog and the cat")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(odd, model).collect()} == {1: "und", 2: "und", 3: "und", 4: "en"}
    assert langid.identify(docs.limit(0), langid.learn(docs.limit(0))).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, langid.learn(docs.limit(0))).collect()} == {"und"}


@pytest.mark.parametrize("n", [1, 1_000, 10**10, 10**14])
def test_samples_never_fall_to_nothing(n):
    assert common.least_hash(1000, n) / 2**63 * n == pytest.approx(min(n, 1000), rel=1e-6)


def test_cues_in_any_spelling_and_licence_places():
    assert [k for _, k, _ in pii.spans("Tax ID 12-3456789, TAX id 98-7654321")] == [4, 4]
    text = b" " + b"under the mit license " * 3000
    assert [i for i, _ in licences.base_places(text)] == list(range(0, 12_000, 4))


def test_scratch_folder_must_be_shared():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: "yarn" if key == "spark.master" else default)

    with pytest.raises(ValueError, match="share"):
        common.shared_dir(Session)


def groups(sets: dict[int, set]) -> dict[int, int]:
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            parent[d] = d = parent[parent[d]]
        return d

    docs = sorted(sets)
    for i, x in enumerate(docs):
        for y in docs[i + 1 :]:
            a, b = sets[x], sets[y]
            inter = len(a & b)
            if 100 * inter >= 75 * (len(a) + len(b) - inter) and root(x) != root(y):
                parent[max(root(x), root(y))] = min(root(x), root(y))
    return {d: root(d) for d in docs}


@pytest.mark.parametrize("edits, n", [((4, 9), 2000), ((1, 9), 700)])
def test_many_near_copies_not_all_linked(spark, edits, n):
    """Copies of a text that is not there itself: most pairs are just too far apart, some link, and none may be lost."""
    rng = random.Random(n)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for doc in range(n):
        words = list(base)
        for _ in range(rng.randint(*edits)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(40)}"
        rows.append((doc, " ".join(words)))
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, t in rows for w in [t.split()]}
    out = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    want = groups(sets)
    assert {r["doc_id"]: r["component_id"] for r in out} == want
    assert 1 < len(set(want.values())) < n


def test_rows_that_share_an_id_are_one_document(spark):
    one, two = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(40))
    rows = [(5, one), (5, two), (5, None), (3, one), (4, two), (9, "c d e")]
    out = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in out.collect()} == {(3, 26, 3), (4, 36, 3), (5, 36, 3), (9, 1, 9)}
