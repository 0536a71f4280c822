"""Hidden Markov language model over whole texts, with an add-one unigram base.

Corpus counts of every token of the training rows are summed over the cluster. Tokens are 64-bit hashes
of words (two words share one with probability ``V^2 / 2^65``). A token belongs to one of ``CLASSES``
classes by its hash; the model is

    P(text) = sum over state paths of prod A[state, next] * B[state, class] * P(token | class)

with ``P(token | class) = (c + 1) / (N_class + V_class + 1)``: the plus one is the share of tokens never
seen. Baum-Welch runs over all training texts: tasks return expected counts, which are summed by a
shuffle; the model itself (``STATES`` x ``CLASSES``) has a fixed size. The scaled forward recursion then
gives the exact likelihood of each text.

Counts of tokens that make up at least 1 / ``FREQUENT`` of all (there can be no more than ``FREQUENT`` of
them, whatever the corpus) are read by tasks from the shared folder; the other tokens of a text are summed
in its task and joined with their counts by a shuffle, so no token is left out.

Null and empty texts hold only the end token. Repeated rows count and are scored as rows of their own
(the result is by row). Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, lowered_words, mix, new_path, read_columns, table, texts

STATES, CLASSES, ROUNDS = 4, 1 << 12, 3
#: Tokens of a block: longer texts are cut into blocks, whose products are joined (exact, whatever the size).
BLOCK = 1024
FREQUENT = 5_000_000
#: Training texts whose class counts start the states apart; Baum-Welch itself reads all.
SEED_TEXTS = 200
END = mix(np.array([0x656E64], np.uint64))[0]
_loaded: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def token_hashes(values: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per chunk: hashes of the texts' tokens, each text's followed by the end token, and where each text begins (n + 1)."""
    for lo, hi in chunks(values):
        words, at = lowered_words(values[lo:hi])
        yield np.insert(words, at[1:], END), at + np.arange(len(at))


def count_tokens(train: DataFrame) -> DataFrame:
    """h, c: exact counts of all tokens; tasks send sums of bounded many tokens at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            h, inverse = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
            c = np.bincount(inverse, np.concatenate([x[1] for x in held])).astype(np.int64)
            held[:] = [(h, c)]
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])

        size = 0
        for batch in batches:
            for tokens, _ in token_hashes(texts(batch.column("text"))):
                held.append(np.unique(tokens, return_counts=True))
                size += len(held[-1][0])
                if size > 1_500_000:
                    out = flush()
                    size = len(held[0][0])
                    if size > 750_000:
                        yield out
                        held.clear()
                        size = 0
        if held:
            yield flush()

    return train.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _frequent(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and their log10(c + 1); one table is kept per worker."""
    if path not in _loaded:
        _loaded.clear()
        t = read_columns(path, ["h", "c"])
        h, c = t["h"].to_numpy().view(np.uint64), t["c"].to_numpy()
        order = np.argsort(h)
        _loaded[path] = h[order], np.log10(c[order] + 1.0)
    return _loaded[path]


def _blocks(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the blocks of the texts begin (n + 1), the text of each and its place there; a text has at least one."""
    n = np.diff(at)
    many = np.maximum(1, -(-n // BLOCK))
    text = np.repeat(np.arange(len(n)), many)
    place = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    return np.r_[at[:-1][text] + place * BLOCK, at[-1:]], text, place


def _transfer(b: np.ndarray, a: np.ndarray, classes: np.ndarray, at: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Scaled products of the steps in each of the blocks ``which``, from before its first token's emission to after its last one's."""
    begin, n = at[:-1][which], np.diff(at)[which]
    order = np.argsort(-n, kind="stable")
    begin, n = begin[order], n[order]
    product, active = np.tile(np.eye(len(a)), (len(n), 1, 1)), len(n)
    for t in range(int(n[0]) if len(n) else 0):
        while active and n[active - 1] <= t:
            active -= 1
        step = (product[:active] @ a if t else product[:active]) * b[classes[begin[:active] + t]][:, None, :]
        product[:active] = step / step.sum((1, 2), keepdims=True)
    out = np.empty_like(product)
    out[order] = product
    return out


def _ends(b: np.ndarray, a: np.ndarray, start: np.ndarray, classes: np.ndarray, at: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State weights before each block's first token and, backwards, after its last one.

    The blocks of a long text are multiplied step by step all at once and then joined, so the Python steps for
    a text of n tokens are BLOCK + n / BLOCK instead of n.
    """
    before, after = np.tile(start, (len(place), 1)), np.ones((len(place), len(start)))
    inner = np.flatnonzero((place > 0) | (np.r_[place[1:], 0] > 0))  # blocks of texts that have several
    if not len(inner):
        return before, after
    slot = np.zeros(len(place), np.int64)
    slot[inner] = np.arange(len(inner))
    product = _transfer(b, a, classes, at, inner)
    later = np.flatnonzero(place > 0)
    by_place = np.split(later[np.argsort(place[later], kind="stable")], np.cumsum(np.bincount(place[later])[1:])[:-1])
    for j in by_place:
        out = np.einsum("ni,nij->nj", before[j - 1], product[slot[j - 1]])
        before[j] = out / out.sum(1, keepdims=True) @ a
    for j in reversed(by_place):
        back = np.einsum("nij,nj->ni", product[slot[j]], after[j]) @ a.T
        after[j - 1] = back / back.sum(1, keepdims=True)
    return before, after


def _run_blocks(b: np.ndarray, a: np.ndarray, before: np.ndarray, classes: np.ndarray, at: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Scaled forward recursion in all blocks at once: log10 of the scales by block and, if asked, the scaled alphas."""
    n = np.diff(at)
    order = np.argsort(-n, kind="stable")
    begin, n = at[:-1][order], n[order]
    total = np.zeros(len(n))
    alphas = np.zeros((len(classes), before.shape[1])) if keep else None
    alpha, active = before[order], len(n)
    for t in range(int(n[0]) if len(n) else 0):
        while active and n[active - 1] <= t:
            active -= 1
        alpha = (alpha[:active] @ a if t else alpha[:active]) * b[classes[begin[:active] + t]]
        scale = alpha.sum(1)
        alpha /= scale[:, None]
        total[:active] += np.log10(scale)
        if keep:
            alphas[begin[:active] + t] = alpha
    out = np.zeros(len(n))
    out[order] = total
    return out, alphas


def _forward(b: np.ndarray, a: np.ndarray, start: np.ndarray, classes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 likelihoods of several texts at once, and their parts by block."""
    cuts, text, place = _blocks(at)
    before, _ = _ends(b, a, start, classes, cuts, place)
    logs, _ = _run_blocks(b, a, before, classes, cuts, False)
    return np.bincount(text, logs, len(at) - 1), logs


def _expected(b: np.ndarray, a: np.ndarray, start: np.ndarray, classes: np.ndarray, at: np.ndarray):
    """Expected state-by-class, transition and start counts (Baum-Welch E step)."""
    cuts, _, place = _blocks(at)
    before, after = _ends(b, a, start, classes, cuts, place)
    _, alphas = _run_blocks(b, a, before, classes, cuts, True)
    n = np.diff(cuts)
    order = np.argsort(-n, kind="stable")
    begin, n, after = cuts[:-1][order], n[order], after[order]
    gamma, moves = np.zeros_like(alphas), np.zeros_like(a)
    beta, active = after.copy(), 0

    def between(here: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        back = ahead @ a.T
        scale = (alphas[here] * back).sum(1)[:, None]
        return a * ((alphas[here] / scale).T @ ahead), back / scale

    for t in range(int(n[0]) - 1 if len(n) else -1, -1, -1):
        more = active
        while more < len(n) and n[more] > t:
            more += 1
        here = begin[:more] + t
        if active:
            found, beta[:active] = between(here[:active], beta[:active] * b[classes[begin[:active] + t + 1]])
            moves += found
        active = more
        gamma[here] = alphas[here] * beta[:active]
    gamma /= gamma.sum(1, keepdims=True)
    first = np.empty_like(beta)
    first[order] = beta
    later = np.flatnonzero(place > 0)
    if len(later):  # the steps from block to block
        at_first = cuts[:-1][later]
        moves += between(at_first - 1, first[later] * b[classes[at_first]])[0]
    emit = np.stack([np.bincount(classes, gamma[:, k], b.shape[0]) for k in range(len(start))], 1)
    return emit, moves, gamma[at[:-1][np.diff(at) > 0]].sum(0)


def _class_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(40)).astype(np.int64) % CLASSES


def _grouped(values: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Class sequences of texts of like length together, so that few time steps serve many texts."""
    order = sorted(range(len(values)), key=lambda i: len(values[i] or b""))
    for tokens, at in token_hashes([values[i] for i in order]):
        yield _class_of(tokens), at


def _other(tokens: np.ndarray, at: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and number in that text of the tokens that are not hit, by text."""
    which = np.flatnonzero(~hit)
    row, h = np.searchsorted(at, which, side="right") - 1, tokens[which]
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, np.int64)
    return row[first], h[first], np.diff(np.r_[first, len(h)])


class Model:
    """start (K), a (K, K), b (CLASSES, K): columns of b sum to one."""

    def __init__(self, b, a, start):
        self.b, self.a, self.start = b, a, start


def train_hmm(train: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> Model:
    ids = train.filter("length(text) > 200").select("doc_id", F.xxhash64("doc_id").alias("h")).distinct().orderBy("h", "doc_id").limit(SEED_TEXTS)
    ids = [r["doc_id"] for r in ids.collect()]  # ids first: tasks send a few numbers and not their texts
    sample = train.filter(F.col("doc_id").isin(ids) & (F.length("text") > 200)).groupBy("doc_id").agg(F.min("text").alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id").select("text").toPandas()
    seen = [np.bincount(_class_of(t), minlength=CLASSES) for v in sample["text"] for t, _ in token_hashes([v.encode()])]
    everything = np.sum(seen, axis=0) + 1.0 if seen else np.ones(CLASSES)
    rows = np.array([np.sqrt(s / s.sum()) for s in seen]) if seen else np.zeros((0, CLASSES))
    centres = [np.sqrt(everything / everything.sum())]
    while len(centres) <= states and len(rows):  # the text least like the centres so far
        centres.append(rows[np.argmin(np.max(rows @ np.array(centres[1:] or centres).T, 1))])
    centres = centres[1:] or [np.random.default_rng(k).random(CLASSES) for k in range(states)]
    for _ in range(4):
        own = np.argmax(rows @ np.array(centres).T, 1) if len(rows) else np.zeros(0, int)
        sums = [np.sum([s for s, k in zip(seen, own, strict=True) if k == j], axis=0) for j in range(states)]
        centres = [np.sqrt(s / s.sum()) if np.ndim(s) and s.sum() else c for s, c in zip(sums, centres, strict=False)]
    b = np.stack([(c**2 / (c**2).sum() + 0.2 * everything / everything.sum()) for c in centres], 1)
    b /= b.sum(0)
    a = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(a, 0.9 if states > 1 else 1)
    model = Model(b, a, np.full(states, 1 / states))
    for _ in range(rounds):
        model = _reestimate(train, model)
    return model


def _reestimate(train: DataFrame, m: Model) -> Model:
    k = len(m.start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emit, moves, start = np.zeros_like(m.b), np.zeros_like(m.a), np.zeros_like(m.start)
        for batch in batches:
            for classes, at in _grouped(texts(batch.column("text"))):
                e, x, s = _expected(m.b, m.a, m.start, classes, at)
                emit += e
                moves += x
                start += s
        for what, values in enumerate((emit, moves, start)):
            flat = values.ravel()
            i = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), what, np.int32)), pa.array(i), pa.array(flat[i])], ["what", "i", "x"])

    sums = train.select("text").mapInArrow(run, "what int, i long, x double").groupBy("what", "i").agg(F.sum("x").alias("x")).toPandas()
    out = [np.zeros(n) for n in (CLASSES * k, k * k, k)]
    for what, part in sums.groupby("what"):
        out[what][part["i"].to_numpy()] = part["x"].to_numpy()
    b = out[0].reshape(CLASSES, k) + 0.01
    a = out[1].reshape(k, k) + 0.1
    start = out[2] + 0.1
    return Model(b / b.sum(0), a / a.sum(1, keepdims=True), start / start.sum())


def score(docs: DataFrame, train: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``; learns from ``train``."""
    spark = docs.sparkSession
    path = new_path(spark, "lm-counts")
    count_tokens(train).withColumn("k", F.pmod(F.shiftrightunsigned("h", 40), F.lit(CLASSES)).cast("int")).write.parquet(path)
    counts = spark.read.parquet(path)
    # CLASSES rows.
    by_class = counts.groupBy("k").agg(F.sum("c").alias("n"), F.count("*").alias("v")).toPandas()
    big_n, big_v = int(by_class["n"].sum()), int(by_class["v"].sum())
    size = np.zeros(CLASSES)
    size[by_class["k"].to_numpy(np.int64)] = (by_class["n"] + by_class["v"]).to_numpy(float)
    least = max(1, -(-big_n // frequent))
    hot = new_path(spark, "lm-frequent")
    counts.filter(F.col("c") >= least).select("h", "c").write.parquet(hot)
    model = train_hmm(train)
    log_size, log_all = np.log10(size + 1), np.log10(big_n + big_v + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, logs = _frequent(hot)
        for batch in batches:
            values = texts(batch.column("text"))
            order = sorted(range(len(values)), key=lambda i: len(values[i] or b""))
            done = 0
            for tokens, at in token_hashes([values[i] for i in order]):
                classes = _class_of(tokens)
                path_log, _ = _forward(model.b, model.a, model.start, classes, at)
                pos = np.minimum(np.searchsorted(known, tokens), max(0, len(known) - 1))
                hit = known[pos] == tokens if len(known) else np.zeros(len(tokens), bool)
                got = np.where(hit, logs[pos], 0.0) if len(known) else np.zeros(len(tokens))
                n = np.diff(at)
                row, h, tf = _other(tokens, at, hit if least > 1 else np.ones(len(tokens), bool))
                rest = pa.StructArray.from_arrays([pa.array(h.view(np.int64)), pa.array(tf)], ["h", "tf"])
                cols = [
                    batch.column("doc_id").take(pa.array(order[done : done + len(n)])), pa.array(n), pa.array(np.add.reduceat(hit.astype(np.int64), at[:-1])),
                    pa.array(np.add.reduceat(got, at[:-1])), pa.array(path_log - np.add.reduceat(log_size[classes], at[:-1])),
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(n) + 1)).astype(np.int32)), rest),
                ]
                done += len(n)
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "n_known", "sum_log", "path", "rest"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, sum_log double, path double, rest array<struct<h: long, tf: long>>")
    if least > 1:  # the other tokens: counts come by a join, sums go back by row
        rows = table(rows.withColumn("row", F.monotonically_increasing_id()), "lm-rows")
        other = rows.select("row", F.inline("rest"))
        found = other.join(counts.filter(F.col("c") < least).select("h", "c"), "h")
        found = found.groupBy("row").agg(F.sum("tf").alias("more"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("more_log"))
        rows = rows.join(found, "row", "left")
        rows = rows.withColumn("n_known", F.col("n_known") + F.coalesce("more", F.lit(0))).withColumn("sum_log", F.col("sum_log") + F.coalesce("more_log", F.lit(0.0)))
    return rows.select(
        "doc_id", "n_tokens", "n_known", F.lit(big_n).cast("long").alias("train_tokens"),
        (F.col("sum_log") - F.col("n_tokens") * F.lit(float(log_all))).alias("base_score"), (F.col("sum_log") + F.col("path")).alias("score"),
    )
