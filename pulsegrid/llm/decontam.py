"""Benchmark decontamination with a positional inverted index sharded by document.

Building: one pass over the documents keeps, as a written table, the postings of the benchmark's terms:
for each document the terms and positions, sorted by term and position. For exact phrases only positions in
a run of benchmark terms at least as long as the shortest window are kept, since no window or phrase can lie
elsewhere; that is exact and leaves a small part of the corpus. A proximity match may lie anywhere, so
``build_index(..., every=True)`` keeps every position of every term.

Searching: corpus counts of the terms come from the index; every window is looked up from its rarest term,
its list intersected with the offset-adjusted lists of the other terms, next rarest first. ``find`` serves
exact phrases and, with ``slop`` on an index of every position, proximity matches in any order and with foreign
words between; ``decontaminate`` marks the words that windows hit.

The benchmark is cut into blocks of at most ``BLOCK_BYTES``, each with its own term numbers and postings;
tasks hold one block at a time, read from the shared folder, so its size has no bound to break.

Null texts have no words; items without words have no windows; an item shorter than a window is one window.
Repeated item ids are one item (the union of their windows); repeated document rows give a row each.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import pickle
import uuid
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, new_path, open_fs, table, texts

WINDOW = 13
BLOCK_BYTES = 4 << 20
INDEX = "doc_id long, n_words long, postings array<struct<block int, terms binary, positions binary>>"
_held: dict[str, dict] = {}


def split_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(ALNUM).split()


def _write(path: str, value) -> None:
    fs, p = open_fs(path)
    fs.create_dir(p.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(p, compression=None) as f:
        f.write(pickle.dumps(value))


def _load(path: str) -> dict:
    if path not in _held:
        fs, p = open_fs(path)
        with fs.open_input_stream(p, compression=None) as f:
            value = pickle.loads(f.read())
        _held.clear()
        _held[path] = value
    return _held[path]


def _block(items: list[tuple[str, list[bytes]]], window: int | None) -> dict:
    terms: dict[bytes, int] = {}
    windows: dict[tuple[int, ...], set[str]] = {}
    for item, words in items:
        ids = [terms.setdefault(w, len(terms)) for w in words]
        n = min(window or len(ids), len(ids))
        for i in range(len(ids) - n + 1):
            windows.setdefault(tuple(ids[i : i + n]), set()).add(item)
    return {"terms": terms, "windows": [(w, sorted(i)) for w, i in windows.items()], "least": min(map(len, windows))}


class Benchmark:
    """The items' words in blocks in the shared folder. window: words of a window; None: whole items only."""

    def __init__(self, items: DataFrame, window: int | None = WINDOW):
        folder = new_path(items.sparkSession, "benchmark")
        items = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
        size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        # Each task writes its own blocks, in the shared folder, and returns their paths only.

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[str, list[bytes]]] = []
            bytes_ = 0

            def write() -> pa.RecordBatch:
                path = f"{folder}/{uuid.uuid4().hex}.pickle"
                _write(path, _block(held, window))
                held.clear()
                return pa.RecordBatch.from_arrays([pa.array([path])], ["path"])

            for batch in batches:
                for item, text in zip(batch.column("item_id").to_pylist(), texts(batch.column("text")), strict=True):
                    if words := split_words(text):
                        held.append((item, words))
                        bytes_ += len(text)
                    if bytes_ > BLOCK_BYTES:
                        yield write()
                        bytes_ = 0
            if held:
                yield write()

        self.paths = [r["path"] for r in items.repartition(1 + size // BLOCK_BYTES).mapInArrow(run, "path string").collect()]

    def rank(self, index: DataFrame) -> None:
        """Order each window's terms by their counts in the index, rarest first."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for postings in batch.column("postings").to_pylist():
                    for p in postings:
                        t, c = np.unique(np.frombuffer(p["terms"], np.int32), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), p["block"], np.int32)), pa.array(t), pa.array(c)], ["block", "term", "n"])

        paths = self.paths

        def order(counts: pd.DataFrame) -> pd.DataFrame:
            path = paths[int(counts["block"].iloc[0])]
            block = _load(path)
            n = np.zeros(len(block["terms"]), np.int64)
            known = counts[counts["term"] >= 0]
            n[known["term"].to_numpy()] = known["n"].to_numpy()
            block["windows"] = [(w, i, tuple(sorted(range(len(w)), key=lambda k: (n[w[k]], k)))) for w, i, *_ in block["windows"]]
            by: dict[int, list[int]] = {}
            for k, (w, _, order) in enumerate(block["windows"]):
                by.setdefault(w[order[0]], []).append(k)
            block["by_rarest"] = by
            _write(f"{path}.ranked", block)  # another file: tasks keep what they have read
            return counts[["block"]].head(1)

        # One job for all blocks; a group holds the terms of one block, which is bounded.
        spark = index.sparkSession
        every = spark.range(len(paths)).select(F.col("id").cast("int").alias("block"), F.lit(-1).alias("term"), F.lit(0).cast("long").alias("n"))
        counts = index.select("postings").mapInArrow(run, "block int, term int, n long").groupBy("block", "term").agg(F.sum("n").alias("n"))
        if paths:
            counts.unionByName(every).groupBy("block").applyInPandas(order, "block int").collect()  # a number for each block
        self.paths = [f"{path}.ranked" for path in paths]


def build_index(docs: DataFrame, bench: Benchmark, every: bool = False) -> DataFrame:
    """INDEX rows, one per document row, written to the shared folder. every: keep all positions, as proximity needs."""
    paths = bench.paths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = texts(batch.column("text"))
            n_words, postings = [], [[] for _ in values]
            words = None
            for b, path in enumerate(paths):
                block = _load(path)
                get, least = block["terms"].get, 1 if every else block["least"]
                for i, v in enumerate(values):
                    words = split_words(v)
                    if b == 0:
                        n_words.append(len(words))
                    if len(words) < least:
                        continue
                    ids = np.fromiter(map(get, words, itertools.repeat(-1)), np.int32, len(words))
                    edge = np.flatnonzero(np.diff(ids >= 0, prepend=False, append=False))
                    begin, end = edge[::2], edge[1::2]
                    long = end - begin >= least
                    if long.any():
                        at = np.concatenate([np.arange(x, y) for x, y in zip(begin[long], end[long], strict=True)]).astype(np.int32)
                        order = np.lexsort((at, ids[at]))
                        postings[i].append({"block": b, "terms": ids[at][order].tobytes(), "positions": at[order].tobytes()})
            if not paths:
                n_words = [len(split_words(v)) for v in values]
            kind = pa.list_(pa.struct([("block", pa.int32()), ("terms", pa.binary()), ("positions", pa.binary())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(postings, kind)], ["doc_id", "n_words", "postings"])

    built = docs.select("doc_id", "text").mapInArrow(run, INDEX)
    index = table(built.withMetadata("postings", {"every": every}), "postings")
    bench.rank(index)
    return index


class _Lists:
    """Position lists of one document."""

    def __init__(self, posting: dict):
        terms, self.at = np.frombuffer(posting["terms"], np.int32), np.frombuffer(posting["positions"], np.int32)
        self.terms, first = np.unique(terms, return_index=True)
        self.begin = dict(zip(self.terms.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(terms)], strict=True), strict=True))

    def of(self, term: int) -> np.ndarray:
        x, y = self.begin.get(term, (0, 0))
        return self.at[x:y]

    def phrase(self, window: tuple[int, ...], order: tuple[int, ...]) -> np.ndarray:
        """Starts of the window: offset-adjusted lists, rarest term first."""
        starts = self.of(window[order[0]]) - order[0]
        for k in order[1:]:
            if not len(starts):
                break
            other = self.of(window[k]) - k
            pos = np.searchsorted(other, starts)
            starts = starts[(pos < len(other)) & (other[np.minimum(pos, len(other) - 1)] == starts)] if len(other) else starts[:0]
        return starts

    def near(self, window: tuple[int, ...], order: tuple[int, ...], slop: int) -> np.ndarray:
        """Positions of the rarest term about which every term of the window occurs within its length plus slop."""
        at, reach = self.of(window[order[0]]), len(window) + slop
        for k in order[1:]:
            if not len(at):
                break
            other = self.of(window[k])
            if not len(other):
                return at[:0]
            pos = np.searchsorted(other, at - reach + 1)
            at = at[(pos < len(other)) & (other[np.minimum(pos, len(other) - 1)] < at + reach)]
        return at


def _matches(posting: dict, path: str, slop: int | None) -> Iterator[tuple[int, np.ndarray]]:
    block, lists = _load(path), _Lists(posting)
    for t in lists.terms.tolist():
        for k in block["by_rarest"].get(t, ()):
            window, _, order = block["windows"][k]
            at = lists.phrase(window, order) if slop is None else lists.near(window, order, slop)
            if len(at):
                yield k, at


def find(index: DataFrame, bench: Benchmark, slop: int | None = None) -> DataFrame:
    """doc_id, item_id, position, n_terms: exact phrase matches of the windows or, with slop, proximity matches.

    An index without every position gives only the proximity matches inside runs of benchmark terms.
    """
    paths = bench.paths
    if slop is not None and not index.schema["postings"].metadata.get("every"):
        warnings.warn("proximity matches are complete only on build_index(..., every=True)", stacklevel=2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, postings in zip(batch.column("doc_id").to_pylist(), batch.column("postings").to_pylist(), strict=True):
                for p in postings:
                    for k, at in _matches(p, paths[p["block"]], slop):
                        window, items, _ = _load(paths[p["block"]])["windows"][k]
                        out += [(doc, i, int(x), len(window)) for i in items for x in at]
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "item_id", "position", "n_terms"])

    return index.mapInArrow(run, "doc_id long, item_id string, position long, n_terms long")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row per document row."""
    bench = Benchmark(items, window)
    index = build_index(docs, bench)
    paths = bench.paths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, n_items, digest = [], [], []
            for n, postings in zip(batch.column("n_words").to_pylist(), batch.column("postings").to_pylist(), strict=True):
                mark, found = np.zeros(n + 1 if postings else 1, np.int32), set()
                for p in postings:
                    for k, at in _matches(p, paths[p["block"]], None):
                        words, items_, _ = _load(paths[p["block"]])["windows"][k]
                        np.add.at(mark, at, 1)
                        np.add.at(mark, at + len(words), -1)
                        found.update(items_)
                hits.append(int((np.cumsum(mark) > 0).sum()))
                n_items.append(len(found))
                digest.append(hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), pa.array(hits, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digest, pa.string())],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"],
            )

    out = index.mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
