"""Best-fit packing by patterns: non-negative least squares over few-document length patterns.

Texts become token pieces in one pass over the documents (written once, with their rank among the
equal lengths of their task). The plan is made from the histogram of piece lengths alone, which has at
most ``capacity`` entries however many documents there are:

1. enumerate patterns of one to three lengths that fill a sequence (exactly, or as nearly as the
   histogram allows);
2. fit non-negative repeat counts to the histogram by projected gradient steps;
3. round down, never using more pieces of a length than there are;
4. pack the residual histogram best-fit, longest first, again as (pattern, repeat) entries.

A pattern slot owns a range of ranks of its length, so that every piece finds its sequence and offset
from its rank by a search in the plan: rows move only to sum the counts of (task, length).

Null texts are empty. Every document ends with the end id, so an empty one has one token. Repeated rows
are packed as rows of their own. Documents longer than a sequence are cut; nothing else is.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, caches, chunks, give_back, table, texts

#: Entries of a worker's cache of white-space-separated chunks; when full it is emptied.
CACHE = 300_000
_tokenizers: dict[str, "_Tokens"] = {}
caches["tokens"] = _tokenizers
#: The tokenizer's splitter parts runs of letters, single digits and runs of marks (but for apostrophes' endings and special tokens).
_PARTS = re.compile(rb"[a-z\x80-\xff]+|[0-9]|[^a-z0-9\x80-\xff]+")


#: Words of letters of a-z and of Latin-1's small ones only, which normalising leaves as they are; chunks of these, digits and marks.
_WORD = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
_MADE = re.compile(rb"(?:[\x00-\x26\x28-\x3b\x3d-\x7f]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
#: Marks that end a pretoken's run only where a letter or digit stands before them.
_MARKS = ".,:;!?"
_CLOSED = f"[a-z0-9][{_MARKS}]+$"


class _Tokens:
    """Ids of whole texts. Neither the normaliser nor the splitter looks across white space, so ids are kept by chunk."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        vocab = self.t.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.kept: dict[bytes, bytes] = {}

    def _ids(self, values: list[str]) -> list[list[int]]:
        return [e.ids for e in self.t.encode_batch_fast(values, add_special_tokens=False)]

    def learn(self, chunks: list[bytes]) -> None:
        """Plain words go through in one call, parted again at their word ends; chunks of words, digits and marks are joined from these; others go one by one."""
        words, other, joined = set(), set(), {}
        for c in chunks:
            if _WORD(c):
                words.add(c)
            elif _MADE(c) and len(parts := _PARTS.findall(c)) > 1:
                joined[c] = parts
                for x in parts:
                    if x not in self.kept:
                        (words if _WORD(x) else other).add(x)
            else:
                other.add(c)
        words, other = list(words), list(other)
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            ids = np.array(self._ids([b" ".join(part).decode()])[0], "<u4")
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(stop) != len(part) or (len(ids) and stop[-1] != len(ids)):
                other += part
                continue
            data, begin = ids.tobytes(), 0
            for c, e in zip(part, (4 * stop).tolist(), strict=True):
                self.kept[c] = data[begin:e]
                begin = e
        for i in range(0, len(other), 20_000):
            part = other[i : i + 20_000]
            for c, ids in zip(part, self._ids([c.decode() for c in part]), strict=True):
                self.kept[c] = np.array(ids, "<u4").tobytes()
        for c, parts in joined.items():
            self.kept[c] = b"".join(map(self.kept.__getitem__, parts))

    def encode(self, values: list[bytes | None]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        for lo, hi in chunks(values, 2 * CHUNK_BYTES):
            lowered = pc.ascii_lower(pa.array([v or b"" for v in values[lo:hi]], pa.binary()).cast(pa.string()))
            split = pc.ascii_split_whitespace(lowered)
            words = split.flatten().dictionary_encode()
            ids = self._of(words.dictionary).take(words.indices)
            _, at, data = ids.buffers()
            ends = np.frombuffer(at, np.int64)[ids.offset : ids.offset + len(ids) + 1][split.offsets.to_numpy()].tolist()
            data = memoryview(data) if data else b""
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                yield bytes(data[a:b])

    def _of(self, distinct: pa.Array) -> pa.Array:
        """Ids of distinct chunks; closing marks after a letter or digit are split off, so that words are kept once."""
        closed = pc.match_substring_regex(distinct, _CLOSED)
        stems = pc.if_else(closed, pc.ascii_rtrim(distinct, _MARKS), distinct).dictionary_encode()
        marks = pc.if_else(closed, pc.replace_substring_regex(distinct, "(?s)^.*[a-z0-9]", ""), "").dictionary_encode()
        both = [texts(x.dictionary) for x in (stems, marks)]
        if len(self.kept) > CACHE:
            self.kept.clear()
        if missing := set().union(*both).difference(self.kept):
            self.learn(list(missing))
        stem, mark = (pa.array(list(map(self.kept.__getitem__, d)), pa.large_binary()).take(x.indices) for d, x in zip(both, (stems, marks), strict=True))
        return pc.binary_join_element_wise(stem, mark, pa.scalar(b"", pa.large_binary()))


def encoder(path: str) -> _Tokens:
    if path not in _tokenizers:
        _tokenizers[path] = _Tokens(path)
    return _tokenizers[path]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, task, rank (among the pieces of this length in this task, from 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        give_back("tokens")
        enc = encoder(tokenizer)
        for batch in batches:
            out: list[list[int]] = [[] for _ in range(7)]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), enc.encode(texts(batch.column("text"))), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    n = len(part) // 4
                    for col, v in zip(out, (doc, piece, at // 4, n, zlib.crc32(part), task, int(seen[n])), strict=True):
                        col.append(v)
                    seen[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])
            pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long")


def enumerate_patterns(have: np.ndarray, capacity: int, limit: int = 12_000) -> list[tuple[int, ...]]:
    """Patterns of one to three of the lengths in ``have`` that leave no room, or the least that can be left."""
    below = np.zeros(capacity + 1, np.int64)  # the longest length that fits into so much room
    last, present = 0, set(have.tolist())
    for i in range(1, capacity + 1):
        last = i if i in present else last
        below[i] = last
    found: set[tuple[int, ...]] = set()
    stride = max(1, len(have) ** 2 // (2 * limit))
    for k, a in enumerate(have[::-1].tolist()):
        b = int(below[capacity - a])
        found.add(tuple(sorted((a, b), reverse=True)) if b else (a,))
        room = capacity - a
        seconds = have[have <= min(a, room)]
        for b in seconds[k % stride :: stride].tolist():
            c = int(below[room - b])
            found.add(tuple(sorted((x for x in (a, b, c) if x), reverse=True)))
    return sorted(found, reverse=True)


def fit_counts(patterns: list[tuple[int, ...]], histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """x >= 0 for which the patterns' lengths come nearest to the histogram (least squares, longer lengths weigh more)."""
    rows = np.array([x for p in patterns for x in p])
    cols = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    weight = np.sqrt(np.arange(len(histogram)) + 1.0) / np.sqrt(len(histogram))
    target = histogram * weight
    apply = lambda x: np.bincount(rows, x[cols], len(histogram)) * weight
    back = lambda r: np.bincount(cols, (r * weight)[rows], len(patterns))
    v = np.ones(len(patterns))
    for _ in range(20):
        v = back(apply(v))
        v /= np.linalg.norm(v) or 1
    rate = 1 / max(np.linalg.norm(apply(v)) ** 2 * 1.05, 1e-12)
    x = y = np.zeros(len(patterns))
    for t in range(steps):
        nxt = np.maximum(0, y - rate * back(apply(y) - target))
        y = nxt + t / (t + 3) * (nxt - x)
        x = nxt
    return x


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that use up the histogram exactly."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    done: list[tuple[tuple[int, ...], int]] = []
    have = np.flatnonzero(left)
    if len(have):
        patterns = enumerate_patterns(have, capacity)
        counts = np.floor(fit_counts(patterns, left.astype(float))).astype(np.int64)
        full = np.array([sum(p) for p in patterns])
        for i in sorted(np.flatnonzero((counts > 0) & (full >= capacity - max(1, capacity // 1000))), key=lambda i: (-full[i], i)):
            need = np.bincount(patterns[i], minlength=capacity + 1)
            n = int(min(counts[i], *(left[x] // need[x] for x in set(patterns[i]))))
            if n:
                left -= n * need
                done.append((patterns[i], n))
    # Residuals, best fit: open[room] holds (pattern, repeats) with so much room left.
    open_: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]
    for length in np.flatnonzero(left)[::-1].tolist():
        n, room = int(left[length]), length
        while n:
            while room <= capacity and not open_[room]:
                room += 1
            if room > capacity:  # new sequences; shorter lengths may still join them
                per = min(n, capacity // length)
                pattern, m, at = (), max(1, n // per), capacity
            else:
                pattern, m = open_[room].pop()
                per, at = min(n, room // length), room
            use = min(m, n // per)
            if m > use:
                open_[at].append((pattern, m - use))
            open_[at - per * length].append(((*pattern, *(length,) * per), use))
            n -= use * per
    return done + [x for group in open_ for x in group]


def _segments(packed: list[tuple[tuple[int, ...], int]], capacity: int):
    """By length: first ranks of its slots' ranges, first sequence and offset of each."""
    used, first = np.zeros(capacity + 1, np.int64), 0
    by: dict[int, list[tuple[int, int, int]]] = {}
    for pattern, n in packed:
        at = 0
        for length in pattern:
            by.setdefault(length, []).append((int(used[length]), first, at))
            used[length] += n
            at += length
        first += n
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in by.items()}


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = table(token_pieces(docs, tokenizer, capacity, end_id), "pack-pieces")
    by_task = table(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "pack-counts")
    # At most ``capacity`` rows.
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    segments = _segments(plan(histogram, capacity), capacity)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = pieces.join(table(base, "pack-bases"), ["task", "length"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("at").to_numpy()
            seq, off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            order = np.argsort(lengths, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else ():
                begin, first, at = segments[int(lengths[part[0]])]
                k = np.searchsorted(begin, ranks[part], side="right") - 1
                seq[part], off[part] = first[k] + ranks[part] - begin[k], at[k]
            cols = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seq), pa.array(off)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    placed = placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("at"))
    return placed.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
