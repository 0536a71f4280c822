"""Exact top-k inner-product search with a KD-tree per shard.

Vectors become whole numbers, floor(256 x). Spark deals all rows evenly over shards of bounded size; each task
builds a KD-tree by median splits of the widest side, with tight bounding boxes around its leaves. Queries are
read in blocks from the shared folder. For a query the largest inner product in a box is bounded by
``sum(max(q * low, q * high))``; leaves are visited best-first until no bound reaches the k-th score so far.
That k-th score starts from a small fixed sample of the rows, which every task of queries searches first,
and rises from leaf to leaf; it travels to the shards with the queries. The shards' bests meet by query. Scores are 64-bit
whole numbers throughout.

Vectors that are null, empty or hold null or non-finite components take no part. Vectors are compared with
those of the same dimension. Rows are told apart by vec_id: no row with the query's own id is a candidate,
and of several query rows with one id the smallest vector asks. Equal scores go to the smaller vec_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, open_fs

SHARD, LEAF, BLOCK, SAMPLE = 65_536, 256, 2_048, 8_192
SCHEMA = "query_id long, vec_id long, score long"
NONE = np.iinfo(np.int64).min


def whole(vectors: DataFrame, *more: str) -> DataFrame:
    """vec_id, v: floor(256 x) of the vectors that take part, and ``more`` columns."""
    fine = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    kept = vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("v"), *more)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of the batch, ids, matrix) by dimension."""
    ids, v = batch.column("vec_id").to_numpy(), batch.column("v")
    lens = v.value_lengths().to_numpy()
    flat, at = v.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.r_[0, np.cumsum(lens)]
    for d in np.unique(lens):
        which = np.flatnonzero(lens == d)
        yield which, ids[which], flat[at[which][:, None] + np.arange(d)]


class Tree:
    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order, leaves, stack = np.argsort(ids, kind="stable"), [], [np.arange(len(ids))]
        ids, x = ids[order], x[order]
        while stack:
            part = stack.pop()
            side = np.argmax(np.ptp(x[part], 0))
            if len(part) <= LEAF or np.ptp(x[part, side]) == 0:
                leaves += [part[i : i + LEAF] for i in range(0, len(part), LEAF)]
                continue
            mid = len(part) // 2
            split = np.argpartition(x[part, side], mid)
            stack += [np.sort(part[split[mid:]]), np.sort(part[split[:mid]])]
        self.ids, self.x = [ids[p] for p in leaves], [x[p] for p in leaves]
        self.low, self.high = (np.array([f(v, 0) for v in self.x], np.float64) for f in (np.min, np.max))
        self.first = np.array([i.min() for i in self.ids])
        self.most = float(np.abs(x.astype(np.float64)).max(initial=0))
        self.real = [v.astype(np.float64) for v in self.x]

    def search(self, qid: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best k (scores, ids) of each query; missing ones have id -1. floor: a score that k candidates are known to reach."""
        real = q.astype(np.float64)
        most = self.most * float(np.abs(real).max(initial=0)) * q.shape[1]
        exact = most < 2**52  # then sums of doubles are whole numbers without error, and faster
        bound = np.maximum(real, 0) @ self.high.T + np.minimum(real, 0) @ self.low.T
        bound += 0 if exact else most * q.shape[1] * 1e-15  # more than rounding can take away
        turn = np.argsort(-bound, axis=1, kind="stable")
        none = np.iinfo(np.int64).max
        best, who = np.full((len(q), k), NONE), np.full((len(q), k), none)
        live = np.arange(len(q))
        for r in range(len(self.ids)):
            leaf = turn[live, r]
            b, kth, last = bound[live, leaf], np.maximum(best[live, -1], floor[live]), who[live, -1]
            go = b >= kth
            live, leaf = live[go], leaf[go]
            b, kth, last = b[go], kth[go], last[go]
            if not len(live):
                break
            # A tied bound helps only if the leaf has a smaller id than the k-th.
            use = (b > kth) | (self.first[leaf] < last) | (best[live, -1] < kth)
            order = np.argsort(leaf[use], kind="stable")
            rows, leaf = live[use][order], leaf[use][order]
            for part in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(leaf)) + 1) if len(rows) else ():
                i, at = rows[part], leaf[part[0]]
                s = (real[i] @ self.real[at].T).astype(np.int64) if exact else q[i] @ self.x[at].T
                s[qid[i][:, None] == self.ids[at][None, :]] = NONE
                better = s.max(1) >= np.maximum(best[i, -1], floor[i])
                if not better.any():
                    continue
                i, s = i[better], s[better]
                all_s = np.hstack([best[i], s])
                all_i = np.hstack([who[i], np.broadcast_to(self.ids[at], s.shape)])
                top = np.lexsort((all_i, ~all_s), axis=1)[:, :k]
                best[i], who[i] = np.take_along_axis(all_s, top, 1), np.take_along_axis(all_i, top, 1)
        who[best == NONE] = -1
        return best, who


def _blocks(path: str) -> Iterator[pa.RecordBatch]:
    import pyarrow.dataset as ds

    f, p = open_fs(path)
    yield from ds.dataset(p, filesystem=f, format="parquet").to_batches(batch_size=BLOCK)


def _forest(parts: dict[int, list[tuple[np.ndarray, np.ndarray]]]) -> dict[int, Tree]:
    return {d: Tree(np.concatenate([i for i, _ in p]), np.concatenate([x for _, x in p])) for d, p in parts.items()}


def _floors(path: str, k: int):
    """Adds to queries the k-th score that the sample reaches; the sample is bounded and read once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = None
        for batch in batches:
            if trees is None:
                parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
                for block in _blocks(path):
                    for _, ids, x in _rows(block):
                        parts.setdefault(x.shape[1], []).append((ids, x))
                trees = _forest(parts)
            floor = np.full(batch.num_rows, NONE)
            for which, ids, q in _rows(batch):
                if q.shape[1] in trees:
                    s, who = trees[q.shape[1]].search(ids, q, k, floor[which])
                    floor[which] = np.where(who[:, -1] >= 0, s[:, -1], NONE)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(floor, mask=floor == NONE)], ["vec_id", "v", "floor"])

    return run


def _searcher(path: str, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def answer() -> Iterator[pa.RecordBatch]:
            trees = _forest(held)
            held.clear()
            for block in _blocks(path):
                for _, ids, q in _rows(block):
                    tree = trees.get(q.shape[1])
                    if tree is None:
                        continue
                    known = dict(zip(block.column("vec_id").to_pylist(), block.column("floor").to_pylist(), strict=True))
                    floor = np.array([NONE if known[i] is None else known[i] for i in ids.tolist()], np.int64)
                    s, who = tree.search(ids, q, k, floor)
                    ok = (who >= 0) & (s >= floor[:, None])
                    row = np.nonzero(ok)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[row[0]]), pa.array(who[row].astype(np.int64)), pa.array(s[row].astype(np.int64))], ["query_id", "vec_id", "score"])

        for batch in batches:
            for _, ids, x in _rows(batch):
                held.setdefault(x.shape[1], []).append((ids, x))
                size += len(ids)
            if size >= SHARD:
                yield from answer()
                size = 0
        if held:
            yield from answer()

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score. vectors, queries: vec_id, embedding."""
    spark = vectors.sparkSession
    rows, asked = whole(vectors), whole(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    few, path = new_path(spark, "knn-sample"), new_path(spark, "knn-queries")
    n = rows.count()
    sample = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n // SAMPLE))) == 0)
    # Different ids only: the k-th score must be reached by k rows that are candidates.
    sample.dropDuplicates(["vec_id"]).write.parquet(few)
    asked.mapInArrow(_floors(few, k), "vec_id long, v array<long>, floor long").write.parquet(path)
    shards = max(-(-n // SHARD), spark.sparkContext.defaultParallelism)
    found = rows.repartition(shards).mapInArrow(_searcher(path, k), SCHEMA)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
