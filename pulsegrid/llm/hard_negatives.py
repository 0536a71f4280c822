"""Hard negatives by angular triangle filtering, exact.

Vectors become whole numbers, floor(256 x). A bounded sample gives ``DIRECTIONS`` reference directions, far from each
other; every row lies in the cell of its nearest one. Spark sorts all rows by cell and angle over range partitions, which
part hot cells, and each task writes them as blocks of at most ``BLOCK`` rows, with their angles to all directions, into the
shared folder; the table of blocks keeps for each the least and greatest angle and norm.

Anchors are searched in groups of neighbours. For an anchor at angle s to a direction and a row at angle t the angle
between them lies in [|s - t|, s + t]; its cosine times both norms, widened by more than rounding can take, bounds the
score. Whole blocks whose interval misses what an anchor still seeks are not read; in a block that is read the angle to
its own direction is sorted, so the rows that can reach the sought scores are a window, and only windows are scored,
in whole numbers. First the positives are sought, by their k-th score so far, then negatives between the two shares of
each positive's score, by the k-th so far of each.

Rows with a null id, a null label, a null or empty vector or a null or non-finite component take no part. Vectors are
compared with those of the same dimension. Rows with the anchor's own id are no candidates; of several anchor rows with
one id that of the smallest vector and label asks. Repeated rows are candidates of their own. Equal scores go to the
smaller id. Vectors so long that scores could pass 2^62 are refused with an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import least_hash, new_path, open_fs, positive_hash
from .kdtree import whole

#: Rows of the sample that directions are taken from, directions, rows of a block, anchors searched together, blocks weighed together.
SAMPLE, DIRECTIONS, BLOCK, GROUP, WEIGHED = 1_024, 16, 2_048, 512, 4_096
SLACK, NONE = 2e-6, np.iinfo(np.int64).min
ROWS = "d int, cell int, angle double, vec_id long, label long, v array<long>"
BLOCKS = "d int, cell int, path string, start long, n int, kind string, near array<double>, far array<double>, short double, long double, most double, label_low long, label_high long"
FOUND = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def directions(sample: list[list[int]]) -> dict[int, np.ndarray]:
    """Unit vectors of each dimension, each the farthest from those before it."""
    out = {}
    for d in sorted({len(v) for v in sample}):
        x = np.array(sorted(v for v in sample if len(v) == d), np.float64)
        x = x[(x != 0).any(1)]
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        chosen = [0] if len(x) else []
        nearest = np.full(len(x), -np.inf)
        while chosen and len(chosen) < DIRECTIONS:
            nearest = np.maximum(nearest, x @ x[chosen[-1]])
            if nearest.min() > 1 - 1e-9:
                break
            chosen.append(int(nearest.argmin()))
        if chosen:
            out[d] = x[chosen]
    return out


def _angles(x: np.ndarray, refs: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Angles to the directions of the dimension (pi / 2 for zero vectors) and norms."""
    real = x.astype(np.float64)
    norm = np.linalg.norm(real, axis=1)
    to = refs.get(x.shape[1], np.empty((0, x.shape[1])))
    return np.arccos(np.clip(real @ to.T / np.where(norm > 0, norm, 1)[:, None], -1, 1)), norm


def _matrix(v: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) by dimension."""
    lens = v.value_lengths().to_numpy()
    flat, at = v.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.r_[0, np.cumsum(lens)]
    for d in np.unique(lens):
        which = np.flatnonzero(lens == d)
        yield which, flat[at[which][:, None] + np.arange(d)]


def _placer(refs: dict[int, np.ndarray]):
    """Adds dimension, cell and the angle to the cell's direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for which, x in _matrix(batch.column("v")):
                theta, _ = _angles(x, refs)
                cell = theta.argmin(1) if theta.shape[1] else np.zeros(len(x), int)
                angle = theta[np.arange(len(x)), cell] if theta.shape[1] else np.zeros(len(x))
                part = batch.take(pa.array(which))
                columns = [pa.array(np.full(len(x), x.shape[1], np.int32)), pa.array(cell.astype(np.int32)), pa.array(angle), part.column("vec_id"), part.column("label"), part.column("v")]
                yield pa.RecordBatch.from_arrays(columns, ["d", "cell", "angle", "vec_id", "label", "v"])

    return run


def _writer(refs: dict[int, np.ndarray], folder: str, most: int):
    """Writes sorted rows as blocks into one file a task and yields the table of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, out, start = f"{folder}/{uuid.uuid4().hex}", None, 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        key: tuple[int, int] | None = None

        def block(n: int) -> dict:
            nonlocal held, out, start
            ids, labels, x = (np.concatenate(c) for c in zip(*held, strict=True))
            held = [(ids[n:], labels[n:], x[n:])] if len(ids) > n else []
            ids, labels, x = ids[:n], labels[:n], x[:n]
            theta, norm = _angles(x, refs)
            if theta.shape[1]:
                order = np.argsort(theta[:, key[1]], kind="stable")
                ids, labels, x, theta, norm = ids[order], labels[order], x[order], theta[order], norm[order]
            kind = next(t for t in ("i1", "i2", "i4", "i8") if np.iinfo(t).min <= x.min() and x.max() <= np.iinfo(t).max)
            data = ids.tobytes() + labels.tobytes() + (theta[:, key[1]] if theta.shape[1] else np.zeros(len(x))).tobytes() + x.astype(kind).tobytes()
            if out is None:
                fs, p = open_fs(path)
                fs.create_dir(p.rsplit("/", 1)[0], recursive=True)
                out = fs.open_output_stream(p)
            out.write(data)
            row = {"d": key[0], "cell": key[1], "path": path, "start": start, "n": n, "kind": kind, "near": theta.min(0).tolist(), "far": theta.max(0).tolist()}
            start += len(data)
            return row | {"short": norm.min(), "long": norm.max(), "most": float(np.abs(x.astype(np.float64)).max()), "label_low": int(labels.min()), "label_high": int(labels.max())}

        def frame(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, schema)

        f8 = pa.float64()
        schema = pa.schema([("d", pa.int32()), ("cell", pa.int32()), ("path", pa.string()), ("start", pa.int64()), ("n", pa.int32()), ("kind", pa.string()), ("near", pa.list_(f8)), ("far", pa.list_(f8)), ("short", f8), ("long", f8), ("most", f8), ("label_low", pa.int64()), ("label_high", pa.int64())])
        for batch in batches:
            rows = []
            d, cell = (batch.column(c).to_numpy() for c in ("d", "cell"))
            edges = np.flatnonzero((np.diff(d) != 0) | (np.diff(cell) != 0)) + 1
            for i, j in zip(np.r_[0, edges], np.r_[edges, len(d)], strict=True):
                if j == i:
                    continue
                if (d[i], cell[i]) != key:
                    rows += [block(sum(len(h[0]) for h in held))] if held else []
                    key = int(d[i]), int(cell[i])
                part = batch.slice(i, j - i)
                x = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(j - i, key[0])
                held.append((part.column("vec_id").to_numpy(), part.column("label").to_numpy(), x))
                while sum(len(h[0]) for h in held) >= most:
                    rows.append(block(most))
            if rows:
                yield frame(rows)
        if held:
            yield frame([block(sum(len(h[0]) for h in held))])
        if out is not None:
            out.close()

    return run


class _Best:
    """The best k (score, id) of each key; kth is the k-th score, or the given floor where fewer are known."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.floor, self.kth = k, floor, floor.copy()
        self.key, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(key):
            return
        key, score, ids = np.r_[self.key, key], np.r_[self.score, score], np.r_[self.id, ids]
        order = np.lexsort((ids, -score, key))
        key, score, ids = key[order], score[order], ids[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        place = np.arange(len(key)) - np.repeat(first, np.diff(np.r_[first, len(key)]))
        kept = place < self.k
        self.key, self.score, self.id = key[kept], score[kept], ids[kept]
        full = self.key[place[kept] == self.k - 1]
        self.kth = self.floor.copy()
        self.kth[full] = np.maximum(self.floor[full], self.score[place[kept] == self.k - 1])


class _Group:
    """Anchors of one dimension and what they search."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, refs: dict[int, np.ndarray], table: str):
        self.ids, self.labels, self.x, self.table = ids, labels, x, table
        self.real = x.astype(np.float64)
        self.theta, self.norm = _angles(x, refs)
        self.most = float(np.abs(self.real).max())

    def _blocks(self) -> Iterator[dict]:
        """The table of blocks a bounded number at a time, as columns."""
        import pyarrow.dataset as ds

        fs, p = open_fs(self.table)
        kept = ds.field("d") == self.x.shape[1]
        for batch in ds.dataset(p, filesystem=fs, format="parquet").to_batches(batch_size=WEIGHED, filter=kept):
            if batch.num_rows:
                t = {c: batch.column(c).to_pylist() for c in ("path", "start", "kind")}
                t |= {c: batch.column(c).to_numpy() for c in ("cell", "n", "short", "long", "most", "label_low", "label_high")}
                yield t | {c: batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in ("near", "far")}

    def _bounds(self, t: dict) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score of each anchor with any row of each block."""
        low, high = np.zeros((len(self.ids), len(t["n"]))), np.full((len(self.ids), len(t["n"])), np.pi)
        for j in range(t["near"].shape[1]):
            s, near, far = self.theta[:, j, None], t["near"][None, :, j], t["far"][None, :, j]
            np.maximum(low, np.maximum(s - far, near - s) - SLACK, out=low)
            np.minimum(high, s + far + SLACK, out=high)
        least, greatest = np.cos(high), np.cos(low)
        least *= np.where(least < 0, t["long"], t["short"])
        greatest *= np.where(greatest > 0, t["long"], t["short"])
        slack = 1 + 1e-9 * self.norm[:, None] * t["long"]
        return self.norm[:, None] * least - slack, self.norm[:, None] * greatest + slack

    def seek(self, wanted, take) -> None:
        """Offers the scores of all rows that may count. wanted(): sought (least, greatest) score of each anchor, narrowing as take adds."""
        for t in self._blocks():
            if (len(t["n"]) and self.most * t["most"].max() * self.x.shape[1]) >= 2.0**62:
                raise ValueError("vectors are too long for scores in 64-bit whole numbers")
            least, greatest = self._bounds(t)
            for b in np.argsort(-greatest.max(0), kind="stable"):
                low, high = wanted(t["label_low"][b], t["label_high"][b])
                need = np.flatnonzero((greatest[:, b] >= low) & (least[:, b] <= high) & (low <= high))
                if len(need):
                    self._score(t, b, need, low[need], high[need], take)

    def _score(self, t: dict, b: int, need: np.ndarray, low: np.ndarray, high: np.ndarray, take) -> None:
        n, d, kind = int(t["n"][b]), self.x.shape[1], np.dtype(t["kind"][b])
        fs, p = open_fs(t["path"][b])
        with fs.open_input_file(p) as f:
            data = f.read_at(24 * n + n * d * kind.itemsize, t["start"][b])
        ids, labels, theta = (np.frombuffer(data, k, n, 8 * n * i) for i, k in enumerate((np.int64, np.int64, np.float64)))
        x = np.frombuffer(data, kind, n * d, 24 * n).reshape(n, d)
        begin, end = np.zeros(len(need), int), np.full(len(need), n)
        if t["near"].shape[1]:
            own = self.theta[need, t["cell"][b]]
            slack = 1 + 1e-9 * self.norm[need] * t["long"][b]
            with np.errstate(divide="ignore", invalid="ignore"):
                reach = (low - slack) / (self.norm[need] * np.where(low - slack > 0, t["long"][b], t["short"][b]))
                over = (high + slack) / (self.norm[need] * np.where(high + slack > 0, t["short"][b], t["long"][b]))
            wide = np.arccos(np.clip(np.nan_to_num(reach, nan=-1.0), -1, 1)) + SLACK
            close = np.arccos(np.clip(np.nan_to_num(over, nan=1.0), -1, 1)) - SLACK
            begin = np.searchsorted(theta, np.maximum(own - wide, close - own), "left")
            end = np.searchsorted(theta, own + wide, "right")
        order = np.argsort(begin, kind="stable")
        exact = self.most * t["most"][b] * d < 2**52  # then sums of doubles are whole numbers without error
        for part in np.array_split(order, -(-len(order) // 64)):
            part = part[end[part] > begin[part]]
            if not len(part):
                continue
            i, j = begin[part].min(), end[part].max()
            who = need[part]
            scores = (self.real[who] @ x[i:j].astype(np.float64).T).astype(np.int64) if exact else self.x[who] @ x[i:j].astype(np.int64).T
            scores[self.ids[who][:, None] == ids[None, i:j]] = NONE
            take(who, scores, ids[i:j], labels[i:j])

    def positives(self, k: int) -> _Best:
        best = _Best(np.full(len(self.ids), NONE), k)

        def wanted(first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
            here = (self.labels >= first) & (self.labels <= last)
            return best.kth.astype(np.float64), np.where(here, np.inf, -np.inf)

        def take(who, scores, ids, labels) -> None:
            a, r = np.nonzero((scores >= best.kth[who][:, None]) & (scores > NONE) & (labels[None, :] == self.labels[who][:, None]))
            best.add(who[a], scores[a, r], ids[r])

        self.seek(wanted, take)
        return best

    def negatives(self, positives: _Best, k: int, low: int, high: int) -> _Best:
        """Keys are places in ``positives``; shares are in hundredths."""
        floor = np.array([-(-low * s // 100) for s in positives.score.tolist()], np.int64)
        top = np.array([high * s // 100 for s in positives.score.tolist()], np.int64)
        best = _Best(floor, k)
        of = positives.key
        slot = np.arange(len(of)) - np.searchsorted(of, of)
        width = int(slot.max()) + 1

        def spread(values: np.ndarray, empty: int) -> np.ndarray:
            out = np.full((len(self.ids), width), empty, np.int64)
            out[of, slot] = values
            return out

        tops, places = spread(np.where(floor <= top, top, NONE + 1), NONE + 1), spread(np.arange(len(of)), -1)

        def floors() -> np.ndarray:
            return spread(best.kth, np.iinfo(np.int64).max)

        def wanted(first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
            only = (self.labels == first) & (self.labels == last)
            now = floors()
            open_ = now <= tops
            least, most = np.where(open_, now, np.iinfo(np.int64).max).min(1), np.where(open_, tops, NONE).max(1)
            return least.astype(np.float64), np.where(only | ~open_.any(1), -np.inf, most.astype(np.float64))

        def take(who, scores, ids, labels) -> None:
            least, most = floors()[who], tops[who]
            sought = (scores >= least.min(1)[:, None]) & (scores <= most.max(1)[:, None]) & (labels[None, :] != self.labels[who][:, None])
            a, r = np.nonzero(sought & (scores > NONE))
            s = scores[a, r]
            keys, found, names = [], [], []
            for j in range(width):
                ok = (s >= least[a, j]) & (s <= most[a, j])
                keys.append(places[who[a[ok]], j])
                found.append(s[ok])
                names.append(ids[r[ok]])
            best.add(np.concatenate(keys), np.concatenate(found), np.concatenate(names))

        self.seek(wanted, take)
        return best


def _searcher(refs: dict[int, np.ndarray], table: str, positives: int, negatives: int, low: int, high: int):
    names = [c.split()[0] for c in FOUND.split(", ")]

    def answer(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for which, x in _matrix(batch.column("v")):
            ids, labels = (batch.column(c).to_numpy()[which] for c in ("vec_id", "label"))
            group = _Group(ids, labels, x, refs, table)
            good = group.positives(positives)
            if not len(good.key):
                continue
            bad = group.negatives(good, negatives, low, high)
            first = np.searchsorted(bad.key, bad.key)
            columns = [ids[good.key[bad.key]], good.id[bad.key], (np.arange(len(bad.key)) - first + 1).astype(np.int32), bad.id, good.score[bad.key], bad.score]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, GROUP):
                yield from answer(batch.slice(i, GROUP))

    return run


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, label, embedding. For each anchor its best ``positives`` other rows of the same label, and for each of
    these the best ``negatives`` rows of other labels that score from ``low`` to ``high`` hundredths of the positive's score.
    """
    spark = vectors.sparkSession
    rows = vectors.withColumn("__anchor", F.coalesce(is_anchor, F.lit(False))).filter("label is not null and vec_id is not null")
    rows = whole(rows, "label", "__anchor").withColumn("label", F.col("label").cast("long"))
    n, asked = rows.agg(F.count("*"), F.count_if("__anchor")).first()
    sample = rows.filter(positive_hash("vec_id") <= least_hash(SAMPLE, n)).select("v").limit(2 * SAMPLE).collect()
    refs = directions([r.v for r in sample])
    folder, table = new_path(spark, "negatives-blocks"), new_path(spark, "negatives-table")
    placed = rows.select("vec_id", "label", "v").mapInArrow(_placer(refs), ROWS).withColumn("at", F.monotonically_increasing_id())
    keys = ["d", "cell", "angle", "vec_id", "at"]  # the last parts even equal rows
    placed = placed.repartitionByRange(-(-n // (16 * BLOCK)) or 1, *keys).sortWithinPartitions(*keys)
    placed.mapInArrow(_writer(refs, folder, BLOCK), BLOCKS).write.parquet(table)
    anchors = rows.filter("__anchor").groupBy("vec_id").agg(F.min(F.struct("v", "label")).alias("m")).select("vec_id", "m.label", "m.v")
    tasks = max(1, -(-asked // GROUP), min(spark.sparkContext.defaultParallelism, -(-asked // 32)))
    anchors = anchors.mapInArrow(_placer(refs), ROWS).repartitionByRange(tasks, "d", "cell", "angle", "vec_id").sortWithinPartitions("d", "cell", "angle")
    return anchors.select("vec_id", "label", "v").mapInArrow(_searcher(refs, table, positives, negatives, low, high), FOUND)
