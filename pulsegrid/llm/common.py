"""Small shared helpers: scratch tables, whole-text bytes, vectorised word hashing, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space 0x09-0x0D and 0x20: the separators of ``[^\x20\x09-\x0D]+`` words.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Lower-cases A-Z and turns every ASCII character that is no digit or letter into a blank,
#: so that ``.translate(ALNUM).split()`` yields the ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` words.
ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
CHUNK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``; set here only where unset and all is one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Rows of whole texts that go to a task's Python at once, where the session leaves Spark's default.
BATCH_ROWS = "1000"


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, BATCH_ROWS)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, shuffle files go as each query ends, and not only when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(*frames: DataFrame) -> None:
    """Delete scratch tables made by ``table`` once no later plan reads them."""
    for df in frames:
        spark = df.sparkSession
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """No rows. An empty list would do, but Spark reads lists by Python processes of their own, beside the workers that hold its functions."""
    return spark.range(0).select(F.lit(None).cast(f"struct<{schema}>").alias("s")).select("s.*").filter(F.lit(False))


#: Caches that tasks leave in their worker for later ones of their kind, by kind.
caches: dict[str, dict] = {}


def give_back(own: str) -> None:
    """In a task: what other kinds left in this worker, which lives on through all stages, returns to the system; its own kind's stays."""
    others = [c for kind, c in caches.items() if kind != own and c]
    for c in others:
        c.clear()
    if others:
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # else freed pages stay with the process
            trim(0)


def open_fs(path: str):
    """(filesystem, path) of a URI in the shared folder, for code inside tasks."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file:///"):
        path = "file:///" + path[6:].lstrip("/")
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def read_columns(path: str, columns: list[str], filters=None) -> pa.Table:
    """Read a (bounded) Parquet folder of the shared folder inside a task."""
    import pyarrow.dataset as ds

    f, p = open_fs(path)
    return ds.dataset(p, filesystem=f, format="parquet", exclude_invalid_files=False).to_table(columns=columns, filter=filters)


def texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column; null stays None."""
    return column.cast(pa.binary()).to_pylist()


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A batch's rows a few at a time, so that what a task makes of them stays small."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def chunks(values: list[bytes | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of at most ``limit`` bytes, one value at least."""
    begin = size = 0
    for i, v in enumerate(values):
        n = len(v or b"") + 1
        if i > begin and size + n > limit:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(values):
        yield begin, len(values)


_MUL, _INV = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_power: dict[str, np.ndarray] = {}
caches["words"] = _power


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "r" not in _power or len(_power["r"]) < n:
        n = max(n, CHUNK_BYTES + 4096)
        for k, m in (("r", _MUL), ("i", _INV)):
            p = np.full(n, m, np.uint64)
            p[0] = 1
            _power[k] = np.multiply.accumulate(p)
    return _power["r"], _power["i"]


def lowered_words(values: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all white-space-separated words, A-Z lowered, and where each text's words begin (n + 1)."""
    joined = np.frombuffer(b" ".join((v or b"").lower() for v in values) + b" ", np.uint8)
    word = ~SPACE[joined]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    begin, end = edge[::2], edge[1::2]
    r, inv = _powers(len(joined) + 1)
    total = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum(_BYTE[joined] * r[: len(joined)], out=total[1:])
    hashes = mix((total[end] - total[begin]) * inv[begin])
    starts = np.zeros(len(values) + 1, np.int64)
    np.cumsum([len(v or b"") + 1 for v in values], out=starts[1:])
    return hashes, np.searchsorted(begin, starts)


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, component) for every node of the undirected ``edges`` (a, b: long); component is one of its nodes.

    Random-order minimum hooking with contraction: every round maps each node to the neighbour of
    the smallest hash, relabels the edges and drops loops, so the edge table shrinks by a constant
    factor a round. Hubs are safe: minima combine before the shuffle, and the relabelling joins a
    written table, which adaptive execution splits where a key is hot.
    """
    spark = edges.sparkSession
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    live = table(edges.filter("a <> b").distinct(), f"{name}-edges")
    maps: list[DataFrame] = []
    while live.limit(1).count():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min(order("b")).alias("m"))
        hook = table(hook.select(F.col("a").alias("node"), F.least(order("a"), "m")["id"].alias("to")), f"{name}-hook")
        maps.append(hook)
        left = live.join(hook.withColumnRenamed("node", "a"), "a").select(F.col("to").alias("x"), "b")
        left = left.join(hook.select(F.col("node").alias("b"), F.col("to").alias("y")), "b").filter("x <> y")
        nxt = left.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        nxt = table(nxt, f"{name}-edges")
        drop_tables(live)
        live = nxt
    drop_tables(live)
    if not maps:
        return empty(spark, "node long, component long")
    result = maps[0].withColumnRenamed("to", "component")
    for m in maps[1:]:
        result = result.join(m.select(F.col("node").alias("component"), "to"), "component", "left")
        result = result.select("node", F.coalesce("to", "component").alias("component"))
    out = table(result, f"{name}-labels")
    drop_tables(*maps)
    return out


def smallest_of(labels: DataFrame) -> DataFrame:
    """(node, component): relabel every component by its smallest node."""
    least = table(labels.groupBy("component").agg(F.min("node").alias("least")), "least")
    return labels.join(least, "component").select("node", F.col("least").alias("component"))


def bucket_of(column: str, n: int):
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(n))


def positive_hash(*columns) -> Column:
    return F.xxhash64(*columns).bitwiseAND(F.lit(2**63 - 1))


def least_hash(wanted: float, n: int) -> int:
    """The bound of ``positive_hash`` that about ``wanted`` of n rows keep; it never falls to nothing."""
    return min(2**63 - 1, int(wanted / max(1, n) * 2**63))
