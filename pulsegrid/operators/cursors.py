"""Incremental reads: lower bounds of repositories and high-water marks of actors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Append, Merge, Store


def since(queue: DataFrame, recollect: float, now: str | Column, full: bool = False) -> DataFrame:
    """repo_id, since: null asks for everything, as for jobs never collected, flagged ones, and all of them with ``full``."""
    at = (F.lit(now) if isinstance(now, str) else now).cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit(recollect).cast("decimal(18,6)"))
    known = F.col("last_collected").isNotNull() & ~F.coalesce("force_full", F.lit(False))
    return queue.select("repo_id", F.when(known & F.lit(not full), at).alias("since"))


def newer(events: DataFrame, marks: DataFrame, actor: str, at: str) -> DataFrame:
    """Events not before their actor's mark, with it; all of an actor without one. Events of the mark's own time come again."""
    mark = marks.select(actor, F.col(at).alias("__mark"))
    return events.filter(F.col(at).isNotNull()).join(mark, actor, "left").filter(F.col("__mark").isNull() | (F.col(at) >= F.col("__mark")))


def append_new(store: Store, name: str, events: DataFrame, key: str, actor: str, at: str, writer: str = "", batch: int | None = None) -> bool:
    """Appends what is new of each actor and moves its mark (table ``<name>_marks``), in one commit.

    Rows are told apart by ``key``; of equal ones the first stays. Only stored rows at or after the actor's mark can be equal
    to new ones, so nothing older is compared. Replays and overlapping reads append nothing twice.
    """
    known = {r.name for r in store.manifest()}
    empty = events.limit(0)
    marks = store.table(f"{name}_marks") if f"{name}_marks" in known else empty.select(actor, at)
    old = store.table(name) if name in known else empty
    edge = newer(old, marks, actor, at).select(key)
    fresh = newer(events, marks, actor, at).drop("__mark").dropDuplicates([key]).join(edge, key, "left_anti").select(*events.columns)
    moved = fresh.groupBy(actor).agg(F.max(at).alias(at))
    return store.commit([Append(name, fresh, by=actor), Merge(f"{name}_marks", moved, [actor], by=actor)], writer, batch)
