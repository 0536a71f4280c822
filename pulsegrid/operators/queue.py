"""Life cycle of the collection queue as functions of the queue table.

queue: repo_id, priority, status (queued, collecting), due_at, locked_by, locked_at, last_collected, force_full,
last_error. Every function gives the queue after the step. ``streaming.queue`` takes the same steps one by one, with timers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = {"repo_id": "long", "priority": "int", "status": "string", "due_at": "timestamp_ntz", "locked_by": "string", "locked_at": "timestamp_ntz", "last_collected": "timestamp_ntz", "force_full": "boolean", "last_error": "string"}
#: Priority after a job is done.
REST = 100


def _now(now: str | Column) -> Column:
    return (F.lit(now) if isinstance(now, str) else now).cast("timestamp_ntz")


def _seconds(n: float) -> Column:
    return F.make_dt_interval(secs=F.lit(n).cast("decimal(18,6)"))


def _change(queue: DataFrame, where: Column, **new: Column) -> DataFrame:
    """The rows for which it holds, with the new values; null is no."""
    hit = F.coalesce(where, F.lit(False))
    return queue.select(*(F.when(hit, new[c]).otherwise(F.col(c)).cast(t).alias(c) if c in new else F.col(c) for c, t in COLUMNS.items()))


def _marked(queue: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """The queue with the columns of other rows (one for each repo_id) beside it, and whether there are such."""
    return queue.join(rows.dropDuplicates(["repo_id"]).select("repo_id", *(F.col(c).alias(f"__{c}") for c in columns), F.lit(True).alias("__hit")), "repo_id", "left")


def enqueue(queue: DataFrame, new: DataFrame, now: str | Column) -> DataFrame:
    """new: repo_id, priority. Jobs that are known become due unless they are under way; the more urgent priority counts."""
    new = new.groupBy("repo_id").agg(F.min("priority").cast("int").alias("__new"))
    both = queue.withColumn("__old", F.lit(True)).join(new, "repo_id", "full_outer")
    known, asked, busy = F.coalesce(F.col("__old"), F.lit(False)), F.col("__new").isNotNull(), F.col("status") == "collecting"
    idle = asked & F.coalesce(~busy, F.lit(True))
    values = {"priority": F.least("priority", "__new"), "status": F.when(idle, "queued").otherwise(F.col("status")), "due_at": F.when(idle, _now(now)).otherwise(F.col("due_at")), "force_full": F.when(known, F.col("force_full")).otherwise(False)}
    return both.select(*(values.get(c, F.col(c)).cast(t).alias(c) for c, t in COLUMNS.items()))


def prioritise(queue: DataFrame, repos: DataFrame, now: str | Column) -> DataFrame:
    """Due at once, before all others, and free."""
    return _change(_marked(queue, repos), F.col("__hit"), priority=F.lit(0), status=F.lit("queued"), due_at=_now(now), locked_by=F.lit(None), locked_at=F.lit(None))


def claim(queue: DataFrame, workers: list[str], now: str | Column) -> DataFrame:
    """Gives each worker in turn the most urgent due job: by priority, due time, repo_id. As many rows are sorted out as there are workers."""
    due = queue.filter((F.col("status") == "queued") & (F.col("due_at") <= _now(now))).orderBy("priority", "due_at", "repo_id").limit(len(workers)).select("repo_id", "priority", "due_at")
    place = F.row_number().over(Window.orderBy("priority", "due_at", "repo_id"))  # over one row a worker
    taken = due.select("repo_id", F.element_at(F.array(*map(F.lit, workers)), place).alias("worker"))
    return _change(_marked(queue, taken, "worker"), F.col("__hit"), status=F.lit("collecting"), locked_by=F.col("__worker"), locked_at=_now(now))


def heartbeat(queue: DataFrame, beats: DataFrame, now: str | Column) -> DataFrame:
    """beats: repo_id, worker. Only the worker that holds a job keeps it alive."""
    held = beats.select("repo_id", F.col("worker").alias("locked_by")).distinct().withColumn("__hit", F.lit(True))
    return _change(queue.join(held, ["repo_id", "locked_by"], "left"), F.col("__hit") & (F.col("status") == "collecting"), locked_at=_now(now))


def complete(queue: DataFrame, done: DataFrame, recollect: float, now: str | Column) -> DataFrame:
    """done: repo_id, ok, error. Back in the queue after ``recollect`` seconds; a good end clears the flag of a full collection."""
    ok = F.col("__ok")
    return _change(
        _marked(queue, done, "ok", "error"), F.col("__hit"), status=F.lit("queued"), priority=F.lit(REST), due_at=_now(now) + _seconds(recollect), locked_by=F.lit(None), locked_at=F.lit(None), last_collected=_now(now),
        last_error=F.when(~ok, F.col("__error")), force_full=F.when(ok, False).otherwise(F.col("force_full")),
    )


def force_full(queue: DataFrame, repos: DataFrame, value: bool = True) -> DataFrame:
    return _change(_marked(queue, repos), F.col("__hit"), force_full=F.lit(value))


def make_due(queue: DataFrame, now: str | Column) -> DataFrame:
    return _change(queue, (F.col("status") == "queued") & (F.col("due_at") > _now(now)), due_at=_now(now))


def realign(queue: DataFrame, recollect: float) -> DataFrame:
    """Waiting jobs that have been collected are due ``recollect`` seconds after that."""
    return _change(queue, (F.col("status") == "queued") & F.col("last_collected").isNotNull(), due_at=F.col("last_collected") + _seconds(recollect))


def recover_stale(queue: DataFrame, lease: float, now: str | Column) -> DataFrame:
    """Jobs whose worker has not been heard of for more than ``lease`` seconds wait again."""
    return _change(queue, (F.col("status") == "collecting") & (F.col("locked_at") < _now(now) - _seconds(lease)), status=F.lit("queued"), locked_by=F.lit(None), locked_at=F.lit(None))


def recover_others(queue: DataFrame, worker: str, now: str | Column) -> DataFrame:
    """Jobs that other workers hold are due again."""
    return _change(queue, (F.col("status") == "collecting") & (F.col("locked_by") != worker), status=F.lit("queued"), locked_by=F.lit(None), locked_at=F.lit(None), due_at=_now(now))
