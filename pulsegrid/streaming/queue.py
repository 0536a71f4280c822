"""The collection queue as keyed state of a stream: commands in, the jobs that they change out, leases as timers.

A job is the state of its repository. Commands are applied in order of their times; a claim starts a lease and a
heartbeat of the same worker renews it. The lease is an event-time timer: when the watermark passes it without a
heartbeat the job waits again, and a command of a later time finds it waiting already. Which job a worker should ask for is ``operators.queue.claim`` on the jobs put out so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.queue import REST

#: value: the priority to enqueue, the seconds until the next collection, or whether to force a full one.
COMMANDS = "repo_id long, seq long, at timestamp, op string, worker string, value double, ok boolean, error string"
STATE = "priority int, status string, due long, worker string, locked long, collected long, force boolean, error string, timer long"
JOBS = "repo_id long, at long, op string, priority int, status string, due long, worker string, locked long, collected long, force boolean, error string"
NAMES = [c.split()[0] for c in STATE.split(", ")]


def advance(job: dict | None, op: str, at: int, worker: str | None, value: float | None, ok: bool | None, error: str | None) -> dict | None:
    """The job after a command at so many milliseconds, or the same one if the command does not apply."""
    if op == "enqueue":
        if job is None:
            return dict.fromkeys(NAMES) | {"priority": int(value), "status": "queued", "due": at, "force": False}
        urgent = job | {"priority": min(job["priority"], int(value))}
        return urgent if job["status"] == "collecting" else urgent | {"status": "queued", "due": at}
    if job is None:
        return None
    free = {"status": "queued", "worker": None, "locked": None}
    waiting, busy = job["status"] == "queued", job["status"] == "collecting"
    if op == "prioritise":
        return job | free | {"priority": 0, "due": at}
    if op == "claim" and waiting and job["due"] <= at:
        return job | {"status": "collecting", "worker": worker, "locked": at}
    if op == "heartbeat" and busy and job["worker"] == worker:
        return job | {"locked": at}
    if op == "complete":
        return job | free | {"priority": REST, "due": at + round(1000 * value), "collected": at, "error": None if ok else error, "force": job["force"] and not ok}
    if op == "force":
        return job | {"force": bool(value)}
    if op == "make_due" and waiting and job["due"] > at:
        return job | {"due": at}
    if op == "realign" and waiting and job["collected"] is not None:
        return job | {"due": job["collected"] + round(1000 * value)}
    if op == "recover_others" and busy and job["worker"] != worker:
        return job | free | {"due": at}
    return job


class Jobs(StatefulProcessor):
    def __init__(self, lease: float):
        self.lease = round(1000 * lease)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("job", STATE)

    def _put(self, repo: int, job: dict, op: str, at: int) -> dict:
        """Stores the job with a timer for its lease, if it has one, and gives its row."""
        if job["timer"] is not None:
            self.handle.deleteTimer(job["timer"])
        # A lease is over when more than its length has passed, as for locks of the table.
        job = job | {"timer": None if job["locked"] is None else job["locked"] + self.lease + 1}
        if job["timer"] is not None:
            self.handle.registerTimer(job["timer"])
        self.state.update(tuple(job[n] for n in NAMES))
        return {"repo_id": repo, "at": at, "op": op} | {n: job[n] for n in NAMES if n != "timer"}

    def _job(self) -> dict | None:
        return dict(zip(NAMES, self.state.get(), strict=True)) if self.state.exists() else None

    def _expired(self, job: dict | None, at: int) -> dict | None:
        """A command that comes after the lease, but before the watermark has passed it, finds the job free."""
        over = job is not None and job["locked"] is not None and job["locked"] + self.lease < at
        return job | {"status": "queued", "worker": None, "locked": None} if over else job

    def _frame(self, rows: list[dict]) -> pd.DataFrame:
        kinds = {"long": "Int64", "int": "Int32", "boolean": "boolean", "string": "object"}
        return pd.DataFrame({n: pd.array([r[n] for r in rows], dtype=kinds[t]) for n, t in (c.split() for c in JOBS.split(", "))})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        commands = pd.concat(rows).sort_values(["ms", "seq"], kind="stable")
        job, first = self._job(), self._job()
        last = None
        for c in commands.to_dict("records"):
            job = self._expired(job, int(c["ms"]))
            given = {n: None if pd.isna(c[n]) else c[n] for n in ("worker", "value", "ok", "error")}
            after = advance(job, c["op"], int(c["ms"]), **given)
            last = c if after != job else last
            job = after
        if job is not None and job != first:
            op, at = (last["op"], int(last["ms"])) if last else ("expired", first["timer"])
            yield self._frame([self._put(int(key[0]), job, op, at)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        job, at = self._job(), expiredTimerInfo.getExpiryTimeInMs()
        if job is not None and job["status"] == "collecting" and job["timer"] == at:
            yield self._frame([self._put(int(key[0]), job | {"status": "queued", "worker": None, "locked": None, "timer": None}, "expired", at)])

    def close(self) -> None:
        pass


def jobs(commands: DataFrame, lease: float = 3600, late: str = "0 seconds") -> DataFrame:
    """The changed jobs, times in milliseconds. Needs the RocksDB state store."""
    rows = commands.filter("repo_id is not null and at is not null").withWatermark("at", late).withColumn("ms", F.unix_millis("at"))
    return rows.groupBy("repo_id").transformWithStateInPandas(Jobs(lease), JOBS, "Update", "EventTime")
