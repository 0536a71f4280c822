"""The queue: steps on the table, the same steps as a stream, leases."""

from __future__ import annotations

import datetime
import json
import os
import random

from pyspark.sql import functions as F

from pulsegrid.operators import queue as Q
from pulsegrid.streaming import queue as S

START = datetime.datetime(2024, 1, 1)
SCHEMA = ", ".join(f"{c} {t}" for c, t in Q.COLUMNS.items())


def at(hours):
    return START + datetime.timedelta(hours=hours)


def frame(spark, *rows):
    """(repo_id, status, due, and more by name)"""
    base = dict.fromkeys(Q.COLUMNS) | {"priority": 50, "force_full": False}
    return spark.createDataFrame([tuple((base | r)[c] for c in Q.COLUMNS) for r in rows], SCHEMA)


def seen(df, *columns):
    return {r["repo_id"]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def test_realign(spark):
    q = frame(
        spark,
        {"repo_id": 1, "status": "collecting", "due_at": at(5), "last_collected": at(0)},
        {"repo_id": 2, "status": "queued", "due_at": at(5)},
        {"repo_id": 3, "status": "queued", "due_at": at(24), "last_collected": at(0)},
        {"repo_id": 4, "status": "queued", "due_at": at(5), "last_collected": at(0.5)},
    )
    assert seen(Q.realign(q, 86_400), "due_at") == {1: at(5), 2: at(5), 3: at(24), 4: at(24.5)}
    assert seen(Q.realign(Q.realign(q, 86_400), 86_400), "due_at") == seen(Q.realign(q, 86_400), "due_at")


def test_claims_are_by_priority_then_due_time_and_skip_what_is_held(spark):
    q = frame(
        spark,
        {"repo_id": 1, "status": "queued", "due_at": at(0), "priority": 100},
        {"repo_id": 2, "status": "queued", "due_at": at(-1), "priority": 100},
        {"repo_id": 3, "status": "queued", "due_at": at(1), "priority": 0},
        {"repo_id": 4, "status": "collecting", "due_at": at(-2), "priority": 0, "locked_by": "z", "locked_at": at(-1)},
        {"repo_id": 5, "status": "queued", "due_at": at(0), "priority": 7},
    )
    got = Q.claim(q, ["a", "b"], str(at(0)))
    assert seen(got, "status", "locked_by") == {1: ("queued", None), 2: ("collecting", "b"), 3: ("queued", None), 4: ("collecting", "z"), 5: ("collecting", "a")}
    assert seen(Q.claim(got, ["c"], str(at(0))), "locked_by")[1] == "c"


def test_other_steps(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "repo_id long")
    q = frame(spark, {"repo_id": 1, "status": "collecting", "due_at": at(0), "locked_by": "a", "locked_at": at(0), "force_full": True}, {"repo_id": 2, "status": "queued", "due_at": at(9), "priority": 9})
    new = spark.createDataFrame([(1, 5), (2, 50), (3, 7), (3, 8)], "repo_id long, priority int")
    assert seen(Q.enqueue(q, new, str(at(1))), "priority", "status", "due_at", "locked_by") == {1: (5, "collecting", at(0), "a"), 2: (9, "queued", at(1), None), 3: (7, "queued", at(1), None)}
    assert seen(Q.prioritise(q, ids(1), str(at(1))), "priority", "status", "locked_by") == {1: (0, "queued", None), 2: (9, "queued", None)}
    beats = spark.createDataFrame([(1, "b"), (1, "a"), (2, "a")], "repo_id long, worker string")
    assert seen(Q.heartbeat(q, beats, str(at(2))), "locked_at") == {1: at(2), 2: None}
    done = lambda ok: spark.createDataFrame([(1, ok, "boom")], "repo_id long, ok boolean, error string")
    assert seen(Q.complete(q, done(True), 3600, str(at(2))), "status", "priority", "due_at", "last_collected", "last_error", "force_full")[1] == ("queued", 100, at(3), at(2), None, False)
    assert seen(Q.complete(q, done(False), 3600, str(at(2))), "last_error", "force_full", "locked_by")[1] == ("boom", True, None)
    assert seen(Q.force_full(q, ids(2)), "force_full") == {1: True, 2: True}
    assert seen(Q.make_due(q, str(at(1))), "due_at") == {1: at(0), 2: at(1)}
    assert seen(Q.recover_stale(q, 3600, str(at(1))), "status")[1] == "collecting" and seen(Q.recover_stale(q, 3600, str(at(1.01))), "status")[1] == "queued"
    assert seen(Q.recover_others(q, "a", str(at(1))), "status")[1] == "collecting" and seen(Q.recover_others(q, "b", str(at(1))), "status", "due_at")[1] == ("queued", at(1))


def run_stream(spark, tmp_path, batches, lease=3600):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder = tmp_path / "commands"
    folder.mkdir()
    seq = 0
    for k, rows in enumerate(batches):
        lines = []
        for r in rows:
            seq += 1
            lines.append(json.dumps({"seq": seq} | r | {"at": r["at"].isoformat() + "Z"}))
        (folder / f"{k:03d}.json").write_text("\n".join(lines))
        os.utime(folder / f"{k:03d}.json", (1_700_000_000 + 60 * k,) * 2)
    stream = spark.readStream.schema(S.COMMANDS).option("maxFilesPerTrigger", 1).json(str(folder))
    out = f"{tmp_path}/out"
    query = S.jobs(stream, lease).writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("overwrite").json(f"{out}/{n:06d}")).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True)
    try:
        query.start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.read.schema(S.JOBS).json(f"{out}/*").withColumn("batch", F.element_at(F.split(F.input_file_name(), "/"), -2).cast("int")).orderBy("batch").collect()


def ms(hours):
    return int(at(hours).replace(tzinfo=datetime.UTC).timestamp() * 1000)


def test_leases_expire_unless_a_heartbeat_renews_them(spark, tmp_path):
    c = lambda h, repo, op, **more: {"repo_id": repo, "at": at(h), "op": op} | more
    got = run_stream(
        spark,
        tmp_path,
        [
            [c(0, 1, "enqueue", value=10), c(0, 2, "enqueue", value=20), c(0, 3, "heartbeat", worker="a")],
            [c(0.1, 1, "claim", worker="a"), c(0.1, 2, "claim", worker="b"), c(0.1, 2, "claim", worker="late")],
            [c(1, 2, "heartbeat", worker="b"), c(1, 1, "heartbeat", worker="stranger")],
            [c(1.2, 9, "enqueue", value=1), c(1.2, 4, "enqueue", value=1), c(1.21, 4, "claim", worker="a")],
            [c(1.25, 9, "prioritise")],
            [c(1.3, 1, "claim", worker="c")],
            [c(1.4, 1, "complete", value=7200, ok=True), c(1.4, 2, "complete", value=60, ok=False, error="boom")],
            [c(1.5, 1, "realign", value=3600), c(1.5, 2, "prioritise")],
            [c(2.3, 4, "heartbeat", worker="a"), c(2.4, 4, "claim", worker="b")],
        ],
    )
    steps = lambda repo: [(r.op, r.status, r.worker) for r in got if r.repo_id == repo]
    assert steps(1) == [("enqueue", "queued", None), ("claim", "collecting", "a"), ("expired", "queued", None), ("claim", "collecting", "c"), ("complete", "queued", None), ("realign", "queued", None)]
    assert steps(2) == [("enqueue", "queued", None), ("claim", "collecting", "b"), ("heartbeat", "collecting", "b"), ("complete", "queued", None), ("prioritise", "queued", None)]
    assert steps(3) == [] and steps(4) == [("claim", "collecting", "a"), ("claim", "collecting", "b")]
    last = {r.repo_id: r for r in got}
    assert (last[1].due, last[1].collected, last[1].priority) == (ms(2.4), ms(1.4), 100) and (last[2].priority, last[2].error) == (0, "boom")
    assert next(r.at for r in got if r.op == "expired") == ms(1.1) + 1


def test_stream_and_table_take_the_same_steps(spark):
    """Random commands one by one through ``advance`` and through the table's functions."""
    r, job, q = random.Random(4), None, frame(spark)
    for k in range(14):
        op = "enqueue" if not k else r.choice(["enqueue", "claim", "claim", "heartbeat", "complete", "realign", "make_due", "recover_others", "force", "prioritise"])
        now, worker, ok = str(at(k)), r.choice("ab"), r.random() < 0.5
        value = {"enqueue": 5 + k, "complete": 3600 * r.randint(0, 4), "realign": 3600 * r.randint(0, 4), "force": 1}.get(op)
        job = S.advance(job, op, ms(k), worker, value, ok, "e")
        ids = spark.createDataFrame([(1, value or 0, worker, ok, "e")], "repo_id long, priority int, worker string, ok boolean, error string")
        q = {
            "enqueue": lambda: Q.enqueue(q, ids, now), "claim": lambda: Q.claim(q, [worker], now), "heartbeat": lambda: Q.heartbeat(q, ids, now), "complete": lambda: Q.complete(q, ids, value, now), "realign": lambda: Q.realign(q, value),
            "make_due": lambda: Q.make_due(q, now), "recover_others": lambda: Q.recover_others(q, worker, now), "force": lambda: Q.force_full(q, ids), "prioritise": lambda: Q.prioritise(q, ids, now),
        }[op]()
        q = spark.createDataFrame(q.collect(), SCHEMA)
        row = q.first()
        stamp = lambda v: None if v is None else int(v.replace(tzinfo=datetime.UTC).timestamp() * 1000)
        assert (row.priority, row.status, stamp(row.due_at), row.locked_by, stamp(row.locked_at), stamp(row.last_collected), row.force_full, row.last_error) == tuple(job[n] for n in S.NAMES if n != "timer"), op
