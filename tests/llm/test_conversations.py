"""Repair of conversations against a search over all edits."""

from __future__ import annotations

import hashlib
import heapq
import random
import re

import pytest
from conftest import DATA, assert_same, duck
from pyspark.sql import functions as F

from pulsegrid.llm import conversations, queries

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")
PREFIX = re.compile(r"s?(ua)*u?")


def brute(rows):
    """The cheapest edits of one conversation by uniform-cost search over whole strings, and its counts."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in rows:
        last = text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], None
    while heap:
        cost, audit, i, initials, out = heapq.heappop(heap)
        if i == len(rows) and LEGAL.fullmatch(initials):
            done = cost, audit, out
            break
        ways = []
        if len(audit) < 2 * len(rows) + 4:
            ways += [(3, "I", i, x[0], (f"{x}:",)) for x in ("user", "assistant")]
        if i < len(rows):
            _, role, text = rows[i]
            ways.append((4, "D", i + 1, "", ()))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                ways += [(more, "K", i + 1, role[:1] or "?", (f"{role}:{text}",))]
                ways += [(3 + more, "R", i + 1, x[0], (f"{x}:{text}",)) for x in ("user", "assistant")]
        for price, edit, j, initial, added in ways:
            if PREFIX.fullmatch(initials + initial):
                heapq.heappush(heap, (cost + price, audit + edit, j, initials + initial, out + added))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    count = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *count, sum(p not in ("su", "ua", "au") for p in pairs), done[0], done[1], hashlib.sha256("\n".join(done[2]).encode()).hexdigest()), done[2]


def made(seed, n):
    r = random.Random(seed)
    rows = []
    for conv in [None, *range(n)]:
        for _ in range(r.randint(1, 6)):
            role = r.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None])
            rows.append((conv, r.choice([None, 0, 1, 2, 3, 5, 9]), role, r.choice(["Yes.", "No!", "Why?\n", "cut off", " \t", "", None, "é.", "1" * 90])))
    return rows


def plans(df, absent=None):
    return {r[0]: tuple(r)[1:] for r in conversations.repair(df, absent).collect()}


def test_brute_force(spark):
    rows = made(1, 150)
    got = plans(spark.createDataFrame(rows, SCHEMA))
    for conv in {r[0] for r in rows}:
        assert got[conv] == brute([r[1:] for r in rows if r[0] == conv])[0], [r for r in rows if r[0] == conv]


def test_turns_after_repair(spark):
    rows = made(2, 60)
    df = spark.createDataFrame(rows, SCHEMA)
    found: dict = {}
    for r in conversations.repaired_turns(df, conversations.repair(df)).orderBy("conv_id", "position").collect():
        found.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for conv in {r[0] for r in rows}:
        assert tuple(found.get(conv, ())) == brute([r[1:] for r in rows if r[0] == conv])[1]


def test_giant_conversation_spills(spark, monkeypatch):
    """One conversation over many Arrow batches and blocks equals the same one held in memory."""
    roles = ["user", "assistant", "assistant", "user", "system"]
    df = spark.range(25_000).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.element_at(F.array(*map(F.lit, roles)), (F.pmod(F.xxhash64("id"), F.lit(5)) + 1).cast("int")).alias("role"), F.concat(F.lit("text "), (F.col("id") % 24_000).cast("string"), F.lit(".")).alias("text"))
    whole = plans(df)
    monkeypatch.setattr(conversations, "SPILL", 1_000)
    assert plans(df) == whole and len(whole) == 1
    audit = whole[7][6]
    assert len(audit.replace("I", "")) == 25_000
    turns = conversations.repaired_turns(df, conversations.repair(df)).orderBy("position").collect()
    assert LEGAL.fullmatch("".join(r.role[0] for r in turns))
    assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in turns).encode()).hexdigest() == whole[7][7]


def test_empty_table_extra_columns_and_absent_rows(spark):
    assert conversations.repair(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(1, 0, "user", "Hi.", 5, "x"), (2, 0, "user", "Hi.", 6, "y")], SCHEMA + ", nth int, absent string")
    got = plans(df, F.col("conv_id") == 2)
    assert got[2] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[1] == (0, 0, 0, 0, 0, 3, "KI", hashlib.sha256(b"user:Hi.\nassistant:").hexdigest())


def test_one_shuffle_of_the_texts(spark):
    plan = conversations.repair(spark.createDataFrame(made(3, 3), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_sql(spark, sf):
    con = duck(sf)
    assert_same(queries.op12_conversations(spark, f"{DATA}/{sf}"), con, queries.ORACLE_SQL["op12_conversations"])


def test_damaged_nulls_and_ties_against_sql(spark, tmp_path):
    spark.createDataFrame(made(4, 200), SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duck("sf0.001")
    con.execute(f"create or replace view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert_same(queries.op12_conversations(spark, str(tmp_path)), con, queries.ORACLE_SQL["op12_conversations"])
