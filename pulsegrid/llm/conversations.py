"""Repair of the turn structure of conversations, by secondary-sorted streaming.

Rows are dealt by conversation and sorted by turn; a task then reads each conversation once, as a stream of Arrow
batches, and carries the state of a dynamic program from row to row and from batch to batch: for each of four
automaton states the least cost, the rank of its cheapest edits among those of the other states, and a running hash of
the repaired turns. What leads back is four bytes a row; a conversation of more than ``SPILL`` rows puts them into the
shared folder block by block, so memory does not grow with a conversation. Repeated rows are found by a window before
the stream, which uses the same partitioning, so texts are shuffled once.

Edits: Keep 0, Rerole to user or assistant 3, Delete 4, Insert an empty user or assistant turn 3; a truncated turn that
stays costs 3 more; blank and repeated turns must go. What is left has role initials ``(s?(ua)+)?``. Of the cheapest
edits those whose initials come first in ASCII order are taken. Two different edits of the same rows that end in the
same state are never prefixes of each other once trailing inserts are left out, so ranks decide ties exactly.

Nulls: a null role or text is one space, a null conv_id is a conversation of its own, a null turn comes first. Rows of
equal turn are taken in order of role and text. Equal rows repeat each other. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, open_fs

#: Rows whose way back is held in memory; more of one conversation go to the shared folder.
SPILL = 262_144
COSTS = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATED = 3
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: The state that a kept initial leads to, and that the next user or assistant turn leads to.
KEPT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
NEXT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
LAST = re.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D]*\Z)")
PLAN = "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURN = "conv_id string, position long, edit string, role string, text string"
LONGEST = 2**63 - 1


def _inserted(state: int) -> Iterator[tuple[int, int]]:
    """(inserts, state) for no, one and two inserted turns; more would undo each other."""
    for k in range(3):
        yield k, state
        state = NEXT[state]


def _best(found: dict[int, tuple[int, int, str, int]], to: int, way: tuple[int, int, str, int]) -> None:
    if to not in found or way[:3] < found[to][:3]:
        found[to] = way


def _step(state: tuple, initial: str, gone: bool, cut: bool) -> tuple[tuple, int, tuple]:
    """State after a row, cost that all share, and for each state (state before, edits) or None."""
    found: dict[int, tuple[int, int, str, int]] = {}
    for before, known in enumerate(state):
        if known is None:
            continue
        cost, rank = known
        for k, at in _inserted(before):
            paid, prefix = cost + k * COSTS["I"], "I" * k
            _best(found, at, (paid + COSTS["D"], rank, prefix + "D", before))
            if not gone:
                paid += TRUNCATED * cut
                if (initial, at) in KEPT:
                    _best(found, KEPT[initial, at], (paid + COSTS["K"], rank, prefix + "K", before))
                _best(found, NEXT[at], (paid + COSTS["R"], rank, prefix + "R", before))
    least = min(w[0] for w in found.values())
    order = {to: i for i, to in enumerate(sorted(found, key=lambda t: found[t][1:3]))}
    after = tuple((found[q][0] - least, order[q]) if q in found else None for q in range(4))
    return after, least, tuple((found[q][3], found[q][2]) if q in found else None for q in range(4))


_STEPS: dict[tuple, tuple] = {}
_CODES = [(b, "I" * k + e) for b in range(4) for k in range(3) for e in "KRD"]
_CODE = {c: i for i, c in enumerate(_CODES)}


class _Way:
    """What leads back: four bytes a row, full blocks in the shared folder."""

    def __init__(self, folder: str, block: int):
        self.folder, self.block, self.rows, self.files = folder, block, bytearray(), []

    def add(self, codes: bytes) -> None:
        self.rows += codes
        if len(self.rows) >= 4 * self.block:
            path = f"{self.folder}/{uuid.uuid4().hex}"
            fs, p = open_fs(path)
            fs.create_dir(p.rsplit("/", 1)[0], recursive=True)
            with fs.open_output_stream(p) as out:
                out.write(bytes(self.rows))
            self.files.append(path)
            self.rows = bytearray()

    def back(self) -> Iterator[bytes]:
        yield bytes(self.rows)
        for path in reversed(self.files):
            fs, p = open_fs(path)
            with fs.open_input_stream(p) as f:
                yield f.read()

    def close(self) -> None:
        for path in self.files:
            fs, p = open_fs(path)
            fs.delete_file(p)
        self.files = []


class _Conversation:
    def __init__(self, key: str | None, folder: str, block: int):
        self.key, self.way = key, _Way(folder, block)
        self.state, self.base = ((0, 0), None, None, None), 0
        self.hashes = [hashlib.sha256(), None, None, None]
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.before = None

    def _insert(self, h, state: int, k: int):
        for _ in range(k):
            h.update((b"" if state == START else b"\n") + NAMES[NEXT[state]].encode() + b":")
            state = NEXT[state]
        return state

    def add(self, turn: str | None, role: str, text: str, nth: int) -> None:
        if turn is not None and turn != self.high:
            self.turns += 1
            self.high = turn
            self.low = turn if self.low is None else self.low
        last = LAST.search(text[-64:]) or LAST.search(text)
        blank, again = last is None, nth > 1
        cut = not blank and last.group() not in ".!?"
        self.blank += blank
        self.duplicate += again and not blank
        self.truncated += cut and not again
        initial = role[:1]
        if self.before is not None:
            self.illegal += self.before + initial not in ("su", "ua", "au")
        self.before = initial
        gone = blank or again
        key = (self.state, initial if initial in "sua" else "", gone, cut and not gone)
        if key not in _STEPS:
            after, paid, ways = _step(*key)
            _STEPS[key] = after, paid, ways, bytes(255 if w is None else _CODE[w] for w in ways)
        self.state, paid, ways, codes = _STEPS[key]
        self.base += paid
        body, hashes = b":" + text.encode(), []
        for to, way in enumerate(ways):
            if way is None:
                hashes.append(None)
                continue
            before, edits = way
            h = self.hashes[before]
            if edits != "D":
                h = h.copy()
                at = self._insert(h, before, len(edits) - 1)
                if edits[-1] != "D":
                    name = role if edits[-1] == "K" else NAMES[to]
                    h.update((b"" if at == START else b"\n") + name.encode() + body)
            hashes.append(h)
        self.hashes = hashes
        self.way.add(codes)

    def end(self) -> tuple:
        cost, _, k, at = min((s[0] + COSTS["I"] * k, s[1], k, q) for q, s in enumerate(self.state) if s for k, e in _inserted(q) if e in (START, ASSISTANT))
        h = self.hashes[at].copy()
        self._insert(h, at, k)
        parts = ["I" * k]
        for rows in self.way.back():
            block = []
            for i in range(len(rows) - 4, -1, -4):
                at, edits = _CODES[rows[i + at]]
                block.append(edits)
            parts.append("".join(reversed(block)))
        self.way.close()
        gaps = int(self.high) - int(self.low) + 1 - self.turns if self.turns else 0
        counts = self.blank, self.duplicate, self.truncated, self.illegal, self.base + cost
        return (self.key, min(gaps, LONGEST), *counts, "".join(reversed(parts)), h.hexdigest())


def _planner(folder: str, block: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PLAN.split(", ")]
        now: _Conversation | None = None
        try:
            for pdf in batches:
                done = []
                columns = (pdf[c].tolist() for c in ("conv_id", "absent", "turn", "role", "text", "nth"))
                for key, absent, turn, role, text, nth in zip(*columns, strict=True):
                    if now is None or key != now.key:
                        done += [now.end()] if now else []
                        now = _Conversation(key, folder, block)
                    if not absent:
                        now.add(turn, role, text, nth)
                if done:
                    yield pd.DataFrame(done, columns=names)
            if now:
                yield pd.DataFrame([now.end()], columns=names)
        finally:
            if now:
                now.way.close()

    return run


def _turns(conversations: DataFrame, absent: Column | None) -> DataFrame:
    """Dealt by conversation: conv_id, absent, turn, role, text, and which of its equals a row is."""
    gone = F.coalesce(absent, F.lit(False)) if absent is not None else F.lit(False)
    here = lambda c: F.when(~gone, F.coalesce(F.col(c).cast("string"), F.lit(" ")))
    rows = conversations.select("conv_id", gone.alias("absent"), F.when(~gone, F.col("turn")).alias("turn"), here("role").alias("role"), here("text").alias("text"))
    same = Window.partitionBy("conv_id", "absent", "role", "text").orderBy(F.asc_nulls_first("turn"))
    return rows.repartition("conv_id").withColumn("nth", F.row_number().over(same))


def repair(conversations: DataFrame, absent: Column | None = None) -> DataFrame:
    """The cheapest edits of each conversation: one row per conv_id.

    conversations: conv_id, turn (whole numbers), role, text. absent: rows for which it is true are no turns and only
    name their conversation. gaps above 2^63 - 1 are given as that.
    """
    folder = new_path(conversations.sparkSession, "conversation-ways")
    rows = _turns(conversations, absent).select(F.col("conv_id").cast("string"), "absent", "turn", "role", "text", "nth")
    rows = rows.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "nth").withColumn("turn", F.col("turn").cast("string"))
    kind = conversations.schema["conv_id"].dataType
    return rows.mapInPandas(_planner(folder, SPILL), PLAN).withColumn("conv_id", F.col("conv_id").cast(kind))


def _apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Follows each conversation's edits; the row that holds them comes first."""
    key, audit, at, state, place = None, "", 0, START, 0

    def insert(out: list) -> None:
        nonlocal at, state, place
        while at < len(audit) and audit[at] == "I":
            state = NEXT[state]
            out.append((key, place, "I", NAMES[state], ""))
            at, place = at + 1, place + 1

    for pdf in batches:
        out: list[tuple] = []
        for k, plan, role, text in zip(pdf["conv_id"], pdf["plan"], pdf["role"], pdf["text"], strict=True):
            if plan:
                key, audit, at, state, place = k, text, 0, START, 0
            else:
                edit, at = audit[at], at + 1
                if edit != "D":
                    state = NEXT[state] if edit == "R" else KEPT[role[:1], state]
                    out.append((key, place, edit, NAMES[state] if edit == "R" else role, text))
                    place += 1
            insert(out)
        yield pd.DataFrame(out, columns=["conv_id", "position", "edit", "role", "text"])


def repaired_turns(conversations: DataFrame, plans: DataFrame, absent: Column | None = None) -> DataFrame:
    """The turns after repair: conv_id, position from 0, edit (K, R or I), role, text. plans: what ``repair`` gave for the same rows."""
    turns = _turns(conversations, absent).filter(~F.col("absent")).withColumn("plan", F.lit(False))
    plan = plans.select("conv_id", F.lit(False).alias("absent"), F.lit(None).cast(turns.schema["turn"].dataType).alias("turn"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"), F.lit(0).alias("nth"), F.lit(True).alias("plan"))
    rows = turns.unionByName(plan).repartition("conv_id")
    rows = rows.sortWithinPartitions("conv_id", F.desc("plan"), F.asc_nulls_first("turn"), "role", "text", "nth")
    kind = conversations.schema["conv_id"].dataType
    return rows.select(F.col("conv_id").cast("string"), "plan", "role", "text").mapInPandas(_apply, TURN).withColumn("conv_id", F.col("conv_id").cast(kind))


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped: rows hurt by the hash of conv_id and turn; nulls are one space.

    Of 20 classes, 0 drops the row, 1 empties the text, 2 takes its ends of sentences, 3 repeats it, 4 makes it the user's.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))), F.lit(20))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(blank("text"), r"[.!?]", "")).otherwise(blank("text"))
    rows = conversations.select("conv_id", "turn", "role", "text", kind.alias("kind"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("dropped"), times.alias("copy"))
    return rows.drop("copy")
