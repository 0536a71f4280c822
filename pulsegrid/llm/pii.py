"""Personal data by anchor expansion.

An Aho-Corasick automaton runs over each whole text and reports anchors: at-signs, plus signs, digits, URL
schemes and identifier cues. From every anchor a deterministic parser expands to the left and right,
validates (octets, Luhn, digit counts) and fixes the boundaries. The parsers keep to anchored regular
expressions of linear time, so neither long texts nor long runs of one character slow them down.

Base kinds: email, ip, card, phone. Kinds the method adds: ``url_login`` (user part of a URL) and
``account`` (an identifier of six or more digits or an IBAN within a few characters of a cue).

Null texts are empty; positions are code points, the end exclusive. Rows repeat as they are; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "account", "url_login")
BASE = KINDS[:4]
#: Words after which an account number may stand.
CUES = ("account", "acct", "iban", "ssn", "passport", "tax id", "konto", "compte", "cuenta")
SCHEMES = ("http://", "https://", "ftp://")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ACCOUNT = re.compile(r"\W{0,3}(?:no\.?|number|nr\.?|#)?\W{0,3}((?:[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[0-9](?:[ -]?[0-9]){5,17}))(?![A-Za-z0-9])", re.I)
_LOGIN = re.compile(r"[A-Za-z0-9._%+:-]++(?=@)")
#: A-Z lowered, for cues and schemes in any spelling; no place moves.
_LOWER = {c: c + 32 for c in range(65, 91)}
_automaton: list[ahocorasick.Automaton] = []


def automaton() -> ahocorasick.Automaton:
    if not _automaton:
        a = ahocorasick.Automaton()
        for c in "0123456789":
            a.add_word(c, ("digit", 1))
        a.add_word("@", ("at", 1))
        a.add_word("+", ("plus", 1))
        for s in SCHEMES:
            a.add_word(s, ("scheme", len(s)))
        for c in CUES:
            a.add_word(c, ("cue", len(c)))
        a.make_automaton()
        _automaton.append(a)
    return _automaton[0]


def luhn(digits: str) -> bool:
    twice = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(twice[x] for x in d[1::2])) % 10 == 0


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end), sorted."""
    out: list[tuple[int, int, int]] = []
    mail = dotted = card = phone = 0  # where the next match of a kind may begin
    n = len(text)
    for last, (anchor, width) in automaton().iter(text.lower() if text.isascii() else text.translate(_LOWER)):
        if anchor == "digit":
            if last >= dotted:
                m = _DOTTED.match(text, last)
                dotted = m.end()
                if text.count(".", last, dotted) >= 3:
                    at, parts = last, m[0].split(".")
                    for k in range(0, len(parts) - 3, 4):
                        four = parts[k : k + 4]
                        end = at + sum(map(len, four)) + 3
                        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                            out.append((at, 1, end))
                        at = end + 1
            if last >= card and (m := _CARD.match(text, last)):
                card = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((last, 2, card))
        elif anchor == "at":
            at = last
            while at > mail and text[at - 1] in _LOCAL:
                at -= 1
            if at < last and (m := _HOST.match(text, last)):
                mail = m.end()
                out.append((at, 0, mail))
        elif anchor == "plus":
            if last >= phone and (m := _PHONE.match(text, last)):
                phone = m.end()
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((last, 3, phone))
        elif anchor == "cue":
            begin = last - width + 1
            if (begin == 0 or not text[begin - 1].isalnum()) and (last + 1 == n or not text[last + 1].isalnum()):
                if m := _ACCOUNT.match(text, last + 1):
                    out.append((m.start(1), 4, m.end(1)))
        elif m := _LOGIN.match(text, last + 1):
            out.append((m.start(), 5, m.end()))
    return sorted(set(out))


def redact(text: str) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans merge."""
    parts, at = [], 0
    for start, kind, end in spans(text):
        if start >= at:
            parts += [text[at:start], f"<{KINDS[kind]}>"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def _joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in BASE]
            digest, every = [], []
            for text in batch.column("text").to_pylist():
                found = spans(text or "")
                for k, c in enumerate(counts):
                    c.append(sum(x[1] == k for x in found))
                digest.append(hashlib.sha256(_joined([x for x in found if x[1] < len(BASE)]).encode()).hexdigest())
                every.append(_joined(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array(every, pa.string())],
                ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact_pii(docs: DataFrame) -> DataFrame:
    """documents with the personal data in ``text`` replaced; null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [t if t is None else redact(t) for t in batch.column("text").to_pylist()]
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(out, pa.string()))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
