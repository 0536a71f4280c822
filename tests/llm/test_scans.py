"""PII, licences and decontamination against the contract's own patterns and DuckDB."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import pytest
from conftest import DATA, assert_same, duck

from pulsegrid.llm import decontam, licences, pii, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c.isascii() and c.isdigit()]
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits)))
                if not 12 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


@pytest.mark.parametrize("alphabet", ["0123456789.", "a@.-1 ", "+1 2(3).4-5", "0123 -", "aB_%+@.é\n9- ", "0.1.25 +@x-"])
def test_base_spans_of_random_texts(alphabet):
    rng = random.Random(alphabet)
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
        assert [s for s in pii.spans(text) if s[1] < 4] == brute_spans(text), text


def test_pii_rows(spark):
    card, rows = "4111 1111-1111 1111", [(1, None), (2, ""), (3, "ä mail me@x.org, 10.0.0.1 or +49 (30) 123456-78"), (4, "4111 1111-1111 1111"), (4, "4111 1111-1111 1111"), (5, "x" * 200_000 + " a@b.c"), (6, "1" * 100_000), (7, "konto 12345678 https://user:pw@host.org/")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as spans", "1 as n_email")
    got = pii.find_pii(frame).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for doc, text in rows:
        base = brute_spans(text or "")
        assert by[doc]["base_sha256"] == hashlib.sha256(",".join(f"{list(PATTERNS)[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest()
        assert [by[doc][f"n_{k}"] for k in PATTERNS] == [sum(x[1] == i for x in base) for i in range(4)]
    assert by[4]["spans"] == f"card:0:{len(card)}"
    assert "account:6:14" in by[7]["spans"] and "url_login" in by[7]["spans"]
    assert pii.find_pii(frame.limit(0)).count() == 0


def test_redaction():
    text = "write to me@x.org (4111111111111111)"
    assert pii.redact(text) == "write to <email> (<card>)"
    assert pii.redact("clean text, 3.14") == "clean text, 3.14"


@pytest.mark.parametrize("n", [1, 128, 129, 5000, 300_000])
def test_login_of_any_length(n):
    user = "".join(random.Random(n).choice("aZ7._%+:-") for _ in range(n - 1)) + "t"
    text = f"clone https://{user}@host/x.git now"
    assert (14, pii.KINDS.index("url_login"), 14 + n) in pii.spans(text)
    assert pii.redact(text) == "clone https://<url_login>@host/x.git now"
    assert all(k != pii.KINDS.index("url_login") for _, k, _ in pii.spans(f"https://{user} @host https://@host"))


def test_pii_on_the_table(spark):
    texts = {r["doc_id"]: r["text"] for r in queries.read(spark, f"{DATA}/sf0.01", "documents").collect()}
    for r in queries.op6_pii(spark, f"{DATA}/sf0.01").collect():
        base = brute_spans(texts[r["doc_id"]] or "")
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(x[1] == i for x in base) for i in range(4)]


PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def brute_licences(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    where = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), sorted(where)


def test_licences(spark):
    rng = random.Random(9)
    words = "under the mit license Apache License, Version 2 cc-by-nc. cc by nc É x".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(40)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "CC by NC cc BY nc"), (903, "released undr the MIT licence today"), (904, "The weather was fine."), (904, "The weather was fine."), (905, "word " * 50_000 + "under the MIT license")]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_words")).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for doc, text in rows:
        n, where = brute_licences(text)
        r = by[doc]
        assert (r["n_words"], r["n_base"]) == (n, len(where))
        assert (r["first_word"], r["last_word"]) == ((min(where)[0], max(where)[0]) if where else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in where})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
    assert by[903]["labels"] == "mit" and by[903]["n_base"] == 0 and by[904]["labels"] == "" and by[904]["score"] == 0
    assert by[902]["n_base"] == 2


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def brute_notices(words):
    out = set()
    for phrase, (label, errors) in licences.NOTICES.items():
        for i in range(len(words)):
            for j in range(i + 1, len(words) + 1):
                span = b" ".join(words[i:j])
                if abs(len(span) - len(phrase)) <= errors and (e := edit_distance(phrase.encode(), span)) <= errors:
                    out.add((i, j, label, e))
    return out


def test_notices_equal_brute_force():
    rng = random.Random(19)
    notices = list(licences.NOTICES)
    for _ in range(1500):
        text = bytearray(" ".join(rng.choice((*notices, "a", "of", "gnu general", "license", "eserved")) for _ in range(rng.randrange(1, 5))).encode())
        for _ in range(rng.randrange(7)):
            at = rng.randrange(len(text) + 1)
            text[at : at + rng.randrange(2)] = rng.choice((b"", b"s", b" ", b"e", b"ll", b" a "))
        words = bytes(text).split()
        padded = b" " + b" ".join(words) + b" "
        got = [(padded.count(b" ", 0, a) - 1, padded.count(b" ", 0, b), x, e) for a, b, x, e in licences.fuzzy_places(padded)]
        assert len(got) == len(set(got)) and set(got) == brute_notices(words), padded


def test_notices_with_suffixes(spark):
    texts = {"under the gnu general public licenses here": ("gpl", "2:6:gpl:1"), "under the mit licensed": ("mit", "0:4:mit:1"), "All Rights Reservedd.": ("proprietary", "0:3:proprietary:1"), "xunder the mit license": ("mit", "0:4:mit:1")}
    rows = list(enumerate(texts))
    for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        label, span = texts[rows[r["doc_id"]][1]]
        assert label in r["labels"].split(",") and span in r["spans"].split(",") and r["n_base"] == 0


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_contamination(docs, items):
    windows = {}
    for item, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words_of(text), set(), set()
        for win, owners in windows.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    found |= owners
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefgh")
    items = [(i, " ".join(word() for _ in range(rng.choice((2, 13, 14, 30))))) for i in range(12)] + [(20, ""), (21, None), (3, "one more text of item three"), (22, "A a a A")]
    docs = []
    for d in range(60):
        w = [word() for _ in range(rng.randrange(1, 60))]
        if d % 2:
            at = rng.randrange(len(w) + 1)
            w[at:at] = items[d % 12][1].upper().split()
        docs.append((d, rng.choice((" ", "-", "; ")).join(w)))
    docs += [(100, None), (101, ""), (102, "a A-a? a a"), (102, "a A-a? a a"), (103, "x " * 100_000 + "One more text of item THREE")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n_hit", "'y' as item_id")
    got = decontam.decontaminate(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == brute_contamination(docs, items)


def test_decontamination_without_items_or_documents(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert [tuple(r)[:4] for r in decontam.decontaminate(docs, items.limit(0)).collect()] == [(1, 2, 0, 0)]
    assert decontam.decontaminate(docs.limit(0), items).count() == 0


def test_find_by_position_and_proximity(spark):
    docs = spark.createDataFrame([(1, "z red green blue z"), (2, "blue z red green")], "doc_id long, text string")
    items = decontam.Benchmark(spark.createDataFrame([("i", "red green blue")], "item_id string, text string"), None)
    index = decontam.build_index(docs, items)
    assert [tuple(r) for r in decontam.find(index, items).collect()] == [(1, "i", 1, 3)]
    assert {r["doc_id"] for r in decontam.find(index, items, slop=2).collect()} == {1}


def brute_near(docs, items, slop):
    """(doc, item, position of the rarest term) with every term of the item less than its length plus slop away."""
    texts = {d: words_of(t) for d, t in docs}
    count = {}
    for w in itertools.chain.from_iterable(texts.values()):
        count[w] = count.get(w, 0) + 1
    out = set()
    for item, text in items:
        win = words_of(text)
        rarest, reach = min(win, key=lambda w: count.get(w, 0)), len(win) + slop
        for d, w in texts.items():
            out |= {(d, item, i, len(win)) for i, x in enumerate(w) if x == rarest and set(win) <= set(w[max(0, i - reach + 1) : i + reach])}
    return out


@pytest.mark.parametrize("slop", [0, 1, 2, 5])
def test_proximity_equals_brute_force(spark, slop):
    rng = random.Random(11)
    items = [(str(i), " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(4)}" for _ in range(rng.choice((3, 5, 13))))) for i in range(8)]
    docs = [(0, None), (1, ""), (2, "z")]
    for d in range(3, 80):
        w = words_of(items[d % 8][1])
        if d % 3 == 0:
            rng.shuffle(w)
        for _ in range(rng.randrange(4)):
            w.insert(rng.randrange(len(w) + 1), "foreign")
        docs.append((d, " ".join(["x"] * rng.randrange(5) + w + ["y", rng.choice("abcd") + "1"])))
    bench = decontam.Benchmark(spark.createDataFrame(items, "item_id string, text string"), None)
    index = decontam.build_index(spark.createDataFrame(docs, "doc_id long, text string"), bench, every=True)
    got = [tuple(r) for r in decontam.find(index, bench, slop=slop).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_near(docs, items, slop)


def test_proximity_of_split_windows(spark):
    words = [f"w{i}" for i in range(30)]
    docs = [(1, " ".join(words[:6] + ["foreign"] + words[6:13])), (2, " ".join(reversed(words[:13]))), (3, " ".join(words[:12])), (4, " ".join(words[:13]))]
    bench = decontam.Benchmark(spark.createDataFrame([("i", " ".join(words))], "item_id string, text string"))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    index = decontam.build_index(frame, bench, every=True)
    assert {r["doc_id"] for r in decontam.find(index, bench, slop=1).collect()} == {1, 2, 4}
    assert {r["doc_id"] for r in decontam.find(index, bench).collect()} == {4}
    with pytest.warns(UserWarning, match="every=True"):
        decontam.find(decontam.build_index(frame, bench), bench, slop=1)


def test_decontamination_oracle(spark):
    assert_same(queries.op4_decontamination(spark, f"{DATA}/sf0.001"), duck("sf0.001"), queries.ORACLE_SQL["op4_decontamination"])
