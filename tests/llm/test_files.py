"""Packing, WARC and the pipeline: round trips and brute-force versions."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from conftest import DATA, assert_same, duck
from tokenizers import Tokenizer

from pulsegrid.llm import ngram_join, packing, pii, queries, warc

TEXT = "doc_id long, text string"


def check_packing(rows, docs, capacity, tokenizer):
    """docs: (doc_id, text). Every token is in one place, and sequences have no gaps."""
    pieces: dict[int, list] = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    for doc, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        mine = sorted(pieces[doc], key=lambda r: r["piece"])
        cuts = range(0, len(ids), capacity)
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in mine] == [(k, a, min(capacity, len(ids) - a), zlib.crc32(ids[a : a + capacity].tobytes())) for k, a in enumerate(cuts)]
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_edges(spark):
    docs = [(1, None), (2, ""), (3, "Straße  naïve x\n\nÉÉ 北京 🙂"), (4, "a b " * 9000), *((10 + i, "word " * (i % 40)) for i in range(300))]
    frame = spark.createDataFrame(docs, TEXT).selectExpr("*", "1 as piece", "'q' as offset")
    path = queries.tokenizer_path()
    for capacity in (64, 4096):
        rows = packing.pack(frame.repartition(4), path, capacity).collect()
        n = check_packing(rows, docs, capacity, Tokenizer.from_file(path))
        total = sum(r["length"] for r in rows)
        assert n <= -(-total // capacity) * 1.05 + 1
    assert packing.pack(frame.limit(0), path).count() == 0


def test_repeated_rows_are_packed_each(spark):
    rows = packing.pack(spark.createDataFrame([(1, "a b c")] * 3, TEXT), queries.tokenizer_path()).collect()
    assert len(rows) == 3 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 3


def test_packing_on_the_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in queries.read(spark, f"{DATA}/sf0.01", "documents").collect()]
    path = queries.tokenizer_path()
    rows = queries.op2_packing(spark, f"{DATA}/sf0.01").collect()
    n = check_packing(rows, docs, 4096, Tokenizer.from_file(path))
    assert n <= -(-sum(r["length"] for r in rows) // 4096) * 1.02 + 1


def test_plan_uses_up_the_histogram():
    rng = np.random.default_rng(2)
    for capacity in (10, 100, 1000):
        histogram = {int(k): int(n) for k, n in zip(rng.integers(1, capacity + 1, 60), rng.integers(1, 500, 60), strict=True)}
        used: dict[int, int] = {}
        for pattern, n in packing.plan(histogram, capacity):
            assert sum(pattern) <= capacity and n > 0
            for x in pattern:
                used[x] = used.get(x, 0) + n
        assert used == histogram


def test_plan_of_every_length_is_tight():
    histogram = {n: 1 + 200_000 // n for n in range(1, 4097)}
    assert sum(n for _, n in packing.plan(histogram, 4096)) == -(-sum(k * n for k, n in histogram.items()) // 4096)


def brute_warc(pages):
    last: dict[str, int] = {}
    for page, _, html in pages:
        if len((html or "").encode()) >= 1000:
            d = hashlib.sha1(html.encode()).hexdigest()
            last[d] = max(page, last.get(d, page))
    out = []
    for page, _, html in pages:
        raw = (html or "").encode()
        d = hashlib.sha1(raw).hexdigest()
        first = len(raw) < 1000 or last[d] == page
        out.append((page, len(raw), d, "response" if first else "revisit", None if first else last[d]))
    return sorted(out, key=repr)


def test_warc_edges(spark):
    pages = [(i, f"https://www.host{i % 3}.org:443/p?{i % 5}#x", f"<p>é {i % 7}</p>" * 200) for i in range(60)]
    pages += [(100, None, None), (101, "", ""), (102, "http://a.b/", "x" * 999), (103, "http://a.b/", "x" * 999), (104, "not a url\r\n", "y" * 1000), (105, "same", "y" * 1000), (105, "same", "other payload"), (106, "http://user@A.B:8080/Q", "z" * 3_000_000)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'c' as digest", "1 as offset", "'k' as key")
    got = warc.round_trip(frame.repartition(4)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_warc(pages)
    assert warc.round_trip(frame.limit(0)).count() == 0


def test_warc_parses_what_it_writes():
    payload = "ü\r\n\r\nbody".encode()
    digest = hashlib.sha1(payload).hexdigest()
    assert warc.parse(warc.record("response", 7, "http://x/\r\nEvil: 1", payload, digest, None))["payload"] == payload
    again = warc.parse(warc.record("revisit", 3, None, payload, digest, 7))
    assert (again["payload_bytes"], again["payload_digest"], again["refers_to"]) == (len(payload), digest, 7)


def test_keys():
    assert warc.surt("https://www.Example.org:443/a?b#c") == "org,example)/a?b"
    assert warc.surt(None) == ""


def test_warc_oracle(spark):
    assert_same(queries.op3_warc(spark, f"{DATA}/sf0.01"), duck("sf0.01"), queries.ORACLE_SQL["op3_warc"])


def test_pipeline_against_the_operators(spark):
    """Each stage on its own input; brute force where the operator's own test is one."""
    import corpus_pipeline as pipeline
    from test_joins_and_search import brute_groups
    from test_scans import brute_contamination

    sf = f"{DATA}/sf0.001"
    docs = queries.read(spark, sf, "documents").unionByName(spark.createDataFrame([(900_001, None, "en", "s", 0), (900_002, "12 ?", "de", "s", 4), (900_003, "", None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    columns = list(pipeline.COLUMNS)
    texts = lambda df: [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    one = pipeline.table(pipeline.language(spark, docs, sf), "t-language")
    assert one.columns == columns
    assert sorted(texts(one)) == sorted((d, t) for d, t in texts(docs) if t and any(c.isalpha() for c in t))
    two = pipeline.table(pipeline.near_duplicates(spark, one, sf), "t-near")
    groups = brute_groups(texts(one))
    assert two.columns == columns and sorted(d for d, _ in texts(two)) == sorted({c for _, c in groups.values()})
    three = pipeline.table(pipeline.decontaminate(spark, two, sf), "t-clean")
    marks = brute_contamination(texts(two), [(r["item_id"], r["text"]) for r in queries.read(spark, sf, "benchmark").collect()])
    assert three.columns == columns and sorted(d for d, _ in texts(three)) == sorted(m[0] for m in marks if not m[-1])
    four = pipeline.table(pipeline.remove_pii(spark, three, sf), "t-pii")
    assert four.columns == columns and sorted(texts(four)) == sorted((d, pii.redact(t)) for d, t in texts(three))
    five = pipeline.pack(spark, four, sf).collect()
    check_packing(five, texts(four), 4096, Tokenizer.from_file(queries.tokenizer_path()))
    assert [n for n, _ in pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "pii", "packing"]
    assert ngram_join.PERCENT == 75
