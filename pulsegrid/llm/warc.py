"""WARC archives with a two-level capture index.

Writing: each task appends one gzip member per record to an archive of its own in the shared folder and
returns the captures (key, page, file, offset, length). Payloads of equal SHA-1 and length, at least
``REVISIT_BYTES`` long, have one response (the largest page_id); the others are revisits that refer to it.

Index: captures are range-partitioned by (reversed-host key, page_id) and sorted; every ``BLOCK`` of them is one
compressed block of an index file (level one). The directory (level two) is sparse: a row for each block with
its first and last key. Equal keys may be cut anywhere, since the page_id is part of the order.

Reading: tasks take a sorted range of lookup keys, read from the directory the rows of that range only,
binary-search it for the block and the block for the capture. The captures found are then dealt by (file,
offset), so that records are read by ranges in the order of the archives.

Null payloads are empty; null URLs have the empty key; a null page_id counts as the smallest, -2^63, and comes back as null. Page rows that repeat exactly share a record's
content; rows with one page_id and different payloads are told apart by their digests. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, open_fs, table

BLOCK, REVISIT_BYTES = 512, 1_000
#: Stands for a missing page_id in records and index.
NO_ID = -(2**63)
CAPTURE = "key string, page_id long, digest string, file string, offset long, length long"
_URL = re.compile(r"^(?:([A-Za-z][A-Za-z0-9+.-]*)://)?(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]+))?([^#]*)")


def surt(url: str | None) -> str:
    """Reversed-host key: ``com,example,www)/path?query``; fragments, user and default ports go."""
    m = _URL.match((url or "").strip())
    host, port, rest = (m[2] or "").lower(), m[3], m[4] or "/"
    if not host:
        return rest if url else ""
    host = ",".join(reversed(host.removeprefix("www.").split(".")))
    return f"{host}{':' + port if port and port not in ('80', '443') else ''}){rest if rest.startswith('/') else '/' + rest}"


def record(kind: str, page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member. The block of a revisit ends after the HTTP header, which keeps the full length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}:{digest}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c for c in url if c not in "\r\n"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}:{digest}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + pack.flush()


def parse(member: bytes) -> dict:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, payload of a gzip member."""
    data = zlib.decompress(member, 31)
    at = data.index(b"\r\n\r\n")
    head = dict(line.split(": ", 1) for line in data[:at].decode().split("\r\n")[1:])
    block = data[at + 4 : at + 4 + int(head["Content-Length"])]
    cut = block.index(b"\r\n\r\n") + 4
    payload = block[cut:]
    out = {"page_id": int(head["WARC-Record-ID"].split(":")[2]), "record_type": head["WARC-Type"], "refers_to": None, "payload": payload}
    if head["WARC-Type"] == "revisit":
        size = re.search(rb"Content-Length: (\d+)", block)
        refers = int(head["WARC-Refers-To"].split(":")[2])
        return out | {"payload_bytes": int(size[1]), "payload_digest": head["WARC-Payload-Digest"].removeprefix("sha1:"), "refers_to": refers}
    return out | {"payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest()}


def with_digests(pages: DataFrame) -> DataFrame:
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("page_id"), "url", html.alias("payload")).withColumn("digest", F.sha1("payload"))


def write_archives(pages: DataFrame) -> DataFrame:
    """CAPTURE rows, written; archives lie beside them in the shared folder."""
    folder = new_path(pages.sparkSession, "warc")
    full = with_digests(pages)
    ids = table(full.filter(F.length("payload") >= REVISIT_BYTES).select("page_id", "digest"), "warc-digests")
    last = ids.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    last = table(last.select("digest", "refers_to"), "warc-last")
    revisits = ids.join(last, "digest").filter("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()
    rows = full.join(table(revisits, "warc-revisits"), ["page_id", "digest"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        name, out, offset = f"{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for batch in batches:
                made: list[tuple] = []
                for r in batch.to_pylist():
                    kind = "response" if r["refers_to"] is None else "revisit"
                    data = record(kind, r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"])
                    if out is None:
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    out.write(data)
                    made.append((surt(r["url"]), r["page_id"], r["digest"], f"{folder}/{name}", offset, len(data)))
                    offset += len(data)
                yield _captures(made)
        finally:
            if out is not None:
                out.close()

    return table(rows.mapInArrow(run, CAPTURE), "warc-captures")


def _captures(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 6
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["key", "page_id", "digest", "file", "offset", "length"])


_ORDER = ("key", "page_id", "digest")


def build_index(captures: DataFrame) -> str:
    """Write the blocks; return the path of the directory table: first, last (JSON keys), file, offset, length, n."""
    folder = new_path(captures.sparkSession, "cdx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(f"{folder}/blocks")
        fs.create_dir(base, recursive=True)
        name, out, offset, held = f"{uuid.uuid4().hex}.cdx.gz", None, 0, []

        def block(rows: list[dict]) -> pa.RecordBatch:
            nonlocal out, offset
            data = gzip.compress("\n".join(json.dumps([r["key"], r["page_id"], r["digest"], r["file"], r["offset"], r["length"]]) for r in rows).encode(), 6, mtime=0)
            if out is None:
                out = fs.open_output_stream(f"{base}/{name}", compression=None)
            out.write(data)
            offset += len(data)
            ends = [r["key"] for r in (rows[0], rows[-1])]
            row = [*ends, rows[0]["page_id"], rows[0]["digest"], f"{folder}/blocks/{name}", offset - len(data), len(data), len(rows)]
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["first", "last", "first_page", "first_digest", "file", "offset", "length", "n"])

        try:
            for batch in batches:
                held += batch.to_pylist()
                while len(held) >= BLOCK:
                    yield block(held[:BLOCK])
                    held = held[BLOCK:]
            if held:
                yield block(held)
        finally:
            if out is not None:
                out.close()

    parts = max(1, captures.sparkSession.sparkContext.defaultParallelism)
    sorted_ = captures.repartitionByRange(parts, *_ORDER).sortWithinPartitions(*_ORDER)
    schema = "first string, last string, first_page long, first_digest string, file string, offset long, length long, n long"
    sorted_.mapInArrow(run, schema).write.parquet(f"{folder}/directory")
    return f"{folder}/directory"


class _Reader:
    """Range reads from few open files."""

    def __init__(self):
        self.open: dict[str, object] = {}

    def read(self, file: str, offset: int, length: int) -> bytes:
        if file not in self.open:
            if len(self.open) >= 16:
                self.open.pop(next(iter(self.open))).close()
            fs, p = open_fs(file)
            self.open[file] = fs.open_input_file(p)
        f = self.open[file]
        f.seek(offset)
        return f.read(length)


def lookup(keys: DataFrame, directory: str) -> DataFrame:
    """CAPTURE rows of the keys (key, page_id, digest) that the index holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds

        fs, p = open_fs(directory)
        dataset, reader, at_block, lines = ds.dataset(p, filesystem=fs, format="parquet"), _Reader(), None, []
        for batch in batches:
            wanted = list(zip(*(batch.column(c).to_pylist() for c in _ORDER), strict=True))
            if not wanted:
                continue
            reach = (ds.field("first") <= max(wanted)[0]) & (ds.field("last") >= min(wanted)[0])
            blocks = dataset.to_table(filter=reach).sort_by([("first", "ascending"), ("first_page", "ascending"), ("first_digest", "ascending")]).to_pylist()
            starts = [(b["first"], b["first_page"], b["first_digest"]) for b in blocks]
            found = []
            for w in wanted:
                k = bisect.bisect_right(starts, w) - 1
                if k < 0:
                    continue
                b = (blocks[k]["file"], blocks[k]["offset"], blocks[k]["length"])
                if b != at_block:
                    at_block = b
                    lines = [tuple(json.loads(x)) for x in gzip.decompress(reader.read(*b)).split(b"\n")]
                i = bisect.bisect_left(lines, w, key=lambda x: x[:3])
                if i < len(lines) and lines[i][:3] == w:
                    found.append(lines[i])
            yield _captures(found)

    parts = max(1, keys.sparkSession.sparkContext.defaultParallelism)
    return keys.repartitionByRange(parts, *_ORDER).sortWithinPartitions(*_ORDER).mapInArrow(run, CAPTURE)


def read_records(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the captures' records, by range reads in file order."""
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader()
        for batch in batches:
            rows = [parse(reader.read(r["file"], r["offset"], r["length"])) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], list(names))

    parts = max(1, captures.sparkSession.sparkContext.defaultParallelism)
    dealt = captures.repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return dealt.select("file", "offset", "length").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages, index them, look every page up by its URL key and read its record back."""
    captures = write_archives(pages)
    directory = build_index(captures)
    records = read_records(table(lookup(captures.select(*_ORDER), directory), "warc-found"))
    return records.withColumn("page_id", F.nullif(F.col("page_id"), F.lit(NO_ID)))
