"""Short licence notices by fuzzy search.

A notice of a few words is split into ``errors + 1`` pieces; by the pigeonhole rule any occurrence with at
most so many edits holds one piece unchanged. The pieces are exact seeds, found over the whole text (words
joined by one blank); each span from a word that may begin an occurrence about a seed to a word border within its
edits is then matched whole by the regex library with bounds of no edits, one, and so on. So all spans of whole words within a notice's edits are found,
overlapping ones too, each with its least edits; edits count bytes. Spans without edits of a base phrase are
the base; the others add labels of their own.

Null texts are empty. Rows repeat as they are; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import ALNUM, texts

#: Base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further notices; the number of edits allowed in each and in the longer base phrases.
NOTICES = {
    "under the mit license": ("mit", 2),
    "apache license version 2": ("apache-2", 3),
    "gnu general public license": ("gpl", 3),
    "all rights reserved": ("proprietary", 2),
    "creative commons attribution": ("cc-by", 3),
    "mozilla public license": ("mpl", 2),
}


def pieces(phrase: str, errors: int) -> list[tuple[int, bytes]]:
    n, k = len(phrase), errors + 1
    cuts = [round(i * n / k) for i in range(k + 1)]
    return [(a, phrase[a:b].encode()) for a, b in zip(cuts, cuts[1:], strict=False)]


def bounded(phrase: str, errors: int) -> list[regex.Pattern]:
    """Patterns of the phrase with at most no, one, ... and ``errors`` edits."""
    return [regex.compile(b"(?:%s){e<=%d}" % (regex.escape(phrase, special_only=True).encode(), e)) for e in range(errors + 1)]


_FUZZY = [(phrase.encode(), label, errors, pieces(phrase, errors), bounded(phrase, errors)) for phrase, (label, errors) in NOTICES.items()]


def blanks_of(padded: bytes) -> np.ndarray:
    """Where the blanks stand: the word that begins after blank i is word i, counted once for all places."""
    return np.flatnonzero(np.frombuffer(padded, np.uint8) == 32)


def base_places(padded: bytes) -> list[tuple[int, str]]:
    """(word index, label) of every place of a base phrase; padded: b' word word '."""
    out, blanks = [], None
    for phrase, label in PHRASES.items():
        needle, at = b" " + phrase.encode() + b" ", -1
        while (at := padded.find(needle, at + 1)) >= 0:
            blanks = blanks_of(padded) if blanks is None else blanks
            out.append((int(np.searchsorted(blanks, at)), label))
    return out


def span_edits(patterns: list[regex.Pattern], text: bytes, begin: int, end: int) -> int | None:
    """The least number of edits with which the notice matches the whole span, by trying its bounds in turn; None beyond all."""
    return next((edits for edits, pattern in enumerate(patterns) if pattern.fullmatch(text, begin, end)), None)


def fuzzy_places(padded: bytes) -> list[tuple[int, int, str, int]]:
    """(begin, end, label, edits) in the padded text of every span of whole words within a notice's edits."""
    out = []
    for phrase, label, errors, seeds, patterns in _FUZZY:
        seen: set[int] = set()
        for offset, seed in seeds:
            at = -1
            while (at := padded.find(seed, at + 1)) >= 0:
                blank, last = max(0, at - offset - errors - 1), at - offset + errors
                while (blank := padded.find(b" ", blank, max(0, last))) >= 0:
                    blank += 1
                    if blank not in seen:
                        seen.add(blank)
                        end = padded.find(b" ", blank + max(1, len(phrase) - errors))
                        while 0 <= end <= blank + len(phrase) + errors:
                            edits = span_edits(patterns, padded, blank, end)
                            if edits is not None:
                                out.append((blank, end, label, edits))
                            end = padded.find(b" ", end + 1)
    return out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (word:word:label:edits)."""
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in texts(batch.column("text")):
                words = (text or b"").translate(ALNUM).split()
                padded = b" " + b" ".join(words) + b" "
                base = base_places(padded)
                fuzzy = fuzzy_places(padded)
                labels = {x for _, x in base}
                own = {x[2] for x in fuzzy}
                best = max([1.0] * bool(base) + [1 - x[3] / (x[1] - x[0] + 1) for x in fuzzy], default=0.0)
                where = [i for i, _ in base]
                blanks = blanks_of(padded) if fuzzy else None
                spans = ",".join(f"{np.searchsorted(blanks, a) - 1}:{np.searchsorted(blanks, b)}:{x}:{e}" for a, b, x, e in sorted(fuzzy))
                rows.append((len(words), len(base), min(where, default=None), max(where, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | own)), best, spans))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
