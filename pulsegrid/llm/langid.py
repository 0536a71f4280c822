"""Language ID in two levels: the family first, then one-versus-one support vector machines within it.

A text is the hashed counts of its byte pairs and triples (letters only, ASCII lowered), square-rooted and of
length one. Linear support vector machines (squared hinge) are fitted for each pair of families and for each
pair of languages of a family, in the driver, on a bounded sample of about ``SAMPLE`` labelled rows, dealt
evenly to the (at most ``LANGUAGES``, the commonest) languages. Pairs vote; the summed margins break ties. The score is the logistic of the smallest
winning margin of both levels.

``und`` with score 0: null, empty, or no letter (Unicode category L). Repeated rows give a row each; other columns are ignored. With
no language learned, all is ``und``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import least_hash, positive_hash, slices, small_batches, texts
from .toxicity import LETTERS

WIDTH, SAMPLE = 1 << 12, 4_000
#: The commonest languages that are learned.
LANGUAGES = 200
#: Families of language codes; a code that is not here is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "pl", "cs", "uk", "bg", "sk", "hr", "sr"),
    "uralic": ("fi", "hu", "et"),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}
_LETTER = regex.compile(r"\p{L}")


def family(lang: str) -> str:
    return _FAMILY.get(lang, f"own:{lang}")


def features(values: list[bytes | None]) -> np.ndarray:
    out = np.zeros((len(values), WIDTH), np.float32)
    for i, v in enumerate(values):
        b = np.frombuffer(b" " + b" ".join((v or b"").translate(LETTERS).split()) + b" ", np.uint8).astype(np.uint32)
        two = b[:-1] << np.uint32(8) | b[1:]
        three = two[:-1] << np.uint32(8) | b[2:]
        count = np.bincount((two * np.uint32(2654435761)) >> np.uint32(20), minlength=WIDTH) + np.bincount((three * np.uint32(2246822519)) >> np.uint32(20), minlength=WIDTH)
        row = np.sqrt(count[:WIDTH])
        out[i] = row / max(1e-9, np.sqrt((row**2).sum()))
    return out


def _svm(x: np.ndarray, y: np.ndarray, rounds: int = 400, c: float = 300.0) -> np.ndarray:
    """w (the last entry is the bias) of the squared hinge; y is 1 or -1, both sides weigh the same."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = z = np.zeros(x.shape[1] + 1, np.float32)
    rate = 1 / (1 / c + 4)
    for t in range(rounds):
        pull = weight * y * np.maximum(0, 1 - y * (x @ z[:-1] + z[-1]))
        nxt = z - rate * (z / c - 2 * np.append(pull @ x, pull.sum()))
        z = nxt + t / (t + 3) * (nxt - w)
        w = nxt
    return w


class Model:
    """Languages, their families, and a machine for each pair of each level."""

    def __init__(self, langs: list[str], x: np.ndarray, y: np.ndarray):
        self.langs = langs
        self.families = sorted({family(v) for v in langs})
        own = np.array([self.families.index(family(v)) for v in langs])
        self.groups = [[i for i in range(len(langs)) if own[i] == f] for f in range(len(self.families))]
        self.top = self._pairs(range(len(self.families)), x, own[y] if len(y) else y)
        self.within = [self._pairs(g, x, y) for g in self.groups]

    @staticmethod
    def _pairs(labels, x, y):
        out = []
        for a, b in itertools.combinations(labels, 2):
            use = (y == a) | (y == b)
            out.append((a, b, _svm(x[use], np.where(y[use] == a, 1, -1).astype(np.float32))))
        return out

    @staticmethod
    def _vote(pairs, labels, x) -> tuple[np.ndarray, np.ndarray]:
        """Winner of each row and its smallest margin."""
        labels = list(labels)
        if len(labels) == 1 or not len(x):
            return np.full(len(x), labels[0] if labels else 0), np.full(len(x), 3.0)
        margin = np.full((len(x), len(labels), len(labels)), np.nan)
        for a, b, w in pairs:
            m = x @ w[:-1] + w[-1]
            margin[:, labels.index(a), labels.index(b)] = m
            margin[:, labels.index(b), labels.index(a)] = -m
        rank = (margin > 0).sum(2) + 0.1 * np.tanh(np.nansum(margin, 2))
        win = rank.argmax(1)
        return np.array(labels)[win], np.nanmin(margin[np.arange(len(x)), win], 1)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        fam, m = self._vote(self.top, range(len(self.families)), x)
        lang = np.zeros(len(x), np.int64)
        for f, g in enumerate(self.groups):
            use = np.flatnonzero(fam == f)
            lang[use], inner = self._vote(self.within[f], g, x[use])
            m[use] = np.minimum(m[use], inner)
        return [self.langs[i] for i in lang], 1 / (1 + np.exp(-4 * m))


def _sparse(row: np.ndarray) -> bytes:
    at = np.flatnonzero(row)
    return at.astype("<u2").tobytes() + row[at].astype("<f4").tobytes()


def learn(labelled: DataFrame, sample: int = SAMPLE, languages: int = LANGUAGES) -> Model:
    """labelled: doc_id, text, lang. Null languages and texts without letters teach nothing."""
    small_batches(labelled.sparkSession)
    known = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()}
    if not counts:
        return Model([], np.zeros((0, WIDTH), np.float32), np.zeros(0, np.int64))
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, least_hash(sample / len(counts), n))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                f = [_sparse(row) for row in features(texts(part.column("text")))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array(f, pa.binary())], ["doc_id", "lang", "f"])

    chosen = known.filter(positive_hash("doc_id", "lang") <= share[F.col("lang")])
    got = chosen.select("doc_id", "text", "lang").mapInArrow(run, "doc_id long, lang string, f binary").toPandas().sort_values(["doc_id", "lang"])
    langs = sorted(set(got["lang"]))
    x = np.zeros((len(got), WIDTH), np.float32)
    for row, f in zip(x, got["f"], strict=True):
        n = len(f) // 6
        row[np.frombuffer(f, "<u2", n)] = np.frombuffer(f, "<f4", n, 2 * n)
    return Model(langs, x, np.array([langs.index(v) for v in got["lang"]], np.int64))


def found(model: Model, text: str = "text") -> Column:
    """lang_pred and score of a text column; the text itself does not come back from the task's Python."""

    @F.arrow_udf("lang_pred string, score double")
    def run(column: pa.Array) -> pa.Array:
        langs, scores = [], []
        for i in range(0, len(column), 256):
            raw = texts(column.slice(i, 256))
            one, sure = model.predict(features(raw)) if model.langs else (["und"] * len(raw), np.zeros(len(raw)))
            for k, v in enumerate(raw):
                if not v or not _LETTER.search(v.decode()):
                    one[k], sure[k] = "und", 0.0
            langs += one
            scores += sure.tolist()
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return run(F.col(text))


def identify(docs: DataFrame, model: Model, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The given columns, lang_pred, score."""
    return docs.select(*columns, found(model).alias("__found")).select(*columns, "__found.lang_pred", "__found.score")
