"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one a block; scripts, styles, comments and elements that their tag, role, class or id
names as menus, headers, footers, sidebars, notices, adverts, forms or reader comments go with all that they hold, and
boundaries of containers become blank lines. A line weighs its characters (none if links make up most of it or if it
reads like a notice); the distribution is the sum of weights over a sliding window of ``WINDOW`` lines. Where it leaves
zero a region begins, and within a region text is kept from the surge, the first group of lines whose windows reach
the bar, to the dive, the end of the last such group. Lines of an article, or else of a main element, are one group and
weigh in full, and where a page has them other lines weigh nothing.

Null and empty pages give an empty text. Every row gives one row: repeated rows and null ids stay, other columns are
ignored. Time and memory follow the size of a page; unclosed tags, comments and quotes are taken as browsers take them,
except that an unclosed quote ends with its tag.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

WINDOW, BAR, SLICE = 3, 86, 64
RAW = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp"}
HARD = {"nav", "header", "footer", "aside", "menu", "head", "noscript", "template", "svg", "math", "select", "button", "object", "canvas", "audio", "video", "dialog", "datalist"}
CONTAINERS = HARD | {"form", "div", "section", "article", "main", "ul", "ol", "dl", "table", "fieldset", "details", "center", "dir"}
BLOCKS = CONTAINERS | set("p h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody tfoot caption blockquote pre br hr legend figure figcaption address summary option body html".split())
HINTS = set(
    "nav navbar navigation menu menus breadcrumb breadcrumbs header masthead footer colophon sidebar aside rail ad ads advert adverts advertisement advertising adsense adslot promo promotion "
    "sponsor sponsored banner notice notices alert cookie cookies consent gdpr popup modal overlay toast newsletter subscribe signup login search form share sharing social related recommended "
    "pagination pager toolbar copyright disclaimer hidden contentinfo complementary alertdialog".split()
)
COMMENTS = set("comment comments commentlist disqus respond reply replies".split())
OF_ARTICLE = set("article post entry story".split())
NOTICE = re.compile(r"^(©|\(c\)|copyright\b)|all rights reserved|\bcookies?\b|privacy policy|terms of (use|service)|^(advertisement|sponsored|subscribe|share|log ?in|sign (in|up))\b", re.I)
MARK = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
NAMED = re.compile(r"""(?:^|\s)(class|id|role|itemprop|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
CLOSING = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.I) for name in RAW}
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
KEPT, SOFT, DROPPED = range(3)
OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


class Line(NamedTuple):
    text: str
    weight: int
    level: int
    fate: int


def _attributes(tag: str) -> tuple[set[str], set[str], bool]:
    """Pieces of class, id and role, whole values of role and itemprop, and whether the element is hidden."""
    pieces, whole, hidden = set(), set(), False
    for m in NAMED.finditer(tag):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            hidden |= value.lower() == "true"
        elif name == "style":
            hidden |= bool(re.search(r"display\s*:\s*none", value, re.I))
        else:
            whole |= {value.lower()} if name in ("role", "itemprop") else set()
            pieces |= {p.lower() for p in PIECE.findall(value)} if name != "itemprop" else set()
    return pieces, whole, hidden


def _enter(name: str, tag: str, fate: int, level: int) -> tuple[int, int]:
    """Fate and level (2 article, 1 main) of what an element holds."""
    pieces, whole, hidden = _attributes(tag) if tag else (set(), set(), False)
    if name == "article" or "articlebody" in whole:
        comment = pieces & COMMENTS or (name == "article" and level == 2)  # an article within an article is a comment on it
        return (DROPPED if hidden or comment else fate), 2
    if name == "main" or "main" in whole:
        return (DROPPED if hidden else fate), max(level, 1)
    if fate == DROPPED or hidden or pieces & COMMENTS or (name in HARD and not (name == "header" and level == 2)):
        return DROPPED, level
    hints = pieces & HINTS
    if level == 2 or pieces & OF_ARTICLE:
        hints -= {"header", "banner"}
    return (SOFT if hints or name == "form" else fate), level


def _lines(page: str) -> Iterator[Line | None]:
    """Lines of text in page order; None is a blank line."""
    stack: list[tuple[str, int, int]] = []
    opened: dict[str, int] = {}
    fate = level = links = size = linked = at = 0
    heading, parts = False, []

    def text_of() -> Line | None:
        nonlocal parts, size, linked
        text = " ".join("".join(parts).split())
        weight = len(text)
        if level == 0 and (2 * linked > size or (weight < 200 and NOTICE.search(text))):
            weight = 0
        elif heading:
            weight = max(weight, BAR)
        parts, size, linked = [], 0, 0
        return Line(text, weight, level, fate) if text else None

    def add(text: str) -> None:
        nonlocal size, linked
        if text and fate != DROPPED:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            size += len(text)
            linked += len(text) if links else 0

    while True:
        begin = page.find("<", at)
        if begin < 0:
            add(page[at:])
            break
        m = MARK.match(page, begin)
        if not m:
            add(page[at : begin + 1])
            at = begin + 1
            continue
        add(page[at:begin])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        end, tag = m[1] or m[4], m[3] or m[6] or ""
        if name == "a":
            links = 0 if end else 1
        if name in RAW and not end:
            close = CLOSING[name].search(page, at)
            at = close.end() if close else len(page)
        if name not in BLOCKS:
            continue
        line = text_of()
        if line:
            yield line
        heading = name == "h1" and not end
        if name in CONTAINERS:
            links = 0
            before = fate, level
            if not end:
                stack.append((name, fate, level))
                opened[name] = opened.get(name, 0) + 1
                fate, level = _enter(name, tag, fate, level)
            elif opened.get(name):
                while True:
                    last, fate, level = stack.pop()
                    opened[last] -= 1
                    if last == name:
                        break
            if level != before[1]:
                yield from [None] * WINDOW
            elif level == 0:
                yield None
    line = text_of()
    if line:
        yield line


def _kept(lines: list[Line | None]) -> Iterator[str]:
    """Lines from surge to dive of every region of the distribution."""
    weights = [x.weight if x else 0 for x in lines]
    sums = [0]
    for w in weights:
        sums.append(sums[-1] + w)
    last = len(weights)
    blocks = [sums[min(i + WINDOW, last)] - sums[i] for i in range(last)]
    # Groups: lines without a blank one between them, with the largest window that lies within the group.
    groups, i = [], 0
    while i < last:
        if lines[i] is None:
            i += 1
            continue
        j = i
        while j < last and lines[j] is not None:
            j += 1
        groups.append((i, j, max(sums[min(k + WINDOW, j)] - sums[k] for k in range(i, j))))
        i = j
    bar = max(1, min(BAR, max((g[2] for g in groups), default=0) / 2))
    region: list[tuple[int, int, int]] = []

    def between() -> Iterator[str]:
        high = [n for n, g in enumerate(region) if g[2] >= bar]
        for i, j, _ in region[high[0] : high[-1] + 1] if high else ():
            yield from (lines[k].text for k in range(i, j) if weights[k])

    for g in groups:
        if region and any(blocks[k] == 0 for k in range(region[-1][1], g[0])):
            yield from between()
            region = []
        region.append(g)
    yield from between()


def main_text(page: str | None) -> str:
    """Main text of one page, blocks joined by one space."""
    lines = list(_lines(page or ""))
    for fate, level in ((KEPT, 2), (KEPT, 1), (SOFT, 2), (SOFT, 1), (KEPT, 0)):
        if any(x and x.level >= level and x.fate <= fate for x in lines):
            # Within an article or main element what goes leaves no gap; elsewhere it is a blank line.
            chosen = [x if x is None or (x.level >= level and x.fate <= fate) else None for x in lines if level == 0 or x is None or x.level < level or x.fate <= fate]
            return " ".join(_kept(chosen))
    return ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, SLICE):
            found = [main_text(h) for h in part.column("html").to_pylist()]
            columns = [part.column("page_id"), part.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=OUT)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page. pages: page_id, url, html."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
