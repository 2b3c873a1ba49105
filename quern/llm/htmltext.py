"""Main text of HTML pages from flat text blocks and a decision tree.

A page is cut into flat blocks. A block has its words and link density, those
of the blocks before and after it, its share of the page's words outside
links, whether it is a heading, an item or bare text of a container, whether
most of those words aren't bare, and whether it lies in an article or in a box
that tags or names tell. A decision
tree, grown here on a small table of labelled blocks, tells main text from
the rest. Many of the labelled pages are made of plain containers without
names, and their menus of links in lists, paragraphs or none of both, so the
tree works where pages tell nothing by their markup.

Defined results: a null or empty page, or one without main text, gives the
empty text; unclosed comments, scripts and tags run to the page's end; a line
break is white space; repeated pages are judged each; an empty table gives no
rows; extra columns are ignored, whatever their names; ties don't occur.
"""

from __future__ import annotations

import html
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_batches
from .htmllabels import PAGES

#: A comment, declaration, element without text of the page, or tag; each runs to the end if it isn't closed.
#: Quotes count after an equals sign only. Nothing is tried twice, so the scan takes time in proportion to the page.
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(script|style|noscript|template|textarea|select|svg|iframe|object|title|math)\b[^>]*+(?:>|\Z).*?(?:</\1\s*+>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9-]*+)((?:=\s*+\"[^\"]*+(?:\"|\Z)|=\s*+'[^']*+(?:'|\Z)|[^>])*+)(?:>|\Z)",
    re.S | re.I,
)
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINERS = frozenset("div section nav header footer aside form article main ul ol dl table body figure fieldset dialog menu center".split())
VOID = frozenset("br img input hr meta link wbr area base col embed source track".split())
BY_TAG = {"article": "article", "main": "article", "nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "fieldset": "form", "dialog": "notice"}
BY_WORD = {
    **dict.fromkeys("article post entry story content body main".split(), "article"),
    **dict.fromkeys("nav navbar navigation menu breadcrumb breadcrumbs tabs pagination pager toc".split(), "nav"),
    **dict.fromkeys("header masthead topbar banner".split(), "header"),
    **dict.fromkeys("footer colophon copyright legal bottom".split(), "footer"),
    **dict.fromkeys("aside sidebar side widget related recommended recommendations rail share social".split(), "aside"),
    **dict.fromkeys("form search login signup subscribe newsletter".split(), "form"),
    **dict.fromkeys("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion".split(), "ad"),
    **dict.fromkeys("comment comments respond replies reply disqus discussion".split(), "comments"),
    **dict.fromkeys("notice cookie cookies consent gdpr popup modal alert overlay".split(), "notice"),
}
ATTRIBUTE = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
WORD = re.compile(r"\S+")
#: A name that begins so tells what an element has or hides, not what it is.
QUALIFIERS = frozenset("has no not with without is in show hide hidden enable disable open close".split())
NAMES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "heading", "item", "bare", "tagged", "article", "has_article", "boxed", "share")


def named(value: str) -> str | None:
    """The zone that one name of a class or id tells: its last word decides, else its first."""
    words = re.split(r"[^a-z]+", value.lower())
    words = [w for w in words if w]
    if not words or words[0] in QUALIFIERS:
        return None
    return BY_WORD.get(words[-1]) or BY_WORD.get(words[0])


def zone_of(tag: str, attributes: str) -> str | None:
    """What a container opens: `article`, another zone, or None. A tag that says so decides; among names an excluding one counts first."""
    if tag in BY_TAG:
        return BY_TAG[tag]
    found = [z for value in ATTRIBUTE.findall(attributes) for name in value.strip("\"'").split() if (z := named(name))] if "=" in attributes else []
    return min(found, key=lambda z: z == "article", default=None)


def linked_words(raw: str, spans: list[tuple[int, int]]) -> tuple[int, int]:
    """Words of a block as it stands in the page, and how many of them begin in a link."""
    starts = np.array([m.start() for m in WORD.finditer(raw)], np.int64)
    inside = np.zeros(len(starts), bool)
    for a, b in spans:
        inside |= (starts >= a) & (starts < b)
    return len(starts), int(inside.sum())


class Zone:
    """A container that its tag or names give a part of the page, with the words in it and those of them that aren't links."""

    def __init__(self, kind: str):
        self.kind, self.words, self.text, self.whole = kind, 0, 0, False


def flat_blocks(page: str) -> tuple[list[str], np.ndarray]:
    """Texts of the blocks in page order, and a row of features for each.

    A box that holds the article isn't one, whatever it is called: a zone with more than half of the page's words outside
    links is no box if an article or the page's first heading begins in it, or if it holds four fifths of them.
    """
    texts, rows, zones = [], [], []
    stack: list[tuple[str, Zone | None]] = []
    opened: dict[str, int] = {}
    around: list[Zone] = []
    parts: list[str] = []
    spans: list[tuple[int, int]] = []
    size = heading = item = plain = 0
    in_link = titled = False

    def flush() -> None:
        nonlocal size
        words = html.unescape("".join(parts)).split() if parts else ()
        if words:
            seen, linked = linked_words("".join(parts), spans) if spans else (len(words), 0)
            texts.append(" ".join(words))
            rows.append([len(words), linked / max(1, seen), 0, 0, 0, 0, heading, item, not plain, 0, 0, 0, 0, 0])
            zones.append(tuple(around))
            for zone in around:
                zone.words += len(words)
                zone.text += len(words) - min(linked, len(words))
        parts.clear()
        spans.clear()
        size = 0

    def add(piece: str) -> None:
        nonlocal size
        parts.append(piece)
        if in_link:
            spans.append((size, size + len(piece)))
        size += len(piece)

    at = 0
    for m in MARKUP.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        closes = m[2] == "/"
        if tag in INLINE:
            if tag == "a":
                in_link = not closes
            elif tag == "br":
                add(" ")
            continue
        flush()
        in_link = False
        if tag in CONTAINERS:
            heading = item = plain = 0
            if not closes:
                if not m[4].endswith("/"):
                    kind = zone_of(tag, m[4])
                    zone = Zone(kind) if kind else None
                    if kind == "article":
                        for outer in around:
                            outer.whole = True
                    stack.append((tag, zone))
                    opened[tag] = opened.get(tag, 0) + 1
                    if zone:
                        around.append(zone)
            elif opened.get(tag):
                t = None
                while t != tag:
                    t, zone = stack.pop()
                    opened[t] -= 1
                    if zone:
                        around.pop()
        elif tag not in VOID:
            heading = int(not closes and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit())
            if heading and tag == "h1" and not titled:
                titled = True
                for outer in around:
                    outer.whole = True
            item = int(not closes and tag in ("li", "dt", "dd", "option", "td", "th"))
            plain = int(not closes)
    if at < len(page):
        add(page[at:])
    flush()
    x = np.array(rows, np.float64).reshape(len(rows), len(NAMES))
    text = x[:, 0] * (1 - x[:, 1])
    total = text.sum()
    box = lambda z: z.kind != "article" and not (2 * z.text > total and (z.whole or 5 * z.text >= 4 * total))
    x[:, 10] = [any(z.kind == "article" for z in around) for around in zones]
    x[:, 12] = [any(box(z) for z in around) for around in zones]
    x[1:, 2:4], x[:-1, 4:6] = x[:-1, :2], x[1:, :2]
    x[:, 9] = 2 * (text * (1 - x[:, 8])).sum() > total
    x[:, 11] = x[:, 10].any()
    x[:, 13] = text / max(1, total)
    return texts, x


class Tree:
    """A binary decision tree grown by Gini impurity on numeric features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 10, least: int = 3):
        self.split = None
        self.label = bool(2 * y.sum() >= len(y))
        if depth == 0 or len(y) < 2 * least or y.all() or not y.any():
            return
        best = len(y) * self._gini(y) - 1e-9
        for j in range(x.shape[1]):
            values = np.unique(x[:, j])
            for cut in (values[1:] + values[:-1]) / 2:
                left = x[:, j] <= cut
                if min(left.sum(), (~left).sum()) < least:
                    continue
                cost = left.sum() * self._gini(y[left]) + (~left).sum() * self._gini(y[~left])
                if cost < best:
                    best, self.split = cost, (j, cut)
        if self.split:
            left = x[:, self.split[0]] <= self.split[1]
            self.low, self.high = Tree(x[left], y[left], depth - 1, least), Tree(x[~left], y[~left], depth - 1, least)

    @staticmethod
    def _gini(y: np.ndarray) -> float:
        p = y.mean()
        return 2 * p * (1 - p)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not self.split:
            return np.full(len(x), self.label)
        left = x[:, self.split[0]] <= self.split[1]
        out = np.empty(len(x), bool)
        out[left], out[~left] = self.low(x[left]), self.high(x[~left])
        return out


@cache
def trained() -> Tree:
    """The tree grown on the labelled pages of htmllabels."""
    xs, ys = [], []
    for page in PAGES:
        texts, x = flat_blocks("".join(markup for markup, _ in page))
        labels = [label for _, label in page if label is not None]
        if len(labels) != len(texts):
            raise ValueError(f"{len(labels)} labels for {len(texts)} blocks: {texts}")
        xs.append(x)
        ys += labels
    return Tree(np.concatenate(xs), np.array(ys, bool))


def extract(pages: list[str | None]) -> list[str]:
    cut = [flat_blocks(p or "") for p in pages]
    main = trained()(np.concatenate([x for _, x in cut])) if cut else np.empty(0, bool)
    out, at = [], 0
    for texts, _ in cut:
        out.append("\n".join(t for t, keep in zip(texts, main[at : at + len(texts)], strict=True) if keep))
        at += len(texts)
    return out


def main_text(pages: DataFrame, column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns in `keep`, then text and n_chars (code points)."""
    rows = pages.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(keep)), F.col(column).cast("string").alias("_html"))

    def run(batch: pa.RecordBatch) -> pa.Table:
        done = []
        for part in (batch.slice(i, 256) for i in range(0, max(1, batch.num_rows), 256)):
            texts = extract(part.column(len(keep)).to_pylist())
            done.append(pa.record_batch([*part.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*part.schema.names[: len(keep)], "text", "n_chars"]))
        return pa.Table.from_batches(done)

    schema = ", ".join([*(f"_{i} {pages.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), "text string", "n_chars long"])
    return map_batches(rows, run, schema).select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(keep)), "text", "n_chars")


def query(pages: DataFrame) -> DataFrame:
    return main_text(pages)
