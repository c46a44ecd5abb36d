"""Main text of web pages: flat text blocks, judged by a small decision tree."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|iframe|svg|textarea|select|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"'<]|\"[^\"<]*\"|'[^'<]*')*+|[^>]*)>"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)

INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
MAIN = frozenset(("article", "main"))
#: Tags and words in class, id and role whose content is not the article.
OTHER_TAGS = frozenset(("nav", "footer", "aside", "form", "button", "dialog", "menu"))
OTHER_NAMES = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead comment comments disqus reply replies cookie cookies consent notice alert popup modal newsletter subscribe signup share social related login search pagination toolbar widget commentlist".split()
)
#: Words of readers, which stay so even if an article tag marks them.
REPLY_NAMES = frozenset("comment comments disqus reply replies commentlist".split())
#: Beside one of the names above in the same class, these tell how a part is laid out ("has-sidebar").
LAYOUT_NAMES = frozenset(
    "has have with without no not is show hide enable enabled disable disabled open closed on off sticky fixed static transparent left right top bottom one two three full wide layout grid col cols column columns".split()
)


@dataclass
class Block:
    text: str
    words: int
    linked: int  # words in links
    other: bool  # within a part that is not the article
    main: bool  # within article or main


@dataclass
class Part:
    """An element whose class, id or role names something that is not the article, or an outermost article or main."""

    layout: bool = False  # each name has a word of layout
    reply: bool = False  # it or one around it is of readers
    outer: Part | None = None
    inside: bool = False  # within article or main
    words: int = 0
    other: bool = False  # not the article
    other_main: bool = False  # the same for an article or main in it that has most words


def _other_part(tag: str, attributes: str, in_main: bool) -> bool | Part:
    """Whether tag or attributes say that this is not the article; a part if only its names do."""
    if tag in OTHER_TAGS or tag == "header" and not in_main:
        return True
    if not attributes:
        return False
    if _HIDDEN.search(attributes):
        return True
    if tag in MAIN or tag in ("body", "html"):
        return False
    # an article's own header has its title
    other = OTHER_NAMES - {"header"} if in_main else OTHER_NAMES
    found = [
        words
        for m in _NAMES.finditer(attributes)
        for name in (m[1] or m[2] or m[3] or "").lower().split()
        if not other.isdisjoint(words := set(re.split(r"[^a-z]+", name)))
    ]
    if not found:
        return False
    plain = [words for words in found if LAYOUT_NAMES.isdisjoint(words)]
    return Part(not plain, any(not REPLY_NAMES.isdisjoint(words) for words in plain))


def _tokens(html: str) -> Iterator[re.Match]:
    """Tags, comments and elements whose content is no text. All end with the last ``>`` at the latest, but for those that
    are left open, so nothing beyond is searched for an end that is not there."""
    last, end = html.rfind(">") + 1, len(html)
    for token in _TOKEN.finditer(html, 0, last):
        if token.end() < last or not _left_open(token):
            yield token
        else:
            yield _TOKEN.match(html, token.start(), end)


def _left_open(token: re.Match) -> bool:
    if token[1]:
        return not re.search(rf"</{token[1]}\s*>\Z", token[0], re.I)
    return token[0].startswith("<!--") and not token[0].endswith("-->")


def _without_comment(html: str, at: int) -> str:
    """What follows the last tag, up to a comment that is left open."""
    rest = html[at:]
    return rest if (start := rest.find("<!--")) < 0 else rest[:start]


def blocks(html: str) -> list[Block]:
    """Text blocks in page order. A tag that is not inline ends a block; character references are decoded and white
    space becomes one space. An end tag closes the nearest open element of its name, if there is one.

    What names alone call another part is the article nevertheless where it has most of the page's words: a
    part named by its layout, or an article or main within a part that is not of readers. Words of readers
    and in parts that are not the article by their tag, or hidden, do not count for that.
    """
    out: list[Block] = []
    within: list[tuple[Part | None, Part | None]] = []  # for each block the named part and outermost article around it
    # open element, not the article by its tag, named part, outermost article
    stack: list[tuple[str, bool, Part | None, Part | None]] = []
    opened: Counter[str] = Counter()  # elements of the stack, by tag
    named_parts: list[Part] = []
    parts: list[str] = []
    linked = depth = at = 0
    aside: bool | Part = False  # within a paragraph that is not the article; it ends with any other block

    def text(piece: str) -> None:
        nonlocal linked
        if piece:
            parts.append(piece)
            if depth:
                linked += len(unescape(piece).split())

    def flush() -> None:
        nonlocal linked
        content = " ".join(unescape("".join(parts)).split())
        if content:
            other, named, main = stack[-1][1:] if stack else (False, None, None)
            named = aside if isinstance(aside, Part) else named
            out.append(Block(content, len(content.split()), linked, other or aside is True, main is not None))
            within.append((named, main))
        parts.clear()
        linked = 0

    for token in _tokens(html):
        text(html[at : token.start()])
        at = token.end()
        tag = token[3]
        if tag is None:
            if token[1]:
                flush()
            continue
        tag, closing = tag.lower(), bool(token[2])
        if tag in INLINE:
            if tag == "a":
                depth = 0 if closing else 1
            continue
        flush()
        if tag in VOID:
            continue
        aside = False
        if closing:
            if opened[tag]:
                while stack:
                    opened[stack[-1][0]] -= 1
                    if stack.pop()[0] == tag:
                        break
            depth = 0
            continue
        other, named, main = stack[-1][1:] if stack else (False, None, None)
        found = _other_part(tag, token[4] or "", main is not None)
        if isinstance(found, Part):
            found.outer, found.inside = named, main is not None
            found.reply |= named is not None and named.reply
            named_parts.append(found)
        if tag == "p":  # paragraphs are often left open, so they are no part of the stack
            aside = found
        else:
            part = found if isinstance(found, Part) else named
            stack.append((tag, other or found is True, part, main or (Part() if tag in MAIN else None)))
            opened[tag] += 1
    text(_without_comment(html, at))
    flush()
    total = 0
    for block, (named, main) in zip(out, within):
        if not block.other and not (named and named.reply):
            total += block.words
            for part in (named, main):
                if part:
                    part.words += block.words
    for part in reversed(named_parts):
        if part.outer:
            part.outer.words += part.words
    for part in named_parts:
        other = not (part.layout and 2 * part.words > total)
        part.other = other or part.outer is not None and part.outer.other
        part.other_main = other and (part.inside or part.reply) or part.outer is not None and part.outer.other_main
    for block, (named, main) in zip(out, within):
        if named:
            block.other |= named.other_main if main and 2 * main.words > total else named.other
    return out


FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "tag")

# The labelled pages: words and link density of the blocks of a page in their order, and whether a block is article text
# (1) or not (0); 3 and -1 are the same where only tags tell it. 2 is a list of links within the article's mark: not article text.
LABELLED = (
    # menu, advert, title, paragraphs, legal line
    ((1, 1.0, 0), (1, 1.0, 0), (1, 1.0, 0), (8, 0.0, 0), (7, 0.0, 1), (40, 0.0, 1), (3, 0.0, 1), (25, 0.0, 1), (120, 0.1, 1), (9, 0.0, 1), (60, 0.0, 1), (12, 0.0, 0)),
    # menu, title that is a link, links within, other articles
    ((2, 1.0, 0), (1, 1.0, 0), (3, 1.0, 0), (6, 1.0, 1), (55, 0.0, 1), (30, 0.3, 1), (2, 1.0, 1), (80, 0.0, 1), (14, 0.0, 1), (3, 1.0, 0), (5, 1.0, 0), (4, 1.0, 0), (9, 0.0, 0)),
    # title right after the menu, a paragraph of links, readers' words
    ((1, 1.0, 0), (1, 1.0, 0), (5, 0.0, 1), (90, 0.0, 1), (12, 0.9, 1), (35, 0.0, 1), (200, 0.0, 1), (2, 0.0, 1), (2, 0.0, -1), (25, 0.0, -1), (60, 0.0, -1), (1, 1.0, 0), (1, 1.0, 0)),
    # a short article
    ((9, 0.0, -1), (1, 1.0, 0), (15, 0.0, 0), (4, 0.0, 1), (8, 0.0, 1), (6, 0.35, 1), (5, 0.0, 1), (1, 0.0, 1), (10, 0.0, 0)),
    # text and nothing else
    ((300, 0.0, 1),),
    ((60, 0.0, 1), (50, 0.0, 1), (45, 0.0, 1)),
    # notice, advert between paragraphs, promotion
    ((30, 0.0, -1), (1, 1.0, 0), (2, 1.0, 0), (7, 0.0, 1), (70, 0.0, 1), (12, 0.0, -1), (45, 0.0, 1), (50, 0.0, -1), (1, 1.0, 0), (6, 1.0, 1), (150, 0.0, 1), (20, 0.0, 1), (16, 0.0, 0)),
    # an overview of links
    ((1, 1.0, 0), (1, 1.0, 0), (10, 0.5, 0), (6, 0.8, 0), (30, 0.7, 0), (50, 0.9, 0), (4, 0.5, 0), (2, 0.0, 0)),
    # lists and cells of a table
    ((1, 1.0, 0), (14, 0.0, 0), (6, 0.0, 1), (22, 0.0, 1), (3, 0.0, 1), (4, 0.0, 1), (2, 0.0, 1), (5, 0.0, 1), (1, 0.0, 1), (2, 0.0, 1), (40, 0.4, 1), (11, 0.0, 0), (1, 1.0, 0)),
    # nothing after the text
    ((3, 1.0, 0), (8, 0.0, 1), (55, 0.0, 1), (35, 0.25, 1), (65, 0.0, 1)),
    # slogan, menu, form
    ((4, 0.0, -1), (1, 1.0, 0), (1, 1.0, 0), (2, 0.0, -1), (1, 0.0, -1), (9, 0.0, 1), (75, 0.0, 1), (28, 0.2, 1), (110, 0.0, 1), (3, 0.0, -1), (2, 0.0, -1), (15, 0.0, 0)),
    # paragraphs of one word
    ((1, 1.0, 0), (31, 0.0, 1), (1, 0.0, 1), (31, 0.0, 1), (1, 0.0, 1), (90, 0.0, 1), (1, 0.0, 1), (12, 0.0, 1), (9, 0.0, 1), (1, 0.0, 1), (200, 0.0, 1), (14, 0.0, 0)),
    # little text
    ((1, 1.0, 0), (2, 0.0, 3), (5, 0.0, 3), (6, 0.35, 3), (1, 0.0, 3)),
    ((1, 1.0, 0), (2, 1.0, 3), (4, 0.0, 3), (7, 0.3, 3), (2, 0.0, 3)),
    ((3, 1.0, 0), (3, 1.0, 3), (8, 0.0, 3), (20, 0.3, 3), (3, 0.0, 3)),
    ((10, 0.0, 3),),
    ((1, 0.0, 3),),
    # contents at the article's beginning, links at its end
    ((1, 1.0, 0), (7, 0.0, 1), (2, 1.0, 2), (3, 1.0, 2), (2, 1.0, 2), (4, 1.0, 2), (48, 0.0, 1), (33, 0.0, 1), (5, 0.0, 1), (4, 1.0, 2), (6, 1.0, 2), (9, 0.9, 2), (8, 0.0, 0)),
    ((2, 1.0, 0), (10, 1.0, 1), (95, 0.0, 1), (18, 0.0, 1), (1, 1.0, 2), (3, 1.0, 2), (2, 1.0, 2), (13, 0.0, 0)),
)


def labelled_rows() -> list[tuple]:
    """The features and label of each block of the labelled pages, once as on a page whose tags mark the article and once
    as on a page without such tags."""
    rows = []
    for page in LABELLED:
        shape = [(0, 0.0), *((words, density) for words, density, _ in page), (0, 0.0)]
        for i, (_, _, label) in enumerate(page):
            sizes = (*shape[i + 1], *shape[i], *shape[i + 2])
            rows.append((*sizes, 1 if label > 0 else -1, label % 2 if label > 0 else 0))
            if label in (0, 1):
                rows.append((*sizes, 0, label))
    return rows


def _gini(y: np.ndarray) -> float:
    p = y.mean() if len(y) else 0.0
    return 2 * p * (1 - p) * len(y)


def grow(x: np.ndarray, y: np.ndarray, depth: int):
    """A classification tree: (feature, cut, low side, high side) or the majority."""
    leaf = bool(2 * y.sum() >= len(y))
    if depth == 0 or y.min() == y.max():
        return leaf
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= cut
            cost = _gini(y[low]) + _gini(y[~low])
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, float(cut), low)
    if best is None or best[0] >= _gini(y) - 1e-12:
        return leaf
    _, f, cut, low = best
    return (f, cut, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


@lru_cache
def tree(depth: int = 8, tags: bool = True):
    """The tree of the labelled pages; without ``tags`` sizes and densities alone, from the pages whose tags tell nothing."""
    table = np.array(labelled_rows(), float)
    if not tags:
        table = table[table[:, -2] == 0]
    return grow(table[:, :-1], table[:, -1], depth)


def _judge(node, row: tuple) -> bool:
    while not isinstance(node, bool):
        f, cut, low, high = node
        node = low if row[f] <= cut else high
    return node


def features(found: list[Block]) -> list[tuple]:
    """A row of ``FEATURES`` for each block. ``tag`` is 1 within article or main, -1 in a part that is not the article,
    and outside of article and main if they have most of the other words; else 0."""
    plain = sum(b.words for b in found if not b.other)
    marked = 2 * sum(b.words for b in found if b.main and not b.other) > plain
    shape = [(0, 0.0), *((b.words, b.linked / b.words) for b in found), (0, 0.0)]
    tags = (-1 if b.other else 1 if b.main else -int(marked) for b in found)
    return [(*shape[i + 1], *shape[i], *shape[i + 2], tag) for i, tag in enumerate(tags)]


def main_text(html: str, node) -> str:
    """The blocks that the tree takes for the article, joined by an empty line."""
    found = blocks(html)
    return "\n\n".join(b.text for b, row in zip(found, features(found)) if _judge(node, row))


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with ``text``, the main text of each page, instead of ``html``; other columns stay.

    Null and empty pages have an empty text. Each row is a page by itself: one pass, no shuffle. A
    column of the same name as ``text`` is replaced.
    """
    node = tree()
    rest = [c for c in pages.columns if c not in (html, text)]
    names = [f"c{i}" for i in range(len(rest))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(h.as_py() or "", node) for h in batch.columns[-1]], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=[*names, "t"])

    flat = pages.select(*rest, html).toDF(*names, "h")
    schema = "".join(f"{n} {pages.schema[c].dataType.simpleString()}, " for n, c in zip(names, rest))
    return flat.mapInArrow(run, f"{schema}t string").toDF(*rest, text)
