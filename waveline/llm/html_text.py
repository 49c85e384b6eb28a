"""Main text of web pages from streaming parser events.

The standard library's parser feeds blocks ("lines"); each has its text, the tags seen
with it and how much of it is links. The text-to-tag ratios are smoothed with a Gaussian
and split by a threshold (two-means clustering). The content region is chosen by the
text of the content cluster over the tree of containers: the container with the most of
it, less ``OUTSIDE`` of the text that isn't in the cluster. Articles, and next main, are
a prior only: they are the region if they hold ``PRIOR`` of the cluster's text.

All blocks of the region are kept, short ones too, except
- those in elements that are boilerplate by their kind, or whose class, id or role has a
  word that stands for nothing else (``MARKS``);
- elements whose class has a word that may mean boilerplate (``HINTS``), if they hold no
  text of the cluster or are links to ``LINKS`` of their text;
- where the region is no article or main: containers without text of the cluster that
  lie before its first line or after its last, or are links to ``LINKS`` of their text.

Defined results: null or empty html, and pages without content, give the empty string;
markup may be broken (unclosed or stray tags, odd declarations; a tag that never ends is
left out, a comment that never ends hides what follows); repeated rows are separate
rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
SKIP = frozenset("head script style noscript template nav footer aside form svg iframe button select textarea dialog menu canvas object audio video map math datalist title".split())
#: Parts of class, id and role values that mark boilerplate.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|promo\w*|sponsor\w*|cookies?|consent|gdpr|notices?|notification|popup|modal|overlay|nav|navbar|navigation|menu|breadcrumbs?|sidebar|widget|masthead|comments?|commentlist|disqus|sharing|social|newsletter|subscribe|subscription|login|signup|pagination|pager|toolbar|complementary|contentinfo)(?:$|[\s_-])",
    re.I,
)
#: Parts that may mark it.
HINTS = re.compile(r"(?:^|[\s_-])(?:alert|footer|header|recommended|related|replies|respond|search|share|side|skip)(?:$|[\s_-])", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Containers by rank; those of rank 0 can't be the region. A header inside an article is content.
RANKS = {"article": 3, "main": 2, "section": 1, "div": 1, "td": 1, "body": 1, "ul": 0, "ol": 0, "dl": 0, "table": 0}
SIGMA = 1.0
#: Share of the content cluster's text that articles (or main) hold to be the region.
PRIOR = 2 / 3
#: Weight of text outside the cluster against a container.
OUTSIDE = 0.25
#: Share of links in a text that makes it a menu.
LINKS = 0.5
SCHEMA = "page_id long, url string, text string, n_chars long"


class _Line(NamedTuple):
    text: str
    tags: int
    container: int
    links: int  # characters of links


class _Container(NamedTuple):
    parent: int  # an earlier one; the first is the page
    rank: int
    hint: bool


class _Open(NamedTuple):
    tag: str
    skip: bool
    container: int
    rank: int
    link: bool


_PAGE = _Open("", False, 0, 0, False)


class _Blocks(HTMLParser):
    """Collects the lines and the tree of containers."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[_Open] = []
        self.lines: list[_Line] = []
        self.parts: list[str] = []
        self.tags = self.links = 0
        self.containers = [_Container(0, 0, False)]

    def read(self, html: str) -> None:
        self.feed(html)
        while self.rawdata.startswith("<"):  # something that doesn't end
            rest = self.rawdata
            self.rawdata = ""
            if rest.startswith("<!--") or self.cdata_elem or (end := rest.find(">")) < 0:
                break
            self.feed(rest[end + 1 :])
        self.close()
        self.flush()

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers aren't needed

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i, report)

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts.clear()
        if text:
            self.lines.append(_Line(text, self.tags, self.stack[-1].container if self.stack else 0, min(self.links, len(text))))
            self.tags = 0
        self.links = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in BLOCK or tag in SKIP:
            self.flush()
        if tag in VOID:
            return
        if tag in ("a", "p", "li", "dt", "dd", "option", "tr", "td", "th") and any(x.tag == tag for x in self.stack[-3:]):
            self.leave(tag, 3)
        above = self.stack[-1] if self.stack else _PAGE
        container, rank = above.container, above.rank
        skip, hint = above.skip or tag in SKIP or tag == "header" and rank < 3, False
        if not skip and tag not in ("html", "body", "main"):
            for name, value in attrs:
                if name in ("class", "id", "role", "aria-label"):
                    skip = skip or bool(MARKS.search(value or ""))
                    hint = hint or tag in BLOCK and bool(HINTS.search(value or ""))
                elif name == "style":
                    skip = skip or bool(HIDDEN.search(value or ""))
                elif name == "hidden" or name == "aria-hidden" and value == "true":
                    skip = True
        if tag in RANKS or hint:
            own = RANKS.get(tag, 0)
            self.containers.append(_Container(container, own, hint))
            container, rank = len(self.containers) - 1, max(rank, own)
        self.stack.append(_Open(tag, skip, container, rank, above.link or tag == "a"))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def leave(self, tag: str, within: int | None = None) -> None:
        at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i].tag == tag), -1)
        if at >= 0 and (within is None or at >= len(self.stack) - within):
            del self.stack[at:]

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK or tag in SKIP:
            self.flush()
        if tag == "p" and not any(x.tag == "p" for x in self.stack):
            return
        self.leave(tag)

    def handle_data(self, data: str) -> None:
        above = self.stack[-1] if self.stack else _PAGE
        if not above.skip:
            self.parts.append(data)
            if above.link:
                self.links += len(" ".join(data.split()))


def _content_lines(ratios: np.ndarray) -> np.ndarray:
    """Which lines belong to the cluster of higher smoothed text-to-tag ratios."""
    radius = int(3 * SIGMA)
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / SIGMA) ** 2)
    smooth = np.convolve(np.pad(ratios, radius, mode="edge"), kernel / kernel.sum(), mode="valid")
    low, high, total = float(smooth.min()), float(smooth.max()), float(smooth.sum())
    for _ in range(20):
        upper = smooth >= (low + high) / 2
        n = int(upper.sum())
        if n == len(smooth):
            break
        was, above = (low, high), float(smooth[upper].sum())
        low, high = (total - above) / (len(smooth) - n), above / n
        if (low, high) == was:
            break
    return smooth >= (low + high) / 2


def _kept(lines: list[_Line], core: np.ndarray, containers: list[_Container]) -> np.ndarray:
    """Which lines are in the content region and not boilerplate in it."""
    n = len(containers)
    mass, total, links, score = [0] * n, [0] * n, [0] * n, [0.0] * n
    first, last = [len(lines)] * n, [-1] * n
    for i, (line, inside) in enumerate(zip(lines, core, strict=True)):
        k, size = line.container, len(line.text)
        mass[k] += size if inside else 0
        score[k] += size if inside else -OUTSIDE * size
        total[k], links[k], first[k], last[k] = total[k] + size, links[k] + line.links, min(first[k], i), max(last[k], i)
    for k in range(n - 1, 0, -1):  # parents come before their children
        up = containers[k].parent
        for held in (mass, total, links, score):
            held[up] += held[k]
        first[up], last[up] = min(first[up], first[k]), max(last[up], last[k])
    menu = [links[k] >= LINKS * total[k] for k in range(n)]
    roots: set[int] = set()
    for rank in (3, 2):
        inner = [False] * n
        outermost = []
        for k in range(1, n):
            inner[k] = inner[containers[k].parent] or containers[k].rank == rank
            if containers[k].rank == rank and not inner[containers[k].parent] and mass[k]:
                outermost.append(k)
        if outermost and sum(mass[k] for k in outermost) >= PRIOR * mass[0]:
            roots = set(outermost)
            break
    named = bool(roots)
    if not named:
        roots = {max((k for k in range(n) if k == 0 or containers[k].rank), key=lambda k: score[k])}  # of equal ones the outermost
    content = np.flatnonzero(core)
    keep = [False] * n
    for k in range(n):
        keep[k] = k in roots or k > 0 and keep[containers[k].parent]
        if keep[k] and k not in roots:
            if containers[k].hint and (not mass[k] or menu[k]):
                keep[k] = False
            elif not named and not mass[k] and (menu[k] or last[k] < content[0] or first[k] > content[-1]):
                keep[k] = False
    return np.array([keep[line.container] for line in lines])


def main_text(html: str | None) -> str:
    """The text of the page's content region as blocks joined by one space."""
    if not html:
        return ""
    parser = _Blocks()
    parser.read(html)
    lines = parser.lines
    if not lines:
        return ""
    core = _content_lines(np.array([len(line.text) / max(line.tags, 1) for line in lines]))
    return " ".join(line.text for line, keep in zip(lines, _kept(lines, core, parser.containers), strict=True) if keep)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    prepare(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(_rows, SCHEMA)
