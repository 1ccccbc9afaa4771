"""Main-content extraction from HTML by tree scoring.

Every paragraph of ``LEAST`` characters or more earns one point, one for each comma, and one for
each 100 characters up to three. The points go in full to its parent, by half to its grandparent,
and by 1/(3 k) to the k-th ancestor beyond, up to ``LEVELS``. A container's score is
discounted by its link density, the share of its text that lies in links. The container with
the highest score is kept, with those of its siblings that score well or read like paragraphs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

LEAST = 25
LEVELS = 5
SIBLING = 0.2

_TAG = re.compile(r"""<!--|<(/?)([a-zA-Z][^\s<>/]*)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+|[^<>]*+)>|<[!?][^<>]*+>""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea".split())  # what follows is no markup up to their end tag, or at all
_HIDDEN = frozenset("noscript template svg math iframe object select button".split())
_BLOCK = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split())
_PARAGRAPH = frozenset(("p", "pre", "td", "blockquote"))
_HOLDER = frozenset(("div", "section", "article", "main", "body", "center", "dd", "figcaption"))
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
_ENDS_P = _BLOCK - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "html", "head", "title"}
_SCOPE = frozenset(("table", "ul", "ol", "dl", "div", "article", "section", "body", "html"))


class Page:
    """A parsed page as parallel lists over elements in document order; 0 is the root."""

    def __init__(self, html: str) -> None:
        self.tag, self.parent, self.end, self.first, self.last = ["#root"], [0], [0], [0], [0]
        self.pieces: list[str] = []  # texts, and "\n" at block boundaries
        self.owner: list[int] = []
        self.hidden: list[int] = []  # the open elements whose text is left out
        self._parse(html)

    def _open(self, tag: str) -> int:
        node = len(self.tag)
        self.tag.append(tag)
        self.parent.append(self.stack[-1])
        self.first.append(len(self.pieces))
        self.last.append(0)
        self.end.append(0)
        return node

    def _text(self, text: str) -> None:
        if text and not self.hidden:
            self.pieces.append(text)
            self.owner.append(self.stack[-1])

    def _close(self) -> None:
        node = self.stack.pop()
        self.open[self.tag[node]] -= 1
        if self.hidden and self.hidden[-1] == node:
            self.hidden.pop()
        if self.tag[node] in _BLOCK:
            self._text("\n")
        self.end[node], self.last[node] = len(self.tag), len(self.pieces)

    def _until(self, tags: tuple[str, ...], barrier: frozenset[str]) -> None:
        """Close the nearest open element of ``tags``, unless a barrier lies between."""
        for i in range(len(self.stack) - 1, 0, -1):
            if self.tag[self.stack[i]] in tags:
                while len(self.stack) > i:
                    self._close()
                return
            if self.tag[self.stack[i]] in barrier:
                return

    def _parse(self, html: str) -> None:
        self.stack, self.open = [0], {"#root": 1}
        at, lower = 0, ""
        ends: dict[str, int] = {}  # where the last end tag of a kind begins
        while m := _TAG.search(html, at):
            if m.start() > at:
                self._text(unescape(html[at : m.start()]))
            at = m.end()
            if m[0] == "<!--":
                stop = html.find("-->", at)
                at = len(html) if stop < 0 else stop + 3
                continue
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                if self.open.get(tag):
                    while self.tag[self.stack[-1]] != tag:
                        self._close()
                    self._close()
                continue
            if (tag in _RAW or tag in _HIDDEN) and not m[3].endswith("/"):
                lower = lower or html.lower()
                lower = lower if len(lower) == len(html) else "".join(c.lower() if c < "\x80" else c for c in html)
                if tag not in ends:
                    ends[tag] = lower.rfind("</" + tag)
                if tag in _RAW:
                    stop = lower.find("</" + tag, at) if ends[tag] >= at else -1
                    stop = len(html) if stop < 0 else html.find(">", stop)
                    at = len(html) if stop < 0 else min(len(html), stop + 1)
                    continue
                if tag in ("button", "select") and self.open.get(tag):
                    self._until((tag,), _SCOPE)
            if tag in _ENDS_P and self.open.get("p"):
                self._until(("p",), frozenset(("table", "td", "th", "button")))
            for old in _CLOSES.get(tag, ()):
                if self.open.get(old):
                    self._until((old,), _SCOPE)
            if tag in _BLOCK:
                self._text("\n")
            if tag in _VOID:
                continue
            self.stack.append(self._open(tag))
            self.open[tag] = self.open.get(tag, 0) + 1
            if ends.get(tag, -1) >= at and tag in _HIDDEN:
                if m[3].endswith("/"):
                    self._close()
                else:
                    self.hidden.append(self.stack[-1])
        self._text(unescape(html[at:]))
        while len(self.stack) > 1:
            self._close()
        self.end[0], self.last[0] = len(self.tag), len(self.pieces)

    def lines(self, node: int) -> list[str]:
        """The text of an element: blocks as lines, white space collapsed, blank lines left out."""
        joined = "".join(self.pieces[self.first[node] : self.last[node]])
        return [x for x in (" ".join(line.split()) for line in joined.split("\n")) if x]


def _measure(page: Page) -> tuple[list[int], list[int], list[int], list[int]]:
    """Of each element: characters, characters in links, commas, and characters outside blocks in it."""
    n = len(page.tag)
    size, linked, commas, own = [0] * n, [0] * n, [0] * n, [0] * n
    for owner, piece in zip(page.owner, page.pieces, strict=True):
        if piece == "\n":
            continue
        length = len(" ".join(piece.split()))
        size[owner] += length
        own[owner] += length
        commas[owner] += piece.count(",") + piece.count("，") + piece.count("、")
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        linked[p] += size[i] if page.tag[i] == "a" else linked[i]
        size[p] += size[i]
        commas[p] += commas[i]
        if page.tag[i] not in _BLOCK:
            own[p] += own[i]
    return size, linked, commas, own


def extract(html: str) -> tuple[str, str, float, int]:
    """(title, text, score, paragraphs that earned points) of a page.

    A page without any paragraph of ``LEAST`` characters has no content: empty text, score 0. Of
    containers with one score the first counts.
    """
    page = Page(html)
    title = next((x for i, t in enumerate(page.tag) if t == "title" and (x := " ".join(page.lines(i)))), "")
    size, linked, commas, own = _measure(page)
    points: dict[int, float] = {}
    earned = 0
    for i, tag in enumerate(page.tag):
        held = tag in _HOLDER
        if tag not in _PARAGRAPH and not held or size[i] < LEAST or held and own[i] < LEAST:
            continue
        earned += 1
        length = own[i] if held else size[i]
        gain = 1 + commas[i] * length / size[i] + min(3, length // 100)
        node = i
        for level in range(LEVELS):
            if node == 0:
                break
            node = page.parent[node]
            points[node] = points.get(node, 0.0) + gain / (1 if level == 0 else 2 if level == 1 else 3 * level)
    density = [linked[i] / size[i] if size[i] else 0.0 for i in range(len(size))]
    scores = {i: p * (1 - density[i]) for i, p in points.items()}
    if not scores:
        return title, "", 0.0, 0
    best = min(scores, key=lambda i: (-scores[i], i))
    kept = [best]
    if best:
        child, stop = page.parent[best] + 1, page.end[page.parent[best]]
        while child < stop:
            if child != best:
                text = size[child]
                good = scores.get(child, 0.0) >= max(10, SIBLING * scores[best])
                if page.tag[child] == "p" and not good:
                    good = text > 80 and density[child] < 0.25 or 0 < text <= 80 and density[child] == 0 and " ".join(page.lines(child)).endswith((".", "!", "?"))
                if good:
                    kept.append(child)
            child = page.end[child]
    lines = [x for node in sorted(kept) for x in page.lines(node)]
    return title, "\n".join(lines), round(scores[best], 6), earned


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(None, None, None, None) if h is None else extract(h) for h in batch.column("html").to_pylist()]
        title, text, score, count = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [], [])
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(title, pa.string()), pa.array(text, pa.string()), pa.array(score, pa.float64()), pa.array(count, pa.int32())],
            ["page_id", "url", "title", "text", "score", "paragraphs"],
        )


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, text, score, paragraphs) of each row of (page_id, url, html).

    Rows are handled one by one in a single pass without a shuffle. Defined cases: null html gives
    nulls; html without content gives an empty text and score 0; unclosed, stray and deeply nested
    tags are mended as browsers do in the main; the text of buttons, embedded objects and the like is
    left out up to their end tag or their parent's, and kept where no such end tag follows at all;
    what follows an unclosed script, style or textarea is no markup; repeated rows give repeated
    rows; an empty table gives an empty result; other columns play no part.
    """
    small_batches(pages.sparkSession, 500)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(_pages, "page_id long, url string, title string, text string, score double, paragraphs int")
