"""Main text of HTML pages by the distribution of text over line blocks.

Markup is stripped into lines, one per block element, in page order. A line counts its characters outside links; lines in
menus, headers, footers, side bars, notices, adverts, forms, comments and other page parts that aren't the article count
none and have no text. The lengths are summed over sliding windows of ``WINDOW`` lines: a stretch begins where the sum
surges from nothing and ends where it dives back. Stretches are judged by their own share of link text; from the first
surge to the last dive of those that are mostly text outside links, everything is kept. If the page marks an article (or
a main part) and the stretches outside it hold no more text than it does, the text is what it marks, whole.

Defined cases: NULL, empty or text-free html gives an empty text; unclosed or stray tags are closed with the element
around them; an unclosed page part ends with its parent. Rows are handled one by one; columns besides id, url and html are
not read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
#: A stretch with a larger share of its characters in links is no end of the text.
LINK_SHARE = 0.5

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
# Elements without article text, and the words of class and id names, or roles, that mark such page parts.
NO_TEXT = frozenset(
    "aside audio button canvas datalist dialog fieldset footer form head header iframe input label menu nav noscript object "
    "option script select style svg template textarea title video".split()
)
PART_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay "
    "pager pagination popup promo promotion recommended related replies reply respond share sharing sidebar signup social "
    "sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
PART_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
ARTICLE_WORDS = frozenset("article content entry main post story".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"}}

_WORDS = re.compile(r"[a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _is_part(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    """Whether an element is a page part that isn't the article."""
    if tag in NO_TEXT:
        return True
    if tag in ("html", "body", "article", "main") or not attrs:
        return False
    names = dict(attrs)
    if "hidden" in names or names.get("aria-hidden") == "true" or _HIDDEN.search((names.get("style") or "").lower()):
        return True
    if (names.get("role") or "").lower() in PART_ROLES:
        return True
    for key in ("class", "id"):
        for name in (names.get(key) or "").lower().split():
            words = set(_WORDS.findall(name))
            if words & PART_WORDS and not words & ARTICLE_WORDS:
                return True
    return False


class _Lines(HTMLParser):
    """Collects lines as (text, characters outside links, inside an article)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, bool]] = []
        self._open: list[tuple[str, bool]] = []
        self._parts = self._articles = self._links = 0
        self._text: list[str] = []
        self._plain = 0

    def _end_line(self) -> None:
        text = " ".join("".join(self._text).split())
        self.lines.append((text, self._plain if text else 0, self._articles > 0))
        self._text.clear()
        self._plain = 0

    def _shut(self, depth: int) -> None:
        """Closes the open elements from ``depth`` on."""
        if any(tag in BLOCKS or part for tag, part in self._open[depth:]):
            self._end_line()
        for tag, part in self._open[depth:]:
            self._parts -= part
            self._articles -= tag in ("article", "main")
            self._links -= tag == "a"
        del self._open[depth:]

    def _last(self, tags: set[str], bounds: frozenset[str]) -> int | None:
        for depth in range(len(self._open) - 1, -1, -1):
            if self._open[depth][0] in tags:
                return depth
            if self._open[depth][0] in bounds:
                return None
        return None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            if tag in ("br", "hr"):
                self._text.append(" ")
            return
        if tag in BLOCKS:
            if (depth := self._last({"p"}, BLOCKS - {"p"})) is not None:
                self._shut(depth)
            if tag in CLOSED_BY and (depth := self._last(CLOSED_BY[tag], frozenset({"ul", "ol", "dl", "table"}))) is not None:
                self._shut(depth)
            self._end_line()
        elif tag in ("td", "th"):
            self._text.append(" ")
        part = _is_part(tag, attrs)
        if part and tag not in BLOCKS:
            self._end_line()
        self._open.append((tag, part))
        self._parts += part
        self._articles += tag in ("article", "main")
        self._links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:
            super().handle_startendtag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self._text.append(" ")
        for depth in range(len(self._open) - 1, -1, -1):
            if self._open[depth][0] == tag:
                self._shut(depth)
                return

    def handle_data(self, data: str) -> None:
        if not self._parts:
            self._text.append(data)
            if not self._links:
                self._plain += len(data.strip())

    def finish(self) -> list[tuple[str, int, bool]]:
        self.close()
        self._shut(0)
        self._end_line()
        return self.lines


def stretches(plain: np.ndarray, full: np.ndarray) -> list[tuple[int, int, int]]:
    """Surge, dive and characters outside links of each stretch where the window sums are above nothing and links don't
    prevail; bounds fit its first and last text. If links prevail in all of them, all are taken."""
    sums = np.convolve(plain, np.ones(WINDOW, np.int64))[: len(plain)]  # of a line and those before it
    above = np.concatenate([[False], sums > 0, [False]])
    edges = np.flatnonzero(above[1:] != above[:-1])
    found, texts = [], []
    for surge, dive in zip(edges[0::2], edges[1::2]):
        dive = surge + int(np.flatnonzero(plain[surge:dive])[-1]) + 1
        size = int(plain[surge:dive].sum())
        found.append((int(surge), int(dive), size))
        if size >= (1 - LINK_SHARE) * full[surge:dive].sum():
            texts.append(found[-1])
    return texts or found


def main_text(html: str | None) -> str:
    parser = _Lines()
    parser.feed(html or "")
    lines = parser.finish()
    # Lines without text of their own stand for the markup between lines; runs of them count as one.
    lines = [line for i, line in enumerate(lines) if line[0] or i == 0 or lines[i - 1][0]]
    full = np.array([len(text) for text, _, _ in lines], np.int64)
    plain = np.array([n for _, n, _ in lines], np.int64)
    inside = np.array([marked for _, _, marked in lines], bool)
    if full[inside].sum():  # links inside the article are its text
        outside = stretches(np.where(inside, 0, plain), np.where(inside, 0, full))
        if sum(size for *_, size in outside) <= full[inside].sum():
            return "\n".join(text for text, _, marked in lines if text and marked)
    spans = stretches(plain, full)
    return "\n".join(text for text, _, _ in lines[spans[0][0] : spans[-1][1]] if text) if spans else ""


def extract(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
