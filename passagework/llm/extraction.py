"""Main text of web pages from streaming parser events, text-to-tag ratios and threshold clustering.

The standard library's parser feeds a page's events to a small collector that closes a line at every block element. Each line
keeps its text, its number of tags and the container it stands in; what belongs to menus, headers, footers, sidebars, notices,
adverts, forms and reader comments is marked as such by element, role, class or id. The ratio of text to tags, smoothed by a
Gaussian over neighbouring lines, is split into two clusters by a threshold of at most half the usual ratio. On every page the
clusters choose the regions: those whose text lies mostly in the upper cluster, where an article or main element needs the
smaller share ``1 / (2 * PRIOR)`` and goes before unnamed containers. All unmarked lines of the regions are the text.

Marks match whole names (``sidebar``, ``site-header``, ``ad-2``), not parts of others (``no-sidebar``, ``related-work``). An
element whose end tag is missing marks nothing, and a mark outside an article or main does not reach into it unless it
marks reader comments or hidden parts. Parsing takes time in proportion to the page's length, whatever its tags.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_UNREAD = frozenset("script style noscript template iframe object svg canvas math head title textarea select option datalist audio video".split())
_BOILER = frozenset("nav header footer aside form menu dialog button fieldset".split())
_BLOCK = frozenset(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header"
    " hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul aside dialog search hgroup".split()
)
_CONTAINER = frozenset("article main body section div td aside".split())
_NAMED = frozenset(("article", "main"))
#: An inline end tag closes nothing outside the innermost of these.
_BARRIER = frozenset("article main nav aside footer header form table section div".split())
_CLOSES_ITSELF = frozenset("p li tr td th dt dd option".split())
_NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", re.ASCII)
#: An unfinished tag at a page's end.
_UNFINISHED = re.compile(r"<[a-zA-Z/!?][^>]*\Z")
#: Words of class or id names that mark boilerplate, and reader comments (with hidden parts the only marks that reach into articles).
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb"
    " breadcrumbs header masthead footer sidebar aside cookie cookies consent notice notices alert gdpr share sharing social related"
    " recommended newsletter subscribe signup popup modal overlay pager pagination search login widget toolbar teaser teasers".split()
)
_COMMENT_MARKS = frozenset("comment comments disqus reply replies respond".split())
#: Words that may stand beside a mark in one name.
_BESIDE = frozenset(
    "site page main top bottom left right primary secondary global user reader box bar list links link posts post items item block area"
    " slot unit button buttons icons form inner wrapper container panel section thread message policy articles stories".split()
)
_MARK_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
SIGMA = 1.0
#: How much less of its text a named article or main needs in the upper cluster.
PRIOR = 8.0

_PLAIN, _MARK, _COMMENT, _RESET = range(4)


def _kind(tag: str, attrs: list[tuple[str, str | None]]) -> int:
    """What an element says of its text: nothing, that it is boilerplate, or that readers wrote it or nobody sees it."""
    kind = _MARK if tag in _BOILER else _PLAIN
    if tag in ("html", "body", "main", "h1"):
        return kind
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return _COMMENT
        if name == "role" and value and not _MARK_ROLES.isdisjoint(value.lower().split()):
            kind = _MARK
        elif name in ("class", "id") and value:
            for token in value.split():
                parts = {p.lower() for p in _NAME_PARTS.findall(token)}
                rest = {p for p in parts - _MARKS - _COMMENT_MARKS - _BESIDE if not p.isdigit()}
                if not rest and parts & _COMMENT_MARKS:
                    return _COMMENT
                if not rest and parts & _MARKS:
                    kind = _MARK
    return kind


class Lines(HTMLParser):
    """Collects [text, tags, container, mark] for each block of a page; containers and marks are numbered from 1."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[list] = []
        self.open: list[tuple[str, bool, int, int, int]] = []  # tag, unread, innermost mark, container, own mark
        self.places: dict[str, list[int]] = {}  # where in ``open`` the elements of a name are
        self.barriers: list[int] = []
        self.parts: list[str] = []
        self.tags = 0
        self.marks: list[list[int]] = [[0, _PLAIN]]  # outer mark, kind
        self.containers: list[tuple[int, bool, int]] = [(0, False, 0)]  # outer container, named, mark it stands in

    def parse_marked_section(self, i, report=1):  # such a section is a comment in HTML
        return self.parse_bogus_comment(i)

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        _, _, mark, container, _ = self.open[-1] if self.open else ("", False, 0, 0, 0)
        if text:
            self.lines.append([text, self.tags, container, mark])
            self.tags = 0
        self.parts = []

    def pop(self, closed: bool) -> None:
        tag, _, _, _, own = self.open.pop()
        self.places[tag].pop()
        if tag in _BARRIER:
            self.barriers.pop()
        if own and not closed and self.marks[own][1] == _MARK:
            self.marks[own][1] = _PLAIN  # where it should have ended is unknown

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCK:
            self.flush()
        elif tag == "br":
            self.parts.append(" ")
        self.tags += 1
        if tag in _VOID:
            return
        if tag in _CLOSES_ITSELF and self.open and self.open[-1][0] == tag:
            self.pop(True)
        _, unread, mark, container, _ = self.open[-1] if self.open else ("", False, 0, 0, 0)
        kind, own = _kind(tag, attrs), 0
        named = tag in _NAMED or ("role", "main") in attrs
        if named or tag in _CONTAINER and not self.containers[container][1]:
            self.containers.append((container, named, mark))
            container = len(self.containers) - 1
        for one in ([_RESET] if named else []) + ([kind] if kind else []):
            self.marks.append([mark, one])
            mark = own = len(self.marks) - 1
        if tag in _BARRIER:
            self.barriers.append(len(self.open))
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, unread or tag in _UNREAD, mark, container, own if kind else 0))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash closes void elements only

    def handle_endtag(self, tag):
        if tag in _BLOCK:
            self.flush()
        self.tags += 1
        places = self.places.get(tag)
        if not places or tag not in _BLOCK and self.barriers and self.barriers[-1] > places[-1]:
            return
        at = places[-1]
        while len(self.open) > at + 1:
            self.pop(False)
        self.pop(True)

    def handle_data(self, data):
        if not (self.open and self.open[-1][1]):
            self.parts.append(data)


def page_lines(html: str | None) -> tuple[list[list], list[tuple[int, bool, bool]]]:
    """Lines as [text, tags, container, marked], and containers as (outer container, named, stands in a mark).

    A tag that is unfinished at the page's end is no text.
    """
    parser, html = Lines(), html or ""
    last = html.rfind(">") + 1
    parser.feed(html[:last] + _UNFINISHED.sub("", html[last:]))
    parser.close()
    parser.flush()
    while parser.open:
        parser.pop(False)
    marked, beyond = [False], [False]  # by mark: its text is boilerplate; even inside an article
    for outer, kind in parser.marks[1:]:
        beyond.append(beyond[outer] or kind == _COMMENT)
        marked.append(beyond[-1] or kind == _MARK or kind != _RESET and marked[outer])
    lines = [[text, tags, container, marked[mark]] for text, tags, container, mark in parser.lines]
    return lines, [(outer, named, marked[mark]) for outer, named, mark in parser.containers]


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines; the window is renormalised at both ends."""
    reach = int(np.ceil(3 * sigma))
    window = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = np.convolve(np.pad(values, reach), window, "valid")
    return full / np.convolve(np.pad(np.ones(len(values)), reach), window, "valid")


def threshold(values: np.ndarray) -> float:
    """The border of two clusters: half-way between their means, iterated until it rests."""
    border = float(values.mean())
    for _ in range(50):
        low, high = values[values < border], values[values >= border]
        new = (low.mean() + high.mean()) / 2 if len(low) and len(high) else border
        if abs(new - border) < 1e-9:
            break
        border = float(new)
    return border


def usual(ratios: np.ndarray, sizes: np.ndarray) -> float:
    """Median ratio by text size, where no line weighs more than a tenth of all, so one long block does not decide."""
    weights = sizes.copy()
    for _ in range(50):
        most = max(weights.sum() / 10, weights.min())
        if weights.max() <= most * (1 + 1e-9):
            break
        weights = np.minimum(weights, most)
    order = np.argsort(ratios, kind="stable")
    return float(ratios[order][np.searchsorted(np.cumsum(weights[order]), weights.sum() / 2)])


def upper_cluster(lines: list[list]) -> np.ndarray:
    """Per line whether it is unmarked and its smoothed ratio of text to tags lies in the upper of the page's two clusters."""
    sizes = np.array([float(len(text)) for text, _, _, _ in lines])
    marked = np.array([m for _, _, _, m in lines])
    if marked.all():
        return np.zeros(len(lines), bool)
    raw = np.where(marked, 0.0, sizes / np.maximum(1, [tags for _, tags, _, _ in lines]))
    ratios = smooth(raw)
    return (ratios >= min(threshold(ratios), usual(raw[~marked], sizes[~marked]) / 2)) & ~marked


def content_regions(lines: list[list], containers: list[tuple[int, bool, bool]]) -> set[int]:
    """Containers whose unmarked lines are the page's text.

    An article or main counts with all that stands in it, an unnamed container by its own lines. Articles inside boilerplate hold only
    if one of them has more text than all unmarked containers, ``PRIOR`` times as much where an article is among those. Where no container is dense enough, all of the kind that goes first hold.
    """
    upper = upper_cluster(lines)
    total, dense = np.zeros(len(containers)), np.zeros(len(containers))
    for is_upper, (text, _, container, is_marked) in zip(upper, lines):
        if not is_marked:
            total[container] += len(text)
            dense[container] += len(text) * is_upper
    own, own_dense = total.copy(), dense.copy()
    for c in range(len(containers) - 1, 0, -1):  # outer containers have smaller numbers
        outer, named, _ = containers[c]
        if named and containers[outer][1]:
            total[outer] += total[c]
            dense[outer] += dense[c]
    held = [c for c in range(len(containers)) if own[c] > 0]
    named = [c for c in held if containers[c][1]]
    free = [c for c in named if not containers[c][2]]
    rest = [c for c in held if not containers[c][1]]
    inside = [c for c in named if containers[c][2]]
    most = max((own[c] for c in inside), default=0.0)
    if free and PRIOR * own[free].sum() >= most or not free and most <= own[rest].sum():
        named = free
    elif inside:
        named = inside
    if named:
        return {c for c in named if dense[c] > 0 and 2 * PRIOR * dense[c] >= total[c]} or set(named)
    return {c for c in rest if 2 * own_dense[c] >= own[c]} or set(rest)


def main_text(html: str | None) -> str:
    """Blocks of the content regions, white space inside each turned into one space, joined by newlines; null gives ''."""
    lines, containers = page_lines(html)
    if not lines:
        return ""
    regions = content_regions(lines, containers)
    return "\n".join(text for text, _, container, is_marked in lines if container in regions and not is_marked)


def extract(pages: DataFrame, html: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with the main text as column ``name``; never null, empty where a page has none."""

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(h) for h in batch], dtype=object)

    return pages.withColumn(name, texts(html))


def extracted_pages(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` (repeated rows too): page_id, url, text, n_chars (code points)."""
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
