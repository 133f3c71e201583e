"""HTML extraction: the standard library's parser streams events, every block
becomes a line with its text-to-tag ratio, the ratios are smoothed with a
Gaussian, and lines over the threshold are clustered to find the page's region
of content. The region is the `article` or `main` that holds most of the cluster's text (with its sibling articles of a third of that
or more), or else the smallest container that holds four fifths of it.

Inside the region every block is kept but for two kinds. What HTML or a class, id or role names as a menu, sidebar, notice,
advert, form or comment goes whatever its ratio, as such text can be as dense as an article's. What a word only hints at
(`login-history`, `survey-results`) goes if its text-to-tag ratio is far below the cluster's or it has form controls. In a region that only
the ratios found, runs of lines that are links and nothing else go, too.

Cases: null or empty html, or html without text, gives an empty text; unclosed
and stray tags are tolerated at any depth, and end tags that HTML lets a page omit
are supplied; pages of any length are read whole; of containers with equally much text the later, inner one is the region; repeated rows
each give a row; extra columns, whatever their names, are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: HTML's void elements, its block elements, and what is never main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
NEVER = frozenset("head script style noscript template svg iframe object canvas audio video nav aside footer form button select textarea menu dialog input label".split())
CONTAINERS = frozenset("article main section div body td blockquote".split())
#: Words of a class, id or role that mark what isn't the article; and words that only hint at it.
ASIDE_WORDS = frozenset("ad adbox adsbygoogle adslot ads adv advert advertisement advertising advertorial alert banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookiebar cookies copyright disclaimer disqus footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notification pagination pager paywall popup promo promoted promotion recommended related replies reply respond share sharebar sharing sidebar signup social sponsor sponsored sponsors subscribe toolbar widget widgets".split())
HINT_WORDS = frozenset("dialog form login overlay poll search signin subscription survey toc".split())
CONTROLS = frozenset("button form input select textarea".split())
#: A hinted element's ratio that is enough: this share of the cluster's, and so many characters a tag. Lines of a run of links.
HINT_SHARE, HINT_LEAST, LINK_RUN = 0.25, 20, 3
#: What a start tag closes if its end tag was omitted, but not beyond an open element of the second set.
SCOPE = frozenset("table td th caption article section aside nav main header footer blockquote fieldset form details dialog figure button select object template".split())
CLOSES: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset(["li"]), SCOPE | {"ul", "ol", "menu"}),
    "option": (frozenset(["option"]), frozenset(["select", "datalist", "optgroup"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "tr": (frozenset(["tr", "caption"]), frozenset(["table"])),
} | {t: (frozenset(["dt", "dd"]), SCOPE | {"dl"}) for t in ("dt", "dd")}
CLOSES |= {t: (frozenset(["td", "th"]), frozenset(["tr", "table"])) for t in ("td", "th")}
CLOSES |= {t: (frozenset(["thead", "tbody", "tfoot", "tr", "caption"]), frozenset(["table"])) for t in ("thead", "tbody", "tfoot")}
SPLIT = re.compile(r"[^a-z0-9]+")
SCHEMA = "page_id long, url string, text string, n_chars long"


class Line(NamedTuple):
    text: str
    tags: int
    path: tuple[int, ...]
    title: bool
    hints: tuple[int, ...]
    links: int


class Lines(HTMLParser):
    """Collects the blocks outside what is never main text, with the containers and the hinted elements around each."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.kinds: dict[int, str] = {}
        self.parent: dict[int, int] = {}
        # tag, hidden, container's number or 0, hinted element's number or 0
        self.open: list[tuple[str, bool, int, int]] = []
        self.places: defaultdict[str, list[int]] = defaultdict(list)  # of each tag, its places in open
        self.hidden = self.number = self.tags = self.links = 0
        self.path: tuple[int, ...] = ()
        self.hints: tuple[int, ...] = ()
        self.controls: set[int] = set()
        self.parts: list[str] = []

    def end_line(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts.clear()
            if text:
                self.lines.append(Line(text, self.tags, self.path, any(o[0] == "h1" for o in self.open[-3:]), self.hints, self.links))
                self.tags = 0
            self.links = 0

    def inside_article(self) -> bool:
        return bool(self.places["article"] or self.places["main"])

    def aside(self, tag: str, attrs: list[tuple[str, str | None]]) -> tuple[bool, bool]:
        """Whether the element isn't main text, and whether a word hints that it may not be."""
        if tag in NEVER or tag == "header" and not self.inside_article():
            return True, False
        # the classes of a page's outer parts tell of its layout; an article in an article can be a comment or a teaser
        if tag in ("main", "body", "html") or tag == "article" and not self.inside_article():
            return False, False
        hint = False
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return True, False
            if name in ("class", "id", "role") and value:
                words = set(SPLIT.split(value.lower()))
                # an article's own header holds its title
                if words & ASIDE_WORDS - ({"header"} if self.inside_article() else set()):
                    return True, False
                hint = hint or bool(words & HINT_WORDS)
            if name == "style" and value and "display:none" in value.replace(" ", "").lower():
                return True, False
        return False, hint

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.end_line()
        elif tag == "br":
            self.parts.append(" ")
        if tag in CONTROLS:
            self.controls.update(self.hints)
        if tag in VOID:
            return
        if tag in BLOCK and self.open and self.open[-1][0] == "p":
            self.close_last()
        if tag in CLOSES:
            ends, scope = CLOSES[tag]
            least = max((self.places[t][-1] for t in scope if self.places[t]), default=-1)
            self.close_from(min((self.places[t][-1] for t in ends if self.places[t] and self.places[t][-1] > least), default=len(self.open)))
        hidden, hint = self.aside(tag, attrs)
        number = mark = 0
        if tag in CONTAINERS and not hidden:
            self.number += 1
            number = self.number
            self.kinds[number] = "article" if any(k == "itemprop" and v == "articleBody" for k, v in attrs) else tag
            self.parent[number] = self.path[-1] if self.path else 0
            self.path += (number,)
        if hint and not hidden:
            self.number += 1
            mark = self.number
            self.hints += (mark,)
        self.hidden += hidden
        self.places[tag].append(len(self.open))
        self.open.append((tag, hidden, number, mark))

    def close_last(self) -> None:
        tag, hidden, number, mark = self.open.pop()
        self.places[tag].pop()
        self.hidden -= hidden
        if number:
            self.path = self.path[:-1]
        if mark:
            self.hints = self.hints[:-1]

    def close_from(self, place: int) -> None:
        while len(self.open) > place:
            self.close_last()

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.end_line()
        if self.places[tag]:
            self.close_from(self.places[tag][-1])

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)
            if self.places["a"]:
                self.links += len("".join(data.split()))


def content_lines(lengths: np.ndarray, tags: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Which lines belong to content: smoothed text-to-tag ratios over the threshold."""
    ratio = lengths / np.maximum(tags, 1)
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    smooth = np.convolve(np.pad(ratio, reach, mode="edge"), kernel / kernel.sum(), mode="valid")
    return smooth >= min(smooth.std(), smooth.max())


def regions(parser: Lines, lengths: np.ndarray, chosen: np.ndarray) -> tuple[set[int], bool]:
    """The containers that hold the content, and whether they are articles by their tag."""
    weight: dict[int, float] = {}
    for line, size, on in zip(parser.lines, lengths, chosen):
        if on:
            for k in line.path:
                weight[k] = weight.get(k, 0) + size
    main = [k for k in weight if parser.kinds[k] in ("article", "main")]
    if main:
        # nested ones: the innermost that still holds the most
        best = max(main, key=lambda k: (weight[k], k))
        return {k for k in main if k == best or parser.kinds[k] == "article" == parser.kinds[best] and parser.parent[k] == parser.parent[best] and 3 * weight[k] >= weight[best]}, True
    total = float(lengths[chosen].sum())
    best = max((k for k in weight if weight[k] >= 0.8 * total), default=0)
    return {best} if best else set(), False


def dropped_hints(parser: Lines, lengths: np.ndarray, tags: np.ndarray, chosen: np.ndarray) -> set[int]:
    """The hinted elements that have form controls or far less text to a tag than the cluster."""
    enough = max(HINT_LEAST, HINT_SHARE * lengths[chosen].sum() / max(1.0, tags[chosen].sum()))
    text: defaultdict[int, list[float]] = defaultdict(lambda: [0.0, 0.0])
    for line, size, n in zip(parser.lines, lengths, tags):
        for k in line.hints:
            text[k][0] += size
            text[k][1] += n
    return {k for k, (size, n) in text.items() if k in parser.controls or size < enough * n}


def link_runs(lines: list[Line]) -> set[int]:
    """Places of runs of LINK_RUN lines or more that are links and nothing else."""
    only = [line.links >= len(line.text.replace(" ", "")) for line in lines]
    out: set[int] = set()
    begin = 0
    for i in range(len(lines) + 1):
        if i == len(lines) or not only[i]:
            if i - begin >= LINK_RUN:
                out.update(range(begin, i))
            begin = i + 1
    return out


def extract(html: str | None) -> str:
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    lines = parser.lines
    if not lines:
        return ""
    lengths = np.array([len(line.text) for line in lines], dtype=np.float64)
    tags = np.array([line.tags for line in lines], dtype=np.float64)
    chosen = content_lines(lengths, tags)
    region, by_tag = regions(parser, lengths, chosen)
    gone = dropped_hints(parser, lengths, tags, chosen) if parser.hints or any(line.hints for line in lines) else set()
    menus = set() if by_tag else link_runs(lines)
    if len(menus) == len(lines):
        menus = set()
    # a page's title often stands before the container of its text
    first = next((i for i, line in enumerate(lines) if region.intersection(line.path)), 0)
    return "\n".join(line.text for i, line in enumerate(lines) if (not region or region.intersection(line.path) or line.title and i < first) and i not in menus and not gone.intersection(line.hints))


def html_text(pages: DataFrame) -> DataFrame:
    """A row per page with its main text; one scan, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, SCHEMA)
