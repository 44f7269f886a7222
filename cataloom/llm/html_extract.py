r"""Main text of web pages from streaming parser events, text-to-tag ratios and smoothed clustering.

The standard-library parser streams tags and text; block-level tags cut the page into lines. Each line has the ratio of its
text length to its tags. The ratios are smoothed by a Gaussian over neighbouring lines, a two-means threshold splits them,
and the lines above it form the content clusters. The content region is the smallest element that holds most of the
clustered text. Where the page marks its articles, only these can be regions, and one is kept with its short paragraphs, which
belong to it too; but an element in it that is named like furniture in part (related-work, related-posts) stays or goes by
whether its text lies in the clusters. In a page without any, a region that is the page itself ends at its outermost
clusters, and what a heading calls reader comments goes with that heading's element.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import field_type

BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul "
    "caption option".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never part of an article.
NOT_TEXT = frozenset(
    "head title script style noscript template iframe object svg math canvas audio video nav footer aside form button select "
    "textarea input dialog menu".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class, id and role that mark page furniture.
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar aside nav navbar "
    "navigation menu breadcrumb breadcrumbs header masthead footer cookie cookies consent gdpr notice notices alert popup modal "
    "overlay comment comments disqus respond reply replies share sharing social related recommended newsletter subscribe signup "
    "login pagination pager widget toolbar complementary contentinfo search hidden".split()
)
#: Those that mark furniture inside an article even as a part of a name.
SURE = frozenset("comment comments disqus replies cookie cookies consent breadcrumb breadcrumbs pagination pager navbar".split())
#: Those that, as a part of a name inside an article, leave it to the clusters; others must be the whole name there.
MAYBE = frozenset("ad ads advert adverts advertisement advertising sponsored share sharing social related newsletter subscribe promo sidebar".split())
#: Headings of reader comments.
COMMENTS = re.compile(r"(?i)^(\d+\s+)?(reader |user )?(comments?|responses|replies|kommentare|commentaires|comentarios)\W*(\(?\d+\)?)?\W*$")
#: Share of the clustered text that the content region holds.
MOST = 0.75
WORDS = re.compile(r"[a-z]+")
WHITE = re.compile(r"\s+")
SIGMA = 1.5


class _Open(NamedTuple):
    """An open element: tag, furniture here or above, region, number, nearest block element, in a heading, in a link, suspect."""

    tag: str
    bad: bool
    region: int
    number: int
    block: int
    heading: bool
    link: bool
    suspect: int


class _Lines(HTMLParser):
    """Collects lines: (text, tags, link characters, region or 0, is heading, element, suspect element or 0)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, bool, int, int]] = []
        self.stack: list[_Open] = []
        self.counts: Counter[str] = Counter()  # open elements by tag
        self.names = [""]
        self.above = [0]  # the element around each element; 0 is the page
        self.parts: list[str] = []
        self.tags = self.linked = self.regions = 0

    def _cut(self) -> None:
        text = WHITE.sub(" ", "".join(self.parts)).strip()
        if text:
            top = self.stack[-1] if self.stack else OUTSIDE
            self.lines.append((text, self.tags, self.linked, top.region, top.heading, top.block, top.suspect))
        self.parts, self.tags, self.linked = [], 0, 0

    def _close(self, size: int) -> None:
        for s in self.stack[size:]:
            self.counts[s.tag] -= 1
        del self.stack[size:]

    def _furniture(self, tag: str, attrs: dict[str, str | None], region: int) -> bool:
        if tag in NOT_TEXT or "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true":
            return True
        if tag == "header" and not region:
            return True
        if re.search(r"display\s*:\s*none", attrs.get("style") or "", re.I):
            return True
        if tag in ("html", "body", "main", "article"):
            names = attrs.get("class") or ""
            return tag == "article" and bool({"comment", "ad", "promo", "sponsored"} & set(WORDS.findall(names.lower())))
        names = " ".join(v for k in ("class", "id", "role") if (v := attrs.get(k)))
        if region:
            return bool(names) and not (SURE.isdisjoint(WORDS.findall(names.lower())) and FURNITURE.isdisjoint(names.lower().split()))
        return bool(names) and not FURNITURE.isdisjoint(WORDS.findall(names.lower()))

    def page_wide(self, element: int) -> bool:
        """Whether an element is the page's html or body."""
        return self.names[element] in ("html", "body")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self._cut()
        elif tag in ("br", "td", "th"):
            self.parts.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        if tag in ("article", "main"):  # an article doesn't stand in a menu that was never closed
            while self.counts["nav"] or self.counts["header"]:
                self._close(len(self.stack) - 1)
        elif tag == "body":
            stay = [s for s in self.stack if s.tag == "html"]
            self._close(0)
            self.stack = stay
            self.counts["html"] += len(stay)
        above = self.stack[-1] if self.stack else OUTSIDE
        a = dict(attrs)
        region = above.region
        bad = above.bad or self._furniture(tag, a, region)
        if not bad and not region and (tag in ("article", "main") or a.get("role") == "main" or a.get("itemprop") == "articleBody"):
            self.regions += 1
            region = self.regions
        number = len(self.above)
        suspect = above.suspect
        if not suspect and above.region and tag not in ("article", "main"):
            named = " ".join(v for k in ("class", "id", "role") if (v := a.get(k)))
            suspect = number if named and not MAYBE.isdisjoint(WORDS.findall(named.lower())) else 0
        self.stack.append(_Open(tag, bad, region, number, number if tag in BLOCK else above.block, above.heading or tag in HEADINGS, above.link or tag == "a", suspect))
        self.counts[tag] += 1
        self.above.append(above.number)
        self.names.append(tag)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self._cut()
        elif tag in ("td", "th"):
            self.parts.append(" ")
        self.tags += 1
        if self.counts[tag]:
            i = len(self.stack) - 1
            while self.stack[i].tag != tag:
                i -= 1
            self._close(i)

    def handle_data(self, data: str) -> None:
        top = self.stack[-1] if self.stack else OUTSIDE
        if top.bad:
            return
        self.parts.append(data)
        if top.link:
            self.linked += len(data.strip())


OUTSIDE = _Open("", False, 0, 0, 0, False, False, 0)


def _threshold(x: np.ndarray) -> float:
    """Two-means cut of the smoothed ratios."""
    cut = x.mean()
    for _ in range(50):
        low, high = x[x <= cut], x[x > cut]
        if not len(low) or not len(high):
            break
        new = (low.mean() + high.mean()) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return float(cut)


def content_lines(lines: list[tuple[str, int, int, int, bool, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(which lines the smoothed text-to-tag ratio puts into content clusters, which lines reach them by themselves)."""
    ratio = np.array([len(t) / max(1, n) for t, n, *_ in lines])
    reach = np.arange(-4, 5)
    kernel = np.exp(-(reach**2) / (2 * SIGMA**2))
    padded = np.pad(ratio, 4, mode="edge")
    smooth = np.convolve(padded, kernel / kernel.sum(), mode="valid")
    cut = _threshold(smooth)
    return smooth >= cut, ratio >= cut


def _without_comments(p: _Lines) -> list[tuple[str, int, int, int, bool, int, int]]:
    """The lines outside of elements with a heading of reader comments; where such a heading stands in the page itself, all before it."""
    gone = np.zeros(len(p.above), bool)
    lines = p.lines
    for at, (text, _, _, _, heading, element, _) in enumerate(lines):
        if heading and COMMENTS.match(text):
            around = p.above[element] if p.names[element] in HEADINGS else element
            if not around or p.page_wide(around):
                lines = lines[:at]
                break
            gone[around] = True
    for i in range(1, len(gone)):  # an element comes after those around it
        gone[i] |= gone[p.above[i]]
    return [x for x in lines if not gone[x[5]]]


def main_text(html: str | None) -> str:
    """The article of a page: its blocks joined by one line feed; empty if there is none."""
    if not html:
        return ""
    p = _Lines()
    p.feed(html)
    rest = p.rawdata
    if not rest.startswith("<"):  # an unfinished tag at the end of a cut page is no text
        p.close()
    p._cut()
    lines = p.lines if p.regions else _without_comments(p)
    if not lines:
        return ""
    inside, alone = content_lines(lines)
    if p.regions:
        weight = np.zeros(p.regions + 1)
        for (text, _, _, region, *_), good in zip(lines, inside):
            weight[region] += len(text) * (1.0 if good else 0.1)
        weight[0] = 0
        best = weight.max()
        keep = [r > 0 and weight[r] >= best / 2 for _, _, _, r, *_ in lines]
        held: dict[int, list[int]] = {}  # of suspect elements: characters in clusters that are no links, and all
        for (text, _, linked, _, _, _, suspect), good in zip(lines, inside | alone):
            if suspect:
                own = held.setdefault(suspect, [0, 0])
                own[0] += len(text) if good and linked * 2 <= len(text) else 0
                own[1] += len(text)
        keep = [k and (not s or 2 * held[s][0] > held[s][1]) for k, (*_, s) in zip(keep, lines)]
        if any(keep):
            return "\n".join(text for (text, *_), k in zip(lines, keep) if k)
    held = np.zeros(len(p.above))
    for (text, _, _, _, _, element, _), good in zip(lines, inside):
        held[element] += len(text) * good
    for i in range(len(held) - 1, 0, -1):  # an element comes after those around it
        held[p.above[i]] += held[i]
    region = max(i for i in range(len(held)) if held[i] >= MOST * held[0])
    within = np.zeros(len(held), bool)
    within[region] = True
    for i in range(region + 1, len(held)):
        within[i] = within[p.above[i]]
    keep = np.array([within[element] and linked * 2 <= len(text) for text, _, linked, _, _, element, _ in lines], bool)
    if region == 0 or p.page_wide(region):
        at = np.flatnonzero(inside & keep)
        if not len(at):
            return ""
        first, last = int(at[0]), int(at[-1])
        while first and lines[first - 1][4] and keep[first - 1]:
            first -= 1
        keep[:first] = keep[last + 1 :] = False
    return "\n".join(text for (text, *_), k in zip(lines, keep) if k)


def extract(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of keep, text (the main text) and n_chars (its code points), one row for each row of df.

    A null or empty html, or a page without an article, gives an empty text and 0. Markup is read whole, however long;
    repeated rows come out repeatedly; null keys and urls pass through; other columns are not read.
    """
    src = df.select(*keep, F.col(html_col).cast("string").alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(h.as_py()) for h in b.column(len(keep))]
            made = [pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *made], [*keep, "text", "n_chars"])

    fields = [f"`{c}` {field_type(src, c)}" for c in keep]
    return src.mapInArrow(run, ", ".join([*fields, "text string", "n_chars bigint"]))
