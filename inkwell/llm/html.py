"""Main text of web pages by the distribution of text over lines of blocks.

Markup is stripped into lines: each tag of a block begins a line, so text that other blocks part lies further apart than the paragraphs of one. A
line's weight is the length of its text outside links. Markup gives hints, which change weights but leave every line one: a line in an
element that is rarely the article (menus, footers, adverts, forms, comments and the like, by tag, role, class or id) counts ``HINTED`` of its text; where a
page has an ``article`` or ``main`` element, a line outside it counts ``OUTSIDE``, and one inside counts its links in part, and at least as ``SURGE``
characters.

Weights are summed over windows of ``BLOCK`` lines, for lines of each kind of hint by themselves. The level of a page is ``LEVEL`` of its greatest sum, at most
``SURGE``. A stretch of text begins where the sums leave nothing and ends where they dive back to it; it is kept if
they surge to the level in between, and its text is what is returned.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import pieces, with_fields

#: Kinds of elements.
DROPPED = frozenset("script style template noscript svg math iframe object canvas audio video select option textarea button head title datalist".split())
APART = frozenset("nav footer aside form menu dialog".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Words of a class or an id that name what isn't the article.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored menu nav navbar navigation breadcrumb breadcrumbs "
    "sidebar aside footer header masthead topbar toolbar cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "comment comments discussion replies reply disqus share sharing social related recommended widget pagination pager search form copyright legal disclaimer".split()
)
#: Words that name where an article stands: a header in there is the article's.
CONTENT = frozenset("content article post entry story main".split())
#: First words of a name that tells of another element, as has-sidebar does.
ABOUT = frozenset("has with without no".split())
#: Words that, in an article, may name a part of it.
PARTS = frozenset("header banner discussion legal disclaimer copyright notice notices form search".split())
TALK = frozenset("comment comments discussion replies reply disqus".split())
_CONTENT = frozenset("article main body html".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*+)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
#: Elements whose content isn't markup: only their own end tag ends them.
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|$)", re.I) for t in ("script", "style", "textarea", "title", "iframe")}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Lines of a window.
BLOCK = 2
#: Characters in a window that make a surge on any page, and the share of the greatest sum that does on a page with little text (one, at least).
SURGE, LEVEL = 120, 0.3
#: What a line counts for in an element that is rarely the article, and outside the article element of a page that has one.
HINTED, OUTSIDE = 1 / 4096, 1 / 16


def _names(attributes: str) -> set[str]:
    if "=" not in attributes:
        return set()
    found = [[w.lower() for w in _WORD.findall(x)] for k, a, b, c in _ATTRIBUTE.findall(attributes) if k.lower() in ("class", "id") for x in (a or b or c).split()]
    return {w for x in found if x and x[0] not in ABOUT for w in x}


def _apart(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element never holds the article, by tag, role or style. inside: it stands in an article already."""
    if tag in APART:
        return True
    found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
    if found.get("role", "").lower() in ROLES or found.get("aria-hidden", "").lower() == "true" or re.search(r"\bhidden\b", _ATTRIBUTE.sub("", attributes)):
        return True
    if re.search(r"display\s*:\s*none", found.get("style", "")):
        return True
    return tag == "header" and not inside


def _named(tag: str, attributes: str, inside: bool, own: bool) -> set[str]:
    """Words of the class and the id by which an element may not be the article."""
    if tag in _CONTENT or tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        return set()
    names = _names(attributes) & NAMES
    if tag == "header" or inside:
        names -= {"header", "banner"}
    return names - PARTS if own else names


class Line:
    """named: the innermost element around it whose name marks it, -1 without one. place: which line of the page it is, with those without text."""

    __slots__ = ("text", "linked", "apart", "own", "named", "place")

    def __init__(self, apart: bool, own: bool, named: int, place: int) -> None:
        self.text: list[str] = []
        self.linked: list[str] = []
        self.apart, self.own, self.named, self.place = apart, own, named, place


#: Elements with names that mark them, in page order: the one around each (-1: none), and whether the name is one of comments.
Named = list[tuple[int, bool]]


def lines(page: str) -> tuple[list[Line], Named]:
    """A line for each block of text, in page order, and the named elements. own: it stands in an article or main element."""
    out: list[Line] = []
    elements: Named = []
    stack: list[tuple[str, bool, bool, bool, int]] = []
    open_: Counter[str] = Counter()
    named = -1
    apart = own = inside = False
    fresh = True
    raw, links, at, place = "", 0, 0, 0
    within: Counter[str] = Counter()
    endless: set[str] = set()

    def text(value: str) -> None:
        nonlocal fresh
        if not value or raw or (fresh and not value.strip()):
            return
        if fresh:
            out.append(Line(apart, own, named, max(place, out[-1].place + 1 if out else 0)))
            fresh = False
        value = entities.unescape(value)
        out[-1].text.append(value)
        if links:
            out[-1].linked.append(value)

    while m := _TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA[") and not raw:
                text(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        opens = not m[1] and not m[3].rstrip().endswith("/")
        if opens and tag in _ENDS:
            end = None if tag in endless else _ENDS[tag].search(page, at)
            if end or tag in ("script", "style"):
                at = end.end() if end else len(page)
                fresh = fresh or not raw
                continue
            endless.add(tag)
        if raw:
            if opens and tag not in VOID and (tag != raw or tag not in ("button", "select")):
                within[tag] += 1
            elif m[1] and within[tag]:
                within[tag] -= 1
            elif m[1] and tag == raw:
                raw = ""
                continue
            elif m[1] and open_[tag]:
                raw = ""  # left open: it ends with the element that it stands in
            if raw:
                continue
        block = tag not in INLINE
        fresh = fresh or block
        place += block
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            if open_[tag]:
                was = apart, own, named
                while stack:
                    name, apart, own, inside, named = stack.pop()
                    open_[name] -= 1
                    if name == tag:
                        break
                fresh = fresh or was != (apart, own, named)
            continue
        if m[3].rstrip().endswith("/") and tag not in ("a", "p", "div", "span", "article", "main", "section") or tag in VOID:
            continue
        if tag in DROPPED:
            raw = tag if not m[3].rstrip().endswith("/") and tag not in ("head", "option") else ""
            within.clear()
            if tag != "head":
                continue
        if tag == "a":
            links += 1
            continue
        if tag in ("p", "li", "td", "th", "dt", "dd", "tr", "option") and stack and stack[-1][0] == tag:
            _, apart, own, inside, named = stack.pop()
            open_[tag] -= 1
        stack.append((tag, apart, own, inside, named))
        open_[tag] += 1
        was = apart, own, named
        apart = apart or _apart(tag, m[3], inside)
        if not apart and (words := _named(tag, m[3], inside, own)):
            elements.append((named, bool(words & TALK)))
            named = len(elements) - 1
        own = own or tag in ("article", "main") and not apart
        inside = inside or own or _names(m[3]) & CONTENT != set()
        fresh = fresh or was != (apart, own, named)
    text(page[at:])
    return out, elements


def _clean(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def _by_name(found: list[tuple[Line, str]], elements: Named) -> None:
    """Lines in elements that names mark stand apart, unless the element holds most of the page's text; one of
    comments may do so beside an article."""
    if not elements:
        return
    mass = [0] * len(elements)
    for x, t in found:
        if not x.apart and x.named >= 0:
            mass[x.named] += len(t)
    for e in range(len(elements) - 1, -1, -1):  # an element comes after the one around it
        if (around := elements[e][0]) >= 0:
            mass[around] += mass[e]
    most = sum(len(t) for x, t in found if not x.apart) / 2
    held = any(x.own and not x.apart and x.named < 0 for x, _ in found)
    marked: list[bool] = []
    for (around, talk), n in zip(elements, mass):
        marked.append(around >= 0 and marked[around] or n <= most or talk and held)
    for x, _ in found:
        x.apart = x.apart or x.named >= 0 and marked[x.named]


def windows(weight: np.ndarray) -> np.ndarray:
    """Sum of each window of ``BLOCK`` lines, by its last line."""
    return np.convolve(weight, np.ones(BLOCK))


def stretches(weight: np.ndarray, level: float) -> list[tuple[int, int]]:
    """(first, last + 1) of the lines between a surge and a dive: runs of windows with weight, that reach ``level``."""
    if not len(weight):
        return []
    sums = windows(weight)
    live = sums > 0
    start = np.flatnonzero(live & ~np.concatenate([[False], live[:-1]]))
    end = np.flatnonzero(live & ~np.concatenate([live[1:], [False]])) + 1
    return [(int(a), int(b) - BLOCK + 1) for a, b in zip(start, end) if sums[a:b].max() >= level]


def kept_lines(page: str) -> list[str]:
    all_, elements = lines(page)
    found = [(x, t) for x in all_ if (t := _clean(x.text))]
    _by_name(found, elements)
    held = any(x.own and not x.apart for x, _ in found)

    def kind(x: Line) -> str:
        return "apart" if x.apart else "own" if held and x.own else "other"

    def weight(x: Line, t: str) -> float:
        if kind(x) == "own":
            return max(SURGE, len(t) - 0.75 * len(_clean(x.linked)))
        return max(0, len(t) - len(_clean(x.linked))) * (HINTED if x.apart else OUTSIDE if held else 1)

    weights: dict[str, np.ndarray] = {}
    for x, t in found:
        weights.setdefault(kind(x), np.zeros(found[-1][0].place + 1))[x.place] = weight(x, t)
    level = max(1, min(SURGE, LEVEL * max((windows(w).max() for w in weights.values()), default=0)))
    kept = {k: np.zeros(len(w), bool) for k, w in weights.items()}
    for k, w in weights.items():
        for a, b in stretches(w, level):
            kept[k][a:b] = w[a:b] > 0
    return [t for x, t in found if kept[kind(x)][x.place]]


def main_text(page: str | None) -> str:
    return " ".join(kept_lines(page or ""))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "html"):
        texts = [main_text(h) for h in b.column("html").to_pylist()]
        yield pa.record_batch([b.column("row"), pa.array(texts, pa.string())], names=["row", "text"])


def extract(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` and text: a row for each page. Character references are decoded, white space in
    a block becomes one space, blocks are joined in page order by one space.

    Null and empty pages, and pages without an article, have the empty text. Broken markup is read as far as it goes:
    a tag cut off at the end is dropped, a block left open ends with the page. No rows move.
    """
    rows = pages.select(F.struct(*(keep or ["page_id", "url"])).alias("row"), F.col(html_col).cast("string").alias("html"))
    shape = with_fields(rows.select("row"), "text string")
    return rows.mapInArrow(_extract, shape).select("row.*", "text")
