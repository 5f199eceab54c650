"""Main text of HTML pages by the distribution of text over line blocks.

Markup is stripped to lines, one per block element, each with its text length and the part of
it that stands in links or in page furniture (menus, headers, footers, sidebars, notices,
adverts, forms, reader comments). Lengths that count are summed over sliding windows of lines.
A stretch of the page begins where the sums rise from nothing and ends where they dive to
nothing again; it surges if a sum inside reaches a share of the page's largest. Stretches of
one container that only furniture or links separate are one text. The text that weighs most is
the article: every line between its two ends but furniture and lists of links, short ones too.

An article or main element decides nothing by itself: text in one weighs more, and its edges
are as wide as a window, so that no window looks over them.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import map_rows

#: Lines in a window, what a character in an article or main element counts, and the share of
#: the page's largest window sum that a stretch must reach to be text.
WINDOW, ARTICLE_WEIGHT, SURGE = 3, 3, 0.25

# Elements of the HTML standard by their role here.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "canvas", "audio", "video")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
#: Elements that hold a text of their own; other blocks are parts of one.
BOXES = frozenset("article center div main td".split())
FURNITURE = frozenset("nav footer aside form button select dialog menu fieldset head datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist".split())
#: Words of class and id names that mark furniture.
NAMES = frozenset(
    "ad ads adbox adslot adunit advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promoted promotion banner banners "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars rail masthead header footer footers "
    "cookie cookies consent gdpr notice notices alert alerts notification notifications disclaimer popup modal overlay paywall "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations pagination pager "
    "comment comments commentlist disqus respond reply replies discussion widget widgets toolbar skip search form copyright hidden".split()
)
#: Names that keep what is in an article's own header.
HEADER_NAMES = frozenset(["header", "masthead"])

#: Names of reader comments; what looks like an article inside is a comment.
COMMENT_NAMES = frozenset("comment comments commentlist disqus respond reply replies discussion".split())

#: Words that a name of several words may have beside one of ``NAMES``.
PLACES = frozenset(
    "area article bar block body bottom box button buttons center col column container desktop entry fixed float global group heading holder inline inner item items left link links list "
    "main mobile module outer page panel post primary right row secondary section site slot sticky text title top unit wrap wrapper zone".split()
)
#: Characters outside links from which an element that holds most of a page's text is no furniture by its name.
LEAST_TEXT = 250

_ATTR = r"(?:[^<>\"']|\"[^\"]*\"|'[^']*')*"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(RAW) + r")\b(?:" + _ATTR + r")>.*?(?:</\1\s*[^>]*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:" + _ATTR + r"|[^<>]*))>|<[!?][^>]*>",
    re.S | re.I,
)
_NAMED = re.compile(r"(?<![\w-])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+")


class Box:
    """A container of lines; None stands for the page."""

    __slots__ = ("outer", "depth")

    def __init__(self, outer: Box | None) -> None:
        self.outer, self.depth = outer, outer.depth + 1 if outer else 1


@dataclass
class Line:
    text: str
    length: int
    linked: int
    furniture: bool
    article: int
    named: tuple = ()
    box: Box | None = None


def _marks(tag: str, attrs: str, in_article: bool) -> int:
    """2 if an element is page furniture, 1 if only a name says so (an article inside such a
    wrapper is still one), 0 if it is none."""
    if tag in FURNITURE or (tag == "header" and not in_article):
        return 2
    if not attrs or tag in ("html", "body"):
        return 0
    for m in _NAMED.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return 2
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return 2
        elif name == "role":
            if value in ROLES:
                return 2
        elif not re.fullmatch("h[1-6]", tag) and (tag not in ("main", "a", "span", "em", "strong", "b", "i", "code") or name == "id"):
            for token in value.split():
                words = _WORD.findall(token)
                hit = [w for w in words if w in NAMES]
                if len(hit) < len(words) and not all(w in NAMES or w in PLACES for w in words):
                    continue  # 'overflow-hidden' and 'social-impact' only contain such a word
                if hit and not (in_article and set(hit) <= HEADER_NAMES):
                    return 2 if set(hit) & COMMENT_NAMES else 1
    return 0


def lines_of(page: str) -> list[Line]:
    """The page as lines: one per stretch of text between block elements."""
    out: list[Line] = []
    stack: list[tuple[str, int, int, tuple, Box | None]] = []  # tag, furniture, article, furniture names and container around it
    sums: list[int] = []  # text outside links by element with such a name
    parts: list[str] = []
    state = {"furniture": 0, "articles": 0, "article": 0, "link": 0, "linked": 0, "named": (), "box": None}

    def flush() -> None:
        text = "".join(parts)
        parts.clear()
        linked, state["linked"] = state["linked"], 0
        if "&" in text:
            text = html.unescape(text)
        text = _SPACE.sub(" ", text).strip()
        if text:
            hard = state["furniture"] == 2
            out.append(Line(text, len(text), linked, hard, state["article"], state["named"], state["box"]))
            for i in () if hard else state["named"]:
                sums[i] += max(0, len(text) - linked)

    def add(text: str) -> None:
        if text:
            parts.append(text)
            if state["link"]:
                state["linked"] += len(text.strip())

    def close(upto: int) -> None:
        while len(stack) > upto:
            tag, state["furniture"], state["article"], state["named"], state["box"] = stack.pop()
            if tag == "a":
                state["link"] -= 1

    at = 0
    for m in _TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        if not m[3]:
            continue
        tag = m[3].lower()
        if tag in BLOCK:
            flush()
        if m[2]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
            continue
        if tag in VOID or m[4].endswith("/"):
            continue
        if tag in ("p", "li", "dd", "dt", "tr", "td", "th", "option"):
            _imply_end(stack, tag, close)
        if tag == "body":  # ends a head without an end tag
            head = next((i for i, x in enumerate(stack) if x[0] == "head"), None)
            if head is not None:
                close(head)
        mark = _marks(tag, m[4], bool(state["article"]))
        stack.append((tag, state["furniture"], state["article"], state["named"], state["box"]))
        if tag in BOXES:
            state["box"] = Box(state["box"])
        if tag in ("article", "main") and not mark and not state["article"] and state["furniture"] == 1:
            state["furniture"], state["named"] = 0, ()  # a wrapper's name does not make its article furniture
        if mark == 1:
            state["named"] = (*state["named"], len(sums))
            sums.append(0)
        state["furniture"] = max(state["furniture"], mark)
        if tag in ("article", "main") and state["furniture"] < 2:
            state["articles"] += 1
            state["article"] = state["articles"] if not state["article"] else state["article"]
        if tag == "a":
            state["link"] += 1
    add(page[at:])
    flush()
    total = sum(max(0, x.length - x.linked) for x in out if not x.furniture)
    for x in out:
        x.furniture = x.furniture or any(sums[i] < LEAST_TEXT or 2 * sums[i] <= total for i in x.named)
    return out


def _imply_end(stack: list, tag: str, close) -> None:
    """A new paragraph, item or cell ends an open one of its kind in the same container."""
    for i in range(len(stack) - 1, -1, -1):
        name = stack[i][0]
        if name == tag or (tag in ("dd", "dt") and name in ("dd", "dt")) or (tag in ("td", "th") and name in ("td", "th")):
            close(i)
            return
        if name in BLOCK and name not in ("p",):
            return


@dataclass
class Stretch:
    """Lines ``first`` to ``last`` between a rise and a dive: largest window sum, total weight
    and innermost container."""

    first: int
    last: int
    peak: int
    mass: int
    box: Box | None = None


def main_lines(lines: list[Line]) -> list[Line]:
    """The lines of the heaviest text that surges, without furniture and lists of links; if it
    stands in an article, other articles that surge count too."""
    weight = [_weight(x) for x in lines]
    lists = _link_lists(lines)
    found = _joined(stretches(lines, weight), lines, weight)
    level = SURGE * max((x.peak for x in found), default=0)
    found = [x for x in found if x.peak >= level]
    if not found:
        return []
    best = max(found, key=lambda x: x.mass)
    kept = [x for x in found if x is best or (lines[best.first].article and lines[x.first].article)]
    return [lines[i] for x in kept for i in _span(x, lines) if not lines[i].furniture and not lists[i]]


def _weight(line: Line) -> int:
    """What a line adds to its windows; links outside articles are no text."""
    if line.furniture or (not line.article and line.linked * 2 > line.length):
        return 0
    return line.length * (ARTICLE_WEIGHT if line.article else 1)


def window_sums(rows: list[int]) -> list[int]:
    """Sum of each row and the ``WINDOW - 1`` rows after it."""
    ahead = [0, *accumulate(rows)]
    return [ahead[min(i + WINDOW, len(rows))] - ahead[i] for i in range(len(rows))]


def stretches(lines: list[Line], weight: list[int]) -> list[Stretch]:
    """Stretches of lines whose windows are not empty, in page order."""
    place: list[int | None] = []  # line of each row; an article's edge is a window of empty rows
    for i, x in enumerate(lines):
        if i and x.article != lines[i - 1].article:
            place += [None] * WINDOW
        place.append(i)
    rows = [0 if i is None else weight[i] for i in place]
    out: list[Stretch] = []
    now: Stretch | None = None
    peak = 0
    for at, own, total in zip(place, rows, window_sums(rows), strict=True):
        if not total:  # the dive
            now, peak = None, 0
            continue
        peak = max(peak, total)
        if own:
            if now is None:
                now = Stretch(at, at, 0, 0, lines[at].box)
                out.append(now)
            now.last, now.mass, now.box = at, now.mass + own, _common(now.box, lines[at].box)
        if now is not None:
            now.peak = max(now.peak, peak)
    return out


def _span(text: Stretch, lines: list[Line]) -> range:
    """A text's lines, with the paragraphs of links at its ends that share its container."""
    first, last = text.first, text.last
    if not lines[first].article and text.box:
        while last + 1 < len(lines) and _common(lines[last + 1].box, text.box) is text.box:
            last += 1
        while first and _common(lines[first - 1].box, text.box) is text.box:
            first -= 1
    return range(first, last + 1)


def _link_lists(lines: list[Line]) -> list[bool]:
    """Lines outside articles that are links and nothing else, in runs of a window or more."""
    out = [False] * len(lines)
    run = 0
    for i, x in enumerate(lines):
        run = run + 1 if not x.furniture and not x.article and x.linked * 10 >= x.length * 9 else 0
        if run >= WINDOW:
            out[i - WINDOW + 1 : i + 1] = [True] * WINDOW
    return out


def _common(a: Box | None, b: Box | None) -> Box | None:
    """The innermost container of both."""
    while a is not b:
        if b is None or (a is not None and a.depth >= b.depth):
            a = a.outer
        else:
            b = b.outer
    return a


def _joined(found: list[Stretch], lines: list[Line], weight: list[int]) -> list[Stretch]:
    """Stretches of one container or article that are one text, as one."""
    out: list[Stretch] = []
    before: dict[int, Stretch] = {}  # the last text by article, 0 for none
    for x in found:
        article = lines[x.first].article
        old = before.get(article)
        if old and _one_text(old, x, lines, weight):
            old.last, old.peak, old.mass, old.box = x.last, max(old.peak, x.peak), old.mass + x.mass, _common(old.box, x.box)
        else:
            before[article] = x
            out.append(x)
    return out


def _one_text(a: Stretch, b: Stretch, lines: list[Line], weight: list[int]) -> bool:
    """Whether only furniture, links or a lighter article stands between two stretches, inside
    the container that one of them has; in an article, only furniture."""
    between = range(a.last + 1, b.first)
    if lines[a.first].article:
        return all(lines[i].furniture for i in between)
    both = _common(a.box, b.box)
    if both is not a.box and both is not b.box:
        return False
    inside = both is not None and all(_common(lines[i].box, both) is both for i in between)
    return sum(weight[i] for i in between) <= a.mass + b.mass and (inside or all(lines[i].furniture for i in between))


def main_text(page: str) -> str:
    """The article of a page: blocks in order, joined by line feeds."""
    return "\n".join(x.text for x in main_lines(lines_of(page)))


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``.

    A null or empty page and one without an article give an empty text; a null page_id or url
    stays null; repeated rows repeat; other columns are not read. Whole pages are read,
    whatever their length.
    """

    def rows(batch: Iterator[dict]) -> Iterator[dict]:
        for r in batch:
            text = main_text(r["page"] or "")
            yield {"page_id": r["page_id"], "url": r["url"], "text": text, "n_chars": len(text)}

    schema = "page_id bigint, url string, text string, n_chars bigint"
    return map_rows(pages.select("page_id", "url", F.col("html").alias("page")), rows, schema)
