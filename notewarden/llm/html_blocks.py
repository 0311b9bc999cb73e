"""Main text of web pages from flat text blocks.

A page becomes a flat list of text blocks.  Each block has its word count, its
link density and its zone (inside an article, inside a part that pages repeat,
inside a part that only a class, id or role names so, or neither), and the same figures of its two neighbours.  A decision tree, trained
here on a small labelled table of blocks, keeps or drops each block."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts_of, with_arrow

#: Zones of a block; FINAL counts as REPEATED where it has not ended.
OTHER, ARTICLE, REPEATED, NAMED, FINAL = 0, 1, 2, 3, 4

# Fixed values of HTML: elements that start a block, that have no end, and whose
# content is not text.
BLOCK_TAGS = frozenset({
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main",
    "menu", "nav", "ol", "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title",
    "tr", "ul",
})
VOID_TAGS = frozenset({
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
})
#: Elements whose text belongs to the page's frame, not to its article.
REPEATED_TAGS = frozenset({
    "nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "search",
})
UNSEEN_TAGS = frozenset({
    "head", "title", "template", "svg", "math", "object", "iframe", "canvas", "audio", "video", "noscript",
})
#: Elements that stand in a head; any other one, and text, ends it.
HEAD_TAGS = frozenset({
    "head", "html", "title", "base", "basefont", "bgsound", "link", "meta", "noframes", "noscript", "script", "style", "template",
})
#: Words of a class, id or role that name such a part.
REPEATED_WORDS = frozenset({
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar",
    "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "contentinfo", "sidebar", "aside", "complementary",
    "widget", "cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "dialog", "overlay", "comment", "comments", "commentlist",
    "adsbygoogle", "disqus", "respond", "reply", "replies", "share", "sharing", "social", "related", "recommended", "newsletter", "subscribe", "signup", "login",
    "search", "pagination", "pager", "toolbar", "skip",
})
#: Those of them whose part is never main text, however long it is; the others are weighed.
FINAL_WORDS = frozenset({
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsbygoogle", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent",
    "gdpr", "sidebar", "share", "sharing", "social", "related", "recommended", "newsletter", "comment", "comments", "commentlist", "disqus", "respond", "reply", "replies",
})
#: Before a final word they tell of a layout that has such a part, as in content-sidebar-wrap.
LAYOUT_WORDS = frozenset({"content", "main", "page", "primary"})
#: Those of them that name readers' answers, which follow an article inside its element.
ANSWER_WORDS = frozenset({"comment", "comments", "commentlist", "disqus", "respond", "reply", "replies"})
#: Words that may stand beside them in a name, as in site-header or comment-list.
PLAIN_WORDS = frozenset({
    "site", "page", "main", "global", "top", "bottom", "left", "right", "primary", "secondary", "box", "bar", "block", "body", "button",
    "buttons", "container", "content", "wrapper", "wrap", "inner", "outer", "list", "item", "items", "link", "links", "section", "area", "panel", "form",
    "field", "input", "icon", "icons", "title", "text", "id", "div", "col", "row", "unit", "slot", "message", "policy", "posts", "post",
    "articles", "media", "level", "depth", "thread", "even", "odd", "parent", "children", "to",
    "user", "users", "reader", "readers", "google", "article", "module", "component", "region", "holder", "group",
})
#: What a form around a whole page holds.
PAGE_TAGS = frozenset({"article", "main", "h1", "header", "footer", "nav", "aside"})
#: Elements whose content is text up to their end tag, whatever it holds, and is not shown.
_RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in ("script", "style", "textarea", "xmp")}
_TAG_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
_GAP = re.compile(r"[\s/]*+")
_NAME = re.compile(r"[^\s/>][^\s/>=]*+")
_EQUALS = re.compile(r"\s*+=\s*+")
_BARE = re.compile(r"[^\s>]*+")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_WORD_PARTS = re.compile(r"[a-z]+|[0-9]+")


class Token(NamedTuple):
    start: int
    end: int
    tag: str  # "" for comments and the like
    closes: bool
    attrs: dict[str, str]
    empty: bool  # ends with a slash


def read_attributes(page: str, at: int, last: dict[str, int]) -> tuple[dict[str, str], int]:
    """The attributes from a place on (the first of a name counts) and the place
    behind the tag's end; -1 if the page ends before.  A quote that nothing closes
    is taken as part of the value.  Goes forward only."""
    attrs: dict[str, str] = {}
    while True:
        at = _GAP.match(page, at).end()
        if at >= len(page):
            return attrs, -1
        if page[at] == ">":
            return attrs, at + 1
        m = _NAME.match(page, at)
        name, value, at = m[0].lower(), "", m.end()
        if m := _EQUALS.match(page, at):
            at = m.end()
            quote = page[at : at + 1]
            if quote in last and last[quote] > at:
                end = page.index(quote, at + 1)
                value, at = page[at + 1 : end], end + 1
            else:
                m = _BARE.match(page, at)
                value, at = m[0], m.end()
        attrs.setdefault(name, value)


def tokens_of(page: str) -> Iterator[Token]:
    """Tags, comments and raw elements in order.  Every step goes forward, so the
    time is in proportion to the page; a tag that the page ends in takes the rest."""
    last, at, size = {q: page.rfind(q) for q in "\"'"}, 0, len(page)
    while (at := page.find("<", at)) >= 0:
        after = page[at + 1 : at + 3]
        if page.startswith("<!--", at):
            end = page.find("-->", at + 2)
            end = size if end < 0 else end + 3
            yield Token(at, end, "", False, {}, False)
        elif after[:1] in ("!", "?") or after[:1] == "/" and not after[1:].isalpha():
            end = page.find(">", at) + 1 or size
            yield Token(at, end, "", False, {}, False)
        elif m := _TAG_NAME.match(page, at):
            tag, closes = m[1].lower(), after[0] == "/"
            attrs, end = read_attributes(page, m.end(), last)
            if end < 0:
                yield Token(at, size, "", False, {}, False)
                return
            if tag in _RAW_ENDS and not closes:
                found = _RAW_ENDS[tag].search(page, end)
                end = read_attributes(page, found.end(), last)[1] if found else -1
                end = size if end < 0 else end
                yield Token(at, end, "", False, {}, False)
            else:
                yield Token(at, end, tag, closes, attrs, page[end - 2] == "/")
        else:
            at += 1
            continue
        at = end


FEATURES = ("words", "links", "zone", "prev_words", "prev_links", "prev_zone", "next_words", "next_links", "next_zone")
#: The labelled table: words, link density, zone of a block, of the one before, of the one after; whether it is main text.
LABELLED_BLOCKS = [
    # news page with an article element: headline, paragraphs of any length, list and quote inside
    (9, 0.0, 1, 3, 0.0, 2, 55, 0.0, 1, 1), (55, 0.0, 1, 9, 0.0, 1, 62, 0.1, 1, 1), (62, 0.1, 1, 55, 0.0, 1, 1, 0.0, 1, 1), (1, 0.0, 1, 62, 0.1, 1, 40, 0.0, 1, 1),
    (40, 0.0, 1, 1, 0.0, 1, 5, 1.0, 1, 1), (5, 1.0, 1, 40, 0.0, 1, 30, 0.0, 1, 1), (30, 0.0, 1, 5, 1.0, 1, 9, 0.0, 2, 1), (3, 0.0, 1, 0, 0.0, 0, 0, 0.0, 0, 1),
    (2, 0.0, 1, 7, 0.0, 2, 11, 0.0, 2, 1), (120, 0.3, 1, 9, 0.0, 1, 18, 0.2, 2, 1), (14, 0.6, 1, 25, 0.0, 1, 21, 0.0, 1, 1), (7, 0.0, 1, 1, 1.0, 2, 4, 0.0, 1, 1),
    # short articles right between parts of the frame
    (3, 0.0, 1, 1, 1.0, 2, 1, 0.0, 2, 1), (1, 0.0, 1, 2, 1.0, 2, 1, 1.0, 2, 1), (6, 0.0, 1, 1, 1.0, 2, 2, 1.0, 2, 1), (2, 0.5, 1, 3, 0.0, 2, 3, 0.0, 2, 1),
    (4, 1.0, 1, 1, 1.0, 2, 1, 1.0, 2, 1), (1, 1.0, 1, 0, 0.0, 0, 1, 1.0, 2, 1), (5, 0.0, 1, 1, 1.0, 0, 2, 1.0, 0, 1), (2, 0.0, 1, 1, 0.0, 3, 1, 0.0, 3, 1),
    # its frame: menu items, advert, cookie notice, footer, comments, forms; short or long, with links or without
    (1, 1.0, 2, 1, 1.0, 2, 1, 1.0, 2, 0), (1, 1.0, 2, 0, 0.0, 0, 2, 1.0, 2, 0), (2, 1.0, 2, 1, 1.0, 2, 8, 0.0, 2, 0), (8, 0.0, 2, 1, 1.0, 2, 9, 0.0, 1, 0),
    (35, 0.0, 2, 1, 1.0, 2, 9, 0.0, 1, 0), (12, 0.2, 2, 30, 0.0, 1, 0, 0.0, 0, 0), (60, 0.0, 2, 30, 0.0, 1, 48, 0.0, 2, 0), (48, 0.0, 2, 60, 0.0, 2, 12, 0.2, 2, 0),
    (3, 0.0, 2, 48, 0.0, 2, 1, 0.0, 2, 0), (25, 0.1, 2, 12, 0.0, 2, 55, 0.0, 1, 0), (18, 0.2, 2, 120, 0.3, 1, 0, 0.0, 0, 0), (150, 0.0, 2, 9, 0.0, 1, 40, 0.0, 1, 0),
    # pages without an article element: long blocks and short ones between them stay, link lists and lone scraps go
    (70, 0.0, 0, 3, 0.0, 0, 45, 0.05, 0, 1), (45, 0.05, 0, 70, 0.0, 0, 6, 0.0, 0, 1), (6, 0.0, 0, 45, 0.05, 0, 33, 0.0, 0, 1), (33, 0.0, 0, 6, 0.0, 0, 20, 0.0, 2, 1),
    (8, 0.0, 0, 1, 1.0, 2, 70, 0.0, 0, 1), (18, 0.0, 0, 0, 0.0, 0, 22, 0.0, 0, 1), (22, 0.0, 0, 18, 0.0, 0, 0, 0.0, 0, 1), (26, 0.3, 0, 33, 0.0, 0, 41, 0.0, 0, 1),
    (2, 1.0, 0, 1, 1.0, 0, 2, 1.0, 0, 0), (1, 1.0, 0, 0, 0.0, 0, 1, 1.0, 0, 0), (3, 0.9, 0, 40, 0.0, 0, 4, 1.0, 0, 0), (12, 0.9, 0, 4, 1.0, 0, 3, 1.0, 0, 0),
    (2, 0.0, 0, 1, 1.0, 0, 1, 1.0, 0, 0), (4, 0.0, 0, 2, 1.0, 0, 0, 0.0, 0, 0), (30, 0.85, 0, 3, 1.0, 0, 2, 1.0, 0, 0), (3, 0.0, 0, 1, 1.0, 2, 2, 1.0, 0, 0),
    (1, 1.0, 0, 1, 1.0, 0, 30, 0.0, 0, 0), (2, 1.0, 0, 3, 1.0, 0, 70, 0.0, 0, 0), (4, 0.95, 0, 60, 0.0, 0, 45, 0.0, 0, 0), (1, 1.0, 0, 50, 0.0, 0, 25, 0.0, 0, 0),
    # parts that only a name calls repeated: long blocks with few links stay, short ones and those with many links go
    (150, 0.0, 3, 9, 0.0, 3, 120, 0.05, 3, 1), (120, 0.05, 3, 150, 0.0, 3, 2, 1.0, 2, 1), (110, 0.1, 3, 40, 0.0, 1, 30, 0.0, 1, 1), (200, 0.0, 3, 0, 0.0, 0, 0, 0.0, 0, 1),
    (60, 0.0, 3, 30, 0.0, 1, 48, 0.0, 3, 0), (8, 0.0, 3, 1, 1.0, 2, 9, 0.0, 1, 0), (150, 0.7, 3, 9, 0.0, 1, 40, 0.0, 1, 0), (35, 0.0, 3, 120, 0.0, 3, 0, 0.0, 0, 0),
    (2, 1.0, 3, 1, 1.0, 3, 3, 1.0, 3, 0), (1, 0.0, 3, 55, 0.0, 0, 70, 0.0, 0, 0), (120, 0.9, 3, 70, 0.0, 0, 0, 0.0, 0, 0), (45, 0.1, 3, 70, 0.0, 0, 45, 0.0, 0, 0),
    # headlines and short paragraphs on pages without an article element, and pages that are short as a whole
    (1, 0.0, 0, 45, 0.0, 0, 30, 0.0, 0, 1), (2, 0.0, 0, 1, 1.0, 2, 45, 0.0, 0, 1), (2, 0.0, 0, 0, 0.0, 0, 3, 0.0, 0, 1), (3, 0.0, 0, 2, 0.0, 0, 0, 0.0, 0, 1),
    (1, 0.0, 0, 60, 0.0, 0, 25, 0.05, 0, 1), (2, 0.0, 0, 0, 0.0, 0, 50, 0.0, 0, 1), (4, 0.0, 0, 40, 0.05, 0, 18, 0.0, 0, 1), (3, 0.0, 0, 1, 0.0, 0, 60, 0.0, 0, 1),
    (70, 0.0, 0, 2, 1.0, 0, 45, 0.05, 0, 1), (33, 0.0, 0, 1, 1.0, 0, 1, 1.0, 0, 1), (25, 0.0, 0, 3, 0.9, 0, 2, 1.0, 0, 1), (40, 0.1, 0, 1, 1.0, 0, 0, 0.0, 0, 1),
]


def train_tree(table: list[tuple], depth: int = 6):
    """A classification tree by Gini impurity; a leaf is True (main text) or False.

    Ties go to the first feature and the lowest threshold, so that the tree is
    the same in every run."""
    data = np.array(table, float)
    x, y = data[:, :-1], data[:, -1]

    def grow(rows: np.ndarray, left: int):
        share = y[rows].mean()
        if left == 0 or share in (0.0, 1.0):
            return bool(share >= 0.5)
        best = None
        for feature in range(x.shape[1]):
            values = np.unique(x[rows, feature])
            for cut in (values[:-1] + values[1:]) / 2:
                low = x[rows, feature] <= cut
                impurity = sum(p.mean() * (1 - p.mean()) * len(p) for p in (y[rows[low]], y[rows[~low]]))
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, feature, cut, low)
        if best is None:
            return bool(share >= 0.5)
        _, feature, cut, low = best
        return (feature, cut, grow(rows[low], left - 1), grow(rows[~low], left - 1))

    return grow(np.arange(len(y)), depth)


def classify(tree, features: tuple) -> bool:
    while not isinstance(tree, bool):
        feature, cut, low, high = tree
        tree = low if features[feature] <= cut else high
    return tree


def repeated_words(tag: str, attrs: dict[str, str]) -> tuple[set[str], bool]:
    """The REPEATED_WORDS by which a class, id or role names the whole part (one of its
    tokens is made of REPEATED_WORDS and PLAIN_WORDS; letters that stand alone and
    versions do not count), and whether such a name is final.  Tokens like has-sidebar
    tell of the page, and the names of a heading are places to link to."""
    if tag in ("html", "body") or re.fullmatch("h[1-6]", tag):
        return set(), False
    named: set[str] = set()
    for name in ("class", "id", "role"):
        for token in attrs.get(name, "").lower().split():
            words = [w for w in _WORD_PARTS.findall(token) if not w.isdigit() and len(w) > 1]
            if REPEATED_WORDS.intersection(words) and REPEATED_WORDS.union(PLAIN_WORDS).issuperset(words):
                named |= REPEATED_WORDS.intersection(words)
                first = next((i for i, w in enumerate(words) if w in FINAL_WORDS), None)
                if first is not None and not LAYOUT_WORDS.intersection(words[:first]):
                    return named, True
    return named, False


def hidden(attrs: dict[str, str]) -> bool:
    return "hidden" in attrs or attrs.get("aria-hidden", "").strip().lower() == "true" or bool(_NO_DISPLAY.search(attrs.get("style", "")))


def zone_of(tag: str, attrs: dict[str, str], above: int, inside_article: bool, around: bool) -> int:
    """REPEATED is for good, and so is a FINAL name of readers' answers or in an article.
    NAMED, and a FINAL name outside of articles, end at an article or main that is
    not named so itself, unless it stands in an article, as comments do.  A form
    `around` the page is none of its parts."""
    if above == REPEATED or (tag in REPEATED_TAGS and not around) or (tag == "header" and not inside_article) or hidden(attrs):
        return REPEATED
    named, final = repeated_words(tag, attrs)
    if named & ANSWER_WORDS and (final or inside_article) or final and inside_article:
        return REPEATED
    if final:
        return FINAL
    if named and above != FINAL:
        return NAMED
    return ARTICLE if tag in ("article", "main") and not (above == NAMED and inside_article) else above


def unclosed(tokens: list[Token]) -> set[int]:
    """Starts of the unseen elements that no end tag closes."""
    opened: dict[str, list[int]] = {}
    for t in tokens:
        if t.tag not in UNSEEN_TAGS:
            continue
        if not t.closes:
            if not t.empty:
                opened.setdefault(t.tag, []).append(t.start)
        elif opened.get(t.tag):
            opened[t.tag].pop()
    return {at for places in opened.values() for at in places}


def forms_around(tokens: list[Token]) -> set[int]:
    """Starts of the forms that hold parts of a whole page; one inside another is not looked at."""
    found, start = set(), None
    for t in tokens:
        if t.tag == "form":
            start = None if t.closes else t.start if start is None else start
        elif start is not None and t.tag in PAGE_TAGS and not t.closes:
            found.add(start)
    return found


class Reader:
    """Open elements and the text blocks met so far.  Open elements are also listed by
    tag and kind, so no step looks through the stack."""

    def __init__(self, never: set[int], around: set[int]):
        self.never, self.around = never, around
        self.blocks: list[tuple[str, int, float, int]] = []
        self.within: set[int] = set()  # blocks inside an article
        self.stack: list[tuple[str, int, bool]] = []  # tag, zone, inside an article
        self.places: dict[str, list[int]] = {}  # heights of open elements by tag
        self.block_at: list[int] = []
        self.unseen_at: list[int] = []
        self.endless: list[int] = []  # heights of unseen elements that no tag closes
        self.parts: list[str] = []
        self.linked = 0

    def flush(self) -> None:
        text = " ".join(html.unescape("".join(self.parts)).split())
        if text:
            words = text.count(" ") + 1
            _, zone, inside = self.stack[-1] if self.stack else ("", OTHER, False)
            if inside:
                self.within.add(len(self.blocks))
            self.blocks.append((text, words, min(1.0, self.linked / words), REPEATED if zone == FINAL else zone))
        self.parts, self.linked = [], 0

    def push(self, t: Token) -> None:
        height = len(self.stack)
        _, above, inside = self.stack[-1] if self.stack else ("", OTHER, False)
        zone = zone_of(t.tag, t.attrs, above, inside, t.start in self.around)
        self.stack.append((t.tag, zone, inside or zone == ARTICLE))
        self.places.setdefault(t.tag, []).append(height)
        if t.tag in BLOCK_TAGS:
            self.block_at.append(height)
        if t.tag in UNSEEN_TAGS:
            self.unseen_at.append(height)
            if t.start in self.never:
                self.endless.append(height)

    def pop(self) -> None:
        tag, height = self.stack.pop()[0], len(self.stack)
        self.places[tag].pop()
        for heights in (self.block_at, self.unseen_at, self.endless):
            if heights and heights[-1] == height:
                heights.pop()

    def pop_to(self, height: int) -> None:
        while len(self.stack) > height:
            self.pop()

    def end_unseen(self, tag: str) -> None:
        """A block ends the unclosed unseen elements right above it, and what cannot
        stand in a head ends the head."""
        if tag in BLOCK_TAGS and tag not in ("head", "title", "html"):
            while self.endless and self.unseen_at[-1] == self.endless[-1]:
                self.pop_to(self.endless[-1])
        if tag not in HEAD_TAGS and self.places.get("head") and (self.stack[-1][0] == "head" or tag == "body"):
            self.pop_to(self.places["head"][-1])

    def put(self, text: str) -> None:
        if self.stack and self.stack[-1][0] == "head" and text.strip():
            self.end_unseen("")
        if text and not self.unseen_at:
            self.parts.append(text)
            if self.places.get("a"):
                self.linked += len(text.split())

    def open(self, t: Token) -> None:
        self.end_unseen(t.tag)
        if t.tag in BLOCK_TAGS:
            self.flush()
        elif t.tag == "br":
            self.put(" ")
        if t.tag in VOID_TAGS or t.empty:
            return
        if t.tag in BLOCK_TAGS:  # ends an open p, before it an open link for p, and an open item for li
            for ended in ("p", "li") if t.tag == "li" else ("p",):
                if self.block_at and self.stack[self.block_at[-1]][0] == ended:
                    self.pop_to(self.block_at[-1])
            links = self.places.get("a")
            if t.tag == "p" and links and links[-1] > (self.block_at[-1] if self.block_at else -1):
                self.pop_to(links[-1])
        self.push(t)

    def close(self, t: Token) -> None:
        if t.tag in BLOCK_TAGS:
            self.flush()
        elif t.tag == "br":
            self.put(" ")
        if self.places.get(t.tag):
            self.pop_to(self.places[t.tag][-1])


def blocks_of(page: str) -> list[tuple[str, int, float, int]]:
    """The page's text blocks in order: text, words, link density, zone."""
    tokens, at = list(tokens_of(page)), 0
    reader = Reader(unclosed(tokens), forms_around(tokens))
    for t in tokens:
        reader.put(page[at : t.start])
        at = t.end
        if t.tag:
            (reader.close if t.closes else reader.open)(t)
    reader.put(page[at:])
    reader.flush()
    blocks = reader.blocks
    if any(zone == ARTICLE for *_, zone in blocks):  # then what stands in named parts outside it is none of it
        return [(t, w, l, REPEATED if zone == NAMED and i not in reader.within else zone) for i, (t, w, l, zone) in enumerate(blocks)]
    return blocks


def main_text(page: str, tree) -> str:
    blocks = blocks_of(page)
    figures = [(0, 0.0, OTHER), *(b[1:] for b in blocks), (0, 0.0, OTHER)]
    return "\n".join(b[0] for i, b in enumerate(blocks) if classify(tree, (*figures[i + 1], *figures[i], *figures[i + 2])))


def extract_text(pages: DataFrame, column: str = "html", out: str = "text", labelled: list[tuple] = LABELLED_BLOCKS) -> DataFrame:
    """`pages` plus the main text of each whole page.

    Blocks are joined in page order by one line end; white space inside a block is
    one space.  Null or empty html, and a page without main text, give an empty
    text; a broken page is read as far as its tags go.  A column named `out` is
    replaced.  Row-local: no shuffle."""
    tree = train_tree(labelled)

    def make():
        return lambda pages: [pa.array([main_text(p, tree) for p in texts_of(pages)], pa.string())]

    return with_arrow(pages, [column], {out: "string"}, make)
