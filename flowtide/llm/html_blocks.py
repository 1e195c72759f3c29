"""Splitting a page into its blocks: the leaf sequence that the labeller reads.

Tags, comments and attributes end where HTML's own rules end them, in time
proportional to the page, whatever it holds. Two rules are kinder than a browser's, so that
broken markup hides no text: a quote that is never closed ends with its tag, and an
element of HIDDEN that is never closed hides nothing.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from dataclasses import dataclass
from html import unescape

#: Elements that begin and end a block of text.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html iframe label legend li main menu nav ol optgroup option p pre section select summary "
    "table tbody td textarea tfoot th thead title tr ul".split()
)
#: Elements that hold characters alone, up to their closing tag or the end of the page, and none of the page's text.
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
#: Elements whose content isn't shown as text, if they are closed.
HIDDEN = frozenset("noscript object svg template".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element that begins closes an open one of these kinds, up to the given limits.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

MARKUP = re.compile(r"<(?:(/?)([A-Za-z][^\t\n\f\r />]*+)|(!--)|[!?/])")
COMMENT_END = re.compile(r"(?<=<!--)-?>|--!?>")
GAP = re.compile(r"[\t\n\f\r /]*+")
NAME = re.compile(r"=?[^\t\n\f\r />=]*+")
EQUALS = re.compile(r"[\t\n\f\r ]*+=[\t\n\f\r ]*+")
BARE = re.compile(r"[^\t\n\f\r >]*+")
WORDS = re.compile(r"[A-Za-z]+")


class Path:
    """The open block elements: the innermost one's name and words of its class, id and role, and the path around it.

    Paths share what is around them, so that a page may be nested as deep as it likes. `vector` is kept for the labeller.
    """

    __slots__ = ("around", "names", "vector")

    def __init__(self, around: Path | None, names: tuple[str, ...]):
        self.around, self.names, self.vector = around, names, None

    def all_names(self) -> tuple[str, ...]:
        levels, at = [], self
        while at is not None:
            levels.append(at.names)
            at = at.around
        return tuple(n for names in reversed(levels) for n in names)


@dataclass
class Block:
    text: str  # decoded, with single spaces
    path: Path
    linked: int  # characters inside links


@dataclass
class Tag:
    name: str
    closes: bool
    empty: bool  # written with a slash at its end
    attributes: dict[str, str]


@functools.cache
def _ends(name: str) -> re.Pattern:
    return re.compile(rf"<(/?){re.escape(name)}(?=[\t\n\f\r />])[^>]*+>?", re.I)


class Page:
    """A page's markup from left to right; what was found missing once isn't looked for again."""

    def __init__(self, html: str):
        self.html = html
        self.never: set[str] = set()  # quotes that don't occur from here on
        self.pairs: dict[str, dict[int, int]] = {}

    def attributes(self, at: int) -> tuple[dict[str, str], bool, int]:
        """Attributes from behind a tag's name on, whether a slash ends them, and the place behind the tag (-1: none)."""
        html, found = self.html, {}
        while True:
            gap = GAP.match(html, at)
            at = gap.end()
            if at >= len(html):
                return found, False, -1
            if html[at] == ">":
                return found, gap[0].endswith("/"), at + 1
            name, value = NAME.match(html, at), ""
            at = name.end()
            equals = EQUALS.match(html, at)
            if equals:
                at = equals.end()
                quote = html[at : at + 1]
                if quote in ('"', "'") and quote:
                    to = -1 if quote in self.never else html.find(quote, at + 1)
                    closed = to >= 0
                    if not closed:
                        self.never.add(quote)
                        to = html.find(">", at)
                        if to < 0:
                            return found, False, -1
                    value, at = html[at + 1 : to], to + closed
                else:
                    bare = BARE.match(html, at)
                    value, at = bare[0], bare.end()
            found.setdefault(name[0].lower(), value)

    def markup(self, at: int):
        """The next tag, comment or the like from `at` on: (where it begins, where it ends, its Tag if it is one)."""
        html, start = self.html, at
        while (lt := html.find("<", start)) >= 0:
            m = MARKUP.match(html, lt)
            if not m:
                start = lt + 1
                continue
            if m[2]:
                found, empty, end = self.attributes(m.end())
                return lt, end if end >= 0 else len(html), Tag(m[2].lower(), bool(m[1]), empty, found) if end >= 0 else None
            if m[3]:
                close = COMMENT_END.search(html, m.end())
                return lt, close.end() if close else len(html), None
            close = html.find(">", m.end())
            return lt, close + 1 if close >= 0 else len(html), None
        return None

    def raw_end(self, name: str, at: int) -> int:
        """Where the content of a RAW element ends."""
        return next((m.end() for m in _ends(name).finditer(self.html, at) if m[1]), len(self.html))

    def hidden_end(self, name: str, at: int) -> int:
        """Where an element of HIDDEN that opens before `at` ends, by pairs of equal names; `at` itself if it doesn't."""
        if name not in self.pairs:
            open_, pairs = [], {}
            for m in _ends(name).finditer(self.html):
                if not m[1]:
                    open_.append(m.start())
                elif open_:
                    pairs[open_.pop()] = m.end()
            self.pairs[name] = pairs
        return self.pairs[name].get(at, -1)


def _names(tag: Tag) -> tuple[str, ...]:
    return (tag.name, *("." + w.lower() for key in ("class", "id", "role") for w in WORDS.findall(tag.attributes.get(key, ""))))


class Blocks:
    """The blocks of a page as its pieces of text and its tags come."""

    def __init__(self):
        self.out: list[Block] = []
        self.stack: list[tuple[str, Path]] = [("", Path(None, ()))]
        self.open_names: Counter[str] = Counter()
        self.words: list[str] = []
        self.linked = self.links = 0

    def flush(self) -> None:
        if self.words:
            text = " ".join("".join(self.words).split())
            if text:
                self.out.append(Block(text, self.stack[-1][1], self.linked))
            self.words.clear()
        self.linked = 0

    def text(self, piece: str) -> None:
        if piece:
            self.words.append(unescape(piece) if "&" in piece else piece)
            if self.links:
                self.linked += len(piece)

    def drop(self, kinds: set[str], limits: tuple[str, ...] | set[str]) -> None:
        """Closes the innermost open element of some kinds and all inside it, unless a limit is nearer."""
        if not any(self.open_names[k] for k in kinds):
            return
        at = next(i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] in kinds or self.stack[i][0] in limits)
        if self.stack[at][0] in kinds:
            self.open_names.subtract(name for name, _ in self.stack[at:])
            del self.stack[at:]

    def close(self, name: str) -> None:
        if name == "a":
            self.links = max(0, self.links - 1)
        if name in BLOCK:
            self.flush()
            self.drop({name}, ("article", "body", "table") if name in ("p", "li", "td", "th", "tr") else ())

    def open(self, tag: Tag) -> None:
        if tag.name == "a":
            self.links += 1
        elif tag.name == "br":
            self.words.append(" ")
        elif tag.name in BLOCK:
            self.flush()
            if self.stack[-1][0] == "p":
                self.drop({"p"}, ())
            if tag.name in IMPLIED:
                self.drop(*IMPLIED[tag.name])
            if tag.name not in VOID:
                self.stack.append((tag.name, Path(self.stack[-1][1], _names(tag))))
                self.open_names[tag.name] += 1
                self.links = 0 if tag.name not in ("li", "p", "div", "td") else self.links


def blocks(html: str | None) -> list[Block]:
    """Blocks in page order, without comments and the content of RAW and HIDDEN elements."""
    if not html:
        return []
    page, found, at = Page(html), Blocks(), 0
    while markup := page.markup(at):
        start, end, tag = markup
        found.text(html[at:start])
        at = end
        if tag is None:
            continue
        if tag.closes:
            found.close(tag.name)
        elif tag.name in RAW:
            if tag.name in BLOCK:
                found.flush()
            at = page.raw_end(tag.name, end)
        elif tag.name in HIDDEN:
            if not (tag.empty and tag.name == "svg"):
                at = max(end, page.hidden_end(tag.name, start))
        else:
            found.open(tag)
    found.text(html[at:])
    found.flush()
    return found.out
