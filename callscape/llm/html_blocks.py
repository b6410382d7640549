"""Leaf text blocks of HTML pages, in page order, with what surrounds them."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Element names.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math noscript "
    "object q s samp small span strike strong sub sup svg time tt u var wbr nobr".split())
RAW = frozenset("script style template textarea iframe title".split())
VOID = frozenset("area base col embed hr img input link meta param source track wbr br".split())
CLOSES_SAME = frozenset("p li dt dd tr td th option".split())
FOREIGN = frozenset("svg math".split())
# Elements that end svg and math.
ENDS_FOREIGN = frozenset(
    "article aside b big blockquote body br center code dd div dl dt em embed footer form h1 h2 h3 h4 "
    "h5 h6 head header hr i img li main menu meta nav nobr ol p pre ruby s section small span strong "
    "strike sub sup table tt u ul var".split())

# A tag's attributes as HTML's tokenizer reads them: a name ends at space, "/", ">" or "=", and a
# value is quoted or ends at space or ">". What the page's end cuts off is no text.
_VALUE = r"\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+"
_ATTR = re.compile(rf"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+({_VALUE})?+)?+")
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)"
    rf"(?P<attrs>(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:{_VALUE})?+)?+)*+)(?:>|\Z)"
    r"|<(?:[!?]|/(?!\Z))[^>]*+(?:>|\Z)",
    re.S)
_NAME = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    tags: tuple[str, ...]
    names: frozenset[str]
    linked: float  # share of the characters inside links


@dataclass
class _Open:
    tag: str
    names: frozenset[str]


@dataclass
class _Reader:
    stack: list[_Open] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    link_chars: int = 0
    in_link: bool = False
    foreign: int = 0  # open svg and math elements
    blocks: list[Block] = field(default_factory=list)

    def text(self, raw: str) -> None:
        if raw:
            self.parts.append(html.unescape(raw))
            if self.in_link:
                self.link_chars += len(raw)

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                names = frozenset().union(*[o.names for o in self.stack])
                tags = tuple(o.tag for o in self.stack)
                share = min(1.0, self.link_chars / max(len(text), 1))
                self.blocks.append(Block(text, tags, names, share))
        self.parts, self.link_chars = [], 0

    def open(self, tag: str, names: frozenset[str]) -> None:
        if tag in CLOSES_SAME:
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k].tag == tag:
                    del self.stack[k:]
                    break
                if self.stack[k].tag in ("ul", "ol", "table", "dl", "select", "div", "article",
                                         "section", "aside", "nav"):
                    break
        elif self.stack and self.stack[-1].tag == "p":  # a block element ends a paragraph
            self.stack.pop()
        self.stack.append(_Open(tag, names))

    def close(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].tag == tag:
                del self.stack[k:]
                return


def _names(attrs: str) -> frozenset[str]:
    """The words of the class, id and role of a tag; of a repeated attribute the first counts."""
    found: dict[str, str] = {}
    for name, value in _ATTR.findall(attrs):
        found.setdefault(name.lower(), value)
    return frozenset(word for key in ("class", "id", "role")
                     for word in _NAME.findall(found.get(key, "").lower()))


def _raw_end(page: str, tag: str, at: int) -> int | None:
    """Where the content of a raw element that begins at ``at`` has ended, if it ends."""
    end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
    return end.end() if end else None


def leaf_blocks(page: str) -> list[Block]:
    """The texts between block boundaries. Markup, comments and the content of scripts, styles,
    templates, frames, titles and text areas are left out, to the page's end if such an element is
    not closed; character references are decoded; white space becomes one space. Elements of svg and
    math stand within a line, and their texts are kept."""
    reader, at = _Reader(), 0
    while (m := _TOKEN.search(page, at)) is not None:
        reader.text(page[at : m.start()])
        at = m.end()
        tag = (m["name"] or "").lower()
        if not tag:
            if m["data"] is not None and reader.foreign:
                reader.parts.append(m["data"])
            elif m["data"] is not None:  # outside svg and math a bogus comment, up to the first >
                at = page.find(">", m.start()) + 1 or len(page)
            continue
        empty = m["attrs"].endswith("/")
        if tag in FOREIGN:
            reader.foreign = max(0, reader.foreign + (-1 if m["close"] else not empty))
        elif reader.foreign and tag in ENDS_FOREIGN and not m["close"]:
            reader.foreign = 0
        if tag == "br":
            reader.text(" ")
        elif tag in RAW and not (reader.foreign and tag == "title"):
            if not m["close"] and not (reader.foreign and empty):
                end = _raw_end(page, tag, at)
                at = end or (at if empty else len(page))
        elif tag in INLINE:
            if tag == "a":
                reader.in_link = not m["close"]
        elif reader.foreign and (tag not in ENDS_FOREIGN):
            if tag in ("text", "title", "desc", "foreignobject", "mtr", "mtd"):
                reader.text(" ")
        else:
            reader.flush()
            if m["close"]:
                reader.in_link = False
                reader.close(tag)
            elif tag not in VOID:
                reader.open(tag, _names(m["attrs"]))
    reader.text(page[at:])
    reader.flush()
    return reader.blocks
