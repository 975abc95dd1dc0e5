"""Parsing of archived pages into text units and the tree of containers they stand in.

A unit is a run of text between block-level tags or line breaks: a paragraph, heading, list item, caption or the like.
The parser takes broken markup: missing or stray end tags, unclosed paragraphs, rules in place of containers, pages cut
off anywhere, pages on a single line.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import blake2b

_CUT = re.compile(r"(<!--.*?-->|<(?:script|style)\b.*?</(?:script|style)\s*>|<[^>]*>)", re.S | re.I)
_NAME = re.compile(r"</?\s*([a-zA-Z][a-zA-Z0-9]*)")
_CHARSET = re.compile(r"charset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)
_HEAD_END = re.compile(rb"\r?\n\r?\n")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|\shidden(?=[\s>=/])", re.I)
# What HTML's elements are.
INLINE = frozenset("a abbr acronym b big button cite code del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("meta link base area col embed param source track input img wbr".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul td tr th li figcaption".split())
SELF_CLOSING = {"li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
SCOPES = frozenset("table ul ol dl div section article main aside nav header footer body".split())


@dataclass(slots=True)
class Node:
    name: str
    sig: int
    parent: int
    units: int = 0
    children: int = 0


@dataclass(slots=True)
class Unit:
    node: int
    tag: str
    text: str
    lines: list[int]
    linked: int
    hidden: bool
    links: int


@dataclass(slots=True)
class Page:
    nodes: list[Node] = field(default_factory=list)
    units: list[Unit] = field(default_factory=list)
    title: str = ""
    lang: str = ""


def declared_charset(content_type: str | None) -> str | None:
    """The charset that a content type names, lower-case and without quotes; None if it names none."""
    m = _CHARSET.search(content_type or "")
    return m[1].lower() if m else None


def body_start(content: bytes) -> int:
    """Where the HTTP header, if there is one, ends."""
    if content[:5] == b"HTTP/":
        m = _HEAD_END.search(content)
        return m.end() if m else len(content)
    return 0


def readable(content: bytes, declared: str | None) -> str:
    """The content as text for judging it: UTF-8 if it is valid, else the charset most likely by its letters."""
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError as e:
        if e.reason == "unexpected end of data":
            return content.decode("utf-8", "ignore")
    high = [b for b in content if b > 127]
    if len(high) * 6 > len(content):  # Cyrillic, one byte a letter: lower-case letters outnumber capitals
        koi = sum(0xC0 <= b < 0xE0 for b in high)
        win = sum(0xE0 <= b for b in high)
        iso = sum(0xD0 <= b < 0xF0 for b in high)
        valid = content.decode("utf-8", "ignore")
        if sum(map(len, re.findall("[Ѐ-ӿ]+", valid))) * 2 > len(high) * 0.6:
            return valid
        return content.decode("koi8-r" if koi > win and koi >= iso else "cp1251" if win >= iso else "iso-8859-5", "replace")
    for name in (declared, "cp1252"):
        if name and name not in ("utf-8", "utf8", "iso-8859-1", "latin-1"):
            try:
                return content.decode(name, "replace")
            except LookupError:
                pass
    return content.decode("cp1252", "replace")


@lru_cache(maxsize=20_000)
def _sig(tag: str, parent: str) -> int:
    text = f"{parent}>{' '.join(tag.lower().split())}"
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


#: Elements that don't hold units of their own; all others are blocks.
_OTHER = INLINE | VOID | {"br", "script", "style", "title", "html", "head", "body", "hr"}


@lru_cache(maxsize=20_000)
def _tag(piece: str) -> tuple[str, bool, bool]:
    """(element, whether it is an end tag, whether it is a block's); no element for comments and declarations."""
    m = _NAME.match(piece)
    if not m:
        return "", False, False
    name = m[1].lower()
    return name, piece[1] == "/", name not in _OTHER


def parse(text: str) -> Page:
    """The page's units and containers; ``text`` is the whole record, lines numbered from 1."""
    page = Page()
    nodes, units = page.nodes, page.units
    nodes.append(Node("body", 0, -1))
    stack = [0]
    line, start = 1, 0
    if text.startswith("HTTP/"):
        m = re.search(r"\r?\n\r?\n", text)
        start = m.end() if m else len(text)
        line += text.count("\n", 0, start)
    buf: list[str] = []
    at: list[int] = []
    linked = links = 0
    in_link = hidden_from = 0
    bold = False
    in_title = False

    def flush() -> None:
        nonlocal linked, links, bold
        if at:
            joined = " ".join((buf[0] if len(buf) == 1 else "".join(buf)).split())
            if joined:
                top = stack[-1]
                name = nodes[top].name
                nodes[top].units += 1
                units.append(Unit(top, "b" if bold and name not in HEADINGS else name, joined, at.copy(), linked, hidden_from > 0, links))
        buf.clear()
        at.clear()
        linked = links = 0
        bold = False

    def close(depth: int) -> None:
        nonlocal hidden_from
        del stack[depth:]
        if hidden_from and len(stack) < hidden_from:
            hidden_from = 0

    pieces = _CUT.split(text[start:] if start else text)
    for k, piece in enumerate(pieces):
        if not k & 1:
            if not piece:
                continue
            if piece.isspace():
                line += piece.count("\n")
                if at:
                    buf.append(" ")
                continue
            if "\n" not in piece:
                if "&" in piece:
                    piece = html.unescape(piece)
                if in_title:
                    page.title += piece
                elif piece[0] != "<":
                    if not at or at[-1] != line:
                        at.append(line)
                    buf.append(piece)
                    if in_link:
                        linked += len(piece)
                continue
            for j, part in enumerate(piece.split("\n")):
                if j:
                    line += 1
                    buf.append(" ")
                if part and not part.isspace():
                    if "&" in part:
                        part = html.unescape(part)
                    if in_title:
                        page.title += part
                    elif part.lstrip()[0] != "<" or ">" in part:
                        if not at or at[-1] != line:
                            at.append(line)
                        buf.append(part)
                        if in_link:
                            linked += len(part)
            continue
        head = piece[1:3]
        if head == "a " or head == "a>" or head == "A ":
            in_link, links = 1, links + 1
        elif head == "/a" and piece[3:4] in (">", " "):
            in_link = 0
            buf.append(" ")
        else:
            name, ends, block = _tag(piece) if len(piece) < 40 else _tag.__wrapped__(piece)
            if block:
                if at:
                    flush()
                else:
                    links, bold = 0, False
                in_link = 0
                if ends:
                    for d in range(len(stack) - 1, 0, -1):
                        if nodes[stack[d]].name == name:
                            close(d)
                            break
                else:
                    if name in CLOSES_P:
                        while len(stack) > 1 and nodes[stack[-1]].name == "p":
                            close(len(stack) - 1)
                    if name in SELF_CLOSING:
                        for d in range(len(stack) - 1, 0, -1):
                            held = nodes[stack[d]].name
                            if held in SELF_CLOSING[name]:
                                close(d)
                                break
                            if held in SCOPES:
                                break
                    top = stack[-1]
                    nodes[top].children += 1
                    nodes.append(Node(name, _sig(piece, nodes[top].name), top))
                    stack.append(len(nodes) - 1)
                    if not hidden_from and ("idden" in piece or "none" in piece) and _HIDDEN.search(piece):
                        hidden_from = len(stack)
            elif name:
                if name == "br":
                    flush()
                elif name in INLINE:
                    if name in ("b", "strong") and not ends and not at:
                        bold = True
                    if name == "a":
                        in_link = 0 if ends else 1
                elif name in ("script", "style") or name in VOID:
                    pass
                elif name == "title":
                    in_title = not ends
                elif name in ("html", "head", "body"):
                    flush()
                    if name == "html" and not ends and (g := re.search(r"\blang\s*=\s*[\"']?([\w-]+)", piece, re.I)):
                        page.lang = g[1]
                elif name == "hr":
                    flush()
                    while nodes[stack[-1]].name in ("p", "hr"):
                        close(len(stack) - 1)
                    nodes[stack[-1]].children += 1
                    nodes.append(Node("hr", _sig("<hr>", nodes[stack[-1]].name), stack[-1]))
                    stack.append(len(nodes) - 1)
        if "\n" in piece:
            line += piece.count("\n")
    flush()
    page.title = " ".join(page.title.split())
    return page
