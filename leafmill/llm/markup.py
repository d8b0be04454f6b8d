"""Pages as a flat run of nodes and texts: the small helper of the HTML extraction.

A page is cut into tags and texts by one pattern; a stack of its structural
elements gives every text the id of the node that holds it. A node's id is a hash
of its parent's id and its own label (name, id and classes),
so equal places of two pages have equal ids and no path is ever spelled out.
Inline elements make no nodes. Time and memory grow with the page's length.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import xxhash

#: Elements of HTML by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: An opening tag closes open elements of these names, up to the nearest of those.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "thead": ({"tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "body": ({"head"}, {"html"}),
}
TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:-->|--!>|\Z))"
    r"|<(?P<slash>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?/][^>]*>?"
    r"|(?P<broken><[a-zA-Z/][^<>]*\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S,
)
NAMED = re.compile(r"(?<![^\s\"'/])(id|class|role|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
ROOT = 0


class Node(NamedTuple):
    """An element that holds texts: its place's id, that of its parent, its name and label."""

    id: int
    parent: int
    name: str
    label: str


class Text(NamedTuple):
    """A stretch of text with the node that holds it, whether it is inside a link, and its block's number."""

    node: int
    block: int
    link: bool
    text: str


def hashed(*parts: object) -> int:
    """A signed 64-bit hash of the parts."""
    return xxhash.xxh64_intdigest("\x00".join(map(str, parts)).encode("utf-8", "replace")) - (1 << 63)


def label(name: str, rest: str) -> str:
    """An element's name, id, classes and role; numbers of ids, and those of three digits or more in classes, as ``0``."""
    if not rest.strip():
        return name
    found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in NAMED.finditer(rest)}
    marks = ["#" + re.sub(r"\d+", "0", found["id"])] if found.get("id") else []
    marks += ["." + re.sub(r"\d{3,}", "0", c) for c in sorted(set(found.get("class", "").split()))]
    marks += [f"@{found['role']}"] if found.get("role") else []
    return name + "".join(marks).lower() + ("!" if "hidden" in found else "")


def read(page: str | None) -> Iterator[Node | Text]:
    """The page's structural nodes as they open, and its texts, in page order; character references are decoded.

    Contents of scripts, styles, titles and comments give no text. A tag that never
    ends is left out, as browsers do; a ``<`` that begins no tag is text.
    """
    page = page or ""
    stack: list[Node] = []
    open_names: dict[str, int] = {}
    links = block = at = 0

    def close(count: int) -> None:
        for _ in range(count):
            open_names[stack.pop().name] -= 1

    def close_up_to(names: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> None:
        """Close the outermost open element of ``names`` that stands inside the nearest of ``stop``."""
        if not any(open_names.get(n) for n in names):
            return
        count = 0
        for depth, node in enumerate(reversed(stack), 1):
            if node.name in names:
                count = depth
            if node.name in stop:
                break
        close(count)

    while at < len(page):
        m = TOKEN.match(page, at)
        if m is None:  # a tag whose quotes never close: read it up to the next ">"
            end = page.find(">", at)
            at = len(page) if end < 0 else end + 1
            continue
        at = m.end()
        if (text := m["text"]) is not None:
            if text == "<":  # begins no tag; the text that follows goes with it
                following = re.compile(r"[^<]*").match(page, at)
                text, at = text + following[0], following.end()
            yield Text(stack[-1].id if stack else ROOT, block, links > 0, html.unescape(text))
            continue
        if not m["name"]:
            continue
        name = m["name"].lower()
        if m["slash"]:
            if name == "a":
                links = max(0, links - 1)
            elif name == "p" and not open_names.get("p") or name in VOID:
                block += name != "wbr"
            elif name not in INLINE:
                block += 1
                if open_names.get(name):
                    depth = next(d for d, node in enumerate(reversed(stack), 1) if node.name == name)
                    close(depth)
            continue
        if name in INLINE:
            links += name == "a" and not links
            continue
        if name == "br":
            yield Text(stack[-1].id if stack else ROOT, block, links > 0, " ")
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in VOID:
            block += name == "hr"
            continue
        block += 1
        if name in ENDS_PARAGRAPH:
            close_up_to({"p"}, {"button", "td", "th", "table", "body"})
            links = 0
        if name in CLOSES:
            close_up_to(*CLOSES[name])
        parent = stack[-1].id if stack else ROOT
        own = label(name, m["rest"])
        node = Node(hashed(parent, own), parent, name, own)
        if not m["rest"].rstrip().endswith("/") or name not in ("svg", "path"):
            stack.append(node)
            open_names[name] = open_names.get(name, 0) + 1
        yield node
