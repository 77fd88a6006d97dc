"""Leaf blocks of a page: runs of text between the borders of block elements, with what encloses them."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from dataclasses import dataclass

# Fixed values of HTML: elements that begin and end blocks, that have no content, whose content has no tags and isn't shown,
# that hold elements of another language, and that stand for a picture or a player where one can be shown.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript title iframe".split())
FOREIGN = frozenset("svg math".split())
EMBEDDED = FOREIGN | frozenset("object audio video canvas".split())
#: On the stack these are muted: templates, and raw elements of a drawing, where they are elements like any other.
MUTED = RAW | {"template"}
#: Blocks that enclose text.
HOLDS = BLOCK - MUTED
#: Elements that an opening tag ends, up to the nearest of the elements that hold them.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}

_TAG = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>"']++|"[^"]*"|'[^']*')*+)(?:>|\Z)|</?[a-zA-Z][^>]*+(?:>|\Z)|</(?:>|[^a-zA-Z>][^>]*+(?:>|\Z))""",
    re.S,
)
_NAMES = re.compile(r"""(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")


class Element:
    """A block element that encloses text; ``parent`` is the next one around it."""

    __slots__ = ("tag", "names", "parent")

    def __init__(self, tag: str, names: tuple[str, ...], parent: Element | None):
        self.tag, self.names, self.parent = tag, names, parent


@dataclass
class Block:
    text: str
    element: Element | None  # the innermost element around it; blocks share those around them
    link: float  # share of the text in links

    def path(self) -> list[Element]:
        out, at = [], self.element
        while at is not None:
            out.append(at)
            at = at.parent
        return out[::-1]

    @property
    def tags(self) -> tuple[str, ...]:
        """Enclosing block elements, outermost first."""
        return tuple(e.tag for e in self.path())

    @property
    def names(self) -> tuple[tuple[str, ...], ...]:
        """Words of class, id, role and itemprop of each."""
        return tuple(e.names for e in self.path())


class Stack:
    """The open elements. Where each name is open is known, so that no step takes time by the depth."""

    def __init__(self):
        self.names: list[str] = []
        self.elements: list[Element | None] = []  # innermost enclosing element at each place
        self.at: dict[str, list[int]] = defaultdict(list)
        self.holders: list[int] = []
        self.near: list[int] = []  # elements that say whether the next one is of a drawing or of the page

    def push(self, name: str, attributes: str) -> None:
        place, around = len(self.names), self.elements[-1] if self.elements else None
        if name in HOLDS:
            around = Element(name, names_of(attributes), around)
            self.holders.append(place)
        if name in HOLDS or name in FOREIGN or name == "foreignobject":
            self.near.append(place)
        self.names.append(name)
        self.elements.append(around)
        self.at[name].append(place)

    def pop(self, place: int) -> None:
        """Close the element at a place and all in it."""
        while len(self.names) > place:
            self.at[self.names.pop()].pop()
            self.elements.pop()
        for places in (self.holders, self.near):
            while places and places[-1] >= place:
                places.pop()

    def last(self, name: str) -> int | None:
        places = self.at.get(name)
        return places[-1] if places else None

    def foreign(self) -> bool:
        """Whether the next element is one of a drawing or formula."""
        return bool(self.near) and self.names[self.near[-1]] in FOREIGN

    def ended_by(self, name: str) -> int | None:
        """The place of the outermost element that the opening tag of a block ends."""
        if name not in ENDS:
            return self.last("p")
        ended, holders = ENDS[name]
        held = max((p for p in map(self.last, holders) if p is not None), default=-1)
        first = []
        for own in ended | {"p"}:
            places = self.at.get(own, [])
            k = bisect_right(places, held)
            first += places[k : k + 1]
        return min(first, default=None)


def names_of(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    found = [w for m in _NAMES.finditer(attributes) for w in _PART.findall((m[1] or m[2] or m[3] or "").lower())]
    return tuple(dict.fromkeys(found))


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page in order. Character references are decoded, white space is one space; scripts, styles, titles,
    frames and templates have no text, all else has. What is never closed ends with what encloses it, or with the page; so
    does a drawing or player. Only a script, style, title or frame without an end reaches to the end of the page."""
    page = page or ""
    out: list[Block] = []
    stack = Stack()
    parts: list[str] = []
    linked = at = 0
    muted: int | None = None  # place of the outermost muted element of the stack

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, stack.elements[-1] if stack.elements else None, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text and muted is None:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            linked += len(text.strip()) if stack.at.get("a") else 0

    def pop(place: int) -> None:
        nonlocal muted
        muted = None if muted is not None and place <= muted else muted
        stack.pop(place)

    while (m := _TAG.search(page, at)) is not None:
        say(page[at : m.start()])
        at, name = m.end(), (m["name"] or "").lower()
        if not name:
            continue
        if m["end"]:
            place = stack.last(name)
            if muted is not None and (place is None or place >= muted):
                if place is not None:
                    pop(place)
                continue
            if name in BLOCK or name == "br":
                flush() if name != "br" else parts.append(" ")
            elif name in EMBEDDED:
                parts.append(" ")
            # An inline element's end doesn't reach beyond the block it is in.
            if place is not None and (name in BLOCK or not stack.holders or stack.holders[-1] < place):
                pop(place)
            continue
        if name in EMBEDDED or name in MUTED:
            parts.append(" ")
        if name not in VOID and m["attributes"].endswith("/") and (name in FOREIGN or stack.foreign()):
            continue
        if name in MUTED and (name == "template" or stack.foreign()):
            muted = len(stack.names) if muted is None else muted
        elif name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = len(page) if end is None else end.start()
            continue
        elif muted is not None:
            pass
        elif name in BLOCK:
            flush()
            if (place := stack.ended_by(name)) is not None:
                pop(place)
        elif name == "br":
            parts.append(" ")
        elif name == "a" and stack.at.get("a"):
            pop(stack.at["a"][0])
        if name not in VOID:
            stack.push(name, m["attributes"])
    say(page[at:])
    flush()
    return out
