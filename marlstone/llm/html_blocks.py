"""Leaf blocks of an HTML page: the text between block boundaries, with its path of open elements."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

#: Fixed values of HTML: elements that bound blocks, that hold no text for readers, and that close themselves.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table "
    "tbody td tfoot th thead title tr ul".split()
)
HIDDEN = frozenset("script style template iframe svg textarea canvas audio video head".split())
RAW = frozenset("script style textarea title iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the key ends an open element of the value.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

#: A comment ends at `-->` or `--!>`, or at once in `<!-->` and `<!--->`.
_TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?][^>]*>",
    re.S,
)
_OPEN = re.compile(r"<!--.*()()()()()()\Z", re.S)
_NAMES = re.compile(r"""(?:class|id|role|itemprop|aria-label|rel)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
_WORDS = re.compile(r"[a-z]+")
_UNSEEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|visibility\s*:\s*hidden|aria-hidden\s*=\s*["']?true""", re.I)


@dataclass
class Leaf:
    text: str  # decoded, white space folded, trimmed; never empty
    path: tuple[str, ...]  # tokens of the open elements, outermost first
    link_chars: int


def _tokens(name: str, attributes: str) -> tuple[str, ...]:
    """Tag, and the words of the attributes that name an element's purpose."""
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return (f"<{name}>",)
    found = [f"<{name}>"]
    for value in _NAMES.findall(attributes):
        found += _WORDS.findall(value.lower())
    if _UNSEEN.search(attributes):
        found.append("(hidden)")
    return tuple(found)


def leaf_blocks(page: str) -> list[Leaf]:
    """All blocks with text, in page order; scripts, styles and other unseen elements give none."""
    leaves: list[Leaf] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[str] = []
    link_depth = link_chars = 0
    skip_until, at, hidden = "", 0, 0
    folded = page.lower() if any(f"<{x}" in page or f"<{x.upper()}" in page for x in RAW) else ""

    def flush() -> None:
        nonlocal link_chars
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                leaves.append(Leaf(text, tuple(t for _, tokens in stack for t in tokens), link_chars))
            pieces.clear()
        link_chars = 0

    def pop_to(k: int) -> None:
        nonlocal hidden
        for name, _ in stack[k:]:
            hidden -= name in HIDDEN
        del stack[k:]

    end, last = len(page), page.rfind(">")
    while at < end:
        # behind the last ">" only an unclosed comment can follow
        tag = _TAG.search(page, at) if at <= last else _OPEN.search(page, at)
        stop = tag.start() if tag else end
        if stop > at and not hidden:
            piece = page[at:stop]
            pieces.append(html.unescape(piece))  # a reference lies within one text node
            if link_depth:
                link_chars += len(piece)
        if not tag:
            break
        at = tag.end()
        name = tag[2] or tag[5]
        if not name:
            continue
        name, closing, attributes = name.lower(), tag[1] or tag[4], tag[3] or tag[6] or ""
        if closing:
            if name == "a":
                link_depth = max(0, link_depth - 1)
            elif name in BLOCK or name in HIDDEN:
                flush()
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        pop_to(k)
                        break
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name == "a":
            link_depth = 1
            continue
        if name not in BLOCK and name not in HIDDEN:
            continue
        flush()
        if name == "body":
            for k in range(len(stack)):
                if stack[k][0] == "head":
                    pop_to(k)
                    break
        if name in BLOCK and name != "title":
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    pop_to(k)
                    break
                if stack[k][0] not in ("p",):
                    break
        for other in CLOSES.get(name, ()):
            if stack and stack[-1][0] == other:
                pop_to(len(stack) - 1)
        if name in RAW:
            # no tags inside: go on behind the end tag
            close = folded.find(f"</{name}", at)
            if name == "title" or name in HIDDEN:
                at = end if close < 0 else close
                if close >= 0:
                    closed = page.find(">", close)
                    at = end if closed < 0 else closed + 1
            continue
        if name in VOID or attributes.endswith("/") and name in HIDDEN:
            continue
        stack.append((name, _tokens(name, attributes)))
        hidden += name in HIDDEN
    flush()
    return leaves
