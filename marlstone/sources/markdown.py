"""Markdown (S5, S6): a hand-written CommonMark subset, as no parser is installed.

Headings (both styles), paragraphs, fenced code, lists, block quotes, tables with pipes, links,
emphasis and code spans are read; indented code, HTML blocks and thematic breaks give no blocks.
Not covered: nested emphasis rules in full, link reference definitions, lazy continuation in all cases.
"""

from __future__ import annotations

import math
import re
from datetime import date, datetime

import yaml

#: Bounds of front matter.
MAX_RAW, MAX_SCALAR, MAX_DEPTH, MAX_NODES = 65_536, 16_384, 20, 10_000

_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})\s*([^`]*)$")
_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])([ \t]+|$)(.*)$")
_QUOTE = re.compile(r" {0,3}> ?(.*)$")
_DELIMITER_ROW = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_HTML = re.compile(r" {0,3}<(?:[A-Za-z/!?])")
_LINK = re.compile(r"(!?)\[((?:[^\[\]\\]|\\.|\[[^\]]*\])*)\]\(\s*<?([^\s)>]*)>?(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?\s*\)")
_AUTO = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*)>")
_CODE = re.compile(r"(`+)(.+?)(?<!`)\1(?!`)", re.S)
_MARKS = re.compile(r"(\*\*|__|\*|_|~~)(?=\S)(.+?)(?<=\S)\1", re.S)


def inline(text: str, links: list[str]) -> str:
    """Shown text of inline markup; link and image targets are added to links."""
    held: list[str] = []

    def hold(s: str) -> str:
        held.append(s)
        return f"\0{len(held) - 1}\0"

    def link(m: re.Match) -> str:
        if m[3] and m[3] not in links:
            links.append(m[3])
        return m[2]

    def auto(m: re.Match) -> str:
        if m[1] not in links:
            links.append(m[1])
        return hold(m[1])

    text = _CODE.sub(lambda m: hold(m[2].strip() if m[2].strip() else m[2]), text)
    text = re.sub(r"\\([!-/:-@\[-`{-~])", lambda m: hold(m[1]), text)
    text = _AUTO.sub(auto, text)
    while _LINK.search(text):
        text = _LINK.sub(link, text, count=1)
    while _MARKS.search(text):
        text = _MARKS.sub(lambda m: m[2], text)
    text = re.sub(r"[ \t]*\n[ \t]*", "\n", text)
    while "\0" in text and re.search("\0\\d+\0", text):
        text = re.sub("\0(\\d+)\0", lambda m: held[int(m[1])], text)
    return text


def front_matter(text: str) -> tuple[str, dict, int]:
    """Rest of the text, metadata, and the number of lines before it."""
    lines = text.split("\n")
    if lines[0] != "---" or "---" not in lines[1:]:
        return text, {}, 0
    end = lines.index("---", 1)
    raw, rest = "\n".join(lines[1:end]), "\n".join(lines[end + 1 :])
    try:
        if len(raw) > MAX_RAW:
            raise ValueError("front matter is too long")
        return rest, {"front_matter": _bounded(_load(raw))}, end + 1
    except (ValueError, TypeError, RecursionError, yaml.YAMLError):
        return rest, {"front_matter_raw": raw[:MAX_RAW]}, end + 1


class _Strict(yaml.SafeLoader):
    """Rejects repeated keys."""

    def construct_mapping(self, node, deep=False):
        keys = [self.construct_object(k, deep=True) for k, _ in node.value]
        if len({repr(k) for k in keys}) != len(keys):
            raise yaml.constructor.ConstructorError(None, None, "a key is repeated", node.start_mark)
        return super().construct_mapping(node, deep)


def _load(raw: str):
    depth = 0
    for n, event in enumerate(yaml.parse(raw, Loader=yaml.SafeLoader), 1):
        depth += isinstance(event, yaml.CollectionStartEvent) - isinstance(event, yaml.CollectionEndEvent)
        if n > MAX_NODES or depth > MAX_DEPTH or isinstance(event, yaml.AliasEvent) or getattr(event, "anchor", None):
            raise ValueError("front matter has anchors or is too large")
    return yaml.load(raw, Loader=_Strict)


def _bounded(value, depth: int = 0):
    if depth > MAX_DEPTH or isinstance(value, str) and len(value) > MAX_SCALAR or isinstance(value, float) and not math.isfinite(value):
        raise ValueError("front matter is too large")
    if isinstance(value, dict):
        if any(not isinstance(k, str) or len(k) > MAX_SCALAR for k in value):
            raise TypeError("front matter keys must be strings")
        return {k: _bounded(v, depth + 1) for k, v in value.items()}
    if isinstance(value, list):
        return [_bounded(v, depth + 1) for v in value]
    if isinstance(value, (date, datetime)):
        return value.isoformat()
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    raise TypeError("front matter holds no JSON value")


def _cells(line: str) -> list[str]:
    parts = re.split(r"(?<!\\)\|", line.strip())
    if parts and not parts[0].strip():
        parts = parts[1:]
    if parts and not parts[-1].strip():
        parts = parts[:-1]
    return [p.strip().replace("\\|", "|") for p in parts]


def blocks_of(text: str, offset: int = 0) -> tuple[list[dict], list[str]]:
    """Blocks (kind, text, meta) and links of a Markdown text; line numbers are of the file."""
    blocks: list[dict] = []
    links: list[str] = []
    headings: list[tuple[int, str]] = []

    def add(kind: str, shown: str, first: int, last: int, **more) -> None:
        if shown.strip():
            meta = {"heading_path": [t for _, t in headings], "line_start": first + 1 + offset, "line_end": last + offset} | more
            blocks.append({"kind": kind, "text": shown, "meta": meta})

    def heading(level: int, raw: str, first: int, last: int) -> None:
        shown = inline(raw, links)
        headings[:] = [h for h in headings if h[0] < level] + [(level, shown)]
        add("heading", shown, first, last)

    def walk(lines: list[tuple[int, str]], in_list: bool) -> None:
        k = 0
        kind = "list_item" if in_list else "paragraph"
        while k < len(lines):
            number, line = lines[k]
            if not line.strip():
                k += 1
                continue
            fence = _FENCE.match(line)
            if fence and not (fence[1][0] == "`" and "`" in fence[2]):
                body, j = [], k + 1
                close = re.compile(rf" {{0,3}}{re.escape(fence[1][0])}{{{len(fence[1])},}}[ \t]*$")
                while j < len(lines) and not close.match(lines[j][1]):
                    body.append(lines[j][1])
                    j += 1
                content = "\n".join(body) + "\n" if body else ""
                last = lines[min(j, len(lines) - 1)][0] + 1
                if content:
                    language = fence[2].strip().split(maxsplit=1)
                    meta = {"heading_path": [t for _, t in headings], "line_start": number + 1 + offset, "line_end": last + offset}
                    blocks.append({"kind": "code", "text": content, "meta": meta | ({"language": language[0]} if language else {})})
                k = j + 1
                continue
            atx = _ATX.match(line)
            if atx:
                heading(len(atx[1]), (atx[2] or "").strip(), number, number + 1)
                k += 1
                continue
            if _RULE.match(line):
                k += 1
                continue
            if line.startswith(("    ", "\t")):
                while k < len(lines) and (lines[k][1].startswith(("    ", "\t")) or not lines[k][1].strip()):
                    k += 1
                continue
            if _HTML.match(line):
                while k < len(lines) and lines[k][1].strip():
                    k += 1
                continue
            item = _ITEM.match(line)
            if item:
                width = len(item[1]) + len(item[2]) + (len(item[3]) if 0 < len(item[3]) < 5 else 1)
                own, j = [(number, item[4])], k + 1
                while j < len(lines):
                    later = lines[j][1]
                    if later.startswith(" " * width) or not later.strip():
                        own.append((lines[j][0], later[width:]))
                    elif _ITEM.match(later) or not own[-1][1].strip() or _FENCE.match(later) or _ATX.match(later) or _RULE.match(later):
                        break
                    else:
                        own.append((lines[j][0], later.lstrip()))
                    j += 1
                walk(own, True)
                k = j
                continue
            quote = _QUOTE.match(line)
            if quote:
                own, j = [], k
                while j < len(lines) and lines[j][1].strip() and ((q := _QUOTE.match(lines[j][1])) or own):
                    own.append((lines[j][0], q[1] if q else lines[j][1]))
                    j += 1
                walk(own, in_list)
                k = j
                continue
            if "|" in line and k + 1 < len(lines) and _DELIMITER_ROW.match(lines[k + 1][1]) and len(_cells(lines[k + 1][1])) == len(_cells(line)):
                width = len(_cells(line))
                j = k
                while j < len(lines) and lines[j][1].strip() and not (j > k + 1 and (_FENCE.match(lines[j][1]) or _ATX.match(lines[j][1]))):
                    if j != k + 1:
                        row = (_cells(lines[j][1]) + [""] * width)[:width]
                        add("table_row", " | ".join(inline(c, links) for c in row), lines[j][0], lines[j][0] + 1)
                    j += 1
                k = j
                continue
            j = k + 1
            level = 0
            while j < len(lines) and lines[j][1].strip():
                later = lines[j][1]
                under = _SETEXT.match(later)
                if under:
                    level = 1 if under[1][0] == "=" else 2
                    break
                if _FENCE.match(later) or _ATX.match(later) or _RULE.match(later) or _QUOTE.match(later) or ((i := _ITEM.match(later)) and i[4] and not (i[2][0].isdigit() and i[2][:-1] != "1")):
                    break
                j += 1
            raw = "\n".join(x.lstrip() for _, x in lines[k:j]).rstrip()
            last = lines[j - 1][0] + 1
            if level:
                heading(level, raw, number, last + 1)
                j += 1
            else:
                add(kind, inline(raw, links), number, last)
            k = j

    walk(list(enumerate(text.split("\n"))), False)
    return blocks, links
