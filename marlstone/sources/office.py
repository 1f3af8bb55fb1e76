"""XLSX and DOCX over the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET

from ..operators.tables import TableError, row_text, table_rows
from .decode import ParseError, normalise

#: Bounds of a workbook, and built-in date formats.
MAX_NODES, MAX_CELLS, MAX_ROW, MAX_COLUMN, MAX_MERGED, MAX_MERGED_TOTAL = 2_000_000, 1_000_000, 1_048_576, 16_384, 100_000, 1_000_000
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
MOST_SAMPLES = 5
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _local(element) -> str:
    return element.tag.rpartition("}")[2]


def _root(archive: zipfile.ZipFile, name: str):
    data = archive.read(name)
    if b"<!DOCTYPE" in data[:4096] or b"<!ENTITY" in data:
        raise ParseError("XML_ENTITY_FORBIDDEN")
    return ET.fromstring(data)


def coordinate(reference: str) -> tuple[int, int]:
    """Row and column of a reference like B7, within the sheet's limits."""
    m = re.fullmatch(r"\$?([A-Z]{1,3})\$?([1-9]\d{0,6})", reference or "")
    if not m:
        raise ParseError("XLSX_MALFORMED")
    column = 0
    for c in m[1]:
        column = column * 26 + ord(c) - 64
    if int(m[2]) > MAX_ROW or column > MAX_COLUMN:
        raise ParseError("XLSX_MALFORMED")
    return int(m[2]), column


def area(reference: str) -> int:
    """Cells of a range."""
    a, _, b = reference.partition(":")
    (r1, c1), (r2, c2) = coordinate(a), coordinate(b or a)
    if r2 < r1 or c2 < c1:
        raise ParseError("XLSX_MALFORMED")
    return (r2 - r1 + 1) * (c2 - c1 + 1)


def parse_xlsx(data: bytes) -> tuple[list[dict], list[dict]]:
    """Blocks and warnings of the visible sheets; formulas show their cached value, else themselves."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
        book, rels = _root(archive, "xl/workbook.xml"), _root(archive, "xl/_rels/workbook.xml.rels")
        targets = {r.get("Id"): r.get("Target") for r in rels}
        shared = ["".join(t.text or "" for t in si.iter() if _local(t) == "t" and True) for si in _root(archive, "xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in archive.namelist() else []
        dated, epoch = _date_styles(archive), datetime(1904, 1, 1) if any(_local(e) == "workbookPr" and e.get("date1904") in ("1", "true") for e in book) else datetime(1899, 12, 30)
        blocks, warnings, used, nodes, cells, merged_total = [], [], 0, 0, 0, 0
        for sheet in (s for e in book if _local(e) == "sheets" for s in e):
            title, target = sheet.get("name"), targets[sheet.get(_REL)]
            part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            rows: dict[int, dict[int, object]] = {}
            formulas: list[str] = []
            merged: set[str] = set()
            for e in _root(archive, part).iter():
                nodes += 1
                if nodes > MAX_NODES:
                    raise ParseError("TABLE_XML_NODE_LIMIT_EXCEEDED")
                if _local(e) == "mergeCell" and e.get("ref") not in merged:
                    merged.add(e.get("ref"))
                    size = area(e.get("ref"))
                    merged_total += size
                    if size > MAX_MERGED:
                        raise ParseError("TABLE_MERGED_CELL_LIMIT_EXCEEDED")
                    if merged_total > MAX_MERGED_TOTAL:
                        raise ParseError("TABLE_TOTAL_MERGED_CELL_LIMIT_EXCEEDED")
                if _local(e) != "c":
                    continue
                cells += 1
                if cells > MAX_CELLS:
                    raise ParseError("TABLE_CELL_LIMIT_EXCEEDED")
                row, column = coordinate(e.get("r"))
                value, bare = _cell_value(e, shared, dated, epoch)
                if bare:
                    formulas.append(e.get("r"))
                if value is not None:
                    rows.setdefault(row, {})[column] = value
            if sheet.get("state", "visible") != "visible":
                warnings.append({"code": "SHEET_HIDDEN", "metadata": {"sheet": title}})
                continue
            ordered = [(r, [rows[r].get(c) for c in range(1, max(rows[r]) + 1)]) for r in sorted(rows)]
            own, used = table_rows(ordered, title, used=used)
            if formulas:
                warnings.append({"code": "FORMULA_CACHE_MISSING", "metadata": {"sheet": title, "count": len(formulas), "sample_cells": formulas[:MOST_SAMPLES]}})
            if not own:
                warnings.append({"code": "SHEET_EMPTY", "metadata": {"sheet": title}})
            blocks += own
        return blocks, warnings
    except TableError as e:
        raise ParseError(e.code) from e
    except (zipfile.BadZipFile, KeyError, ET.ParseError, ValueError, AttributeError) as e:
        raise e if isinstance(e, ParseError) else ParseError("XLSX_MALFORMED") from e


def _date_styles(archive: zipfile.ZipFile) -> list[bool]:
    if "xl/styles.xml" not in archive.namelist():
        return []
    styles = _root(archive, "xl/styles.xml")
    custom = {int(e.get("numFmtId")): e.get("formatCode", "") for e in styles.iter() if _local(e) == "numFmt"}
    is_date = lambda n: n in DATE_FORMATS or n in custom and bool(re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", custom[n]).lower()))
    return [is_date(int(x.get("numFmtId", 0))) for e in styles if _local(e) == "cellXfs" for x in e]


def _cell_value(cell, shared: list[str], dated: list[bool], epoch: datetime) -> tuple[object, bool]:
    """Value of a cell, and whether it is a formula without a cached value."""
    kind, style = cell.get("t", "n"), int(cell.get("s", 0))
    parts = {_local(x): x for x in cell}
    raw = parts["v"].text if "v" in parts else None
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter() if _local(t) == "t"), False
    if raw is None or raw == "":
        if "f" in parts and parts["f"].text:
            return parts["f"].text if parts["f"].text.startswith("=") else f"={parts['f'].text}", True
        return None, False
    if kind == "s":
        return shared[int(raw)], False
    if kind == "b":
        return raw == "1", False
    if kind in ("str", "e", "d"):
        return raw, False
    number = float(raw)
    if style < len(dated) and dated[style]:
        return epoch + timedelta(days=number), False
    return int(number) if number.is_integer() and "." not in raw and "e" not in raw.lower() else number, False


def parse_docx(data: bytes) -> list[dict]:
    """Body blocks in order: headings by style, list items, paragraphs, and table rows with the first row as headers."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
        body = _root(archive, "word/document.xml").find(f"{_W}body")
        names = {}
        if "word/styles.xml" in archive.namelist():
            for s in _root(archive, "word/styles.xml").iter(f"{_W}style"):
                name = s.find(f"{_W}name")
                shown = name.get(f"{_W}val") if name is not None else ""
                names[s.get(f"{_W}styleId")] = re.sub(r"^heading (?=[1-9])", "Heading ", shown)
    except (zipfile.BadZipFile, KeyError, ET.ParseError) as e:
        raise ParseError("DOCX_MALFORMED") from e
    if body is None:
        raise ParseError("DOCX_MALFORMED")

    def text_of(p) -> str:
        out = []
        for e in p.iter():
            if e.tag == f"{_W}t":
                out.append(e.text or "")
            elif e.tag == f"{_W}tab":
                out.append("\t")
            elif e.tag in (f"{_W}br", f"{_W}cr"):
                out.append("\n")
        return normalise("".join(out))

    blocks, path = [], []
    for child in body:
        if child.tag == f"{_W}p":
            text = text_of(child).strip()
            if not text:
                continue
            style = child.find(f"{_W}pPr/{_W}pStyle")
            name = names.get(style.get(f"{_W}val"), "") if style is not None else ""
            level = re.fullmatch(r"Heading ([1-6])", name)
            if level:
                path = [h for h in path if h[0] < int(level[1])] + [(int(level[1]), text)]
            kind = "heading" if level else "list_item" if name.startswith("List ") else "paragraph"
            blocks.append({"kind": kind, "text": text, "meta": {"heading_path": [t for _, t in path]}})
        elif child.tag == f"{_W}tbl":
            rows = [[" ".join("\n".join(text_of(p) for p in cell.iter(f"{_W}p")).split()) for cell in row.iter(f"{_W}tc")] for row in child.iter(f"{_W}tr")]
            for values in rows[1:]:
                text = row_text(rows[0], values)
                if text:
                    blocks.append({"kind": "table_row", "text": text, "meta": {"heading_path": [t for _, t in path]}})
    return blocks
