"""Workbooks (xlsx, xlsm, ods): a sheet as text cells, the way a CSV export would show them."""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from xml.etree import ElementTree as ET

from .options import SourceError

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
_TABLE = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}"
_OFFICE = "{urn:oasis:names:tc:opendocument:xmlns:office:1.0}"
_TEXT = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
#: Built-in number formats that show dates or times: fixed values.
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _number(text: str) -> str:
    value = float(text)
    return str(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value)


def _serial(text: str, from_1904: bool) -> str:
    value = float(text)
    if value < 1 and not from_1904:
        seconds = round(value * 86400)
        return f"{seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}"
    base = dt.datetime(1904, 1, 1) if from_1904 else dt.datetime(1899, 12, 30)
    when = base + dt.timedelta(milliseconds=round(value * 86_400_000))
    if when.time() == dt.time():
        return when.date().isoformat()
    return when.isoformat(timespec="milliseconds").rstrip("0").rstrip(".") if when.microsecond else when.isoformat()


def _pick(names: list[str], sheet: str | int | None) -> int:
    if not names:
        raise SourceError("the workbook has no sheets")
    if sheet is None:
        return 0
    for i, n in enumerate(names):
        if n.lower() == str(sheet).lower():
            return i
    if str(sheet).isdigit() and 1 <= int(sheet) <= len(names):
        return int(sheet) - 1
    raise SourceError(f"no sheet `{sheet}`; the workbook has {', '.join(names)}")


def _xlsx(z: zipfile.ZipFile, sheet: str | int | None) -> list[list[str | None]]:
    book = ET.fromstring(z.read("xl/workbook.xml"))
    sheets = book.findall(f"{_MAIN}sheets/{_MAIN}sheet")
    pick = sheets[_pick([s.get("name") for s in sheets], sheet)]
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels")).iter(f"{_PACKAGE}Relationship")}
    target = targets[pick.get(_REL)]
    path = target.lstrip("/") if target.startswith("/") else "xl/" + target
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))]
    dates = set()
    if "xl/styles.xml" in z.namelist():
        styles = ET.fromstring(z.read("xl/styles.xml"))
        custom = {int(f.get("numFmtId")) for f in styles.iter(f"{_MAIN}numFmt") if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")), re.I)}
        for i, xf in enumerate(styles.findall(f"{_MAIN}cellXfs/{_MAIN}xf")):
            if int(xf.get("numFmtId", 0)) in _DATE_FORMATS | custom:
                dates.add(i)
    properties = book.find(f"{_MAIN}workbookPr")
    from_1904 = properties is not None and properties.get("date1904") in ("1", "true")
    rows: list[list[str | None]] = []
    for row in ET.fromstring(z.read(path)).iter(f"{_MAIN}row"):
        cells: list[str | None] = []
        for c in row.findall(f"{_MAIN}c"):
            letters = re.match(r"[A-Z]+", c.get("r", ""))
            at = len(cells)
            if letters:
                at = 0
                for ch in letters[0]:
                    at = at * 26 + ord(ch) - 64
                at -= 1
            cells += [None] * (at + 1 - len(cells))
            value, kind = c.find(f"{_MAIN}v"), c.get("t", "n")
            text = value.text if value is not None else None
            if kind == "inlineStr":
                cells[at] = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
            elif text is None or kind == "e":
                cells[at] = None
            elif kind == "s":
                cells[at] = shared[int(text)]
            elif kind == "b":
                cells[at] = "true" if text == "1" else "false"
            elif kind in ("str", "d"):
                cells[at] = text
            else:
                cells[at] = _serial(text, from_1904) if int(c.get("s", 0)) in dates else _number(text)
        number = int(row.get("r", len(rows) + 1))
        rows += [[] for _ in range(number - 1 - len(rows))]
        rows.append(cells)
    return rows


def _ods(z: zipfile.ZipFile, sheet: str | int | None) -> list[list[str | None]]:
    tables = list(ET.fromstring(z.read("content.xml")).iter(f"{_TABLE}table"))
    table = tables[_pick([t.get(f"{_TABLE}name") for t in tables], sheet)]
    rows: list[list[str | None]] = []
    for row in table.iter(f"{_TABLE}table-row"):
        cells: list[str | None] = []
        for c in row:
            kind = c.get(f"{_OFFICE}value-type")
            text: str | None = "\n".join("".join(p.itertext()) for p in c.findall(f"{_TEXT}p"))
            if kind in ("float", "percentage", "currency"):
                text = _number(c.get(f"{_OFFICE}value"))
            elif kind == "boolean":
                text = c.get(f"{_OFFICE}boolean-value")
            elif kind == "date":
                text = c.get(f"{_OFFICE}date-value").removesuffix("T00:00:00")
            elif kind is None:
                text = None
            times = int(c.get(f"{_TABLE}number-columns-repeated", 1))
            cells += [text] * (times if text is not None else min(times, 1024))
        while cells and cells[-1] is None:
            cells.pop()
        rows += [cells] * min(int(row.get(f"{_TABLE}number-rows-repeated", 1)), 1 if not cells else 1 << 20)
    return rows


def read_sheet(raw: bytes, sheet: str | int | None) -> list[list[str | None]]:
    """All rows of a sheet. Old binary workbooks need a library that is not at hand."""
    try:
        z = zipfile.ZipFile(io.BytesIO(raw))
    except zipfile.BadZipFile:
        raise SourceError("not a workbook that can be read here; save it as .xlsx or .ods") from None
    with z:
        if "xl/workbook.xml" in z.namelist():
            return _xlsx(z, sheet)
        if "content.xml" in z.namelist():
            return _ods(z, sheet)
    raise SourceError("binary workbooks (.xlsb, .xls) cannot be read here; save it as .xlsx or .ods")
