"""Texts of docx and xlsx packages, from their parts with the standard library.

Parts are found through the packages' relationships, never by the names that they happen to have.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, time, timedelta
from xml.etree import ElementTree

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_P = "{http://schemas.openxmlformats.org/package/2006/relationships}"

# Built-in number formats that show dates or times, and what a run's marks stand for.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
DURATION_FORMATS = {46}
RUN_MARKS = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n", f"{_W}noBreakHyphen": "-", f"{_W}ptab": "\t"}

#: What of a number format isn't a token: quoted texts, escaped characters, colours and conditions.
_LITERAL = re.compile(r'"[^"]*"|\\.|_.|\*.|\[(?![hms]+\])[^\]]*\]', re.IGNORECASE)


class Package:
    """A zip of parts; a part's relationships name the others."""

    def __init__(self, raw: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(raw))

    def __enter__(self) -> Package:
        return self

    def __exit__(self, *_: object) -> None:
        self.zip.close()

    def root(self, part: str) -> ElementTree.Element:
        return ElementTree.fromstring(self.zip.read(part))

    def related(self, part: str) -> dict[str, tuple[str, str]]:
        """By relationship id: the kind's last word, and the part."""
        folder, name = posixpath.split(part)
        rels = posixpath.join(folder, "_rels", f"{name}.rels")
        if rels not in self.zip.namelist():
            return {}
        found = {}
        for r in self.root(rels).iter(f"{_P}Relationship"):
            if r.get("TargetMode") != "External":
                target = r.get("Target") or ""
                found[r.get("Id") or ""] = ((r.get("Type") or "").rsplit("/", 1)[-1], target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target)))
        return found

    def main(self, usual: str) -> str:
        """The document's own part."""
        return next((p for kind, p in self.related("").values() if kind == "officeDocument"), usual)

    def of_kind(self, part: str, kind: str) -> str | None:
        return next((p for k, p in self.related(part).values() if k == kind), None)


# ---------------------------------------------------------------- workbooks


def _plain(node: ElementTree.Element) -> str:
    """Texts of a cell or shared string, rich or not, without the readings that may stand beside them."""
    if node.tag == f"{_S}rPh":
        return ""
    return (node.text or "") if node.tag == f"{_S}t" else "".join(map(_plain, node))


def is_date_format(code: str) -> bool:
    return re.search("[dmyhs]", _LITERAL.sub("", code.split(";")[0]), re.IGNORECASE) is not None


def is_duration_format(code: str) -> bool:
    return re.search(r"\[[hms]+\]", _LITERAL.sub("", code.split(";")[0]), re.IGNORECASE) is not None


def date_text(serial: float, from_1904: bool = False, duration: bool = False) -> str:
    """A serial day as a date and time, to the second; a part of a day as a time, a duration as one.

    Days before the 29th of February 1900, which that year hadn't but serials have, are one later.
    """
    if duration:
        return str(timedelta(seconds=round(serial * 86400)))
    if 0 <= serial < 1 and not from_1904:
        seconds = round(serial * 86400)
        return str((datetime.min + timedelta(seconds=seconds)).time()) if seconds < 86400 else str(time())
    start = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30)
    days = serial + 1 if 0 < serial < 60 and not from_1904 else serial
    return (start + timedelta(seconds=round(days * 86400))).isoformat(sep=" ", timespec="seconds")


def number_text(value: str) -> str:
    """A number without float noise: whole ones without a fraction."""
    try:
        return str(int(value))
    except ValueError:
        number = float(value)
        return str(int(number)) if number.is_integer() else str(number)


def column_of(reference: str | None) -> int:
    """The place of a cell's letters, from 1; 0 without any."""
    at = 0
    for letter in re.sub("[^A-Z]", "", (reference or "").upper()):
        at = at * 26 + ord(letter) - 64
    return at


def _styles(package: Package, part: str | None) -> list[str | None]:
    """By a cell's style: date, duration or None."""
    if part is None:
        return []
    root = package.root(part)
    codes = {int(f.get("numFmtId") or 0): f.get("formatCode") or "" for f in root.iter(f"{_S}numFmt")}
    formats = [int(x.get("numFmtId") or 0) for xfs in root.iter(f"{_S}cellXfs") for x in xfs.iter(f"{_S}xf")]
    told = lambda k: "duration" if (is_duration_format(codes[k]) if k in codes else k in DURATION_FORMATS) else "date" if (is_date_format(codes[k]) if k in codes else k in DATE_FORMATS) else None
    return [told(k) for k in formats]


def _cell(cell: ElementTree.Element, shared: list[str], styles: list[str | None], from_1904: bool) -> str:
    kind, value = cell.get("t") or "n", cell.findtext(f"{_S}v")
    if kind == "inlineStr":
        return "".join(_plain(x) for x in cell.findall(f"{_S}is"))
    if value is None or value == "":
        return ""
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return "True" if value.strip() == "1" else "False"
    if kind == "d":
        return datetime.fromisoformat(value.replace("Z", "+00:00")).replace(tzinfo=None).isoformat(sep=" ", timespec="seconds")
    if kind != "n":
        return value
    style = int(cell.get("s") or 0)
    shown = styles[style] if style < len(styles) else None
    return date_text(float(value), from_1904, shown == "duration") if shown else number_text(value)


def sheets(raw: bytes) -> Iterator[tuple[str, Iterator[list[str]]]]:
    """(title, rows of texts) of a workbook's sheets, in its order; rows that aren't written are empty ones."""
    with Package(raw) as package:
        main = package.main("xl/workbook.xml")
        related, book = package.related(main), package.root(main)
        strings, styles = package.of_kind(main, "sharedStrings"), _styles(package, package.of_kind(main, "styles"))
        shared = [_plain(s) for s in package.root(strings).findall(f"{_S}si")] if strings else []
        from_1904 = any((p.get("date1904") or "0") in ("1", "true") for p in book.iter(f"{_S}workbookPr"))
        for sheet in book.iter(f"{_S}sheet"):
            kind, part = related.get(sheet.get(f"{_R}id") or "", ("", ""))
            if kind == "worksheet":
                yield sheet.get("name") or "", _rows(package, part, shared, styles, from_1904)


def _rows(package: Package, part: str, shared: list[str], styles: list[str | None], from_1904: bool) -> Iterator[list[str]]:
    """Read as a stream, so that a sheet's tree is never whole."""
    at = 0
    with package.zip.open(part) as stream:
        for _, row in ElementTree.iterparse(stream):
            if row.tag != f"{_S}row":
                continue
            number = int(row.get("r") or at + 1)
            while at + 1 < number:
                yield []
                at += 1
            cells: list[str] = []
            for c in row.findall(f"{_S}c"):
                cells += [""] * (column_of(c.get("r")) - 1 - len(cells))
                cells.append(_cell(c, shared, styles, from_1904))
            yield cells
            at += 1
            row.clear()


# ---------------------------------------------------------------- documents


def paragraph_text(paragraph: ElementTree.Element) -> str:
    """Texts and marks of a paragraph's runs and links; what was deleted or floats beside it isn't there."""
    out = []
    for child in paragraph:
        for run in [child] if child.tag == f"{_W}r" else child.findall(f"{_W}r") if child.tag == f"{_W}hyperlink" else []:
            for x in run:
                if x.tag == f"{_W}t":
                    out.append(x.text or "")
                elif x.tag == f"{_W}br" and x.get(f"{_W}type") in ("page", "column"):
                    continue
                else:
                    out.append(RUN_MARKS.get(x.tag, ""))
    return "".join(out)


def grid(table: ElementTree.Element) -> Iterator[list[str]]:
    """Rows of a table's texts. A cell that goes on from the row above repeats its text; neighbours with the same text are
    one cell, since merged ones can't be told from them. Tables inside of cells aren't looked into."""
    above: dict[int, str] = {}
    for row in table.findall(f"{_W}tr"):
        texts: list[str] = []
        at, here = 0, {}
        for cell in row.findall(f"{_W}tc"):
            span, merge = cell.find(f"{_W}tcPr/{_W}gridSpan"), cell.find(f"{_W}tcPr/{_W}vMerge")
            width = int(span.get(f"{_W}val") or 1) if span is not None else 1
            goes_on = merge is not None and (merge.get(f"{_W}val") or "continue") == "continue"
            text = above.get(at, "") if goes_on else "\n".join(map(paragraph_text, cell.findall(f"{_W}p"))).strip()
            here |= dict.fromkeys(range(at, at + width), text)
            at += width
            if not texts or text != texts[-1]:
                texts.append(text)
        above = here
        yield texts


def blocks(raw: bytes) -> Iterator[tuple[str, str | list[list[str]]]]:
    """("paragraphs", text) and ("table", rows) of a document's body, in order; headings begin with a number sign."""
    with Package(raw) as package:
        main = package.main("word/document.xml")
        styles = package.of_kind(main, "styles")
        # Without a list of styles the usual one holds.
        names, usual = {} if styles else {f"Heading{k}": f"heading {k}" for k in range(1, 10)}, None
        for style in package.root(styles).iter(f"{_W}style") if styles else []:
            name = style.find(f"{_W}name")
            if style.get(f"{_W}type") == "paragraph" and name is not None:
                names[style.get(f"{_W}styleId")] = name.get(f"{_W}val") or ""
                if style.get(f"{_W}default") in ("1", "true"):
                    usual = style.get(f"{_W}styleId")
        body = package.root(main).find(f"{_W}body")
        held: list[str] = []
        for node in body if body is not None else []:
            if node.tag == f"{_W}p":
                text, own = paragraph_text(node).strip(), node.find(f"{_W}pPr/{_W}pStyle")
                style = own.get(f"{_W}val") if own is not None else None
                # A style that isn't in the list counts as the usual one.
                name = names.get(style if style in names else usual, "")
                if text:
                    held.append(f"# {text}" if re.match("Heading|heading [1-9]", name) else text)
            elif node.tag == f"{_W}tbl":
                if held:
                    yield "paragraphs", "\n".join(held)
                    held = []
                yield "table", list(grid(node))
        if held:
            yield "paragraphs", "\n".join(held)
