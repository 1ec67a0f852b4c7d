"""Workbooks (.xlsx, .xlsm): the archive is read with the standard library, a task a file."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from itertools import islice
from xml.etree import ElementTree

import pyarrow as pa

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def column_number(reference: str) -> int:
    n = 0
    for letter in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(letter) - 64
    return n - 1


# Numbers of the built-in formats that show dates or times, and the days that serial numbers count from.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
DAY_ZERO, DAY_ZERO_1904 = datetime(1899, 12, 30), datetime(1904, 1, 1)
#: Stands before the text of a date cell.
DATED = "\x02"


def shows_dates(code: str) -> bool:
    """Whether a format code has letters of dates or times, outside quotes, escapes and brackets."""
    return re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\\.|_.|\[[^\]]*\]', "", code.lower()).replace("general", "")) is not None


def date_styles(z: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show dates."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): shows_dates(f.get("formatCode", "")) for f in root.iterfind("m:numFmts/m:numFmt", NS)}
    ids = [int(x.get("numFmtId", "0")) for x in root.iterfind("m:cellXfs/m:xf", NS)]
    return {k for k, i in enumerate(ids) if own.get(i, i in DATE_FORMATS)}


def dated(serial: str, zero: datetime) -> str:
    """A serial number as a point in time, to the second; the text itself where it is none. The first 59 days of 1900 are a day further
    on, as the format takes that year for a leap year."""
    try:
        days = float(serial)
        days += zero == DAY_ZERO and 0 < days < 60
        return DATED + (zero + timedelta(seconds=round(days * 86_400))).isoformat(" ")
    except (ValueError, OverflowError):
        return serial


def sheet_rows(raw: bytes) -> Iterator[list[str | None]]:
    """Rows of the first sheet that has any, as text, one at a time: the sheet is pulled through the parser, and only shared texts are held."""
    tag = f"{{{NS['m']}}}"
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            for _, si in ElementTree.iterparse(z.open("xl/sharedStrings.xml")):
                if si.tag == f"{tag}si":
                    shared.append("".join(t.text or "" for t in si.iter(f"{tag}t")))
                    si.clear()
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        setting = book.find("m:workbookPr", NS)
        zero = DAY_ZERO_1904 if setting is not None and setting.get("date1904") in ("1", "true") else DAY_ZERO
        dates = date_styles(z)
        for sheet in book.find("m:sheets", NS):
            target = targets[sheet.get(REL)]
            some = False
            root = None
            for event, row in ElementTree.iterparse(z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}"), ("start", "end")):
                root = row if root is None else root
                if event == "start" or row.tag != f"{tag}row":
                    continue
                out: list[str | None] = []
                for c in row.findall("m:c", NS):
                    at = column_number(c.get("r")) if c.get("r") else len(out)
                    out += [None] * (at - len(out))
                    v, kind = c.find("m:v", NS), c.get("t", "n")
                    if kind == "inlineStr":
                        out.append("".join(t.text or "" for t in c.iter(f"{tag}t")))
                    elif v is None or v.text is None:
                        out.append(None)
                    elif kind == "s":
                        out.append(shared[int(v.text)])
                    elif kind == "b":
                        out.append({"1": "true", "0": "false"}.get(v.text, v.text))
                    else:
                        out.append(dated(v.text, zero) if kind == "n" and int(c.get("s", "0")) in dates else v.text)
                row.clear()
                for data in root.iterfind("m:sheetData", NS):
                    data.clear()  # rows that have been seen
                if any(x not in (None, "") for x in out):
                    some = True
                    yield out
            if some:
                return


ROWS = "path string, place long, cells array<string>"


def sheets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each workbook (path, content), numbered from the header, 0."""
    for batch in batches:
        for path, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows, at = sheet_rows(raw), 0
            while some := list(islice(rows, 4096)):
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(some), pa.string()), pa.array(range(at, at + len(some)), pa.int64()), pa.array(some, pa.list_(pa.string()))], names=["path", "place", "cells"])
                at += len(some)
