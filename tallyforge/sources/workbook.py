"""Rows of XLSX and ODS workbooks, by the standard library. A workbook is one file and one task; Spark deals the files out."""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

ROWS = "path string, sheet string, record_ordinal int, raw_values array<string>"
SUMMARY = "path string, outcome string, reason string, sheets int, rows long, formulas int, active_parts int, external_relations int"
#: Limits of a workbook: rows of all its sheets, columns, characters of a cell, entries of the package, bytes it expands to, and their ratio.
MOST_ROWS, MOST_COLUMNS, MOST_CHARS = 200_000, 512, 4_096
MOST_ENTRIES, MOST_EXPANDED, MOST_RATIO = 512, 200 * 1024 * 1024, 100
#: Parts of a package that can do something or fetch something.
ACTIVE_PREFIXES = ("xl/activex/", "xl/embeddings/", "xl/externallinks/", "xl/querytables/", "xl/pivotcache/", "customxml/")
ACTIVE_PARTS = ("xl/connections.xml", "xl/webpublishitems.xml", "xl/vbaproject.bin")
#: Names of the formats' XML.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
TABLE, TEXT, OFFICE = ("{urn:oasis:names:tc:opendocument:xmlns:%s:1.0}" % x for x in ("table", "text", "office"))
#: Numbers of built-in date formats.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}


def letters(number: int) -> str:
    """1 is A, 27 is AA."""
    out = ""
    while number:
        number, rest = divmod(number - 1, 26)
        out = chr(65 + rest) + out
    return out


def number_of(column: str) -> int:
    out = 0
    for c in column:
        out = out * 26 + ord(c) - 64
    return out


def date_of(serial: float, from_1904: bool = False) -> str:
    """A serial day as ISO text; a fraction is the time."""
    start = dt.datetime(1904, 1, 1) if from_1904 else dt.datetime(1899, 12, 30)
    moment = start + dt.timedelta(microseconds=round(serial * 86_400_000_000))
    return moment.date().isoformat() if moment.time() == dt.time() else moment.isoformat()


class Refused(ValueError):
    """A workbook that is not read, with the reason."""


def package(payload: bytes) -> zipfile.ZipFile:
    """The opened package, if it keeps to the limits."""
    try:
        z = zipfile.ZipFile(io.BytesIO(payload))
    except zipfile.BadZipFile as e:
        raise Refused("not_a_package") from e
    entries = z.infolist()
    if len(entries) > MOST_ENTRIES:
        raise Refused("too_many_entries")
    if sum(e.file_size for e in entries) > MOST_EXPANDED:
        raise Refused("too_large_expanded")
    if any(e.compress_size and e.file_size > MOST_RATIO * e.compress_size for e in entries):
        raise Refused("compression_ratio")
    if any(".." in e.filename.replace("\\", "/").split("/") or e.filename.startswith(("/", "\\")) for e in entries):
        raise Refused("path_escape")
    if len({e.filename.casefold() for e in entries}) < len(entries):
        raise Refused("repeated_entry")
    return z


def inspected(payload: bytes) -> dict[str, int]:
    """Formulas, active parts and relations to outside of a package."""
    z = package(payload)
    names = [n.casefold() for n in z.namelist()]
    relations = [safe_xml(z.read(n)) for n in z.namelist() if n.lower().endswith(".rels")]
    cells = [safe_xml(z.read(n)) for n in z.namelist() if n.lower().startswith("xl/worksheets/") and n.lower().endswith(".xml") or n == "content.xml"]
    return {
        "formulas": sum(1 for root in cells for x in root.iter() if x.tag == f"{MAIN}f" or x.get(f"{TABLE}formula")),
        "active_parts": sum(n in ACTIVE_PARTS or n.startswith(ACTIVE_PREFIXES) for n in names),
        "external_relations": sum(r.get("TargetMode", "").casefold() == "external" for root in relations for r in root),
    }


def within(rows: Iterator[tuple[str, int, list[str]]]) -> Iterator[tuple[str, int, list[str]]]:
    """The rows, as long as they keep to the limits."""
    for n, row in enumerate(rows, 1):
        if n > MOST_ROWS:
            raise Refused("too_many_rows")
        if len(row[2]) > MOST_COLUMNS:
            raise Refused("too_many_columns")
        if any(len(c) > MOST_CHARS for c in row[2]):
            raise Refused("cell_too_long")
        yield row


def safe_xml(raw: bytes) -> ElementTree.Element:
    """Parsed XML; a document type could name entities, so there is none."""
    if b"<!DOCTYPE" in raw[:4096] or b"<!ENTITY" in raw[:4096]:
        raise Refused("document_type")
    try:
        return ElementTree.fromstring(raw)
    except ElementTree.ParseError as e:
        raise Refused("malformed") from e


def xlsx_rows(payload: bytes) -> Iterator[tuple[str, int, list[str]]]:
    z = package(payload)
    names = {*z.namelist()}
    book = safe_xml(z.read("xl/workbook.xml"))
    links = {r.get("Id"): r.get("Target") for r in safe_xml(z.read("xl/_rels/workbook.xml.rels"))}
    shared = ["".join(t.text or "" for t in s.iter(f"{MAIN}t")) for s in safe_xml(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    styles = safe_xml(z.read("xl/styles.xml")) if "xl/styles.xml" in names else None
    custom = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{MAIN}numFmt")} if styles is not None else {}
    formats = [int(x.get("numFmtId", 0)) for x in styles.find(f"{MAIN}cellXfs") or ()] if styles is not None else []
    is_date = [f in DATE_FORMATS or bool(re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^]]*\]', "", custom.get(f, "")), re.I)) for f in formats]
    properties = book.find(f"{MAIN}workbookPr")
    from_1904 = properties is not None and properties.get("date1904") in ("1", "true")
    for sheet in book.iter(f"{MAIN}sheet"):
        target = links[sheet.get(RELATION)]
        root = safe_xml(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
        for n, row in enumerate(root.iter(f"{MAIN}row"), 1):
            cells: list[str] = []
            for c in row.iter(f"{MAIN}c"):
                column = number_of(re.match("[A-Z]+", c.get("r") or letters(len(cells) + 1))[0])
                cells += [""] * (column - 1 - len(cells))
                value, kind = c.findtext(f"{MAIN}v"), c.get("t")
                if kind == "s":
                    value = shared[int(value)]
                elif kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
                elif kind == "b":
                    value = "true" if value == "1" else "false"
                elif value is not None and kind in (None, "n") and int(c.get("s", 0)) < len(is_date) and is_date[int(c.get("s", 0))]:
                    value = date_of(float(value), from_1904)
                cells.append(value or "")
            yield sheet.get("name"), int(row.get("r") or n), cells


def ods_rows(payload: bytes) -> Iterator[tuple[str, int, list[str]]]:
    root = safe_xml(package(payload).read("content.xml"))
    for sheet in root.iter(f"{TABLE}table"):
        ordinal = 0
        for row in sheet.iter(f"{TABLE}table-row"):
            cells: list[str] = []
            for c in row:
                kind = c.get(f"{OFFICE}value-type")
                text = "\n".join("".join(p.itertext()) for p in c.iter(f"{TEXT}p"))
                value = c.get(f"{OFFICE}date-value") if kind == "date" else c.get(f"{OFFICE}value") if kind in ("float", "currency", "percentage") else c.get(f"{OFFICE}boolean-value") if kind == "boolean" else text
                repeated = int(c.get(f"{TABLE}number-columns-repeated", 1))
                # blank cells up to the sheet's edge are no content, but content beyond the limit is refused, not dropped
                cells += [value or ""] * min(repeated, MOST_COLUMNS + 1)
            while cells and not cells[-1]:
                cells.pop()
            repeats = int(row.get(f"{TABLE}number-rows-repeated", 1))
            if cells:
                for k in range(repeats):
                    yield sheet.get(f"{TABLE}name"), ordinal + k + 1, cells
            ordinal += repeats


def rows_of(path: str, payload: bytes) -> list[tuple[str, int, list[str]]]:
    """All rows of a workbook, or the reason why it is not read."""
    try:
        return list(within((ods_rows if path.lower().endswith(".ods") else xlsx_rows)(payload)))
    except (KeyError, IndexError, TypeError, zipfile.BadZipFile) as e:
        # a part, a text or a number that the workbook names and does not have
        raise Refused("malformed") from e
    except ValueError as e:
        raise e if isinstance(e, Refused) else Refused("malformed") from e


def read_workbooks(contents: DataFrame) -> DataFrame:
    """Rows of all sheets of all workbooks (path, content); blank cells before the last are filled in. A workbook that is malformed or over a limit
    has no rows; ``workbook_summaries`` says why."""

    def run(batches):
        for batch in batches:
            for path, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    out = rows_of(path, payload)
                except Refused:
                    continue
                columns = [[path] * len(out), *([o[i] for o in out] for i in range(3))]
                types = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["path", "sheet", "record_ordinal", "raw_values"])

    return contents.select("path", "content").mapInArrow(run, ROWS)


def workbook_summaries(contents: DataFrame) -> DataFrame:
    """One row for each workbook: complete or failed and why, its sheets and rows, and what is in it besides values."""

    def run(batches):
        names = [x.split()[0] for x in SUMMARY.split(", ")]
        types = [pa.string()] * 3 + [pa.int32(), pa.int64()] + [pa.int32()] * 3
        for batch in batches:
            out = []
            for path, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found, rows = inspected(payload), rows_of(path, payload)
                    out.append((path, "complete", None, len({r[0] for r in rows}), len(rows), *found.values()))
                except Refused as e:
                    out.append((path, "failed", str(e), 0, 0, 0, 0, 0))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names=names)

    return contents.select("path", "content").mapInArrow(run, SUMMARY)
