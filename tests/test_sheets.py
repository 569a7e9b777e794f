"""Workbooks as tables: what a package holds, and the rows of its sheets."""

from __future__ import annotations

import io
import random
import zipfile

import pytest

from tallyforge.session import ship
from tallyforge.sources import sheets, workbook

M = f'xmlns="{sheets.MAIN}" xmlns:r="{sheets.RELATION}"'
TYPES = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Override PartName="/xl/workbook.xml" ContentType="%s"/></Types>'
LINK = '<Relationship Id="r%d" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="%s"/>'


def book(cells: list[str], strings="", styles="", names=("S",), states=(), more=None, main=sheets.MAIN_TYPE, properties="", relation=LINK):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", TYPES % main)
        state = dict(enumerate(states))
        said = "".join(f'<sheet name="{n}" sheetId="{k + 1}" r:id="r{k}"' + (f' state="{state[k]}"' if k in state else "") + "/>" for k, n in enumerate(names))
        z.writestr("xl/workbook.xml", f"<workbook {M}>{properties}<sheets>{said}</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(relation % (k, f"{'/xl/' * (k % 2)}worksheets/sheet{k + 1}.xml") for k in range(len(names))) + "</Relationships>")
        if strings:
            z.writestr("xl/sharedStrings.xml", f"<sst {M}>{strings}</sst>")
        if styles:
            z.writestr("xl/styles.xml", f"<styleSheet {M}>{styles}</styleSheet>")
        for k, rows in enumerate(cells):
            z.writestr(f"xl/worksheets/sheet{k + 1}.xml", f"<worksheet {M}><sheetData>{rows}</sheetData></worksheet>")
        for name, raw in (more or {}).items():
            z.writestr(name, raw)
    return out.getvalue()


ROW = '<row r="1"><c r="A1"><v>1</v></c></row>'
STYLES = '<numFmts><numFmt numFmtId="170" formatCode="yyyy&quot;x&quot;"/><numFmt numFmtId="171" formatCode="[Red]0.00&quot;days&quot;"/></numFmts><cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs>'


def test_inspections(spark):
    ship(spark)
    cases = {
        "plain": book([ROW]), "two": book([ROW, ROW], names=("A", "B")), "hidden": book([ROW], states=("hidden",)), "formula": book(['<row r="1"><c r="A1"><f>1+1</f><v>2</v></c></row>']),
        "macro": book([ROW], more={"xl/vbaProject.bin": b"x"}), "unknown": book([ROW], more={"xl/drawings/drawing1.xml": b"<x/>"}), "linked": book([ROW], relation=LINK.replace("/>", ' TargetMode="External"/>')),
        "template": book([ROW], main="application/vnd.ms-excel.sheet.macroEnabled.main+xml"), "lost": book([], names=("S",)), "no package": b"PK nothing", "broken": book(["<row>"]), "entity": book([ROW], more={"docProps/app.xml": b'<!DOCTYPE x [<!ENTITY a "b">]><x/>'}),
    }
    half = io.BytesIO()
    with zipfile.ZipFile(half, "w") as z:
        z.writestr("xl/workbook.xml", "<x/>")
    cases["half"] = half.getvalue()
    df = spark.createDataFrame([*cases.items()], "path string, content binary")
    got = {r.path: (r.problem, r.sheets, r.formulas, r.active_parts, r.external_relations, r.supported) for r in sheets.inspections(df).collect()}
    assert got == {
        "plain": (None, 1, 0, 0, 0, True), "two": (None, 2, 0, 0, 0, False), "hidden": (None, 1, 0, 0, 0, False), "formula": (None, 1, 1, 0, 0, False), "macro": (None, 1, 0, 1, 0, False), "unknown": (None, 1, 0, 1, 0, False),
        "linked": (None, 1, 0, 0, 1, False), "template": ("content_type", 1, 0, 0, 0, False), "lost": ("sheet_without_part", 1, 0, 0, 0, False), "no package": ("not_a_package", 0, 0, 0, 0, False),
        "broken": ("malformed", 1, 0, 0, 0, False), "entity": ("document_type", 1, 0, 0, 0, False), "half": ("incomplete", 0, 0, 0, 0, False),
    }
    named = sheets.sheets(sheets.elements(sheets.parts(df.where("path = 'two'")))).orderBy("ordinal").collect()
    assert [(r.name, r.part) for r in named] == [("A", "xl/worksheets/sheet1.xml"), ("B", "xl/worksheets/sheet2.xml")] and len({r.sheet_identity for r in named}) == 2


def test_rows_are_those_of_the_reader_in_order(spark):
    ship(spark)
    rng = random.Random(2)
    strings = "".join(rng.choice([f"<si><t>text {k}</t></si>", f"<si><r><t>rich </t></r><r><t>{k}</t></r></si>", "<si/>"]) for k in range(20))
    cell = lambda ref: rng.choice([f'<c r="{ref}"><v>{rng.randint(1, 99)}.5</v></c>', f'<c r="{ref}" t="s"><v>{rng.randrange(20)}</v></c>', f'<c r="{ref}" t="b"><v>{rng.randint(0, 1)}</v></c>', f'<c r="{ref}" s="{rng.randint(1, 3)}"><v>{rng.randint(100, 45000)}</v></c>', f'<c r="{ref}" t="inlineStr"><is><t>in &amp; line</t></is></c>', f'<c r="{ref}"/>', f'<c r="{ref}" t="str"><v>007</v></c>', f'<c r="{ref}" s="1"><v>{rng.randint(100, 45000)}.25</v></c>'])
    rows = lambda n: "".join(f'<row r="{k}">' + "".join(cell(f"{workbook.letters(c)}{k}") for c in sorted(rng.sample(range(1, 40), rng.randint(1, 9)))) + "</row>" for k in sorted(rng.sample(range(1, 90), n)))
    payloads = [(f"b{k}.xlsx", book([rows(25), rows(12)], strings, STYLES, ("One", "Two"), properties='<workbookPr date1904="1"/>' if k else "")) for k in range(2)]
    df = spark.createDataFrame(payloads, "path string, content binary")
    want = sorted((r.path, r.sheet, r.record_ordinal, r.raw_values) for r in workbook.read_workbooks(df).collect())
    got = sheets.sheet_rows(df).collect()
    assert len(want) == 74 and {r.problem for r in got} == {None}
    assert sorted((r.path, r.sheet, r.record_ordinal, r.raw_values) for r in got) == want


def test_odd_rows(spark):
    ship(spark)
    cases = {
        "micro": book(['<row r="1"><c s="1"><v>45000.123456789</v></c><c><v>4.5E3</v></c></row><row/><row r="9"><c r="B9" s="1"><v>1.5</v></c></row>'], styles=STYLES),
        "lost text": book(['<row r="1"><c r="A1" t="s"><v>7</v></c></row>'], strings="<si><t>only</t></si>"),
        "no date": book(['<row r="1"><c r="A1" s="1"><v>soon</v></c></row>'], styles=STYLES),
        "wide": book(['<row r="1"><c r="ZZZ1"><v>1</v></c></row>']), "twice": book(['<row r="1"><c r="A1"><v>1</v></c><c r="A1"><v>2</v></c></row>']), "empty": book([""]), "none": b"",
    }
    got = sheets.sheet_rows(spark.createDataFrame([*cases.items()], "path string, content binary")).collect()
    found = {k: sorted((r.record_ordinal, r.raw_values) for r in got if r.path == k and r.problem is None) for k in cases}
    assert found == {
        "micro": [(1, ["2023-03-15T02:57:46.666570", "4.5E3"]), (2, []), (9, ["", "1899-12-31T12:00:00"])], "lost text": [], "no date": [], "wide": [], "twice": [(1, ["2"])], "empty": [], "none": [],
    }
    assert {r.path: r.problem for r in got if r.problem} == {"lost text": "malformed", "no date": "malformed", "wide": "too_many_columns", "none": "not_a_package"}


@pytest.mark.parametrize("serial, late, iso", [("0", False, "1899-12-30"), ("1", True, "1904-01-02"), ("44927.5", False, "2023-01-01T12:00:00"), ("60", False, "1900-02-28")])
def test_serial_days(spark, serial, late, iso):
    from pyspark.sql import functions as F

    assert spark.range(1).select(sheets.iso_of(F.lit(serial), F.lit(late)).alias("x")).first().x == iso
