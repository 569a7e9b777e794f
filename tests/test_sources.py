"""Files: exact places, limits, kinds, workbooks, exports, streams."""

from __future__ import annotations

import csv
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyforge.plans.views import movements
from tallyforge.session import ship
from tallyforge.sources import admission, export, statement, workbook
from tallyforge.streaming import inbox

CSV = {
    "bank.csv": "fecha;descripcion;valor\n13/02/2026;\"dos\nlineas\";1.234,56\n\n14/02/2026;café;-5,00\n".encode("utf-8-sig"),
    "latin.csv": "fila;importe;descripción\n1;1.234,56;ñ\n2;2;x;extra\n".encode("latin-1"),
    "plain.csv": b"one column\nonly\n",
    "nul.csv": b"a,b\n\x00,1\n",
    "empty.csv": b"",
    "prog.csv": b"MZ....",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    for name, payload in CSV.items():
        (d / name).write_bytes(payload)
    return str(d)


def name(path):
    return path.rsplit("/", 1)[-1]


def test_records_slice_back_to_their_bytes(spark, folder):
    ship(spark)
    contents = statement.files(spark, folder)
    rows = statement.sliced(contents, statement.read_statements(contents)).collect()
    by = {(name(r.path), r.record_ordinal): r for r in rows}
    assert by["bank.csv", 2].raw_values == ["13/02/2026", "dos\nlineas", "1.234,56"] and by["bank.csv", 2].bytes == b'13/02/2026;"dos\nlineas";1.234,56\n'
    assert by["bank.csv", 1].byte_start == 3 and ("bank.csv", 3) not in by and by["bank.csv", 4].raw_values[1] == "café"
    assert by["latin.csv", 2].bytes.decode("latin-1") == "1;1.234,56;ñ\n" and by["latin.csv", 3].field_count == 4
    assert all(r.bytes == CSV[name(r.path)][r.byte_start : r.byte_end] for r in rows)
    told = {name(r.path): r for r in statement.summaries(contents).collect()}
    assert told["bank.csv"].outcome == "complete" and told["latin.csv"].ragged == 1 and told["latin.csv"].codec == "cp1252"
    assert {n: told[n].reason for n in ("plain.csv", "nul.csv")} == {"plain.csv": "single_column", "nul.csv": "control_bytes"} and "empty.csv" not in told
    assert {name(r.path): r.outcome for r in statement.summaries(contents, most=3).collect()}["bank.csv"] == "complete"
    assert {name(r.path): r.outcome for r in statement.summaries(contents, most=2).collect()}["bank.csv"] == "truncated"


def zipped(**entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n, v in entries.items():
            z.writestr(n.replace("__", "/"), v)
    return out.getvalue()


def test_admission(spark):
    ship(spark)
    bomb = zipped(a=b"0" * 5_000_000)
    escape = io.BytesIO()
    with zipfile.ZipFile(escape, "w") as z:
        z.writestr("../x", "y")
    cases = [("a.csv", b"x,y\n1,2\n"), ("b.pdf", b"%PDF-1.7 x"), ("c.csv", b"%PDF-1.7 x"), ("d.exe", b"MZ"), ("e.zip", bomb), ("f.zip", escape.getvalue()), ("g.png", b"\x89PNG\r\n\x1a\nx"), ("h.csv", b""), ("i.zip", zipped(a=b"fine")), ("j.xlsx", zipped(**{"[Content_Types].xml": b"x", "xl__workbook.xml": b"x"})), ("k.ods", zipped(mimetype=admission.ODS_MIMETYPE, Basic__x=b"x")), ("l.xlsx", zipped(mimetype=admission.ODS_MIMETYPE))]
    got = {r.path: (r.decision, r.reason) for r in admission.decisions(spark.createDataFrame(cases, "path string, content binary")).collect()}
    assert got == {
        "a.csv": ("admitted", None), "b.pdf": ("admitted", None), "c.csv": ("quarantined", "extension_mismatch"), "d.exe": ("rejected", "dos_or_windows_executable"), "e.zip": ("rejected", "compression_ratio"),
        "f.zip": ("rejected", "path_escape"), "g.png": ("rejected", "type_not_accepted"), "h.csv": ("rejected", "empty"), "i.zip": ("quarantined", "archive_not_promotable"), "j.xlsx": ("admitted", None), "k.ods": ("rejected", "macro"), "l.xlsx": ("quarantined", "extension_mismatch"),
    }


def test_promotion_after_a_scan(spark):
    ship(spark)
    cases = [("a.csv", b"x,y"), ("b.csv", b"x,y"), ("c.pdf", b"%PDF-1.7 x"), ("d.zip", zipped(a=b"fine")), ("e.ods", zipped(mimetype=admission.ODS_MIMETYPE))]
    found = spark.createDataFrame([("b.csv", "aws_access_key"), ("b.csv", "private_key")], "path string, kind string")
    got = {r.path: (r.decision, r.reason) for r in admission.promotions(spark.createDataFrame(cases, "path string, content binary"), found).collect()}
    assert got == {"a.csv": ("promoted", None), "b.csv": ("held", "sensitive_aws_access_key"), "c.pdf": ("held", "not_inspectable"), "d.zip": ("held", "archive_not_promotable"), "e.ods": ("promoted", None)}


def test_faulty_workbooks_are_rows(spark):
    ship(spark)
    o, t = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"', 'xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0"'
    sheet = lambda rows, columns=1: zipped(**{"content.xml": f'<d {o} {t}><table:table table:name="T"><table:table-row table:number-rows-repeated="{rows}"><table:table-cell table:number-columns-repeated="{columns}" table:formula="of:=1"><text:p>x</text:p></table:table-cell></table:table-row></table:table></d>'.encode()})
    cases = [("a.ods", sheet(3000)), ("b.ods", sheet(200_001)), ("c.ods", sheet(1, 600)), ("d.xlsx", b"no package"), ("e.xlsx", zipped(a=b"x")), ("f.ods", zipped(**{"content.xml": b"<!DOCTYPE x><x/>"})), ("g.ods", zipped(**{"content.xml": b"<open"}))]
    df = spark.createDataFrame(cases, "path string, content binary")
    got = {r.path: (r.outcome, r.reason, r.rows, r.formulas) for r in workbook.workbook_summaries(df).collect()}
    assert got == {
        "a.ods": ("complete", None, 3000, 1), "b.ods": ("failed", "too_many_rows", 0, 0), "c.ods": ("failed", "too_many_columns", 0, 0), "d.xlsx": ("failed", "not_a_package", 0, 0), "e.xlsx": ("failed", "malformed", 0, 0),
        "f.ods": ("failed", "document_type", 0, 0), "g.ods": ("failed", "malformed", 0, 0),
    }
    assert workbook.read_workbooks(df).count() == 3000


def test_workbooks(spark):
    ship(spark)
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {m} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {m}><si><t>fecha</t></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {m}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {m}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>x</t></is></c></row><row r="3"><c r="A3" s="1"><v>45000.5</v></c><c r="B3" t="b"><v>1</v></c></row></sheetData></worksheet>')
    ods = io.BytesIO()
    o = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"'
    with zipfile.ZipFile(ods, "w") as z:
        z.writestr("content.xml", f'<office:document-content {o}><table:table table:name="T"><table:table-row table:number-rows-repeated="2"><table:table-cell office:value-type="float" office:value="1.5" table:number-columns-repeated="2"/><table:table-cell><text:p>a<text:span>b</text:span></text:p></table:table-cell></table:table-row></table:table></office:document-content>')
    df = spark.createDataFrame([("b.xlsx", out.getvalue()), ("b.ods", ods.getvalue())], "path string, content binary")
    got = sorted((r.path, r.sheet, r.record_ordinal, r.raw_values) for r in workbook.read_workbooks(df).collect())
    assert got == [("b.ods", "T", 1, ["1.5", "1.5", "ab"]), ("b.ods", "T", 2, ["1.5", "1.5", "ab"]), ("b.xlsx", "S", 1, ["fecha", "", "x"]), ("b.xlsx", "S", 3, ["2023-03-15T12:00:00", "true"])]
    assert workbook.letters(28) == "AB" and workbook.number_of("AB") == 28 and workbook.date_of(1, True) == "1904-01-02"


def test_exports(spark, tmp_path):
    m = movements(spark, "/root/testdata/sf0.001")
    text = F.when(F.col("movement_id") == "7", 'two\r\nlines, "quoted"').otherwise("=SUM(1)")
    rows = export.export_rows(m.withColumn("description", text).withColumn("record_ordinal", F.col("movement_id").cast("long")))
    assert tuple(rows.columns) == export.COLUMNS
    assert export.write_csv(rows, [F.col("record_ordinal").cast("long")], str(tmp_path / "csv")) == m.count()
    raw = b"".join(export.csv_bytes(str(tmp_path / "csv")))
    got = [*csv.reader(io.StringIO(raw.decode("utf-8-sig"), newline=""))]
    assert raw.startswith(b"\xef\xbb\xbfrecord_ordinal,movement_id,") and got[0] == [*export.COLUMNS] and raw.count(b"\r\n") == m.count() + 2
    assert [int(r[0]) for r in got[1:]] == sorted(int(r.movement_id) for r in m.select("movement_id").collect()) and {r[10] for r in got[1:]} == {"'=SUM(1)", 'two\r\nlines, "quoted"'}
    path = str(tmp_path / "m")
    export.write_movements(m, path)
    export.write_movements(m.where("dataset_version_id = 'A'").limit(5), path)
    left = {r.dataset_version_id: r.n for r in spark.read.parquet(path).groupBy("dataset_version_id").agg(F.count("*").alias("n")).collect()}
    assert left == {"A": 5, "B": m.where("dataset_version_id = 'B'").count()}


def test_streams_are_idempotent(spark, folder, tmp_path):
    ship(spark)
    path = str(tmp_path / "out")
    for _ in range(2):
        q = inbox.new_records(spark, folder).writeStream.foreachBatch(inbox.appended_once(path, ["sha256", "record_ordinal"])).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    batch = statement.read_statements(statement.files(spark, folder))
    assert spark.read.parquet(path).count() == batch.count()
    again = inbox.appended_once(path, ["sha256", "record_ordinal"])
    again(batch, 0)
    again(batch, 7)
    assert spark.read.parquet(path).count() == batch.count()


def test_delivery_states(spark, tmp_path):
    ship(spark)
    rows = [("d1", 1, "claim", 1), ("d1", 2, "retryable_failure", 1), ("d1", 3, "claim", 2), ("d1", 4, "succeed", 1), ("d1", 5, "succeed", 2), ("d2", 1, "succeed", 1), ("d3", 1, "claim", 1), ("d3", 2, "conflict", 1), ("d3", 3, "claim", 2)]
    spark.createDataFrame(rows, "delivery_id string, seq long, event string, token long").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("delivery_id string, seq long, event string, token long").parquet(str(tmp_path / "e"))
    q = inbox.delivery_states(stream).writeStream.outputMode("update").format("memory").queryName("deliveries").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.delivery_id: (r.state, r.stale) for r in spark.table("deliveries").collect()} == {"d1": ("succeeded", 1), "d2": ("received", 0), "d3": ("conflict", 0)}
