"""XLSX workbooks as tables: parts of the package, elements of their XML, and by joins over these what a workbook holds and its rows.

Python takes a package apart and its XML to elements, piece by piece; all that follows (sheets and their relations, shared strings, number formats, dates, blank cells) is
expressions, joins and windows over the elements, so that large sheets are worked on by many tasks. Every element has its number in the order of the part and that of its parent.

What is not known to be passive is active: parts are told by a list of those that may be there. A workbook that is malformed, over a limit or has a document type has a problem and
no rows.
"""

from __future__ import annotations

import zipfile
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.rounds import settled
from .workbook import DATE_FORMATS, MOST_CHARS, MOST_COLUMNS, MOST_ROWS, Refused, package

#: What the main part is declared to be, parts without effects of their own, and the namespaces.
MAIN_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"
PASSIVE_PARTS = ("[content_types].xml", "_rels/.rels", "docprops/app.xml", "docprops/core.xml", "xl/workbook.xml", "xl/_rels/workbook.xml.rels", "xl/sharedstrings.xml", "xl/styles.xml", "xl/theme/theme1.xml")
PASSIVE_SHEETS = "^xl/worksheets/sheet[1-9][0-9]*[.]xml$"
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATION = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
#: Parts that belong to every workbook.
REQUIRED = ("[Content_Types].xml", "xl/workbook.xml", "xl/_rels/workbook.xml.rels")
DAY = 86_400_000_000

PART = "path string, part string, bytes long, xml binary, problem string"
ELEMENT = "path string, part string, n long, up long, tag string, attributes map<string,string>, text string, problem string"


def parts(contents: DataFrame) -> DataFrame:
    """The parts of each package (path, content), XML with its bytes; a package that breaks a limit is one row with the problem."""

    def run(batches):
        for batch in batches:
            for path, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                try:
                    with package(payload) as z:
                        for e in z.infolist():
                            is_xml = e.filename.lower().endswith((".xml", ".rels"))
                            rows.append((path, e.filename, e.file_size, z.read(e) if is_xml else None, None))
                except (Refused, zipfile.BadZipFile, NotImplementedError, RuntimeError, OSError) as e:
                    rows = [(path, None, 0, None, str(e) if isinstance(e, Refused) else "malformed")]
                types = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=[x.split()[0] for x in PART.split(", ")])

    return contents.select("path", "content").mapInArrow(run, PART)


def elements(parts_: DataFrame) -> DataFrame:
    """The elements of all XML parts. A part that cannot be read ends in a row with the problem."""

    def run(batches):
        for batch in batches:
            for path, part, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from read(path, part, raw)

    def read(path, part, raw):
        open_: list[list] = []
        done: list[tuple] = []
        count = 0

        def start(name, attributes):
            nonlocal count
            named = {("r:" if a.startswith(RELATION) else "") + a.rpartition(" ")[2]: v for a, v in attributes.items()}
            open_.append([count, open_[-1][0] if open_ else None, name.rpartition(" ")[2], named, []])
            count += 1

        def end(_):
            n, up, tag, attributes, text = open_.pop()
            done.append((path, part, n, up, tag, attributes, "".join(text), None))

        def document_type(*_):
            raise Refused("document_type")

        parser = expat.ParserCreate(namespace_separator=" ")
        parser.StartElementHandler, parser.EndElementHandler, parser.StartDoctypeDeclHandler = start, end, document_type
        parser.CharacterDataHandler = lambda text: open_[-1][4].append(text)
        try:
            for at in range(0, len(raw), 1 << 16):
                parser.Parse(raw[at : at + (1 << 16)], False)
                yield out(done)
                done.clear()
            parser.Parse(b"", True)
        except (expat.ExpatError, Refused) as e:
            done.append((path, part, None, None, None, None, None, str(e) if isinstance(e, Refused) else "malformed"))
        yield out(done)

    def out(rows):
        types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[k] if k != 5 or r[k] is None else [*r[k].items()] for r in rows], t) for k, t in enumerate(types)], names=[x.split()[0] for x in ELEMENT.replace("map<string,string>", "map").split(", ")])

    return parts_.where("xml IS NOT NULL").select("path", "part", "xml").mapInArrow(run, ELEMENT)


def attribute(name: str) -> Column:
    return F.try_element_at("attributes", F.lit(name))


def sheets(e: DataFrame) -> DataFrame:
    """``path, ordinal, name, state, part, sheet_identity``: the sheets that a workbook declares, in order, with their parts by relation; the identity is of relations and not of the name."""
    said = e.where("part = 'xl/workbook.xml' AND tag = 'sheet'")
    place = F.row_number().over(Window.partitionBy("path").orderBy("n"))
    said = said.select("path", place.alias("ordinal"), F.trim(attribute("name")).alias("name"), F.coalesce(attribute("state"), F.lit("visible")).alias("state"), attribute("sheetId").alias("sheet_id"), attribute("r:id").alias("relation"))
    target = attribute("Target")
    at = F.when(F.startswith(target, F.lit("/")), F.ltrim(target, F.lit("/"))).otherwise(F.concat(F.lit("xl/"), target))
    links = e.where("part = 'xl/_rels/workbook.xml.rels' AND tag = 'Relationship'").select("path", attribute("Id").alias("relation"), at.alias("part"))
    found = said.join(links, ["path", "relation"], "left")
    identity = F.sha2(F.concat_ws("|", F.coalesce("sheet_id", F.lit("")), "relation", "part"), 256)
    return found.select("path", "ordinal", "name", "state", "part", identity.alias("sheet_identity"))


def inspections(contents: DataFrame) -> DataFrame:
    """``path, problem, sheets, formulas, active_parts, external_relations, supported`` of each workbook. Supported is one visible sheet without formulas in a package that holds nothing active and points nowhere."""
    p = settled(parts(contents))
    e = settled(elements(p))
    low = F.lower("part")
    passive = low.isin(*PASSIVE_PARTS) | low.rlike(PASSIVE_SHEETS)
    of_parts = p.groupBy("path").agg(F.max("problem").alias("broken"), F.count_if(~passive).alias("active_parts"), F.count_distinct(F.when(F.col("part").isin(*REQUIRED), F.col("part"))).alias("required"))
    found = sheets(e)
    main = (F.col("tag") == "Override") & (F.ltrim(attribute("PartName"), F.lit("/")) == "xl/workbook.xml") & (F.col("part") == "[Content_Types].xml")
    outside = F.endswith(low, F.lit(".rels")) & (F.lower(attribute("TargetMode")) == "external")
    of_elements = e.groupBy("path").agg(F.max("problem").alias("unread"), F.count_if(outside).alias("external_relations"), F.count_if(main).alias("mains"), F.count_if(main & (attribute("ContentType") == MAIN_TYPE)).alias("safe"))
    formulas = e.where("tag = 'f'").join(found.select("path", "part").distinct(), ["path", "part"], "left_semi").groupBy("path").agg(F.count("*").alias("formulas"))
    held = p.where("part IS NOT NULL").select("path", "part", F.lit(True).alias("there"))
    of_sheets = found.join(held, ["path", "part"], "left").groupBy("path").agg(F.count("*").alias("sheets"), F.bool_or((F.coalesce("name", F.lit("")) == "") | F.col("there").isNull()).alias("lost"), F.bool_and(F.col("state") == "visible").alias("visible"))
    both = of_parts.join(of_elements, "path", "left").join(of_sheets, "path", "left").join(formulas, "path", "left")
    problem = (
        F.when(F.col("broken").isNotNull(), F.col("broken")).when(F.col("required") < len(REQUIRED), "incomplete").when(F.col("unread").isNotNull(), F.col("unread"))
        .when((F.col("mains") != 1) | (F.col("safe") != 1), "content_type").when(F.col("sheets").isNull(), "no_sheets").when(F.col("lost"), "sheet_without_part")
    )
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = both.select("path", problem.alias("problem"), n("sheets"), n("formulas"), n("active_parts"), n("external_relations"), "visible")
    fine = F.col("problem").isNull() & (F.col("sheets") == 1) & F.col("visible") & (F.col("formulas") == 0) & (F.col("active_parts") == 0) & (F.col("external_relations") == 0)
    return out.withColumn("supported", F.coalesce(fine, F.lit(False))).drop("visible")


def texts_below(e: DataFrame, holder: str) -> DataFrame:
    """``path, part, n, text``: the text of each element ``holder``, its own t and those of its rich text runs, in order; reading aids are left out."""
    t = e.where("tag = 't'").select("path", "part", F.col("n").alias("at"), "text", F.col("up").alias("n"))
    runs = e.where("tag = 'r'").select("path", "part", "n", F.col("up").alias("above"))
    placed = t.join(runs, ["path", "part", "n"], "left").select("path", "part", "at", "text", F.coalesce("above", "n").alias("n"))
    mine = placed.join(e.where(F.col("tag") == holder).select("path", "part", "n"), ["path", "part", "n"])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "")
    return mine.groupBy("path", "part", "n").agg(joined.alias("text"))


def iso_of(serial: Column, from_1904: Column) -> Column:
    """A serial day as ISO text, its fraction the time, to microseconds with halves to the even one."""
    micros = F.bround(serial.cast("decimal(38,15)") * F.lit(DAY).cast("decimal(12,0)"), 0).cast("long")
    days = F.floor(micros / DAY).cast("int")
    rest = micros - days.cast("long") * DAY
    first = F.when(from_1904, F.lit("1904-01-01")).otherwise("1899-12-30").cast("date")
    seconds = F.floor(rest / 1_000_000)
    clock = F.format_string("T%02d:%02d:%02d", F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60)
    part = F.when(rest % 1_000_000 != 0, F.format_string(".%06d", rest % 1_000_000)).otherwise("")
    return F.concat(F.date_add(first, days).cast("string"), F.when(rest == 0, "").otherwise(F.concat(clock, part)))


def column_number(cell: Column) -> Column:
    letters = F.regexp_extract(cell, "^[A-Z]+", 0)
    return F.when(letters != "", F.aggregate(F.split(letters, ""), F.lit(0), lambda n, c: n * 26 + F.ascii(c) - 64))


def sheet_rows(contents: DataFrame) -> DataFrame:
    """``path, sheet, record_ordinal, raw_values, problem`` of all workbooks' sheets; cells that are left out before the last are blank. Rows of a file with a problem are
    left out but for one that says so."""
    p = settled(parts(contents))
    e = settled(elements(p))
    broken = p.where("problem IS NOT NULL").select("path", "problem").unionByName(e.where("problem IS NOT NULL").select("path", "problem")).groupBy("path").agg(F.min("problem").alias("problem"))
    e = e.where("problem IS NULL")
    number = lambda order: F.row_number().over(Window.partitionBy("path").orderBy(order)) - 1
    strings = e.where("part = 'xl/sharedStrings.xml' AND tag = 'si'").select("path", "part", "n", number("n").alias("k"))
    strings = strings.join(texts_below(e.where("part = 'xl/sharedStrings.xml'"), "si"), ["path", "part", "n"], "left").select("path", F.col("k").cast("string").alias("v"), F.coalesce("text", F.lit("")).alias("shared"))
    styles = e.where("part = 'xl/styles.xml'")
    formats = styles.where("tag = 'cellXfs'").select("path", F.col("n").alias("up")).join(styles.where("tag = 'xf'"), ["path", "up"]).select("path", "n", F.coalesce(attribute("numFmtId"), F.lit("0")).alias("format"))
    codes = styles.where("tag = 'numFmt'").select("path", attribute("numFmtId").alias("format"), attribute("formatCode").alias("code"))
    dated = F.col("format").cast("int").isin(*sorted(DATE_FORMATS)) | F.coalesce(F.regexp_replace("code", r'"[^"]*"|\[[^]]*\]', "").rlike("(?i)[ymdhs]"), F.lit(False))
    formats = formats.withColumn("k", number("n")).join(codes, ["path", "format"], "left").select("path", F.col("k").cast("string").alias("s"), dated.alias("dated"))
    calendar = e.where("part = 'xl/workbook.xml' AND tag = 'workbookPr'").groupBy("path").agg(F.bool_or(attribute("date1904").isin("1", "true")).alias("from_1904"))
    in_sheet = e.join(sheets(e).select("path", "part", F.col("name").alias("sheet"), "ordinal"), ["path", "part"])
    keys = ["path", "part"]
    rows = in_sheet.where("tag = 'row'").select(*keys, "sheet", F.col("n").alias("row"), F.coalesce(attribute("r").cast("int"), F.row_number().over(Window.partitionBy(*keys).orderBy("n"))).alias("record_ordinal"))
    c = in_sheet.where("tag = 'c'").select(*keys, F.col("n").alias("cell"), F.col("up").alias("row"), attribute("t").alias("kind"), F.coalesce(attribute("s"), F.lit("0")).alias("s"), column_number(attribute("r")).alias("column"), F.row_number().over(Window.partitionBy(*keys, "up").orderBy("n")).alias("place"))
    v = in_sheet.where("tag = 'v'").select(*keys, F.col("up").alias("cell"), F.col("text").alias("v"))
    own = texts_below(in_sheet.select(*e.columns), "is").join(in_sheet.where("tag = 'is'").select(*keys, "n", F.col("up").alias("cell")), [*keys, "n"]).select(*keys, "cell", F.col("text").alias("inline"))
    cells = c.join(v, [*keys, "cell"], "left").join(own, [*keys, "cell"], "left").join(strings, ["path", "v"], "left").join(formats, ["path", "s"], "left").join(calendar, "path", "left")
    is_date = F.coalesce(F.col("dated"), F.lit(False)) & F.col("v").isNotNull() & F.coalesce(F.col("kind") == "n", F.lit(True))
    value = F.when(F.col("kind") == "s", F.col("shared")).when(F.col("kind") == "inlineStr", F.col("inline")).when(F.col("kind") == "b", F.when(F.col("v") == "1", "true").otherwise("false")).when(is_date, iso_of(F.expr("try_cast(v AS decimal(38,15))"), F.coalesce("from_1904", F.lit(False)))).otherwise(F.col("v"))
    lost = ((F.col("kind") == "s") & F.col("shared").isNull()) | (is_date & F.expr("try_cast(v AS decimal(38,15))").isNull())
    cells = cells.select(*keys, "row", F.coalesce("column", "place").alias("column"), F.coalesce(value, F.lit("")).alias("value"), F.when(F.coalesce(lost, F.lit(False)), "malformed").alias("wrong"))
    # of cells that name one place the largest stays
    cells = cells.groupBy(*keys, "row", "column").agg(F.max("value").alias("value"), F.max("wrong").alias("wrong"))
    wide = F.when(F.max("column") > MOST_COLUMNS, "too_many_columns").when(F.max(F.length("value")) > MOST_CHARS, "cell_too_long")
    few = F.when(F.col("column") <= MOST_COLUMNS, F.struct("column", F.substring("value", 1, MOST_CHARS + 1).alias("value")))
    by_row = cells.groupBy(*keys, "row").agg(F.coalesce(F.max("wrong"), wide).alias("wrong"), F.max("column").alias("width"), F.map_from_entries(F.collect_list(few)).alias("held"))
    filled = F.transform(F.sequence(F.lit(1), F.least("width", F.lit(MOST_COLUMNS))), lambda k: F.coalesce(F.try_element_at("held", k), F.lit("")))
    found = settled(rows.join(by_row, [*keys, "row"], "left").select("path", "sheet", "record_ordinal", F.when(F.col("width").isNull(), F.array().cast("array<string>")).otherwise(filled).alias("raw_values"), "wrong"))
    many = found.groupBy("path").agg(F.coalesce(F.min("wrong"), F.when(F.count("*") > MOST_ROWS, "too_many_rows")).alias("problem")).where("problem IS NOT NULL")
    problems = settled(broken.unionByName(many).groupBy("path").agg(F.min("problem").alias("problem")))
    good = found.drop("wrong").join(problems, "path", "left_anti").withColumn("problem", F.lit(None).cast("string"))
    return good.unionByName(problems.select("path", "problem"), allowMissingColumns=True)
