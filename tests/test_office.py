import io
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quireframe.operators import lookup
from quireframe.sources import office, pictures

REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
A, P, C = (f"http://schemas.openxmlformats.org/{x}/2006/main" for x in ("drawingml", "presentationml", "drawingml/chart"))


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def rels(*targets):
    return "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Type="{REL}/{kind}" Target="{target}"/>' for i, (kind, target) in enumerate(targets, 1)) + "</Relationships>"


XLSX = package({
    "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets><sheet name="One" sheetId="1" r:id="rId1"/><sheet name="Gone" sheetId="2" state="hidden" r:id="rId2"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": rels(("worksheet", "worksheets/sheet1.xml"), ("worksheet", "/xl/worksheets/sheet2.xml")),
    "xl/sharedStrings.xml": f'<sst xmlns="{MAIN}"><si><t>plain</t></si><si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si></sst>',
    "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{MAIN}"><cols><col min="2" max="16384" width="8.43" hidden="1"/></cols><sheetData><row r="1"><c r="A1" t="s"><v>1</v></c><c t="s"><v>9</v></c><c r="D1" t="b"><v>1</v></c></row>'
    '<row r="3" ht="30" hidden="1"><c r="A3"><f>SUM(A1:B2)</f><v>1.5</v></c><c r="B3" t="inlineStr"><is><t>in</t></is></c><c r="C3" t="e"><v>#N/A</v></c></row></sheetData><mergeCells><mergeCell ref="B2:C3"/></mergeCells></worksheet>',
    "xl/worksheets/sheet2.xml": f'<worksheet xmlns="{MAIN}"><sheetData/></worksheet>',
    "xl/charts/chart1.xml": f'<c:chartSpace xmlns:c="{C}"><c:chart><c:plotArea><c:barChart><c:ser><c:tx><c:v>x</c:v></c:tx><c:cat><c:pt idx="0"><c:v>a</c:v></c:pt></c:cat><c:val><c:pt idx="0"><c:v>1</c:v></c:pt><c:pt idx="2"><c:v>n/a</c:v></c:pt></c:val></c:ser></c:barChart>'
    '<c:scatterChart><c:ser><c:xVal><c:pt idx="0"><c:v>7</c:v></c:pt></c:xVal><c:yVal><c:pt idx="0"><c:v>8</c:v></c:pt></c:yVal></c:ser></c:scatterChart></c:plotArea></c:chart></c:chartSpace>',
})
DOCX = package({
    "word/document.xml": f'<w:document xmlns:w="{W}"><w:body><w:p><w:pPr><w:pStyle w:val="H2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:pPr><w:numPr><w:ilvl w:val="1"/><w:numId w:val="4"/></w:numPr></w:pPr><w:ins><w:r><w:t>kept</w:t></w:r></w:ins><w:del><w:r><w:delText>x</w:delText><w:t>gone</w:t></w:r></w:del><w:r><w:br w:type="page"/></w:r></w:p>'
    "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>",
    "word/styles.xml": f'<w:styles xmlns:w="{W}"><w:style w:styleId="H1"><w:name w:val="heading 1"/><w:pPr><w:outlineLvl w:val="0"/></w:pPr></w:style><w:style w:styleId="H2"><w:basedOn w:val="H1"/></w:style><w:style w:styleId="X"><w:basedOn w:val="Y"/></w:style><w:style w:styleId="Y"><w:basedOn w:val="X"/></w:style></w:styles>',
})
PPTX = package({
    "ppt/presentation.xml": f'<p:presentation xmlns:p="{P}" xmlns:r="{REL}"><p:sldIdLst><p:sldId id="256" r:id="rId2"/><p:sldId id="257" r:id="rId1"/></p:sldIdLst></p:presentation>',
    "ppt/_rels/presentation.xml.rels": rels(("slide", "slides/slide1.xml"), ("slide", "slides/slide2.xml")),
    "ppt/slides/slide1.xml": f'<p:sld xmlns:p="{P}" xmlns:a="{A}" show="0"><p:cSld><p:spTree><p:grpSp><p:pic><p:nvPicPr><p:cNvPr name="pic"/></p:nvPicPr></p:pic></p:grpSp><p:graphicFrame><a:tbl><a:tr/><a:tr/></a:tbl></p:graphicFrame></p:spTree></p:cSld></p:sld>',
    "ppt/slides/slide2.xml": f'<p:sld xmlns:p="{P}" xmlns:a="{A}"><p:cSld><p:spTree><p:sp><p:nvSpPr><p:cNvPr name="t"/><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>Hel</a:t></a:r><a:r><a:t>lo</a:t></a:r></a:p></p:txBody></p:sp></p:spTree></p:cSld></p:sld>',
    "ppt/slides/_rels/slide2.xml.rels": rels(("notesSlide", "../notesSlides/notes1.xml")),
    "ppt/notesSlides/notes1.xml": f'<p:notes xmlns:p="{P}" xmlns:a="{A}"><p:cSld><p:spTree><p:sp><p:nvSpPr><p:nvPr><p:ph type="body"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>say this</a:t></a:r></a:p></p:txBody></p:sp></p:spTree></p:cSld></p:notes>',
})


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("office")
    for name, data in {"a.xlsx": XLSX, "b.docx": DOCX, "c.pptx": PPTX, "broken.xlsx": XLSX[:200], "text.docx": b"no package"}.items():
        (folder / name).write_bytes(data)
    return office.read_files(spark, str(folder))


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_packages(files):
    assert office.entries(files).where("file_id LIKE '%a.xlsx'").count() == 6
    assert {r.file_id.rpartition("/")[2] for r in office.problems(files).collect()} == {"broken.xlsx", "text.docx"}
    assert ("xl/workbook.xml", "rId2", "xl/worksheets/sheet2.xml", "worksheet") in rows(office.relationships(files), "part", "rel_id", "target", "type")


def test_cells(files):
    assert sorted(rows(office.sheets(files), "sheet_id", "name", "state")) == [("1", "One", "visible"), ("2", "Gone", "hidden")]
    found = sorted(rows(office.cells(files), "row_index", "column_index", "ref", "value", "num_value", "formula"))
    assert found == [(1, 1, "A1", "rich", None, None), (1, 2, "B1", "", None, None), (1, 4, "D1", "TRUE", None, None), (3, 1, "A3", "1.5", 1.5, "SUM(A1:B2)"), (3, 2, "B3", "in", None, None), (3, 3, "C3", "#N/A", None, None)]
    assert rows(office.merges(files), "start_row", "start_column", "end_row", "end_column") == [(2, 2, 3, 3)]
    assert sorted(rows(office.axis_metrics(files), "axis", "first", "last", "size", "hidden")) == [("column", 2, 16384, 8.43, True), ("row", 3, 3, 30.0, True)]


def test_blocks_and_inherited_levels(files):
    assert rows(office.blocks(files).orderBy("ord"), "type", "text", "style_id", "num_id", "num_level", "page_break") == [("paragraph", "Head", "H2", None, None, False), ("paragraph", "kept", None, "4", 1, True), ("table_row", "a|b", None, None, None, False)]
    levels = lookup.inherit(office.styles(files), ["outline_level"])
    assert dict(rows(levels, "style_id", "outline_level")) == {"H1": 0, "H2": 0, "X": None, "Y": None}


def test_slides_and_charts(files):
    found = rows(office.slide_elements(files).orderBy("slide_index", "ord"), "slide_index", "hidden", "type", "placeholder", "text", "row_count")
    assert found == [(1, False, "text", "title", "Hello", 0), (1, False, "notes", "body", "say this", 0), (2, True, "image", None, "", 0), (2, True, "table", None, "", 2)]
    points = rows(office.chart_points(files).orderBy("series", "idx"), "type", "series_name", "idx", "category", "value", "x")
    assert points == [("bar", "Series 1", 0, "a", 1.0, None), ("bar", "Series 1", 2, None, None, None), ("scatter", "Series 2", 0, None, 8.0, 7.0)]


def test_sheets_are_peeked_at_and_styles_read(spark):
    styles = f'<styleSheet xmlns="{MAIN}"><numFmts><numFmt numFmtId="170" formatCode="yyyy/m/d"/><numFmt numFmtId="171" formatCode="odd"/></numFmts><cellStyleXfs><xf numFmtId="9"/></cellStyleXfs><cellXfs><xf/><xf numFmtId="170"/><xf numFmtId="10"/><xf numFmtId="171"/></cellXfs></styleSheet>'
    sheet = f'<worksheet xmlns="{MAIN}"><dimension ref="B2:D9"/><sheetData><row r="1"><c r="A1" s="1"><v>45000</v></c><c r="B1" s="2"><v>0.125</v></c><c r="C1" s="3"><v>1.50</v></c><c r="D1"><v>2</v></c></row></sheetData></worksheet>'
    book = {"xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets><sheet name="One" sheetId="1" r:id="rId1"/><sheet name="Two" sheetId="2" r:id="rId2"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": rels(("worksheet", "worksheets/sheet1.xml"), ("worksheet", "worksheets/sheet2.xml"))}
    good = package(book | {"xl/styles.xml": styles, "xl/worksheets/sheet1.xml": sheet, "xl/worksheets/sheet2.xml": f'<worksheet xmlns="{MAIN}"><sheetData/></worksheet>'})
    broken = package(book | {"xl/worksheets/sheet1.xml": sheet.replace("</row>", "</row>" + "<row r='2'><c r='A2'><v>1</v></c></row>" * 6000 + "<row>"), "xl/worksheets/sheet2.xml": "<x/>"})
    files = spark.createDataFrame([("good", bytearray(good)), ("broken", bytearray(broken))], "file_id string, content binary")
    seen = {(r.file_id, r.name): (r.dimension, r.rows, r.columns) for r in office.peek(files).collect()}
    assert seen["good", "One"] == ("B2:D9", 8, 3) and seen["good", "Two"] == (None, None, None)
    assert {r.file_id for r in office.cells(files).collect()} == {"good"}  # no part of a broken file
    assert {r.file_id for r in office.problems(files).collect()} == {"broken"}
    formats = {r.style_id: (r.format_id, r.code) for r in office.number_formats(files).collect()}
    assert formats == {0: (0, "General"), 1: (170, "yyyy/m/d"), 2: (10, "0.00%"), 3: (171, "odd")}
    shown = {r.ref: r.shown for r in office.displayed(office.cells(files), office.number_formats(files), ("0.00%", "yyyy/m/d")).collect()}
    assert shown == {"A1": "2023-03-15", "B1": "12.50%", "C1": "1.5", "D1": "2"}


def test_styles_with_exponents_show_halves_as_printf_does(spark):
    styles = f'<styleSheet xmlns="{MAIN}"><cellXfs><xf/><xf numFmtId="11"/></cellXfs></styleSheet>'
    numbers_ = ["-496.5", "-497.5", "-33.65", "-0.0", "0"]
    sheet = f'<worksheet xmlns="{MAIN}"><sheetData>' + "".join(f'<row r="{i}"><c r="B{i}" s="1"><v>{x}</v></c></row>' for i, x in enumerate(numbers_, 1)) + "</sheetData></worksheet>"
    book = {"xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets><sheet name="One" sheetId="1" r:id="rId1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": rels(("worksheet", "worksheets/sheet1.xml"))}
    files = spark.createDataFrame([("a", bytearray(package(book | {"xl/styles.xml": styles, "xl/worksheets/sheet1.xml": sheet})))], "file_id string, content binary")
    shown = {r.ref: r.shown for r in office.displayed(office.cells(files), office.number_formats(files)).collect()}
    assert shown == {"B1": "-4.96E+2", "B2": "-4.98E+2", "B3": "-3.36E+1", "B4": "-0.00E+0", "B5": "0.00E+0"}


def test_parts_are_found_without_going_through_all_names(monkeypatch):
    """A text document with a header a section: the package's names are listed no more often than with one."""
    listed = []
    names = zipfile.ZipFile.namelist
    monkeypatch.setattr(zipfile.ZipFile, "namelist", lambda z: listed.append(1) or names(z))
    n = 300
    body = "".join(f'<w:p><w:pPr><w:sectPr><w:headerReference w:type="default" r:id="rId{i}"/></w:sectPr></w:pPr></w:p>' for i in range(1, n + 1))
    parts = {f"word/header{i}.xml": f'<w:hdr xmlns:w="{W}"><w:p><w:r><w:t>h{i}</w:t></w:r></w:p></w:hdr>' for i in range(1, n + 1)}
    parts |= {"word/document.xml": f'<w:document xmlns:w="{W}" xmlns:r="{REL}"><w:body>{body}</w:body></w:document>', "word/_rels/document.xml.rels": rels(*(("header", f"header{i}.xml") for i in range(1, n + 1)))}

    class Here:  # what reads the packages, run here
        def mapInPandas(self, run, _):  # noqa: N802
            return list(run(iter([pd.DataFrame({"file_id": ["a"], "content": [package(parts)]})])))

    found = pd.concat(office.regions(Here()))
    assert list(found["text"]) == [f"h{i}" for i in range(1, n + 1)]
    assert len(listed) < 10


def test_contents_are_made_once(spark):
    """A file's content may be computed: no filter asks for it besides the reading; one that is null has no rows."""
    made = F.pandas_udf(lambda ids: pd.Series([XLSX if x == "a" else None for x in ids]), "binary")
    found = office.sheets(spark.range(2).select(F.element_at(F.array(F.lit("a"), F.lit("b")), (F.col("id") + 1).cast("int")).alias("file_id")).select("file_id", made("file_id").alias("content")))
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert {r.file_id for r in found.collect()} == {"a"}


def test_parts_of_packages_are_not_broadcast(spark, tmp_path):
    """A small table of packages, as Spark takes it, can have many cells, strings and pictures: they do not go through the driver."""
    content = bytes(package({"xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets><sheet name="S" sheetId="1"/></sheets></workbook>', "xl/media/i.png": "x", "xl/media/j.png": "x",
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{MAIN}"><sheetData><row r="1">' + "".join(f'<c r="{c}1" t="str"><f>DISPIMG("{c}",1)</f></c>' for c in "ABCD") + "</row></sheetData></worksheet>",
        "xl/cellimages.xml": f'<x xmlns:r="{REL}">' + "".join(f'<cellImage><cNvPr name="{c}"/><blip r:embed="rId{i}"/></cellImage>' for i, c in enumerate("ABC", 1)) + "</x>",
        "xl/_rels/cellimages.xml.rels": rels(("image", "media/i.png"), ("image", "elsewhere/j.png"), ("image", "media/none.png"))}))
    spark.createDataFrame([("a", bytearray(content))], "file_id string, content binary").write.parquet(str(tmp_path / "files"))
    found = pictures.cell_images(spark.read.parquet(str(tmp_path / "files")))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.image_id: r.path for r in found.collect()} == {"A": "xl/media/i.png", "B": "xl/media/j.png", "C": None, "D": None}


def test_files_with_more_rows_than_are_held(spark):
    """60,000 cells come whole; as many with a broken end give none."""

    def workbook(end):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("xl/workbook.xml", '<workbook><sheets><sheet name="S" sheetId="1"/></sheets></workbook>')
            z.writestr("xl/worksheets/sheet1.xml", "<worksheet><sheetData>" + "".join(f'<row r="{i}">' + "<c><v>1</v></c>" * 20 + "</row>" for i in range(1, 3001)) + end)
        return out.getvalue()

    files = spark.createDataFrame([("good", workbook("</sheetData></worksheet>")), ("bad", workbook("<"))], "file_id string, content binary")
    found = office.cells(files).groupBy("file_id").count().collect()
    assert [tuple(r) for r in found] == [("good", 60_000)]
