"""Queries of the office source: small packages are made of table rows in each task, and read back as tables."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType

from quireframe.operators import documents, lineage
from quireframe.plans.documents import LINES_SQL
from quireframe.plans.registry import query, table
from quireframe.sources import office, sheets

RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
SLIDE = "http://schemas.openxmlformats.org/presentationml/2006/main"
DRAWING = "http://schemas.openxmlformats.org/drawingml/2006/main"


def package(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def relations(targets: list[str], kind: str) -> str:
    return "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Type="{RELATIONS}/{kind}" Target="{t}"/>' for i, t in enumerate(targets, 1)) + "</Relationships>"


@pandas_udf(BinaryType())
def _workbook(rows: pd.Series) -> pd.Series:
    """Rows of (name, balance) as a workbook with one sheet; names are shared strings."""

    def one(items) -> bytes:
        names = sorted({r["name"] for r in items})
        at = {n: i for i, n in enumerate(names)}
        cells = "".join(f'<row r="{i}"><c r="A{i}" t="s"><v>{at[r["name"]]}</v></c><c r="B{i}" s="{1 if r["balance"] > 0 else 2}"><v>{r["balance"]!r}</v></c><c r="C{i}" t="b"><v>{int(r["balance"] > 0)}</v></c></row>' for i, r in enumerate(items, 1))
        return package({
            "xl/workbook.xml": f'<workbook xmlns="{SHEET}" xmlns:r="{RELATIONS}"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": relations(["worksheets/sheet1.xml"], "worksheet"),
            "xl/sharedStrings.xml": f'<sst xmlns="{SHEET}">' + "".join(f"<si><t>{escape(n)}</t></si>" for n in names) + "</sst>",
            "xl/styles.xml": f'<styleSheet xmlns="{SHEET}"><numFmts><numFmt numFmtId="164" formatCode="0.00E+00"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="4"/><xf numFmtId="164"/></cellXfs></styleSheet>',
            "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{SHEET}"><dimension ref="A1:C{len(items)}"/><sheetData>{cells}</sheetData><mergeCells><mergeCell ref="A1:B{len(items)}"/></mergeCells></worksheet>',
        })

    return pd.Series([one(r) for r in rows])


@pandas_udf(BinaryType())
def _text_document(paragraphs: pd.Series) -> pd.Series:
    body = lambda ps: "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(p)}</w:t></w:r></w:p>' for p in ps)
    return pd.Series([package({"word/document.xml": f'<w:document xmlns:w="{WORD}"><w:body>{body(ps)}</w:body></w:document>'}) for ps in paragraphs])


@pandas_udf(BinaryType())
def _deck(turns: pd.Series) -> pd.Series:
    """Turns (role, text) as slides: the role is the title, the text the body."""
    shape = lambda kind, text: f'<p:sp><p:nvSpPr><p:cNvPr id="1" name="{kind}"/><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:txBody>' + "".join(f"<a:p><a:r><a:t>{escape(x)}</a:t></a:r></a:p>" for x in text.split("\n")) + "</p:txBody></p:sp>"

    def one(items) -> bytes:
        parts = {f"ppt/slides/slide{i}.xml": f'<p:sld xmlns:p="{SLIDE}" xmlns:a="{DRAWING}"><p:cSld><p:spTree>{shape("title", t["role"])}{shape("body", t["text"])}</p:spTree></p:cSld></p:sld>' for i, t in enumerate(items, 1)}
        ids = "".join(f'<p:sldId id="{255 + i}" r:id="rId{i}"/>' for i in range(1, len(items) + 1))
        parts["ppt/presentation.xml"] = f'<p:presentation xmlns:p="{SLIDE}" xmlns:r="{RELATIONS}"><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>'
        parts["ppt/_rels/presentation.xml.rels"] = relations([f"slides/slide{i}.xml" for i in range(1, len(items) + 1)], "slide")
        return package(parts)

    return pd.Series([one(r) for r in turns])


def workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, content): a workbook for every 50 suppliers."""
    suppliers = table(spark, sf_dir, "supplier").groupBy(F.floor(F.col("s_suppkey") / 50).cast("string").alias("file_id"))
    rows = suppliers.agg(F.array_sort(F.collect_list(F.struct("s_suppkey", F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")))).alias("rows"))
    return rows.select("file_id", _workbook("rows").alias("content"))


@query(
    "office_cells",
    """WITH n AS (SELECT CAST(s_suppkey // 50 AS VARCHAR) AS file_id, CAST(row_number() OVER (PARTITION BY s_suppkey // 50 ORDER BY s_suppkey) AS INT) AS row_index, s_name, s_acctbal FROM supplier),
c AS (SELECT file_id, row_index, 1 AS k, 's' AS type, s_name AS value, NULL::DOUBLE AS num_value FROM n UNION ALL SELECT file_id, row_index, 2, 'n', CAST(s_acctbal AS VARCHAR), s_acctbal FROM n
  UNION ALL SELECT file_id, row_index, 3, 'b', CASE WHEN s_acctbal > 0 THEN 'TRUE' ELSE 'FALSE' END, NULL FROM n)
SELECT file_id, row_index, CAST(k AS INT) AS column_index, chr(64 + k) || row_index AS ref, type, value, num_value FROM c""",
)
def office_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-XLSX, SRC-XLSX-CELLS, SRC-ZIP, SRC-SAX, SRC-XML, SRC-RELS, JN-SST, SO-CELLS: the cells of workbooks."""
    return office.cells(workbooks(spark, sf_dir)).select("file_id", "row_index", "column_index", "ref", "type", "value", "num_value")


@query("office_merges", "SELECT CAST(s_suppkey // 50 AS VARCHAR) AS file_id, 'A1:B' || count(*) AS ref, CAST(1 AS INT) AS start_row, CAST(1 AS INT) AS start_column, CAST(count(*) AS INT) AS end_row, CAST(2 AS INT) AS end_column FROM supplier GROUP BY s_suppkey // 50")
def office_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-XLSX-CELLS: the merged ranges of workbooks."""
    return office.merges(workbooks(spark, sf_dir)).drop("sheet_id")


@query("office_peek", "SELECT CAST(s_suppkey // 50 AS VARCHAR) AS file_id, '1' AS sheet_id, 'A1:C' || count(*) AS dimension, CAST(count(*) AS INT) AS rows, CAST(3 AS INT) AS columns FROM supplier GROUP BY s_suppkey // 50")
def office_peek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-XLSX-PEEK: the sizes that sheets say they have, read without their cells."""
    return office.peek(workbooks(spark, sf_dir)).select("file_id", "sheet_id", "dimension", "rows", "columns")


@query(
    "office_styles",
    r"""WITH n AS (SELECT CAST(s_suppkey // 50 AS VARCHAR) AS file_id, 'B' || row_number() OVER (PARTITION BY s_suppkey // 50 ORDER BY s_suppkey) AS ref, s_acctbal > 0 AS up, s_acctbal AS x FROM supplier)
SELECT file_id, ref, CAST(CASE WHEN up THEN 1 ELSE 2 END AS INT) AS style_id, CASE WHEN up THEN '#,##0.00' ELSE '0.00E+00' END AS code,
  CASE WHEN up THEN format('{:,.2f}', x) ELSE regexp_replace(printf('%.2E', x), 'E([+-])0(\d)$', 'E\1\2') END AS shown FROM n""",
)
def office_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-XLSX: numbers of workbooks as their styles' formats show them."""
    files = workbooks(spark, sf_dir)
    shown = office.displayed(office.cells(files), office.number_formats(files))
    return shown.where("type = 'n'").select("file_id", "ref", "style_id", "code", "shown")


@query("office_blocks", rf"WITH {LINES_SQL} SELECT CAST(doc_id AS VARCHAR) AS file_id, ord, 'paragraph' AS type, text FROM p")
def office_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-DOCX, SRC-DOCX-STREAM: the paragraphs of text documents."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_id"), documents.lines_of(F.col("text")).alias("p"))
    files = docs.withColumn("content", _text_document("p")).drop("p")
    return office.blocks(files).select("file_id", "ord", "type", "text")


@query(
    "office_slides",
    """WITH n AS (SELECT CAST(conv_id AS VARCHAR) AS file_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS slide_index, role, text FROM conversations)
SELECT file_id, slide_index, CAST(0 AS INT) AS ord, 'text' AS type, 'title' AS placeholder, role AS text FROM n UNION ALL SELECT file_id, slide_index, CAST(1 AS INT), CASE WHEN trim(text) = '' THEN 'shape' ELSE 'text' END, 'body', text FROM n""",
)
def office_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-PPTX: the elements of decks."""
    turns = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("file_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    files = turns.select("file_id", _deck("t").alias("content"))
    return office.slide_elements(files).select("file_id", "slide_index", "ord", "type", "placeholder", "text")


def written(files: DataFrame, name: str) -> str:
    """A new folder with the files (file_id, content) in it, written by the tasks that have them."""
    import re

    import pyarrow as pa
    from pyarrow import fs

    folder = lineage.new_folder(files.sparkSession, name)

    def write(batches):
        system, at = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", folder))
        system.create_dir(at, recursive=True)
        for batch in batches:
            for file_id, content in zip(batch["file_id"].to_pylist(), batch["content"].to_pylist(), strict=True):
                with system.open_output_stream(f"{at}/{file_id}.xlsx") as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    files.select("file_id", "content").mapInArrow(write, "n long").agg(F.sum("n")).first()
    return folder


@query(
    "sheet_window",
    """WITH n AS (SELECT CAST(s_suppkey // 50 AS VARCHAR) AS file_id, CAST(row_number() OVER (PARTITION BY s_suppkey // 50 ORDER BY s_suppkey) AS INT) AS row_index, s_name, s_acctbal FROM supplier)
SELECT file_id, 'S' AS sheet_name, row_index, CAST(k AS INT) AS column_index, CASE WHEN k = 1 THEN 's' ELSE 'n' END AS type, CASE WHEN k = 1 THEN s_name ELSE CAST(s_acctbal AS VARCHAR) END AS value FROM n, (VALUES (1), (2)) AS t(k) WHERE row_index BETWEEN 5 AND 24""",
)
def sheet_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-XLSX-CELLS, SRC-SAX, SRC-URI, FLT-RANGE: rows 5 to 24 of each sheet, read no further than that."""
    folder = written(workbooks(spark, sf_dir), "workbooks")
    cells = sheets.raw_cells(spark, folder).where("row_index BETWEEN 5 AND 24 AND column_index <= 2 AND sheet_name = 'S'")
    strings = office.shared_strings(office.read_files(spark, folder, "*.xlsx").withColumn("file_id", F.regexp_extract("file_id", "([^/]+)$", 1)))
    named = cells.withColumn("file_id", F.regexp_extract("file_id", "([^/]+)$", 1))
    return sheets.shown(named, strings).select(F.replace("file_id", F.lit(".xlsx"), F.lit("")).alias("file_id"), "sheet_name", "row_index", "column_index", "type", "value")


@pandas_udf(BinaryType())
def _sectioned(sections: pd.Series) -> pd.Series:
    """Customers (k, name) as sections: those of every third have a header of their own, those of every fourth a footer for first pages."""

    def one(items) -> bytes:
        parts, relations_, body = {}, [], ""
        for i, s in enumerate(items):
            own = [(kind, type_) for kind, type_, n in (("header", "default", 3), ("footer", "first", 4)) if s["k"] % n == 0]
            references = ""
            for kind, type_ in own:
                relations_.append(f"{kind}{i}.xml")
                references += f'<w:{kind}Reference w:type="{type_}" r:id="rId{len(relations_)}"/>'
                parts[f"word/{kind}{i}.xml"] = f'<w:hdr xmlns:w="{WORD}"><w:p><w:r><w:t>{kind} {escape(s["name"])}</w:t></w:r></w:p><w:p><w:r><w:t>2</w:t></w:r></w:p></w:hdr>'
            end = f"<w:sectPr>{references}</w:sectPr>"
            body += f'<w:p><w:r><w:t>{escape(s["name"])}</w:t></w:r></w:p>' + (end if i == len(items) - 1 else f"<w:p><w:pPr>{end}</w:pPr></w:p>")
        parts["word/document.xml"] = f'<w:document xmlns:w="{WORD}" xmlns:r="{RELATIONS}"><w:body>{body}</w:body></w:document>'
        parts["word/_rels/document.xml.rels"] = relations(relations_, "header")
        return package(parts)

    return pd.Series([one(s) for s in sections])


@query(
    "office_regions",
    """WITH c AS (SELECT CAST(c_nationkey AS VARCHAR) AS file_id, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS INT) AS section, c_custkey AS k, c_name FROM customer),
r AS (SELECT file_id, section, 'header' AS kind, 'default' AS type, CASE WHEN k % 3 = 0 THEN 'header ' || c_name END AS t FROM c UNION ALL SELECT file_id, section, 'footer', 'first', CASE WHEN k % 4 = 0 THEN 'footer ' || c_name END FROM c),
l AS (SELECT file_id, section, kind, type, last_value(t IGNORE NULLS) OVER (PARTITION BY file_id, kind ORDER BY section ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t FROM r)
SELECT file_id, section, kind, type, t || chr(10) || '2' AS text FROM l WHERE t IS NOT NULL""",
)
def office_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-DOCX, SRC-DOCX-STREAM: headers and footers by section, those of the section before where there is none."""
    rows = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("string").alias("file_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")))).alias("s"))
    return office.regions(rows.select("file_id", _sectioned("s").alias("content")))


@pandas_udf(BinaryType())
def _tracked(rows: pd.Series) -> pd.Series:
    """Rows (name, segment) as paragraphs: the name, an inserted segment, a deleted and a moved-away name, a moved one, in a link and a field."""
    run = lambda t, tag="t": f'<w:r><w:{tag} xml:space="preserve">{escape(t)}</w:{tag}></w:r>'
    one = lambda r: (
        f'<w:p>{run(r["name"])}<w:ins>{run("+" + r["segment"])}</w:ins><w:del>{run(r["name"], "delText")}{run("gone")}</w:del><w:moveFrom>{run("away")}</w:moveFrom>'
        f'<w:moveTo>{run(" to ")}</w:moveTo><w:hyperlink>{run("link")}</w:hyperlink><w:fldSimple>{run("field")}</w:fldSimple><w:sdt><w:sdtContent>{run("!")}</w:sdtContent></w:sdt></w:p>'
    )
    return pd.Series([package({"word/document.xml": f'<w:document xmlns:w="{WORD}"><w:body>{"".join(map(one, items))}</w:body></w:document>'}) for items in rows])


@query(
    "office_tracked",
    "SELECT CAST(c_nationkey AS VARCHAR) AS file_id, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS INT) AS ord, c_name || '+' || c_mktsegment || ' to linkfield!' AS text FROM customer",
)
def office_tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-TRACKED: texts as they stand after their tracked changes."""
    rows = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("string").alias("file_id")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")))).alias("r"))
    return office.blocks(rows.select("file_id", _tracked("r").alias("content"))).select("file_id", "ord", "text")


CHART = "http://schemas.openxmlformats.org/drawingml/2006/chart"


@pandas_udf(BinaryType())
def _charted(slides: pd.Series) -> pd.Series:
    """Orders (k, price) of customers: a slide with a table frame, a chart frame and one of another kind, and a chart whose every fifth point is missing."""

    def one(items) -> bytes:
        frame = lambda body: f'<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="1" name="f"/></p:nvGraphicFramePr><a:graphic><a:graphicData>{body}</a:graphicData></a:graphic></p:graphicFrame>'
        frames = frame(f"<a:tbl>{'<a:tr/>' * len(items)}</a:tbl>") + frame('<c:chart r:id="rId1"/>') + frame("<x/>")
        points = lambda key: "".join(f'<c:pt idx="{i}"><c:v>{p[key]}</c:v></c:pt>' for i, p in enumerate(items) if i % 5 < 4)
        return package({
            "ppt/presentation.xml": f'<p:presentation xmlns:p="{SLIDE}" xmlns:r="{RELATIONS}"><p:sldIdLst><p:sldId id="256" r:id="rId1"/></p:sldIdLst></p:presentation>',
            "ppt/_rels/presentation.xml.rels": relations(["slides/slide1.xml"], "slide"),
            "ppt/slides/slide1.xml": f'<p:sld xmlns:p="{SLIDE}" xmlns:a="{DRAWING}" xmlns:c="{CHART}" xmlns:r="{RELATIONS}"><p:cSld><p:spTree>{frames}</p:spTree></p:cSld></p:sld>',
            "ppt/charts/chart1.xml": f'<c:chartSpace xmlns:c="{CHART}"><c:chart><c:plotArea><c:lineChart><c:ser><c:tx><c:strRef><c:strCache><c:pt idx="0"><c:v>Prices</c:v></c:pt></c:strCache></c:strRef></c:tx>'
            f'<c:cat><c:strRef><c:strCache>{points("k")}</c:strCache></c:strRef></c:cat><c:val><c:numRef><c:numCache>{points("price")}</c:numCache></c:numRef></c:val></c:ser></c:lineChart></c:plotArea></c:chart></c:chartSpace>',
        })

    return pd.Series([one(s) for s in slides])


def order_decks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, content): a deck with one slide and one chart for each customer."""
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("file_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price")))).alias("s"))
    return rows.select("file_id", _charted("s").alias("content"))


@query(
    "office_frames",
    "SELECT CAST(o_custkey AS VARCHAR) AS file_id, CAST(i AS INT) AS ord, k AS type, CAST(CASE WHEN i = 0 THEN count(*) ELSE 0 END AS INT) AS row_count FROM orders, (VALUES (0, 'table'), (1, 'chart'), (2, 'unsupported')) AS t(i, k) GROUP BY o_custkey, i, k",
)
def office_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-UNSUPPORTED: frames of slides by what is in them; one of an unknown kind stays."""
    return office.slide_elements(order_decks(spark, sf_dir)).select("file_id", "ord", "type", "row_count")


@query(
    "office_charts",
    """WITH n AS (SELECT CAST(o_custkey AS VARCHAR) AS file_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS idx, o_orderkey, o_totalprice FROM orders)
SELECT file_id, 'line' AS type, 'Prices' AS series_name, idx, CAST(o_orderkey AS VARCHAR) AS category, o_totalprice AS value FROM n WHERE idx % 5 < 4""",
)
def office_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-CHART-XML: the cached points of charts at their places."""
    return office.chart_points(order_decks(spark, sf_dir)).select("file_id", "type", "series_name", "idx", "category", "value")
