"""Queries of pictures in packages: workbooks with pictures of cells are made of parts in each task, and read back."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType

from quireframe.plans.office import RELATIONS, SHEET, relations
from quireframe.plans.registry import query, table
from quireframe.sources import pictures

NAMES = 'xmlns:etc="http://www.wps.cn/officeDocument/2017/etCustomData" xmlns:xdr="http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'


@pandas_udf(BinaryType())
def _picture_book(parts: pd.Series) -> pd.Series:
    """Parts (k, size): a cell in column A with a picture formula for each; pictures of every fifth are not there, those
    of every third are in another folder than their relationship says."""

    def one(items) -> bytes:
        there = [p for p in items if p["k"] % 5]
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("xl/workbook.xml", f'<workbook xmlns="{SHEET}" xmlns:r="{RELATIONS}"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", relations(["worksheets/sheet1.xml"], "worksheet"))
            rows = "".join(f'<row r="{i}"><c r="A{i}" t="str"><f>_xlfn.DISPIMG(&quot;ID_{p["k"]}&quot;,1)</f><v>=DISPIMG()</v></c></row>' for i, p in enumerate(items, 1))
            z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{SHEET}"><sheetData>{rows}</sheetData></worksheet>')
            images = "".join(f'<etc:cellImage><xdr:pic><xdr:nvPicPr><xdr:cNvPr id="1" name="ID_{p["k"]}"' + (f' descr="d{p["k"]}"' if p["k"] % 2 else "") + f'/></xdr:nvPicPr><xdr:blipFill><a:blip r:embed="rId{i}"/></xdr:blipFill></xdr:pic></etc:cellImage>' for i, p in enumerate(there, 1))
            z.writestr("xl/cellimages.xml", f'<etc:cellImages {NAMES} xmlns:r="{RELATIONS}">{images}</etc:cellImages>')
            z.writestr("xl/_rels/cellimages.xml.rels", relations([f"{'other' if p['k'] % 3 == 0 else 'media'}/i{p['k']}.png" for p in there], "image"))
            for p in there:
                z.writestr(f"xl/media/i{p['k']}.png", (b"\x89PNG" if p["k"] % 4 else b"\xff\xd8\xff\xe0") + b"x" * (p["size"] * 100))
        return out.getvalue()

    return pd.Series([one(p) for p in parts])


def picture_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, content): a workbook for every 100 parts."""
    key = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").groupBy(F.floor(key / 100).cast("string").alias("file_id")).agg(F.array_sort(F.collect_list(F.struct(key.alias("k"), F.col("p_size").alias("size")))).alias("parts"))
    return rows.select("file_id", _picture_book("parts").alias("content"))


@query(
    "office_cell_images",
    """SELECT CAST(p_partkey // 100 AS VARCHAR) AS file_id, '1' AS sheet_id, CAST(row_number() OVER (PARTITION BY p_partkey // 100 ORDER BY p_partkey) AS INT) AS row_index, CAST(1 AS INT) AS column_index, 'ID_' || p_partkey AS image_id,
  CASE WHEN p_partkey % 5 > 0 AND p_partkey % 2 = 1 THEN 'd' || p_partkey ELSE 'ID_' || p_partkey END AS name, CASE WHEN p_partkey % 5 > 0 THEN 'xl/media/i' || p_partkey || '.png' END AS path FROM part""",
)
def office_cell_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-CELLIMG, JN-REL: the cells of workbooks that show pictures, and where these lie."""
    return pictures.cell_images(picture_books(spark, sf_dir))


@query("office_media", "SELECT CAST(p_partkey // 100 AS VARCHAR) AS file_id, 'xl/media/i' || p_partkey || '.png' AS path, CASE WHEN p_partkey % 4 > 0 THEN 'image/png' ELSE 'image/jpeg' END AS type, CAST(p_size * 100 + 4 AS BIGINT) AS bytes FROM part WHERE p_partkey % 5 > 0")
def office_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-IMG: the media of packages with their kinds by their first bytes."""
    found = pictures.media(picture_books(spark, sf_dir))
    return found.select("file_id", "path", pictures.media_type(F.col("data")).alias("type"), F.octet_length("data").cast("long").alias("bytes"))


@pandas_udf(BinaryType())
def _archive(parts: pd.Series) -> pd.Series:
    def one(items) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for p in items:
                z.writestr(zipfile.ZipInfo(f"p{p['k']}"), b"x" * p["size"])
        return out.getvalue()

    return pd.Series([one(p) for p in parts])


# A stored package: 30 bytes and the name before each part, 46 and the name in the directory, 22 at the end.
@query(
    "office_archives",
    """SELECT CAST(p_partkey // 100 AS VARCHAR) AS file_id, count(*) AS parts, CAST(sum(p_size) AS BIGINT) AS packed, CAST(sum(p_size) AS BIGINT) AS unpacked, CAST(sum(p_size + 76 + 2 * length('p' || p_partkey)) + 22 AS BIGINT) AS bytes FROM part GROUP BY p_partkey // 100""",
)
def office_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-ARCHIVE: parts and sizes of packages."""
    key = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").groupBy(F.floor(key / 100).cast("string").alias("file_id")).agg(F.array_sort(F.collect_list(F.struct(key.alias("k"), F.col("p_size").alias("size")))).alias("parts"))
    return pictures.archive_totals(rows.select("file_id", _archive("parts").alias("content")))
