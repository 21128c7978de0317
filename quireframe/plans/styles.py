"""Query of cell styles: workbooks with style sheets are made of table rows in each task, and read back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType

from quireframe.plans.office import DRAWING, SHEET, package
from quireframe.plans.registry import query, table
from quireframe.sources import styles


@pandas_udf(BinaryType())
def _style_book(parts: pd.Series) -> pd.Series:
    """Parts (k, size) as cell styles: each has a font of its own; fills and borders take turns; the theme has one colour."""

    def one(items) -> bytes:
        font = lambda p: f'<font>{"<b/>" * (p["k"] % 2)}{"<i/>" * (p["k"] % 3 == 0)}<sz val="{p["size"]}"/><name val="F{p["k"]}"/>{colour(p["k"])}</font>'
        colour = lambda k: ('<color auto="1"/>', '<color rgb="FF12aB34"/>', f'<color theme="{k % 12}"/>', f'<color indexed="{k % 64}"/>')[k % 4]
        xf = lambda i, p: f'<xf fontId="{i}" fillId="{p["k"] % 3}" borderId="{p["k"] % 4}"><alignment horizontal="{"center" if p["k"] % 2 else "fill"}" vertical="center" wrapText="{p["k"] % 2}"/></xf>'
        return package({
            "xl/theme/theme1.xml": f'<a:theme xmlns:a="{DRAWING}"><a:themeElements><a:clrScheme name="x"><a:accent1><a:srgbClr val="ABCDEF"/></a:accent1></a:clrScheme></a:themeElements></a:theme>',
            "xl/styles.xml": f'<styleSheet xmlns="{SHEET}"><fonts>{"".join(map(font, items))}</fonts>'
            '<fills><fill><patternFill patternType="none"/></fill><fill><patternFill><fgColor rgb="FF00FF00"/></patternFill></fill><fill><patternFill><fgColor theme="1" tint="0.5"/></patternFill></fill></fills>'
            '<borders><border><left/></border><border><left style="hair"/><top style="thick"><color rgb="FF0000FF"/></top></border><border><right style="dashDot"><color indexed="10"/></right></border><border diagonalUp="1"><diagonal style="double"/></border></borders>'
            f'<cellXfs>{"".join(xf(i, p) for i, p in enumerate(items))}</cellXfs></styleSheet>',
        })

    return pd.Series([one(p) for p in parts])


@query(
    "office_cell_styles",
    """WITH n AS (SELECT CAST(p_partkey // 100 AS VARCHAR) AS file_id, CAST(row_number() OVER (PARTITION BY p_partkey // 100 ORDER BY p_partkey) - 1 AS INT) AS style_id, p_partkey AS k, p_size FROM part)
SELECT file_id, style_id, k % 2 = 1 AS bold, k % 3 = 0 AS italic, p_size * 96.0::DOUBLE / 72 AS size, 'F' || k AS family,
  CASE k % 4 WHEN 0 THEN '#000000' WHEN 1 THEN '#12ab34' WHEN 2 THEN '#' || lower(['FFFFFF', '000000', 'E7E6E6', '44546A', 'ABCDEF', 'ED7D31', 'A5A5A5', 'FFC000', '4472C4', '70AD47', '0563C1', '954F72'][k % 12 + 1]) ELSE '#' || string_split('"""
    + " ".join(styles.units.INDEXED)
    + """', ' ')[k % 64 + 1] END AS color, [NULL, '#00ff00', '#808080'][k % 3 + 1] AS background,
  CASE k % 4 WHEN 1 THEN 'left=0.5px solid #000000,top=3px solid #0000ff' WHEN 2 THEN 'right=1px dashed #ff0000' WHEN 3 THEN 'diagonal_up=2px double #000000' ELSE '' END AS border, CASE WHEN k % 2 = 1 THEN 'center' END AS horizontal, 'middle' AS vertical, k % 2 = 1 AS wrap FROM n""",
)
def office_cell_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-XLSX, JN-XF, FN-COLOR-RGB: fonts, fills, lines and alignment of each cell style, with the theme's colours."""
    key = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").groupBy(F.floor(key / 100).cast("string").alias("file_id")).agg(F.array_sort(F.collect_list(F.struct(key.alias("k"), F.col("p_size").alias("size")))).alias("parts"))
    found = styles.cell_styles(rows.select("file_id", _style_book("parts").alias("content")))
    lines = F.transform(F.array_sort(F.map_entries(F.coalesce("border", F.create_map().cast("map<string,string>")))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.withColumn("border", F.array_join(lines, ",")).drop("underline", "shrink")
