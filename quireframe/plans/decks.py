"""Queries of decks: small decks are made of parts in each task, and read back as tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType

from quireframe.plans.office import DRAWING, RELATIONS, SLIDE, package, relations
from quireframe.plans.registry import query, table
from quireframe.sources import decks

NAMES = f'xmlns:p="{SLIDE}" xmlns:a="{DRAWING}" xmlns:r="{RELATIONS}"'


def _place(x: float, y: float, width: float, height: float, child: tuple | None = None, tag: str = "spPr") -> str:
    emu = lambda v: int(v * decks.EMU)
    inner = "" if child is None else f'<a:chOff x="{emu(child[0])}" y="{emu(child[1])}"/><a:chExt cx="{emu(child[2])}" cy="{emu(child[3])}"/>'
    return f'<p:{tag}><a:xfrm><a:off x="{emu(x)}" y="{emu(y)}"/><a:ext cx="{emu(width)}" cy="{emu(height)}"/>{inner}</a:xfrm></p:{tag}>'


def _shape(name: str, place: str, holder: str = "") -> str:
    mark = f'<p:ph type="{holder}"/>' if holder else ""
    return f'<p:sp><p:nvSpPr><p:cNvPr id="1" name="{name}"/><p:nvPr>{mark}</p:nvPr></p:nvSpPr>{place}</p:sp>'


def _part(kind: str, tree: str, fill: str | None) -> str:
    background = f'<p:bg><p:bgPr><a:solidFill><a:srgbClr val="{fill}"/></a:solidFill></p:bgPr></p:bg>' if fill else ""
    return f"<p:{kind} {NAMES}><p:cSld>{background}<p:spTree>{tree}</p:spTree></p:cSld></p:{kind}>"


@pandas_udf(BinaryType())
def _deck(slides: pd.Series) -> pd.Series:
    """Slides (arrays of parts) whose parts are groups in each other, each with a shape; two layouts and two masters.

    Layout 1 and both masters have a background, as every fifth slide does; every third slide has no layout. A slide's
    title has no place of its own; layout 1 and the masters have one for it.
    """

    def groups(parts) -> str:
        out = ""
        for p in reversed(parts):
            k, size = p["k"], p["size"]
            child = (size % 5, size % 3, (0, 64, 128, 256)[size % 4], (32, 64, 128)[size % 3])
            out = f'<p:grpSp><p:nvGrpSpPr><p:cNvPr id="1" name="g{k}"/></p:nvGrpSpPr>{_place(size * 8, k % 50 * 4, 128, 64, child, "grpSpPr")}{_shape(f"s{k}", _place(k % 7, size, 16, 8))}{out}</p:grpSp>'
        return out

    def one(items) -> bytes:
        n = len(items)
        parts = {
            "ppt/presentation.xml": f'<p:presentation {NAMES}><p:sldMasterIdLst><p:sldMasterId r:id="rId1"/><p:sldMasterId r:id="rId2"/></p:sldMasterIdLst><p:sldIdLst>' + "".join(f'<p:sldId id="{256 + i}" r:id="rId{i + 3}"/>' for i in range(n)) + '</p:sldIdLst><p:sldSz cx="9144000" cy="6858000"/></p:presentation>',
            "ppt/_rels/presentation.xml.rels": relations([*(f"slideMasters/slideMaster{i}.xml" for i in (1, 2)), *(f"slides/slide{i + 1}.xml" for i in range(n))], "slide"),
            "ppt/theme/theme1.xml": f'<a:theme {NAMES}><a:themeElements><a:clrScheme name="x"><a:dk1><a:sysClr val="windowText" lastClr="010203"/></a:dk1><a:accent1><a:srgbClr val="4472C4"/></a:accent1></a:clrScheme></a:themeElements></a:theme>',
        }
        for i, fill in ((1, "AA0001"), (2, "AA0002")):
            parts[f"ppt/slideMasters/slideMaster{i}.xml"] = _part("sldMaster", _shape("logo", _place(900, 10 * i, 40, 20)) + _shape("title", _place(i, i, 500, 50), "title"), fill)
            parts[f"ppt/slideLayouts/slideLayout{i}.xml"] = _part("sldLayout", _shape("line", _place(0, 100, 960, 2)) + _shape("title", _place(7, 7, 400, 40) if i == 1 else "", "title"), "BB0001" if i == 1 else None)
            parts[f"ppt/slideLayouts/_rels/slideLayout{i}.xml.rels"] = relations([f"../slideMasters/slideMaster{3 - i}.xml"], "slideMaster")
        for i, slide in enumerate(items):
            parts[f"ppt/slides/slide{i + 1}.xml"] = _part("sld", _shape("title", "", "title") + groups(slide["parts"]), "CC0000" if i % 5 == 0 else None)
            if i % 3:
                parts[f"ppt/slides/_rels/slide{i + 1}.xml.rels"] = relations([f"../slideLayouts/slideLayout{i % 2 + 1}.xml"], "slideLayout")
        return package(parts)

    return pd.Series([one(s) for s in slides])


def part_decks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, content): a deck for every 100 parts, ten of which are a slide."""
    key = F.col("p_partkey")
    slides = table(spark, sf_dir, "part").groupBy(F.floor(key / 10).alias("slide")).agg(F.array_sort(F.collect_list(F.struct(key.alias("k"), F.col("p_size").alias("size")))).alias("parts"))
    whole = slides.groupBy(F.floor(F.col("slide") / 10).cast("string").alias("file_id")).agg(F.array_sort(F.collect_list(F.struct("slide", "parts"))).alias("slides"))
    return whole.select("file_id", _deck("slides").alias("content"))


SLIDES_SQL = """s AS (SELECT DISTINCT CAST(p_partkey // 100 AS VARCHAR) AS file_id, p_partkey // 10 AS slide FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY slide) - 1 AS i FROM s),
l AS (SELECT *, CASE WHEN i % 3 > 0 THEN i % 2 + 1 END AS layout, CASE WHEN i % 3 > 0 THEN 2 - i % 2 ELSE 1 END AS master FROM n)"""


@query(
    "deck_slides",
    f"""WITH {SLIDES_SQL} SELECT file_id, CAST(i + 1 AS INT) AS slide_index, 'ppt/slideLayouts/slideLayout' || layout || '.xml' AS layout, 'ppt/slideMasters/slideMaster' || master || '.xml' AS master,
  CASE WHEN i % 5 = 0 THEN 'CC0000' WHEN layout = 1 THEN 'BB0001' ELSE 'AA000' || master END AS background, 960.0::DOUBLE AS width, 720.0::DOUBLE AS height FROM l""",
)
def deck_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-PPTX, JN-LAYOUT: the layout, master, background and size of each slide; without a layout the first master's."""
    files = part_decks(spark, sf_dir)
    return decks.inherited(files).join(decks.sizes(files), "file_id").drop("part")


@query(
    "deck_shapes",
    f"""WITH RECURSIVE {SLIDES_SQL}, g AS (SELECT p_partkey AS node, CASE WHEN p_partkey % 10 <> 0 THEN p_partkey - 1 END AS parent, p_size * 8.0::DOUBLE AS x, p_partkey % 50 * 4.0::DOUBLE AS y,
    CASE p_size % 4 WHEN 1 THEN 2.0 WHEN 3 THEN 0.5 ELSE 1.0 END::DOUBLE AS sx, CASE p_size % 3 WHEN 0 THEN 2.0 WHEN 1 THEN 1.0 ELSE 0.5 END::DOUBLE AS sy, (p_size % 5)::DOUBLE AS cx, (p_size % 3)::DOUBLE AS cy FROM part),
e(id, parent, x, y, w, h) AS (SELECT p_partkey, p_partkey, (p_partkey % 7)::DOUBLE, p_size::DOUBLE, 16.0::DOUBLE, 8.0::DOUBLE FROM part
  UNION ALL SELECT e.id, g.parent, g.x + (e.x - g.cx) * g.sx, g.y + (e.y - g.cy) * g.sy, e.w * g.sx, e.h * g.sy FROM e JOIN g ON g.node = e.parent),
a AS (SELECT file_id, i, 0 AS rank, 'master' AS source, 'logo' AS name, 0 AS ord, 900.0::DOUBLE AS x, 10.0::DOUBLE * master AS y, 40.0::DOUBLE AS w, 20.0::DOUBLE AS h FROM l
  UNION ALL SELECT file_id, i, 1, 'layout', 'line', 0, 0, 100, 960, 2 FROM l WHERE layout IS NOT NULL
  UNION ALL SELECT file_id, i, 2, 'slide', 'title', 0, CASE WHEN layout = 1 THEN 7 ELSE master END, CASE WHEN layout = 1 THEN 7 ELSE master END, CASE WHEN layout = 1 THEN 400 ELSE 500 END, CASE WHEN layout = 1 THEN 40 ELSE 50 END FROM l
  UNION ALL SELECT file_id, i, 2, 'slide', 's' || id, id, x, y, w, h FROM e JOIN l ON l.slide = e.id // 10 WHERE parent IS NULL OR NOT EXISTS (SELECT 1 FROM g WHERE g.node = e.parent))
SELECT file_id, CAST(i + 1 AS INT) AS slide_index, CAST(row_number() OVER (PARTITION BY file_id, i ORDER BY rank, CASE WHEN name = 'title' THEN -1 ELSE ord END) - 1 AS INT) AS z_index, source, 'shape' AS type, name, x, y, w AS width, h AS height FROM a""",
)
def deck_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-PPTX, PRJ-FLATTEN-GROUP, JN-LAYOUT, JN-MASTER, JN-PLACEHOLDER: what each slide shows, in its own px."""
    return decks.composed(part_decks(spark, sf_dir))


@query("deck_themes", "SELECT DISTINCT CAST(p_partkey // 100 AS VARCHAR) AS file_id, 'ppt/theme/theme1.xml' AS part, name, value FROM part, (VALUES ('dk1', '010203'), ('accent1', '4472C4')) AS t(name, value)")
def deck_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-PPTX: the colours of each deck's theme."""
    return decks.theme_colours(part_decks(spark, sf_dir))
