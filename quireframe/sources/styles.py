"""Cell styles of workbooks as tables: fonts, fills, borders, formats of cells, and colours by theme, index and tint."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireframe.functions import units
from quireframe.sources import decks, office

# The order in which themes are indexed, the colours without a theme of one's own, widths of lines in px.
THEME_ORDER = ("lt1", "dk1", "lt2", "dk2", "accent1", "accent2", "accent3", "accent4", "accent5", "accent6", "hlink", "folHlink")
DEFAULT_THEME = {
    "dk1": "000000", "lt1": "FFFFFF", "dk2": "44546A", "lt2": "E7E6E6", "accent1": "5B9BD5", "accent2": "ED7D31",
    "accent3": "A5A5A5", "accent4": "FFC000", "accent5": "4472C4", "accent6": "70AD47", "hlink": "0563C1", "folHlink": "954F72",
}
LINE_WIDTHS = {"hair": 0.5, "medium": 2.0, "double": 2.0, "thick": 3.0}
SIDES = ("left", "right", "top", "bottom", "diagonal")
COLOUR = "struct<auto:boolean,rgb:string,theme:int,indexed:int,tint:double>"


def _raw_colour(node: ElementTree.Element | None) -> tuple | None:
    """(auto, rgb, theme, indexed, tint) as the part has them."""
    if node is None:
        return None
    number = lambda name, kind: None if node.get(name) is None else kind(node.get(name))
    return node.get("auto") in ("1", "true"), node.get("rgb"), number("theme", int), number("indexed", int), number("tint", float)


def _sheet_styles(z: zipfile.ZipFile, group: str, name: str) -> Iterator[tuple[int, ElementTree.Element]]:
    if "xl/styles.xml" in z.namelist():
        found = decks._child(office._tree(z, "xl/styles.xml"), group)
        yield from enumerate(x for x in (() if found is None else found) if office._local(x.tag) == name)


def fonts(files: DataFrame) -> DataFrame:
    """(file_id, font_id, bold, italic, underline, size in px, family, color): the fonts of each workbook."""

    def read(z: zipfile.ZipFile) -> Iterator[tuple]:
        for i, x in _sheet_styles(z, "fonts", "font"):
            get = lambda name, x=x: None if (n := decks._child(x, name)) is None else n.get("val")
            there = lambda name, x=x: decks._child(x, name) is not None
            size = float(get("sz") or 0)
            yield i, there("b"), there("i"), there("u"), size * 96 / 72 if size else None, get("name") or get("family") or get("charset"), _raw_colour(decks._child(x, "color"))

    return office._rows(files, read, f"font_id int, bold boolean, italic boolean, underline boolean, size double, family string, color {COLOUR}")


def fills(files: DataFrame) -> DataFrame:
    """(file_id, fill_id, color): the colour of each pattern."""
    return office._rows(files, lambda z: ((i, _raw_colour(decks._child(x, "patternFill", "fgColor"))) for i, x in _sheet_styles(z, "fills", "fill")), f"fill_id int, color {COLOUR}")


def borders(files: DataFrame) -> DataFrame:
    """(file_id, border_id, side, line, color): the lines that each border has; diagonal ones as diagonal_up and _down."""

    def read(z: zipfile.ZipFile) -> Iterator[tuple]:
        for i, x in _sheet_styles(z, "borders", "border"):
            for side in SIDES:
                line = decks._child(x, side)
                if line is None or not line.get("style"):
                    continue
                names = [side] if side != "diagonal" else [f"diagonal_{way.lower()}" for way in ("Up", "Down") if x.get(f"diagonal{way}") in ("1", "true")]
                for name in names:
                    yield i, name, line.get("style"), _raw_colour(decks._child(line, "color"))

    return office._rows(files, read, f"border_id int, side string, line string, color {COLOUR}")


def cell_formats(files: DataFrame) -> DataFrame:
    """(file_id, style_id, font_id, fill_id, border_id, horizontal, vertical, wrap, shrink): what each style puts together."""

    def read(z: zipfile.ZipFile) -> Iterator[tuple]:
        for i, x in _sheet_styles(z, "cellXfs", "xf"):
            align = decks._child(x, "alignment")
            get = lambda name, align=align: None if align is None else align.get(name)
            horizontal, vertical = get("horizontal"), {"top": "top", "bottom": "bottom", "center": "middle"}.get(get("vertical") or "")
            yield (i, *(int(x.get(n) or 0) for n in ("fontId", "fillId", "borderId")), horizontal if horizontal in ("left", "center", "right", "justify") else None, vertical, get("wrapText") == "1", get("shrinkToFit") == "1")

    return office._rows(files, read, "style_id int, font_id int, fill_id int, border_id int, horizontal string, vertical string, wrap boolean, shrink boolean")


def colour(raw: Column, scheme: Column) -> Column:
    """#rrggbb (lower case) of a raw colour: black if automatic, else its own digits, the theme's or the indexed one, tinted.

    scheme is a map of the theme's colours by name, over the default ones.
    """
    own = F.when(raw["rgb"].rlike("^#?([0-9A-Fa-f]{6}|[0-9A-Fa-f]{8})$"), F.concat(F.lit("#"), F.lower(F.right(raw["rgb"], F.lit(6)))))
    name = F.when(raw["theme"] >= 0, F.get(F.array(*map(F.lit, THEME_ORDER)), raw["theme"]))
    default = F.map_from_arrays(F.array(*map(F.lit, DEFAULT_THEME)), F.array(*map(F.lit, DEFAULT_THEME.values())))
    themed = F.concat(F.lit("#"), F.lower(F.coalesce(F.try_element_at(scheme, name), F.try_element_at(default, name))))
    base = F.coalesce(own, themed, units.indexed_colour(raw["indexed"]))
    return F.when(F.coalesce(raw["auto"], F.lit(False)), "#000000").when(F.coalesce(raw["tint"], F.lit(0.0)) == 0, base).otherwise(units.tint(base, raw["tint"]))


def cell_styles(files: DataFrame) -> DataFrame:
    """(file_id, style_id, bold, italic, underline, size, family, color, background, border, horizontal, vertical, wrap, shrink).

    Each style's font, fill and lines are joined by their numbers within the file; border is a map from side to
    'width line colour'. Colours are settled by the workbook's first theme. Styles of numbers that are not there have
    nulls.
    """
    theme = decks.theme_colours(files)
    first = theme.groupBy("file_id").agg(F.min("part").alias("part"))
    schemes = theme.join(first, ["file_id", "part"]).groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("scheme"))
    scheme = F.coalesce("scheme", F.create_map().cast("map<string,string>"))
    settled = lambda df, name: df.join(schemes, "file_id", "left").withColumn(name, colour(F.col("color"), scheme)).drop("scheme")
    font = settled(fonts(files), "color")
    fill = settled(fills(files), "background").drop("color")
    width = F.lit(1.0)
    for line, px in LINE_WIDTHS.items():
        width = F.when(F.col("line") == line, px).otherwise(width)
    shown = F.when(F.col("line").isin("dashed", "dashDot", "dashDotDot", "slantDashDot"), "dashed").when(F.col("line").isin("dotted", "double"), F.col("line")).otherwise("solid")
    css = F.concat(F.regexp_replace(width.cast("string"), "\\.0$", ""), F.lit("px "), shown, F.lit(" "), F.coalesce("color", F.lit("#000000")))
    lines = settled(borders(files), "color").groupBy("file_id", "border_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("side", css.alias("css"))))).alias("border"))
    out = cell_formats(files).join(font, ["file_id", "font_id"], "left").join(fill, ["file_id", "fill_id"], "left").join(lines, ["file_id", "border_id"], "left")
    return out.select("file_id", "style_id", "bold", "italic", "underline", "size", "family", "color", "background", "border", "horizontal", "vertical", "wrap", "shrink")
