"""Decks: elements of masters, layouts and slides together, notes, groups and table styles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def compose(slides: DataFrame, masters: DataFrame, layouts: DataFrame, elements: DataFrame) -> DataFrame:
    """(slide_id, z_index, source, name): the elements of a slide's master, then its layout's, then its own.

    slides (slide_id, layout_id, master_id); elements of the three kinds have slide_id, layout_id or master_id, ord and
    name. Masters and layouts are few for each deck, so Spark joins them by size.
    """
    parts = [
        slides.join(masters, "master_id").select("slide_id", F.lit(0).alias("rank"), F.lit("master").alias("source"), "ord", "name"),
        slides.join(layouts, "layout_id").select("slide_id", F.lit(1).alias("rank"), F.lit("layout").alias("source"), "ord", "name"),
        elements.select("slide_id", F.lit(2).alias("rank"), F.lit("slide").alias("source"), "ord", "name"),
    ]
    z = F.row_number().over(Window.partitionBy("slide_id").orderBy("rank", "ord", "name")) - 1
    return reduce(DataFrame.unionByName, parts).select("slide_id", z.alias("z_index"), "source", "name")


def with_notes(slides: DataFrame, notes: DataFrame, key: str) -> DataFrame:
    """slides with notes: the texts of the notes that refer to a slide, in order, joined by line ends; '' for none."""
    joined = notes.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda s: s["text"]), "\n").alias("notes"))
    return slides.join(joined, key, "left").withColumn("notes", F.coalesce("notes", F.lit("")))


def in_group(element: str, group: str) -> dict[str, Column]:
    """x, y, width and height of an element in its group's own coordinates, as coordinates outside the group.

    The arguments name structs: element x, y, width, height; group also child_x, child_y, child_width, child_height. A
    child size of 0 means no scaling.
    """
    e, g = F.col(element), F.col(group)
    scale = lambda side: F.when(g[f"child_{side}"] != 0, g[side] / g[f"child_{side}"]).otherwise(1.0)
    place = lambda at, side: g[at] + (e[at] - g[f"child_{at}"]) * scale(side)
    return {"x": place("x", "width"), "y": place("y", "height"), "width": e["width"] * scale("width"), "height": e["height"] * scale("height")}


def table_style(row: Column, column: Column, rows: Column, columns: Column, flags: dict[str, Column], style: dict[str, Column]) -> Column:
    """A cell's setting by a table style's parts; later ones win: whole table, row band, column band, first and last row, first and last column.

    Rows and columns count from 0. Bands begin after a first row or column that is set off; flags are first_row,
    last_row, first_column, last_column, band_rows and band_columns; style has the settings (null: none).
    """
    first_row, last_row = flags["first_row"] & (row == 0), flags["last_row"] & (row == rows - 1)
    first_column, last_column = flags["first_column"] & (column == 0), flags["last_column"] & (column == columns - 1)
    # the band before the first one counts as the second, as a remainder below 0 is not 0
    band = lambda at, off, one, two: F.when((at - off.cast("int")) % 2 == 0, style[one]).otherwise(style[two])
    row_band = F.when(flags["band_rows"] & ~first_row & ~last_row, band(row, flags["first_row"], "band1_row", "band2_row"))
    column_band = F.when(flags["band_columns"] & ~first_column & ~last_column, band(column, flags["first_column"], "band1_column", "band2_column"))
    edges = [F.when(last_column, style["last_column"]), F.when(first_column, style["first_column"]), F.when(last_row, style["last_row"]), F.when(first_row, style["first_row"])]
    return F.coalesce(*edges, column_band, row_band, style["whole"])
