"""Tables as spreadsheets: cells, tiles, used ranges, range queries, the visible table and text overflow.

Row and column numbers start at 1. Windows are always inside one sheet; a sheet is as large as a spreadsheet file's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quireframe.functions import a1
from quireframe.operators import merges

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def to_cells(df: DataFrame, sheet: str, order: list[str], columns: list[str]) -> DataFrame:
    """(sheet_id, row_index, column_index, type, raw_value, num_value): each row of a sheet as cells, header in row 1.

    Rows are numbered in the given order inside their sheet, one shuffle by sheet. Numbers have type 'n' and num_value,
    anything else type 's'; nulls are cells with a null raw_value.
    """
    kinds = dict(df.dtypes)
    row = F.row_number().over(Window.partitionBy(sheet).orderBy(*order))
    number = lambda c: F.col(c).cast("double") if kinds[c] in NUMERIC else F.lit(None).cast("double")
    cell = lambda i, c: F.struct(F.lit(i).alias("column_index"), F.lit("n" if kinds[c] in NUMERIC else "s").alias("type"), F.col(c).cast("string").alias("raw_value"), number(c).alias("num_value"))
    numbered = df.select(F.col(sheet).cast("string").alias("sheet_id"), *columns, (row + 1).alias("row_index"))
    cells = numbered.select("sheet_id", "row_index", F.explode(F.array(*[cell(i, c) for i, c in enumerate(columns, 1)])).alias("c"))
    return cells.select("sheet_id", "row_index", "c.column_index", "c.type", "c.raw_value", "c.num_value")


def occupied(value: Column, formula: Column | None = None, raw: Column | None = None) -> Column:
    """Has the cell a value, a formula or a raw value?"""
    out = F.coalesce(value, F.lit("")) != ""
    if formula is not None:
        out = out | formula.isNotNull()
    return out if raw is None else out | (F.coalesce(raw, F.lit("")) != "")


def shows_when_empty(*styles: Column) -> Column:
    """Has an empty cell a fill, a border or a diagonal, so that it matters?"""
    return F.coalesce(*styles).isNotNull()


def clamp_range(start: Column, end: Column, count: Column) -> tuple[Column, Column]:
    """The start in 1 to count, the end from the start to count."""
    first = F.least(F.greatest(F.floor(start), F.lit(1)), count)
    return first, F.least(F.greatest(F.floor(end), first), count)


def in_range(cells: DataFrame, rows: tuple[int, int], columns: tuple[int, int]) -> DataFrame:
    """The cells of a range. Its tiles are asked for too, so files that are partitioned by tile are pruned."""
    tiles = []
    for (first, last), size, name in ((rows, a1.TILE_ROWS, "row_tile"), (columns, a1.TILE_COLUMNS, "column_tile")):
        if name in cells.columns:
            tiles.append(F.col(name).between((first - 1) // size, (last - 1) // size))
    out = cells.where(F.col("row_index").between(*rows) & F.col("column_index").between(*columns))
    for t in tiles:
        out = out.where(t)
    return out


def range_query(ranges: DataFrame, sheets: DataFrame, cells: DataFrame, sizes: DataFrame, merged: DataFrame) -> dict[str, DataFrame]:
    """What a viewer asks for of many ranges (sheet_id, range_id and ends) at once.

    sheets have rows, columns, row_size and column_size (the defaults), sizes have axis ('row' or 'column'), idx, size
    and hidden, merged has merge_id and ends. Ranges are clamped to their sheet, grown until no merge is cut, and
    clamped again: ``range``. ``cells`` are the cells inside, met by tile; ``axis`` has the size of every row and
    column inside, the default and not hidden where none is given; ``merges`` are the merges that touch the range.
    """
    def clamped(df: DataFrame) -> DataFrame:
        sized = df.join(sheets, "sheet_id")
        rows, columns = clamp_range(F.col("start_row"), F.col("end_row"), F.col("rows")), clamp_range(F.col("start_column"), F.col("end_column"), F.col("columns"))
        ends = zip(merges.ENDS, (rows[0], columns[0], rows[1], columns[1]), strict=True)
        return sized.select("sheet_id", "range_id", *[x.cast("int").alias(e) for e, x in ends])

    whole = clamped(merges.expand(clamped(ranges), merged))
    inside = F.col("row_index").between(F.col("start_row"), F.col("end_row")) & F.col("column_index").between(F.col("start_column"), F.col("end_column"))
    placed = cells.withColumns({"row_tile": a1.row_tile(F.col("row_index")), "column_tile": a1.column_tile(F.col("column_index"))})
    found = merges.tiled(whole).join(placed, ["sheet_id", "row_tile", "column_tile"]).where(inside).drop("row_tile", "column_tile", *merges.ENDS)
    lines = [whole.select("sheet_id", "range_id", F.lit(axis).alias("axis"), F.explode(F.sequence(f"start_{axis}", f"end_{axis}")).alias("idx")) for axis in ("row", "column")]
    metrics = lines[0].unionByName(lines[1]).join(sizes, ["sheet_id", "axis", "idx"], "left").join(sheets, "sheet_id")
    default = F.when(F.col("axis") == "row", F.col("row_size")).otherwise(F.col("column_size"))
    metrics = metrics.select("sheet_id", "range_id", "axis", "idx", F.coalesce("size", default).alias("size"), F.coalesce("hidden", F.lit(False)).alias("hidden"))
    return {"range": whole, "cells": found, "axis": metrics, "merges": merges.overlapping(whole, merged)}


def tiles(cells: DataFrame) -> DataFrame:
    """(sheet_id, row_tile, column_tile, cells, first_row, last_row, filled): the tiles that have cells."""
    return cells.groupBy("sheet_id", a1.row_tile(F.col("row_index")).alias("row_tile"), a1.column_tile(F.col("column_index")).alias("column_tile")).agg(
        F.count("*").alias("cells"), F.min("row_index").alias("first_row"), F.max("row_index").alias("last_row"), F.count(F.when(occupied(F.col("raw_value")), 1)).alias("filled")
    )


def used_range(cells: DataFrame, filled: Column) -> DataFrame:
    """(sheet_id, rows, columns, declared_rows, declared_columns): the extent of the cells that count, and of all."""
    most = lambda c: F.coalesce(F.max(F.when(filled, F.col(c))), F.lit(0)).cast("int")
    return cells.groupBy("sheet_id").agg(
        most("row_index").alias("rows"), most("column_index").alias("columns"), F.max("row_index").cast("int").alias("declared_rows"), F.max("column_index").cast("int").alias("declared_columns")
    )


def materialize(sheets: DataFrame, cells: DataFrame) -> DataFrame:
    """(sheet_id, row_index, column_index, value): all positions of sheets (sheet_id, rows, columns), '' where no cell is."""
    grid = sheets.select("sheet_id", F.explode(F.sequence(F.lit(1), "rows")).alias("row_index"), "columns")
    grid = grid.select("sheet_id", "row_index", F.explode(F.sequence(F.lit(1), "columns")).alias("column_index"))
    return grid.join(cells, ["sheet_id", "row_index", "column_index"], "left").select("sheet_id", "row_index", "column_index", F.coalesce("raw_value", F.lit("")).alias("value"))


def visible(cells: DataFrame, hidden_row: Column, hidden_column: Column) -> DataFrame:
    """The cells of rows and columns that are not hidden, with visible_row and visible_column counted from 1."""
    kept = cells.where(~F.coalesce(hidden_row, F.lit(False)) & ~F.coalesce(hidden_column, F.lit(False)))
    by = Window.partitionBy("sheet_id")
    rank = lambda c: F.dense_rank().over(by.orderBy(c))
    return kept.withColumns({"visible_row": rank("row_index"), "visible_column": rank("column_index")})


def overflow(cells: DataFrame, width: Column, align: Column, kind: Column) -> DataFrame:
    """Where a text may run over its empty neighbours: direction, and the free width at each side, by row.

    left, right, center and justify give right, left, both and none; without an alignment texts run right, numbers
    nowhere. left_free and right_free are the widths up to the next occupied cell (null where there is none).
    """
    row = Window.partitionBy("sheet_id", "row_index").orderBy("column_index")
    before, after = row.rowsBetween(Window.unboundedPreceding, -1), row.rowsBetween(1, Window.unboundedFollowing)
    full = occupied(F.col("value"))
    upto = F.coalesce(F.sum(width).over(before), F.lit(0.0))  # width of all columns before
    out = cells.withColumns({"_full": full, "_upto": upto, "_end": upto + width})
    out = out.withColumns({
        "previous_column": F.last(F.when(F.col("_full"), F.col("column_index")), ignorenulls=True).over(before),
        "next_column": F.first(F.when(F.col("_full"), F.col("column_index")), ignorenulls=True).over(after),
        "_previous_end": F.last(F.when(F.col("_full"), F.col("_end")), ignorenulls=True).over(before),
        "_next_start": F.first(F.when(F.col("_full"), F.col("_upto")), ignorenulls=True).over(after),
    })
    direction = F.when(align == "left", "right").when(align == "right", "left").when(align == "center", "both").when(align == "justify", "none").when(kind == "s", "right").otherwise("none")
    free = {"direction": direction, "left_free": F.col("_upto") - F.col("_previous_end"), "right_free": F.col("_next_start") - F.col("_end")}
    return out.where("_full").withColumns(free).drop("_full", "_upto", "_end", "_previous_end", "_next_start")


def extent(dimensions: DataFrame, cells: DataFrame, merged: DataFrame) -> DataFrame:
    """(sheet_id, last_row, last_column) from 0: the farthest of a sheet's declared ends (row_end, column_end, exclusive),
    its cells, also blank ones, and its merges. Sizes and styles of whole rows and columns do not count.
    """
    parts = [
        dimensions.select("sheet_id", (F.col("row_end") - 1).alias("r"), (F.col("column_end") - 1).alias("c")),
        cells.select("sheet_id", F.col("row_index").alias("r"), F.col("column_index").alias("c")),
        merged.select("sheet_id", F.col("end_row").alias("r"), F.col("end_column").alias("c")),
    ]
    most = lambda c: F.greatest(F.lit(0), F.coalesce(F.max(c), F.lit(0))).cast("int")
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("sheet_id").agg(most("r").alias("last_row"), most("c").alias("last_column"))


def visible_merges(merged: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """(sheet_id, merge_id, row_index, column_index, row_span, column_span): merges on the rows and columns that show.

    rows and columns (sheet_id, idx) are those that show. A merge stands at the first of its rows and columns that shows
    and spans those that do; one without any is left out. How many show up to an index is a running count, so a merge
    asks for two places on each axis (as-of steps), however large it is.
    """
    ranked = [(rows.select("sheet_id", F.lit("row").alias("axis"), "idx")), columns.select("sheet_id", F.lit("column").alias("axis"), "idx")]
    w = Window.partitionBy("sheet_id", "axis").orderBy("idx")
    shown = ranked[0].unionByName(ranked[1]).withColumn("n", F.row_number().over(w))
    ends = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(e).alias("end"), (F.col(f"{'start' if e == 'before' else 'end'}_{a}") - (1 if e == "before" else 0)).alias("idx")) for a in ("row", "column") for e in ("before", "upto")]))
    asked = merged.select("sheet_id", "merge_id", ends.alias("e")).select("sheet_id", "e.axis", "e.idx", F.struct("merge_id", "e.end").alias("ask"))
    both = shown.withColumn("ask", F.lit(None).cast(asked.schema["ask"].dataType)).unionByName(asked.withColumn("n", F.lit(None).cast("int")))
    upto = Window.partitionBy("sheet_id", "axis").orderBy("idx", F.col("ask").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    counted = both.withColumn("n", F.coalesce(F.last("n", ignorenulls=True).over(upto), F.lit(0))).where("ask IS NOT NULL")
    at = lambda a, e: F.max(F.when((F.col("axis") == a) & (F.col("ask.end") == e), F.col("n"))).alias(f"{a}_{e}")
    spans = counted.groupBy("sheet_id", "ask.merge_id").agg(*[at(a, e) for a in ("row", "column") for e in ("before", "upto")]).where("row_upto > row_before AND column_upto > column_before")
    out = spans
    for a in ("row", "column"):
        first = shown.where(F.col("axis") == a).select("sheet_id", F.col("idx").alias(f"{a}_index"), (F.col("n") - 1).alias(f"{a}_before"))
        out = out.join(first, ["sheet_id", f"{a}_before"])
    return out.select("sheet_id", "merge_id", "row_index", "column_index", (F.col("row_upto") - F.col("row_before")).alias("row_span"), (F.col("column_upto") - F.col("column_before")).alias("column_span"))


# Rows and columns of a sheet that is made whole as a preview.
MOST_ROWS, MOST_COLUMNS = 200, 80


def capped(cells: DataFrame, rows: int = MOST_ROWS, columns: int = MOST_COLUMNS) -> DataFrame:
    """The cells of a preview, with cut: does its sheet have more? Sheets that are not previews are never cut."""
    w = Window.partitionBy("sheet_id")
    more = (F.max("row_index").over(w) > rows) | (F.max("column_index").over(w) > columns)
    return cells.withColumn("cut", more).where((F.col("row_index") <= rows) & (F.col("column_index") <= columns))
