"""Cell addresses: column letters, references, ranges and tiles, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TILE_ROWS, TILE_COLUMNS = 200, 50


def _letter(n: Column) -> Column:
    return F.chr((n + 65).cast("long"))


def column_label(index: Column) -> Column:
    """1 is A, 27 is AA, 18278 is ZZZ; '' below 1, null beyond three letters and for null."""
    two, three = index - 27, index - 703
    return (
        F.when(index < 1, "")
        .when(index <= 26, _letter(index - 1))
        .when(index <= 702, F.concat(_letter(F.floor(two / 26)), _letter(two % 26)))
        .when(index <= 18278, F.concat(_letter(F.floor(three / 676)), _letter(F.floor(three / 26) % 26), _letter(three % 26)))
    )


def column_index(label: Column) -> Column:
    """The number of a column's letters (upper case is the caller's duty); 0 for ''."""
    letters = F.filter(F.split(label, ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(0), lambda n, c: n * 26 + F.ascii(c) - 64)


def cell_ref(row: Column, column: Column) -> Column:
    return F.concat(column_label(column), row.cast("string"))


def parse_ref(ref: Column) -> Column:
    """struct<row, column>; anything but letters and then digits is row 1, column 1."""
    good = ref.rlike(r"^[A-Za-z]+[0-9]+$")
    part = lambda i: F.regexp_extract(ref, r"^([A-Za-z]+)([0-9]+)$", i)
    row = F.when(good, part(2).cast("int")).otherwise(1)
    column = F.when(good, column_index(F.upper(part(1)))).otherwise(1)
    return F.when(ref.isNotNull(), F.struct(row.alias("row"), column.alias("column")))


def parse_range(text: Column) -> Column:
    """struct<start_row, start_column, end_row, end_column>; dollar signs do not count, one cell is its own end, '' is null."""
    ends = F.split(F.regexp_replace(text, r"\$", ""), ":")
    start, end = parse_ref(ends[0]), parse_ref(F.coalesce(F.get(ends, F.lit(1)), ends[0]))
    return F.when(
        text != "",
        F.struct(start["row"].alias("start_row"), start["column"].alias("start_column"), end["row"].alias("end_row"), end["column"].alias("end_column")),
    )


def row_tile(row: Column) -> Column:
    return F.floor((row - 1) / TILE_ROWS).cast("int")


def column_tile(column: Column) -> Column:
    return F.floor((column - 1) / TILE_COLUMNS).cast("int")
