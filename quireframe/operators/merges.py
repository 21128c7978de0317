"""Merged ranges: covered cells, cells in ranges, overlapping ranges, and growth of ranges until no merge is cut.

Ranges have start_row, start_column, end_row and end_column, both ends inclusive. Joins are by sheet and tile, with the
exact test as a residual, so that no join compares every range with every other.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireframe.functions import a1
from quireframe.operators.lineage import cut

ENDS = ["start_row", "start_column", "end_row", "end_column"]


def tiled(ranges: DataFrame) -> DataFrame:
    """The ranges once for each tile that they touch."""
    rows = F.explode(F.sequence(a1.row_tile(F.col("start_row")), a1.row_tile(F.col("end_row"))))
    columns = F.explode(F.sequence(a1.column_tile(F.col("start_column")), a1.column_tile(F.col("end_column"))))
    return ranges.withColumn("row_tile", rows).withColumn("column_tile", columns)


def cover(merges: DataFrame) -> DataFrame:
    """(sheet_id, row_index, column_index, row_span, column_span, hidden_by_merge): a row for each cell of each merge.

    The root has the spans; the others are hidden and have spans of 1.
    """
    rows = merges.withColumn("row_index", F.explode(F.sequence("start_row", "end_row")))
    cells = rows.withColumn("column_index", F.explode(F.sequence("start_column", "end_column")))
    root = (F.col("row_index") == F.col("start_row")) & (F.col("column_index") == F.col("start_column"))
    span = lambda a, b: F.when(root, F.col(b) - F.col(a) + 1).otherwise(1)
    return cells.select("sheet_id", "row_index", "column_index", span("start_row", "end_row").alias("row_span"), span("start_column", "end_column").alias("column_span"), (~root).alias("hidden_by_merge"))


def containing(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """The cells that a merge holds, with the merge's ends and merge_id."""
    laid = tiled(merges.select("sheet_id", "merge_id", *ENDS))
    placed = cells.withColumns({"row_tile": a1.row_tile(F.col("row_index")), "column_tile": a1.column_tile(F.col("column_index"))})
    found = placed.join(laid, ["sheet_id", "row_tile", "column_tile"])
    inside = F.col("row_index").between(F.col("start_row"), F.col("end_row")) & F.col("column_index").between(F.col("start_column"), F.col("end_column"))
    return found.where(inside).drop("row_tile", "column_tile")


def overlapping(ranges: DataFrame, merges: DataFrame) -> DataFrame:
    """(sheet_id, range_id, merge_id) of all pairs that share a cell.

    A pair meets in every tile that both touch, and counts only in the first of them, so nothing has to be made distinct.
    """
    a = tiled(ranges.select("sheet_id", "range_id", *ENDS))
    b = tiled(merges.select("sheet_id", "merge_id", *[F.col(c).alias(f"m_{c}") for c in ENDS], *ENDS)).drop(*ENDS)
    both = a.join(b, ["sheet_id", "row_tile", "column_tile"])
    first = lambda tile, c: F.greatest(tile(F.col(f"start_{c}")), tile(F.col(f"m_start_{c}")))
    once = (F.col("row_tile") == first(a1.row_tile, "row")) & (F.col("column_tile") == first(a1.column_tile, "column"))
    return both.where(once & intersect("", "m_")).select("sheet_id", "range_id", "merge_id", *[f"m_{c}" for c in ENDS])


def intersect(a: str, b: str) -> Column:
    """Do two ranges share a cell? The arguments are prefixes of their columns."""
    meet = lambda c: (F.col(f"{a}start_{c}") <= F.col(f"{b}end_{c}")) & (F.col(f"{b}start_{c}") <= F.col(f"{a}end_{c}"))
    return meet("row") & meet("column")


def expand(ranges: DataFrame, merges: DataFrame, rounds: int = 100) -> DataFrame:
    """The ranges (sheet_id, range_id and ends) grown until every merge that they touch lies inside.

    Each round grows only ranges that grew in the one before. Raises RuntimeError if they still grow after ``rounds``.
    """
    own = ranges.select("sheet_id", "range_id", *ENDS)
    grown, still = None, own
    for _ in range(rounds):
        found = overlapping(still, merges).groupBy("sheet_id", "range_id").agg(
            F.min("m_start_row").alias("a"), F.min("m_start_column").alias("b"), F.max("m_end_row").alias("c"), F.max("m_end_column").alias("d")
        )
        wide = still.join(found, ["sheet_id", "range_id"], "left")
        new = [F.least("start_row", "a"), F.least("start_column", "b"), F.greatest("end_row", "c"), F.greatest("end_column", "d")]
        changed = (F.col("a") < F.col("start_row")) | (F.col("b") < F.col("start_column")) | (F.col("c") > F.col("end_row")) | (F.col("d") > F.col("end_column"))
        step = cut(wide.select("sheet_id", "range_id", *[n.alias(e) for n, e in zip(new, ENDS, strict=True)], F.coalesce(changed, F.lit(False)).alias("changed")))
        done = step.where("NOT changed").drop("changed")
        grown = done if grown is None else grown.unionByName(done)
        still = step.where("changed").drop("changed")
        if not still.take(1):
            return grown
    raise RuntimeError(f"ranges still grow after {rounds} rounds")


def drop_overlapping(merges: DataFrame) -> DataFrame:
    """The merges (sheet_id, merge_id and ends) that overlap no kept one with a smaller merge_id: the first come stay.

    A merge that ends before it begins, or begins before the first row or column, is not kept either. Each sheet is
    folded in order of merge_id in one task, as each choice hangs on those before it; only ids and ends go there, and
    a merge is held against the kept ones by tile.
    """
    own = merges.select("sheet_id", "merge_id", *ENDS)

    def fold(sheet: pd.DataFrame) -> pd.DataFrame:
        tiles: dict[tuple[int, int], list[tuple]] = {}
        kept = []
        for sheet_id, merge_id, a, b, c, d in sheet.sort_values("merge_id").itertuples(index=False):
            if not (1 <= a <= c and 1 <= b <= d):
                continue
            there = [(x, y) for x in range(a // a1.TILE_ROWS, c // a1.TILE_ROWS + 1) for y in range(b // a1.TILE_COLUMNS, d // a1.TILE_COLUMNS + 1)]
            if any(a <= e[2] and e[0] <= c and b <= e[3] and e[1] <= d for t in there for e in tiles.get(t, ())):
                continue
            for t in there:
                tiles.setdefault(t, []).append((a, b, c, d))
            kept.append((sheet_id, merge_id))
        return pd.DataFrame(kept, columns=["sheet_id", "merge_id"])

    kept = own.groupBy("sheet_id").applyInPandas(fold, own.select("sheet_id", "merge_id").schema)
    return merges.join(kept, ["sheet_id", "merge_id"], "left_semi")
