"""Reading layout of sheets: rows made as high as their texts need, and places carried from one row axis to another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quireframe.operators import axis


def hidden_runs(sized: DataFrame) -> DataFrame:
    """(sheet_id, idx, run_start) of the rows without height: where the run of them that holds the row begins."""
    w = Window.partitionBy("sheet_id").orderBy("idx")
    flat = sized.where("axis = 'row' AND size <= 0")
    runs = flat.withColumn("_run", F.col("idx") - F.row_number().over(w))
    return runs.select("sheet_id", "idx", F.min("idx").over(Window.partitionBy("sheet_id", "_run")).alias("run_start"))


def spans(cells: DataFrame, sized: DataFrame, axis_name: str, first: str, last: str, default: float, out: str) -> DataFrame:
    """cells (distinct, sheet_id and more) with ``out``: the px from where row or column ``first`` begins to where ``last`` ends."""
    ends = F.explode(F.array(F.struct(F.col(first).alias("idx"), F.lit(-1.0).alias("sign")), F.struct((F.col(last) + 1).alias("idx"), F.lit(1.0).alias("sign"))))
    rest = [c for c in cells.columns if c != "sheet_id"]
    points = cells.select("sheet_id", F.lit(axis_name).alias("axis"), F.struct(*rest).alias("cell"), ends.alias("e")).select("sheet_id", "axis", "e.idx", F.lit(default).alias("default_size"), "cell", "e.sign")
    sums = axis.offset_at(sized, points).groupBy("sheet_id", "cell").agg(F.sum(F.col("start") * F.col("sign")).alias(out))
    return sums.select("sheet_id", "cell.*", out)


def row_updates(cells: DataFrame, sized: DataFrame, default_row: float) -> DataFrame:
    """(sheet_id, idx, height): rows that have to be higher, for cells (sheet_id, row_index, end_row, needed).

    A cell that needs more than its rows have gives what is missing to the last of them that shows; several cells give
    the largest. Cells whose rows are all hidden change nothing.
    """
    runs = hidden_runs(sized).withColumnsRenamed({"idx": "end_row"})
    placed = cells.select("sheet_id", "row_index", "end_row", "needed").distinct()
    wide = spans(placed, sized, "row", "row_index", "end_row", default_row, "has")
    wide = wide.join(runs, ["sheet_id", "end_row"], "left").withColumn("idx", F.coalesce(F.col("run_start") - 1, F.col("end_row")))
    short = wide.where((F.col("idx") >= F.col("row_index")) & (F.col("needed") > F.col("has")))
    own = sized.where("axis = 'row'").select("sheet_id", "idx", F.col("size").alias("_size"))
    target = short.join(own, ["sheet_id", "idx"], "left").withColumn("_now", F.coalesce("_size", F.lit(default_row)))
    return target.groupBy("sheet_id", "idx").agg(F.max(F.col("_now") + F.col("needed") - F.col("has")).alias("height"))


def updated(overrides: DataFrame, updates: DataFrame, default_row: float) -> DataFrame:
    """overrides (as of axis.offsets()) with rows as high as the updates ask, never lower; hidden rows stay."""
    new = updates.select("sheet_id", F.lit("row").alias("axis"), "idx", F.col("height").alias("_new"))
    both = overrides.join(new, ["sheet_id", "axis", "idx"], "full")
    size = F.when(F.coalesce("hidden", F.lit(False)), F.col("size")).otherwise(F.greatest(F.coalesce("size", F.lit(0.0)), F.coalesce("_new", F.lit(0.0))))
    return both.select("sheet_id", "axis", "idx", size.alias("size"), F.coalesce("hidden", F.lit(False)).alias("hidden"), F.coalesce("default_size", F.lit(default_row)).alias("default_size"))


def remapped(ranges: DataFrame, source: DataFrame, display: DataFrame, default_row: float, rows: int) -> DataFrame:
    """(sheet_id, object_id, y, height) of vertical ranges (sheet_id, object_id, y, height) on another row axis.

    Both axes are what axis.offsets() gives for the same rows. An end lies as far into its row as before, as a share of
    the row's height; a height is 1 at least. The map is linear between the rows' edges: as-of steps find the row on one
    axis and its place on the other.
    """
    ends = F.explode(F.array(F.struct(F.lit("top").alias("end"), F.col("y").alias("x")), F.struct(F.lit("bottom").alias("end"), (F.col("y") + F.col("height")).alias("x"))))
    asked = ranges.select("sheet_id", "object_id", ends.alias("e")).select("sheet_id", "object_id", "e.end", F.col("e.x").cast("double").alias("x"))
    points = asked.select("sheet_id", "x").distinct().select("sheet_id", F.lit("row").alias("axis"), "x", F.lit(default_row).alias("default_size"), F.lit(rows).alias("count"))
    at = axis.find(source, points).select("sheet_id", F.lit("row").alias("axis"), "idx", "x", F.lit(default_row).alias("default_size"))
    here = axis.offset_at(source, at).select("sheet_id", "axis", "idx", "x", "default_size", F.col("start").alias("from"))
    there = axis.offset_at(display, here).withColumnRenamed("start", "to")
    size = lambda sized, name: sized.where("axis = 'row'").select("sheet_id", F.col("idx").alias("idx"), F.col("size").alias(name))
    known = there.join(size(source, "_a"), ["sheet_id", "idx"], "left").join(size(display, "_b"), ["sheet_id", "idx"], "left")
    a, b = F.coalesce("_a", F.lit(default_row)), F.coalesce("_b", F.lit(default_row))
    share = F.when(a > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("x") - F.col("from")) / a))).otherwise(0.0)
    mapped = known.select("sheet_id", "x", (F.col("to") + b * share).alias("mapped"))
    both = asked.join(mapped, ["sheet_id", "x"]).groupBy("sheet_id", "object_id").agg(*[F.max(F.when(F.col("end") == e, F.col("mapped"))).alias(e) for e in ("top", "bottom")])
    return both.select("sheet_id", "object_id", F.col("top").alias("y"), F.greatest(F.lit(1.0), F.col("bottom") - F.col("top")).alias("height"))
