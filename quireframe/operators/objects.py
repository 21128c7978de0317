"""Floating objects of sheets: px rectangles of ranges and anchors, which objects a range shows, and the canvas they need."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireframe.operators import axis
from quireframe.operators.lineage import cut

#: Side in px of the grid's finest cells; those of each further level are twice as wide.
SIDE = 256.0
RECT = ["x", "y", "width", "height"]


def range_rects(ranges: DataFrame, sized: DataFrame, default_row: float, default_column: float) -> DataFrame:
    """ranges (sheet_id, range_id and ends) with x, y, width and height in px; sized is what axis.offsets() gives.

    A range ends where the row and the column after it begin.
    """
    edges = [("row", "start_row", 0, "y"), ("row", "end_row", 1, "bottom"), ("column", "start_column", 0, "x"), ("column", "end_column", 1, "right")]
    spread = F.explode(F.array_distinct(F.array(*[F.struct(F.lit(a).alias("axis"), (F.col(c) + off).cast("int").alias("idx")) for a, c, off, _ in edges])))
    points = ranges.select("sheet_id", spread.alias("p")).select("sheet_id", "p.axis", "p.idx", F.when(F.col("p.axis") == "row", default_row).otherwise(default_column).alias("default_size")).distinct()
    at, placed = axis.offset_at(sized, points), ranges
    for a, c, off, name in edges:
        # a row or column is looked up once for all ranges; how many there are is not known when the plan is made, so none are broadcast
        placed = placed.join(at.where(F.col("axis") == a).select("sheet_id", (F.col("idx") - off).alias(c), F.col("start").alias(name)).hint("merge"), ["sheet_id", c], "left")
    return placed.select(*ranges.columns, "x", "y", (F.col("right") - F.col("x")).alias("width"), (F.col("bottom") - F.col("y")).alias("height"))


def _level(side: Column) -> Column:
    """The finest level whose cells are at least as wide as the rectangle, so that it touches two in each direction at most."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(side, F.lit(1.0)) / SIDE))).cast("int")


def _levels(rects: DataFrame) -> Column:
    """The levels that rectangles lie on, as an array; a few whole numbers, whatever the rows."""
    found = sorted(r[0] for r in rects.select(_level(F.greatest("width", "height")).alias("level")).distinct().collect())
    return F.array(*map(F.lit, found)).cast("array<int>")


def _gridded(rects: DataFrame, name: str, at: Callable[[Column], Column]) -> DataFrame:
    """The rectangles once for each cell that they touch on the levels (is it the range's own?, level) that ``at`` gives for their own."""
    placed = rects.select("sheet_id", *[F.col(c).alias(f"{name}_{c}") for c in ("id", *RECT)], F.explode(at(_level(F.greatest("width", "height")))).alias("at"))
    placed = placed.select("*", "at.own", "at.level").drop("at")
    cell = lambda at: F.floor(at / (SIDE * F.pow(F.lit(2.0), F.col("level")))).cast("long")
    for axis_, size in (("x", "width"), ("y", "height")):
        placed = placed.withColumn(f"cell_{axis_}", F.explode(F.sequence(cell(F.col(f"{name}_{axis_}")), cell(F.col(f"{name}_{axis_}") + F.col(f"{name}_{size}")))))
    return placed


def intersecting(ranges: DataFrame, objects: DataFrame) -> DataFrame:
    """(sheet_id, range_id, object_id) of all pairs whose px rectangles meet; touching edges count.

    ranges (sheet_id, range_id) and objects (sheet_id, object_id) have x, y, width and height. A grid of levels: a
    rectangle lies on the level whose cells are as wide as it is, in four cells at most, so that none is spread over
    many; a pair meets on the coarser of both levels. Ranges on their own level meet objects of finer or the same one,
    and the other way round, so two small ones never meet only because a large one is there; only levels that the other
    side has are gone to. The upper left corner of what both share lies in one cell, where the pair counts.

    The ranges are written to the shared folder, as they are read for their levels and for the join. Spark takes the
    cells of a table for as few as its rows, so the join says how it is done: else they could be broadcast.
    """
    r = cut(ranges.select("sheet_id", F.col("range_id").alias("id"), *RECT))
    o = objects.select("sheet_id", F.col("object_id").alias("id"), *RECT)
    of_ranges, of_objects = _levels(r), _levels(o)
    on = lambda own, level: F.struct(F.lit(own).alias("own"), level.alias("level"))
    coarser = lambda levels, level, own: F.transform(F.filter(levels, lambda x: x > level), lambda x: on(own, x))
    placed = _gridded(r, "r", lambda level: F.concat(F.array(on(True, level)), coarser(of_objects, level, False)))
    met = _gridded(o, "o", lambda level: F.concat(F.array(on(True, level), on(False, level)), coarser(of_ranges, level, True)))
    side = SIDE * F.pow(F.lit(2.0), F.col("level"))
    meet, once = F.lit(True), F.lit(True)
    for at, size in (("x", "width"), ("y", "height")):
        meet = meet & (F.col(f"o_{at}") + F.col(f"o_{size}") >= F.col(f"r_{at}")) & (F.col(f"o_{at}") <= F.col(f"r_{at}") + F.col(f"r_{size}"))
        once = once & (F.col(f"cell_{at}") == F.floor(F.greatest(f"r_{at}", f"o_{at}") / side))
    pairs = placed.join(met.hint("merge"), ["sheet_id", "own", "level", "cell_x", "cell_y"])
    return pairs.where(meet & once).select("sheet_id", F.col("r_id").alias("range_id"), F.col("o_id").alias("object_id"))


def canvas(cells: DataFrame, objects: DataFrame, least: float = 0.0) -> DataFrame:
    """(sheet_id, width, height): the px that a sheet's grid (sheet_id, width, height) and its objects need together."""
    far = objects.groupBy("sheet_id").agg(F.max(F.col("x") + F.col("width")).alias("_x"), F.max(F.col("y") + F.col("height")).alias("_y"))
    joined = cells.join(far, "sheet_id", "left")
    return joined.select("sheet_id", F.greatest("width", F.coalesce("_x", F.lit(0.0)), F.lit(least)).alias("width"), F.greatest("height", F.coalesce("_y", F.lit(0.0)), F.lit(least)).alias("height"))


def anchor_rects(anchors: DataFrame, sized: DataFrame, default_row: float, default_column: float) -> DataFrame:
    """(sheet_id, object_id, x, y, width, height) of objects held by two cells (from_row, from_column, to_row, to_column
    from 1, each with an offset in px: from_y, from_x, to_y, to_x); sides are 1 px at least."""
    ends = [("row", "from_row", "from_y", "top"), ("row", "to_row", "to_y", "bottom"), ("column", "from_column", "from_x", "left"), ("column", "to_column", "to_x", "right")]
    spread = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(c).cast("int").alias("idx"), F.col(off).cast("double").alias("off"), F.lit(name).alias("edge")) for a, c, off, name in ends]))
    points = anchors.select("sheet_id", "object_id", spread.alias("p")).select("sheet_id", "p.axis", "p.idx", F.when(F.col("p.axis") == "row", default_row).otherwise(default_column).alias("default_size"), "object_id", "p.edge", "p.off")
    at = axis.offset_at(sized, points).groupBy("sheet_id", "object_id").agg(*[F.max(F.when(F.col("edge") == name, F.col("start") + F.col("off"))).alias(name) for *_, name in ends])
    side = lambda a, b: F.greatest(F.lit(1.0), F.col(b) - F.col(a))
    return at.select("sheet_id", "object_id", F.col("left").alias("x"), F.col("top").alias("y"), side("left", "right").alias("width"), side("top", "bottom").alias("height"))
