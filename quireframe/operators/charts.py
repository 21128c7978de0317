"""Chart data: dense series, shares, split pies, axis ends, tiers, and workload weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quireframe.functions import a1, chart


def matrix(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, idx, value): each series from 0 to its last point, gaps null; of points (keys, idx, value, ord) at one place the last counts."""
    settled = points.groupBy(*keys, "idx").agg(F.max_by("value", "ord").alias("value"))
    ends = settled.groupBy(*keys).agg(F.max("idx").alias("_end"))
    places = ends.select(*keys, F.explode(F.sequence(F.lit(0), F.col("_end").cast("int"))).alias("idx"))
    return places.join(settled.withColumn("idx", F.col("idx").cast("int")), [*keys, "idx"], "left")


def percent_stack(points: DataFrame, chart_keys: list[str], category: str, value: str) -> DataFrame:
    """points with share: the value over the sum of its category's values; null where that is 0."""
    total = F.sum(value).over(Window.partitionBy(*chart_keys, category))
    return points.withColumn("share", F.when(total != 0, F.col(value) / total))


def of_pie(points: DataFrame, keys: list[str], order: Column, category: str, value: str, split: int | None = None) -> DataFrame:
    """(keys, part, pos, category, value): the last points of a pie in a second plot, and in the first one 'other' for their sum.

    ``split`` points go, a third of them (rounded up) if it is None; one at least and one at most stays behind.
    """
    w = Window.partitionBy(*keys)
    n = F.count("*").over(w)
    k = F.least(n - 1, F.greatest(F.lit(1), F.lit(split) if split is not None else F.ceil(n / 3)))
    placed = points.withColumns({"pos": F.row_number().over(w.orderBy(order)), "_n": n}).withColumn("_tail", F.col("pos") > F.col("_n") - k)
    rows = placed.select(*keys, F.when(F.col("_tail"), "second").otherwise("main").alias("part"), "pos", F.col(category).alias("category"), F.col(value).alias("value"))
    other = placed.where("_tail").groupBy(*keys).agg(F.sum(value).alias("value"), F.min("pos").alias("pos"))
    return rows.unionByName(other.select(*keys, F.lit("main").alias("part"), "pos", F.lit("other").alias("category"), "value"))


def radar_axes(points: DataFrame, keys: list[str], category: str, value: str) -> DataFrame:
    """(keys, category, largest, axis_max): the largest value of all series, 0 at least, and a round axis end."""
    most = points.groupBy(*keys, category).agg(F.greatest(F.coalesce(F.max(value), F.lit(0.0)), F.lit(0.0)).alias("largest"))
    return most.withColumn("axis_max", chart.nice_max(F.col("largest")))


def with_categories(points: DataFrame, keys: list[str]) -> DataFrame:
    """points (keys, series, idx from 0, category, value) with categories: those of a chart that has none are 1, 2, 3 and so on.

    A chart that has categories keeps them, and places without one have none.
    """
    has = F.max(F.col("category").isNotNull().cast("int")).over(Window.partitionBy(*keys)) == 1
    return points.withColumn("category", F.when(has, F.col("category")).otherwise((F.col("idx") + 1).cast("string")))


def radar_order(axes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """axes with place (from 0): the first axis stays, the others go the other way round, as they are drawn clockwise."""
    w = Window.partitionBy(*keys)
    n, at = F.count("*").over(w), F.row_number().over(w.orderBy(order))
    return axes.withColumns({"_n": n, "_at": at}).withColumn("place", F.when((F.col("_n") <= 2) | (F.col("_at") == 1), F.col("_at") - 1).otherwise(F.col("_n") - F.col("_at") + 1).cast("int")).drop("_n", "_at")


def plotted(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, drawn, series, place, name, x, y): what is drawn of points (keys, kind, series, type, idx, category, value, x).

    kind is the chart's. A pie (or doughnut) draws its first series by category; a radar the axes in radar_order(), but
    cartesian where it has no categories; every other chart all series, points of scatter and bubble series at their x,
    else at their category, else by number. A gap is a point without y, on a pie 0.
    """
    known = with_categories(points.withColumn("_own", F.col("category")), keys)
    w = Window.partitionBy(*keys)
    named = F.max(F.col("_own").isNotNull().cast("int")).over(w) == 1
    drawn = F.when(F.col("kind").isin("pie", "doughnut"), "pie").when((F.col("kind") == "radar") & named, "radar").otherwise("cartesian")
    rows = known.withColumn("drawn", drawn).where((F.col("drawn") != "pie") | (F.col("series") == 0))
    axes = rows.where("drawn = 'radar'").select(*keys, "idx").distinct()
    order = radar_order(axes, keys, "idx").withColumnRenamed("place", "_place")
    placed = rows.join(order, [*keys, "idx"], "left")
    scatter = chart.drawn_as(F.col("type")) == "scatter"
    x = F.when((F.col("drawn") == "cartesian") & scatter, F.coalesce("x", F.col("_own").try_cast("double"), (F.col("idx") + 1).cast("double")))
    y = F.when(F.col("drawn") == "pie", F.coalesce("value", F.lit(0.0))).otherwise(F.col("value"))
    return placed.select(*keys, "drawn", "series", F.coalesce("_place", F.col("idx")).cast("int").alias("place"), F.col("category").alias("name"), x.alias("x"), y.alias("y"))


def tiers(rows: DataFrame, keys: list[str], tier: str, order: str) -> DataFrame:
    """(keys, tier, first, number): the distinct tiers, numbered from 1 as they come."""
    found = rows.groupBy(*keys, tier).agg(F.min(order).alias("first"))
    return found.withColumn("number", F.row_number().over(Window.partitionBy(*keys).orderBy("first", tier)))


def slide_weights(elements: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, elements, weight): images 20, charts 30, tables 4 a row (one at least), others 1."""
    weight = F.when(F.col("type") == "image", 20).when(F.col("type") == "chart", 30).when(F.col("type") == "table", 4 * F.greatest(F.lit(1), F.col("row_count"))).otherwise(1)
    return elements.groupBy(*keys).agg(F.count("*").alias("elements"), F.sum(weight).cast("long").alias("weight"))


def deck_profile(slides: Column, weight: Column, most_elements: Column) -> tuple[Column, Column]:
    """(slides, thumbnails): 'lazy' and 'virtual' beyond the limits, else 'materialized' and 'normal'."""
    return F.when((slides >= 80) | (weight >= 3000) | (most_elements >= 300), "lazy").otherwise("materialized"), F.when(slides > 50, "virtual").otherwise("normal")


def sheet_profile(rows: Column, columns: Column) -> Column:
    """How a grid of so many rows and columns is to be shown."""
    r, c = F.greatest(F.lit(1), F.floor(rows)), F.greatest(F.lit(1), F.floor(columns))
    return F.when(c >= 100, "two-axis-window").when((r >= 500) | (r * c >= 20000), "row-window").otherwise("table")


def column_shares(lengths: DataFrame, table: list[str], column: str, width: Column, total: int = 554, least: int = 64) -> DataFrame:
    """(table, column, weight, px): columns share the width by their widest text (8 at least), none narrower than ``least``."""
    weights = lengths.groupBy(*table, column).agg(F.greatest(F.lit(8.0), F.max(width)).alias("weight"))
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy(*table)) * total
    return weights.withColumn("px", F.greatest(F.lit(float(least)), share))


#: A reference of a chart: a sheet's name, in quotes (doubled inside) or plain, or none; a cell or a range.
REFERENCE = r"^=(?:'((?:''|[^'])+)'|([^!]+))?!?\$?([A-Z]+\$?[0-9]+(?::\$?[A-Z]+\$?[0-9]+)?)$"


def referenced_cells(references: DataFrame, sheets: DataFrame, cells: DataFrame) -> DataFrame:
    """references (their columns, among them sheet_id and formula) with target, ord, row_index, column_index and value.

    A reference gives a row for each cell of its range, row by row (ord from 0); value is null where the sheet has no
    such cell. target is the sheet (sheet_id, name) that the formula names, or the reference's own where it names none
    or none that is there. Formulas of another form give no rows. sheets may have a file_id with references and cells,
    then names count inside their file.
    """
    scope = [c for c in ("file_id",) if c in sheets.columns]
    part = lambda i: F.regexp_extract("formula", REFERENCE, i)
    named = F.trim(F.when(part(1) != "", F.replace(part(1), F.lit("''"), F.lit("'"))).otherwise(part(2)))
    asked = references.where(F.col("formula").rlike(REFERENCE)).withColumns({"_name": named, "_range": a1.parse_range(part(3))})
    known = sheets.groupBy(*scope, F.col("name").alias("_name")).agg(F.min("sheet_id").alias("_found"))
    asked = asked.join(known, [*scope, "_name"], "left").withColumn("target", F.coalesce("_found", "sheet_id"))
    r = F.col("_range")
    span = F.greatest(r["end_column"] - r["start_column"] + 1, F.lit(0))
    rows = asked.withColumns({"_first": r["start_row"], "_column": r["start_column"], "_span": span, "row_index": F.explode(F.when(r["start_row"] <= r["end_row"], F.sequence(r["start_row"], r["end_row"])))})
    each = rows.withColumn("column_index", F.explode(F.when(F.col("_span") > 0, F.sequence(F.col("_column"), F.col("_column") + F.col("_span") - 1))))
    each = each.withColumn("ord", ((F.col("row_index") - F.col("_first")) * F.col("_span") + F.col("column_index") - F.col("_column")).cast("long"))
    values = cells.select(*scope, F.col("sheet_id").alias("target"), "row_index", "column_index", "value")
    return each.join(values, [*scope, "target", "row_index", "column_index"], "left").select(*references.columns, "target", "ord", "row_index", "column_index", "value")


def first_chart(parts: DataFrame, keys: list[str], is_chart: Column, order: str, value: str) -> DataFrame:
    """(keys, order, value, charts): the first part that is a chart in each book, and how many it has; without one there is no row."""
    found = parts.where(is_chart).groupBy(*keys)
    return found.agg(F.min(order).alias(order), F.min_by(value, order).alias(value), F.count("*").alias("charts"))
