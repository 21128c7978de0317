"""Sizes and offsets along a sheet's rows or columns, from sparse overrides of a default size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEYS = ["sheet_id", "axis"]


def offsets(overrides: DataFrame) -> DataFrame:
    """(sheet_id, axis, idx, size, start, end) of each override (sheet_id, axis, idx, size, hidden, default_size).

    A hidden row or column has size 0, a negative size counts as 0. Start is the offset of its upper or left edge: the
    default size for all before it, and the difference of every override before it. Indexes are unique by axis.
    """
    size = F.when(F.col("hidden"), 0.0).otherwise(F.greatest(F.col("size"), F.lit(0.0)))
    before = Window.partitionBy(*KEYS).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    sized = overrides.where("idx >= 1").withColumn("size", size)
    start = (F.col("idx") - 1) * F.col("default_size") + F.coalesce(F.sum(F.col("size") - F.col("default_size")).over(before), F.lit(0.0))
    return sized.withColumn("start", start).withColumn("end", F.col("start") + F.col("size"))


def find(sized: DataFrame, points: DataFrame) -> DataFrame:
    """points (sheet_id, axis, x, default_size, count) with idx: the row or column that holds the offset x.

    The smallest index whose end lies beyond x, at most count; negative offsets are in the first. sized is what
    offsets() gives; an as-of step over the union of both, so no range join.
    """
    known = sized.select(*KEYS, F.col("start").alias("x"), F.lit(None).cast("double").alias("default_size"), F.lit(None).cast("long").alias("count"), F.struct("idx", "start", "end").alias("at"))
    asked = points.select(*KEYS, F.col("x").cast("double").alias("x"), F.col("default_size").cast("double").alias("default_size"), F.col("count").cast("long").alias("count"), F.lit(None).cast(known.schema["at"].dataType).alias("at"))
    # at the same place overrides come first, those without a size before others
    upto = Window.partitionBy(*KEYS).orderBy("x", F.col("at").isNull(), "at.idx").rowsBetween(Window.unboundedPreceding, 0)
    near = known.unionByName(asked).withColumn("near", F.last("at", ignorenulls=True).over(upto)).where("count IS NOT NULL")
    plain = lambda x: F.floor(x / F.col("default_size")).cast("long")
    idx = F.when(F.col("near").isNull(), plain(F.col("x")) + 1).when(F.col("x") < F.col("near.end"), F.col("near.idx").cast("long")).otherwise(F.col("near.idx") + 1 + plain(F.col("x") - F.col("near.end")))
    return near.select(*KEYS, "x", F.least("count", F.greatest(F.lit(1).cast("long"), idx)).alias("idx"))


def offset_at(sized: DataFrame, points: DataFrame) -> DataFrame:
    """points (sheet_id, axis, idx, default_size and more) with start: the offset of that row or column.

    An as-of step by index over the union of both, as in find().
    """
    rest = [c for c in points.columns if c not in (*KEYS, "idx")]
    asked = points.select(*KEYS, F.col("idx").cast("int").alias("idx"), F.struct(*rest).alias("row"))
    known = sized.select(*KEYS, F.col("idx").cast("int").alias("idx"), F.struct("idx", "end").alias("at"))
    both = known.unionByName(asked, allowMissingColumns=True)
    before = Window.partitionBy(*KEYS).orderBy("idx", F.col("row").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("near", F.last("at", ignorenulls=True).over(before)).where("row IS NOT NULL")
    default = F.col("row.default_size")
    start = F.when(F.col("near").isNull(), (F.col("idx") - 1) * default).otherwise(F.col("near.end") + (F.col("idx") - F.col("near.idx") - 1) * default)
    return found.select(*KEYS, "idx", start.alias("start"), *[F.col(f"row.{c}") for c in rest])


def viewport(sized: DataFrame, views: DataFrame, least: float = 240.0, overscan: float = 2.0) -> DataFrame:
    """views (sheet_id, axis, view_id, scroll, size, default_size, count) with first and last: the rows or columns from
    ``overscan`` sizes of the view before it to as many behind it; a view counts as ``least`` px at least."""
    span = F.greatest(F.lit(least), F.col("size"))
    top = F.greatest(F.lit(0.0), F.col("scroll"))
    edges = F.explode(F.array(F.struct(F.lit("first").alias("edge"), F.greatest(F.lit(0.0), top - overscan * span).alias("x")), F.struct(F.lit("last").alias("edge"), (top + (1 + overscan) * span).alias("x"))))
    asked = views.select(*KEYS, "view_id", "default_size", "count", edges.alias("e")).select(*KEYS, "view_id", "default_size", "count", "e.edge", "e.x")
    found = find(sized, asked.select(*KEYS, "x", "default_size", "count").distinct()).withColumnRenamed("idx", "_at")
    at = asked.join(found, [*KEYS, "x"]).groupBy(*KEYS, "view_id").agg(*[F.max(F.when(F.col("edge") == e, F.col("_at"))).alias(e) for e in ("first", "last")])
    return views.join(at, [*KEYS, "view_id"]).withColumn("last", F.greatest("first", "last"))
