"""Heights of pages in two levels: blocks that hold their pages' heights and sum, prefix sums over the blocks alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Pages in a block.
BLOCK = 64


def _height(c: Column) -> Column:
    return F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0))


def _sum(heights: Column) -> Column:
    return F.aggregate(heights, F.lit(0.0), lambda a, h: a + h)


def build(pages: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """(key, block, heights, total) of pages (key, idx from 0 without gaps, height); negative heights count as 0."""
    sized = pages.select(key, F.floor(F.col("idx") / block).cast("long").alias("block"), F.struct("idx", _height(F.col("height")).alias("height")).alias("p"))
    blocks = sized.groupBy(key, "block").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["height"]).alias("heights"))
    return blocks.withColumn("total", _sum(F.col("heights")))


def append(blocks: DataFrame, more: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """blocks with pages (key, ord, height) behind those that are there: only a key's last block and new ones change."""
    counts = blocks.groupBy(key).agg((F.max("block") * block + F.max_by(F.size("heights"), "block")).alias("_n"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("ord")) - 1
    placed = more.withColumn("_place", place).join(counts, key, "left").select(key, (F.coalesce("_n", F.lit(0)) + F.col("_place")).alias("idx"), "height")
    new = build(placed, key, block)
    joined = blocks.select(key, "block", "heights").join(new.select(key, "block", F.col("heights").alias("_more")), [key, "block"], "full")
    both = F.concat(F.coalesce("heights", F.array().cast("array<double>")), F.coalesce("_more", F.array().cast("array<double>")))
    return joined.select(key, "block", both.alias("heights")).withColumn("total", _sum(F.col("heights")))


def replace(blocks: DataFrame, changes: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """blocks with new heights for pages (key, idx, height); pages that are not there are passed over.

    Changes meet by block; a block without one keeps its row as it is. A block's total moves by the differences.
    """
    place = F.pmod(F.col("idx"), F.lit(block)).cast("int")
    grouped = changes.select(key, F.floor(F.col("idx") / block).cast("long").alias("block"), F.struct(place.alias("at"), _height(F.col("height")).alias("height")).alias("c")).groupBy(key, "block").agg(F.map_from_entries(F.collect_list("c")).alias("_new"))
    joined = blocks.join(grouped, [key, "block"], "left")
    fresh = F.transform("heights", lambda h, i: F.coalesce(F.try_element_at("_new", i), h))
    changed = joined.withColumn("_heights", F.when(F.col("_new").isNotNull(), fresh).otherwise(F.col("heights")))
    delta = _sum(F.zip_with("_heights", "heights", lambda a, b: a - b))
    return changed.select(key, "block", F.col("_heights").alias("heights"), F.when(F.col("_new").isNull(), F.col("total")).otherwise(F.col("total") + delta).alias("total"))


def starts(blocks: DataFrame, key: str) -> DataFrame:
    """blocks with start, the sum of all before, and all, the whole sum: a window over the blocks, one row for each."""
    w = Window.partitionBy(key)
    before = w.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumns({"start": F.coalesce(F.sum("total").over(before), F.lit(0.0)), "all": F.sum("total").over(w), "last": F.max("block").over(w)})


def offset_of(blocks: DataFrame, points: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """points (key, idx and more) with offset: the sum of the heights of all pages before page idx; all beyond the last.

    A point meets the one block that holds it, whose heights up to it are added inside the row.
    """
    known = starts(blocks, key)
    clamped = points.withColumn("_idx", F.greatest(F.col("idx"), F.lit(0)).cast("long"))
    ends = known.where("block = last").select(key, F.col("all").alias("_all"), (F.col("block") * block + F.size("heights")).alias("_n"))
    asked = clamped.join(ends, key, "left").withColumn("block", F.floor(F.least("_idx", "_n") / block).cast("long"))
    found = asked.join(known.select(key, "block", "start", "heights"), [key, "block"], "left")
    part = _sum(F.slice("heights", F.lit(1), (F.col("_idx") - F.col("block") * block).cast("int")))
    offset = F.when(F.col("_idx") >= F.col("_n"), F.col("_all")).otherwise(F.col("start") + part)
    return found.select(*points.columns, F.coalesce(offset, F.lit(0.0)).alias("offset"))


def _walk(s: Column, height: Column) -> Column:
    """One page on, if what is left reaches beyond it; nothing is left from the first on that it does not."""
    return F.when(s["left"] >= height, F.struct((s["left"] - height).alias("left"), (s["n"] + 1).alias("n"))).otherwise(F.struct(F.lit(-1.0).alias("left"), s["n"].alias("n")))


def index_at(blocks: DataFrame, points: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """points (key, x and more) with idx: the page that holds the offset x.

    The first page up to 0 and the last from the whole height on; -1 without pages. An as-of step over the starts of the
    blocks (of equal ones the last, as blocks without height hold nothing) finds a point's block, whose heights are
    walked inside the row.
    """
    known = starts(blocks, key)
    at = known.select(key, F.col("start").alias("x"), F.struct("block", "start", "heights", "all", "last").alias("b"))
    asked = points.select(key, F.col("x").cast("double").alias("x"), F.struct(*points.columns).alias("row"))
    both = at.unionByName(asked, allowMissingColumns=True)
    upto = Window.partitionBy(key).orderBy("x", F.col("row").isNotNull(), "b.block").rowsBetween(Window.unboundedPreceding, 0)
    edge = Window.partitionBy(key)
    found = both.withColumns({"near": F.last("b", ignorenulls=True).over(upto), "any": F.max(F.struct(F.col("b.block"), F.size("b.heights").alias("n"))).over(edge)}).where("row IS NOT NULL")
    left = F.col("x") - F.col("near.start")
    walked = F.aggregate("near.heights", F.struct(left.alias("left"), F.lit(0).alias("n")), _walk, lambda s: s["n"])
    end = F.col("any.block") * block + F.col("any.n") - 1
    idx = F.when(F.col("any.block").isNull(), -1).when(F.col("x") <= 0, 0).when(F.col("x") >= F.col("near.all"), end).otherwise(F.least(end, F.col("near.block") * block + walked))
    return found.select(*[F.col(f"row.{c}").alias(c) for c in points.columns], idx.cast("long").alias("idx"))


def page_window(blocks: DataFrame, views: DataFrame, key: str, block: int = BLOCK, overscan: float = 2.0, least: int = 3) -> DataFrame:
    """views (key, view_id, scroll, size) with first, last (exclusive), above and below: the pages to show and the heights
    of what is left out before and behind them.

    Pages from ``overscan`` sizes of the view before it to as many behind, at least ``least`` (as far as there are so
    many), of which half of what is missing comes before.
    """
    ends = starts(blocks, key).where("block = last").select(key, (F.col("block") * block + F.size("heights")).alias("_n"), F.col("all").alias("_all"))
    span = F.greatest(F.col("size"), F.lit(0.0)) * overscan
    edges = F.explode(F.array(F.struct(F.lit("a").alias("edge"), F.greatest(F.lit(0.0), F.col("scroll") - span).alias("x")), F.struct(F.lit("b").alias("edge"), (F.col("scroll") + F.col("size") + span).alias("x"))))
    asked = views.select(key, "view_id", edges.alias("e")).select(key, "view_id", "e.edge", "e.x")
    found = index_at(blocks, asked, key, block).groupBy(key, "view_id").agg(*[F.max(F.when(F.col("edge") == e, F.col("idx"))).alias(f"_{e}") for e in "ab"])
    known = views.join(found, [key, "view_id"]).join(ends, key, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    start, end = F.greatest(F.col("_a"), F.lit(0)), F.least(F.col("_b") + 1, F.col("_n"))
    missing = F.greatest(F.lit(0), least - (end - start))
    before = F.least(start, F.ceil(missing / 2))
    last = F.least(F.col("_n"), end + missing - before)
    first = F.when(missing > 0, F.greatest(F.lit(0), last - least)).otherwise(start)
    placed = known.withColumns({"first": first.cast("long"), "last": last.cast("long")}).drop("_a", "_b", "_n")
    above = offset_of(blocks, placed.select(key, "view_id", F.col("first").alias("idx")), key, block).select(key, "view_id", F.col("offset").alias("above"))
    upto = offset_of(blocks, placed.select(key, "view_id", F.col("last").alias("idx")), key, block).select(key, "view_id", F.col("offset").alias("_upto"))
    out = placed.join(above, [key, "view_id"]).join(upto, [key, "view_id"])
    return out.select(*views.columns, "first", "last", "above", (F.coalesce("_all", F.lit(0.0)) - F.col("_upto")).alias("below"))
