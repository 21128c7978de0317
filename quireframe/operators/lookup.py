"""Lookups: dictionaries of shared strings, cascades of styles, priority lists, column ranges and style runs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quireframe.operators.lineage import cut


def dictionary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, index, value): the distinct values of each file or sheet, numbered from 0 in their order."""
    distinct = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("value")).distinct()
    return distinct.withColumn("index", (F.row_number().over(Window.partitionBy(*keys).orderBy("value")) - 1).cast("int"))


def resolve(cells: DataFrame, entries: DataFrame, keys: list[str], index: str, missing: str | None = "") -> DataFrame:
    """cells with value: the dictionary's entry; ``missing`` where there is none, or an error if that is None."""
    known = entries.select(*keys, F.col("index").alias(index), F.col("value").alias("value"))
    joined = cells.join(known, [*keys, index], "left")
    gap = F.raise_error(F.concat(F.lit("no entry "), F.col(index).cast("string"))) if missing is None else F.lit(missing)
    return joined.withColumn("value", F.when(F.col("value").isNull() & F.col(index).isNotNull(), gap).otherwise(F.coalesce("value", F.lit(missing or ""))))


def cascade(df: DataFrame, levels: list[tuple[DataFrame, list[str]]], fields: list[str]) -> DataFrame:
    """df with each field from the last level that has it: levels are (defaults, keys), the most general first.

    Each level is a left join of defaults that are unique by key; a field of df itself comes before all levels.
    """
    own = {f: [F.col(f)] for f in fields if f in df.columns}
    out = df
    for i, (defaults, keys) in enumerate(levels):
        named = defaults.select(*keys, *[F.col(f).alias(f"_{i}_{f}") for f in fields if f in defaults.columns])
        out = out.join(named, keys, "left")
    order = range(len(levels) - 1, -1, -1)
    found = {f: F.coalesce(*own.get(f, []), *[F.col(f"_{i}_{f}") for i in order if f in levels[i][0].columns]) for f in fields}
    return out.select(*[c for c in df.columns if c not in fields], *[c.alias(f) for f, c in found.items()])


def by_priority(df: DataFrame, aliases: Column, entries: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    """df with the value of the first of its aliases (array<string>, best first) that the entries have; null if none.

    The aliases of a row are tried in one join; the keys identify a row of df.
    """
    tried = df.select(*keys, F.posexplode(aliases).alias("rank", "alias"))
    hits = tried.join(entries.select(F.col(name).alias("alias"), F.col(value).alias("hit")), "alias")
    best = hits.groupBy(*keys).agg(F.min_by("alias", "rank").alias("matched"), F.min_by("hit", "rank").alias(value))
    return df.join(best, keys, "left")


def anti_union(first: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of first whose key other does not have, and all rows of other."""
    return first.join(other.select(*keys).distinct(), keys, "left_anti").unionByName(other)


def column_setting(cells: DataFrame, spans: DataFrame, keys: list[str], value: str, last: bool = False) -> DataFrame:
    """cells with the setting of the first (or last) span (keys, first, last, ord, value) that holds their column_index.

    Spans are spread over their columns and settled there, so the join is on equal columns.
    """
    pick = F.max_by if last else F.min_by
    spread = spans.select(*keys, F.explode(F.sequence("first", "last")).alias("column_index"), "ord", value)
    settled = spread.groupBy(*keys, "column_index").agg(pick(value, "ord").alias(value))
    return cells.join(settled, [*keys, "column_index"], "left")


def style_runs(pieces: DataFrame, runs: DataFrame, key: str, value: str) -> DataFrame:
    """(key, piece_id, start, end, value): pieces of text cut at the borders of style runs, with the run's style.

    Pieces (key, piece_id, start, end) and runs (key, start, end, value) lie on one line for each key; runs do not
    overlap each other, nor do pieces. All borders are swept in order once, in a window inside the key: no range join.
    """
    kind = runs.schema[value].dataType
    none = F.lit(None)
    borders = [
        pieces.select(key, F.col("start").alias("at"), F.col("piece_id").cast("long").alias("opens"), none.cast(kind).alias("style"), F.lit("p").alias("of")),
        pieces.select(key, F.col("end").alias("at"), none.cast("long").alias("opens"), none.cast(kind).alias("style"), F.lit("p").alias("of")),
        runs.select(key, F.col("start").alias("at"), none.cast("long").alias("opens"), F.col(value).alias("style"), F.lit("r").alias("of")),
        runs.select(key, F.col("end").alias("at"), none.cast("long").alias("opens"), none.cast(kind).alias("style"), F.lit("r").alias("of")),
    ]
    all_ = borders[0].unionByName(borders[1]).unionByName(borders[2]).unionByName(borders[3])
    # one row for each place: what opens there, or that something closes
    mark = lambda of, c: F.max(F.when(F.col("of") == of, F.struct(F.col(c).isNotNull().alias("open"), F.col(c).alias("v"))))
    places = all_.groupBy(key, "at").agg(mark("p", "opens").alias("piece"), mark("r", "style").alias("run"))
    upto = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    swept = places.select(
        key, F.col("at").alias("start"), F.lead("at").over(Window.partitionBy(key).orderBy("at")).alias("end"),
        F.last("piece", ignorenulls=True).over(upto).alias("piece"), F.last("run", ignorenulls=True).over(upto).alias("run"),
    )
    return swept.where("piece.open").select(key, F.col("piece.v").alias("piece_id"), "start", "end", F.when(F.col("run.open"), F.col("run.v")).alias(value))


def style_at(points: DataFrame, runs: DataFrame, key: str, value: str) -> DataFrame:
    """points (key, position) with the style at that position: runs (key, ord, count, value) follow each other in order.

    A position beyond the last run has the last run's style; before the first there is none. An as-of step over the
    union of both.
    """
    before = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.where("count > 0").select(key, F.coalesce(F.sum("count").over(before), F.lit(0)).cast("long").alias("position"), F.struct(F.col(value).alias("v")).alias("style"))
    asked = points.select(key, F.col("position").cast("long").alias("position"), F.lit(None).cast(starts.schema["style"].dataType).alias("style"), F.lit(True).alias("asked"))
    upto = Window.partitionBy(key).orderBy("position", F.col("asked").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = starts.withColumn("asked", F.lit(None).cast("boolean")).unionByName(asked)
    return both.withColumn("found", F.last("style", ignorenulls=True).over(upto)).where("asked").select(key, "position", F.col("found.v").alias(value))


def inherit(styles: DataFrame, fields: list[str]) -> DataFrame:
    """styles (style_id, fields) with each missing field from the nearest style up the chain of based_on.

    Chains are followed by doubling: each round joins every style with where it stands, so n rounds follow 2^n steps, and
    as many are done as the longest chain of so many styles can need. In one that comes back to itself all fields are
    found on the way.
    """
    now = cut(styles.select("style_id", "based_on", *fields))
    for _ in range(math.ceil(math.log2(max(1, now.count()))) + 1):
        up = now.select(F.col("style_id").alias("_id"), F.col("based_on").alias("_next"), *[F.col(f).alias(f"_{f}") for f in fields])
        step = now.join(up, F.col("based_on") == F.col("_id"), "left")
        now = cut(step.select("style_id", F.when(F.col("_next") != F.col("style_id"), F.col("_next")).alias("based_on"), *[F.coalesce(f, f"_{f}").alias(f) for f in fields]))
        if not now.where("based_on IS NOT NULL").take(1):
            break
    return now.drop("based_on")


def newest_first(edits: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """entries (edit_id, key, offset) of the newest edit that has each key; edits (edit_id, depth), 0 the newest."""
    ranked = entries.join(edits, "edit_id")
    return ranked.groupBy(key).agg(F.min_by("offset", "depth").alias("offset"), F.min("depth").alias("depth"))


def interval_value(points: DataFrame, intervals: DataFrame, key: str, value: str, otherwise: float = 0.0) -> DataFrame:
    """points (key, position) with the value of the interval (key, start, end, value) that holds it, end exclusive; else ``otherwise``.

    Intervals do not overlap. An as-of step over the union of both finds the last that begins at or before the position.
    """
    known = intervals.where("end > start").select(key, F.col("start").cast("long").alias("position"), F.struct(F.col("end"), F.col(value).alias("v")).alias("i"))
    asked = points.select(key, F.col("position").cast("long").alias("position"), F.lit(None).cast(known.schema["i"].dataType).alias("i"), F.lit(True).alias("asked"))
    upto = Window.partitionBy(key).orderBy("position", F.col("asked").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = known.withColumn("asked", F.lit(None).cast("boolean")).unionByName(asked).withColumn("near", F.last("i", ignorenulls=True).over(upto)).where("asked")
    return both.select(key, "position", F.coalesce(F.when(F.col("position") < F.col("near.end"), F.col("near.v")), F.lit(otherwise)).alias(value))


def substreams(pieces: DataFrame, key: str, offset: str, size: Column) -> DataFrame:
    """pieces with end and bytes: each goes up to where the next begins, the last up to the whole size of its stream.

    Of pieces at one place all but the last are empty; a piece that begins behind the end has no bytes.
    """
    end = F.coalesce(F.lead(offset).over(Window.partitionBy(key).orderBy(offset)), size)
    return pieces.withColumn("end", end.cast("long")).withColumn("bytes", F.greatest(F.lit(0).cast("long"), F.col("end") - F.col(offset)))
