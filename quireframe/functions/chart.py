"""Small rules of charts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How series types are drawn, and the suffixes of kinds of regions.
#: How series types are drawn; any other type is a line.
DRAWN_AS = {"bar": "bar", "column": "bar", "line": "line", "area": "area", "surface": "area", "pie": "pie", "ofPie": "pie", "doughnut": "pie", "radar": "radar", "scatter": "scatter", "bubble": "scatter", "stock": "line"}

REGION_KINDS = "特别行政区|壮族自治区|回族自治区|维吾尔自治区|自治区|省|市"


def nice_max(x: Column) -> Column:
    """The axis end for a largest value: 2, 5 or 10 times a power of ten; 1 for none, zero and less."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(x)))
    return F.when(x > 0, F.when(x / power <= 2, 2).when(x / power <= 5, 5).otherwise(10) * power).otherwise(1.0)


def pie_start(angle: Column) -> Column:
    """Degrees from twelve o'clock, clockwise, as degrees from three o'clock, counter-clockwise: 0 to below 360."""
    return F.pmod(90 - angle, F.lit(360))


def bubble_size(x: Column) -> Column:
    return F.greatest(F.lit(6.0), F.least(F.lit(42.0), F.sqrt(F.abs(x)) * 6))


def bar_width(gap: Column, series: Column, overlap: Column) -> Column:
    """Bar width in px by gap width and overlap in percent, 6 to 46; null without a gap."""
    ratio = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(overlap, F.lit(0)) / 100))
    many = F.greatest(F.lit(1), series)
    shown = F.greatest(F.lit(1.0), many - ratio * (many - 1))
    return F.greatest(F.lit(6), F.least(F.lit(46), F.floor(72 / (shown + gap / 100) + 0.5))).cast("int")


def rose_radius(inner: Column, outer: Column) -> Column:
    """struct<inner, outer> of a pair of radii in percent, fitted to 58; unchanged where outer is not positive."""
    fitted = F.least(F.lit(58.0), outer)
    return F.when(outer > 0, F.struct(F.greatest(F.lit(0.0), F.least(fitted - 4, F.floor(inner / outer * fitted + 0.5))).alias("inner"), fitted.alias("outer"))).otherwise(F.struct(inner.cast("double").alias("inner"), outer.cast("double").alias("outer")))


def drawn_as(kind: Column) -> Column:
    known = F.map_from_arrays(F.array(*map(F.lit, DRAWN_AS)), F.array(*map(F.lit, DRAWN_AS.values())))
    return F.coalesce(F.try_element_at(known, kind), F.lit("line"))


def region_name(name: Column) -> Column:
    """A region's name without the suffix of its kind."""
    return F.trim(F.regexp_replace(name, f"(?:{REGION_KINDS})$", ""))


def shows_labels(deleted: Column, flags: Column, otherwise: Column) -> Column:
    """Are data labels shown: not if deleted; by the flags (array<boolean>) that are set; else as the chart says."""
    explicit = F.filter(flags, lambda f: f.isNotNull())
    return F.when(F.coalesce(deleted, F.lit(False)), False).when(F.size(explicit) > 0, F.exists(explicit, lambda f: f)).otherwise(F.coalesce(otherwise, F.lit(False)))


def label_text(parts: Column, separator: Column) -> Column:
    """The parts (array<string>) that are there, joined by a separator and trimmed."""
    there = F.filter(parts, lambda p: F.coalesce(p, F.lit("")) != "")
    joined = F.aggregate(there, F.lit(None).cast("string"), lambda t, p: F.when(t.isNull(), p).otherwise(F.concat(t, separator, p)))
    return F.trim(F.coalesce(joined, F.lit("")))
