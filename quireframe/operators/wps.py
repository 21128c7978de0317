"""Charts that are kept as JSON properties: read as VARIANT, without a schema, into series and points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["type", "dschart_type", "demoData", "style", "extStyle", "dschart"]


def json_value(raw: Column) -> Column:
    """A property's text as VARIANT; one whose quotes were written as a broken entity is mended; null if it is no JSON."""
    return F.coalesce(F.try_parse_json(raw), F.try_parse_json(F.regexp_replace(raw, "[?\\x{FFFD}]quot;", '"')))


def _array(value: Column, path: str = "$") -> Column:
    """array<variant> at a path; null if there is none."""
    return F.try_variant_get(value, path, "array<variant>")


def _text(value: Column, path: str = "$") -> Column:
    return F.try_variant_get(value, path, "string")


def _number(value: Column) -> Column:
    """The number of a cell; text is read as one, what is none is 0."""
    return F.coalesce(F.try_variant_get(value, "$", "double"), F.trim(_text(value)).try_cast("double"), F.lit(0.0))


def models(properties: DataFrame, key: str) -> DataFrame:
    """(key, kind, area, table, tiers) of the charts that properties (key, name, value) describe.

    Data of demoData are a pie, a doughnut (a pie with a hole, two radii or as a rose) or lines, which are areas where
    the style fills them; those of dschart are a map if dschart_type says so. table (array<variant>) has the heading row
    first. A chart without data has no row.
    """
    found = properties.where(F.col("name").isin(*KEYS)).groupBy(key).agg(*[F.max(F.when(F.col("name") == k, F.col("value"))).alias(f"_{k}") for k in KEYS])
    read = found.select(key, F.lower(F.coalesce("_type", F.lit(""))).alias("_kind"), F.lower(F.coalesce("_dschart_type", F.lit(""))).alias("_map"), *[json_value(F.col(f"_{k}")).alias(k) for k in KEYS[2:]])
    demo = _array(F.col("demoData"), "$.data")
    maps = _array(F.col("dschart"), "$.json.data[0]")
    rose = F.coalesce(_text(F.col("extStyle"), "$.series[0].roseType"), _text(F.col("style"), "$.series[0].roseType")).isin("radius", "area")
    two = _text(F.col("style"), "$.radius[0]").isNotNull() & _text(F.col("style"), "$.radius[1]").isNotNull()
    hole = F.lower(F.coalesce(_text(F.col("style"), "$.pieType"), F.lit(""))).contains("doughnut") | F.coalesce(rose, F.lit(False)) | F.coalesce(two, F.lit(False))
    pie = F.col("_kind").contains("pie")
    area = F.coalesce(F.try_variant_get("style", "$.areaStyle.show", "boolean"), F.lit(False))
    is_demo = F.col("demoData").isNotNull()
    kind = F.when(is_demo, F.when(pie & hole, "doughnut").when(pie, "pie").otherwise("line")).when(F.col("_map") == "map", "map")
    table = F.when(is_demo, demo).otherwise(maps)
    good = F.when(is_demo, _array(F.try_element_at(demo, F.lit(1))).isNotNull()).otherwise(F.size(maps) >= 2)
    return read.select(key, kind.alias("kind"), (area & ~pie & is_demo).alias("area"), table.alias("table")).where(F.col("kind").isNotNull() & good)


def points(charts: DataFrame, key: str) -> DataFrame:
    """(key, kind, series, series_name, type, idx, category, value, tier) of models(): a row for each number.

    Rows that are no lists are passed over. Categories are the rows' first texts, those that are not empty, so that a
    number stands at its row's place among all and a category at its place among those. Without headings beside the
    first there is one series. A map has one series, and its third column, if there is one, is the point's tier.
    """
    rows = F.filter(F.transform("table", lambda r: _array(r)), lambda r: r.isNotNull())
    heads = F.transform(_array(F.try_element_at("table", F.lit(1))), lambda h: F.trim(_text(h)))
    body = F.when(F.size(F.filter(F.slice("table", F.lit(1), F.lit(1)), lambda r: _array(r).isNotNull())) == 1, F.slice("_rows", F.lit(2), F.greatest(F.size("_rows") - 1, F.lit(0)))).otherwise(F.col("_rows"))
    read = charts.withColumns({"_rows": rows, "_heads": F.coalesce(heads, F.array().cast("array<string>"))}).withColumn("_body", body)
    labels = F.filter(F.transform("_body", lambda r: F.trim(F.coalesce(_text(F.try_element_at(r, F.lit(1))), F.lit("")))), lambda c: c != "")
    many = F.when(F.col("kind") == "map", 1).otherwise(F.greatest(F.lit(1), F.size("_heads") - 1))
    series = F.explode(F.sequence(F.lit(0), many - 1))
    each = read.withColumns({"_labels": labels, "series": series})
    name = F.coalesce(F.try_element_at("_heads", F.col("series") + 2), F.concat(F.lit("Series "), F.col("series") + 1))
    kind = F.when(F.col("kind").isin("pie", "doughnut"), "pie").when(F.col("kind") == "map", "map").when(F.col("area"), "area").otherwise("line")
    tier = F.transform("_body", lambda r: F.when((F.col("kind") == "map") & (F.size("_heads") > 2), F.trim(F.coalesce(_text(F.try_element_at(r, F.lit(3))), F.lit("")))))
    values = F.transform("_body", lambda r: _number(F.try_element_at(r, F.col("series") + 2)))
    rows_ = each.select(key, "kind", "series", name.alias("series_name"), kind.alias("type"), "_labels", F.posexplode(F.arrays_zip(values.alias("value"), tier.alias("tier"))).alias("idx", "p"))
    return rows_.select(key, "kind", "series", "series_name", "type", "idx", F.try_element_at("_labels", F.col("idx") + 1).alias("category"), "p.value", "p.tier")
