"""Queries of chart data and workload weights over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireframe.functions import text as T
from quireframe.operators import charts, wps
from quireframe.plans.registry import query, table


def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(flag, status, month, quantity): a chart of shipped quantities by month, a series for each flag and status."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.month("l_shipdate").alias("month")).agg(F.sum("l_quantity").alias("quantity"))


SHIPPED_SQL = "q AS (SELECT l_returnflag AS flag, l_linestatus AS status, CAST(month(l_shipdate) AS INT) AS month, sum(l_quantity) AS quantity FROM lineitem GROUP BY ALL)"


@query(
    "chart_matrix",
    """WITH s AS (SELECT user_id AS series, event_id % 40 AS idx, arg_max(value, event_id) AS value FROM events GROUP BY ALL), e AS (SELECT series, max(idx) AS last FROM s GROUP BY series)
SELECT e.series, CAST(i AS INT) AS idx, value FROM e, unnest(range(0, last + 1)) AS t(i) LEFT JOIN s ON s.series = e.series AND s.idx = i""",
)
def chart_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-CHARTMATRIX, SO-CACHEPT: dense series with gaps."""
    points = table(spark, sf_dir, "events").select(F.col("user_id").alias("series"), (F.col("event_id") % 40).alias("idx"), "value", F.col("event_id").alias("ord"))
    return charts.matrix(points, ["series"])


@query(
    "chart_references",
    """WITH s AS (SELECT s_nationkey AS sheet, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS INT) AS row_index, s_name, s_acctbal FROM supplier),
c AS (SELECT sheet, row_index, CAST(1 AS INT) AS column_index, s_name AS value FROM s UNION ALL SELECT sheet, row_index, CAST(2 AS INT), CAST(s_acctbal AS VARCHAR) FROM s),
f AS (SELECT c_custkey, c_custkey % 3 AS k, CASE c_custkey % 3 WHEN 0 THEN n_nationkey ELSE c_nationkey END AS target,
  CASE c_custkey % 3 WHEN 0 THEN 1 + c_custkey % 5 WHEN 1 THEN 1 ELSE 2 END AS a, CASE c_custkey % 3 WHEN 0 THEN 3 + c_custkey % 7 WHEN 1 THEN 1 ELSE 2 END AS z,
  CASE c_custkey % 3 WHEN 2 THEN 2 ELSE 1 END AS l, CASE c_custkey % 3 WHEN 1 THEN 1 ELSE 2 END AS r FROM customer JOIN nation ON n_nationkey = c_custkey % 25)
SELECT c_custkey, CAST(target AS VARCHAR) AS target, CAST((i - a) * (r - l + 1) + k2 - l AS BIGINT) AS ord, CAST(i AS INT) AS row_index, CAST(k2 AS INT) AS column_index, value
FROM f, unnest(range(a, z + 1)) AS t(i), unnest(range(l, r + 1)) AS u(k2) LEFT JOIN c ON c.sheet = target AND c.row_index = i AND c.column_index = k2""",
)
def chart_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-CHARTREF: the cells that formulas refer to, on a sheet they name, their own, and one that is not there."""
    from pyspark.sql.window import Window

    placed = table(spark, sf_dir, "supplier").withColumn("row_index", F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")))
    pairs = F.explode(F.array(F.struct(F.lit(1).alias("column_index"), F.col("s_name").alias("value")), F.struct(F.lit(2).alias("column_index"), F.col("s_acctbal").cast("string").alias("value"))))
    cells = placed.select(F.col("s_nationkey").cast("string").alias("sheet_id"), "row_index", pairs.alias("c")).select("sheet_id", "row_index", "c.column_index", "c.value")
    nations = table(spark, sf_dir, "nation")
    sheets = nations.select(F.col("n_nationkey").cast("string").alias("sheet_id"), F.concat("n_name", F.lit("'s")).alias("name"))
    key = F.col("c_custkey")
    named = F.concat(F.lit("='"), F.col("n_name"), F.lit("''s'!$A$"), (1 + key % 5).cast("string"), F.lit(":$B$"), (3 + key % 7).cast("string"))
    formula = F.when(key % 3 == 0, named).when(key % 3 == 1, "=A1").otherwise("=Missing!B2")
    asked = table(spark, sf_dir, "customer").join(nations, F.col("n_nationkey") == key % 25).select("c_custkey", F.col("c_nationkey").cast("string").alias("sheet_id"), formula.alias("formula"))
    return charts.referenced_cells(asked, sheets, cells).drop("sheet_id", "formula")


@query("percent_stack", f"WITH {SHIPPED_SQL} SELECT flag, status, month, quantity, round(quantity / sum(quantity) OVER (PARTITION BY month), 9) AS share FROM q")
def percent_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QR-CHART percent stacking: shares of a month's quantity."""
    stacked = charts.percent_stack(shipped(spark, sf_dir), [], "month", "quantity")
    return stacked.withColumn("share", F.round("share", 9))


@query(
    "of_pie",
    f"""WITH {SHIPPED_SQL}, n AS (SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY flag, status) AS n FROM q WINDOW w AS (PARTITION BY flag, status ORDER BY month)),
k AS (SELECT *, pos > n - least(n - 1, greatest(1, ceil(n / 3.0))) AS tail FROM n)
SELECT flag, status, CASE WHEN tail THEN 'second' ELSE 'main' END AS part, CAST(pos AS INT) AS pos, CAST(month AS VARCHAR) AS category, quantity AS value FROM k
UNION ALL SELECT flag, status, 'main', CAST(min(pos) AS INT), 'other', sum(quantity) FROM k WHERE tail GROUP BY flag, status""",
)
def of_pie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-OFPIE: the last months of each pie in a second plot."""
    points = shipped(spark, sf_dir).withColumn("label", F.col("month").cast("string"))
    return charts.of_pie(points, ["flag", "status"], F.col("month"), "label", "quantity")


@query(
    "radar_axes",
    """WITH m AS (SELECT c_mktsegment AS category, c_nationkey AS chart, greatest(0.0::DOUBLE, max(c_acctbal)) AS largest FROM customer GROUP BY ALL)
SELECT chart, category, largest, CASE WHEN largest <= 0 THEN 1.0::DOUBLE ELSE (CASE WHEN largest / 10.0::DOUBLE ** floor(log10(largest)) <= 2 THEN 2 WHEN largest / 10.0::DOUBLE ** floor(log10(largest)) <= 5 THEN 5 ELSE 10 END) * 10.0::DOUBLE ** floor(log10(largest)) END AS axis_max FROM m""",
)
def radar_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-RADARMAX: a round axis end for each segment."""
    points = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("chart"), F.col("c_mktsegment").alias("category"), F.col("c_acctbal").alias("value"))
    return charts.radar_axes(points, ["chart"], "category", "value")


@query(
    "map_tiers",
    """WITH f AS (SELECT c_nationkey AS chart, c_mktsegment AS tier, min(c_custkey) AS first FROM customer GROUP BY ALL) SELECT chart, tier, first, CAST(row_number() OVER (PARTITION BY chart ORDER BY first, tier) AS INT) AS number FROM f""",
)
def map_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-TIERS: tiers in the order in which they come."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("chart"), F.col("c_mktsegment").alias("tier"), "c_custkey")
    return charts.tiers(rows, ["chart"], "tier", "c_custkey")


@query(
    "slide_weights",
    """WITH e AS (SELECT conv_id AS deck, turn, CASE role WHEN 'system' THEN 'chart' WHEN 'user' THEN 'image' ELSE 'table' END AS type, length(text) % 6 AS n FROM conversations),
w AS (SELECT deck, turn, count(*) AS elements, CAST(sum(CASE type WHEN 'image' THEN 20 WHEN 'chart' THEN 30 ELSE 4 * greatest(1, n) END) AS BIGINT) AS weight FROM e GROUP BY ALL),
d AS (SELECT deck, count(*) AS slides, CAST(sum(weight) AS BIGINT) AS weight, max(elements) AS most FROM w GROUP BY deck)
SELECT deck, slides, weight, CASE WHEN slides >= 80 OR weight >= 3000 OR most >= 300 THEN 'lazy' ELSE 'materialized' END AS slide_mode, CASE WHEN slides > 50 THEN 'virtual' ELSE 'normal' END AS thumbnail_mode FROM d""",
)
def slide_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-SLIDEWEIGHT, AG-SLIDEPROFILE: conversations as decks, turns as slides."""
    kind = F.when(F.col("role") == "system", "chart").when(F.col("role") == "user", "image").otherwise("table")
    elements = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("deck"), "turn", kind.alias("type"), (F.char_length("text") % 6).alias("row_count"))
    slides = charts.slide_weights(elements, ["deck", "turn"])
    decks = slides.groupBy("deck").agg(F.count("*").alias("slides"), F.sum("weight").alias("weight"), F.max("elements").alias("most"))
    slide_mode, thumbnail_mode = charts.deck_profile(F.col("slides"), F.col("weight"), F.col("most"))
    return decks.select("deck", "slides", "weight", slide_mode.alias("slide_mode"), thumbnail_mode.alias("thumbnail_mode"))


@query(
    "sheet_profiles",
    """WITH s AS (SELECT l_suppkey, count(*) AS rows, CAST(max(l_linenumber) * (5 + l_suppkey % 12) AS INT) AS columns FROM lineitem GROUP BY l_suppkey)
SELECT *, CASE WHEN columns >= 100 THEN 'two-axis-window' WHEN rows >= 500 OR rows * columns >= 20000 THEN 'row-window' ELSE 'table' END AS mode FROM s""",
)
def sheet_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-SHEETPROFILE: how the suppliers' sheets are to be shown."""
    columns = (F.max("l_linenumber") * (5 + F.col("l_suppkey") % 12)).cast("int").alias("columns")
    sizes = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("rows"), columns)
    return sizes.withColumn("mode", charts.sheet_profile(F.col("rows"), F.col("columns")))


@query(
    "table_columns",
    r"""WITH w AS (SELECT conv_id AS grid, role AS col, greatest(8.0::DOUBLE, max(CAST(length(text) AS DOUBLE))) AS weight FROM conversations GROUP BY ALL)
SELECT grid, col, weight, round(greatest(64.0::DOUBLE, weight / sum(weight) OVER (PARTITION BY grid) * 554), 6) AS px FROM w""",
)
def table_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-TABLE-COLS: column widths by the widest text, Han characters counting two."""
    t = F.col("text")
    cells = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("grid"), F.col("role").alias("col"), (F.char_length(t) + T.matches(t, f"[{T.HAN}]")).cast("double").alias("width"))
    return charts.column_shares(cells, ["grid"], "col", F.col("width")).withColumn("px", F.round("px", 6))


# A chart for each customer: kind by key, two series over orders; every fourth chart has no categories, some points no value.
KINDS_SQL = """k AS (SELECT o_custkey AS chart_id, ['pie', 'radar', 'line', 'scatter', 'doughnut'][CAST(o_custkey % 5 AS INT) + 1] AS kind, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS idx, o_orderkey, o_totalprice FROM orders),
p AS (SELECT chart_id, kind, s AS series, kind AS type, idx, CASE WHEN chart_id % 4 > 0 THEN CASE WHEN s = 1 AND kind = 'scatter' THEN CAST(o_orderkey AS VARCHAR) ELSE 'o' || o_orderkey END END AS category, CASE WHEN (o_orderkey + s) % 6 > 0 THEN o_totalprice * (s + 1) END AS value, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey / 2.0 END::DOUBLE AS x FROM k, (VALUES (0), (1)) AS t(s))"""


@query(
    "plotted_points",
    f"""WITH {KINDS_SQL}, n AS (SELECT *, max(idx) OVER (PARTITION BY chart_id) + 1 AS n FROM p)
SELECT chart_id, CASE WHEN kind IN ('pie', 'doughnut') THEN 'pie' WHEN kind = 'radar' AND chart_id % 4 > 0 THEN 'radar' ELSE 'cartesian' END AS drawn, CAST(series AS INT) AS series,
  CAST(CASE WHEN kind = 'radar' AND chart_id % 4 > 0 AND n > 2 AND idx > 0 THEN n - idx ELSE idx END AS INT) AS place, coalesce(category, CAST(idx + 1 AS VARCHAR)) AS name,
  CASE WHEN kind = 'scatter' THEN coalesce(x, TRY_CAST(category AS DOUBLE), idx + 1) END AS x, CASE WHEN kind IN ('pie', 'doughnut') THEN coalesce(value, 0) ELSE value END AS y
FROM n WHERE kind NOT IN ('pie', 'doughnut') OR series = 0""",
)
def plotted_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QR-CHART, SO-RADAR, FN-CATEGORIES: what charts of each type draw, radar axes in their order, default categories."""
    from pyspark.sql.window import Window

    key, order = F.col("o_custkey"), F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        key.alias("chart_id"), F.element_at(F.array(*map(F.lit, ("pie", "radar", "line", "scatter", "doughnut"))), (key % 5 + 1).cast("int")).alias("kind"),
        (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("idx"), order.alias("id"), "o_totalprice",
    ).withColumn("series", F.explode(F.array(F.lit(0), F.lit(1))))
    name = F.when((F.col("series") == 1) & (F.col("kind") == "scatter"), F.col("id").cast("string")).otherwise(F.concat(F.lit("o"), F.col("id")))
    points = rows.select(
        "chart_id", "kind", "series", F.col("kind").alias("type"), "idx", F.when(F.col("chart_id") % 4 > 0, name).alias("category"),
        F.when((F.col("id") + F.col("series")) % 6 > 0, F.col("o_totalprice") * (F.col("series") + 1)).alias("value"), F.when(F.col("id") % 3 == 0, F.col("id") / 2.0).alias("x"),
    )
    return charts.plotted(points, ["chart_id"])


@query(
    "wps_points",
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, o_custkey % 6 AS k FROM orders),
r AS (SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'o' || o_orderkey END AS c FROM n), l AS (SELECT o_custkey, list(c ORDER BY i) FILTER (c <> '') AS labels FROM r GROUP BY o_custkey),
s AS (SELECT r.*, labels, s FROM r JOIN l USING (o_custkey), (VALUES (0), (1)) AS t(s) WHERE k < 5 AND (k < 4 OR s = 0))
SELECT o_custkey AS chart_id, CASE k WHEN 0 THEN 'pie' WHEN 1 THEN 'doughnut' WHEN 4 THEN 'map' ELSE 'line' END AS kind, CAST(s AS INT) AS series, CASE WHEN s = 0 THEN 'Price' ELSE 'Key' END AS series_name,
  CASE k WHEN 0 THEN 'pie' WHEN 1 THEN 'pie' WHEN 3 THEN 'area' WHEN 4 THEN 'map' ELSE 'line' END AS type, CAST(i AS INT) AS idx, labels[i + 1] AS category,
  CASE WHEN s = 1 THEN o_orderkey WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_totalprice END::DOUBLE AS value, CASE WHEN k = 4 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END END AS tier FROM s""",
)
def wps_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-CHART-WPS, FN-JSONPROP, FN-JSONTABLE: series and points of charts that are kept as JSON properties."""
    key, k = F.col("o_custkey"), F.col("o_custkey") % 6
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    order = F.col("o_orderkey")
    price = F.when(order % 5 == 0, '"n/a"').when(order % 3 == 0, quoted(F.concat(F.lit(" "), F.col("o_totalprice").cast("string")))).otherwise(F.col("o_totalprice").cast("string"))
    third = F.when(k == 4, quoted(F.when(order % 2 == 0, " even").otherwise("odd"))).otherwise(order.cast("string"))
    row = F.concat(F.lit("["), F.when(order % 7 == 0, "null").otherwise(quoted(F.concat(F.lit(" o"), order))), F.lit(", "), price, F.lit(", "), third, F.lit("]"))
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.struct("o_orderkey", row.alias("row")).alias("r")).groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["row"]), ", ").alias("rows"))
    data = F.concat(F.lit('[["", "Price", " Key"], 5, '), F.col("rows"), F.lit("]"))
    demo = F.concat(F.lit('{"data": '), data, F.lit("}"))
    texts = {
        "type": F.when(k <= 1, "wpsPie").otherwise("wpsLine"), "dschart_type": F.when(k == 4, "MAP").when(k == 5, "tree"),
        "demoData": F.when(k == 2, F.replace(demo, F.lit('"'), F.lit("?quot;"))).when(k < 4, demo), "dschart": F.when(k >= 4, F.concat(F.lit('{"json": {"data": ['), data, F.lit("]}}"))),
        "style": F.when(k == 1, '{"radius": ["40%", "70%"]}').when(k == 3, '{"areaStyle": {"show": true}}').when(k == 2, "no JSON"),
    }
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c.alias("value")) for n, c in texts.items()])).alias("p")
    properties = rows.select(key.alias("chart_id"), pairs).select("chart_id", "p.name", "p.value").where("value IS NOT NULL")
    return wps.points(wps.models(properties, "chart_id"), "chart_id")
