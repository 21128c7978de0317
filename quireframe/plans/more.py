"""Queries of decks, layout folds and the smaller rules over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quireframe.functions import chart, numbers, units
from quireframe.functions import text as T
from quireframe.operators import axis, charts, documents, grid, layout, lookup, slides
from quireframe.plans.grid import PARTS_SQL, part_rows
from quireframe.plans.registry import query, table


@query(
    "slide_compose",
    """WITH s AS (SELECT conv_id * 100 + turn AS slide_id, conv_id % 7 AS layout_id, conv_id % 3 AS master_id, length(text) AS n FROM conversations),
m AS (SELECT n_nationkey % 3 AS master_id, n_nationkey AS ord, 'm' || n_name AS name FROM nation), l AS (SELECT n_nationkey % 7 AS layout_id, n_nationkey AS ord, 'l' || n_name AS name FROM nation),
u AS (SELECT slide_id, 0 AS rank, 'master' AS source, ord, name FROM s JOIN m USING (master_id) UNION ALL SELECT slide_id, 1, 'layout', ord, name FROM s JOIN l USING (layout_id) UNION ALL SELECT slide_id, 2, 'slide', 0, 'text ' || n FROM s)
SELECT slide_id, CAST(row_number() OVER (PARTITION BY slide_id ORDER BY rank, ord, name) - 1 AS INT) AS z_index, source, name FROM u""",
)
def slide_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QR-SLIDE, QR-SLIDES, JN-MASTER, SO-DOCORDER: turns as slides, nations as elements of masters and layouts."""
    nation = table(spark, sf_dir, "nation")
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("slide_id"), (F.col("conv_id") % 7).alias("layout_id"), (F.col("conv_id") % 3).alias("master_id"), "text")
    masters = nation.select((F.col("n_nationkey") % 3).alias("master_id"), F.col("n_nationkey").alias("ord"), F.concat(F.lit("m"), "n_name").alias("name"))
    layouts = nation.select((F.col("n_nationkey") % 7).alias("layout_id"), F.col("n_nationkey").alias("ord"), F.concat(F.lit("l"), "n_name").alias("name"))
    own = turns.select("slide_id", F.lit(0).alias("ord"), F.concat(F.lit("text "), F.char_length("text")).alias("name"))
    return slides.compose(turns, masters, layouts, own)


@query(
    "slide_notes",
    """WITH n AS (SELECT user_id % 300 AS slide, event_id, event_type FROM events)
SELECT c_custkey, coalesce((SELECT string_agg(event_type, chr(10) ORDER BY event_id) FROM n WHERE slide = c_custkey), '') AS notes FROM customer""",
)
def slide_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-NOTES: customers as slides, events as notes."""
    notes = table(spark, sf_dir, "events").select((F.col("user_id") % 300).alias("c_custkey"), F.col("event_id").alias("ord"), F.col("event_type").alias("text"))
    return slides.with_notes(table(spark, sf_dir, "customer").select("c_custkey"), notes, "c_custkey")


@query(
    "group_transform",
    """SELECT p_partkey, p_size + (p_partkey % 50 - 5) * (100.0::DOUBLE / 25) AS x, 2.0::DOUBLE * p_size + (p_size - 0.0::DOUBLE) * 1.0 AS y, p_size * (100.0::DOUBLE / 25) AS width, p_size * 1.0::DOUBLE AS height FROM part""",
)
def group_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-FLATTEN-GROUP: elements of a group in the coordinates outside it."""
    size = F.col("p_size").cast("double")
    element = F.struct((F.col("p_partkey") % 50).cast("double").alias("x"), size.alias("y"), size.alias("width"), size.alias("height"))
    fixed = {"width": 100.0, "height": 70.0, "child_x": 5.0, "child_y": 0.0, "child_width": 25.0, "child_height": 0.0}
    group = F.struct(size.alias("x"), (2 * size).alias("y"), *[F.lit(v).alias(k) for k, v in fixed.items()])
    parts = table(spark, sf_dir, "part").select("p_partkey", element.alias("e"), group.alias("g"))
    return parts.select("p_partkey", *[c.alias(k) for k, c in slides.in_group("e", "g").items()])


@query(
    "table_bands",
    """WITH c AS (SELECT o_orderkey, CAST(o_orderkey % 6 AS INT) AS r, CAST(o_custkey % 5 AS INT) AS k, o_orderkey % 4 < 2 AS head, o_orderkey % 3 = 0 AS last FROM orders)
SELECT o_orderkey, CASE WHEN last AND k = 4 THEN 'last column' WHEN head AND r = 0 THEN 'first row' WHEN NOT (head AND r = 0) THEN CASE WHEN (r - CAST(head AS INT)) % 2 = 0 THEN 'band 1' ELSE coalesce(NULL, 'whole') END ELSE 'whole' END AS style FROM c""",
)
def table_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QR-TABLESTYLE: the setting of a table's cell by its place."""
    no, none = F.lit(False), F.lit(None).cast("string")
    flags = {"first_row": F.col("o_orderkey") % 4 < 2, "last_row": no, "first_column": no, "last_column": F.col("o_orderkey") % 3 == 0, "band_rows": F.lit(True), "band_columns": no}
    names = {"whole": "whole", "band1_row": "band 1", "first_row": "first row", "last_column": "last column"}
    style = {k: F.lit(names[k]) if k in names else none for k in ("whole", "band1_row", "band2_row", "band1_column", "band2_column", "first_row", "last_row", "first_column", "last_column")}
    place = slides.table_style(F.col("o_orderkey") % 6, F.col("o_custkey") % 5, F.lit(6), F.lit(5), flags, style)
    return table(spark, sf_dir, "orders").select("o_orderkey", place.alias("style"))


@query(
    "anchor_rects",
    f"""WITH {PARTS_SQL}, a AS (SELECT DISTINCT CAST(l_partkey // 1000 AS VARCHAR) AS sheet_id, CAST(l_partkey % 1000 + 1 AS INT) AS idx, CAST(l_linenumber AS DOUBLE) AS off FROM lineitem WHERE CAST(l_partkey // 1000 AS VARCHAR) IN (SELECT sheet_id FROM o)),
n AS (SELECT a.*, (SELECT max(s.idx) FROM s WHERE s.sheet_id = a.sheet_id AND s.idx < a.idx) AS near FROM a)
SELECT n.sheet_id, n.idx, off, coalesce(s.start + s.size + (n.idx - near - 1) * 20, (n.idx - 1) * 20.0) + off AS y FROM n LEFT JOIN s ON s.sheet_id = n.sheet_id AND s.idx = n.near""",
)
def anchor_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QR-ANCHOR, SO-OVERRIDE: the px of anchors in rows of their own heights."""
    sized = axis.offsets(part_rows(spark, sf_dir))
    lines = table(spark, sf_dir, "lineitem")
    anchors = lines.select(F.floor(F.col("l_partkey") / 1000).cast("string").alias("sheet_id"), (F.col("l_partkey") % 1000 + 1).cast("int").alias("idx"), F.col("l_linenumber").cast("double").alias("off")).distinct()
    points = anchors.join(sized.select("sheet_id").distinct(), "sheet_id", "left_semi").withColumns({"axis": F.lit("row"), "default_size": F.lit(20.0)})
    return axis.offset_at(sized, points).select("sheet_id", "idx", "off", (F.col("start") + F.col("off")).alias("y"))


IMAGES_SQL = "i AS (SELECT user_id, event_id, CAST(event_id % 13 * 40 AS DOUBLE) AS w, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)"


@query(
    "image_rows",
    f"""WITH RECURSIVE {IMAGES_SQL}, p AS (SELECT user_id, n, event_id, w, lead(w) OVER (PARTITION BY user_id ORDER BY n) AS w2 FROM i),
q AS (SELECT *, coalesce(w > 0 AND w2 > 0 AND w <= 300 AND w2 <= 300 AND w + w2 + 6 <= 554, FALSE) AS pair FROM p),
f(user_id, n, row_, second_) AS (SELECT user_id, n, CAST(0 AS INT), FALSE FROM q WHERE n = 1
  UNION ALL SELECT q.user_id, q.n, CASE WHEN NOT f.second_ AND b.pair THEN f.row_ ELSE f.row_ + 1 END, NOT f.second_ AND b.pair FROM f JOIN q ON q.user_id = f.user_id AND q.n = f.n + 1 JOIN q b ON b.user_id = f.user_id AND b.n = f.n)
SELECT f.user_id, event_id, row_ AS image_row FROM f JOIN q USING (user_id, n)""",
)
def image_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-IMAGEROWS: images of a user's document, two small ones beside each other."""
    images = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", (F.col("event_id") % 13 * 40).cast("double").alias("w")))).alias("i"))
    placed = images.withColumn("r", layout.image_rows(F.col("i.w"))).select("user_id", F.explode(F.arrays_zip("i", "r")).alias("z"))
    return placed.select("user_id", "z.i.event_id", F.col("z.r").alias("image_row"))


@query(
    "measured_pages",
    """WITH RECURSIVE h AS (SELECT user_id, event_id, CAST(event_id % 17 * 10 AS DOUBLE) AS h, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, sum(event_id % 17 * 10) OVER (PARTITION BY user_id) AS total FROM events),
f(user_id, n, used, page) AS (SELECT user_id, n, h, CAST(0 AS INT) FROM h WHERE n = 1
  UNION ALL SELECT h.user_id, h.n, CASE WHEN f.used > 0 AND f.used + h.h > 901 THEN h.h ELSE f.used + h.h END, CASE WHEN f.used > 0 AND f.used + h.h > 901 THEN f.page + 1 ELSE f.page END FROM f JOIN h ON h.user_id = f.user_id AND h.n = f.n + 1)
SELECT f.user_id, event_id, CASE WHEN total <= 1020 THEN 0 ELSE page END AS page FROM f JOIN h USING (user_id, n)""",
)
def measured_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-PAGINATE-DOCX: measured blocks of a user's document on pages."""
    blocks = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", (F.col("event_id") % 17 * 10).cast("double").alias("h")))).alias("b"))
    placed = blocks.withColumn("p", layout.measured_pages(F.col("b.h"), 900.0)).select("user_id", F.explode(F.arrays_zip("b", "p")).alias("z"))
    return placed.select("user_id", "z.b.event_id", F.col("z.p").alias("page"))


@query(
    "measuring_batches",
    """WITH RECURSIVE h AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, CASE WHEN event_id % 5 = 0 THEN event_id % 90 ELSE 0 END AS size FROM events),
f(user_id, n, start, batch, held, used) AS (
  SELECT DISTINCT user_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM events
  UNION ALL
  SELECT user_id, n, b, b + k, CASE WHEN k > 0 THEN 1 ELSE h1 + 1 END, u - 200 * k FROM (
    SELECT *, greatest(u - 1, 0) // 200 AS k FROM (
      SELECT user_id, n, CASE WHEN full_ THEN batch + 1 ELSE batch END AS b, CASE WHEN full_ THEN 0 ELSE held END AS h1, CASE WHEN full_ THEN 0 ELSE used END + size AS u
      FROM (SELECT f.user_id, h.n, f.batch, f.held, f.used, h.size, f.held >= 100 OR h.size > 0 AND f.used >= 200 AS full_ FROM f JOIN h ON h.user_id = f.user_id AND h.n = f.n + 1))))
SELECT f.user_id, event_id, CAST(start AS INT) AS batch FROM f JOIN h USING (user_id, n)""",
)
def measuring_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-MEASBATCH: blocks of a user's document, some of them tables, in batches."""
    blocks = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", F.when(F.col("event_id") % 5 == 0, F.col("event_id") % 90).otherwise(0).cast("int").alias("rows")))).alias("b"))
    placed = blocks.withColumn("p", layout.measuring_batches(F.col("b.rows"))).select("user_id", F.explode(F.arrays_zip("b", "p")).alias("z"))
    return placed.select("user_id", "z.b.event_id", F.col("z.p").alias("batch"))


@query("reading_heights")
def reading_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-WRAPLINES, FN-READHEIGHT, WN-READHEIGHT, QR-READING: the height that each conversation's row of turns needs."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", layout.reading_height(F.col("text"), F.lit(12.0), F.lit(400.0)).alias("height"))
    return turns.groupBy("conv_id").agg(F.max("height").alias("height"))


@query(
    "substreams",
    """SELECT user_id, event_id, CAST(e AS BIGINT) AS "end", greatest(0, e - event_id) AS bytes FROM (SELECT user_id, event_id, coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id), 100 + max(event_id) OVER ()) AS e FROM events)""",
)
def substreams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO-SHEETOFF: where each piece ends, by where the next begins or the stream does."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id")
    sized = events.join(F.broadcast(events.agg((F.max("event_id") + 100).alias("size"))))  # one row
    return lookup.substreams(sized, "user_id", "event_id", F.col("size")).drop("size")


@query("first_chart", "SELECT user_id, arg_min(value, event_id) AS value, min(event_id) AS event_id, count(*) AS charts FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def first_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LM-FIRSTCHART: the first chart of each book; purchases are charts among other parts."""
    return charts.first_chart(table(spark, sf_dir, "events"), ["user_id"], F.col("event_type") == "purchase", "event_id", "value")


@query(
    "sheet_states",
    """SELECT s_suppkey, s_name, CASE s_suppkey % 4 WHEN 1 THEN 'hidden' WHEN 2 THEN 'veryHidden' WHEN 3 THEN 'visible' END AS state FROM supplier WHERE s_suppkey % 4 NOT IN (1, 2)""",
)
def sheet_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-HIDDEN-SHEET, PRJ-SNAPSHOT: sheets that are not hidden; a missing state is visible."""
    state = F.when(F.col("s_suppkey") % 4 == 1, "hidden").when(F.col("s_suppkey") % 4 == 2, "veryHidden").when(F.col("s_suppkey") % 4 == 3, "visible")
    named = table(spark, sf_dir, "supplier").withColumn("state", state)
    return named.where(~F.coalesce("state", F.lit("visible")).isin("hidden", "veryHidden")).select("s_suppkey", "s_name", "state")


@query(
    "rk_numbers",
    """WITH p AS (SELECT p_partkey, p_size * 4 + 2 + p_partkey % 2 AS whole FROM part) SELECT p_partkey, CASE WHEN p_partkey % 2 = 1 THEN (whole // 4) / 100.0::DOUBLE ELSE (whole // 4)::DOUBLE END AS whole, 1.0::DOUBLE * 2.0::DOUBLE ** (p_partkey % 20) AS power FROM p""",
)
def rk_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-RK: numbers in their compressed form, whole ones, hundredths and powers of two."""
    whole = F.col("p_size") * 4 + 2 + F.col("p_partkey") % 2
    power = (1023 + F.col("p_partkey") % 20) * 1048576
    return table(spark, sf_dir, "part").select("p_partkey", numbers.rk(whole).alias("whole"), numbers.rk(power).alias("power"))


@query(
    "colour_steps",
    """WITH c AS (SELECT c_custkey, c_custkey % 256 AS r, c_custkey * 3 % 256 AS g, c_custkey * 7 % 256 AS b FROM customer),
x AS (SELECT c_custkey, [least(255, floor(v * 0.75::DOUBLE + 255 * 0.25::DOUBLE + 0.5)) FOR v IN [r, g, b]] AS o FROM c)
SELECT c_custkey, format('#{:02x}{:02x}{:02x}', CAST(o[1] AS INT), CAST(o[2] AS INT), CAST(o[3] AS INT)) AS colour FROM x""",
)
def colour_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-COLOR-RGB, FN-COLOR-THEME: a theme's colour after two steps."""
    key = F.col("c_custkey")
    scheme = F.create_map(F.lit("accent1"), units.colour(F.array(key % 256, key * 3 % 256, key * 7 % 256)))
    base = units.scheme_colour(scheme, F.create_map(F.lit("bg1"), F.lit("accent1")), F.lit("bg1"))
    steps = F.array(F.struct(F.lit("lumMod").alias("type"), F.lit(75000).alias("val")), F.struct(F.lit("lumOff").alias("type"), F.lit(25000).alias("val")))
    return table(spark, sf_dir, "customer").select("c_custkey", units.transform_colour(base, steps).alias("colour"))


@query(
    "digit_widths",
    """WITH f AS (SELECT p_partkey, p_size::DOUBLE AS size, ['Calibri', 'Arial Narrow', 'Arial', 'Courier New', '宋体', 'Times'][p_partkey % 6 + 1] AS family, [0.48, 0.45, 0.525, 0.6, 0.55, 0.5][p_partkey % 6 + 1]::DOUBLE AS share FROM part)
SELECT p_partkey, family, CAST(greatest(1, floor(size * share)) AS INT) AS px FROM f""",
)
def digit_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-DIGITWIDTH: the widest digit of fonts."""
    family = F.element_at(F.array(*map(F.lit, ("Calibri", "Arial Narrow", "Arial", "Courier New", "宋体", "Times"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", family.alias("family"), units.digit_width(family, F.col("p_size").cast("double")).alias("px"))


@query(
    "chart_labels",
    """WITH c AS (SELECT c_custkey, c_mktsegment, c_custkey % 5 = 0 AS gone, CASE c_custkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS v, c_custkey % 2 = 0 AS chart FROM customer)
SELECT c_custkey, CASE WHEN gone THEN FALSE WHEN v IS NOT NULL THEN v ELSE chart END AS shown, c_mktsegment || '; ' || c_custkey AS label, '四川' AS region,
  CASE c_custkey % 4 WHEN 0 THEN 'bar' WHEN 1 THEN 'area' WHEN 2 THEN 'pie' ELSE 'line' END AS drawn FROM c""",
)
def chart_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-LABELFLAGS, FN-REGION, FN-SERIESTYPE: are labels shown, and with what text."""
    key = F.col("c_custkey")
    value = F.when(key % 3 == 0, True).when(key % 3 == 1, False)
    kind = F.when(key % 4 == 0, "column").when(key % 4 == 1, "surface").when(key % 4 == 2, "ofPie").otherwise("strange")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", chart.shows_labels(key % 5 == 0, F.array(value, F.lit(None).cast("boolean")), key % 2 == 0).alias("shown"),
        chart.label_text(F.array(F.col("c_mktsegment"), F.lit(None), F.lit(""), key.cast("string")), F.lit("; ")).alias("label"),
        chart.region_name(F.when(key % 2 == 0, "四川省").otherwise("四川市")).alias("region"), chart.drawn_as(kind).alias("drawn"),
    )


@query(
    "numbered_texts",
    """WITH i AS (SELECT item_id, text, CAST(item_id % 9 + 1 AS VARCHAR) || '.' AS n FROM benchmark)
SELECT item_id, CASE item_id % 3 WHEN 0 THEN n || ' ' || text WHEN 1 THEN n || chr(9) || text ELSE n || text END AS once, CASE item_id % 3 WHEN 0 THEN n || ' ' || text WHEN 1 THEN n || chr(9) || text ELSE n || n || text END AS twice FROM i""",
)
def numbered_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-SUFFIXPREFIX: a list number before a text, not a second time."""
    number = F.concat((F.col("item_id") % 9 + 1).cast("string"), F.lit("."))
    suffix = F.when(F.col("item_id") % 3 == 0, "space").when(F.col("item_id") % 3 == 1, "tab")
    once = T.with_number(F.col("text"), number, suffix)
    return table(spark, sf_dir, "benchmark").select("item_id", once.alias("once"), T.with_number(once, number, suffix).alias("twice"))


@query(
    "json_tables",
    """SELECT event_id, event_type AS category, round(value, 6) AS first, 0.0::DOUBLE AS second FROM events""",
)
def json_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-JSONTABLE, SRC-CHART-WPS: a JSON table under headings, what is no number is 0, rows without a category go."""
    quote = F.lit("?quot;")
    text = F.concat(F.lit('{"data": [["h", "a", "b"], ["'), F.col("event_type"), F.lit(' ", "'), F.round("value", 6).cast("string"), F.lit('", "n/a"], ["", "1", "2"]]}'))
    written = F.when(F.col("event_id") % 2 == 0, F.replace(text, F.lit('"'), quote)).otherwise(text)
    rows = table(spark, sf_dir, "events").select("event_id", F.explode(T.json_table(written)).alias("r"))
    return rows.select("event_id", "r.category", F.round(F.col("r.values")[0], 6).alias("first"), F.col("r.values")[1].alias("second"))


@query(
    "indexed_colours",
    """WITH p AS (SELECT p_partkey, CAST(p_partkey % 70 - 3 AS INT) AS i FROM part) SELECT p_partkey, CASE WHEN i BETWEEN 0 AND 63 THEN '#' || string_split('"""
    + " ".join(units.INDEXED)
    + """', ' ')[i + 1] END AS colour FROM p""",
)
def indexed_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-COLOR-INDEXED."""
    return table(spark, sf_dir, "part").select("p_partkey", units.indexed_colour((F.col("p_partkey") % 70 - 3).cast("int")).alias("colour"))


@query(
    "grey_shifts",
    """WITH p AS (SELECT p_partkey, p_size * 5 AS g FROM part), s AS (SELECT p_partkey, g, CAST(floor(least(1.0::DOUBLE, g / 255.0::DOUBLE * 0.5 + 0.25) * 255 + 0.5) AS INT) AS o FROM p)
SELECT p_partkey, format('#{:02x}{:02x}{:02x}', CAST(g AS INT), CAST(g AS INT), CAST(g AS INT)) AS base, format('#{:02x}{:02x}{:02x}', o, o, o) AS shifted FROM s""",
)
def grey_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-COLOR-HSL on greys; a test has other colours."""
    grey = F.col("p_size") * 5
    base = units.colour(F.array(grey, grey, grey))
    return table(spark, sf_dir, "part").select("p_partkey", base.alias("base"), units.shift_hsl(base, F.lit(0.5), F.lit(0.25), F.lit(2.0)).alias("shifted"))


@query(
    "texts_before_images",
    """WITH k AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'table' WHEN 'click' THEN 'image' WHEN 'view' THEN 'text' ELSE 'other' END AS kind FROM events),
s AS (SELECT *, count(*) FILTER (kind NOT IN ('image', 'text')) OVER (PARTITION BY user_id ORDER BY event_id) AS stop FROM k),
a AS (SELECT *, first_value(kind) OVER (PARTITION BY user_id, stop ORDER BY event_id) AS head FROM s)
SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY stop, CASE WHEN kind NOT IN ('image', 'text') THEN -1 WHEN head <> 'table' THEN 0 WHEN kind = 'text' THEN 1 ELSE 2 END, event_id) - 1 AS INT) AS place FROM a""",
)
def texts_before_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-TABLEGROUP: after a table, texts come before images."""
    kind = F.when(F.col("event_type") == "error", "table").when(F.col("event_type") == "click", "image").when(F.col("event_type") == "view", "text").otherwise("other")
    return documents.texts_before_images(table(spark, sf_dir, "events"), "user_id", "event_id", kind).select("user_id", "event_id", "place")


@query(
    "overflow_pages",
    """WITH k AS (SELECT user_id, event_id, event_type IN ('view', 'click') AS spacer, event_type = 'purchase' AS full_, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
c AS (SELECT *, n - 1 - coalesce(max(CASE WHEN NOT spacer THEN n END) OVER b, 0) AS gap, coalesce(bool_or(full_) OVER b, FALSE) AS earlier FROM k WINDOW b AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT user_id, event_id, CAST(sum(CASE WHEN full_ AND earlier AND gap >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS INT) AS page FROM c""",
)
def overflow_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-SECTIONSPLIT: a second shape of a page's size after spacers begins a page."""
    events = table(spark, sf_dir, "events")
    found = documents.overflow_pages(events, "user_id", "event_id", F.col("event_type").isin("view", "click"), F.col("event_type") == "purchase")
    return found.select("user_id", "event_id", "page")


@query(
    "repaired_texts",
    r"""SELECT item_id, text AS repaired, CASE WHEN regexp_matches(text, '[^\x00-\x7F]') THEN '锟 ' || text ELSE chr(31) || ' ' || text END AS mixed, 'x' || chr(10) || regexp_replace(text, '[{}\\]', '', 'g') AS plain FROM benchmark""",
)
def repaired_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-MOJIBAKE, FN-STRIP-RTF: texts whose UTF-8 was read as Latin-1, and texts inside RTF."""
    text = F.col("text")
    spoilt = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    rtf = F.concat(F.lit(r"{\rtf1\b x\par "), F.regexp_replace(text, r"[{}\\]", ""), F.lit("}"))
    return table(spark, sf_dir, "benchmark").select("item_id", T.mojibake(spoilt).alias("repaired"), T.mojibake(F.concat(F.lit("锟 "), text)).alias("mixed"), T.strip_rtf(rtf).alias("plain"))


@query(
    "letter_counters",
    """WITH n AS (SELECT c_custkey, c_custkey % 702 + 1 AS n FROM customer) SELECT c_custkey, lower(CASE WHEN n <= 26 THEN chr(CAST(64 + n AS INT)) ELSE chr(CAST(64 + (n - 1) // 26 AS INT)) || chr(CAST(65 + (n - 1) % 26 AS INT)) END) AS letter FROM n""",
)
def letter_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-LETTER, WN-NUMBERING's texts: counters as letters."""
    counters = F.array((F.col("c_custkey") % 702 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", documents.number_text(counters, F.lit(0), ("lower_letter",)).alias("letter"))


@query(
    "capped_grid",
    """WITH n AS (SELECT CAST(l_suppkey AS VARCHAR) AS sheet_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS r, l_linenumber * 30 AS c, l_quantity FROM lineitem), s AS (SELECT *, max(r) OVER w > 200 OR max(c) OVER w > 80 AS cut FROM n WINDOW w AS (PARTITION BY sheet_id))
SELECT sheet_id, CAST(r AS INT) AS row_index, CAST(c AS INT) AS column_index, l_quantity AS value, cut FROM s WHERE r <= 200 AND c <= 80""",
)
def capped_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LM-CAP: previews of sheets, with a sign where a sheet has more; nothing else cuts sheets."""
    row = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("sheet_id"), row.alias("row_index"), (F.col("l_linenumber") * 30).cast("int").alias("column_index"), F.col("l_quantity").alias("value"))
    return grid.capped(lines)


@query(
    "visible_blanks",
    """WITH s AS (SELECT p_partkey, p_brand, CASE WHEN p_size % 5 = 0 THEN 'fill' END AS fill, CASE WHEN p_size % 7 = 0 THEN 'thin' END AS border, CASE WHEN p_size % 3 = 0 THEN p_type ELSE '' END AS value FROM part)
SELECT p_brand AS sheet_id, count(*) FILTER (value <> '' OR fill IS NOT NULL OR border IS NOT NULL) AS kept, count(*) FILTER (value = '' AND (fill IS NOT NULL OR border IS NOT NULL)) AS blanks FROM s GROUP BY p_brand""",
)
def visible_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-VISIBLE-EMPTY: blank cells count where their style shows."""
    size = F.col("p_size")
    cells = table(spark, sf_dir, "part").select(F.col("p_brand").alias("sheet_id"), F.when(size % 5 == 0, "fill").alias("fill"), F.when(size % 7 == 0, "thin").alias("border"), F.when(size % 3 == 0, F.col("p_type")).otherwise("").alias("value"))
    shows = grid.shows_when_empty(F.col("fill"), F.col("border"))
    full = grid.occupied(F.col("value"))
    return cells.groupBy("sheet_id").agg(F.count_if(full | shows).alias("kept"), F.count_if(~full & shows).alias("blanks"))
