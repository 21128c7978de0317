"""Queries of trees, chains, floating objects and page heights over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireframe.operators import axis, documents, grid, heights, lookup, objects, reading, trees
from quireframe.plans.documents import ITEMS_SQL, outline_items
from quireframe.plans.grid import PARTS_SQL, order_merges, part_rows
from quireframe.plans.registry import query, table


def part_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as groups of slides of 100: ten in each other, with scales of a half, one, two and (no child size) one."""
    key, size = F.col("p_partkey"), F.col("p_size")
    number = lambda c: c.cast("double")
    return table(spark, sf_dir, "part").select(
        F.floor(key / 100).cast("long").alias("slide_id"), key.alias("node"), F.when(key % 10 != 0, key - 1).alias("parent"), number(size * 8).alias("x"), number(key % 50 * 4).alias("y"),
        number(F.lit(128)).alias("width"), number(F.lit(64)).alias("height"), number(size % 5).alias("child_x"), number(size % 3).alias("child_y"),
        number(F.element_at(F.array(*map(F.lit, (0, 64, 128, 256))), (size % 4 + 1).cast("int"))).alias("child_width"), number(F.element_at(F.array(*map(F.lit, (32, 64, 128))), (size % 3 + 1).cast("int"))).alias("child_height"),
    )


@query(
    "nested_groups",
    """WITH RECURSIVE g AS (SELECT p_partkey // 100 AS slide_id, p_partkey AS node, CASE WHEN p_partkey % 10 <> 0 THEN p_partkey - 1 END AS parent, p_size * 8.0::DOUBLE AS x, p_partkey % 50 * 4.0::DOUBLE AS y,
    CASE p_size % 4 WHEN 1 THEN 2.0 WHEN 3 THEN 0.5 ELSE 1.0 END::DOUBLE AS sx, CASE p_size % 3 WHEN 0 THEN 2.0 WHEN 1 THEN 1.0 ELSE 0.5 END::DOUBLE AS sy, (p_size % 5)::DOUBLE AS cx, (p_size % 3)::DOUBLE AS cy FROM part),
e(id, slide_id, parent, x, y, w, h) AS (SELECT p_partkey, p_partkey // 100, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey END, (p_partkey % 7)::DOUBLE, p_size::DOUBLE, 16.0::DOUBLE, 8.0::DOUBLE FROM part
  UNION ALL SELECT e.id, e.slide_id, g.parent, g.x + (e.x - g.cx) * g.sx, g.y + (e.y - g.cy) * g.sy, e.w * g.sx, e.h * g.sy FROM e JOIN g ON g.slide_id = e.slide_id AND g.node = e.parent)
SELECT slide_id, id, x, y, w AS width, h AS height FROM e WHERE parent IS NULL OR NOT EXISTS (SELECT 1 FROM g WHERE g.slide_id = e.slide_id AND g.node = e.parent)""",
)
def nested_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-FLATTEN-GROUP: elements of groups in groups, in the slide's coordinates."""
    key = F.col("p_partkey")
    elements = table(spark, sf_dir, "part").select(
        F.floor(key / 100).cast("long").alias("slide_id"), key.alias("id"), F.when(key % 4 != 0, key).alias("parent"), (key % 7).cast("double").alias("x"), F.col("p_size").cast("double").alias("y"), F.lit(16.0).alias("width"), F.lit(8.0).alias("height")
    )
    return trees.flattened(elements, part_groups(spark, sf_dir), ["slide_id"]).drop("parent")


# previous: an edit's file has the edit before of the same file; some files come back to themselves, some are locked
EDITS_SQL = """e AS (SELECT user_id AS file_id, event_id AS edit_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n, max(event_id) OVER (PARTITION BY user_id) AS newest, count(*) OVER (PARTITION BY user_id) AS c FROM events),
d AS (SELECT file_id, edit_id, CASE WHEN file_id % 7 = 3 AND p IS NULL AND c > 2 THEN newest WHEN n % 4 = 1 AND p2 IS NOT NULL THEN p2 ELSE coalesce(p, 0) END AS previous, file_id % 11 = 5 AND n = 2 AS encrypted, newest FROM (SELECT *, lag(p) OVER (PARTITION BY file_id ORDER BY edit_id) AS p2 FROM e))"""


@query(
    "edit_chain_links",
    f"""WITH RECURSIVE {EDITS_SQL},
w(file_id, edit_id, depth) AS (SELECT DISTINCT file_id, newest, 0 FROM d UNION ALL SELECT w.file_id, d.previous, depth + 1 FROM w JOIN d ON d.file_id = w.file_id AND d.edit_id = w.edit_id WHERE d.previous <> 0 AND depth < 400),
x AS (SELECT w.file_id, max(n) > 1 AS cycle, bool_or(coalesce(encrypted, FALSE)) AS locked FROM (SELECT *, count(*) OVER (PARTITION BY file_id, edit_id) AS n FROM w) w JOIN d ON d.file_id = w.file_id AND d.edit_id = w.edit_id GROUP BY w.file_id),
b AS (SELECT w.file_id, w.edit_id % 17 AS persist_id, arg_min(w.edit_id, depth) AS edit_id FROM w JOIN x USING (file_id) WHERE NOT cycle AND NOT locked GROUP BY ALL)
SELECT file_id, persist_id, edit_id * 3 AS "offset", edit_id, NULL::VARCHAR AS error FROM b
UNION ALL SELECT file_id, NULL, NULL, NULL, CASE WHEN cycle THEN 'cycle' ELSE 'encrypted' END FROM x WHERE cycle OR locked""",
)
def edit_chain_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QR-EDITCHAIN: the newest object of each id along the links of a file's edits; cycles and encryption are errors."""
    w = trees.Window.partitionBy("file_id")
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("file_id"), F.col("event_id").alias("edit_id"))
    ordered = w.orderBy("edit_id")
    e = events.withColumns({"p": F.lag("edit_id").over(ordered), "p2": F.lag("edit_id", 2).over(ordered), "n": F.row_number().over(w.orderBy(F.desc("edit_id"))), "newest": F.max("edit_id").over(w), "c": F.count("*").over(w)})
    back = (F.col("file_id") % 7 == 3) & F.col("p").isNull() & (F.col("c") > 2)
    previous = F.when(back, F.col("newest")).when((F.col("n") % 4 == 1) & F.col("p2").isNotNull(), F.col("p2")).otherwise(F.coalesce("p", F.lit(0)))
    edits = e.select("file_id", "edit_id", previous.alias("previous"), ((F.col("file_id") % 11 == 5) & (F.col("n") == 2)).alias("encrypted"))
    entries = events.select("file_id", "edit_id", (F.col("edit_id") % 17).alias("persist_id"), (F.col("edit_id") * 3).alias("offset"))
    return trees.edit_chain(edits, entries, events.groupBy("file_id").agg(F.max("edit_id").alias("edit_id")), "file_id")


NESTED_SQL = f"""{ITEMS_SQL}, t AS (SELECT a.book, a.id, a.level, a.ord, coalesce((SELECT min(b.ord) FROM i b WHERE b.book = a.book AND b.ord > a.ord AND b.level <= a.level), (SELECT max(ord) FROM i b WHERE b.book = a.book) + 1) - 1 AS leave FROM i a),
p AS (SELECT a.book, a.id, b.id AS up, b.ord AS up_ord FROM t a JOIN t b ON b.book = a.book AND b.ord < a.ord AND a.ord <= b.leave)"""


@query(
    "outline_ancestors",
    f"""WITH {NESTED_SQL} SELECT t.book, t.id, CAST(t.ord AS BIGINT) AS enter, CAST(t.leave AS BIGINT) AS leave, CAST((SELECT count(*) FROM p WHERE p.book = t.book AND p.id = t.id) + 1 AS INT) AS depth,
  coalesce((SELECT string_agg(up, '/' ORDER BY up_ord) FROM p WHERE p.book = t.book AND p.id = t.id), '') AS path FROM t""",
)
def outline_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QR-OUTLINE: where each heading's part ends, its depth and its ancestors."""
    nested = trees.nested_sets(outline_items(spark, sf_dir), "book")
    return nested.select("book", "id", "enter", "leave", "depth", F.array_join(F.transform("ancestors", lambda a: a.cast("string")), "/").alias("path"))


@query(
    "outline_subtrees",
    f"""WITH {NESTED_SQL}, n AS (SELECT t.*, (SELECT count(*) FROM p WHERE p.book = t.book AND p.id = t.id) AS d FROM t)
SELECT b.book, a.id AS asked, b.id, CAST(b.d - a.d AS INT) AS level_below, b.ord = b.leave AS is_leaf FROM n a JOIN n b ON b.book = a.book AND b.ord > a.ord AND b.ord <= a.leave WHERE a.id % 5 = 0 AND b.d - a.d <= 2""",
)
def outline_subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QR-OUTLINE: what lies below some headings, down to two levels."""
    nested = trees.nested_sets(outline_items(spark, sf_dir), "book")
    return trees.subtrees(nested, nested.where("id % 5 = 0").select("book", F.col("id").alias("asked")), "book", 2)


@query(
    "outline_roots",
    f"""WITH {NESTED_SQL}, n AS (SELECT t.*, (SELECT count(*) FROM p WHERE p.book = t.book AND p.id = t.id) + 1 AS d FROM t)
SELECT a.book, a.id, CAST(a.d AS INT) AS depth, (SELECT count(*) FROM n b WHERE b.book = a.book AND b.ord > a.ord AND b.ord <= a.leave AND b.d = a.d + 1) AS children FROM n a WHERE a.d <= 2""",
)
def outline_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QR-OUTLINE: the first two levels, with the number of each heading's children."""
    return trees.top_levels(trees.nested_sets(outline_items(spark, sf_dir), "book"), "book", 2)


# Objects of sheets of 1000 parts: most are small, every 50th is as high as the sheet.
OBJECTS_SQL = """ob AS (SELECT CAST(p_partkey // 1000 AS VARCHAR) AS sheet_id, p_partkey AS object_id, (p_partkey * 37 % 4000)::DOUBLE AS x, (p_partkey * 13 % 20000)::DOUBLE AS y,
  CASE WHEN p_partkey % 50 = 0 THEN 3000 ELSE p_size * 4 END::DOUBLE AS width, CASE WHEN p_partkey % 50 = 0 THEN 20000 ELSE p_size * 3 END::DOUBLE AS height FROM part)"""


def part_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        F.floor(key / 1000).cast("string").alias("sheet_id"), key.alias("object_id"), (key * 37 % 4000).cast("double").alias("x"), (key * 13 % 20000).cast("double").alias("y"),
        F.when(key % 50 == 0, 3000).otherwise(size * 4).cast("double").alias("width"), F.when(key % 50 == 0, 20000).otherwise(size * 3).cast("double").alias("height"),
    )


@query(
    "range_objects",
    f"""WITH {PARTS_SQL}, {OBJECTS_SQL}, m AS (SELECT CAST(o_orderkey // 500 % 3 AS VARCHAR) AS sheet_id, o_orderkey AS range_id, CAST(o_orderkey % 500 + 1 AS INT) AS a, CAST(o_orderkey % 500 + 2 + o_custkey % 3 AS INT) AS b, CAST(o_custkey % 60 AS INT) AS c, CAST(o_custkey % 60 + 1 + o_orderkey % 4 AS INT) AS d FROM orders),
px AS (SELECT m.*, (a - 1) * 20.0::DOUBLE + coalesce((SELECT sum(size - 20) FROM s WHERE s.sheet_id = m.sheet_id AND s.idx < a), 0) AS top, (b - 1) * 20.0::DOUBLE + coalesce((SELECT sum(size - 20) FROM s WHERE s.sheet_id = m.sheet_id AND s.idx < b), 0) AS bottom, c * 64.0::DOUBLE AS "left", d * 64.0::DOUBLE AS "right" FROM m)
SELECT px.sheet_id, range_id, object_id FROM px JOIN ob ON ob.sheet_id = px.sheet_id AND x + width >= "left" AND x <= "right" AND y + height >= top AND y <= bottom""",
)
def range_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-OBJ-ISECT, QR-RANGE: the objects that each range of cells shows, by px."""
    ranges = order_merges(spark, sf_dir).select((F.col("sheet_id").cast("int") % 3).cast("string").alias("sheet_id"), F.col("merge_id").alias("range_id"), "start_row", "start_column", "end_row", "end_column")
    rects = objects.range_rects(ranges, axis.offsets(part_rows(spark, sf_dir)), 20.0, 64.0)
    return objects.intersecting(rects, part_objects(spark, sf_dir))


@query(
    "sheet_canvas",
    f"""WITH {PARTS_SQL}, {OBJECTS_SQL}, g AS (SELECT sheet_id, 640.0::DOUBLE AS width, max(start + size) AS height FROM s GROUP BY sheet_id)
SELECT g.sheet_id, greatest(g.width, max(ob.x + ob.width)) AS width, greatest(g.height, max(ob.y + ob.height)) AS height FROM g JOIN ob USING (sheet_id) GROUP BY g.sheet_id, g.width, g.height""",
)
def sheet_canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-CANVAS: the px that a sheet's rows and its objects need."""
    grid = axis.offsets(part_rows(spark, sf_dir)).groupBy("sheet_id").agg(F.lit(640.0).alias("width"), F.max("end").alias("height"))
    return objects.canvas(grid, part_objects(spark, sf_dir))


# Pages of suppliers' documents: lines are pages, those with number 6 and more come later, some heights change after.
PAGES_SQL = """n AS (SELECT l_suppkey AS doc, l_linenumber > 5 AS late, l_quantity - 5 AS h, l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem),
q AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY late, l_orderkey, l_linenumber, l_partkey, l_quantity) - 1 AS idx, h FROM n),
z AS (SELECT doc, idx, greatest(0, CASE WHEN idx % 31 = 7 AND doc % 3 = 1 THEN idx % 90 - 10 ELSE h END)::DOUBLE AS h FROM q),
v AS (SELECT doc, idx, sum(h) OVER (PARTITION BY doc ORDER BY idx) AS upto, count(*) OVER (PARTITION BY doc) AS n, sum(h) OVER (PARTITION BY doc) AS total FROM z)"""


def page_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    order = [F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").alias("ord"), (F.col("l_quantity") - 5).alias("height")]
    rows = lines.select(F.col("l_suppkey").alias("doc"), "l_linenumber", *order)
    first = rows.where("l_linenumber <= 5").withColumn("idx", F.row_number().over(heights.Window.partitionBy("doc").orderBy("ord")) - 1)
    whole = heights.append(heights.build(first, "doc"), rows.where("l_linenumber > 5"), "doc")
    numbers = whole.where("doc % 3 = 1").select("doc", F.explode(F.sequence(F.col("block") * heights.BLOCK, F.col("block") * heights.BLOCK + F.size("heights") - 1)).alias("idx"))
    changes = numbers.where("idx % 31 = 7").select("doc", "idx", (F.col("idx") % 90 - 10).cast("double").alias("height"))
    return heights.replace(whole, changes, "doc")


@query("page_offsets", f"WITH {PAGES_SQL}, a AS (SELECT DISTINCT l_suppkey AS doc, l_orderkey % 900 - 5 AS idx FROM lineitem) SELECT a.doc, a.idx, coalesce((SELECT max(upto) FROM v WHERE v.doc = a.doc AND v.idx < a.idx), 0) AS \"offset\" FROM a")
def page_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-FENWICK: offsets of pages after pages were appended and replaced, from two levels of sums."""
    points = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc"), (F.col("l_orderkey") % 900 - 5).alias("idx")).distinct()
    return heights.offset_of(page_heights(spark, sf_dir), points, "doc")


@query(
    "page_at_offset",
    f"""WITH {PAGES_SQL}, a AS (SELECT DISTINCT l_suppkey AS doc, CAST(l_partkey * 7 % 20000 - 50 AS DOUBLE) AS x FROM lineitem), t AS (SELECT DISTINCT doc, n, total FROM v)
SELECT a.doc, a.x, CASE WHEN x <= 0 THEN 0 WHEN x >= total THEN n - 1 ELSE least(n - 1, (SELECT count(*) FROM v WHERE v.doc = a.doc AND upto <= a.x)) END AS idx FROM a JOIN t USING (doc)""",
)
def page_at_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-FENWICK inverse: the page at an offset."""
    points = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc"), (F.col("l_partkey") * 7 % 20000 - 50).cast("double").alias("x")).distinct()
    return heights.index_at(page_heights(spark, sf_dir), points, "doc")


READING_SQL = """c AS (SELECT DISTINCT CAST(l_partkey // 1000 AS VARCHAR) AS sheet_id, CAST(l_partkey % 1000 + 1 AS INT) AS row_index, CAST(l_partkey % 1000 + 1 + CASE WHEN l_partkey % 5 = 0 THEN 3 ELSE 0 END AS INT) AS end_row, l_quantity * 2 AS needed FROM lineitem WHERE CAST(l_partkey // 1000 AS VARCHAR) IN (SELECT sheet_id FROM o)),
y AS (SELECT c.*, r, coalesce(o.size, 20.0) AS size FROM c CROSS JOIN unnest(range(row_index, end_row + 1)) AS t(r) LEFT JOIN o ON o.sheet_id = c.sheet_id AND o.idx = r),
h AS (SELECT sheet_id, row_index, end_row, needed, sum(size) AS has, max(r) FILTER (size > 0) AS target, arg_max(size, r) FILTER (size > 0) AS now FROM y GROUP BY ALL),
u AS (SELECT sheet_id, target AS idx, max(now + needed - has) AS height FROM h WHERE target IS NOT NULL AND needed > has GROUP BY ALL)"""


def reading_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as cells in the rows of their parts; those of every fifth part are merged over four rows."""
    key, row = F.col("l_partkey"), (F.col("l_partkey") % 1000 + 1).cast("int")
    cells = table(spark, sf_dir, "lineitem").select(F.floor(key / 1000).cast("string").alias("sheet_id"), row.alias("row_index"), (row + F.when(key % 5 == 0, 3).otherwise(0)).cast("int").alias("end_row"), (F.col("l_quantity") * 2).alias("needed"))
    return cells.join(part_rows(spark, sf_dir).select("sheet_id").distinct(), "sheet_id", "left_semi")


@query("reading_rows", f"WITH {PARTS_SQL}, {READING_SQL} SELECT sheet_id, CAST(idx AS INT) AS idx, height FROM u")
def reading_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-READHEIGHT: rows that have to be higher so that their cells' texts show, merged cells' by their last visible row."""
    return reading.row_updates(reading_cells(spark, sf_dir), axis.offsets(part_rows(spark, sf_dir)), 20.0)


@query(
    "reading_objects",
    f"""WITH {PARTS_SQL}, {READING_SQL}, {OBJECTS_SQL}, a AS (SELECT h.sheet_id, r AS idx, coalesce(o.size, 20.0) AS size, CASE WHEN o.size = 0 AND o.idx IS NOT NULL AND EXISTS (SELECT 1 FROM part WHERE CAST(p_partkey // 1000 AS VARCHAR) = h.sheet_id AND p_partkey % 1000 + 1 = r AND p_size % 7 = 0 AND p_size % 3 <> 0) THEN 0 ELSE greatest(coalesce(o.size, CASE WHEN u.height IS NULL THEN 20.0 ELSE 0 END), coalesce(u.height, 0)) END AS shown
  FROM (SELECT DISTINCT sheet_id FROM o) h CROSS JOIN unnest(range(1, 1201)) AS t(r) LEFT JOIN o ON o.sheet_id = h.sheet_id AND o.idx = r LEFT JOIN u ON u.sheet_id = h.sheet_id AND u.idx = r),
e AS (SELECT sheet_id, idx, size, shown, sum(size) OVER w - size AS start, sum(size) OVER w AS stop, sum(shown) OVER w - shown AS to_ FROM a WINDOW w AS (PARTITION BY sheet_id ORDER BY idx)),
p AS (SELECT sheet_id, object_id, 0 AS k, y AS x FROM ob UNION ALL SELECT sheet_id, object_id, 1, y + height FROM ob),
f AS (SELECT p.sheet_id, object_id, k, x, least(1000, coalesce((SELECT min(idx) FROM e WHERE e.sheet_id = p.sheet_id AND stop > x), 1000)) AS idx FROM p WHERE p.sheet_id IN (SELECT sheet_id FROM o)),
m AS (SELECT f.sheet_id, object_id, k, to_ + shown * CASE WHEN size > 0 THEN greatest(0, least(1, (x - start) / size)) ELSE 0 END AS v FROM f JOIN e ON e.sheet_id = f.sheet_id AND e.idx = f.idx),
v AS (SELECT sheet_id, object_id, max(v) FILTER (k = 0) AS y, max(v) FILTER (k = 1) AS bottom FROM m GROUP BY ALL)
SELECT sheet_id, object_id, round(y, 6) AS y, round(greatest(1, bottom - y), 6) AS height FROM v""",
)
def reading_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QR-READING: where objects lie once rows are as high as their texts need."""
    overrides = part_rows(spark, sf_dir)
    source = axis.offsets(overrides)
    display = axis.offsets(reading.updated(overrides, reading.row_updates(reading_cells(spark, sf_dir), source, 20.0), 20.0))
    objects_ = part_objects(spark, sf_dir).join(source.select("sheet_id").distinct(), "sheet_id", "left_semi")
    found = reading.remapped(objects_, source, display, 20.0, 1000)
    return found.select("sheet_id", "object_id", *[F.round(c, 6).alias(c) for c in ("y", "height")])


@query(
    "sheet_views",
    f"""WITH {PARTS_SQL}, full_ AS (SELECT h.sheet_id, r AS idx, coalesce(o.size, 20.0) AS size FROM (SELECT DISTINCT sheet_id FROM o) h CROSS JOIN unnest(range(1, 1001)) AS t(r) LEFT JOIN o ON o.sheet_id = h.sheet_id AND o.idx = r),
ends AS (SELECT sheet_id, idx, sum(size) OVER (PARTITION BY sheet_id ORDER BY idx) AS e FROM full_),
q AS (SELECT CAST(o_orderkey % 3 AS VARCHAR) AS sheet_id, o_orderkey AS view_id, greatest(0, o_custkey * 11 % 20000 - 50)::DOUBLE AS top, greatest(240, o_orderkey % 500)::DOUBLE AS span FROM orders WHERE CAST(o_orderkey % 3 AS VARCHAR) IN (SELECT sheet_id FROM o)),
r AS (SELECT sheet_id, view_id, least(1000, coalesce((SELECT min(idx) FROM ends WHERE ends.sheet_id = q.sheet_id AND e > greatest(0, top - 2 * span)), 1000)) AS a, least(1000, coalesce((SELECT min(idx) FROM ends WHERE ends.sheet_id = q.sheet_id AND e > top + 3 * span), 1000)) AS b FROM q)
SELECT sheet_id, view_id, CAST(a AS BIGINT) AS first, CAST(greatest(a, b) AS BIGINT) AS last FROM r""",
)
def sheet_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-VIEWPORT: the rows to show for a place of a sheet, two heights of the view before it to two behind."""
    sized = axis.offsets(part_rows(spark, sf_dir))
    views = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 3).cast("string").alias("sheet_id"), F.lit("row").alias("axis"), F.col("o_orderkey").alias("view_id"), (F.col("o_custkey") * 11 % 20000 - 50).cast("double").alias("scroll"), (F.col("o_orderkey") % 500).cast("double").alias("size"), F.lit(20.0).alias("default_size"), F.lit(1000).alias("count"))
    return axis.viewport(sized, views.join(sized.select("sheet_id").distinct(), "sheet_id", "left_semi")).select("sheet_id", "view_id", "first", "last")


@query(
    "page_views",
    f"""WITH {PAGES_SQL}, w AS (SELECT DISTINCT l_suppkey AS doc, l_partkey % 40 AS view_id FROM lineitem), p AS (SELECT doc, view_id, (view_id * 613 % 20000)::DOUBLE AS scroll, (view_id % 7 * 20)::DOUBLE AS size FROM w), t AS (SELECT DISTINCT doc, n, total FROM v),
a AS (SELECT p.*, n, total, greatest(0, scroll - 2 * size) AS x, scroll + 3 * size AS z FROM p JOIN t USING (doc)),
i AS (SELECT *, CASE WHEN x <= 0 THEN 0 WHEN x >= total THEN n - 1 ELSE least(n - 1, (SELECT count(*) FROM v WHERE v.doc = a.doc AND upto <= x)) END AS s, least(n, 1 + CASE WHEN z <= 0 THEN 0 WHEN z >= total THEN n - 1 ELSE least(n - 1, (SELECT count(*) FROM v WHERE v.doc = a.doc AND upto <= z)) END) AS e FROM a),
m AS (SELECT *, greatest(0, 3 - (e - s)) AS missing FROM i), l AS (SELECT *, least(n, e + missing - least(s, CAST(ceil(missing / 2) AS BIGINT))) AS last FROM m),
f AS (SELECT *, CASE WHEN missing > 0 THEN greatest(0, last - 3) ELSE s END AS first FROM l)
SELECT doc, view_id, CAST(first AS BIGINT) AS first, CAST(last AS BIGINT) AS last, coalesce((SELECT max(upto) FROM v WHERE v.doc = f.doc AND v.idx < first), 0) AS above, total - coalesce((SELECT max(upto) FROM v WHERE v.doc = f.doc AND v.idx < last), 0) AS below FROM f""",
)
def page_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-VIEWPORT, QR-PAGES: the pages to show for a place of a document, three at least, and the heights around them."""
    view = F.col("view_id")
    views = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc"), (F.col("l_partkey") % 40).alias("view_id")).distinct()
    views = views.select("doc", "view_id", (view * 613 % 20000).cast("double").alias("scroll"), (view % 7 * 20).cast("double").alias("size"))
    return heights.page_window(page_heights(spark, sf_dir), views, "doc").drop("scroll", "size")


@query(
    "anchored_objects",
    f"""WITH {PARTS_SQL}, a AS (SELECT *, r || '/' || c || '/' || CAST(q AS INT) AS object_id FROM (SELECT DISTINCT CAST(l_partkey // 1000 AS VARCHAR) AS sheet_id, l_partkey % 1000 + 1 AS r, l_suppkey % 9 + 1 AS c, l_quantity AS q FROM lineitem WHERE CAST(l_partkey // 1000 AS VARCHAR) IN (SELECT sheet_id FROM o))),
b AS (SELECT *, (r - 1) * 20.0::DOUBLE + coalesce((SELECT sum(size - 20) FROM s WHERE s.sheet_id = a.sheet_id AND s.idx < r), 0) + q AS y, (r + q % 4 - 1) * 20.0::DOUBLE + coalesce((SELECT sum(size - 20) FROM s WHERE s.sheet_id = a.sheet_id AND s.idx < r + q % 4), 0) + 5 AS y2 FROM a)
SELECT sheet_id, object_id, (c - 1) * 64.0::DOUBLE + 3 AS x, y, greatest(1, q % 3 * 64.0::DOUBLE) AS width, greatest(1, y2 - y) AS height FROM b""",
)
def anchored_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QR-ANCHOR: px rectangles of objects between two cells, 1 px at least."""
    sized = axis.offsets(part_rows(spark, sf_dir))
    lines = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_partkey") / 1000).cast("string").alias("sheet_id"), (F.col("l_partkey") % 1000 + 1).alias("r"), (F.col("l_suppkey") % 9 + 1).alias("c"), F.col("l_quantity").alias("q")).distinct()
    lines = lines.withColumn("object_id", F.concat_ws("/", "r", "c", F.col("q").cast("int")))
    lines = lines.join(sized.select("sheet_id").distinct(), "sheet_id", "left_semi")
    anchors = lines.select("sheet_id", "object_id", F.col("r").alias("from_row"), F.col("q").alias("from_y"), F.col("c").alias("from_column"), F.lit(3).alias("from_x"), (F.col("r") + F.col("q") % 4).alias("to_row"), F.lit(5).alias("to_y"), (F.col("c") + F.col("q") % 3).alias("to_column"), F.lit(3).alias("to_x"))
    return objects.anchor_rects(anchors, sized, 20.0, 64.0)


@query(
    "drawing_tops",
    """WITH i AS (SELECT conv_id, turn * 100 AS a, turn * 100 + length(text) % 90 AS b, turn * 10.0::DOUBLE AS top FROM conversations), p AS (SELECT DISTINCT conv_id, turn * 61 AS position FROM conversations)
SELECT p.conv_id, CAST(position AS BIGINT) AS position, coalesce((SELECT max(top) FROM i WHERE i.conv_id = p.conv_id AND a <= position AND position < b), 0) AS top FROM p""",
)
def drawing_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-ANCHOR: the top of the paragraph whose characters hold an anchor, 0 between paragraphs."""
    turns = table(spark, sf_dir, "conversations")
    intervals = turns.select("conv_id", (F.col("turn") * 100).alias("start"), (F.col("turn") * 100 + F.char_length("text") % 90).alias("end"), (F.col("turn") * 10.0).alias("top"))
    return lookup.interval_value(turns.select("conv_id", (F.col("turn") * 61).alias("position")).distinct(), intervals, "conv_id", "top")


@query(
    "sheet_extents",
    """WITH c AS (SELECT CAST(o_orderkey // 500 AS VARCHAR) AS s, o_orderkey % 500 AS r, o_custkey % 60 AS k, o_custkey % 3 AS dr, o_orderkey % 4 AS dk, o_orderkey % 7 AS z FROM orders)
SELECT s AS sheet_id, CAST(greatest(0, max(CASE WHEN z < 3 THEN r WHEN z < 5 THEN r + dr + 1 ELSE r % 100 - 1 END)) AS INT) AS last_row, CAST(greatest(0, max(CASE WHEN z < 3 THEN k WHEN z < 5 THEN k + dk + 1 ELSE k % 20 - 1 END)) AS INT) AS last_column FROM c GROUP BY s""",
)
def sheet_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-USED-RANGE-XLS: the extent of declared dimensions, cells and merges of sheets."""
    key, row, column = F.col("o_orderkey"), F.col("o_orderkey") % 500, F.col("o_custkey") % 60
    rows = table(spark, sf_dir, "orders").select(F.floor(key / 500).cast("string").alias("sheet_id"), row.alias("r"), column.alias("k"), (row + F.col("o_custkey") % 3 + 1).alias("end_row"), (column + key % 4 + 1).alias("end_column"), (key % 7).alias("z"))
    dimensions = rows.where("z >= 5").select("sheet_id", (F.col("r") % 100).alias("row_end"), (F.col("k") % 20).alias("column_end"))
    return grid.extent(dimensions, rows.where("z < 3").select("sheet_id", F.col("r").alias("row_index"), F.col("k").alias("column_index")), rows.where("z IN (3, 4)"))


@query(
    "visible_merges",
    """WITH m AS (SELECT CAST(o_orderkey // 500 AS VARCHAR) AS sheet_id, o_orderkey AS merge_id, o_orderkey % 500 + 1 AS a, o_custkey % 60 + 1 AS b, o_orderkey % 500 + 1 + o_custkey % 3 AS c, o_custkey % 60 + 1 + o_orderkey % 4 AS d FROM orders),
r AS (SELECT sheet_id, merge_id, count(*) AS n, min(i) AS first FROM m, unnest(range(a, c + 1)) AS t(i) WHERE i % 4 <> 1 AND i <= 520 GROUP BY ALL), k AS (SELECT sheet_id, merge_id, count(*) AS n, min(i) AS first FROM m, unnest(range(b, d + 1)) AS t(i) WHERE i % 3 <> 0 AND i <= 70 GROUP BY ALL)
SELECT r.sheet_id, r.merge_id, CAST(r.first AS INT) AS row_index, CAST(k.first AS INT) AS column_index, CAST(r.n AS INT) AS row_span, CAST(k.n AS INT) AS column_span FROM r JOIN k USING (sheet_id, merge_id)""",
)
def visible_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QR-VISIBLE: merges on the rows and columns that show; every fourth row and every third column is hidden."""
    merged = order_merges(spark, sf_dir)
    sheets = merged.select("sheet_id").distinct()
    shown = lambda last: sheets.select("sheet_id", F.explode(F.sequence(F.lit(1), F.lit(last))).alias("idx"))
    return grid.visible_merges(merged, shown(520).where("idx % 4 <> 1"), shown(70).where("idx % 3 <> 0"))


# Events as blocks: errors are rendered breaks, every seventh has an explicit one (every 14th nothing else), every 19th ends a section, every 23rd is a table with breaks before its first and third row.
@query(
    "page_starts",
    """WITH RECURSIVE b AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_type = 'error' AS rendered, event_id % 7 = 0 AS explicit, event_id % 14 = 0 AS alone, event_id % 19 = 0 AS section, event_id % 23 = 0 AND event_id % 14 > 0 AS tab FROM events),
f(user_id, n, event_id, page, filled, said, place) AS (SELECT DISTINCT user_id, 0::BIGINT, -1::BIGINT, 0, FALSE, FALSE, NULL::INT FROM b
  UNION ALL SELECT user_id, n, event_id, page3 + (filled3 AND after)::INT, CASE WHEN after THEN FALSE ELSE filled3 END, alone OR explicit AND NOT section, CASE WHEN NOT alone THEN CASE WHEN tab THEN page3 - 1 ELSE page3 END END FROM (
    SELECT *, alone OR explicit OR section AS after, CASE WHEN alone THEN page2 WHEN tab THEN page2 + filled2::INT + 1 ELSE page2 END AS page3, CASE WHEN alone THEN filled2 ELSE TRUE END AS filled3 FROM (
      SELECT *, page + (filled AND cut)::INT AS page2, filled AND NOT cut AS filled2 FROM (
        SELECT b.*, f.page, f.filled, b.rendered AND NOT b.tab AND NOT f.said AS cut FROM f JOIN b ON b.user_id = f.user_id AND b.n = f.n + 1))))
SELECT user_id, event_id, CAST(place AS INT) AS page FROM f WHERE n > 0""",
)
def page_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-PAGEBREAK: where pages begin by explicit and rendered breaks, sections and rows of tables, doubles counted once."""
    key = F.col("event_id")
    tab = (key % 23 == 0) & (key % 14 > 0)
    blocks = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("rendered"), (key % 7 == 0).alias("explicit"), (key % 14 == 0).alias("alone"), (key % 19 == 0).alias("section"), F.when(tab, F.array(F.lit(0), F.lit(2))).alias("table_breaks"))
    return documents.page_starts(blocks, "user_id", "event_id").select("user_id", "event_id", "page")


@query(
    "object_stats",
    """WITH b AS (SELECT DISTINCT l_suppkey AS doc, l_orderkey AS id FROM lineitem), i AS (SELECT l_suppkey AS doc, count(DISTINCT l_partkey) AS images, count(DISTINCT CASE WHEN l_quantity < 10 THEN l_orderkey % 50 END) AS drawings FROM lineitem GROUP BY l_suppkey)
SELECT doc, count(*) FILTER (id % 3 > 0) AS paragraphs, count(*) FILTER (id % 3 = 0) AS table_rows, CAST(sum(length(o_orderpriority)) AS BIGINT) AS text_length, count(*) FILTER (id % 5 = 0) AS outline_items, images, drawings FROM b JOIN orders ON o_orderkey = id JOIN i USING (doc) GROUP BY doc, images, drawings""",
)
def object_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-WORDSTATS: blocks counted once, distinct pictures and drawings: orders are blocks of their suppliers, parts pictures."""
    key = F.col("l_orderkey")
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), key == F.col("o_orderkey"))
    blocks = lines.select(
        F.col("l_suppkey").alias("doc"), key.alias("block_id"), F.when(key % 3 == 0, "table_row").otherwise("paragraph").alias("kind"), F.col("o_orderpriority").alias("text"), F.when(key % 5 == 0, 1).alias("outline_level"),
        F.array("l_partkey").alias("image_ids"), F.array(F.when(F.col("l_quantity") < 10, key % 50)).alias("drawing_ids"),
    )
    return documents.object_statistics(blocks, "doc")
