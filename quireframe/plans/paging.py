"""Queries of documents on pages over the test tables: a customer is a document, its orders blocks, their lines table rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireframe.operators import paging
from quireframe.operators.lineage import new_folder
from quireframe.plans.registry import query, table
from quireframe.streaming import pages as page_streams

CONTENT, WIDTH = 500.0, 554.0


def order_blocks(spark: SparkSession, sf_dir: str, images: bool) -> DataFrame:
    """(doc, ord, ...): the kind of an order's block by its key, its heights by the key and its lines."""
    key = F.col("o_orderkey")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("l"))
    orders = table(spark, sf_dir, "orders").join(lines, key == F.col("l_orderkey"), "left")
    place = F.row_number().over(paging.Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    n = key % 10
    kind = F.when(n.isin(0, 1), "heading").when(n == 2, "title").when(n.isin(3, 4, 5) & F.col("l").isNotNull(), "table").when(F.lit(images) & n.isin(6, 7), "image").otherwise("paragraph")
    orders = orders.select(F.col("o_custkey").alias("doc"), place.cast("long").alias("ord"), key.alias("id"), kind.alias("kind"), "l", (key % 7 * 20.0).alias("lead"), (20.0 * (1 + key % 6)).alias("own"))
    image, is_table = F.col("kind") == "image", F.col("kind") == "table"
    return orders.select(
        "doc", "ord", "id", "kind", (F.col("id") % 10 == 9).alias("break_before"), (F.col("id") % 60).cast("int").alias("solid"),
        F.when(image, F.col("own") * 5).otherwise(F.col("own") + F.col("lead")).alias("height"), (F.col("lead") + 20.0).alias("leading"), F.when(image, 0.0).otherwise(F.col("lead")).alias("lead"),
        F.lit(16.0).alias("after"), F.when(image, F.col("id") % 11 * 60.0).alias("width"), F.when(F.col("id") % 3 == 0, "center").alias("align"),
        F.when(is_table, F.transform("l", lambda x: x["l_quantity"] * 2 + 20)).alias("rows"),
    )


# Blocks; their rows as items; what a heading or a caption has to fit with (keep); then item by item. state: page, used,
# filled; of a table that is split also part, rows' height so far (grown) and room.
PAGED_SQL = """
WITH RECURSIVE b AS (SELECT o_custkey AS doc, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT) AS ord, o_orderkey AS id,
    CASE WHEN o_orderkey % 10 IN (0, 1) THEN 'heading' WHEN o_orderkey % 10 = 2 THEN 'title' WHEN o_orderkey % 10 IN (3, 4, 5) AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) THEN 'table' ELSE 'paragraph' END AS kind,
    o_orderkey % 10 = 9 AS brk, o_orderkey % 60 AS solid, (o_orderkey % 7 * 20.0)::DOUBLE AS lead, (20.0 * (1 + o_orderkey % 6))::DOUBLE AS own FROM orders),
r AS (SELECT l_orderkey AS id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) - 1 AS INT) AS r, l_quantity * 2 + 20 AS h FROM lineitem),
s AS (SELECT id, count(*) AS n, sum(h) AS h, sum(h) FILTER (r < 2) AS h2 FROM r GROUP BY id),
t AS (SELECT b.*, coalesce(s.n, 0) AS n, CASE WHEN kind = 'table' THEN lead + s.h + 16 ELSE own + lead END AS whole, CASE WHEN kind = 'table' THEN lead + s.h2 + 16 ELSE lead + 20 END AS beginning,
    kind = 'heading' AND NOT brk AS heads FROM b LEFT JOIN s ON s.id = b.id AND kind = 'table'),
u AS (SELECT *, sum(whole) OVER (PARTITION BY doc ORDER BY ord) AS upto, min(CASE WHEN NOT heads THEN ord END) OVER (PARTITION BY doc ORDER BY ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop FROM t),
k AS (SELECT u.*, CASE WHEN u.kind <> 'table' AND u.solid <= 40 AND a.kind = 'table' THEN CASE WHEN a.whole <= 500 THEN a.whole ELSE a.beginning END END AS table_keep,
    CASE WHEN u.heads AND z.ord IS NOT NULL THEN z.upto - z.whole - u.upto + u.whole + z.beginning END AS head_keep
  FROM u LEFT JOIN u a ON a.doc = u.doc AND a.ord = u.ord + 1 LEFT JOIN u z ON z.doc = u.doc AND z.ord = u.stop),
i AS (SELECT k.doc, k.ord, k.kind, k.brk, k.lead, k.whole, k.table_keep, k.head_keep, r.r, k.n, r.h, row_number() OVER (PARTITION BY k.doc ORDER BY k.ord, r.r) AS i FROM k LEFT JOIN r ON r.id = k.id AND k.kind = 'table'),
f(doc, i, ord, r, page, used, filled, mode, part, held, grown, room, more, shown) AS (
  SELECT DISTINCT doc, 0::BIGINT, -1::BIGINT, NULL::INT, 0, 0::DOUBLE, FALSE, 0, 0, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, FALSE FROM b
  UNION ALL
  SELECT doc, i, ord, r, page7, CASE WHEN mode7 = 2 THEN CASE WHEN last THEN used7 + held7 + grown7 + aft ELSE used7 END WHEN cont THEN used7 WHEN brk THEN 0 ELSE used7 + whole1 END, NOT brk, mode7, part7, held7, grown7, room7,
    CASE WHEN mode7 = 2 THEN h + aft + CASE WHEN NOT cont OR over THEN held7 ELSE 0 END WHEN cont THEN 0 ELSE whole1 END, NOT brk
  FROM (SELECT *, CASE WHEN mode7 = 2 AND last THEN least(16, greatest(0, room7 - grown7)) ELSE 0 END AS aft FROM (
    SELECT *, coalesce(r + 1 = n, FALSE) AS last, CASE WHEN cont THEN mode WHEN big THEN 2 WHEN kind = 'table' THEN 1 ELSE 0 END AS mode7, CASE WHEN cont THEN part + over::INT ELSE 0 END AS part7,
      CASE WHEN cont THEN page + over::INT ELSE page3 + g::INT END AS page7, CASE WHEN NOT cont THEN lead1 WHEN over THEN 0 ELSE held END AS held7, CASE WHEN NOT cont OR over THEN h ELSE grown + h END AS grown7,
      CASE WHEN NOT cont THEN room3 WHEN over THEN 500 ELSE room END AS room7, CASE WHEN cont AND over OR NOT cont AND g THEN 0 WHEN cont THEN used ELSE used3 END AS used7 FROM (
      SELECT *, greatest(0, 500 - used3 - lead1) AS room3, big AND filled3 AND used3 + lead1 + h > 500 AS g FROM (
        SELECT *, page2 + (e OR t)::INT AS page3, CASE WHEN e OR t THEN 0 ELSE used2 END AS used3, filled2 AND NOT e AND NOT t AS filled3 FROM (
          SELECT *, big AND filled2 AND 500 - used2 < 80 AS e, NOT brk AND kind <> 'table' AND filled2 AND used2 + whole1 > 500 AS t FROM (
            SELECT *, kind = 'table' AND (whole1 > 500 OR filled2 AND used2 + whole1 > 500) AS big FROM (
              SELECT *, page1 + c::INT AS page2, CASE WHEN c OR brk THEN 0 ELSE used1 END AS used2, filled1 AND NOT c AND NOT brk AS filled2 FROM (
                SELECT *, filled1 AND (brk OR coalesce(used1 + CASE WHEN table_keep IS NOT NULL THEN whole1 + table_keep ELSE head_keep END > 500, FALSE)) AS c FROM (
                  SELECT *, page + d::INT AS page1, CASE WHEN d THEN 0 ELSE used END AS used1, filled AND NOT d AS filled1, CASE WHEN d THEN 0 ELSE lead END AS lead1, CASE WHEN d THEN whole - lead ELSE whole END AS whole1 FROM (
                    SELECT x.*, f.page, f.used, f.filled, f.mode, f.part, f.held, f.grown, f.room, coalesce(x.r > 0, FALSE) AS cont, coalesce(x.r > 0 AND f.mode = 2 AND f.grown + x.h > f.room, FALSE) AS over,
                      x.lead > 0 AND f.filled AND x.lead >= 500 - f.used AS d FROM f JOIN i x ON x.doc = f.doc AND x.i = f.i + 1)))))))))))
SELECT doc, ord, CAST(part AS INT) AS piece, CAST(page AS INT) AS page, min(r) AS first_row, max(r) AS last_row, sum(more) AS height FROM f WHERE shown GROUP BY doc, ord, part, page"""


@query("paged_blocks", PAGED_SQL)
def paged_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-PAGINATE-DOC, QR-PAGES: blocks of customers' documents on pages, with breaks, spacing, headings, captions and split tables."""
    return paging.paged(order_blocks(spark, sf_dir, False), "doc", CONTENT, WIDTH)


@query("paged_images")
def paged_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-PAGINATE-DOC, WN-IMAGEROWS: the same with images, in rows and groups; its plain version is in the tests."""
    return paging.paged(order_blocks(spark, sf_dir, True), "doc", CONTENT, WIDTH)


@query(
    "paged_stream",
    PAGED_SQL,
)
def paged_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM-PAGESTATE, SM-QUEUE: the same blocks in any order as a stream, with what waits as keyed state."""
    folder = new_folder(spark, "blocks")
    blocks = order_blocks(spark, sf_dir, False).select("doc", "ord", *paging.NAMES)
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc")).agg(F.count("*").alias("ord"))
    ends = counts.withColumns({n: F.lit("end" if n == "kind" else None).cast(blocks.schema[n].dataType) for n in paging.NAMES})
    blocks.unionByName(ends).write.parquet(f"{folder}/blocks")
    rows = spark.readStream.schema(blocks.schema).option("maxFilesPerTrigger", 64).parquet(f"{folder}/blocks")
    with page_streams.with_store(spark):
        writer = page_streams.paged(rows, "doc", CONTENT, WIDTH).writeStream.format("parquet").option("path", f"{folder}/pages")
        writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(f"doc long, ord long, {paging.PIECE}").parquet(f"{folder}/pages")



# A customer's orders are a source page, an order's lines the lines of a paragraph or the rows of a table.
MEASURED_SQL = """
WITH RECURSIVE l AS (SELECT l_orderkey AS id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) - 1 AS INT) AS r, l_quantity * 2 AS h, count(*) OVER (PARTITION BY l_orderkey) AS n, sum(l_quantity * 2) OVER (PARTITION BY l_orderkey) AS whole FROM lineitem),
b AS (SELECT o_custkey AS doc, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT) AS ord, o_orderkey AS id, ['paragraph', 'table', 'image'][CAST(o_orderkey % 3 AS INT) + 1] AS kind FROM orders),
x AS (SELECT b.doc, b.ord, b.kind, coalesce(n, 0) AS n, r, h, coalesce(whole, 50) AS whole FROM b LEFT JOIN l ON l.id = b.id AND b.kind <> 'image'),
y AS (SELECT *, sum(CASE WHEN coalesce(r, 0) = 0 THEN whole ELSE 0 END) OVER (PARTITION BY doc) AS total, row_number() OVER (PARTITION BY doc ORDER BY ord, r) AS i FROM x),
f(doc, i, ord, r, page, used, filled, cut, high, part, grown, more, shown) AS (
  SELECT DISTINCT doc, 0::BIGINT, -1::BIGINT, NULL::INT, 0, 0::DOUBLE, FALSE, FALSE, FALSE, 0, 0::DOUBLE, 0::DOUBLE, FALSE FROM b
  UNION ALL
  SELECT doc, i, ord, CASE WHEN cut1 THEN r END, page2, CASE WHEN cut1 AND r + 1 = n THEN grown2 + CASE WHEN high2 THEN 0 ELSE used2 END WHEN cut1 OR cont THEN used2 ELSE used2 + whole END, TRUE, cut1, high2, part2, grown2, CASE WHEN cut1 THEN h ELSE whole END, cut1 OR NOT cont
  FROM (SELECT *, page + (over OR turn)::INT AS page2, CASE WHEN over OR turn AND NOT (cut1 AND kind = 'table') THEN 0 ELSE used END AS used2, CASE WHEN cont THEN high AND NOT over ELSE turn AND cut1 AND kind = 'table' END AS high2,
      CASE WHEN cont THEN part + over::INT ELSE 0 END AS part2, CASE WHEN cont AND NOT over THEN grown + h ELSE h END AS grown2 FROM (
    SELECT *, cut1 AND cont AND used + grown + h > 301 AS over, NOT cont AND filled AND used + CASE WHEN cut1 THEN h ELSE whole END > 301 AS turn FROM (
      SELECT x.*, f.page, f.used, f.filled, f.high, f.part, f.grown, coalesce(x.r > 0, FALSE) AS cont, CASE WHEN x.r > 0 THEN f.cut ELSE x.kind = 'paragraph' AND x.n > 1 AND f.used + x.whole > 301 OR x.kind = 'table' AND x.n > 0 AND x.whole > 180 END AS cut1
      FROM f JOIN y x ON x.doc = f.doc AND x.i = f.i + 1 WHERE total > 420))))
SELECT doc, ord, CAST(part AS INT) AS piece, CAST(page AS INT) AS page, min(r) AS first_line, max(r) AS last_line, sum(more) AS height FROM f WHERE shown GROUP BY doc, ord, part, page
UNION ALL SELECT doc, ord, 0, 0, NULL, NULL, whole FROM y WHERE total <= 420 AND coalesce(r, 0) = 0"""


@query("measured_parts", MEASURED_SQL)
def measured_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-PAGINATE-DOCX: measured blocks on pages, paragraphs split at ends of lines and tables between rows."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_quantity") * 2).alias("h")))).alias("l"))
    kind = F.element_at(F.array(F.lit("paragraph"), F.lit("table"), F.lit("image")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    place = F.row_number().over(paging.Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    blocks = orders.select(F.col("o_custkey").alias("doc"), place.cast("long").alias("ord"), kind.alias("kind"), "l")
    parts = F.when(F.col("kind") != "image", F.col("l.h"))
    height = F.coalesce(F.aggregate(parts, F.lit(0.0), lambda a, h: a + h), F.lit(50.0))
    blocks = blocks.select("doc", "ord", "kind", height.alias("height"), parts.alias("parts"), F.lit(None).cast("int").alias("original_rows"))
    return paging.measured(blocks, ["doc"], F.lit(300.0))


@query(
    "pages_of_blocks",
    f"""SELECT p.doc, p.ord, min(p.page) AS page, greatest(0, min(p.page) - 1) AS first, least(max(m.most), min(p.page) + 1) AS last FROM ({PAGED_SQL}) p JOIN (SELECT doc, max(page) AS most FROM ({PAGED_SQL}) GROUP BY doc) m USING (doc) WHERE p.ord % 3 = 1 GROUP BY p.doc, p.ord""",
)
def pages_of_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QR-PAGES: the page of a block that is looked for, and those around it."""
    blocks = order_blocks(spark, sf_dir, False)
    return paging.pages_near(paging.paged(blocks, "doc", CONTENT, WIDTH), blocks.where("ord % 3 = 1").select("doc", "ord"), "doc")
