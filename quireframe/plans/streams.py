"""Queries that run as streams over what the tables have, and return what they have written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quireframe.functions import text as T
from quireframe.operators import documents, revisions
from quireframe.operators.lineage import cut, new_folder
from quireframe.plans.documents import HEIGHT_SQL, ITEMS_SQL, LINES_SQL, ROLE_SQL, outline_items
from quireframe.plans.registry import query, table
from quireframe.streaming import chunks
from quireframe.streaming import revisions as streams
from quireframe.streaming.pages import with_store


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream. The pattern stands for that name alone; a stream takes a single file only by a pattern."""
    path = f"{sf_dir}/[{name[0]}]{name[1:]}.parquet"
    return spark.readStream.schema(table(spark, sf_dir, name).schema).option("maxFilesPerTrigger", 64).parquet(path)


@query(
    "revision_stream",
    "SELECT user_id AS key, max(event_id) AS revision, arg_max(value, event_id) AS value FROM events GROUP BY user_id",
)
def revision_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM-STALE, SM-TWOREV, SO-ASSEMBLE: events as revisions; a key's last one is state, stale ones are dropped, the rest is a history."""
    rows = stream(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("revision"), "value")
    folder = new_folder(spark, "revisions")
    with with_store(spark):
        writer = chunks.newer(streams.progress(rows), ["key"]).writeStream.format("parquet").option("path", f"{folder}/history")
        writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return revisions.newest(spark.read.schema(rows.schema).parquet(f"{folder}/history"), ["key"])


# Chunks of users' documents in the order of events: errors fail a document, every 17th event ends one, clicks change nothing.
CHUNKS_SQL = """c AS (SELECT user_id AS doc, event_id, row_number() OVER (ORDER BY event_id) - 1 AS sequence, CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'error' WHEN event_id % 17 = 0 THEN 'complete' WHEN event_type = 'click' THEN 'progress' ELSE 'part' END AS kind, event_id % 10 AS rows FROM events),
e AS (SELECT doc, min(sequence) AS stop FROM c WHERE kind IN ('error', 'complete') GROUP BY doc),
k AS (SELECT c.*, stop FROM c LEFT JOIN e USING (doc) WHERE (stop IS NULL OR sequence <= stop) AND kind <> 'progress'),
s AS (SELECT doc, sequence, kind, CAST(count(*) FILTER (kind = 'part') OVER w AS BIGINT) AS parts, CAST(coalesce(sum(rows) FILTER (kind = 'part') OVER w, 0) AS BIGINT) AS rows FROM k WINDOW w AS (PARTITION BY doc ORDER BY sequence))"""


def event_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in one sequence over all users: (doc, sequence, kind, rows). Numbers come from a sort in ranges and counts of its partitions."""
    events = table(spark, sf_dir, "events")
    kind = F.when((F.col("event_type") == "error") & (F.col("event_id") % 3 == 0), "error").when(F.col("event_id") % 17 == 0, "complete").when(F.col("event_type") == "click", "progress").otherwise("part")
    rows = events.select(F.col("user_id").alias("doc"), "event_id", kind.alias("kind"), (F.col("event_id") % 10).alias("rows"))
    run = cut(rows.repartitionByRange("event_id").sortWithinPartitions("event_id").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    counts = run.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = counts.select(F.col("part").alias("of"), "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return run.join(starts, part == F.col("of")).select("doc", (F.col("at") - F.col("first") + F.col("before")).alias("sequence"), "kind", "rows")


@query(
    "chunk_stream",
    f"""WITH {CHUNKS_SQL} SELECT doc, sequence, parts, rows, CASE kind WHEN 'complete' THEN 'complete' WHEN 'error' THEN CASE WHEN parts > 0 THEN 'partial' ELSE 'failed' END ELSE 'loading' END AS status FROM s""",
)
def chunk_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM-CHUNKS, SM-PARTIAL, SO-ASSEMBLE: chunks in sequence as a source, a snapshot for each change, what has come stays after an error."""
    folder = new_folder(spark, "chunks")
    rows = event_chunks(spark, sf_dir)
    chunks.write_chunks(rows, f"{folder}/chunks", "sequence", 24)
    with with_store(spark):
        writer = chunks.snapshots(chunks.chunks(spark, f"{folder}/chunks", rows.schema), "doc").writeStream.format("parquet").option("path", f"{folder}/snapshots")
        writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(f"doc long, {chunks.SNAPSHOT}").parquet(f"{folder}/snapshots")


@query(
    "page_stream",
    rf"""WITH RECURSIVE {LINES_SQL}, r AS (SELECT doc_id, ord, text, {ROLE_SQL} AS role, regexp_replace(text, '[\x{{4e00}}-\x{{9fa5}}]', '', 'g') AS h FROM p),
t AS (SELECT *, CASE role WHEN 'title' THEN 22.0 WHEN 'heading' THEN 16.0 ELSE 14.0 END::DOUBLE AS font, CASE role WHEN 'title' THEN 1.45 WHEN 'heading' THEN 1.65 ELSE 1.8 END::DOUBLE AS high, CASE role WHEN 'title' THEN 18.0 WHEN 'heading' THEN 14.0 ELSE 12.0 END::DOUBLE AS aft FROM r),
z AS (SELECT doc_id, ord, {HEIGHT_SQL} AS b FROM (SELECT *, greatest(8, floor(554.0::DOUBLE / (font * 0.95::DOUBLE))) AS cap FROM t)),
f(doc_id, ord, used, page) AS (SELECT doc_id, ord, b, CAST(0 AS INT) FROM z WHERE ord = 0
  UNION ALL SELECT z.doc_id, z.ord, CASE WHEN f.used + z.b > 931 THEN z.b ELSE f.used + z.b END, CASE WHEN f.used + z.b > 931 THEN f.page + 1 ELSE f.page END FROM f JOIN z ON z.doc_id = f.doc_id AND z.ord = f.ord + 1)
SELECT doc_id, CAST(ord AS BIGINT) AS ord, page FROM f""",
)
def page_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM-QUEUE: blocks put on pages as they come, the place on the page kept as state."""
    blocks = documents.paragraphs(stream(spark, sf_dir, "documents"), "doc_id", "text")
    sized = blocks.select("doc_id", F.col("ord").cast("long").alias("ord"), T.paragraph_height(F.col("text"), T.role(F.col("text"), F.col("ord"))).alias("height"))
    folder = new_folder(spark, "pages")
    writer = streams.paginate(sized).writeStream.format("parquet").option("path", f"{folder}/pages").option("checkpointLocation", f"{folder}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("doc_id long, ord long, page int").parquet(f"{folder}/pages")


@query(
    "outline_stream",
    f"""WITH {ITEMS_SQL} SELECT a.book, CAST(a.ord - 1 AS BIGINT) AS ord, a.id, (SELECT arg_max(b.id, b.ord) FROM i b WHERE b.book = a.book AND b.ord < a.ord AND b.level < a.level) AS parent_id FROM i a""",
)
def outline_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM-OUTLINE, SM-PROGRESS: headings get their parents as they come, the open ones kept as state."""
    folder = new_folder(spark, "outline")
    items = outline_items(spark, sf_dir).select("book", (F.col("ord") - 1).cast("long").alias("ord"), "level", "id")
    items.write.parquet(f"{folder}/items")
    rows = spark.readStream.schema(items.schema).option("maxFilesPerTrigger", 64).parquet(f"{folder}/items")
    writer = streams.outline(rows, "book").writeStream.format("parquet").option("path", f"{folder}/tree").option("checkpointLocation", f"{folder}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("book long, ord long, id long, parent_id long").parquet(f"{folder}/tree")
