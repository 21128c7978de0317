from pyspark.sql import functions as F

from quireframe.functions import text as T
from quireframe.operators import documents, revisions
from quireframe.streaming import chunks
from quireframe.streaming import revisions as streams
from quireframe.streaming.pages import with_store


def stream_of(spark, tmp_path, name, df, files, order):
    """A stream of df's rows, a file a batch, in a given order of rows."""
    for i in range(files):
        df.where(F.pmod(F.xxhash64(*order), F.lit(files)) == i).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))


def run(query):
    query.processAllAvailable()
    query.stop()


def test_newest_and_upsert(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("key"), F.col("event_id").alias("revision"), "value")
    want = sorted(map(tuple, revisions.newest(rows, ["key"]).collect()))
    stream = stream_of(spark, tmp_path, "rows", rows, 4, ["revision"])
    run(streams.newest(stream, ["key"]).writeStream.outputMode("complete").format("memory").queryName("newest_rows").option("checkpointLocation", str(tmp_path / "c1")).start())
    assert sorted(map(tuple, spark.table("newest_rows").collect())) == want
    with with_store(spark):
        run(chunks.newer(stream, ["key"]).writeStream.format("memory").queryName("history").option("checkpointLocation", str(tmp_path / "c2")).start())
    history = spark.table("history")
    assert sorted(map(tuple, revisions.newest(history, ["key"]).collect())) == want
    assert history.count() == history.select("key", "revision").distinct().count() <= rows.count()


def test_stale_and_repeated_revisions_are_dropped(spark, tmp_path):
    batches = [[(1, 5, "a"), (1, 7, "b"), (1, 7, "again"), (2, 1, "x")], [(1, 6, "stale"), (1, 7, "stale"), (2, 2, "y")], [(1, 9, "c")]]
    for i, own in enumerate(batches):
        spark.createDataFrame(own, "key long, revision long, value string").coalesce(1).write.mode("append").parquet(str(tmp_path / "rows"))
    stream = spark.readStream.schema("key long, revision long, value string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "rows"))
    with with_store(spark):
        run(chunks.newer(stream, ["key"]).writeStream.format("memory").queryName("accepted").option("checkpointLocation", str(tmp_path / "c")).start())
    assert sorted(map(tuple, spark.table("accepted").collect())) == [(1, 5, "a"), (1, 7, "b"), (1, 9, "c"), (2, 1, "x"), (2, 2, "y")]


def test_chunks_wait_for_a_gap_and_go_on_after_a_restart(spark, tmp_path):
    rows = spark.createDataFrame([("d", i, "part", 1) for i in range(4)] + [("d", 4, "error", 0), ("d", 5, "part", 9), ("e", 6, "error", 0), ("f", 7, "part", 2), ("f", 8, "complete", 0), ("f", 9, "part", 5)], "doc string, sequence long, kind string, rows int")
    chunks.write_chunks(rows, f"file://{tmp_path}/chunks", "sequence", 5)
    late = (tmp_path / "chunks" / "00000002.parquet").rename(tmp_path / "late")

    def go():
        with with_store(spark):
            stream = chunks.snapshots(chunks.chunks(spark, f"file://{tmp_path}/chunks", rows.schema), "doc")
            stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))

    first = [("d", i, i + 1, i + 1, "loading") for i in range(4)]
    assert go() == first
    late.rename(tmp_path / "chunks" / "00000002.parquet")
    assert go() == [*first, ("d", 4, 4, 4, "partial"), ("e", 6, 0, 0, "failed"), ("f", 7, 1, 2, "loading"), ("f", 8, 1, 2, "complete")]


def test_pages_in_any_order(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 40")
    whole = documents.pages(docs, "doc_id", "text")
    p = documents.paragraphs(docs, "doc_id", "text")
    blocks = p.select("doc_id", F.col("ord").cast("long").alias("ord"), T.paragraph_height(F.col("text"), T.role(F.col("text"), F.col("ord"))).alias("height"))
    stream = stream_of(spark, tmp_path, "blocks", blocks.unionByName(blocks.where("ord = 1")), 3, ["doc_id", "ord"])
    run(streams.paginate(stream).writeStream.outputMode("append").format("memory").queryName("paged").option("checkpointLocation", str(tmp_path / "c3")).start())
    assert sorted(map(tuple, spark.table("paged").collect())) == sorted(map(tuple, whole.select("doc_id", F.col("ord").cast("long"), "page").collect()))
