"""What several operators of this subpackage share: intermediate tables in the shared folder and connected components."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireframe.operators import lineage

#: Folders that were made in the shared folder and may still be there; see sweep().
WRITTEN: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used; it is not made yet."""
    WRITTEN.append(lineage.new_folder(spark, name))
    return WRITTEN[-1]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data; Spark opens the path, so any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store_of(uri: str):
    """(file system, path) by which a task opens a file of the shared folder itself."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


class Cut:
    """Cuts lineage: writes a DataFrame as Parquet into the shared folder and reads it again.

    A lost executor then costs no recomputation of what came before, and Spark knows the size of what it reads.
    drop() removes a table once a later one has been written from it.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, str] = {}

    def __call__(self, df: DataFrame, name: str, drop: tuple[DataFrame, ...] = (), level: int = 3) -> DataFrame:
        path = new_folder(self.spark, name)
        df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self._kept = [*getattr(self, "_kept", []), out]
        self.drop(*drop)
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if path := self.paths.pop(id(df), None):
                delete(self.spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared store."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def sweep(spark: SparkSession, since: int, keep: str) -> None:
    """Delete what has been written since WRITTEN had so many folders, but for one of them."""
    for path in WRITTEN[since:]:
        if path != keep:
            delete(spark, path)
    WRITTEN[since:] = [keep]


def components(edges: DataFrame, cut: Cut, rounds: int = 60) -> DataFrame:
    """Connected components of the links (a, b), both long: (node, component), component the smallest node reachable.

    Alternates two steps until nothing changes, which takes a number of rounds logarithmic in the nodes in practice:
    every larger neighbour of a node links to the node's smallest neighbour, then every smaller one does. Only minima
    meet at a node (combined before the shuffle), so a node with very many links is no hot group; the joins of links
    with minima read written tables, so that Spark can split their skewed partitions. Nodes come only from links;
    loops (a = b) give a component of one node. Null ends are ignored. Raises if rounds do not suffice.
    """
    now = cut(
        edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links",
    )
    before = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.col("n")).alias("m")), "least")
        large = cut(
            both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct(),
            "large", (least,),
        )
        least = cut(large.where("b <= a").groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")), "least")
        small = cut(
            large.where("b < a").join(least, F.col("a") == F.col("n")).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct(),
            "small", (least, large),
        )
        state = tuple(small.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        cut.drop(now)
        now = small
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")
