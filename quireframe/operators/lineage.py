"""The shared folder, and cutting a plan's lineage with a checkpoint in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it is unset, a local session gets a temporary one.

    On a cluster, where no machine-local folder would do, a missing setting raises RuntimeError."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    if "://" in found:
        return found
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found)  # a path in the cluster's default store
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().replace("file:/", "file:///", 1)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used; it is not made yet."""
    return f"{shared_folder(spark)}/quire-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, checkpointed in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
