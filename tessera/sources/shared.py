"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, a local session gets one of its own, and on a cluster it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tessera-shared-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "part") -> DataFrame:
    """df as a Parquet table in the shared folder, read again: what made it isn't run twice, and a lost executor repeats one stage."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def files_of(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Bytes, number and last modification of the files below a path: they differ where its data do."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    held = fs.getContentSummary(target)
    return held.getLength(), held.getFileCount(), max([fs.getFileStatus(target).getModificationTime(), *(s.getModificationTime() for s in fs.listStatus(target))])
