"""Tables that one call writes in the folder that all machines share, and removes when it is over."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset, a folder of its own on a local master alone, as in tests. A
    cluster must name a folder that all its machines share.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that Spark itself uses for it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, for what a call returns."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Written tables outlive lost executors and cut the lineage, as checkpoints do, and forget what the optimiser derived of
    sizes, which in loops of joins grows with every round."""

    def __init__(self, spark: SparkSession):
        self.spark, self.count = spark, 0
        self.path = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        remove(self.spark, self.path)

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        at = f"{self.path}/{self.count}"
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)
