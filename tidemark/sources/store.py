"""Keyed tables on Parquet, and small reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyedTable:
    """A table with one row a key, as Parquet versions in a folder that all executors share.

    Each write makes a new version beside the last and then names it current, so that readers of the old one, and
    writes that fail, are not harmed. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str):
        self.spark, self.path, self.key, self.schema = spark, path.rstrip("/"), key, schema

    def _current(self) -> str | None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return None
        done = [str(f.getPath().getName()) for f in fs.listStatus(root) if str(f.getPath().getName()).startswith("v")]
        done = [v for v in done if fs.exists(hadoop.Path(f"{self.path}/{v}/_SUCCESS"))]
        return max(done, default=None)

    def read(self) -> DataFrame:
        now = self._current()
        if now is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{now}")

    def _write(self, df: DataFrame) -> None:
        number = int((self._current() or "v0000000-")[1:8]) + 1
        df.write.parquet(f"{self.path}/v{number:07d}-{uuid.uuid4().hex}")

    def put(self, rows: DataFrame) -> None:
        """Rows in place of those of the same key, of repeated keys one."""
        new = rows.dropDuplicates([self.key])
        self._write(self.read().join(new.select(self.key), self.key, "left_anti").unionByName(new.select(self.read().columns)))

    def get(self, key: object) -> DataFrame:
        return self.where(F.col(self.key) == F.lit(key))

    def where(self, condition: Column) -> DataFrame:
        """Rows for which a condition holds; it reaches the scan."""
        return self.read().where(condition)

    def delete(self, keys: DataFrame) -> None:
        self._write(self.read().join(keys.select(self.key), self.key, "left_anti"))

    def clear(self) -> None:
        self._write(self.read().limit(0))


def write_version(df: DataFrame, path: str, number: int) -> None:
    """Version ``number`` of a table at ``path``; written again, it takes its own place."""
    df.write.mode("overwrite").parquet(f"{path}/batch-{number:012d}")


def latest_version(spark: SparkSession, path: str, below: int | None = None) -> int | None:
    """The last whole version at ``path``, or the last below a number; None if there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [str(f.getPath().getName()) for f in fs.listStatus(root)] if fs.exists(root) else []
    numbers = [int(n.removeprefix("batch-")) for n in names if n.startswith("batch-") and fs.exists(hadoop.Path(f"{path}/{n}/_SUCCESS"))]
    return max((n for n in numbers if below is None or n < below), default=None)


def read_version(spark: SparkSession, path: str, number: int) -> DataFrame:
    return spark.read.parquet(f"{path}/batch-{number:012d}")


def read_files(expected: DataFrame, path: str) -> DataFrame:
    """``expected`` (name, ...) with status and content of the files of those names; missing and empty ones ``failed``."""
    df = expected.sparkSession.read.format("binaryFile").load(path)
    files = df.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    status = F.when(F.col("content").isNull(), "failed").otherwise("changed")
    return expected.join(files, "name", "left").withColumn("status", status)


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A report's few rows as a markdown table; more than ``most`` are an error, as nobody would read them."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"| {' | '.join(df.columns)} |", f"|{' --- |' * len(df.columns)}"]
    return "\n".join([*lines, *(f"| {' | '.join(map(cell, r))} |" for r in rows)]) + "\n"
