"""Sources' chunks as a stream: each batch is merged into a stored index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import apply_batch, with_hashes
from ..sources.store import latest_version, read_version, write_version


def ingest_stream(chunks: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Merges batches of chunks (source, section, text, fetched) into the index at ``path``, a version a batch.

    A batch that is tried again writes its own version anew from the version before it, so that it counts once. Chunks
    that are there already are only touched.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        new = with_hashes(batch.persist())
        before = latest_version(spark, path, below=number)
        index = new.where("false") if before is None else read_version(spark, path, before)
        out, _ = apply_batch(index, new.drop("fetched"), F.lit(batch.agg(F.max("fetched")).first()[0]))
        write_version(out, path, number)
        batch.unpersist()

    return chunks.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
