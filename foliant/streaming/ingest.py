"""Incremental reading of a folder of tables or files: each run takes what has come since the last."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.sources.store import ChunkStore


def run_available(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Give every batch that is there now to work(batch, number), then stop. The checkpoint remembers what was read."""
    query = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def new_files(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files under path as a stream (path, modificationTime, length, content)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(path)


def ingest_stream(store: ChunkStore, stream: DataFrame, checkpoint: str, now: str, root: str = "", name: str = "files") -> None:
    """new_files() into the store, each batch one commit that bears its number: a batch that is given again changes nothing.

    root is cut off the front of paths. A file that comes again with another text takes the place of its rows.
    """

    def work(batch: DataFrame, number: int) -> None:
        path = F.regexp_replace(F.regexp_replace(F.col("path"), "^file:/*", "/"), f"^{root.rstrip('/')}/" if root else "^$", "")
        late = batch.groupBy(path.alias("doc_path")).agg(F.max_by(F.struct("content", "modificationTime"), F.struct("modificationTime", "length")).alias("x"))
        # not below zero, and the same whenever the batch is given
        rows = late.select("doc_path", X.source_type(F.col("doc_path")).alias("source_type"), F.decode("x.content", "UTF-8").alias("text"), F.col("x.modificationTime").cast("timestamp_ntz").alias("authored_at"), F.shiftrightunsigned(F.xxhash64("doc_path"), 1).alias("seq"))
        store.sync(rows, now, whole=False, batch=(name, number))

    run_available(stream, work, checkpoint)
