"""Row counts by source type, kept up to date from a growing table of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.sources.corpus import document_path
from foliant.sources.scratch import fresh_path

from .ingest import run_available


def streamed_stats(spark: SparkSession, path: str) -> DataFrame:
    """(source_type, n_rows) of the Parquet table at path, each batch's counts written once and summed at the end.

    State lies in the shared folder of scratch.shared_dir().
    """
    state = fresh_path(spark, "stream")
    kind = X.source_type(document_path(F.col("source"), F.col("doc_id")))

    def count(batch: DataFrame, number: int) -> None:
        batch.select(kind.alias("source_type")).groupBy("source_type").agg(F.count("*").alias("n_rows")).write.mode("overwrite").parquet(f"{state}/counts/batch={number}")

    schema = spark.read.parquet(path).schema
    # a table may be one file: its folder is streamed, and only names like the table's (or its part files) are taken
    folder, _, name = path.rstrip("/").rpartition("/")
    single = spark.read.format("binaryFile").load(path).select("path").limit(2).collect()
    one = len(single) == 1 and single[0]["path"].rstrip("/").endswith(f"/{name}")
    stream = spark.readStream.schema(schema)
    run_available(stream.option("pathGlobFilter", name).parquet(folder) if one else stream.parquet(path), count, f"{state}/checkpoint")
    return spark.read.schema("source_type string, n_rows long").parquet(f"{state}/counts").groupBy("source_type").agg(F.sum("n_rows").alias("n_rows"))
