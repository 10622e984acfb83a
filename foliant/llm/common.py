"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Keys that are broadcast at most when rows are dropped (some 100 bytes each in a task's hash table), and bytes of what is broadcast with keys.
BROADCAST_KEYS, BROADCAST_BYTES = 1_000_000, 32_000_000


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor see, named by spark.checkpoint.dir.

    Where the setting is absent, a local master may use the context's own checkpoint folder; a cluster must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/foliant-checkpoints"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df once to the shared folder and continue from the written table.

    This cuts lineage with files that outlive any executor. Compression is zstd, for
    these tables are read once or twice only. A result may still read them after the call
    that staged them returns, so they stay until discard() or the cluster's own clean-up.
    """
    path = f"{shared_dir(df.sparkSession)}/foliant/{uuid.uuid4().hex}/{name}"
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Eager checkpoint of a small frame."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def text_bytes(column: str = "text") -> Column:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def width(df: DataFrame) -> int:
    """Shuffle partitions of the session, at least one per core."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def discard(staged: DataFrame) -> None:
    """Delete a staged table that nothing will read again."""
    for path in {f.rpartition("/")[0] for f in staged.inputFiles()}:
        if "/foliant/" in path:
            jvm = staged.sparkSession.sparkContext._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(staged.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name = f"_{name}"
    return name


def text_hash() -> Column:
    return F.xxhash64(text_bytes())


def keyed(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with two more columns, whose names it does not have: doc_id as a number, and a hash of text; together they name a document."""
    number, digest = free_name(docs, "key_id"), free_name(docs, "key_text")
    return docs.withColumns({number: F.col("doc_id").cast("long"), digest: text_hash()}), number, digest


def joined_rows(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """docs joined with keys (doc_id, text_hash, and more): 'left_semi', 'left_anti' or 'inner'; columns of docs, then the others of keys.

    Null ids match each other. Up to BROADCAST_KEYS keys, and with 'inner' BROADCAST_BYTES of what comes with them, are broadcast, so whole texts are not
    shuffled; beyond that both sides are, and a join's large partitions are left to be split by AQE.
    keys should be staged, for they are counted first.
    """
    marked, number, digest = keyed(docs)
    names = {c: free_name(marked, f"of_{c}") for c in ("doc_id", "text_hash")}
    side = keys.withColumnsRenamed(names)
    if how != "inner":
        side = side.select(*names.values()).distinct()
    small = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    if small and how == "inner":  # what comes with the keys may be of any length
        small = (side.agg(F.sum(F.length(F.to_json(F.struct(F.lit(0), *side.columns)))).alias("n")).first()["n"] or 0) <= BROADCAST_BYTES
    if small:
        side = F.broadcast(side)
    out = marked.join(side, marked[number].eqNullSafe(side[names["doc_id"]]) & (marked[digest] == side[names["text_hash"]]), how)
    return out.drop(number, digest, *names.values())
