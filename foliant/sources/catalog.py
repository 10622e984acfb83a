"""The chunk table and its manifest as versioned Parquet folders behind a pointer."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.operators import chunking, curation, models

from .corpus import CHUNK_SCHEMA
from .pointer import Pointer
from .scratch import written

#: A text's vector, and a line about a chunk from its document and its text.
Embedder = Callable[[Column], Column]
Context = Callable[[Column, Column], Column]


class VersionedTable:
    """Each write makes a whole new folder and then moves the pointer; readers of the old one are not disturbed.

    The folder may lie in any store that Spark's file systems reach. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.pointer = spark, Pointer(spark, path)
        self.path = self.pointer.path

    def version(self) -> int:
        found = self.pointer.read()
        return found["version"] if found else 0

    def read(self) -> DataFrame | None:
        found = self.pointer.read()
        return self.spark.read.parquet(f"{self.path}/{found['folders'][0]}") if found else None

    def write(self, df: DataFrame) -> int:
        version, folder = self.version() + 1, uuid.uuid4().hex
        df.write.parquet(f"{self.path}/{folder}")
        self.pointer.commit({"version": version, "folders": [folder]})
        return version

    def append(self, df: DataFrame) -> int:
        """A new version with df's rows behind the present ones."""
        present = self.read()
        return self.write(df if present is None else present.unionByName(df))

    def compact(self, files: int) -> int:
        """A new version of the same rows in about so many files."""
        return self.write(self.read().repartition(files))

    def clean_up(self, older_than_seconds: float = 86_400.0) -> int:
        """Delete versions that neither pointer names and that were written before; a day keeps long readers safe. Returns how many."""
        return self.pointer.clean_up(older_than_seconds=older_than_seconds)

    def health(self) -> dict[str, int]:
        """Versions kept, and files and rows of the current one."""
        df = self.read()
        kept = sum(status.isDirectory() for status in self.pointer.files.listStatus(self.pointer.at("")))
        if df is None:
            return {"versions": kept, "files": 0, "rows": 0}
        row = df.agg(F.count("*").alias("rows")).first()
        return {"versions": kept, "files": len(df.inputFiles()), "rows": row["rows"]}


def chunk_rows(files: DataFrame, created_at: str, version: str = "1.0.0", embedder: Embedder = models.embed, context: Context | None = None) -> DataFrame:
    """files (doc_path, source_type, text, authored_at, seq) -> rows of the chunk table before dedup, with their seq.

    Session texts are scrubbed first. With a context function, its line stands above each chunk's text before that is hashed and embedded.
    """
    scrub = F.when(F.col("source_type") == "session", X.scrubbed(F.col("text"))).otherwise(F.col("text"))
    clean = files.withColumn("text", scrub)
    cut = chunking.chunks(clean)
    if context is not None:
        cut = models.contextualised(cut, clean, context).withColumn("content_hash", X.content_hash(F.col("text")))
    return cut.select(
        X.chunk_key(F.col("doc_path"), F.col("chunk_index"), F.col("content_hash")).alias("chunk_id"),
        X.document_key(F.col("doc_path")).alias("doc_id"),
        "doc_path",
        F.lit(0).alias("tier"),
        F.array().cast("array<string>").alias("parent_id"),
        F.lit("").alias("cluster_id"),
        "text",
        embedder(F.col("text")).alias("vector"),
        "heading",
        "chunk_index",
        "char_start",
        "char_end",
        "token_count",
        "content_hash",
        "source_type",
        F.lit(0).alias("retrieval_count"),
        F.lit(created_at).cast("timestamp_ntz").alias("created_at"),
        F.col("authored_at").cast("timestamp_ntz").alias("authored_at"),
        F.lit(version).alias("pipeline_version"),
        "seq",
    )


def digests(files: DataFrame) -> DataFrame:
    """files (doc_path, text, …) with content_hash instead of text, written once: all that diffs, manifests and outcomes need of a text.

    Files are dealt by their path, for a table's files may hold very many in one row group, which is one task's.
    """
    rest = [c for c in files.columns if c != "text"]
    return written(files.select(*rest, "text").repartition("doc_path").select(*rest, X.content_hash(F.col("text")).alias("content_hash")), "digests")


def _digest(files: DataFrame) -> Column:
    """The hash of a file: that of digests(), or else its text's."""
    return F.col("content_hash") if "content_hash" in files.columns else X.content_hash(F.col("text"))


def sync(files: DataFrame, manifest: DataFrame, stored: DataFrame | None, created_at: str, embedder: Embedder = models.embed, context: Context | None = None, hashed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """files (doc_path, source_type, text, authored_at, seq), manifest (path, content_hash), stored chunks -> (chunks, statuses).

    Deleted and modified documents lose their rows before the new and modified ones come in,
    so a renamed file is no copy of itself. A backslash in a path counts as a slash, on every side.
    hashed: digests() of the files, if they are there. Statuses and the new files' chunks are written on the way, so each is made once.
    """
    files = files.withColumn("doc_path", X.slashes(F.col("doc_path")))
    stored = stored if stored is None else stored.withColumn("doc_path", X.slashes(F.col("doc_path")))
    hashed = digests(files.select("doc_path", "text")) if hashed is None else hashed
    status = written(curation.diff(hashed.select(F.col("doc_path").alias("path"), "content_hash"), manifest), "statuses")
    gone = status.where("status in ('deleted', 'modified', 'new')").select("path")
    left = curation.without_paths(stored, gone) if stored is not None else None
    wanted = files.join(status.where("status in ('new', 'modified')").select(F.col("path").alias("doc_path")), "doc_path", "left_semi")
    rows = written(chunk_rows(wanted, created_at, embedder=embedder, context=context), "rows")
    fresh = curation.with_donors(rows, left).where("kept").select(*CHUNK_SCHEMA.names)
    return (fresh if left is None else left.unionByName(fresh)), status


def tier_counts(chunks: DataFrame) -> DataFrame:
    """(tier, n_rows, n_docs) of a chunk table."""
    return chunks.groupBy("tier").agg(F.count("*").alias("n_rows"), F.countDistinct("doc_path").alias("n_docs"))


def without_summaries(chunks: DataFrame) -> DataFrame:
    """The chunk table without its cluster summaries."""
    return chunks.where("tier <> 1")


def sync_manifest(files: DataFrame, manifest: DataFrame, chunks: DataFrame, statuses: DataFrame, now: str) -> DataFrame:
    """The manifest after sync(): (path, content_hash, chunk_count, ingested_at, updated_at, retrieval_count).

    manifest: the one before, whose times and counts stay where a file is unchanged; a file that was
    modified keeps its first ingest. Deleted files and files without a chunk of their own are left out. files: as for sync(), or their digests().
    """
    counted = chunks.where("tier = 0").groupBy(F.col("doc_path").alias("path")).agg(F.count("*").cast("int").alias("chunk_count"))
    hashed = files.select(X.slashes(F.col("doc_path")).alias("path"), _digest(files).alias("content_hash"))
    before = manifest.select(X.slashes(F.col("path")).alias("path"), *[(F.col(c) if c in manifest.columns else F.lit(None).cast(kind)).alias(f"old_{c}") for c, kind in (("ingested_at", "string"), ("updated_at", "string"), ("retrieval_count", "int"))])
    joined = hashed.join(counted, "path").join(statuses, "path").join(before, "path", "left")
    same = F.col("status") == "unchanged"
    return joined.select(
        "path",
        "content_hash",
        "chunk_count",
        F.coalesce("old_ingested_at", F.lit(now)).alias("ingested_at"),
        F.when(same, F.coalesce("old_updated_at", F.lit(now))).otherwise(now).alias("updated_at"),
        F.coalesce("old_retrieval_count", F.lit(0)).alias("retrieval_count"),
    )


def without_files(chunks: DataFrame, manifest: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """chunks and manifest without the documents named by paths (path): both or neither lose a file."""
    return curation.without_paths(chunks, paths), manifest.join(paths.select("path").distinct(), "path", "left_anti")


def file_statuses(files: DataFrame, statuses: DataFrame, chunks: DataFrame) -> DataFrame:
    """sync()'s outcome for each file: (path, status, chunks): ingested, all_chunks_duplicate, empty, unchanged, pruned or error.

    A file that could not be read has a null text and is an error. files: as for sync(), or their digests().
    """
    counted = chunks.where("tier = 0").groupBy(F.col("doc_path").alias("path")).agg(F.count("*").alias("chunks"))
    texts = files.select(X.slashes(F.col("doc_path")).alias("path"), _digest(files).alias("digest"))
    texts = texts.select("path", F.col("digest").isNull().alias("unread"), (F.col("digest") == X.content_hash(F.lit(""))).alias("blank"))
    joined = statuses.join(counted, "path", "left").join(texts, "path", "left")
    outcome = F.when(F.col("status") == "deleted", "pruned").when(F.col("unread"), "error").when(F.col("status") == "unchanged", "unchanged").when(F.col("blank"), "empty").when(F.col("chunks") > 0, "ingested").otherwise("all_chunks_duplicate")
    return joined.select("path", outcome.alias("status"), F.when(F.col("status") == "deleted", 0).otherwise(F.coalesce("chunks", F.lit(0))).alias("chunks"))


def sync_report(outcomes: DataFrame, statuses: DataFrame, pending: DataFrame, threshold: int = 5) -> DataFrame:
    """One row: scanned, ingested, skipped, pruned, new, modified, unchanged, errors, error_details (ten paths at most), pending, hint."""
    of = lambda c, *values: F.count_if(F.col(c).isin(*values))
    counts = outcomes.agg(
        F.count_if(F.col("status") != "pruned").alias("scanned"), of("status", "ingested").alias("ingested"), of("status", "all_chunks_duplicate", "empty").alias("skipped"), of("status", "pruned").alias("pruned"), of("status", "error").alias("errors"),
    )
    first = outcomes.where("status = 'error'").select("path").orderBy("path").limit(10).agg(F.array_sort(F.collect_list("path")).alias("error_details"))
    changes = statuses.agg(of("status", "new").alias("new"), of("status", "modified").alias("modified"), of("status", "unchanged").alias("unchanged"))
    ripe = F.array_join(F.array_sort(F.collect_list(F.when(F.col("pending") >= threshold, F.col("project")))), ", ")
    waiting = pending.agg(F.coalesce(F.sum("pending"), F.lit(0)).alias("pending"), F.nullif(ripe, F.lit("")).alias("ripe"))
    hint = F.concat("ripe", F.lit(f" have {threshold}+ pending session captures — consider consolidating them into memory notes"))
    return counts.crossJoin(first).crossJoin(changes).crossJoin(waiting).withColumn("hint", hint).drop("ripe")  # one row each
