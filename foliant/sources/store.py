"""The chunk table and its manifest in buckets of doc_path, under one pointer.

A commit writes anew the buckets that it touches and no others, chunks and manifest together: readers see both as before or both
as after. Every row gets a number in the order it came, which never changes and is never given twice, so the last
rows are found without a sort of all. A stream's batch leaves its number in the commit, and the
same batch changes nothing when it comes again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions import text as X
from foliant.operators import curation, models, similarity

from . import catalog
from .corpus import CHUNK_SCHEMA
from .pointer import Pointer
from .scratch import written

#: Buckets of a store, and files of a bucket that one commit writes at most.
BUCKETS, SPLITS = 64, 2
#: A document's chunks that are compared with the rows that came last, how many of these, and from which similarity on a warning is given.
FIRST_CHUNKS, LAST_ROWS, NEAR, SHOWN = 3, 500, 0.9, 5
STORED = T.StructType([*CHUNK_SCHEMA.fields, T.StructField("ingest_seq", T.LongType())])
MANIFEST = T.StructType([T.StructField(n, T.StringType()) for n in ("path", "content_hash")] + [T.StructField("chunk_count", T.IntegerType()), T.StructField("ingested_at", T.StringType()), T.StructField("updated_at", T.StringType()), T.StructField("retrieval_count", T.IntegerType())])


class _StorePointer(Pointer):
    def folders(self, state: dict) -> set[str]:
        return {f"{kind}/{name}" for kind in ("chunks", "manifest") for name in state[kind].values()}


def numbered(rows: DataFrame, order: list[str], first: int) -> tuple[DataFrame, int]:
    """rows with ingest_seq, counted up from first in the given order, and the number after the last.

    Rows are dealt by ranges and numbered in their partition; only the partitions' counts come to the driver.
    """
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(width, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = written(dealt, "placed").withColumn("piece", F.shiftright("place", 33).cast("int"))
    offsets, following = [], first
    for r in placed.groupBy("piece").agg(F.count("*").alias("n"), F.min("place").alias("low")).orderBy("piece").collect():
        offsets.append((r["piece"], following - r["low"]))
        following += r["n"]
    sizes = rows.sparkSession.createDataFrame(offsets, "piece int, shift long")
    return placed.join(F.broadcast(sizes), "piece").withColumn("ingest_seq", F.col("place") + F.col("shift")).drop("piece", "place", "shift"), following


class ChunkStore:
    """One writer at a time; readers keep the version they began with until clean_up()."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.pointer = spark, _StorePointer(spark, path)
        self.path, self.buckets = self.pointer.path, self.state().get("buckets", buckets)

    def state(self) -> dict:
        """version, next (the number of the next row), batches (the last of each stream), and for each bucket its folder and greatest number."""
        return self.pointer.read() or {"version": 0, "next": 0, "batches": {}, "chunks": {}, "manifest": {}, "high": {}}

    def _bucket(self, path: Column) -> Column:
        return F.pmod(F.xxhash64(path), F.lit(self.buckets)).cast("int")

    def _read(self, kind: str, buckets: list[str] | None = None, state: dict | None = None) -> DataFrame:
        held, schema = (state or self.state())[kind], STORED if kind == "chunks" else MANIFEST
        folders = [f"{self.path}/{kind}/{name}" for b, name in sorted(held.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def chunks(self) -> DataFrame:
        return self._read("chunks")

    def manifest(self) -> DataFrame:
        return self._read("manifest")

    def _rewrite(self, kind: str, rows: DataFrame, path: str, order: str) -> dict[str, str]:
        """rows written by bucket in a new folder -> bucket: folder of those that have rows."""
        name, width = uuid.uuid4().hex, int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # a bucket is several tasks', and nothing is read twice for the sake of ranges; files are sorted, so row groups still tell their numbers
        dealt = rows.withColumn("bucket", self._bucket(F.col(path))).repartition(width, "bucket", F.pmod(F.hash(path), F.lit(SPLITS))).sortWithinPartitions("bucket", order)
        dealt.write.partitionBy("bucket").parquet(f"{self.path}/{kind}/{name}")
        made = [s.getPath().getName() for s in self.pointer.files.listStatus(self.pointer.at(f"{kind}/{name}")) if s.isDirectory()]
        return {b.removeprefix("bucket="): f"{name}/{b}" for b in made if b.startswith("bucket=")}

    def apply(self, fresh: DataFrame, gone: DataFrame, entries: DataFrame, order: list[str], batch: tuple[str, int] | None = None) -> int:
        """Commit: without the rows and entries of the documents in gone (path) and in entries, with fresh rows (of the chunk schema, and the order columns) and entries (of the manifest).

        Returns the version. batch (stream, number): nothing changes if that stream's number was committed before.
        """
        state = self.state()
        if batch is not None and state["batches"].get(batch[0], -1) >= batch[1]:
            return state["version"]
        fresh, following = numbered(fresh, order, state["next"])
        fresh, entries = fresh.select(*STORED.names), written(entries.select(*MANIFEST.names), "entries")
        paths = gone.select("path").unionByName(fresh.select(F.col("doc_path").alias("path"))).unionByName(entries.select("path"))
        touched = written(paths.distinct().withColumn("bucket", self._bucket(F.col("path"))), "touched")
        hit = sorted(str(r["bucket"]) for r in touched.select("bucket").distinct().collect())  # as many as there are buckets at most
        out = state | {"version": state["version"] + 1, "next": following, "buckets": self.buckets, "batches": state["batches"] | ({batch[0]: batch[1]} if batch else {})}
        for kind, rows, path, by in (("chunks", fresh, "doc_path", "ingest_seq"), ("manifest", entries, "path", "path")):
            left = self._read(kind, hit, state).join(touched.select(F.col("path").alias(path)), path, "left_anti").select(*rows.columns)
            kept = {b: name for b, name in state[kind].items() if b not in hit}
            out[kind] = kept | (self._rewrite(kind, left.unionByName(rows), path, by) if hit else {})
        high = self._read("chunks", hit, out).groupBy(self._bucket(F.col("doc_path")).alias("b")).agg(F.max("ingest_seq").alias("high")).collect() if hit else []
        out["high"] = {b: h for b, h in state["high"].items() if b not in hit} | {str(r["b"]): r["high"] for r in high}
        self.pointer.commit(out)
        return out["version"]

    def tail(self, n: int) -> DataFrame:
        """The n rows that came last. Buckets without a late row are not opened, and row groups are left out by their numbers."""
        state, reach = self.state(), 2 * n
        while True:
            low = max(0, state["next"] - reach)
            late = self._read("chunks", [b for b, h in state["high"].items() if h >= low], state).where(F.col("ingest_seq") >= low)
            if not low or late.limit(n).count() == n:
                return late.orderBy(F.desc("ingest_seq")).limit(n)
            reach *= 8

    def sync(self, files: DataFrame, now: str, embedder: catalog.Embedder = models.embed, context: catalog.Context | None = None, whole: bool = True, batch: tuple[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
        """files (doc_path, source_type, text, authored_at, seq) into the store -> (statuses, warnings).

        whole: files that are not there are deleted; otherwise they stay, as in a batch of a stream. warnings
        are near_warnings() of what came. Files whose text could not be read (null) keep the rows they have.
        """
        files = files.withColumn("doc_path", X.slashes(F.col("doc_path")))
        manifest = self.manifest()
        hashed = files.where("text is not null").select(F.col("doc_path").alias("path"), X.content_hash(F.col("text")).alias("content_hash"))
        status = curation.diff(hashed, manifest).join(files.where("text is null").select(F.col("doc_path").alias("path")), "path", "left_anti")
        status = written(status if whole else status.where("status <> 'deleted'"), "statuses")
        gone = status.where("status <> 'unchanged'").select("path")
        wanted = files.join(status.where("status in ('new', 'modified')").select(F.col("path").alias("doc_path")), "doc_path", "left_semi")
        left = curation.without_paths(self.chunks().select("doc_path", "content_hash", "source_type"), gone)
        rows = curation.with_donors(catalog.chunk_rows(wanted, now, embedder=embedder, context=context), left).where("kept")
        fresh = written(rows.select(*CHUNK_SCHEMA.names, "seq"), "chunks")
        entries = catalog.sync_manifest(wanted, manifest, fresh, status, now)
        warnings = written(self.near_warnings(fresh), "warnings")
        self.apply(fresh, gone, entries, ["seq", "chunk_index"], batch)
        return status, warnings

    def near_warnings(self, fresh: DataFrame, first: int = FIRST_CHUNKS, last: int = LAST_ROWS, least: float = NEAR, shown: int = SHOWN) -> DataFrame:
        """(doc_path, place, chunk_id, near_id, similarity): rows among the last that the first chunks of a document come close to, the closest first, ties by id."""
        return near_rows(fresh, self.tail(last), first, least, shown)

    def clean_up(self, older_than_seconds: float = 86_400.0) -> int:
        """Delete what no pointer names, bucket by bucket."""
        kinds = [f"{kind}/{s.getPath().getName()}" for kind in ("chunks", "manifest") if self.pointer.files.exists(self.pointer.at(kind)) for s in self.pointer.files.listStatus(self.pointer.at(kind))]
        return self.pointer.clean_up(tuple(kinds), older_than_seconds)


def near_rows(fresh: DataFrame, late: DataFrame, first: int = FIRST_CHUNKS, least: float = NEAR, shown: int = SHOWN) -> DataFrame:
    """fresh (doc_path, chunk_index, chunk_id, vector) against late (chunk_id, vector), a bounded number of rows: ChunkStore.near_warnings()."""
    lead = curation.first_rows(fresh.where("vector is not null"), "doc_path", ["chunk_index", "chunk_id"], first)
    asked = lead.select("doc_path", F.col("chunk_id").alias("name"), F.xxhash64("chunk_id").alias("query_id"), "vector")
    base = late.select(F.col("chunk_id").alias("near_id"), F.xxhash64("chunk_id").alias("id"), "vector")
    found = similarity.similar(base, asked, k=shown, least=least).join(base.select("id", "near_id"), "id").join(asked.select("doc_path", "name", "query_id"), "query_id")
    rows = found.select("doc_path", F.col("name").alias("chunk_id"), "near_id", "similarity").withColumn("closeness", -F.col("similarity"))
    return curation.first_rows(rows, "doc_path", ["closeness", "chunk_id", "near_id"], shown, "place").select("doc_path", "place", "chunk_id", "near_id", "similarity")
