"""Consolidation into the store: notes are indexed and the sessions they hold leave it, in one commit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.operators import curation, models, sessions

from . import catalog
from .corpus import CHUNK_SCHEMA
from .scratch import written
from .store import ChunkStore


def note_path(project, topic, repos: str, base: str):
    """research/memory/<slug of the topic>.md of the project's repository; sessions of the shared lane have theirs in the library."""
    slug = F.coalesce(F.nullif(X.slug(topic), F.lit("")), F.lit("session-memory"))
    root = F.when(project == "library", F.lit(f"{base}/library")).otherwise(F.concat(F.lit(f"{repos}/"), project))
    return F.concat(root, F.lit("/research/memory/"), slug, F.lit(".md"))


def consolidate_sessions(
    store: ChunkStore, files: DataFrame, now: str, project: str | None = None, topic: str = "", days: int = 0, repos: str = "repos", base: str = "vault", budget: int = curation.BUDGET,
    embedder: catalog.Embedder = models.embed, nli: sessions.Judge = models.contradiction,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """files (path, text, modified) of sessions and notes -> (outcomes, notes to write, sources to archive).

    Every project that has sessions in reach (of one project, not older than `days`; none or fewer days: all) gets one note, named by the
    topic, else by the project; facts of the note that is there are kept unless they are contradicted. outcomes (project, topic, status, memory_file, n_sources,
    n_pending, n_unreadable, n_clamped, n_contradictions, nli, bloated, memory_chunks): status is empty_consolidation, memory_not_indexed,
    where the note has neither a chunk nor donors for all its chunks, or consolidated. Sources (project, path) of consolidated notes alone leave the
    store, together with the note's coming; pending and unreadable (null) ones stay. Files themselves are
    the caller's to write and to move.
    """
    files = files.withColumn("path", X.slashes(F.col("path")))
    recent = written(sessions.recent_sessions(files, project, days, now, repos, base).select(X.session_project(F.col("path"), base).alias("project"), F.col("path").alias("doc_path"), "text"), "recent")
    reports = recent.where("text is not null")
    title = F.lit(topic) if topic else F.col("project")
    path = note_path(F.col("project"), title, repos, base)
    targets = recent.select("project").distinct().select("project", title.alias("topic"), path.alias("memory_file"))
    notes = targets.join(files.select(F.col("path").alias("memory_file"), "text"), "memory_file").select("project", "text").where("text is not null")
    merged = sessions.consolidate(reports, notes, now[:10], budget=budget, embedder=embedder, nli=nli).join(targets, "project")
    # the title is the topic's
    note = F.concat(F.lit("# "), F.col("topic"), F.substring(F.col("note"), F.length("project") + 3, F.length("note")))
    merged = written(merged.withColumn("note", note), "merged")
    packed = curation.within_budget(reports.select("project", "doc_path", F.length("text").alias("length")), "project", ["doc_path"], budget)
    taken = packed.where("status <> 'pending'").select("project", F.col("doc_path").alias("path"))

    fresh_notes = merged.where("status = 'consolidated'").select("project", F.col("memory_file").alias("doc_path"), F.lit("research").alias("source_type"), F.col("note").alias("text"), F.lit(now).cast("timestamp_ntz").alias("authored_at"), F.pmod(F.xxhash64("memory_file"), F.lit(1 << 62)).alias("seq"))
    paths = fresh_notes.select(F.col("doc_path").alias("path"))
    rows = catalog.chunk_rows(fresh_notes.drop("project"), now, embedder=embedder)
    left = curation.without_paths(store.chunks().select("doc_path", "content_hash", "source_type"), paths)
    judged = written(curation.with_donors(rows, left), "judged")
    counts = judged.groupBy("doc_path").agg(F.count_if("kept").alias("memory_chunks"), F.count("*").alias("chunks"))
    known = written(fresh_notes.join(counts, "doc_path", "left").select("project", F.col("doc_path").alias("path"), "text", F.coalesce("memory_chunks", F.lit(0)).alias("memory_chunks"), (F.coalesce("chunks", F.lit(0)) > 0).alias("indexed")), "known")
    indexed = known.where("indexed")
    sources = written(taken.join(indexed.select("project"), "project", "left_semi"), "sources")

    hashed = X.content_hash(F.col("text"))
    before = store.manifest().select("path", F.col("ingested_at").alias("first"))
    entries = indexed.where("memory_chunks > 0").join(before, "path", "left").select("path", hashed.alias("content_hash"), F.col("memory_chunks").cast("int").alias("chunk_count"), F.coalesce("first", F.lit(now)).alias("ingested_at"), F.lit(now).alias("updated_at"), F.lit(0).alias("retrieval_count"))
    fresh = judged.where("kept").join(indexed.select(F.col("path").alias("doc_path")), "doc_path", "left_semi").select(*CHUNK_SCHEMA.names, "seq")
    gone = sources.select("path").unionByName(indexed.select("path"))
    store.apply(fresh, gone, entries, ["seq", "chunk_index"])

    unreadable = recent.groupBy("project").agg(F.count_if(F.col("text").isNull()).alias("n_unreadable"))
    status = F.when(F.col("status") != "consolidated", F.col("status")).when(F.coalesce("indexed", F.lit(False)), "consolidated").otherwise("memory_not_indexed")
    outcomes = merged.join(known.select("project", "memory_chunks", "indexed"), "project", "left").join(unreadable, "project").select(
        "project", "topic", status.alias("status"), "memory_file", "n_sources", "n_pending", "n_unreadable", "n_clamped", "n_contradictions", "nli", "bloated", F.coalesce("memory_chunks", F.lit(0)).alias("memory_chunks")
    )
    return written(outcomes, "outcomes"), indexed.select("path", "text"), sources
