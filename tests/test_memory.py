"""Consolidation whole: the note in the index, its sources out of it, pending ones left, in one commit."""

import pytest

from foliant.sources import memory
from foliant.sources.store import ChunkStore

NOW, LATER = "2025-03-01 00:00:00", "2025-03-20 00:00:00"


def session(k, fact):
    return f"---\ntype: session\n---\n# S {k}\n\n## Summary\n- {fact}\n"


def frame(spark, rows):
    return spark.createDataFrame([(p, t, m) for p, t, m in rows], "path string, text string, modified string").selectExpr("path", "text", "cast(modified as timestamp_ntz) as modified")


def ingest(spark, store, files):
    rows = files.selectExpr("path as doc_path", "if(contains(path, '/memory/'), 'research', 'session') as source_type", "text", "modified as authored_at", "pmod(xxhash64(path), 1000000) as seq")
    store.sync(rows, NOW)


@pytest.fixture
def files(spark):
    lane = "repos/proj/research/sessions/2025-02-0{}-x.md"
    rows = [(lane.format(k), session(k, f"The reranker number {k} uses a batch of {k * 8} rows in all."), f"2025-02-0{k} 00:00:00") for k in (1, 2)]
    rows += [("vault/library/sessions/2025-01-01-y.md", session(9, "The shared lane keeps a fact about harbours and ships."), "2025-01-01 00:00:00"), ("repos/proj/research/sessions/2025-02-09-z.md", None, "2025-02-09 00:00:00"), ("repos/empty/research/sessions/2025-02-03-e.md", "---\ntype: session\n---\n", "2025-02-03 00:00:00")]
    return frame(spark, rows)


def test_notes_come_and_sources_go(spark, tmp_path, files):
    store = ChunkStore(spark, str(tmp_path / "s"), buckets=4)
    ingest(spark, store, files)
    before = {r["doc_path"] for r in store.chunks().collect()}
    version = store.state()["version"]
    outcomes, notes, sources = memory.consolidate_sessions(store, files, NOW)
    found = {r["project"]: r for r in outcomes.collect()}
    assert found["proj"]["status"] == found["library"]["status"] == "consolidated" and found["proj"]["n_sources"] == 2 and found["proj"]["n_unreadable"] == 1
    assert found["empty"]["status"] == "empty_consolidation"
    assert found["proj"]["memory_file"] == "repos/proj/research/memory/proj.md" and found["library"]["memory_file"] == "vault/library/research/memory/library.md"
    after = {r["doc_path"]: r["source_type"] for r in store.chunks().collect()}
    gone = {r["path"] for r in sources.collect()}
    assert gone == {p for p in before if "proj" in p or "library" in p} and not gone & after.keys()
    assert after["repos/proj/research/memory/proj.md"] == "research" and store.state()["version"] == version + 1
    assert {r["path"] for r in store.manifest().collect()} == after.keys()
    text = {r["path"]: r["text"] for r in notes.collect()}["repos/proj/research/memory/proj.md"]
    assert "reranker number 1" in text and "reranker number 2" in text and text.startswith("# proj\n\n_Consolidated 2025-03-01 from 2 session")
    # a second run with the note there: its facts stay, and the new session's comes
    more = [("repos/proj/research/sessions/2025-03-10-n.md", session(3, "The index of chunks is written by bucket of path."), "2025-03-10 00:00:00"), ("repos/proj/research/memory/proj.md", text, NOW)]
    outcomes, notes, sources = memory.consolidate_sessions(store, frame(spark, more), LATER)
    (row,), (note,) = outcomes.collect(), notes.collect()
    assert row["nli"] == "ran" and "reranker number 1" in note["text"] and "bucket of path" in note["text"]
    (entry,) = store.manifest().where("path = 'repos/proj/research/memory/proj.md'").collect()
    assert entry["ingested_at"] == NOW and entry["updated_at"] == LATER


def test_days_topic_and_budget(spark, tmp_path, files):
    store = ChunkStore(spark, str(tmp_path / "s"), buckets=4)
    ingest(spark, store, files)
    # only sessions of the last 28 days, of one project, under a topic of its own; a budget that the first report fills
    outcomes, notes, sources = memory.consolidate_sessions(store, files, NOW, project="proj", topic="Reranker decisions", days=28, budget=80)
    (row,) = outcomes.collect()
    assert (row["status"], row["topic"], row["memory_file"]) == ("consolidated", "Reranker decisions", "repos/proj/research/memory/reranker-decisions.md")
    assert row["n_pending"] == 1 and row["n_clamped"] == 1 and [r["path"] for r in sources.collect()] == ["repos/proj/research/sessions/2025-02-01-x.md"]
    assert store.chunks().where("doc_path = 'repos/proj/research/sessions/2025-02-02-x.md'").count() == 1
    assert notes.first()["text"].startswith("# Reranker decisions\n")


def test_sources_stay_where_the_note_is_not_indexed(spark, tmp_path, files, monkeypatch):
    store = ChunkStore(spark, str(tmp_path / "s"), buckets=4)
    ingest(spark, store, files)
    held = {r["chunk_id"] for r in store.chunks().collect()}
    rows = memory.catalog.chunk_rows
    monkeypatch.setattr(memory.catalog, "chunk_rows", lambda *a, **k: rows(*a, **k).where("false"))
    outcomes, notes, sources = memory.consolidate_sessions(store, files, NOW)
    assert {r["status"] for r in outcomes.collect()} == {"memory_not_indexed", "empty_consolidation"}
    assert notes.count() == sources.count() == 0 and {r["chunk_id"] for r in store.chunks().collect()} == held


def test_no_sessions(spark, tmp_path, files):
    store = ChunkStore(spark, str(tmp_path / "s"), buckets=4)
    outcomes, notes, sources = memory.consolidate_sessions(store, files, NOW, project="none")
    assert outcomes.count() == notes.count() == sources.count() == 0
