"""Paths of notes: never one that is taken, whatever names meet."""

import random

from foliant.operators import sessions
from foliant.sources import catalog
from foliant.plans import registry

NOW = "2025-03-01 00:00:00"


def brute(notes, held):
    taken, out = set(held), {}
    for seq, lane, stem in sorted(notes):
        n = 1
        while (path := f"{lane}/{stem}.md" if n == 1 else f"{lane}/{stem}-{n}.md") in taken:
            n += 1
        taken.add(path)
        out[seq] = path
    return out


def test_first_free_names(spark):
    rng = random.Random(7)
    stems = ["plan", "plan-2", "plan-2-2", "x", "x-1", "y", "2025", "2025-03", "z-02"]
    for trial in range(3):
        notes = [(i, rng.choice("ab"), rng.choice(stems)) for i in range(40)]
        held = [f"{rng.choice('ab')}/{rng.choice(stems)}{rng.choice(['', '-2', '-3', '-5', '-01'])}.md" for _ in range(12 * trial)]
        frame = spark.createDataFrame(notes, "seq long, lane string, stem string")
        there = spark.createDataFrame([(p,) for p in held], "path string") if held else None
        found = {r["seq"]: r["path"] for r in sessions._numbered(frame, there).collect()}
        assert found == brute(notes, held)


def calls(spark, titles):
    rows = [(i, f"body {i}", t, "p", "note", "s1", "") for i, t in enumerate(titles)]
    return spark.createDataFrame(rows, "seq long, content string, title string, project string, kind string, session_id string, cwd string")


def test_notes_of_like_titles(spark):
    """The cases that once gave one path to two notes, or wrote over one that is there."""
    lane = "repos/p/research/sessions/2025-03-01-000000-s1-"
    paths = lambda titles, held: [r["path"].removeprefix(lane) for r in sessions.capture_memories(calls(spark, titles), held and spark.createDataFrame([(lane + h,) for h in held], "path string"), NOW).orderBy("seq").collect()]
    assert paths(["plan", "plan", "plan 2"], None) == ["plan.md", "plan-2.md", "plan-2-2.md"]
    assert paths(["plan"], ["plan-2.md"]) == ["plan.md"]
    assert paths(["x", "x", "x"], ["x.md", "x-3.md"]) == ["x-2.md", "x-4.md", "x-5.md"]


def test_paths_with_backslashes_are_synced(spark):
    """A file that is named with backslashes is chunked, and its modified form replaces the rows of either spelling."""
    shape = "doc_path string, source_type string, text string, authored_at timestamp_ntz, seq long"
    files = spark.createDataFrame([("repos\\a\\docs\\x.md", "docs", "# X\n\nNew text of the file.", None, 1), ("repos/a/docs/y.md", "docs", "# Y\n\nOther text here.", None, 2)], shape)
    none = spark.createDataFrame([], "path string, content_hash string")
    chunks, statuses = catalog.sync(files, none, None, NOW)
    assert {r["doc_path"] for r in chunks.collect()} == {"repos/a/docs/x.md", "repos/a/docs/y.md"}
    assert {(r["path"], r["status"], r["chunks"]) for r in catalog.file_statuses(files, statuses, chunks).collect()} == {("repos/a/docs/x.md", "ingested", 1), ("repos/a/docs/y.md", "ingested", 1)}
    old = spark.createDataFrame([("repos\\a\\docs\\x.md", "old"), ("repos\\a\\docs\\gone.md", "old")], "path string, content_hash string")
    stored = chunks.withColumn("doc_path", registry.F.translate("doc_path", "/", "\\"))
    again, _ = catalog.sync(files.where("seq = 1").replace("# X\n\nNew text of the file.", "# X\n\nNewer text."), old, stored, NOW)
    assert {(r["doc_path"], r["text"]) for r in again.collect()} >= {("repos/a/docs/x.md", "# X\n\nNewer text.")} or any("Newer" in r["text"] for r in again.collect())
    assert not any("New text" in r["text"] for r in again.collect())
