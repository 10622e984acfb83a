"""The bucketed chunk store: commits, sequence, tail, warnings and streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from foliant.sources.corpus import CHUNK_SCHEMA
from foliant.sources.store import MANIFEST, ChunkStore, near_rows
from foliant.streaming.ingest import ingest_stream, new_files

NOW, LATER = "2025-01-01 00:00:00", "2025-02-01 00:00:00"
FILE = "doc_path string, source_type string, text string, authored_at timestamp_ntz, seq long"


def files(spark, texts):
    return spark.createDataFrame([(p, "docs", t, None, i) for i, (p, t) in enumerate(sorted(texts.items()))], FILE)


def body(k, extra=""):
    return f"# File {k}\n\nThis is what file number {k} says about subject {k * 7}. {extra}"


def test_one_file_rewrites_one_bucket(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"), buckets=8)
    texts = {f"repos/p/docs/{k}.md": body(k) for k in range(40)}
    store.sync(files(spark, texts), NOW)
    before = store.state()
    assert before["next"] == store.chunks().count() == 40 and store.manifest().count() == 40
    texts["repos/p/docs/5.md"] = body(5, "It was changed.")
    status, _ = store.sync(files(spark, texts), LATER)
    after = store.state()
    assert {r["status"] for r in status.where("path = 'repos/p/docs/5.md'").collect()} == {"modified"}
    for kind in ("chunks", "manifest"):
        assert sum(after[kind][b] != before[kind].get(b) for b in after[kind]) == 1
    (row,) = store.chunks().where("doc_path = 'repos/p/docs/5.md'").collect()
    assert "changed" in row["text"] and row["ingest_seq"] == 40
    (entry,) = store.manifest().where("path = 'repos/p/docs/5.md'").collect()
    assert entry["ingested_at"] == NOW and entry["updated_at"] == LATER
    # deletion takes chunks and entry together; a file that can't be read keeps what it has
    del texts["repos/p/docs/6.md"]
    store.sync(files(spark, texts | {"repos/p/docs/7.md": None}), LATER)
    assert {r["doc_path"] for r in store.chunks().collect()} == {r["path"] for r in store.manifest().collect()} == set(texts)
    assert store.clean_up(0) > 0 and store.chunks().count() == 39
    assert ChunkStore(spark, str(tmp_path / "s")).state() == store.state()


def test_tail_follows_the_sequence(spark, tmp_path):
    """Against a plain list, over commits that add, replace and remove."""
    store, rng, plain, following = ChunkStore(spark, str(tmp_path / "s"), buckets=4), random.Random(3), [], 0
    for turn in range(4):
        names = rng.sample(range(60), 25)
        rows = [tuple({"chunk_id": f"{n}-{turn}", "doc_path": str(n), "chunk_index": n}.get(c) for c in CHUNK_SCHEMA.names) for n in names]
        gone = [str(n) for n in rng.sample(range(60), 10)]
        store.apply(spark.createDataFrame(rows, CHUNK_SCHEMA), spark.createDataFrame([(g,) for g in gone], "path string"), spark.createDataFrame([], MANIFEST), ["chunk_index"])
        out = {str(n) for n in names} | set(gone)
        plain = [x for x in plain if x[1] not in out] + [(following + i, str(n)) for i, n in enumerate(sorted(names))]
        following += 25
        assert sorted((r["ingest_seq"], r["doc_path"]) for r in store.chunks().collect()) == sorted(plain)
        for n in (1, 7, 1000):
            assert [(r["ingest_seq"], r["doc_path"]) for r in store.tail(n).collect()] == sorted(plain, reverse=True)[:n]


def test_a_lost_commit_leaves_the_version_before(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"), buckets=2)
    store.sync(files(spark, {"a.md": body(1)}), NOW)
    held = store.state()
    store.sync(files(spark, {"a.md": body(1), "b.md": body(2)}), NOW)
    (tmp_path / "s" / "CURRENT").write_text(json.dumps(held | {"chunks": {"0": "missing/bucket=0"}}))
    assert store.state() == held and store.chunks().count() == store.manifest().count() == 1


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    store, source = ChunkStore(spark, str(tmp_path / "s"), buckets=4), tmp_path / "in" / "repos" / "p" / "docs"
    source.mkdir(parents=True)
    run = lambda at: ingest_stream(store, new_files(spark, str(tmp_path / "in")), str(tmp_path / at), NOW, str(tmp_path / "in"))
    for k in range(5):
        (source / f"{k}.md").write_text(body(k))
    run("state")
    first = store.state()
    assert first["batches"] == {"files": 0} and {r["doc_path"] for r in store.chunks().collect()} == {f"repos/p/docs/{k}.md" for k in range(5)}
    run("lost-state")  # the same batch, number 0, for the checkpoint is gone
    assert store.state() == first
    (source / "9.md").write_text(body(9))
    run("state")
    assert store.state()["batches"] == {"files": 1} and store.chunks().count() == store.manifest().count() == 6
    run("state")
    assert store.state()["version"] == 2


def test_near_rows(spark):
    unit = lambda a: [float(__import__("math").cos(a)), float(__import__("math").sin(a))]
    fresh = spark.createDataFrame([("d", k, f"n{k}", unit(k * 0.05)) for k in range(5)] + [("e", 0, "far", unit(2.0)), ("e", 1, "none", None)], "doc_path string, chunk_index int, chunk_id string, vector array<float>")
    late = spark.createDataFrame([(f"o{k}", unit(k * 0.3)) for k in range(4)], "chunk_id string, vector array<float>")
    found = [(r["doc_path"], r["place"], r["chunk_id"], r["near_id"]) for r in near_rows(fresh, late).orderBy("doc_path", "place").collect()]
    # only the first three chunks count, and five rows are shown at most
    assert found == [("d", 1, "n0", "o0"), ("d", 2, "n1", "o0"), ("d", 3, "n2", "o0"), ("d", 4, "n2", "o1"), ("d", 5, "n1", "o1")]
    assert near_rows(fresh, late, least=0.9999999).count() == 1
