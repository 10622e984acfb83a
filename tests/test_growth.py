"""Work and memory that grow no faster than the input: ties, row groups, texts in Python, hashes made once."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import chunking, clusters, similarity
from foliant.sources import catalog, textindex
from foliant.sources.scratch import fresh_path, shared_dir
from foliant.sources.store import MANIFEST, STORED, ChunkStore


def plain(ids, vectors, names, wanted, k, least):
    scores = np.round(wanted.astype(np.float64) @ vectors.astype(np.float64).T, 9)
    return {n: sorted((-s, i) for s, i in zip(scores[at], ids, strict=True) if i != n and (least is None or s >= least))[:k] for at, n in enumerate(names)}


@pytest.mark.parametrize(("step", "pairs"), [(50, 7), (4_000_000, 100_000)])
def test_best_of_a_cell_with_ties(monkeypatch, step, pairs):
    monkeypatch.setattr(similarity, "STEP_SCORES", step)
    monkeypatch.setattr(similarity, "STEP_PAIRS", pairs)
    rng = np.random.default_rng(3)
    for trial in range(40):
        n, m, k = rng.integers(1, 200), rng.integers(1, 40), int(rng.integers(1, 6))
        vectors = (rng.integers(0, 3, (n, 4)) if trial % 2 else rng.normal(size=(n, 4))).astype(np.float32)
        ids, names, wanted, least = rng.permutation(500)[:n], rng.permutation(500)[:m], vectors[rng.integers(0, n, m)], [None, 0.4][trial % 3 == 0]
        found = sorted(zip(*similarity._compare(ids, vectors, names, wanted, k, least), strict=True), key=lambda x: (x[0], -x[2], x[1]))
        for name, best in plain(ids, vectors, names, wanted, k, least).items():
            assert [(-s, i) for q, i, s in found if q == name][:k] == best


def test_copies_do_not_multiply():
    """Before, every row that tied with a query's k-th best left the cell: queries times copies."""
    same = np.ones((3000, 4), np.float32)
    q, b, _ = similarity._compare(np.arange(3000), same, np.arange(0, 3000, 20), same[::20], 2, 0.4)
    assert len(q) <= 3 * 150 and set(b[q == 2000]) <= {0, 1, 2}


def test_slices_of_texts():
    found = list(chunking.slices(np.array([10, 10, 500, 1, 1, 90, 0]), 100))
    assert sum(n for _, n in found) == 7 and found[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(found, found[1:], strict=False))
    assert len(found) > 2


def test_clusters_keep_texts_out_of_python(spark):
    rows = spark.createDataFrame([(f"d{d}", i, f"c{d}-{i}", "docs", "t", [1.0, float(i % 2)]) for d in range(3) for i in range(8)], "doc_path string, chunk_index int, chunk_id string, source_type string, text string, vector array<float>")
    found = clusters.clusters(rows, 0.1, 3, ("chunk_id", "text"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "InPandas" not in plan
    assert {(r["doc_path"], r["chunk_index"], r["cluster"], r["chunk_id"]) for r in found.collect()} == {(f"d{d}", i, i % 2, f"c{d}-{i}") for d in range(3) for i in range(8)}


def test_hashes_do_for_manifest_and_outcomes(spark):
    texts = [("a.md", "docs", "# A\n\nSome words here.", 0), ("b.md", "docs", " \n", 1), ("c.md", "docs", None, 2)]
    files = spark.createDataFrame(texts, "doc_path string, source_type string, text string, seq long").withColumn("authored_at", F.lit(None).cast("timestamp_ntz"))
    none = spark.createDataFrame([], "path string, content_hash string")
    hashed = catalog.digests(files.select("doc_path", "text"))
    chunks, status = catalog.sync(files, none, None, "2025-01-01 00:00:00", hashed=hashed)
    for side in (files, hashed):
        assert {(r["path"], r["status"], r["chunks"]) for r in catalog.file_statuses(side, status, chunks).collect()} == {("a.md", "ingested", 1), ("b.md", "empty", 0), ("c.md", "error", 0)}
    both = [catalog.sync_manifest(side, none, chunks, status, "2025").collect() for side in (files, hashed)]
    assert both[0] == both[1] and [r["path"] for r in both[0]] == ["a.md"]


def test_a_commit_writes_new_rows_once_on_the_way(spark):
    store = ChunkStore(spark, fresh_path(spark, "store"), buckets=2)
    row = {f.name: None for f in STORED if f.name != "ingest_seq"}
    rows = spark.createDataFrame([row | {"doc_path": f"{i}.md", "chunk_id": str(i)} for i in range(40)], STORED).drop("ingest_seq").withColumn("n", F.col("chunk_id").cast("int"))
    at = store.pointer._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/foliant-scratch/*/fresh")
    before = len(store.pointer.files.globStatus(at) or [])
    store.apply(rows, rows.limit(0).select(F.col("doc_path").alias("path")), spark.createDataFrame([], MANIFEST), ["n"])
    assert len(store.pointer.files.globStatus(at) or []) == before
    assert sorted((r["ingest_seq"], r["doc_path"]) for r in store.chunks().collect()) == [(i, f"{i}.md") for i in range(40)]
    assert [r["doc_path"] for r in store.tail(3).collect()] == ["39.md", "38.md", "37.md"]


def test_terms_are_counted_where_their_text_is(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, None)], "id long, text string")
    lengths, counted = textindex.counted_terms(docs)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1
    assert {tuple(r) for r in counted.collect()} == {("a", 1, 3, 2), ("b", 1, 3, 1)} and {tuple(r) for r in lengths.collect()} == {(1, 3), (2, 0)}


def test_cells_follow_the_input_and_not_the_partitions():
    """Before, a search had as many parts as Spark has shuffle partitions, and each part gave every query's best k: queries times partitions, which both grow."""
    moved = lambda n: (lambda parts, blocks: 20 * n * blocks + n * parts)(*similarity._layout(20 * n, n, n // 250, similarity.BLOCK))
    assert moved(100_000) / moved(10_000) < 10**1.6
    for n, m, cells in ((0, 0, 200), (1, 1, 200), (1000, 50, 200), (5_000_000, 10, 200), (100, 1_000_000, 200), (4_000_000, 200_000, 600), (10**8, 5 * 10**6, 4)):
        parts, blocks = similarity._layout(n, m, cells, similarity.BLOCK)
        assert n / parts <= similarity.PART_ROWS and m / blocks <= similarity.BLOCK and n * m / (parts * blocks) <= similarity.MOST_PAIRS
        assert n * m >= similarity.FEWEST_PAIRS or parts * blocks <= 20


def test_cells_are_tasks_of_their_own(spark):
    """Before, Spark put cells together by their bytes, which say little of their work."""
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "id long, vector array<float>")
    plan = similarity.similar(rows, rows.withColumnRenamed("id", "query_id"), k=2)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(p#\d+, q#\d+, \d+\), REPARTITION_BY_NUM", plan)) == 2 and len(re.findall(r"Exchange hashpartitioning\(p#", plan)) == 2


@pytest.mark.parametrize("kind", [np.float32, np.float64])
def test_best_of_a_cell_over_several_steps(kind):
    """More rows and more queries than one product holds, with copies and a query set that holds rows of its own."""
    rng = np.random.default_rng(8)
    vectors = np.concatenate([rng.normal(size=(2500, 8)), np.repeat(rng.normal(size=(3, 8)), 40, axis=0)]).astype(kind)
    ids = rng.permutation(9000)[: len(vectors)]
    at = rng.permutation(len(vectors))[:1100]
    names = np.concatenate([ids[at[:40]], np.arange(10_000, 10_000 + len(at) - 40)])
    q, b, s = similarity._compare(ids, vectors, names, vectors[at], 5, None)
    by = np.lexsort((b, -s, q))
    starts = dict(zip(*(x.tolist() for x in np.unique(q[by], return_index=True)), strict=True))
    for name, best in plain(ids, vectors, names, vectors[at], 5, None).items():
        first = by[starts[name] : starts[name] + 5]
        assert [(-x, i) for x, i in zip(s[first], b[first], strict=True)] == best


def test_searches_of_a_sweep_run_once(spark):
    """Before, the settings that gave results and the results themselves were read from searches of their own."""
    texts = ["apple pear plum fruit bowl.", "apple pear plum fruit basket.", "apple pear plum fruit salad."]
    rows = spark.createDataFrame([(f"{p}{i}", f"{p}.md", i, "docs", t, [1.0, float(i)]) for p in "ab" for i, t in enumerate(texts)], "chunk_id string, doc_path string, chunk_index int, source_type string, text string, vector array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.5], "a.md", "apple")], "query_id long, vector array<float>, expected_file string, expected_text string")
    found = clusters.scored_sweep(rows, queries, [(1.5, 3)], k=2, embedder=lambda text: F.array(F.lit(1.0), F.lit(0.5)))
    assert "CoGroup" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r["cut"], r["summaries"], r["n"]) for r in found.collect()} == {(None, 0, 1), (1.5, 2, 1)}
