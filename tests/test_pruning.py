"""Similarity with parts about pivots: the same pairs as all comparisons give, and most parts left out where rows lie in clusters."""

import numpy as np

from foliant.operators import similarity


def frames(spark, vectors, asked):
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(9999, None)], "id long, vector array<double>")
    return base, spark.createDataFrame([(i, vectors[i].tolist()) for i in asked], "query_id long, vector array<double>")


def brute(vectors, asked, least, k=None):
    scores, out = np.round(vectors @ vectors.T, 9), set()
    for q in asked:
        found = sorted((-scores[q, b], b) for b in range(len(vectors)) if b != q and scores[q, b] >= least)
        out |= {(q, b) for _, b in found[:k]}
    return out


def test_pruned_pairs_equal_all_comparisons(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    vectors = centres[rng.integers(0, 12, 400)] + 0.15 * rng.normal(size=(400, 16))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for data, least in ((unit, 0.9), (unit, -0.2), (vectors, 12.0), (np.repeat(unit[:20], 5, axis=0), 0.99)):
        asked = list(range(0, len(data), 7))
        base, queries = frames(spark, data, asked)
        for rows in (100_000, 9):
            monkeypatch.setattr(similarity, "PART_ROWS", rows)
            found = {(r["query_id"], r["id"]) for r in similarity.similar(base, queries, least=least).collect()}
            assert found == brute(data, asked, least)
        best = {(r["query_id"], r["id"]) for r in similarity.similar(base, queries, k=3, least=least, block=5).collect()}
        assert best == brute(data, asked, least, 3)


def test_most_parts_are_left_out(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 32))
    vectors = centres[rng.integers(0, 30, 900)] + 0.05 * rng.normal(size=(900, 32))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    row = similarity.cells_met(*frames(spark, unit, range(0, 900, 20)), 0.9).first()
    assert row["queries"] == 45 and row["of"] == 45 * row["parts"] and row["met"] < 0.2 * row["of"]


def test_empty_sides(spark):
    base, queries = frames(spark, np.eye(4), [0, 1])
    assert similarity.similar(base.limit(0), queries, least=0.5).count() == similarity.similar(base, queries.limit(0), least=0.5).count() == 0
    assert similarity.nearest(base, queries, 0.5).count() == 0
