"""Trees of clusters cut at every height, and settings scored by retrieval."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import clusters, models


def plain(vectors, cut):
    """Average linkage by the book: the two closest clusters merge until none are within the cut."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    groups = [[i] for i in range(len(vectors))]
    while len(groups) > 1:
        best = min(((1 - np.mean([unit[i] @ unit[j] for i in a for j in b]), x, y) for x, a in enumerate(groups) for y, b in enumerate(groups) if x < y))
        if best[0] > cut:
            break
        groups[best[1]] += groups.pop(best[2])
    label = {i: min(g) for g in groups for i in g}
    return np.unique([label[i] for i in range(len(vectors))], return_inverse=True)[1]


def test_one_tree_gives_every_cut():
    rng = np.random.default_rng(6)
    for n in (1, 2, 13, 30):
        vectors = rng.normal(size=(n, 5))
        made = clusters.merges(vectors, 2.0)
        assert len(made) == n - 1
        for cut in (0.1, 0.4, 0.6, 0.8, 1.0, 1.5):
            assert (clusters.cut_at(n, made, cut) == plain(vectors, cut)).all()
            assert (clusters.average_linkage(vectors, cut) == plain(vectors, cut)).all()


def chunked(spark):
    texts = {"a.md": ["apple pear plum fruit bowl.", "apple pear plum fruit basket.", "apple pear plum fruit salad.", "engine wheel brake car."], "b.md": ["river bank water fish one.", "river bank water fish two.", "river bank water fish three."], "s.md": ["apple pear plum fruit bowl."] * 3}
    rows = [(f"{p}{i}", p, i, "session" if p == "s.md" else "docs", t, models.bag_vector(t)) for p, ts in texts.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "chunk_id string, doc_path string, chunk_index int, source_type string, text string, vector array<float>")


def test_settings_are_scored(spark):
    rows = chunked(spark)
    settings = [(0.5, 3), (0.5, 4), (0.0, 2)]
    counts = {(r["cut"], r["least"]): (r["n_clusters"], r["n_chunks"], r["n_docs"]) for r in clusters.sweep(rows, settings).collect()}
    assert counts == {(0.5, 3): (2, 6, 2), (0.5, 4): (0, 0, 0), (0.0, 2): (0, 0, 0)}
    asked = [(1, "apple pear plum fruit", "a.md", "apple"), (2, "engine wheel", "a.md", "engine"), (3, "river bank water fish", "b.md", "nowhere"), (4, "apple pear", "z.md", "")]
    queries = spark.createDataFrame([(q, models.bag_vector(t), f, e) for q, t, f, e in asked], "query_id long, vector array<float>, expected_file string, expected_text string")
    found = {(r["cut"], r["least"]): r for r in clusters.scored_sweep(rows, queries, settings, k=2).collect()}
    assert found.keys() == {(None, None), *settings}
    assert {s: r["summaries"] for s, r in found.items()} == {(None, None): 0, (0.5, 3): 2, (0.5, 4): 0, (0.0, 2): 0}
    # in plain form: the best two of leaves and the setting's summaries
    leaves = [(r["doc_path"], r["text"], r["vector"]) for r in rows.where("source_type <> 'session'").collect()]
    extra = {(0.5, 3): [(p, t, models.bag_vector(t)) for p, t in (("a.md", "apple pear plum fruit bowl. apple pear plum fruit basket. apple pear plum fruit salad."), ("b.md", "river bank water fish one. river bank water fish two. river bank water fish three."))]}
    for setting, row in found.items():
        rank = hit = text = 0
        for _, t, file, wanted in asked:
            v = models.bag_vector(t)
            best = sorted(leaves + extra.get(setting, []), key=lambda x: -round(float(np.dot(x[2], v)), 9))[:2]
            places = [i for i, (p, _, _) in enumerate(best, 1) if file in p]
            rank += 1 / places[0] if places else 0
            hit += bool(places and places[0] == 1)
            text += bool(places and places[0] == 1 and wanted.lower() in best[0][1].lower())
        assert (row["n"], row["mrr"], row["hit_1"], row["text_match_1"]) == (4, pytest.approx(rank / 4, abs=1e-6), pytest.approx(hit / 4), pytest.approx(text / 4))


def test_all_chunks_of_a_cluster_are_summarised(spark):
    """Before, a summary had the first 15 chunks of its cluster, as parents, for its heading and for its text."""
    rows = spark.createDataFrame([(f"c{i:02}", "a.md", i, "docs", f"chunk {i} of forty." + (" needle" if i == 38 else ""), "Late" if i > 30 else "(no heading)", [1.0, i / 1000]) for i in range(40)], "chunk_id string, doc_path string, chunk_index int, source_type string, text string, heading string, vector array<float>")
    (row,) = clusters.summaries(rows, summarizer=lambda texts: F.array_join(texts, " ")).collect()
    assert row["parent_id"] == [f"c{i:02}" for i in range(40)] and row["n_chunks"] == 40
    assert row["heading"] == "Late" and "needle" in row["text"] and row["text"].count("of forty.") == 40
    # the same in a sweep: the summary that a query finds first holds what only its 39th chunk says
    queries = spark.createDataFrame([(1, [0.0, 1.0], "a.md", "needle")], "query_id long, vector array<float>, expected_file string, expected_text string")
    scored = clusters.scored_sweep(rows, queries, [(0.8, 3)], k=1, summarizer=lambda texts: F.array_join(texts, " "), embedder=lambda text: F.array(F.lit(0.0), F.lit(1.0)))
    assert {(r["cut"], r["summaries"], r["text_match_1"]) for r in scored.collect()} == {(None, 0, 0.0), (0.8, 1, 1.0)}
