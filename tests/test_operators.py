import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.operators import clusters, curation, fulltext, models, retrieval, sessions, similarity
from foliant.plans.registry import QUERIES


def test_donors_equal_a_sequential_run(spark):
    rng = random.Random(4)
    rows = [(f"d{rng.randint(0, 9)}", i, rng.choice(["session", "docs"]), f"h{rng.randint(0, 12)}") for i in range(150)]
    seen, wanted = {}, {}
    for doc, i, kind, digest in rows:
        wanted[i] = not (seen.get(digest, set()) - {doc})
        if kind != "session" and wanted[i]:
            seen.setdefault(digest, set()).add(doc)
    by_doc = spark.createDataFrame([(d, int(d[1:]) * 1000 + i, k, h) for d, i, k, h in rows], "doc_path string, seq long, source_type string, content_hash string")
    found = {r["seq"]: r["kept"] for r in curation.with_donors(by_doc).collect()}
    assert len(found) == 150
    # one row per document: seq order is document order, as in a fresh build
    once = {}
    for d, i, k, h in rows:
        once.setdefault(d, (d, len(once), k, h))
    held, expect = {}, {}
    for d, s, k, h in once.values():
        expect[s] = h not in held
        if k != "session":
            held.setdefault(h, s)
    frame = spark.createDataFrame(list(once.values()), by_doc.schema)
    assert {r["seq"]: r["kept"] for r in curation.with_donors(frame).collect()} == expect


def test_budget_equals_greedy_packing(spark):
    rng = random.Random(1)
    rows = [(g, i, rng.randint(0, 60)) for g in range(20) for i in range(rng.randint(1, 9))]
    found = {(r["g"], r["i"]): (r["used"], r["status"]) for r in curation.within_budget(spark.createDataFrame(rows, "g int, i int, length int"), "g", ["i"], 100).collect()}
    for g in range(20):
        left = 100
        for _, i, n in [r for r in rows if r[0] == g]:
            used = min(n, left)
            assert found[g, i] == (used, "pending" if left <= 0 else "clamped" if n > left else "taken")
            left -= used


def test_diff(spark):
    files = spark.createDataFrame([("a\\x", "1"), ("b", "2"), ("c", "3")], "path string, content_hash string")
    manifest = spark.createDataFrame([("a/x", "1"), ("b", "9"), ("d", "4")], "path string, content_hash string")
    assert {r["path"]: r["status"] for r in curation.diff(files, manifest).collect()} == {"a/x": "unchanged", "b": "modified", "c": "new", "d": "deleted"}


def test_metrics(spark):
    results = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 12, 3), (3, 13, 1)], "query_id long, id long, rank int")
    expected = spark.createDataFrame([(1, 11), (1, 10), (2, 12)], "query_id long, id long")
    row = curation.ranked_metrics(results, expected, spark.createDataFrame([(1,), (2,), (3,), (4,)], "query_id long")).first()
    assert (row["n"], row["hit_1"], row["hit_3"], row["mrr"]) == (4, 0.25, 0.5, pytest.approx((1 + 1 / 3) / 4, abs=1e-6))


def test_bloat(spark):
    f = lambda m, e, n: spark.range(1).select(curation.bloated(F.lit(m), F.lit(e), F.lit(n)).alias("v")).first()["v"]
    assert f(5000, 1000, 1000) and not f(1900, 10, 10) and not f(5000, 2600, 10) and not f(5000, 1000, 4500)


def test_similar_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    base = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "id long, vector array<double>").repartition(5)
    asked = spark.createDataFrame([(i, v[i].tolist()) for i in range(0, 60, 7)], "query_id long, vector array<double>")
    found = {}
    for r in similarity.similar(base, asked, k=4, block=3).collect():
        found.setdefault(r["query_id"], set()).add(r["id"])
    for q in range(0, 60, 7):
        order = [i for i in np.argsort(-(v @ v[q]), kind="stable") if i != q]
        assert found[q] == set(order[:4])
    assert similarity.similar(base, asked.limit(0), k=3).count() == 0


ROWS = "id long, text string, vector array<float>, source_type string, authored_at timestamp_ntz"


def test_search_excludes_sessions_and_shapes(spark):
    data = [(i, f"alpha beta topic{i} " + "x" * 600, models.bag_vector(f"alpha topic{i}"), "session" if i % 2 else "docs", None) for i in range(12)]
    rows = spark.createDataFrame(data, ROWS)
    asked = spark.createDataFrame([(100, "alpha topic3", models.bag_vector("alpha topic3"))], "query_id long, text string, vector array<float>")
    found = retrieval.search(rows, asked).collect()
    assert len(found) == 3 and {r["source_type"] for r in found} == {"docs"} and all(len(r["preview"]) == 500 and r["truncated"] for r in found)
    best = retrieval.search(rows, asked, include_sessions=True).orderBy("rank").first()
    assert best["id"] == 3 and best["rerank_score"] == 1.0
    levels = retrieval.confidence(retrieval.search(rows, asked), asked.unionByName(spark.createDataFrame([(7, "zzz", None)], asked.schema)))
    assert {r["query_id"]: r["confidence"] for r in levels.collect()} == {100: "high", 7: "none"}
    assert (retrieval.clamp_k(99), retrieval.clamp_k(0), retrieval.pool_size(3), retrieval.pool_size(10)) == (10, 1, 20, 20)


def test_fulltext_prefers_rare_terms(spark):
    docs = spark.createDataFrame([(1, "common rare"), (2, "common common"), (3, None), (4, "other")], "id long, text string")
    found = fulltext.search(docs, spark.createDataFrame([(1, "rare common")], "query_id long, text string")).orderBy("rank").collect()
    assert [r["id"] for r in found] == [1, 2]


def test_line_spans(spark):
    source = "a\nbb\nccc\ndd\n"
    digest = spark.range(1).select(X.content_hash(F.lit(source)).alias("h")).first()["h"]
    rows = [("f", 2, 9, "bb\nccc\n", digest), ("f", 2, 9, "changed", digest), ("f", 2, 9, "bb\nccc", "old"), ("gone", 2, 9, "bb\nccc", digest)]
    results = spark.createDataFrame(rows, "doc_path string, char_start int, char_end int, text string, source_hash string")
    found = retrieval.line_spans(results.withColumn("k", F.monotonically_increasing_id()), spark.createDataFrame([("f", source)], "doc_path string, text string")).orderBy("k").collect()
    assert [(r["line_start"], r["line_end"]) for r in found] == [(2, 3), (None, None), (None, None), (None, None)]


def test_average_linkage_equals_plain_form():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(14, 5))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    groups = [[i] for i in range(14)]
    while len(groups) > 1:
        d = {(i, j): np.mean([1 - u[a] @ u[b] for a in groups[i] for b in groups[j]]) for i in range(len(groups)) for j in range(i)}
        (i, j), best = min(d.items(), key=lambda x: x[1])
        if best > 0.8:
            break
        groups[j] += groups.pop(i)
    found = clusters.average_linkage(v)
    assert {frozenset(np.flatnonzero(found == k)) for k in set(found)} == {frozenset(g) for g in groups}


def test_capture(spark):
    turns = [("s", i, "user", f"task {i}") for i in range(20)] + [("s", 100 + i, "assistant", f"we decided {i}") for i in range(50)] + [("s", 300, "user", "<system-reminder> x"), ("t", 1, "user", "")]
    frame = spark.createDataFrame(turns, "session string, turn long, role string, text string")
    kept = sessions.bounded_turns(frame)
    assert kept.where("role = 'user'").count() == 12 and kept.where("role = 'assistant'").agg(F.min("turn")).first()[0] == 110
    row = sessions.capture(frame).first()
    assert row["title"] == "task 0" and row["outcome"] == "we decided 49" and len(row["decisions"]) == 8


def test_contradictions(spark):
    old = spark.createDataFrame([(1, "the server uses port eighty for all traffic"), (2, "cats like warm places very much")], "id long, fact string")
    new = spark.createDataFrame([(11, "the server no longer uses port eighty for all traffic"), (12, "cats like warm places very much")], "id long, fact string")
    found = sessions.contradictions(old, new).collect()
    assert [(r["prior"][:10], r["confidence"]) for r in found] == [("the server", 0.95)]


def test_consolidated(spark):
    rows = spark.createDataFrame([("p", "a", "a fact that is long enough\nDB_PASSWORD=hunter2hunter2 is here"), ("p", "b", "x" * 30)], "project string, doc_path string, text string")
    row = sessions.consolidated(rows, budget=50).first()
    assert row["n_sources"] == 1 and row["n_pending"] == 1 and row["n_clamped"] == 1 and "hunter2" not in row["body"]


def test_consolidated_keeps_every_fact(spark):
    facts = [f"fact number {i} of a long session report" for i in range(150)]
    rows = spark.createDataFrame([("p", "a", "# Title\n" + "\n".join(f"- {x}" for x in facts[:140])), ("p", "b", "\n".join(facts[140:]))], "project string, doc_path string, text string")
    row = sessions.consolidated(rows).first()
    assert row["body"].split("\n") == facts and (row["n_sources"], row["n_pending"]) == (2, 0)


def test_contradictions_of_long_conversations(spark, tmp_path):
    said = lambda c, t: f"conversation {c} said in turn {t} that the port is open"
    turns = [(20, 3), (20, 499), (20, 500), (20, 900), (19, 503), (19, 1), (21, 2), (21, 400)]
    spark.createDataFrame([(c, t, "user", said(c, t)) for c, t in turns], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    found = QUERIES["contradictions"](spark, str(tmp_path)).collect()
    assert sorted(r["newer"] for r in found) == sorted(said(c, t) for c, t in turns if c == 20)
    assert all(r["prior"] != r["newer"] for r in found)


def test_similar_ties_take_the_least_ids(spark):
    base = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(40)], "id long, vector array<double>").repartition(7)
    asked = spark.createDataFrame([(100, [1.0, 0.0]), (3, [1.0, 0.0])], "query_id long, vector array<double>")
    found = {}
    for r in similarity.similar(base, asked, k=3, block=1).collect():
        found.setdefault(r["query_id"], []).append(r["id"])
    assert {q: sorted(x) for q, x in found.items()} == {100: [0, 1, 2], 3: [0, 1, 2]}


def test_similar_keeps_to_groups(spark):
    base = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("b", 2, [1.0, 0.1]), ("a", 3, [0.0, 1.0])], "g string, id long, vector array<double>")
    asked = spark.createDataFrame([("b", 9, [1.0, 0.0]), ("a", 8, [0.0, 1.0]), ("c", 7, [1.0, 0.0])], "g string, query_id long, vector array<double>")
    assert {(r["query_id"], r["id"]) for r in similarity.nearest(base, asked, 0.1, "g").collect()} == {(9, 2), (8, 3)}


def test_near_duplicate_warnings_are_the_first_five(spark):
    base = spark.createDataFrame([(i, [1.0, i / 100]) for i in range(9)], "id long, vector array<double>")
    asked = spark.createDataFrame([("f", 100, [1.0, 0.0]), ("f", 101, [1.0, 0.0]), ("g", 102, [0.0, 0.0])], "doc_path string, query_id long, vector array<double>")
    found = similarity.near_duplicates(base, asked, 0.9).orderBy("place").collect()
    assert [(r["doc_path"], r["query_id"]) for r in found] == [("f", 100)] * 5


def test_fulltext_ways_agree(spark, monkeypatch):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["the", "a", f"w{rng.randint(0, 30)}"]) for _ in range(20))) for i in range(60)], "id long, text string")
    asked = spark.createDataFrame([(i, f"the w{i}") for i in range(8)], "query_id long, text string")
    few = fulltext.search(docs, asked, 5).collect()
    monkeypatch.setattr(fulltext, "BROADCAST_PAIRS", 3)
    assert sorted(map(tuple, fulltext.search(docs, asked, 5).collect())) == sorted(map(tuple, few))


def test_embedder_equals_plain_form(spark):
    texts = ["The cat sat; the CAT ran", "", None, "ß Ünï 日本 \u00a0 x\x1cy", "a " * 500]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", models.embed("text").alias("v")).orderBy("i").collect()
    assert all(np.allclose(r["v"], models.bag_vector(t), atol=1e-7) for r, t in zip(found, texts))


def test_holders(spark):
    docs = spark.createDataFrame([(1, "one two three four"), (2, "one two threes four"), (3, "xone two three fourx"), (4, None)], "id long, text string")
    items = spark.createDataFrame([(1, "one two three four"), (2, "two"), (3, None)], "query_id long, text string")
    assert {tuple(r) for r in curation.holders(docs, items).collect()} == {(1, 1), (1, 3), (2, 1), (2, 2), (2, 3)}


def test_evaluated_asks_for_the_text(spark):
    results = spark.createDataFrame([(1, 1, "a/x.md", "The Port is open"), (1, 2, "a/y.md", "z"), (2, 1, "q.md", "n"), (2, 3, "b/x.md", "n"), (3, 1, "c.md", "no such")], "query_id long, rank int, doc_path string, text string")
    queries = spark.createDataFrame([(1, "a/", "port IS"), (2, "b/", ""), (3, "c.md", "words"), (4, "d", "")], "query_id long, expected_file string, expected_text string")
    row = curation.evaluated(results, queries).first()
    assert (row["n"], row["hit_1"], row["hit_3"], row["text_match_1"], row["mrr"]) == (4, 0.5, 0.75, 0.25, pytest.approx((1 + 1 / 3 + 1) / 4, abs=1e-6))
    assert curation.evaluated(results, queries.limit(0)).first()["composite"] == 0


def test_metadata_and_captures(spark):
    schema = "file string, line long, type string, session string, cwd string, branch string, sidechain boolean, texts array<string>, captured boolean"
    rows = [
        ("a", 1, "summary", "", None, None, False, [], False), ("a", 2, "user", "side", "/x", "no", True, ["side"], False), ("a", 3, "user", "12345678-a", "repos\\p1\\src", "", False, ["\n Fix the DB_PASSWORD=hunter2hunter2 thing\nsoon"], False),
        ("a", 4, "assistant", "other", "/y", "main", False, ["We decided to use C:\\data\\x.txt", "next step: none"], False), ("a", 5, "user", "", "", "", False, ["\n<system-reminder> x", "\n"], False),
        ("b", 1, "user", "87654321", "/elsewhere", "", False, ["hello"], False), ("b", 2, "assistant", "", "", "", True, ["x"], True),
        ("c", 1, "user", "abcdefgh", "/elsewhere", "", False, ["hello there"], False), ("d", 1, "user", "", "", "", False, ["  "], False), ("e", 1, "user", "ffffffff", "", "", False, ["kept"], False),
    ]
    lines = spark.createDataFrame(rows, schema)
    about = {r["file"]: tuple(r)[1:] for r in sessions.metadata(lines).collect()}
    assert about["a"] == ("12345678-a", "repos\\p1\\src", "main", False) and about["b"][3]
    held = spark.createDataFrame([("vault/library/sessions/2024-01-01-000000-abcdefgh.md",), ("repos/p9/research/sessions/2024-ffffffff.md",)], "path string")
    notes = {r["file"]: r for r in sessions.capture_sessions(lines, held, "2025-03-01 10:20:30").collect()}
    assert set(notes) == {"a", "e"}
    assert notes["a"]["path"] == "repos/p1/research/sessions/2025-03-01-102030-12345678.md"
    text = notes["a"]["text"]
    assert "hunter2" not in text and "title" not in text.split("---")[1] and "git_branch: main" in text and "cwd: repos/p1/src" in text
    assert "# Session 2025-03-01 — Fix the DB_PASSWORD=[REDACTED] thing\n\n## Summary\nTask: Fix" in text and "## Decisions\n- We decided" in text and "## Files touched\n- C:\\data\\x.txt" in text and text.endswith("\n")


def test_memory_notes_are_never_overwritten(spark):
    schema = "seq long, content string, title string, project string, kind string, session_id string, cwd string"
    rows = [(1, "body sk_live_abcdefghijklmnop1", "My Title!", "p", "session", "../../ab-12345678", ""), (2, "other", "My title", "p", "odd", "../../ab-12345678", ""), (3, "x", "t", "../up", "note", "", ""), (4, None, None, None, None, None, "/nowhere")]
    held = spark.createDataFrame([("repos/p/research/sessions/2025-03-01-000000-ab-12345-my-title.md",)], "path string")
    found = {r["seq"]: r for r in sessions.capture_memories(spark.createDataFrame(rows, schema), held, "2025-03-01 00:00:00").collect()}
    assert [found[i]["status"] for i in (1, 2, 3, 4)] == ["written", "written", "error", "written"]
    assert found[1]["path"] == "repos/p/research/sessions/2025-03-01-000000-ab-12345-my-title-2.md" and found[2]["path"].endswith("my-title-3.md")
    assert "sk_live" not in found[1]["text"] and "# Session 2025-03-01 — My Title!\n\nbody" in found[1]["text"] and "type: note" in found[2]["text"] and "# My title" in found[2]["text"]
    assert found[4]["path"].startswith("vault/library/sessions/2025-03-01-000000-adhoc-untitled")


def test_consolidate_supersedes_and_reports(spark):
    reports = spark.createDataFrame([("p", "s/b.md", "- the server no longer uses port eighty for all traffic"), ("p", "s/a.md", "a wholly new fact about cats and dogs"), ("q", "s/c.md", "short"), ("r", "s/d.md", "another fact that stands alone here")], "project string, doc_path string, text string")
    old = "# p\n\n_Consolidated 2024-01-01 from 1 session capture(s)._\n\nthe server uses port eighty for all traffic\nthe moon is made of rock and dust only\n\n## Sources\n- z.md\n"
    notes = spark.createDataFrame([("p", old)], "project string, text string")
    found = {r["project"]: r for r in sessions.consolidate(reports, notes, "2025-03-01").collect()}
    assert {k: (r["status"], r["nli"], r["n_contradictions"]) for k, r in found.items()} == {"p": ("consolidated", "ran", 1), "q": ("empty_consolidation", "no_prior_note", 0), "r": ("consolidated", "no_prior_note", 0)}
    note = found["p"]["note"]
    body = note.split(X.CONTRADICTIONS)[0]
    assert "the server uses port eighty" not in body and "moon is made of rock" in body and body.index("moon") < body.index("wholly new") < body.index("no longer")
    assert "- **prior:** the server uses port eighty for all traffic\n  **newer:** the server no longer" in note and note.endswith("## Sources\n- a.md\n- b.md\n")
    assert spark.createDataFrame([(note,)], "n string").select(X.canonical_body(F.col("n"))).first()[0] == body.split("_\n\n", 1)[1].strip()


def test_recent_sessions(spark):
    rows = [("/r/repos/p/research/sessions/a.md", "2025-02-20 00:00:00"), ("/r/repos/p/research/sessions/deep/b.md", "2025-02-20 00:00:00"), ("/r/repos/q/research/sessions/c.md", "2024-01-01 00:00:00"), ("/r/vault/library/sessions/d.md", "2025-02-28 00:00:00"), ("/r/repos/p/docs/e.md", "2025-02-28 00:00:00")]
    files = spark.createDataFrame(rows, "path string, modified string").withColumn("modified", F.col("modified").cast("timestamp"))
    names = lambda *a: sorted(r["path"][-4:] for r in sessions.recent_sessions(files, *a).collect())
    assert names(None, 30, "2025-03-01") == ["a.md", "d.md"] and names(None, 0, "2025-03-01") == ["a.md", "c.md", "d.md"]
    assert names("p", -1, "2025-03-01") == ["a.md"] and names("q", 10**9, "2025-03-01") == ["c.md"]


def test_prompt_budget(spark):
    of = lambda r, e: tuple(spark.range(1).select(models.prompt_budget(F.lit(r), F.lit(e), 4096, 300, 200).alias("b")).first()["b"])
    most = 32_768 - 4096 - 512
    assert of(100, 50) == (100, 50, True) and of(most - 310, 50) == (most - 310, 10, True)
    assert of(most - 300, 50) == (most - 300, 0, False) and of(most, 50) == (most - 200, 0, False) and of(10, 0) == (10, 0, False)


def test_contexts_never_fail_an_ingest(spark):
    chunks = spark.createDataFrame([("a", 0, "one"), ("a", 1, "two"), ("b", 0, "three")], "doc_path string, chunk_index int, text string")
    docs = spark.createDataFrame([("a", "whole a with API_KEY=abcdefgh12")], "doc_path string, text string")
    assert models.contextualised(chunks, docs) is chunks
    said = models.contextualised(chunks, docs, lambda doc, chunk: F.when(chunk == "one", F.concat(F.lit("from "), doc)))
    assert sorted(r["text"] for r in said.collect()) == ["from whole a with API_KEY=[REDACTED]\n\none", "three", "two"]


def test_rebuilt_summaries_replace_the_old(spark):
    from foliant.plans import registry
    from foliant.sources import catalog

    leaves = catalog.chunk_rows(registry._files(spark, "/root/testdata/sf0.001"), registry.BEFORE).drop("seq").cache()
    once = clusters.rebuilt(leaves, registry.NOW).cache()
    twice = clusters.rebuilt(once, registry.NOW)
    made = once.where("tier = 1")
    assert made.count() > 0 and made.where("source_type = 'session' or vector is null or chunk_index <> -1").count() == 0
    assert once.columns == leaves.columns and sorted(r[0] for r in twice.select("chunk_id").collect()) == sorted(r[0] for r in once.select("chunk_id").collect())
    assert catalog.without_summaries(once).count() == leaves.count()


def test_sweep_counts_what_clusters_finds(spark):
    rng = np.random.default_rng(5)
    rows = [(f"d{d}", i, rng.normal(size=4).tolist(), "docs") for d in range(6) for i in range(rng.integers(1, 9))]
    frame = spark.createDataFrame(rows, "doc_path string, chunk_index int, vector array<double>, source_type string")
    for r in clusters.sweep(frame, [(0.3, 2), (0.8, 3)]).collect():
        found = clusters.clusters(frame, r["cut"], r["least"])
        assert (r["n_clusters"], r["n_chunks"]) == (found.select("doc_path", "cluster").distinct().count(), found.count())
