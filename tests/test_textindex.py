"""The stored full-text index against a search that reads every document."""

import random

from pyspark.sql import functions as F

from foliant.operators import fulltext
from foliant.sources import textindex
from foliant.sources.textindex import TextIndex


def rows(frame):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 6)) for r in frame.collect())


def corpus(spark, seed=3, n=400):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(120)]
    texts = [" ".join(words[min(int(rng.expovariate(0.06)), 119)] for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return [(i, t) for i, t in enumerate(texts)] + [(n, None), (n + 1, ""), (n + 2, "rare word w1")]


def asked(spark):
    return spark.createDataFrame([(1, "w1 w50 w90"), (2, "rare"), (3, "nowhere"), (4, "w0 w0 w2"), (5, "w110 w3 w111 w4"), (6, None), (7, "word W7")], "query_id long, text string")


def test_folds_equal_a_whole_search(spark, tmp_path):
    """Documents that come, go, come back changed and are compacted away: every version gives what a search over the live documents gives."""
    docs, q = corpus(spark), asked(spark)
    frame = lambda some: spark.createDataFrame(some, "id long, text string")
    ids = lambda some: spark.createDataFrame([(i,) for i in some], "id long")
    index = TextIndex(spark, str(tmp_path / "index"), window=16, buckets=8)
    assert index.search(q).count() == 0 and index.compact() == 0
    index.fold(frame(docs[:250]))
    assert rows(index.search(q, 5)) == rows(fulltext.search(frame(docs[:250]), q, 5))
    live = {i: t for i, t in docs if i % 5 and i not in (1, 2)} | {7: "w1 w1 rare", 11: "w50 back again"}
    index.fold(frame(docs[250:] + [(7, "w1 w1 rare")]), ids([*range(0, 250, 5), 1, 2, 7, 9999]))
    index.fold(frame([(11, "w50 back again")]), ids([11, *range(250, 403, 5)]))
    whole = frame(list(live.items()))
    expected = rows(fulltext.search(whole, q, 5))
    assert rows(index.search(q, 5)) == expected
    kept = ids(range(0, 403, 3))
    assert rows(index.search(q, 5, kept)) == rows(fulltext.search(whole, q, 5, kept))
    assert index.state()["docs"] == len(live)
    index.compact()
    assert rows(index.search(q, 5)) == expected and not index.state()["removed"]
    assert TextIndex(spark, str(tmp_path / "index")).state() == index.state()
    index.fold(frame([]), ids([]))
    assert index.clean_up(0) > 0 and rows(index.search(q, 5)) == expected
    index.fold(frame([]), ids(live))
    assert index.search(q, 5).count() == 0 and index.state()["docs"] == 0


def test_search_reads_the_blocks_of_its_terms(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "index"), window=16, buckets=8)
    index.fold(spark.createDataFrame(corpus(spark), "id long, text string"))
    blocks = index._blocks(index.state(), spark.createDataFrame([("rare",)], "term string"))
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    partition, pushed = plan.split("PartitionFilters: [")[1].split("]")[0], plan.split("PushedFilters: [")[1].split("]")[0]
    assert "bucket" in partition and "rare" in pushed
    assert blocks.count() == 1


def test_windows_that_cannot_reach_are_left_out(spark, tmp_path):
    """One window holds the long runs of a term; the others are not scored."""
    rng = random.Random(1)
    docs = [(i, " ".join(["common", *(f"x{rng.randrange(500)}" for _ in range(60))])) for i in range(600)] + [(1000 + i, "common " * 5 + "rare") for i in range(3)]
    index = TextIndex(spark, str(tmp_path / "index"), window=8, buckets=4)
    index.fold(spark.createDataFrame(docs, "id long, text string"))
    q = spark.createDataFrame([(1, "common rare")], "query_id long, text string")
    assert rows(index.search(q, 3)) == rows(fulltext.search(spark.createDataFrame(docs, "id long, text string"), q, 3))
    (row,) = index.pruned(q, 3).collect()
    assert row["windows"] > 60 and row["scored"] <= 8


def test_postings_do_not_move(spark):
    """Before, postings went through two shuffles on their way from texts to folders, each larger than the texts, which were dealt out twice."""
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} w{i % 5}") for i in range(40)], "id long, text string")
    lengths, counted = textindex.counted_terms(docs, 6)
    blocks = textindex.blocks_of(counted)
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (lengths, blocks)]
    assert [p.count("Exchange ") for p in plans] == [0, 1]
    found = {(r["term"], i, tf, n) for r in blocks.collect() for i, tf, n in zip(r["ids"], r["tfs"], r["lengths"], strict=True)}
    assert found == {(f"w{k}", i, [f"w{i % 7}", f"w{i % 5}", f"w{i % 5}"].count(f"w{k}"), 3) for i in range(40) for k in {i % 7, i % 5}}
    assert len({(r["term"], r["window"]) for r in blocks.collect()}) == blocks.count()


def test_windows_are_dealt_evenly(spark):
    ids = spark.range(3000)
    placed = textindex.placed(ids, 10)
    assert {r["n"] for r in placed.groupBy("task").agg(F.countDistinct("window").alias("n")).collect()} <= {2, 3}
    assert placed.rdd.getNumPartitions() == 4 and textindex.placed(ids, 100).rdd.getNumPartitions() == 25


def test_folders_of_older_indexes_are_found(spark, tmp_path):
    """An index whose pointer does not say how many folders it has was written with 64."""
    docs, q = spark.createDataFrame(corpus(spark)[:120], "id long, text string"), asked(spark)
    old = TextIndex(spark, str(tmp_path / "index"), window=16, buckets=64)
    old.fold(docs)
    old.pointer.commit({k: v for k, v in old.state().items() if k != "buckets"} | {"version": 2})
    index = TextIndex(spark, str(tmp_path / "index"), window=16)
    assert index.state()["buckets"] == 64 != index.buckets and rows(index.search(q, 5)) == rows(fulltext.search(docs, q, 5))
    index.fold(spark.createDataFrame([(900, "w1 rare w50")], "id long, text string"))
    assert rows(index.search(q, 5)) == rows(fulltext.search(docs.union(spark.createDataFrame([(900, "w1 rare w50")], "id long, text string")), q, 5))


def test_repeated_rows_and_texts_without_terms(spark, tmp_path):
    """The documents of a part come from its blocks: those without a term are there, and repeated rows and ids count each, as they do in a search over the documents."""
    some = [(1, "a b"), (2, None), (3, ""), (4, "..."), (5, "a"), (5, "a"), (6, "b a"), (6, "c b b"), (7, "d"), (4, "...")]
    docs = spark.createDataFrame(some, "id long, text string")
    index = TextIndex(spark, str(tmp_path / "index"))
    index.fold(docs)
    q = spark.createDataFrame([(1, "a"), (2, ""), (3, "b c")], "query_id long, text string")
    for _ in range(2):
        assert sorted(tuple(r) for r in index.documents().select("id", "length").collect()) == [(1, 2), (2, 0), (3, 0), (4, 0), (4, 0), (5, 1), (5, 1), (6, 2), (6, 3), (7, 1)]
        assert (index.state()["docs"], index.state()["tokens"]) == (10, 10)
        assert rows(index.search(q)) == rows(fulltext.search(docs, q))
        index.compact()
    more = spark.createDataFrame([(8, None)], "id long, text string")
    index.fold(more, spark.createDataFrame([(1,)], "id long"))
    assert rows(index.search(q)) == rows(fulltext.search(docs.where("id <> 1").union(more), q))


def test_a_fold_shuffles_its_texts_only(spark, tmp_path):
    """Before, a fold made five shuffles, two of texts and two of postings among them; now one of texts, and those of two counts."""
    docs, made = spark.createDataFrame(corpus(spark), "id long, text string"), spark.sparkContext._jsc.sc()
    index, first = TextIndex(spark, str(tmp_path / "index")), made.newShuffleId()
    index.fold(docs)
    assert made.newShuffleId() - first - 1 <= 3
