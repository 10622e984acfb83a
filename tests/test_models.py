"""Models behind columns: batches, memory that runs out, and the default embedder in plain form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import models, runner
from foliant.sources import catalog


def lengths_of(limit):
    """A model that gives each text's length and runs out of memory beyond `limit` rows."""

    def load():
        def work(rows):
            if len(rows) > limit:
                raise RuntimeError("CUDA out of memory: tried to allocate")
            return [sum(map(len, row)) for row in rows]

        return work

    return load


def test_batches_are_halved_until_they_fit(spark):
    texts = ["x" * (i % 37) for i in range(500)] + [None]
    frame = spark.createDataFrame(list(enumerate(texts)), "i long, text string").repartition(3)
    for limit in (1, 3, 1000):
        model = runner.Model(lengths_of(limit), "int", batch=64)
        found = {r["i"]: r["n"] for r in frame.select("i", model(F.col("text")).alias("n")).collect()}
        assert found == {i: None if t is None else len(t) for i, t in enumerate(texts)}
    two = runner.Model(lengths_of(5), "int", batch=7)
    assert all(r["n"] == len(r["text"]) + 2 for r in frame.where("text is not null").select("text", two(F.col("text"), F.lit("ab")).alias("n")).collect())
    with pytest.raises(Exception, match="out of memory"):
        frame.select(runner.Model(lengths_of(0), "int")(F.col("text"))).collect()


def test_other_errors_are_not_retried():
    calls = []

    def work(rows):
        calls.append(len(rows))
        raise ValueError("wrong input")

    with pytest.raises(ValueError, match="wrong input"):
        runner.answered(work, [("a",), ("b",)], 8, 100)
    assert calls == [2]
    with pytest.raises(ValueError, match="results"):
        runner.answered(lambda rows: [1], [("a",), ("b",)], 8, 100)


def test_batches_keep_to_rows_and_length():
    sizes = [5, 100, 1, 1, 1, 40, 40, 0]
    found = list(runner.batches(sizes, 3, 80))
    assert sorted(i for some in found for i in some) == list(range(8))
    assert all(len(some) <= 3 and (len(some) == 1 or sum(sizes[i] for i in some) <= 80) for some in found)
    assert found[0] == [1]


def test_a_model_is_loaded_once_a_worker(spark, tmp_path):
    def load():
        (tmp_path / f"{np.random.default_rng().integers(1 << 60)}").touch()
        return lambda rows: [1] * len(rows)

    model = runner.Model(load, "int", batch=5)
    frame = spark.range(0, 3000, 1, 12).select(F.col("id").cast("string").alias("t"))
    frame.select(model(F.col("t"))).collect()
    frame.select(model(F.col("t"))).collect()
    assert len(list(tmp_path.iterdir())) <= 8  # a worker for each of the session's cores, perhaps one more while one ends


def test_default_embedder(spark):
    texts = ["a b  a", "", None, "Über über x", "same same same", "word " * 5000]
    found = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", models.embed("text").alias("v")).collect()
    assert all(np.allclose(r["v"], models.bag_vector(texts[r["i"]]), atol=1e-7) for r in found)


def test_models_of_ones_own(spark):
    """An embedder and a context function of one's own reach the chunk table; the hash is that of the text with its context."""
    shape = "doc_path string, source_type string, text string, authored_at timestamp_ntz, seq long"
    files = spark.createDataFrame([("repos/a/docs/x.md", "docs", "# X\n\nSome text of a file.", None, 1)], shape)
    own = runner.Model(lambda: lambda rows: [[float(len(t)), 1.0] for (t,) in rows], "array<float>")
    said = runner.Model(lambda: lambda rows: [f"Of {len(doc)} characters" for doc, _ in rows], "string")
    (row,) = catalog.chunk_rows(files, "2025-01-01 00:00:00", embedder=own, context=said).collect()
    (plain,) = catalog.chunk_rows(files, "2025-01-01 00:00:00").collect()
    assert row["text"] == f"Of 25 characters\n\n{plain['text']}" and row["vector"] == [float(len(row["text"])), 1.0]
    assert row["content_hash"] != plain["content_hash"] and row["char_start"] == plain["char_start"]


def test_summary_headings(spark):
    frame = spark.createDataFrame([(1, ["(no heading)", "", "B", None, "A", "B", "C", "D"]), (2, ["(no heading)"]), (3, [])], "i int, h array<string>")
    assert [r["x"] for r in frame.select(models.summary_heading(F.col("h")).alias("x")).collect()] == ["B / A / C", "(cluster summary)", "(cluster summary)"]
