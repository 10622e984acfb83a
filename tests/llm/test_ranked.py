"""Ranked search over max-sketches against plain scoring of every document."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from foliant.llm import maxsketch
from foliant.llm.queries import QUERIES

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in _TERM.findall(text or "")]


def brute(docs, items, k=10):
    held = [(i, collections.Counter(terms(t))) for i, t in docs]
    total, length = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    wanted, out = {}, []
    for i, t in items:
        if i is not None:
            wanted.setdefault(i, set()).update(terms(t))
    for item, asked in wanted.items():
        scores = []
        for doc_id, c in held:
            n = sum(c.values())
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * (10 + 90 * n * total // length))) for t in asked if t in c)
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        out += [(item, r, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def collected(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_ranked_query(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet").select(c, "text") for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert collected(QUERIES["op11_ranked_search"](spark, sf_dir)) == brute(docs.collect(), items.collect())


@pytest.mark.parametrize("step, block", [(1, 3), (2_000_000, 200_000)])
def test_ranked_small_alphabet(spark, monkeypatch, step, block):
    """Many ties, counts beyond what a sketch holds, several blocks of items and documents taken one by one."""
    monkeypatch.setattr(maxsketch, "STEP", step)
    monkeypatch.setattr(maxsketch, "BLOCK_TERMS", block)
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(n))
    docs = [(i, text(rng.randint(0, 12))) for i in range(120)] + [(200, "a " * 300 + "b"), (201, "B " * 254), (202, "b " * 255), (3, "a b"), (None, "a b"), (None, None)]
    items = [(1, "a"), (2, "a b c"), (2, "H!"), (3, text(6)), (4, ""), (5, None), (None, "a"), (6, "nowhere"), (7, "Aa BB-cc")]
    found = maxsketch.ranked(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    assert collected(found) == brute(docs, items)


def test_ranked_odd_rows(spark, odd_rows, no_rows):
    items = spark.createDataFrame([(1, "alpha word1x1 日本 Ünï"), (2, "x y")], "item_id int, text string")
    rows = [tuple(r) for r in odd_rows.select("doc_id", "text").collect()]
    assert collected(maxsketch.ranked(odd_rows, items)) == brute(rows, [tuple(r) for r in items.collect()])
    assert maxsketch.ranked(no_rows, items).count() == maxsketch.ranked(odd_rows, items.limit(0)).count() == 0


def test_bounds_hold_and_prune():
    """No bound is below a score, and most documents are never scored."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"t{x}" for x in rng.zipf(1.3, rng.integers(5, 80)) % 3000) for _ in range(800)]
    lengths, sketches, names, counts = maxsketch.sketched(pa.array([t.encode() for t in texts]))
    m = 10 + 90 * lengths * len(texts) // lengths.sum()
    asked = [sorted({f"t{x}" for x in rng.zipf(1.3, 12) % 3000}) for _ in range(20)]
    docs = pa.table({"doc_id": np.arange(len(texts)), "m": m, "sketch": sketches.cast(pa.binary()), "terms": names.cast(pa.binary()), "counts": counts.cast(pa.binary())})
    items = pa.table({"item_id": np.arange(20), "terms": pa.array(asked), "weights": pa.array([[5000] * len(x) for x in asked], pa.list_(pa.int64()))})
    seen, scored, bounds, add = [], [], maxsketch.bounds, maxsketch.Best.add
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(maxsketch, "bounds", lambda *a: seen.append(bounds(*a)) or seen[-1])
        patch.setattr(maxsketch.Best, "add", lambda self, i, score, doc: scored.append((i, score, doc)) or add(self, i, score, doc))
        maxsketch._cell(docs, items, 10)
    held = [collections.Counter(t.split()) for t in texts]
    sizes = [len(x.as_py()) for x in sketches]
    order = [j for size in sorted(set(sizes)) for j, x in enumerate(sizes) if x == size]
    above = np.concatenate(seen)
    for place, j in enumerate(order):
        for i, own in enumerate(asked):
            assert above[place, i] >= sum(5000 * (10**9 * held[j][t] // (1000 * held[j][t] + 8 * int(m[j]))) for t in own if held[j][t])
    assert len(scored) < len(texts) * 20 / 4
