"""MinHash near-duplicates against all pairs of whole sets."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from foliant.llm import minhash
from foliant.llm.queries import QUERIES


def shingles(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w[k : k + 2]) for k in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} if w else set()


def brute(docs, percent=80):
    sets, label = [shingles(t) for _, t in docs], list(range(len(docs)))
    for i, x in enumerate(sets):
        for j in range(i):
            shared = len(x & sets[j])
            if x and label[i] != label[j] and 100 * shared >= percent * (len(x) + len(sets[j]) - shared):
                old, new = label[i], label[j]
                label = [new if k == old else k for k in label]
    least = {}
    for k, (i, _) in zip(label, docs, strict=True):
        if i is not None:
            least[k] = min(least.get(k, i), i)
    return sorted(((i, len(s), least.get(k), i == least.get(k)) for (i, _), s, k in zip(docs, sets, label, strict=True)), key=repr)


def collected(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_near_dup_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert collected(QUERIES["op12_minhash_near_dup"](spark, sf_dir)) == brute(docs)


@pytest.mark.parametrize("progress, rows", [(0.7, 2000), (-1.0, 20)])
def test_groups_of_near_copies(spark, monkeypatch, progress, rows):
    """Copies of one text about the threshold, chains, exact copies and short texts; with blocks of 20 rows the last step does nearly all."""
    monkeypatch.setattr(minhash, "PROGRESS", progress)
    monkeypatch.setattr(minhash, "BLOCK_ROWS", rows)
    rng = random.Random(11)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]

    def copy(edits):
        words = list(base)
        for _ in range(edits):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10_000)}"
        return " ".join(words)

    docs = [(i, copy(rng.randint(0, 14))) for i in range(150)] + [(200 + i, " ".join(f"c{k}" for k in range(i * 4, i * 4 + 60))) for i in range(12)]
    docs += [(300 + i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 4)))) for i in range(30)] + [(400, "A b"), (401, "a\tB"), (402, "a"), (403, "A "), (404, "a a")]
    assert collected(minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))) == brute(docs)


def test_near_dup_odd_rows(spark, odd_rows, no_rows):
    docs = [tuple(r)[:2] for r in odd_rows.collect()]
    assert collected(minhash.near_duplicates(odd_rows)) == brute(docs)
    assert minhash.near_duplicates(no_rows).count() == 0
    alone = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (None, None)], "doc_id int, text string")
    assert collected(minhash.near_duplicates(alone)) == [(None, 0, None, True), (None, 2, None, True), (None, 2, None, True)]


def test_sketches_fill_and_concentrate():
    """Every coordinate of every set is filled, one element or many; the share of equal coordinates is close to the similarity."""
    t, rng = minhash.BANDS * minhash.BAND, np.random.default_rng(2)
    elements = rng.integers(1, 2**63, 3000).astype(np.uint64)
    sets = [elements[:1], elements[:2], elements[:7], elements[:1000], elements[200:1200], elements[:0]]
    sketched = minhash.sketches(np.concatenate(sets), np.append(0, np.cumsum([len(x) for x in sets])), t)
    assert (sketched[:5] != minhash._EMPTY).all() and (sketched[5] == minhash._EMPTY).all()
    assert abs((sketched[3] == sketched[4]).mean() - 800 / 1200) < 0.15
    assert abs((sketched[0] == sketched[1]).mean() - 1 / 2) < 0.15
    alone = minhash.sketches(sets[3], np.array([0, 1000]), t)
    assert (alone[0] == sketched[3]).all()


def test_recall_at_the_threshold():
    """Of 400 pairs of similarity 0.8, small sets and large, every one shares a band."""
    rng, t = np.random.default_rng(4), minhash.BANDS * minhash.BAND
    for shared, own in ((4, 1), (40, 5), (400, 50)):
        for _ in range(130):
            pool = rng.integers(1, 2**63, shared + 2 * own).astype(np.uint64)
            x, y = (pool[: shared + 1], pool[:shared]) if own == 1 else (pool[: shared + own], np.append(pool[:shared], pool[shared + own :]))
            keys = minhash.band_keys(minhash.sketches(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), t))
            assert (keys[0] == keys[1]).any()


def test_sets_of_a_batch():
    texts = ["One two ONE two", "", "word", "a b", "a\n\x0bb c", " ", "ß ß"]
    elements, starts = minhash.shingle_sets(pa.array([x.encode() for x in texts]))
    assert np.diff(starts).tolist() == [len(shingles(x)) for x in texts]
    assert elements[starts[3]] in elements[starts[4] : starts[5]]
