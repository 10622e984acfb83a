"""Quality classifier: random-indexing word vectors, a two-layer network, calibrated scores.

Every word and every word ending owns a sparse random index vector. Over all documents each
collects the index vectors of its neighbours; the sums are whole numbers, so their order
does not matter. A document is the mean of its words' vectors beside the mean of its
endings' vectors. The network is fitted on a bounded sample of labelled documents and its
temperature on a part of the sample that the fit does not see. Words share WORDS rows, and
endings ENDINGS rows, by a hash: the table that is broadcast and its sums on the driver stay of one
size whatever the vocabulary, and a rare word that shares a row with others weighs little in either.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, text_bytes
from .words import WHITE_TABLE, coded_words

DIMENSIONS = 32
WORDS, ENDINGS = 8192, 1024
#: Rows: words, endings, and the ending of a word equal to the one before it.
ROWS = WORDS + ENDINGS + 1
REPEATED = ROWS - 1
_BATCH_BYTES = 1_000_000


def index_vectors(seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Two dimensions and their signs for each row."""
    random = np.random.default_rng(seed)
    places = np.argsort(random.random((ROWS, DIMENSIONS)), axis=1)[:, :2]
    return places.astype(np.int64), random.choice(np.array([-1, 1]), (ROWS, 2))


def rows_of(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of all words, rows of all endings, and words of each body."""
    names, numbers, starts = coded_words(pa.array(bodies, pa.large_binary()), WHITE_TABLE)
    words = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names)) % np.uint64(WORDS)
    ends = np.fromiter((xxhash.xxh3_64_intdigest(w[-2:]) for w in names), np.uint64, len(names)) % np.uint64(ENDINGS)
    endings = ends.astype(np.int64)[numbers] + WORDS
    same = np.zeros(len(numbers), bool)
    same[1:] = numbers[1:] == numbers[:-1]
    same[starts[:-1][starts[:-1] < len(numbers)]] = False
    endings[same] = REPEATED
    return words.astype(np.int64)[numbers], endings, np.diff(starts)


def _groups(bodies: list[bytes]) -> Iterator[list[bytes]]:
    group, size = [], 0
    for body in bodies:
        group.append(body)
        size += len(body)
        if size >= _BATCH_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def word_vectors(docs: DataFrame, reach: int = 2) -> np.ndarray:
    """One vector per row, from neighbours up to `reach` words away in all documents; ROWS rows come to the driver."""
    places, signs = index_vectors()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(ROWS * DIMENSIONS)
        for batch in batches:
            for group in _groups(list(batch["body"])):
                words, endings, lengths = rows_of(group)
                document = np.repeat(np.arange(len(lengths)), lengths)
                for stream in (words, endings):
                    for step in range(1, reach + 1):
                        inside = document[step:] == document[:-step]
                        left, right = stream[:-step][inside], stream[step:][inside]
                        for one, other in ((left, right), (right, left)):
                            for k in range(2):
                                total += np.bincount(one * DIMENSIONS + places[other, k], weights=signs[other, k], minlength=len(total))
        counts = total.astype(np.int64).reshape(ROWS, DIMENSIONS)
        used = np.flatnonzero(counts.any(axis=1))
        yield pd.DataFrame({"row": used} | {f"c{k}": counts[used, k] for k in range(DIMENSIONS)})

    columns = [f"c{k}" for k in range(DIMENSIONS)]
    sums = docs.select(text_bytes().alias("body")).mapInPandas(run, "row int, " + ", ".join(f"{c} long" for c in columns))
    context = np.zeros((ROWS, DIMENSIONS))
    for row in sums.groupBy("row").agg(*[F.sum(c).alias(c) for c in columns]).toLocalIterator():
        context[row["row"]] = [row[c] for c in columns]
    context -= context.sum(axis=0) / max(np.abs(context).sum(), 1) * np.abs(context).sum(axis=1, keepdims=True)
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
    np.put_along_axis(own := np.zeros_like(context), places, signs, axis=1)
    return (context + own).astype(np.float32)


def pooled(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """documents -> staged (doc_id, vector as 2 * DIMENSIONS little-endian floats); no words give zeros."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        for batch in batches:
            out = []
            for group in _groups(list(batch["body"])):
                words, endings, lengths = rows_of(group)
                ends = np.cumsum(lengths)
                for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True):
                    n = max(b - a, 1)
                    mean = [np.bincount(stream[a:b] - low, minlength=size).astype(np.float32) @ table[low : low + size] if b - a > size // 4 else table[stream[a:b]].sum(axis=0) for stream, low, size in ((words, 0, WORDS), (endings, WORDS, ENDINGS + 1))]
                    out.append((np.concatenate(mean) / n).astype("<f4").tobytes())
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "vector": out})

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body"))
    return stage(source.mapInPandas(run, "doc_id long, vector binary"), "vectors")


@dataclass
class Network:
    """Standardised inputs, one hidden layer of tanh units, a logistic output, a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, batch: int = 256, rate: float = 0.01, decay: float = 1e-4, seed: int = 11) -> Network:
    """Adam on the logistic loss. Without labels of both classes the score is their smoothed share."""
    random = np.random.default_rng(seed)
    width = 2 * DIMENSIONS
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Network(np.zeros(width), np.ones(width), np.zeros((width, hidden)), np.zeros(hidden), np.zeros(hidden), float(np.log(share / (1 - share))))
    net = Network(x.mean(axis=0), x.std(axis=0) + 1e-6, random.normal(0, width**-0.5, (width, hidden)), np.zeros(hidden), random.normal(0, hidden**-0.5, hidden), 0.0)
    z = (x - net.mean) / net.scale
    weights = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second, t = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs):
        for at in np.array_split(random.permutation(len(y)), max(1, len(y) // batch)):
            h = np.tanh(z[at] @ weights[0] + weights[1])
            error = (1 / (1 + np.exp(-np.clip(h @ weights[2] + weights[3], -60, 60))) - y[at]) / len(at)
            back = np.outer(error, weights[2]) * (1 - h * h)
            t += 1
            for k, gradient in enumerate((z[at].T @ back + decay * weights[0], back.sum(axis=0), h.T @ error + decay * weights[2], np.array([error.sum()]))):
                first[k] = 0.9 * first[k] + 0.1 * gradient
                second[k] = 0.999 * second[k] + 0.001 * gradient**2
                weights[k] -= rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = weights[0], weights[1], weights[2], float(weights[3][0])
    return net


def calibrate(net: Network, x: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least logistic loss on unseen labels, by a search over powers."""
    if not len(y):
        return 1.0
    logits = net.logits(x)
    grid = np.exp(np.linspace(-2, 3, 201))
    loss = [np.logaddexp(0, np.where(y > 0, -1, 1) * logits / t).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of doc_id as text, mod 3, is 1; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> DataFrame:
    """documents, labels -> (doc_id, held_out, score, predicted), one row per document row.

    Fitted on at most max_labelled documents, those with the least hash of doc_id among the
    labelled ones that are not held out; a fifth of them sets the temperature. Word vectors
    come from all documents. Null and empty texts get the score of a zero vector. Repeated rows
    are scored each; of repeated labels the greater counts, null labels are ignored. An empty
    label table gives 0.5 throughout. Other columns, lang and source among them, are not
    looked at.
    """
    vectors = pooled(docs, word_vectors(docs))
    known = labels.where("doc_id is not null and quality is not null").where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = vectors.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "vector").limit(max_labelled).collect()
    x = np.array([np.frombuffer(r["vector"], "<f4") for r in rows], np.float64).reshape(len(rows), 2 * DIMENSIONS)
    y = np.array([float(r["y"] > 0) for r in rows])
    unseen = np.arange(len(rows)) % 5 == 4
    net = fit_network(x[~unseen], y[~unseen])
    net.temperature = calibrate(net, x[unseen], y[unseen])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            inputs = np.frombuffer(b"".join(batch["vector"]), "<f4").reshape(len(batch), -1).astype(np.float64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": net.scores(inputs)})

    scored = vectors.mapInPandas(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
