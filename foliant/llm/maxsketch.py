"""Ranked lexical search over hashed max-sketches.

The index has a row for each document: its terms with their counts, and a sketch, in which each term's
count is folded by maximum into the coordinates that its hash names, one in each of three rows; the least of the three
is the bound that a lookup takes. A term's impact grows with its count alone (its
document's length and the term's weight are fixed), so the greatest impact at a coordinate follows from
the greatest count, whatever the corpus grows to. A batch of queries looks its terms' coordinates
up in the sketches of many documents at once, which gives upper bounds of all scores; documents are then
scored exactly by falling bound, until no bound reaches the k-th best score.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, text_bytes
from .words import binary_array, coded_words, grouped

#: Rows of a sketch; coordinates of a row for each distinct term of a document (rounded up to a power of two), and for any document at least.
ROWS, LOAD, LEAST_WIDTH = 3, 4, 64
#: A count of so many or more is taken as boundless.
MOST = 255
#: Bytes of terms in a part of the index, terms of queries in a block, and numbers in a matrix of bounds, about.
PART_BYTES, BLOCK_TERMS, STEP = 4_000_000, 200_000, 2_000_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: What each byte becomes: A-Z lower case, what stands between terms a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
INDEX = "doc_id long, n long, sketch binary, terms binary, counts binary"


def hashes(names: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))


def coordinate(hashed: np.ndarray, row: int, size: int | np.ndarray) -> np.ndarray:
    """Places of terms in a row of that size: other bits of the hash for each row."""
    return (hashed >> np.uint64(21 * row)).astype(np.int64) & (size - 1)


def sketched(texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array, pa.Array]:
    """(terms with repeats, sketches, distinct terms joined by spaces, their counts as int32) of each text."""
    names, numbers, starts = coded_words(texts, _TABLE)
    lengths = np.diff(starts)
    if not names:
        return lengths, *(pa.array([b""] * len(texts), pa.large_binary()) for _ in range(3))
    pairs, counts = np.unique(np.repeat(np.arange(len(texts), dtype=np.int64), lengths) * len(names) + numbers, return_counts=True)
    owner, number = pairs // len(names), pairs % len(names)
    distinct = np.bincount(owner, minlength=len(texts))
    widths = 1 << np.ceil(np.log2(np.maximum(LOAD * distinct, LEAST_WIDTH))).astype(np.int64)
    cuts = np.append(0, np.cumsum(ROWS * widths))
    flat, hashed, size, folded = np.zeros(cuts[-1], np.uint8), hashes(names)[number], widths[owner], np.minimum(counts, MOST).astype(np.uint8)
    for row in range(ROWS):
        np.maximum.at(flat, cuts[owner] + row * size + coordinate(hashed, row, size), folded)
    ends = np.append(0, np.cumsum(distinct))
    lists = pa.LargeListArray.from_arrays(ends, pa.array(names, pa.large_binary()).take(pa.array(number)))
    joined = pc.binary_join(lists, pa.scalar(b" ", pa.large_binary()))
    return lengths, binary_array(flat, cuts), joined, binary_array(counts.astype("<i4").view(np.uint8), 4 * ends)


def build_index(docs: DataFrame) -> DataFrame:
    """documents -> the staged index (doc_id, n, sketch, terms, counts), a row for each row; null texts have no terms."""
    names = ("doc_id", "n", "sketch", "terms", "counts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ids = 0, batch.column("doc_id")
            for texts in grouped(batch.column("body")):
                lengths, *columns = sketched(texts)
                yield pa.record_batch([ids.slice(at, len(texts)), pa.array(lengths, pa.int64()), *(c.cast(pa.binary()) for c in columns)], names=names)
                at += len(texts)

    return stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body")).mapInArrow(run, INDEX), "sketches")


def document_counts(index: DataFrame) -> DataFrame:
    """(term, df) of every term of the index; terms are counted a batch at a time before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms in grouped(batch.column("terms")):
                names, numbers, _ = coded_words(terms, _TABLE)
                yield pa.record_batch([pa.array(names, pa.binary()).cast(pa.string()), pa.array(np.bincount(numbers, minlength=len(names)), pa.int64())], names=("term", "df"))

    return index.select("terms").mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, text) -> distinct (item_id, term)."""
    lower = F.translate(F.coalesce("text", F.lit("")), _UPPER, _UPPER.lower())
    found = F.array_distinct(F.regexp_extract_all(lower, F.lit(_TERM), 0))
    return items.where("item_id is not null").select("item_id", F.explode(found).alias("term")).distinct()


def bounds(counts: np.ndarray, m: np.ndarray, weights: np.ndarray, terms: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Documents x items. counts: documents x distinct terms, as looked up; terms: the terms of all items in order; starts: where an item's begin."""
    row, column = np.nonzero(counts)
    tf = counts[row, column].astype(np.int64)
    impact = np.where(tf == MOST, 1_000_000, 1_000_000_000 * tf // (1000 * tf + 8 * m[row]))
    values = np.zeros(counts.shape, np.int64)
    values[row, column] = impact * weights[column]
    return np.add.reduceat(values[:, terms], starts, axis=1)


class Best:
    """The k best (score, document) of each item so far; equal scores by ascending doc_id, null last."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.heaps = k, [[] for _ in range(items)]
        self.least = np.ones(items, np.int64)  # a score below this changes nothing

    def add(self, item: int, score: int, doc_id: int | None) -> None:
        heap, key = self.heaps[item], (score, doc_id is not None, -(doc_id or 0))
        if len(heap) < self.k:
            heapq.heappush(heap, key)
        elif key > heap[0]:
            heapq.heapreplace(heap, key)
        if len(heap) == self.k:
            self.least[item] = heap[0][0]


def _cell(docs: pa.Table, items: pa.Table, k: int) -> pa.Table:
    """The k best documents of a part of the index for each item of a block."""
    lists = items.column("terms").combine_chunks()
    starts = lists.offsets.to_numpy()[: len(items)] - lists.offsets[0].as_py()
    coded = lists.flatten().dictionary_encode()
    vocabulary = [x.encode() for x in coded.dictionary.to_pylist()]
    terms, number = coded.indices.to_numpy(), {x: i for i, x in enumerate(vocabulary)}
    weights = np.zeros(len(vocabulary), np.int64)
    weights[terms] = items.column("weights").combine_chunks().flatten().to_numpy()
    hashed, own = hashes(vocabulary), [x.tolist() for x in np.split(terms, starts[1:])]
    best = Best(len(items), k)
    sketches, names, counts = (docs.column(c) for c in ("sketch", "terms", "counts"))
    sizes, m, ids = pc.binary_length(sketches).to_numpy(), docs.column("m").to_numpy(), docs.column("doc_id").to_pylist()
    for size in np.unique(sizes).tolist():
        rows, step = np.flatnonzero(sizes == size), max(1, STEP // max(size, len(terms)))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            rows_of = np.frombuffer(b"".join(sketches.take(some).to_pylist()), np.uint8).reshape(len(some), ROWS, size // ROWS)
            found = np.minimum.reduce([rows_of[:, row, coordinate(hashed, row, size // ROWS)] for row in range(ROWS)])
            above = bounds(found, m[some], weights, terms, starts)
            impacts: dict[int, dict[int, int]] = {}
            for i in np.flatnonzero((above >= best.least).any(axis=0)).tolist():
                column = above[:, i]
                open_ = np.flatnonzero(column >= best.least[i])
                for j in open_[np.argsort(-column[open_], kind="stable")].tolist():
                    if column[j] < best.least[i]:
                        break
                    if j not in impacts:
                        r, mj = int(some[j]), int(m[some[j]])
                        tfs = np.frombuffer(counts[r].as_py(), "<i4").tolist()
                        held = ((number[x], tf) for x, tf in zip(names[r].as_py().split(b" "), tfs, strict=True) if x in number)
                        impacts[j] = {t: int(weights[t]) * (1_000_000_000 * tf // (1000 * tf + 8 * mj)) for t, tf in held}
                    score = sum(map(impacts[j].get, own[i], repeat(0)))
                    if score:
                        best.add(i, score, ids[some[j]])
    out = [(i, score, -doc if there else None) for i, heap in enumerate(best.heaps) for score, there, doc in heap]
    at, score, doc_id = zip(*out, strict=True) if out else ((), (), ())
    return pa.table([items.column("item_id").take(pa.array(at, pa.int64())), pa.array(doc_id, pa.int64()), pa.array(score, pa.int64())], names=("item_id", "doc_id", "score"))


def search(index: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """items (item_id long, text) against every document of the index -> (item_id, rank, doc_id, score), each item's k best with a score above 0.

    Equal scores go by ascending doc_id, null last. Rows of one item_id are one item with the terms of them
    all; rows without an item_id, and terms that no document has, ask for nothing. Rows of documents that
    repeat a doc_id rank each for itself. An empty table on either side gives no rows.
    Parts of the index meet blocks of items in cells, each bounded whatever the sizes of both; an item is not split.
    """
    spark = index.sparkSession
    size = index.agg(F.count_if(F.col("n") > 0).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L"), F.coalesce(F.sum(F.octet_length("terms")), F.lit(0)).alias("bytes")).first()
    total, length = size["N"], max(size["L"], 1)
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * total + 2) / (F.lit(2.0) * F.col("df") + 1)))
    weighted = stage(item_terms(items).join(document_counts(index), "term").select(F.col("item_id").cast("long").alias("item_id"), "term", weight.alias("weight")), "item_terms")
    blocks = max(1, math.ceil(weighted.count() / BLOCK_TERMS))
    parts = max(1, math.ceil(size["bytes"] / PART_BYTES))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # by a hash of the document, so that one part has no more of a hot id than another
    part = F.pmod(F.xxhash64("doc_id", "terms", F.monotonically_increasing_id()), F.lit(parts)).cast("int")
    m = F.expr(f"10 + (90 * n * {total}L) div {length}L")
    left = index.where("n > 0").select("doc_id", m.alias("m"), "sketch", "terms", "counts", part.alias("p")).withColumn("q", each(blocks))
    listed = F.array_sort(F.collect_list(F.struct("term", "weight")))
    asked = weighted.groupBy("item_id").agg(listed.alias("x")).select("item_id", F.col("x.term").alias("terms"), F.col("x.weight").alias("weights"))
    right = asked.withColumn("q", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")).withColumn("p", each(parts))

    def run(docs: pa.Table, some: pa.Table) -> pa.Table:
        if not len(docs) or not len(some):
            return pa.table([pa.array([], pa.int64())] * 3, names=("item_id", "doc_id", "score"))
        return _cell(docs, some, k)

    found = left.groupBy("p", "q").cogroup(right.groupBy("p", "q")).applyInArrow(run, "item_id long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """search() over documents (doc_id, text), whose other columns are not looked at."""
    return search(build_index(docs), items, k)
