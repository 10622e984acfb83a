"""Benchmark decontamination over a positional inverted index.

The index is document-partitioned: one row per block of documents, holding the block's
terms, the number of postings of each and the sorted positions of every token, as deltas.
A phrase is found by intersecting offset-adjusted position lists, from the phrase's rarest
term in the block upwards, so common terms are only probed at positions that survive. Words
of an item near each other, in any order, are found around the places of the rarest one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_rows, keyed, stage, text_bytes
from .words import coded_words, grouped

#: Words are runs of digits, ASCII letters (lower-cased) and everything beyond ASCII.
_LETTERS = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

INDEX_SCHEMA = "block long, doc_ids array<long>, doc_ends binary, terms array<binary>, counts binary, deltas binary"
INDEX = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_ends", pa.binary()), ("terms", pa.list_(pa.binary())), ("counts", pa.binary()), ("deltas", pa.binary())])
#: Bytes of a row group of the stored index, about. A row is a block of some megabytes, and Parquet's writer looks at its sizes every 100 rows only unless it is told.
GROUP_BYTES = 8_000_000
Phrase = tuple[bytes, ...]


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_LETTERS).split()


def _index_block(block: int, ids: list, terms: list[bytes], tokens: np.ndarray, starts: np.ndarray) -> dict:
    """One row of the index: tokens are the numbers of all words, starts those of each document's first word, with the end."""
    order = np.argsort(tokens, kind="stable").astype(np.int64)
    counts = np.bincount(tokens, minlength=len(terms))
    deltas = np.diff(order, prepend=0)
    firsts = np.cumsum(counts)[:-1] if len(tokens) else np.empty(0, np.int64)
    deltas[firsts] = order[firsts]
    return {
        "block": block,
        "doc_ids": ids,
        "doc_ends": starts[1:].astype("<i8").tobytes(),
        "terms": terms,
        "counts": counts.astype("<i4").tobytes(),
        "deltas": deltas.astype("<i4").tobytes(),
    }


def build_index(docs: DataFrame, block_words: int = 250_000) -> DataFrame:
    """documents -> the stored index, in blocks of whole documents of about block_words words of six bytes; a longer document is a block alone.

    Row groups are of GROUP_BYTES or one block, so what a task holds of the index to write or read it does not follow the size of its input.
    """
    block_bytes = 6 * block_words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            at = 0
            for texts in grouped(batch.column("body"), block_bytes):
                ids = batch.column("doc_id").slice(at, len(texts)).to_pylist()
                at += len(texts)
                yield pa.RecordBatch.from_pylist([_index_block(block, ids, *coded_words(texts, _LETTERS))], INDEX)
                block += 1

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body"))
    groups = {"parquet.block.size": str(GROUP_BYTES), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
    return stage(source.mapInArrow(run, INDEX_SCHEMA), "postings", **groups)


class _Block:
    """One block of the index, ready to be searched."""

    def __init__(self, batch: pa.RecordBatch, i: int) -> None:
        self.block = batch.column("block")[i].as_py()
        self.ids = batch.column("doc_ids")[i].as_py()
        self.ends = np.frombuffer(batch.column("doc_ends")[i].as_py(), "<i8")
        self.terms = batch.column("terms")[i].values
        self.counts = np.frombuffer(batch.column("counts")[i].as_py(), "<i4").astype(np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        self.deltas = np.frombuffer(batch.column("deltas")[i].as_py(), "<i4")
        self.listed: dict[int, np.ndarray] = {}  # positions that were asked for

    def numbers(self, terms: list[bytes]) -> np.ndarray:
        """The block's numbers of these terms, -1 where it has none."""
        found = pc.index_in(pa.array(terms, self.terms.type), value_set=self.terms)
        return found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    def postings(self, term: int) -> np.ndarray:
        found = self.listed.get(term)
        if found is None:
            at = self.first[term]
            found = self.listed[term] = np.cumsum(self.deltas[at : at + self.counts[term]], dtype=np.int64)
        return found

    def document(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, positions, "right")

    def phrase(self, terms: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Start positions of the exact phrase, inside one document. offsets: places in the phrase, the rarest term first."""
        starts = self.postings(int(terms[offsets[0]])) - offsets[0]
        for offset in offsets[1:].tolist():
            listed = self.postings(int(terms[offset]))
            at = np.searchsorted(listed, starts + offset)
            starts = starts[listed[np.minimum(at, len(listed) - 1)] == starts + offset]
            if not len(starts):
                return starts
        starts = starts[starts >= 0]
        return starts[self.document(starts) == self.document(starts + len(terms) - 1)]

    def near(self, terms: np.ndarray, order: np.ndarray, span: int) -> np.ndarray:
        """Documents in which some run of `span` words holds all terms (distinct ones). order: the rarest term first."""
        at = self.postings(int(terms[order[0]]))
        docs = self.document(at)
        low, high = np.concatenate([[0], self.ends])[docs], self.ends[docs]
        left, right = [], []  # words from a place of the rarest term to the nearest place of each other term, or span
        for k in order[1:].tolist():
            listed = self.postings(int(terms[k]))
            i = np.searchsorted(listed, at)
            before, after = listed[np.maximum(i - 1, 0)], listed[np.minimum(i, len(listed) - 1)]
            back = np.where((i > 0) & (before >= low), np.minimum(at - before, span), span)
            ahead = np.where((i < len(listed)) & (after < high), np.minimum(after - at, span), span)
            keep = np.minimum(back, ahead) < span
            if not keep.all():
                at, docs, low, high, back, ahead = (x[keep] for x in (at, docs, low, high, back, ahead))
                left, right = [x[keep] for x in left], [x[keep] for x in right]
                if not len(at):
                    return docs
            left.append(back)
            right.append(ahead)
        if left:
            # taken from the left up to some distance, and the rest from the right
            back, ahead = np.array(left), np.array(right)
            by_left = np.argsort(back, axis=0)
            back, ahead = np.take_along_axis(back, by_left, 0), np.take_along_axis(ahead, by_left, 0)
            rest = np.maximum.accumulate(ahead[::-1], axis=0)[::-1]
            zero = np.zeros((1, len(at)), np.int64)
            docs = docs[(np.concatenate([zero, back]) + np.concatenate([rest, zero]) + 1).min(axis=0) <= span]
        return np.unique(docs)


class _Phrases:
    """A bounded block of phrases, grouped by length, as numbers into their own term list."""

    def __init__(self, phrases: Iterable[Phrase]) -> None:
        number: defaultdict[bytes, int] = defaultdict(count().__next__)
        by_length: defaultdict[int, list[tuple[int, list[int]]]] = defaultdict(list)
        for i, phrase in enumerate(phrases):
            by_length[len(phrase)].append((i, [number[w] for w in phrase]))
        self.terms = list(number)
        self.groups = [(np.array([i for i, _ in group]), np.array([p for _, p in group])) for _, group in sorted(by_length.items())]

    def present(self, block: _Block) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Number, local terms, and places of the terms by rarity in the block, of each phrase whose terms all occur in the block."""
        local = block.numbers(self.terms)
        for numbers, matrix in self.groups:
            terms = local[matrix]
            found = np.flatnonzero((terms >= 0).all(1))
            terms = terms[found]
            order = np.argsort(block.counts[terms], axis=1, kind="stable")
            yield from zip(numbers[found].tolist(), terms, order, strict=True)


def item_windows(words: list[bytes], window: int) -> list[Phrase]:
    """All runs of `window` words; a shorter item is one window, an empty one has none."""
    if len(words) <= window:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]


Owned = dict[Phrase, set[int]]


def query_blocks(items: DataFrame, window: int | None, block_words: int) -> Iterator[tuple[Owned, Owned]]:
    """(item_id, body) in blocks of about block_words words at most: distinct windows, or without a window distinct sets of words, with the items of each."""
    windows: Owned = {}
    wholes: Owned = {}
    n = 0
    for row in items.toLocalIterator():
        words = words_of(bytes(row["body"]))
        for phrase in item_windows(words, window) if window else []:
            n += len(phrase) if phrase not in windows else 0
            windows.setdefault(phrase, set()).add(row["item_id"])
        if words and not window:
            wholes.setdefault(tuple(sorted(set(words))), set()).add(row["item_id"])
            n += len(words)
        if n >= block_words:
            yield windows, wholes
            windows, wholes, n = {}, {}, 0
    if windows or wholes:
        yield windows, wholes


class _Query:
    """A block of the benchmark, as tasks search it."""

    def __init__(self, windows: Owned, wholes: Owned) -> None:
        self.phrases, self.owners = _Phrases(windows), [sorted(x) for x in windows.values()]
        self.wholes, self.near_owners = _Phrases(wholes), [sorted(x) for x in wholes.values()]


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), text_bytes().alias("body"))


def matches(index: DataFrame, benchmark: DataFrame, window: int | None = 13, slack: int = 20, block_words: int = 2_000_000) -> DataFrame:
    """(block, ordinal, doc_id, n_words, starts, ends, items, near) for every document of the index.

    starts, ends: disjoint word intervals that exact window matches cover, in order; items:
    the item_ids with a match. Without a window, these are empty, and near has the item_ids all of
    whose distinct words lie in one run of as many words of the document, and slack more, in any order. The benchmark is read in blocks of
    block_words words, one pass over the index for each, so no more than that is ever held by a task.
    """
    schema = "block long, ordinal int, doc_id long, n_words long, starts array<long>, ends array<long>, items array<long>, near array<long>"
    passes = []
    for windows, wholes in chain(query_blocks(_items(benchmark), window, block_words), [({}, {})]):
        if passes and not windows and not wholes:
            break
        shared = index.sparkSession.sparkContext.broadcast(_Query(windows, wholes))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(len(batch)):
                    yield _matched(_Block(batch, i), shared.value, slack)

        passes.append(index.mapInArrow(run, schema))
    if len(passes) == 1:
        return passes[0]
    together = passes[0]
    for more in passes[1:]:
        together = together.unionByName(more)
    spans = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))))
    united = {c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("items", "near")}
    joined = together.groupBy("block", "ordinal").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), spans.alias("spans"), *united.values())
    empty = F.array().cast("array<struct<starts:bigint,ends:bigint>>")
    merged = F.aggregate(
        "spans",
        empty,
        lambda done, x: F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["ends"] >= x["starts"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.get(done, F.size(done) - 1)["starts"].alias("starts"), F.greatest(F.get(done, F.size(done) - 1)["ends"], x["ends"]).alias("ends"))))).otherwise(F.concat(done, F.array(x))),
    )
    return joined.withColumn("spans", merged).select("block", "ordinal", "doc_id", "n_words", F.col("spans.starts").alias("starts"), F.col("spans.ends").alias("ends"), "items", "near")


def _matched(block: _Block, query: _Query, slack: int) -> pa.RecordBatch:
    n = int(block.ends[-1])
    change = np.zeros(n + 1, np.int32)
    items: list[set[int]] = [set() for _ in block.ids]
    near: list[set[int]] = [set() for _ in block.ids]
    hit = False
    for k, terms, order in query.phrases.present(block):
        starts = block.phrase(terms, order)
        if len(starts):
            hit = True
            np.add.at(change, starts, 1)
            np.add.at(change, starts + len(terms), -1)
            for d in np.unique(block.document(starts)):
                items[d].update(query.owners[k])
    for k, terms, order in query.wholes.present(block):
        for d in block.near(terms, order, len(terms) + slack):
            near[d].update(query.near_owners[k])
    begins = np.concatenate([[0], block.ends[:-1]])
    spans: list[tuple[list[int], list[int]]] = [([], []) for _ in block.ids]
    if hit:
        covered = np.concatenate([[0], (np.cumsum(change[:-1]) > 0).astype(np.int8), [0]])
        edges = np.flatnonzero(np.diff(covered))
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            d = int(block.document(a))
            while a < b:  # touching matches of neighbouring documents make one run
                end = min(b, block.ends[d])
                if end > a:
                    spans[d][0].append(int(a - begins[d]))
                    spans[d][1].append(int(end - begins[d]))
                a, d = end, d + 1
    n = len(block.ids)
    lists = [pa.array(x, pa.list_(pa.int64())) for x in ([s for s, _ in spans], [e for _, e in spans], [sorted(x) for x in items], [sorted(x) for x in near])]
    columns = [pa.array([block.block] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(block.ids, pa.int64()), pa.array(block.ends - begins), *lists]
    return pa.RecordBatch.from_arrays(columns, names=["block", "ordinal", "doc_id", "n_words", "starts", "ends", "items", "near"])


def proximity_matches(index: DataFrame, benchmark: DataFrame, slack: int = 20) -> DataFrame:
    """(doc_id, item_id): documents, each row of its own, and the items all of whose distinct words lie in one run of as many words of it, and slack more.

    Words may stand in any order. Null and empty texts, and items without words or with a null item_id, match nothing.
    """
    return matches(index, benchmark, None, slack).select("doc_id", F.explode("near").alias("item_id"))


def near_items(docs: DataFrame, benchmark: DataFrame, slack: int = 20) -> DataFrame:
    """documents, benchmark -> proximity_matches() of an index built for them."""
    return proximity_matches(build_index(docs), benchmark, slack)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, block_words: int = 250_000, query_words: int = 2_000_000) -> DataFrame:
    """documents, benchmark -> (doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one row per document row.

    A word is hit inside any occurrence of a `window`-word run of an item (a shorter item is
    one run). contaminated: n_hit > 0 and share * n_hit >= n_words. Null and empty texts have
    no words and are clean; repeated rows are judged each; benchmark rows with a null item_id
    are left out, repeated item_ids count once. An empty benchmark leaves all clean. Other
    columns are not looked at.
    """
    found = matches(build_index(docs, block_words), benchmark, window, block_words=query_words)
    zero = F.lit(0).cast("long")
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), zero, lambda x, y: x + y)
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    counted = found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"))
    return counted.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """documents -> the rows that contamination() finds clean, columns as they were.

    Null and empty texts are clean and stay; repeated rows are judged alike. An empty table stays
    empty. Documents are told apart by doc_id and a hash of text, so null and repeated ids need no
    care, and columns of any name may be there. Whole texts are not shuffled.
    """
    marked, number, digest = keyed(docs)
    # contamination() carries one number: a hash of the two, whose documents are then named by both
    judged = contamination(marked.select(F.xxhash64(number, digest).alias("doc_id"), "text"), benchmark, window, share)
    found = judged.where("contaminated").select(F.col("doc_id").alias("judged")).distinct()
    names = marked.select(F.col(number).alias("doc_id"), F.col(digest).alias("text_hash")).withColumn("judged", F.xxhash64("doc_id", "text_hash"))
    dropped = stage(names.join(found, "judged", "left_semi").select("doc_id", "text_hash").distinct(), "contaminated")
    return joined_rows(docs, dropped, "left_anti")
