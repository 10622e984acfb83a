"""Packing of documents into training sequences by lexical retrieval.

Documents are dealt into bounded shards by a min-hash of their token pairs, so copies and
relatives meet, and large groups spread over several shards. Each shard has a BM25 inverted
index over token ids with counts taken over all documents. All terms of a seed document
are looked up; its unused neighbours in the shard fill the window in order of score. A document that
does not fit is cut, and its rest seeds the next window, so every window is full; the last
ids of a partition go to windows of falling powers of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, text_bytes, width
from .tokens import encoder, id_type, with_end

K1, B = 1.2, 0.75
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Coded documents, and for each task one row of the ids it met and the documents that hold each (with no ids of its own).
CODED = "doc_id long, key long, ids binary, used binary, held binary, n_docs long, n_ids long"


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    values ^= values >> np.uint64(29)
    return (values * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(1)


def pair_keys(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Least hash of two neighbouring ids of each text (of its id, if it has one only): equal for two texts as often as their pairs agree."""
    wide = ids.astype(np.uint64)
    pairs = _mixed(np.concatenate([wide[:-1] << np.uint64(32) | wide[1:], wide[-1:]]))
    last = starts[1:] - 1
    pairs[last] = np.uint64(1 << 63)
    single = last[np.diff(starts) == 1]
    pairs[single] = _mixed(wide[single])
    return np.minimum.reduceat(pairs, starts[:-1]).astype(np.int64)


def _distinct(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, id, count) of the distinct ids of each text, by text and id."""
    text = np.repeat(np.arange(len(starts) - 1, dtype=np.uint64), np.diff(starts))
    pairs, counts = np.unique(text << np.uint64(32) | ids, return_counts=True)
    return (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64), counts


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """documents -> staged CODED rows; ids have the end id behind and are of id_type(tokenizer_path)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_docs, n_ids = np.zeros(0, np.int64), 0, 0

        def rows(doc_id, key, ids, *counts) -> pa.RecordBatch:
            blank = pa.nulls(len(doc_id))
            columns = [doc_id, key, ids, *(counts or [blank] * 4)]
            kinds = (pa.int64(), pa.int64(), pa.large_binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "key", "ids", "used", "held", "n_docs", "n_ids"])

        for batch in batches:
            at = 0
            for coded in encoder(tokenizer_path).encode(batch.column("body")):
                ids, starts = with_end(*coded, end_id)
                n = len(starts) - 1
                found = np.bincount(_distinct(ids, starts)[1], minlength=len(held))
                found[: len(held)] += held
                held, n_docs, n_ids = found, n_docs + n, n_ids + len(ids)
                payload = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(starts * ids.dtype.itemsize), pa.py_buffer(ids)])
                yield rows(batch.column("doc_id").slice(at, n), pa.array(pair_keys(ids, starts)), payload)
                at += n
        used = np.flatnonzero(held)
        if n_docs:
            yield rows(pa.nulls(1), pa.nulls(1), pa.nulls(1), pa.array([used.astype("<u4").tobytes()]), pa.array([held[used].astype("<i8").tobytes()]), pa.array([n_docs]), pa.array([n_ids]))

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body"))
    return stage(source.mapInArrow(run, CODED), "ids")


def document_counts(coded: DataFrame) -> tuple[np.ndarray, int, float]:
    """Documents holding each id, all documents, and ids per document: one row per id of the vocabulary comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for used, held in zip(batch.column("used").to_pylist(), batch.column("held").to_pylist(), strict=True):
                at = np.frombuffer(used, "<u4")
                total = np.concatenate([total, np.zeros(max(0, int(at.max()) + 1 - len(total)), np.int64)])
                total[at] += np.frombuffer(held, "<i8")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    tasks = coded.where("used is not null")
    size = tasks.agg(F.sum("n_docs"), F.sum("n_ids")).first()
    rows = tasks.select("used", "held").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(max((r["id"] for r in rows), default=-1) + 1, np.int64)
    for row in rows:
        total[row["id"]] = row["n"]
    return total, size[0] or 0, (size[1] or 0) / max(size[0] or 0, 1)


class Bm25Shard:
    """Inverted index over the documents of one shard; neighbours(d) gives d's unused ones, by all terms of d or its strongest.

    Terms of an eighth of the documents or more keep a weight for every document, as adding up such
    rows is cheaper than adding at listed places; there are at most eight times a document's terms of them.
    """

    def __init__(self, texts: list[np.ndarray], idf: np.ndarray, mean_length: float, query_terms: int | None = None) -> None:
        n = len(texts)
        starts = np.cumsum([0, *map(len, texts)])
        text, term, tf = _distinct(np.concatenate(texts) if n else np.empty(0, np.uint16), starts)
        weight = (idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * np.diff(starts)[text] / mean_length))).astype(np.float32)
        self.queries = np.split(term, np.searchsorted(text, np.arange(1, n)))
        if query_terms is not None:
            self.queries = [q[np.argsort(-w, kind="stable")[:query_terms]] for q, w in zip(self.queries, np.split(weight, np.searchsorted(text, np.arange(1, n))), strict=True)]
        order = np.argsort(term, kind="stable")
        self.docs, self.weights = text[order], weight[order]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(idf)))])
        self.row = np.full(len(idf), -1, np.int64)
        common = np.flatnonzero(8 * np.diff(self.starts) >= max(n, 1))
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), n), np.float32)
        for i, t in enumerate(common):
            a, b = self.starts[t], self.starts[t + 1]
            self.rows[i, self.docs[a:b]] = self.weights[a:b]
        self.unused = np.ones(n, bool)

    def _scores(self, seed: int) -> np.ndarray:
        terms = self.queries[seed]
        row = self.row[terms]
        score = np.zeros(len(self.unused), np.float32)
        for i in row[row >= 0].tolist():
            score += self.rows[i]
        rare = terms[row < 0]
        for a, b in zip(self.starts[rare].tolist(), self.starts[rare + 1].tolist(), strict=True):
            score[self.docs[a:b]] += self.weights[a:b]
        score[~self.unused] = 0
        return score

    @staticmethod
    def _in_order(score: np.ndarray, found: np.ndarray) -> np.ndarray:
        return found[np.argsort(-score[found], kind="stable")]

    def ranked(self, seed: int) -> np.ndarray:
        """All unused documents that share a term with the seed, best first, ties in their order."""
        score = self._scores(seed)
        return self._in_order(score, np.flatnonzero(score > 0))

    def neighbours(self, seed: int, first: int = 32) -> Iterator[int]:
        """ranked(), but sorted only as far as it is asked for."""
        score = self._scores(seed)
        least = np.float32(0)
        if first < len(score):
            least = np.partition(score, len(score) - first)[len(score) - first]
        if least > 0:
            yield from self._in_order(score, np.flatnonzero(score >= least)).tolist()
            yield from self._in_order(score, np.flatnonzero((score > 0) & (score < least))).tolist()
        else:
            yield from self._in_order(score, np.flatnonzero(score > 0)).tolist()


class _Packer:
    """Fills windows from shard after shard; what is left open at the end is cut to powers of two."""

    def __init__(self, idf: np.ndarray, mean_length: float, window: int, first_sequence: int) -> None:
        self.idf, self.mean_length, self.window, self.sequence = idf, mean_length, window, first_sequence
        self.open: list[tuple] = []  # (doc_id, ids, start) pieces of the open window
        self.filled = 0
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, ids, start, length in pieces:
            self.rows.append((doc_id, start, length, zlib.crc32(ids[start : start + length].astype("<u4").tobytes()), len(ids), self.sequence, offset))
            offset += length
        self.sequence += 1

    def _place(self, doc_id, ids: np.ndarray) -> bool:
        """Put a document into the open window, closing windows as they fill; true if the last one is still empty or was closed by it."""
        start, closed = 0, False
        while start < len(ids):
            length = min(len(ids) - start, self.window - self.filled)
            self.open.append((doc_id, ids, start, length))
            self.filled += length
            start += length
            if self.filled == self.window:
                self._emit(self.open)
                self.open, self.filled, closed = [], 0, True
        return closed

    def shard(self, names: list, texts: list[np.ndarray]) -> None:
        index = Bm25Shard(texts, self.idf, self.mean_length)
        for seed in range(len(texts)):
            if not index.unused[seed]:
                continue
            index.unused[seed] = False
            self._place(names[seed], texts[seed])
            while self.filled:
                closed = False
                for d in index.neighbours(seed):
                    index.unused[d] = False
                    if self._place(names[d], texts[d]):
                        closed, seed = True, d  # its rest, if any, seeds the window that is open now
                        break
                if not closed:
                    break

    def finish(self) -> None:
        pieces, left = self.open, self.filled
        while left:
            size, taken = 1 << (left.bit_length() - 1), []
            left -= size
            while size:
                doc_id, ids, start, length = pieces[0]
                part = min(length, size)
                taken.append((doc_id, ids, start, part))
                size -= part
                pieces = pieces[1:] if part == length else [(doc_id, ids, start + part, length - part), *pieces[1:]]
            self._emit(taken)
        self.open, self.filled = [], 0

    def flush(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        names = [x.split()[0] for x in PIECES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(names))], names=names)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, window: int = 4096, shard_tokens: int = 4_000_000) -> DataFrame:
    """documents -> pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    Each id of each document, its end id included, lies in exactly one piece; pieces of a
    sequence are gapless from offset 0. Every sequence holds `window` ids (a power of two) but
    for the last few of a partition, which hold smaller powers of two, so none needs padding.
    Null and empty texts are their end id. Repeated rows and null ids are packed like any
    other; ties in score keep the order of (key, doc_id). An empty table gives no pieces.
    Other columns are not looked at.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    coded = tokenize(docs, tokenizer_path, end_id)
    counts, n, mean_length = document_counts(coded)
    idf = np.where(counts > 0, np.log1p((n - counts + 0.5) / (counts + 0.5)), 0.0).astype(np.float32)
    shared, kind = docs.sparkSession.sparkContext.broadcast((idf, max(mean_length, 1.0))), id_type(tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(*shared.value, window, TaskContext.get().partitionId() << 32)
        names, texts, size = [], [], 0
        for batch in batches:
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ids = np.frombuffer(data, kind)
                if texts and size + len(ids) > shard_tokens:
                    packer.shard(names, texts)
                    yield packer.flush()
                    names, texts, size = [], [], 0
                names.append(doc_id)
                texts.append(ids)
                size += len(ids)
        packer.shard(names, texts)
        packer.finish()
        yield packer.flush()

    texts = coded.where("used is null").select("doc_id", "key", "ids")
    dealt = texts.repartitionByRange(width(docs), "key", "doc_id").sortWithinPartitions("key", "doc_id", "ids")
    return dealt.mapInArrow(run, PIECES)


def sequences(pieces: DataFrame, docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """pieces and their documents (doc_id unique) -> (sequence_id, ids array<int>), for training."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for coded in encoder(tokenizer_path).encode(batch.column("body")):
                ids, starts = with_end(*coded, end_id)
                listed = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(listed)), listed], names=["doc_id", "ids"])
                at += len(listed)

    whole = docs.select("doc_id", text_bytes().alias("body")).mapInArrow(decode, "doc_id long, ids array<int>")
    cut = pieces.join(whole, "doc_id").select("sequence_id", F.struct("offset", F.expr("slice(ids, cast(start + 1 as int), cast(length as int))").alias("ids")).alias("piece"))
    return cut.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["ids"])).alias("ids"))
