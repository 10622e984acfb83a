"""Passages that repeat across documents, found from sparse suffixes.

Only suffixes at content-selected positions are kept: of every min_words - head + 1
neighbouring `head`-word grams the one with the least hash, the first of equal ones, so two documents
that share min_words words keep a suffix at the same place in both. A suffix whose head another
document holds goes on, with the words to its left and right that windows selecting it can
reach. Suffixes of a head are sorted by their words to the right, and again by those to the
left; each is compared with its neighbour word by word, and the lengths they have in common, to
the right and to the left, say which min_words-word windows around them agree. A head in very many
documents is not brought together: its windows are counted by hash instead, so a passage in a third of
all documents costs one row per task and window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, joined_rows, stage, text_bytes, text_hash, width
from .words import WHITE_TABLE, coded_words, grouped, hashed_words

_STEP = 0x9E3779B97F4A7C15
_WORD = 1 << 64


def _grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` hashes, built from runs of powers of two."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, power, length = np.zeros(n, np.uint64), 0, hashes, 1
    while done < size:
        if size & length:
            out = out * np.uint64(pow(_STEP, length, _WORD)) + power[done : done + n]
            done += length
        power = power[:-length] * np.uint64(pow(_STEP, length, _WORD)) + power[length:] if len(power) > length else power[:0]
        length *= 2
    out ^= out >> np.uint64(31)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def selected(hashes: np.ndarray, min_words: int, head: int) -> tuple[np.ndarray, np.ndarray]:
    """For each min_words-word window the hash and the place of its selected suffix's head."""
    values, size = _grams(hashes, head), min_words - head + 1
    places, done = np.arange(len(values)), 1
    while done < size and len(values):
        step = min(done, size - done)
        right = values[step:] < values[:-step]
        values = np.where(right, values[step:], values[:-step])
        places = np.where(right, places[step:], places[:-step])
        done += step
    return values, places


def _places_of(found: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(value, place) of each window -> distinct values, and at how many places each stands."""
    values, places = found
    order = np.lexsort((places, values))
    values, places = values[order], places[order]
    begins = np.append(True, values[1:] != values[:-1]) if len(values) else np.zeros(0, bool)
    moved = begins | np.append(True, places[1:] != places[:-1]) if len(values) else begins
    return values[begins], np.add.reduceat(moved, np.flatnonzero(begins), dtype=np.int64) if len(values) else np.zeros(0, np.int64)


def _source(docs: DataFrame) -> DataFrame:
    """doc_id, body, its hash, and row, which stands for the document: a hash of doc_id and text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body"), text_hash().alias("text_hash")).withColumn("row", F.xxhash64("doc_id", "body"))


#: Suffixes that are compared at a time; documents, and places in all of them, beyond which a head is not brought together.
COMPARED_ROWS, HOT_DOCUMENTS, HOT_PLACES = 20_000, 1_000, 20_000


def repeated_passages(docs: DataFrame, min_words: int = 51, head: int = 20, hot: int = HOT_DOCUMENTS, hot_places: int = HOT_PLACES) -> DataFrame:
    """documents -> (row, doc_id, text_hash, spans, removed), one row per document with a repeated passage.

    spans: maximal word intervals [start, stop) whose every min_words-word window also occurs
    in another document, in order. removed: the part of them that another document, the one
    with the least `row`, keeps. Words are runs of anything but ASCII white space, compared
    exactly; windows around heads that more than `hot` documents hold, or that stand at more than `hot_places`
    places, are compared by 64-bit hashes instead, so no task holds more suffixes of a head. A document's `row` is a 64-bit hash as well. Rows equal in doc_id and text are one document; repeats within a document do
    not count. Null and empty texts, and texts under min_words words, have no passages. Other
    columns are not looked at.
    """
    source = _source(docs)

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in grouped(batch.column("body")):
                hashes, starts = hashed_words(texts)
                found = [_places_of(selected(hashes[a:b], min_words, head)) for a, b in zip(starts[:-1], starts[1:], strict=True)]
                rows = np.repeat(batch.column("row").slice(at, len(texts)).to_numpy(), [len(x) for x, _ in found])
                heads, times = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(heads.view(np.int64)), pa.array(times, pa.int64())], names=["row", "head", "times"])
                at += len(texts)

    suffixes = stage(source.select("row", "body").mapInArrow(select, "row long, head long, times long"), "suffixes")
    heads = suffixes.groupBy("head").agg(F.min("row").alias("least"), F.max("row").alias("most"), F.count("*").alias("n"), F.sum("times").alias("times")).where("least <> most").select("head", ((F.col("n") > hot) | (F.col("times") > hot_places)).alias("hot"))
    of = lambda test: F.collect_list(F.when(test, F.col("head")))
    surviving = suffixes.join(heads, "head").groupBy("row").agg(of(~F.col("hot")).alias("heads"), of(F.col("hot")).alias("hot_heads"))
    candidates = source.select("row", "body").join(surviving, "row")
    parts = stage(candidates.mapInArrow(lambda batches: _extended(batches, min_words, head), "row long, head long, context binary, left int, places array<int>, window long"), "contexts")
    suffix_rows = parts.where("window is null").drop("window").repartition(width(docs), "head").sortWithinPartitions("head", "context")
    found = suffix_rows.mapInArrow(lambda batches: _compared(batches, min_words, head), "row long, first int, last int, cut boolean")

    windows = parts.where("window is not null").select("row", "window", "places")
    keepers = windows.groupBy("window").agg(F.min("row").alias("keeper"), F.max("row").alias("most")).where("keeper <> most").select("window", "keeper")
    shared = windows.join(keepers, "window").select("row", "keeper", F.explode("places").alias("first"))  # a document's places of a window stay one row until here
    counted = shared.select("row", "first", F.explode(F.when(F.col("row") != F.col("keeper"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("cut"))
    runs = found.unionByName(counted.select("row", "first", F.col("first").alias("last"), "cut"))
    starts = lambda cut: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("cut") == cut, F.sequence("first", "last"))))))
    gathered = runs.groupBy("row").agg(starts(False).alias("all"), starts(True).alias("cut"))
    named = source.select("row", "doc_id", "text_hash").distinct()
    return gathered.select("row", _merged("all", min_words).alias("spans"), _merged("cut", min_words).alias("removed")).join(named, "row").select("row", "doc_id", "text_hash", "spans", "removed")


def _extended(batches: Iterator[pa.RecordBatch], min_words: int, head: int) -> Iterator[pa.RecordBatch]:
    """Surviving suffixes of documents, each with its words in reach: context, of which `left` stand before the suffix, and its places.

    A context that a document repeats is one row. Windows of hot heads are rows of their own, by hash.
    """
    names = ["row", "head", "context", "left", "places", "window"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.int64()]
    for batch in batches:
        at = 0
        for texts in grouped(batch.column("body")):
            hashes, starts = hashed_words(texts)
            out: list[list] = [[] for _ in names]
            for i, text in enumerate(texts.to_pylist()):
                own = hashes[starts[i] : starts[i + 1]]
                values, places = selected(own, min_words, head)
                row = batch.column("row")[at + i].as_py()
                members = lambda name, k=at + i, v=values: np.isin(v, np.asarray(batch.column(name)[k].as_py(), np.int64).view(np.uint64))
                live = np.flatnonzero(members("heads"))
                met: dict[tuple, list[int]] = {}
                if len(live):
                    words = text.split()
                    # windows that select one suffix are neighbours
                    cut = np.flatnonzero(np.diff(places[live])) + 1
                    for first, last in zip(live[np.concatenate([[0], cut])].tolist(), live[np.concatenate([cut - 1, [-1]])].tolist(), strict=True):
                        place = int(places[first])
                        key = (int(values[first : first + 1].view(np.int64)[0]), b" ".join(words[first : last + min_words]), place - first)
                        met.setdefault(key, []).append(place)
                for (name, context, left), where in met.items():
                    for column, x in zip(out, (row, name, context, left, where, None), strict=True):
                        column.append(x)
                hot = np.flatnonzero(members("hot_heads"))
                if len(hot):
                    window = _grams(own, min_words)[hot].view(np.int64)
                    order = np.argsort(window, kind="stable")
                    distinct, firsts = np.unique(window[order], return_index=True)
                    for w, where in zip(distinct.tolist(), np.split(hot[order], firsts[1:]), strict=True):
                        for column, x in zip(out, (row, None, None, None, where.tolist(), w), strict=True):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=names)
            at += len(texts)


def _compared(batches: Iterator[pa.RecordBatch], min_words: int, head: int) -> Iterator[pa.RecordBatch]:
    """Sorted suffixes -> runs of window starts that another document shares (cut false), and that it keeps (cut true), whole heads at a time."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= COMPARED_ROWS:
            rows = pa.Table.from_batches(held)
            heads = rows.column("head").to_numpy()
            whole = int(np.searchsorted(heads, heads[-1]))
            if whole:
                yield _common_windows(rows.slice(0, whole), min_words, head)
            held = rows.slice(whole).to_batches()
            size = len(rows) - whole
    if size:
        yield _common_windows(pa.Table.from_batches(held), min_words, head)


def _classes(words: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """words: one row per suffix. -> for each length, and each row, a number that rows agreeing in that many words share."""
    order = np.lexsort((*words.T[::-1], heads))
    ordered = words[order]
    same = (ordered[1:] == ordered[:-1]) & (heads[order][1:] == heads[order][:-1])[:, None]
    common = np.cumprod(same, axis=1, dtype=np.int8).sum(axis=1)  # words that neighbours have in common
    apart = common[None, :] < np.arange(words.shape[1] + 1)[:, None]
    out = np.zeros((words.shape[1] + 1, len(words)), np.int64)
    out[:, order[1:]] = np.cumsum(apart, axis=1)
    return out


def _common_windows(rows: pa.Table, min_words: int, head: int) -> pa.RecordBatch:
    n = len(rows)
    doc, heads, left = (rows.column(c).to_numpy() for c in ("row", "head", "left"))
    _, numbers, starts = coded_words(rows.column("context").combine_chunks(), WHITE_TABLE)
    reach = min_words - head  # words to the left that a window can have before its suffix
    right = np.diff(starts) - left

    def placed(columns: np.ndarray, known: np.ndarray) -> np.ndarray:
        at = np.clip((starts[:-1] + left)[:, None] + columns, 0, max(len(numbers) - 1, 0))
        return np.where(known, numbers[at], -1)

    ahead = np.arange(min_words)
    back = np.arange(1, reach + 1)
    by_right = _classes(placed(ahead, ahead < right[:, None]), heads)
    by_left = _classes(placed(-back, back <= left[:, None]), heads)
    shared, cut = np.zeros((n, reach + 1), bool), np.zeros((n, reach + 1), bool)
    for before in range(reach + 1):
        some = np.flatnonzero((left >= before) & (right >= min_words - before))
        if len(some) < 2:
            continue
        key = by_left[before][some] * n + by_right[min_words - before][some]
        order = np.argsort(key, kind="stable")
        begins = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) > 0]))
        members = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(some))))
        least, most = np.minimum.reduceat(doc[some][order], begins), np.maximum.reduceat(doc[some][order], begins)
        there = some[order]
        shared[there, before] = (least != most)[members]
        cut[there, before] = doc[there] != least[members]
    places = rows.column("places").combine_chunks()
    offsets, values = places.offsets.to_numpy() - places.offsets[0].as_py(), places.flatten().to_numpy()
    out: list[list[np.ndarray]] = [[], [], [], []]
    for mask, name in ((shared, False), (cut, True)):
        edges = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        (row, low), (_, high) = np.nonzero(edges == 1), np.nonzero(edges == -1)
        times = np.diff(offsets)[row]
        each = np.repeat(np.arange(len(row)), times)
        at = values[offsets[row][each] + np.arange(len(each)) - (np.cumsum(times) - times)[each]]
        for column, x in zip(out, (doc[row][each], at - high[each] + 1, at - low[each], np.full(len(each), name)), strict=True):
            column.append(x)
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)).cast(k) for x, k in zip(out, kinds, strict=True)], names=["row", "first", "last", "cut"])


def _merged(column: str, size: int):
    """Sorted starts of windows of `size` words -> disjoint intervals: starts after a gap, ends before one."""
    opens = F.filter(F.col(column), lambda s, i: (i == 0) | (s - F.get(column, i - 1) > size))
    closes = F.filter(F.col(column), lambda s, i: (i == F.size(column) - 1) | (F.get(column, i + 1) - s > size))
    return F.zip_with(opens, closes, lambda a, b: F.struct(a.cast("long").alias("start"), (b + size).cast("long").alias("stop")))


def passages(docs: DataFrame, min_words: int = 51, head: int = 20) -> DataFrame:
    """One row per repeated passage and document: (doc_id, start_word, end_word, n_words, n_removed).

    Documents without one do not appear. n_removed: its words that another document keeps.
    """
    found = repeated_passages(docs, min_words, head).select("doc_id", "removed", F.explode("spans").alias("span"))
    inside = F.transform("removed", lambda r: F.greatest(F.lit(0).cast("long"), F.least(r["stop"], F.col("span.stop")) - F.greatest(r["start"], F.col("span.start"))))
    return found.select(
        "doc_id",
        F.col("span.start").alias("start_word"),
        F.col("span.stop").alias("end_word"),
        (F.col("span.stop") - F.col("span.start")).alias("n_words"),
        F.aggregate(inside, F.lit(0).cast("long"), lambda a, b: a + b).alias("n_removed"),
    )


def without_repeats(docs: DataFrame, min_words: int = 51, head: int = 20) -> DataFrame:
    """documents -> the same columns and rows, later copies of repeated passages cut out of text.

    A removed word goes with the white space before it; text that remains is unchanged.
    n_chars, where there is one, follows the text. Null and empty texts stay as they are; rows equal
    in doc_id and text are cut alike; an empty table stays empty. Columns of any name may be there.
    Only documents with something to remove are joined with what is removed.
    """
    name = free_name(docs, "removed")
    cut = stage(repeated_passages(docs, min_words, head).where(F.size("removed") > 0).select("doc_id", "text_hash", F.col("removed").alias(name)), "cut")

    @F.pandas_udf("string")
    def drop(text: pd.Series, removed: pd.Series) -> pd.Series:
        return pd.Series([drop_words(t, [(x["start"], x["stop"]) for x in r]) for t, r in zip(text, removed, strict=True)])

    touched = joined_rows(docs, cut, "inner").withColumn("text", drop("text", name))
    if "n_chars" in docs.columns:
        touched = touched.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return joined_rows(docs, cut, "left_anti").unionByName(touched.select(*docs.columns))


def drop_words(text: str, spans: list[tuple[int, int]]) -> str:
    import re

    ends = [0] + [m.end() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    out, at = [], 0
    for start, stop in spans:
        out.append(text[at : ends[start]])
        at = ends[stop]
    return "".join([*out, text[at:]])
