"""MinHash near-duplicates by fast similarity sketching.

A sketch of t coordinates is filled in rounds: each element of a set is thrown into one of the t bins by a hash of
its own in each round, and a bin keeps the least value of the first round that reaches it. From round t on, round
t + j throws every element into bin j, so each coordinate is filled after 2t rounds at most (one or a few do for a set of
t log t elements or more), and sketches of sets agree in a share of coordinates that concentrates about their similarity. Coordinates
are cut into bands; sets that agree in a band are candidates, and every link is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import joined_rows, stage, text_bytes, text_hash
from .graph import connected_components
from .words import WHITE, coded_words, grouped

#: Bands and coordinates of a band: a pair of similarity 0.8 is in no common bucket with a chance of (1 - 0.8 ** 5) ** 48, 5e-9.
BANDS, BAND = 48, 5
#: Rounds of leaders end where one leaves over this share of the rows before it.
PROGRESS = 0.7
#: Sets of a block, by the bytes of their elements and by number.
BLOCK_BYTES, BLOCK_ROWS = 8_000_000, 2000
_TABLE = bytes(32 if c in WHITE else c + 32 if 65 <= c <= 90 else c for c in range(256))
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed shuffle of 64-bit numbers, every bit by every bit (constants of the usual 64-bit finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's pairs of neighbouring words, all texts in a row, and where each begins, with the end.

    One word alone is a set of one, no word is the empty set.
    """
    names, numbers, starts = coded_words(texts, _TABLE)
    if not names:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    words = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))[numbers]
    following = np.append(words[1:], np.uint64(0))
    lengths = np.diff(starts)
    hashes = mixed(mixed(words) + np.uint64(0x9E3779B97F4A7C15) * following)
    lone = starts[:-1][lengths == 1]
    hashes[lone] = mixed(words[lone] ^ np.uint64(0xD1B54A32D192ED03))
    inner = np.ones(len(words), bool)
    inner[starts[1:][lengths > 1] - 1] = False  # the last word of a text begins no pair
    owner, hashes = np.repeat(np.arange(len(texts)), lengths)[inner], hashes[inner]
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    first = np.ones(len(owner), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[first], np.append(0, np.cumsum(np.bincount(owner[first], minlength=len(texts))))


def sketches(elements: np.ndarray, starts: np.ndarray, t: int) -> np.ndarray:
    """Sets x t coordinates, (round, value) packed into one number each; an empty set keeps all coordinates empty."""
    sizes = np.diff(starts)
    out = np.full((len(sizes), t), _EMPTY, np.uint64)
    open_ = sizes > 0
    owner = np.repeat(np.arange(len(sizes)), sizes)
    for i in range(2 * t):
        if not len(owner):
            break
        thrown = mixed(elements + np.uint64((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        # the upper half names the bin, the lower the value
        bins = ((thrown >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else i - t
        np.minimum.at(out.reshape(-1), owner * t + bins, (np.uint64(i) << np.uint64(32)) | (thrown & np.uint64(0xFFFFFFFF)))
        open_[open_] = (out[open_] == _EMPTY).any(axis=1)
        elements, owner = elements[open_[owner]], owner[open_[owner]]
    return out


def band_keys(sketched: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """Sets x bands: a hash of the band's number and coordinates."""
    parts = sketched.reshape(len(sketched), bands, -1)
    keys = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64)), parts.shape[:2]).copy()
    for j in range(parts.shape[2]):
        keys = mixed(keys ^ parts[:, :, j]) + np.uint64(j)
    return keys


def sketched_rows(docs: DataFrame, bands: int = BANDS, band: int = BAND) -> DataFrame:
    """documents -> (doc_id, text_hash, set_id, n_shingles, keys), a row for each row; set_id is a 128-bit hash of the set, null for the empty one, whose keys are null as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in grouped(batch.column("body")):
                elements, starts = shingle_sets(texts)
                sizes = np.diff(starts)
                keys = band_keys(sketches(elements, starts, bands * band), bands).view(np.int64)
                some = pa.array(sizes == 0)
                names = [xxhash.xxh3_128_digest(elements[a:b].tobytes()) if b > a else None for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * bands, pa.int32()), pa.array(keys.reshape(-1)), mask=some)
                own = batch.slice(at, len(texts))
                yield pa.record_batch([own.column("doc_id"), own.column("text_hash"), pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), lists], names=("doc_id", "text_hash", "set_id", "n_shingles", "keys"))
                at += len(texts)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), text_bytes().alias("body"))
    return source.mapInArrow(run, "doc_id long, text_hash long, set_id binary, n_shingles long, keys array<long>")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (set_id, doc_id, text_hash), a document for each set -> the staged (set_id, elements), read from whole texts again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in grouped(batch.column("body")):
                elements, starts = shingle_sets(texts)
                pieces = [elements[a:b].tobytes() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                yield pa.record_batch([pa.array(map(xxhash.xxh3_128_digest, pieces), pa.binary()), pa.array(pieces, pa.binary())], names=("set_id", "elements"))

    rows = joined_rows(docs.select("doc_id", "text"), wanted.select("doc_id", "text_hash"), "left_semi")
    found = stage(rows.select(text_bytes().alias("body")).mapInArrow(run, "set_id binary, elements binary"), "sets")
    return found if found.count() == wanted.count() else stage(found.dropDuplicates(["set_id"]), "single_sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose full sets share at least so many percent of their union. Many pairs may have one b: a's sets join first, so AQE sees and cuts such partitions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["of_a"], batch["of_b"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                place = np.minimum(np.searchsorted(y, x), len(y) - 1)
                shared = int((y[place] == x).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.loc[keep, ["a", "b"]]

    side = lambda c: sets.select(F.col("set_id").alias(c), F.col("elements").alias(f"of_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "of_a", "of_b").mapInPandas(run, "a binary, b binary")


def _compared(cell: pd.DataFrame, percent: int) -> pd.DataFrame:
    """(a, b) links between rows (set_id, label, block, elements) of two blocks, or within the one; of those that join the same labels, one.

    Rows of the commonest label wait for the others: each of these meets all rows that share an element by one lookup of its elements.
    """
    sets = [np.frombuffer(x, np.uint64) for x in cell["elements"]]
    sizes, names, block = np.array([len(x) for x in sets]), cell["set_id"].tolist(), cell["block"].to_numpy()
    code, labels = pd.factorize(cell["label"])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner, up, out, two = flat[order], owner[order], list(range(len(labels))), [], len(set(block.tolist())) > 1

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for x in np.flatnonzero(code != np.bincount(code).argmax()).tolist():
        low, high = np.searchsorted(flat, sets[x], "left"), np.searchsorted(flat, sets[x], "right")
        lengths = high - low
        places = np.repeat(low - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        shared = np.bincount(owner[places], minlength=len(sets))
        near = (100 * shared >= percent * (sizes[x] + sizes - shared)) & (code != code[x])
        for y in np.flatnonzero(near & (block != block[x]) if two else near).tolist():
            if root(int(code[x])) != root(int(code[y])):
                up[root(int(code[x]))] = root(int(code[y]))
                out.append((names[x], names[y]))
    return pd.DataFrame(out, columns=["a", "b"])


def _across(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components that still share buckets: left (key, set_id, n_shingles, label).

    What buckets hold together, directly or by others, is dealt into blocks of bounded size, and every two blocks meet in one cell, where
    only rows of different components are compared. Not pairs but rows are moved, each once for each block of its group.
    """
    firsts = left.select("set_id", F.min("set_id").over(Window.partitionBy("key")).alias("b"))
    groups = connected_components(firsts.select(F.col("set_id").alias("a"), "b")).withColumnsRenamed({"node": "set_id", "label": "group"})
    members = stage(left.select("set_id", "label", "n_shingles").distinct().join(groups, "set_id"), "members")
    blocks = F.greatest(F.ceil(F.sum("n_shingles") * 8 / F.lit(BLOCK_BYTES)), F.ceil(F.count("*") / F.lit(BLOCK_ROWS)))
    dealt = members.join(members.groupBy("group").agg(blocks.alias("blocks")), "group").withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cell = [F.col("group"), F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")]
    rows = cells.join(sets, "set_id").select(*cell, "set_id", "label", "block", "elements")
    return rows.groupBy("group", "low", "high").applyInPandas(lambda some: _compared(some, percent), "a binary, b binary")


def links(classes: DataFrame, docs: DataFrame, percent: int = 80) -> DataFrame:
    """classes (set_id, n_shingles, keys, doc_id, text_hash), one row per set -> (node, label): the sets that links reach, with the least set_id of their component.

    No group is expanded into pairs. First each set is compared with the least of the leaders of its buckets, then buckets that
    still hold several components with leaders of their own, as long as such rounds bring components together; sets that still share a
    bucket and not a component are then compared in blocks. Sets within a component need no comparison, so no link between components is lost.
    """
    spread = classes.where("keys is not null").select("set_id", "n_shingles", F.explode("keys").alias("key"))
    bucket = Window.partitionBy("key")
    first = F.min(F.struct("set_id", "n_shingles")).over(bucket)
    buckets = stage(spread.withColumn("held", F.count("*").over(bucket)).withColumn("first", first).where("held > 1").drop("held"), "buckets")
    named = classes.select("set_id", "doc_id", "text_hash").join(buckets.select("set_id").distinct(), "set_id", "left_semi")
    sets = _sets(docs, stage(named, "candidates"))
    alike = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    led = buckets.where((F.col("set_id") != F.col("first.set_id")) & alike(F.col("n_shingles"), F.col("first.n_shingles")))
    pairs = led.groupBy(F.col("set_id").alias("a")).agg(F.min("first.set_id").alias("b"))
    found, before, turn = stage(confirmed(pairs, sets, percent), "links"), None, 0
    while True:
        labels = stage(connected_components(found), "labels")
        marked = buckets.join(labels.withColumnsRenamed({"node": "set_id"}), "set_id", "left").select("key", "set_id", "n_shingles", F.coalesce("label", "set_id").alias("label"))
        open_ = marked.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
        left = stage(marked.join(open_, "key", "left_semi"), "left")
        rows = left.count()
        if not rows:
            return labels
        if before is not None and rows > PROGRESS * before:
            return connected_components(found.unionByName(_across(left, sets, percent)))
        order = F.struct(F.xxhash64("set_id", F.lit(turn)), "set_id", "n_shingles", "label")
        lead = left.groupBy("key").agg(F.min(order).alias("lead"))
        pairs = left.join(lead, "key").where((F.col("label") != F.col("lead.label")) & alike(F.col("n_shingles"), F.col("lead.n_shingles")))
        found = stage(found.unionByName(confirmed(pairs.select(F.col("set_id").alias("a"), F.col("lead.set_id").alias("b")).distinct(), sets, percent)), "links")
        before, turn = rows, turn + 1


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """documents -> (doc_id, n_shingles, component_id, kept), one row per input row.

    component_id is the least doc_id of all rows that links reach. Rows with equal sets are one class and never compared.
    Null texts and texts without words have no shingles and link with nothing, not even each other. Rows with a null doc_id keep
    it, link as others do, and take the least id of their component; kept is doc_id = component_id, where a component
    without any id keeps all its rows. Repeated rows stay. Other columns are not looked at. An empty table gives no rows.
    Shingles are compared by 64-bit hashes, sets of equal 128-bit hash taken as equal.
    """
    rows = stage(sketched_rows(docs), "sketched")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    held = rows.where("set_id is not null").groupBy("set_id").agg(F.min(order).alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"))
    classes = stage(held.select("set_id", "n_shingles", "keys", "least.doc_id", "least.text_hash"), "classes")
    labels = links(classes, docs, percent).withColumnsRenamed({"node": "set_id"})
    joined = classes.select("set_id", "doc_id").join(labels, "set_id").select("set_id", "label", "doc_id")
    heads = joined.groupBy("label").agg(F.min("doc_id").alias("head"))
    linked = joined.join(heads, "label").select("set_id", "head")
    found = stage(classes.join(linked, "set_id", "left").select("set_id", F.coalesce("head", "doc_id").alias("component_id")), "components")
    component = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    return rows.join(found, "set_id", "left").select("doc_id", "n_shingles", component).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
