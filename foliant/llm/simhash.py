"""SimHash near-duplicates found by a generalised pigeonhole search.

Fingerprints are cut into partitions of correlated bits. Each partition gets its own
threshold, -1 (never probed) or more, with sum(threshold + 1) = distance + 1: two
fingerprints within the distance then agree up to the threshold in one partition at
least, so probing loses no link. A dynamic program picks the thresholds that minimise
probes plus candidates, from counts over all fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined_rows, keyed, stage, text_bytes, text_hash
from .graph import connected_components

BITS = 64
#: Cost of one probe row against one compared pair.
PROBE_COST = 2.0


def shingle_hashes(data: bytes, words_per_shingle: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of each word shingle of the ASCII-lower-cased text, repeats included."""
    words = data.lower().split()
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    text = b" ".join(words)
    if n < words_per_shingle:
        return np.array([xxhash.xxh64_intdigest(text, 42)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - words_per_shingle + 1].tolist()
    shingles = [text[a:b] for a, b in zip(starts, ends[words_per_shingle - 1 :].tolist(), strict=True)]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, len(shingles))


def simhash64(data: bytes, words_per_shingle: int = 3) -> int:
    """A bit is 1 if it is set in over half of the shingle hashes; no words give zero."""
    hashes = shingle_hashes(data, words_per_shingle)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):
        block = hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """documents -> (doc_id, text_hash, fp), fp the fingerprint as a signed long; one row per row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = np.fromiter((simhash64(x, words_per_shingle) for x in batch["body"]), np.uint64, len(batch))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "text_hash": batch["text_hash"], "fp": fp.view(np.int64)})

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), text_bytes().alias("body"))
    return source.mapInPandas(run, "doc_id long, text_hash long, fp long")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


@dataclass(frozen=True)
class Partition:
    """Bits of one partition and the threshold that the plan gives it."""

    bits: tuple[int, ...]
    threshold: int = 0

    @property
    def mask(self) -> int:
        return _signed(sum(1 << b for b in self.bits))

    def flips(self) -> list[int]:
        """All xor masks of up to threshold bits inside the partition."""
        return [_signed(sum(1 << b for b in some)) for k in range(self.threshold + 1) for some in combinations(self.bits, k)]


def bit_statistics(classes: DataFrame) -> np.ndarray:
    """64 x 64 counts of bits set together, over every fingerprint: at most 2080 sums reach the driver."""
    upper = np.triu_indices(BITS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((BITS, BITS))
        for batch in batches:
            bits = np.unpackbits(batch["fp"].to_numpy(np.int64).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
        yield pd.DataFrame({"i": upper[0], "j": upper[1], "n": total[upper].astype(np.int64)})

    counts = np.zeros((BITS, BITS))
    for row in classes.select("fp").mapInPandas(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        counts[row["i"], row["j"]] = counts[row["j"], row["i"]] = row["n"]
    return counts


def group_bits(together: np.ndarray, n: int, parts: int) -> list[Partition]:
    """Cut the bits into parts of even size, correlated bits in one part."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    strength = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(strength, 0)
    left, out = set(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        seed = max(sorted(left), key=lambda b: strength[b, sorted(left)].sum())
        part = [seed]
        left.discard(seed)
        while len(part) < size:
            best = max(sorted(left), key=lambda b: strength[b, part].sum())
            part.append(best)
            left.discard(best)
        out.append(Partition(tuple(sorted(part))))
    return out


def _within(p: np.ndarray, most: int) -> list[float]:
    """Chance that two fingerprints differ in at most 0..most of these bits, taken as independent."""
    chance = np.zeros(most + 2)
    chance[0] = 1
    for q in 2 * p * (1 - p):
        chance[1:] = chance[1:] * (1 - q) + chance[:-1] * q
        chance[0] *= 1 - q
    return np.cumsum(chance[: most + 1]).tolist()


def allot(partitions: list[Partition], equal_pairs: list[float], together: np.ndarray, n: int, distance: int) -> tuple[float, list[Partition]]:
    """Thresholds of least estimated cost with sum(threshold + 1) = distance + 1, and that cost.

    equal_pairs: for each partition the exact number of pairs that agree in all its bits.
    For higher thresholds it is scaled by the ratio that independent bits would give.
    """
    p = np.diag(together) / max(n, 1)
    costs = []
    for part, pairs in zip(partitions, equal_pairs, strict=True):
        within = _within(p[list(part.bits)], distance)
        row, probes = [0.0], 0
        for t in range(distance + 1):
            probes = len(Partition(part.bits, t).flips())
            row.append(PROBE_COST * n * probes + max(pairs, 1.0) * within[t] / max(within[0], 1e-300))
        costs.append(row)
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for row in costs:
        following: dict[int, tuple[float, tuple[int, ...]]] = {}
        for spent, (cost, chosen) in best.items():
            for units in range(distance + 2 - spent):
                option = (cost + row[units], (*chosen, units - 1))
                if spent + units not in following or option < following[spent + units]:
                    following[spent + units] = option
        best = following
    cost, chosen = best[distance + 1]
    return cost, [Partition(part.bits, t) for part, t in zip(partitions, chosen, strict=True)]


def plan_search(classes: DataFrame, distance: int, choices: tuple[int, ...] = (2, 3, 4)) -> tuple[list[Partition], int]:
    """The cheapest partitioning and thresholds, and the size of its largest bucket."""
    together = bit_statistics(classes)
    n = classes.count()
    layouts = {m: group_bits(together, n, m) for m in choices}
    keys = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(part.mask)).alias("key")) for m, parts in layouts.items() for i, part in enumerate(parts)]))
    counts = classes.select(keys.alias("x")).select("x.*").groupBy("m", "i", "key").agg(F.count("*").alias("c"))
    found = {(r["m"], r["i"]): r for r in counts.groupBy("m", "i").agg(F.sum(F.col("c").cast("double") * (F.col("c") - 1) / 2).alias("pairs"), F.max("c").alias("most")).collect()}
    if not found:
        return [], 0
    plans = {m: allot(parts, [found[m, i]["pairs"] for i in range(m)], together, n, distance) for m, parts in layouts.items()}
    m = min(plans, key=lambda k: plans[k][0])
    return plans[m][1], max(found[m, i]["most"] for i in range(m) if plans[m][1][i].threshold >= 0)


def _refined(rows: DataFrame, hot: DataFrame, partitions: list[Partition], distance: int) -> DataFrame:
    """Rows of over-full buckets get a second key: one of distance + 1 cuts of the other bits agrees."""
    cuts = []
    for i, part in enumerate(partitions):
        rest = [b for b in range(BITS) if b not in part.bits]
        masks = [_signed(sum(1 << b for b in rest[k :: distance + 1])) for k in range(distance + 1)]
        cuts.append(F.when(F.col("i") == i, F.array(*[F.struct(F.lit(k + 1).alias("k"), F.col("fp").bitwiseAND(F.lit(mask)).alias("rest")) for k, mask in enumerate(masks)])))
    plain = F.array(F.struct(F.lit(0).alias("k"), F.lit(0).cast("long").alias("rest")))
    marked = rows.join(hot, ["i", "key"], "left")
    return marked.withColumn("x", F.explode(F.when(F.col("hot"), F.coalesce(*cuts)).otherwise(plain))).select("i", "key", "x.k", "x.rest", "fp")


def near_links(classes: DataFrame, distance: int = 3, hot_bucket: int = 2000) -> DataFrame:
    """(fp) distinct fingerprints -> (a, b) with a < b and at most distance differing bits; every such pair.

    Buckets with more than hot_bucket members are cut again by the pigeonhole rule on the
    bits outside their partition, which is exact as well.
    """
    partitions, most = plan_search(classes, distance)
    used = [(i, part) for i, part in enumerate(partitions) if part.threshold >= 0]
    if not used:
        return classes.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("a < b")
    cell = lambda i, key: F.struct(F.lit(i).alias("i"), key.alias("key"))
    stored = classes.select(F.explode(F.array(*[cell(i, F.col("fp").bitwiseAND(F.lit(part.mask))) for i, part in used])).alias("x"), "fp").select("x.i", "x.key", "fp")

    def around(i: int, part: Partition) -> Column:
        return F.transform(F.array(*[F.lit(flip) for flip in part.flips()]), lambda flip: cell(i, F.col("fp").bitwiseAND(F.lit(part.mask)).bitwiseXOR(flip)))

    probe_keys = F.concat(*[around(i, part) for i, part in used])
    probes = classes.select(F.explode(probe_keys).alias("x"), "fp").select("x.i", "x.key", "fp")
    on = ["i", "key"]
    if most > hot_bucket:
        hot = stored.groupBy("i", "key").agg((F.count("*") > hot_bucket).alias("hot")).where("hot")
        stored, probes = (_refined(x, hot, partitions, distance) for x in (stored, probes))
        on += ["k", "rest"]
    left, right = probes.withColumnRenamed("fp", "a").alias("l"), stored.withColumnRenamed("fp", "b").alias("r")
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in on]
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return left.join(right, [*same, close], "inner").select("a", "b").distinct()


def components(classes: DataFrame, distance: int, hot_bucket: int) -> DataFrame:
    """(fp, …) one row per distinct fingerprint -> the same with label, the least fingerprint that links reach."""
    labels = connected_components(near_links(classes.select("fp"), distance, hot_bucket)).withColumnsRenamed({"node": "fp"})
    return classes.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))


def near_duplicates(docs: DataFrame, distance: int = 3, words_per_shingle: int = 3, hot_bucket: int = 2000) -> DataFrame:
    """documents -> (doc_id, fingerprint, component_id), one row per input row.

    fingerprint: 16 lower-case hex digits. component_id: least doc_id of all rows that links
    of at most `distance` bits reach. Null and empty texts have fingerprint zero and link as
    such. Repeated rows stay; rows with a null doc_id keep it and take the least non-null id
    of their component (null if there is none). Other columns are not looked at. Copies are
    reduced to one row per fingerprint before the search, so groups are never expanded.
    """
    rows = stage(fingerprints(docs, words_per_shingle), "fingerprints")
    classes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    members = components(classes, distance, hot_bucket)
    heads = members.groupBy("label").agg(F.min("least").alias("component_id"))
    component = members.join(heads, "label").select("fp", "component_id")
    return rows.join(component, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame, distance: int = 3, one_text_per_id: bool = True, hot_bucket: int = 2000) -> DataFrame:
    """documents -> one document of each near-duplicate component; columns as they were.

    The document of the least doc_id stays (null ids last, then by a hash of text). With
    one_text_per_id, of several texts under one doc_id only the least stays, before anything
    else; without it, they are documents of their own, and only near copies go. Of
    rows equal in doc_id and text one stays, whichever it is. Null and empty texts are near
    copies of each other. An empty table stays empty. Columns of any name may be there.
    """
    if one_text_per_id:
        marked, number, digest = keyed(docs)
        named = marked.where(F.col(number).isNotNull()).groupBy(number).agg(F.min("text").alias("text"), F.count_distinct(digest).alias("texts")).where("texts > 1")
        least = stage(named.select(F.col(number).alias("least_id"), text_hash().alias("least_text")), "least")
        rows = marked.select(F.col(number).alias("doc_id"), F.col(digest).alias("text_hash"))
        later = rows.join(least, (F.col("doc_id") == F.col("least_id")) & (F.col("text_hash") != F.col("least_text")), "left_semi").distinct()
        docs = joined_rows(docs, stage(later, "later"), "left_anti")
    rows = stage(fingerprints(docs).groupBy("doc_id", "text_hash", "fp").agg(F.count("*").alias("times")), "fingerprints")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    classes = stage(rows.groupBy("fp").agg(F.min(order).alias("least")), "classes")
    members = components(classes, distance, hot_bucket)
    kept = members.groupBy("label").agg(F.min("least").alias("least")).select("least.doc_id", "least.text_hash")
    same = rows["doc_id"].eqNullSafe(kept["doc_id"]) & (rows["text_hash"] == kept["text_hash"])
    dropped = stage(rows.join(kept, same, "left_anti").select("doc_id", "text_hash"), "dropped")
    repeated = stage(rows.join(kept, same, "left_semi").where("times > 1").select("doc_id", "text_hash"), "repeated")
    left = joined_rows(docs, dropped, "left_anti")
    if repeated.isEmpty():
        return left
    twice, number, digest = keyed(joined_rows(left, repeated, "left_semi"))
    return joined_rows(left, repeated, "left_anti").unionByName(twice.dropDuplicates([number, digest]).drop(number, digest))
