"""Exact nearest vectors for a query set, in cells of bounded size, without a join of all pairs.

Base rows are dealt into parts and queries into blocks; each part meets each block in one cell,
where they are compared by matrix products, a few rows at a time, and each query's best k of
the part are kept. A window over those few rows finishes the job. One plan, one scan of either
side, however large the query set is.

With a least similarity, parts are made of rows about pivots, and a query meets only parts that can hold a row
similar enough: q.b = q.c + q.(b - c) is at most q.c + |q| r for the rows b of a part with centre c and
radius r. Without one, every query is compared with every row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Base rows of a cell at most, on average, and those compared at a time where all pairs over a threshold are wanted.
PART_ROWS, STEP_ROWS = 100_000, 512
#: Queries of a cell, on average; products that are made at a time where the best k are wanted (as many as a core's cache holds), and pairs that are then measured exactly at a time.
BLOCK, STEP_SCORES, STEP_PAIRS = 65_536, 1 << 20, 100_000
#: Pairs of a cell: no cells are made for fewer, and more cells than asked for if they would hold more. What a query costs in a part, in rows moved: itself and its best rows of that part.
FEWEST_PAIRS, MOST_PAIRS, QUERY_COST = 20_000_000, 4_000_000_000, 10
#: Pivots at least and at most; as many vectors reach the driver.
FEWEST_PIVOTS, MOST_PIVOTS = 64, 1024


def _matrix(rows: pa.Table) -> np.ndarray:
    return rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def _compare(ids: np.ndarray, vectors: np.ndarray, names: np.ndarray, wanted: np.ndarray, k: int | None, least: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, similarity) of a cell: every pair, or with k each query's k best (and maybe one more), ties by id."""
    if k is not None and np.isfinite(vectors).all() and np.isfinite(wanted).all():
        return _best(ids, vectors, names, wanted, k, least)
    vectors, wanted = vectors.astype(np.float64), wanted.astype(np.float64)
    found = []
    for at in range(0, len(ids), STEP_ROWS):
        own = ids[at : at + STEP_ROWS]
        scores = np.round(wanted @ vectors[at : at + STEP_ROWS].T, 9)
        scores[names[:, None] == own] = -np.inf
        if least is not None:
            scores[scores < least] = -np.inf
        q, b = np.nonzero(scores > -np.inf)
        found.append((q, own[b], scores[q, b]))
    q, b, s = (np.concatenate(x) for x in zip(*found, strict=True))
    return names[q], b, s


def _alike(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's group of rows that are the same bit by bit, and the row's place in its group."""
    bits = np.ascontiguousarray(vectors).view(f"u{vectors.itemsize}")
    odd = np.random.default_rng(1).integers(1 << 62, size=bits.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    some = (bits[at : at + 8192].astype(np.uint64) for at in range(0, len(bits), 8192))
    key = np.concatenate([((x ^ (x >> np.uint64(29))) * odd).sum(axis=1) for x in some])
    order = np.argsort(key, kind="stable")
    first = np.ones(len(order), bool)
    first[1:] = (key[order][1:] != key[order][:-1]) | (bits[order][1:] != bits[order][:-1]).any(axis=1)
    group, place = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    group[order] = np.cumsum(first) - 1
    starts = np.flatnonzero(first)
    place[order] = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return group, place


def _at_least(scores: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the scores that reach their row's limit. They are few, so eight are looked at together."""
    over = np.zeros(-(-scores.size // 8) * 8, bool)
    np.greater_equal(scores, limit[:, None], out=over[: scores.size].reshape(scores.shape))
    near = (np.flatnonzero(over.view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return np.divmod(near[over[near]], scores.shape[1])


def _best(ids: np.ndarray, vectors: np.ndarray, names: np.ndarray, wanted: np.ndarray, k: int, least: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k + 1 best without itself, ties by id. Memory is that of both sides and of one step, however many rows tie.

    Products in single precision leave out what cannot be among the best, with a margin for their error; what is left is measured
    in double precision. Queries alike are asked once, and of rows alike the first k + 1 count, for no other can be chosen.
    """
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    place = _alike(vectors)[1]
    ids, vectors = ids[place <= k], vectors[place <= k]
    asked, turn = _alike(wanted)
    lead = np.empty(asked.max() + 1, np.int64)
    lead[asked[turn == 0]] = np.flatnonzero(turn == 0)
    unlike, most = wanted[lead], k + 1
    large = max(np.abs(vectors).max(), np.abs(unlike).max()) > 1e15
    near, far = (x.astype(np.float64 if large else np.float32, copy=False) for x in (unlike, vectors))
    length = lambda x: np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))
    slack = (vectors.shape[1] + 2) * 2.0**-22 * length(unlike) * length(vectors).max() + 2e-9
    floor, full = np.full(len(unlike), -np.inf if least is None else least), np.zeros(len(unlike), bool)
    empty = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    held, waiting = empty, []
    side = max(1, min(len(unlike), math.isqrt(STEP_SCORES)))
    step = max(most, STEP_SCORES // side)
    room = np.empty(side * step, near.dtype)  # one for all products, for new memory costs as much as they do
    for at in range(0, len(ids), step):
        for of in range(0, len(unlike), side):
            own_floor, own_slack = floor[of : of + side], slack[of : of + side]
            ours, theirs = near[of : of + side], far[at : at + step]
            scores = np.matmul(ours, theirs.T, out=room[: len(ours) * len(theirs)].reshape(len(ours), -1))
            limit = own_floor - own_slack
            if not full[of : of + side].all() and scores.shape[1] > most:
                limit = np.maximum(limit, np.partition(scores, -most, axis=1)[:, -most] - 2 * own_slack)
            q, b = _at_least(scores, limit.astype(scores.dtype))
            for i in range(0, len(q), STEP_PAIRS):
                some, own = q[i : i + STEP_PAIRS] + of, b[i : i + STEP_PAIRS] + at
                s = np.round(np.einsum("ij,ij->i", unlike[some].astype(np.float64), vectors[own].astype(np.float64)), 9)
                kept = np.where(full[some], s > floor[some], s >= floor[some])  # later ids lose ties
                waiting.append((some[kept], own[kept], s[kept]))
        if not full.all() or sum(len(x[0]) for x in waiting) >= len(unlike) * most // 2:
            held, waiting = tuple(np.concatenate(x) for x in zip(held, *waiting, strict=True)), []
            by = np.lexsort((held[1], -held[2], held[0]))
            q_by = held[0][by]
            starts = np.searchsorted(q_by, np.arange(len(unlike)))
            nth = np.arange(len(by)) - starts[q_by]
            held = tuple(x[by][nth < most] for x in held)
            last = nth == most - 1
            floor[q_by[last]], full[q_by[last]] = held[2][np.flatnonzero(nth[nth < most] == most - 1)], True
    if waiting:
        held = tuple(np.concatenate(x) for x in zip(held, *waiting, strict=True))
        by = np.lexsort((held[1], -held[2], held[0]))
        held = tuple(x[by] for x in held)
    starts = np.searchsorted(held[0], np.arange(len(unlike) + 1))
    sizes = np.minimum(np.diff(starts), most)
    own = np.repeat(np.arange(len(names)), sizes[asked])
    at = starts[asked][own] + np.arange(len(own)) - np.repeat(np.cumsum(sizes[asked]) - sizes[asked], sizes[asked])
    q, b, s = names[own], ids[held[1][at]], held[2][at]
    other = q != b
    return q[other], b[other], s[other]


@dataclass(frozen=True)
class Parts:
    """centres: pivots x dimensions; radius: of the rows nearest to each; first, splits: the numbers of each pivot's parts."""

    centres: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    splits: np.ndarray

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's pivot and its distance from it."""
        square = (vectors**2).sum(axis=1)[:, None] + (self.centres**2).sum(axis=1) - 2 * vectors @ self.centres.T
        pivot = square.argmin(axis=1)
        # measured afresh, for a difference of squares loses digits
        return pivot, np.linalg.norm(vectors - self.centres[pivot], axis=1)

    def within_reach(self, vectors: np.ndarray, least: float) -> list[np.ndarray]:
        """The parts that may hold a row of at least that similarity, for each vector."""
        most = vectors @ self.centres.T + np.linalg.norm(vectors, axis=1)[:, None] * self.radius
        near = (most >= least - 1e-6) & (self.splits > 0)
        return [np.concatenate([np.arange(f, f + n) for f, n in zip(self.first[row], self.splits[row], strict=True)] or [np.empty(0, np.int64)]).astype(np.int64) for row in near]


def _stacked(series: pd.Series) -> np.ndarray:
    return np.stack(series.tolist()).astype(np.float64) if len(series) else np.empty((0, 1))


def about_pivots(rows: DataFrame, parts: int) -> tuple[DataFrame, Parts] | None:
    """rows (id, vector) with p, the part of each, about as many parts as asked for but no fewer than FEWEST_PIVOTS; none without rows.

    The pivots are rows picked by a hash of their id. Only they, and a count and a radius for each, reach the driver.
    """
    wanted = min(MOST_PIVOTS, max(parts, FEWEST_PIVOTS))
    picked = rows.select("vector").orderBy(F.xxhash64("id"), "id").limit(wanted).collect()
    if not picked:
        return None
    centres = np.unique(np.array([r["vector"] for r in picked], np.float64), axis=0)
    none = np.zeros(len(centres), np.int64)
    held = Parts(centres, none.astype(float), none, none)

    def place(vectors: pd.Series) -> pd.DataFrame:
        pivot, distance = held.nearest(_stacked(vectors))
        return pd.DataFrame({"pivot": pivot.astype(np.int32), "distance": distance})

    placed = rows.withColumn("x", F.pandas_udf(place, "pivot int, distance double")(F.col("vector"))).select(*rows.columns, "x.pivot", "x.distance")
    sizes = {r["pivot"]: (r["n"], r["radius"]) for r in placed.groupBy("pivot").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).collect()}
    counts, radius = (np.array([sizes.get(k, (0, 0.0))[i] for k in range(len(centres))]) for i in (0, 1))
    splits = -(-counts // PART_ROWS)
    first = np.cumsum(splits) - splits
    # a pivot's rows are dealt over its parts by a hash
    numbers = F.get(F.array(*[F.struct(F.lit(int(a)).alias("first"), F.lit(max(1, int(n))).alias("splits")) for a, n in zip(first, splits, strict=True)]), F.col("pivot"))
    part = (numbers["first"] + F.pmod(F.xxhash64("id"), numbers["splits"])).cast("int")
    return placed.withColumn("p", part).select(*rows.columns, "p"), Parts(centres, radius.astype(float), first.astype(np.int64), splits.astype(np.int64))


def _reaching(asked: DataFrame, parts: Parts, least: float) -> DataFrame:
    """asked once for each part in reach."""

    def reach(vectors: pd.Series) -> pd.Series:
        return pd.Series(parts.within_reach(_stacked(vectors), least), dtype=object)

    return asked.withColumn("p", F.explode(F.pandas_udf(reach, "array<int>")(F.col("vector"))))


def cells_met(base: DataFrame, queries: DataFrame, least: float) -> DataFrame:
    """One row: queries, parts, and of the meetings of a query and a part those that similar() would not leave out (met, of all)."""
    rows = base.where("vector is not null").select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    asked = queries.where("vector is not null").select(F.col("vector").cast("array<double>").alias("vector"))
    dealt = about_pivots(rows, int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    n_parts = int(dealt[1].splits.sum()) if dealt else 0
    met = _reaching(asked, dealt[1], least).agg(F.count("*").alias("met")) if dealt else asked.limit(0).agg(F.count("*").alias("met"))
    return asked.agg(F.count("*").alias("queries")).crossJoin(met).select("queries", F.lit(n_parts).alias("parts"), "met", (F.col("queries") * n_parts).alias("of"))  # one row each


def _layout(rows: int, queries: int, cells: int, block: int) -> tuple[int, int]:
    """How many parts and blocks, for about so many cells or as many as their bounds ask for: the numbers that move fewest rows.

    A row goes to each block and a query to each part, so for n rows and n queries what is moved grows with the power 1.5 of n until
    parts are as large as they may be.
    """
    pairs = max(rows, 1) * max(queries, 1)
    wanted = max(min(cells, math.ceil(pairs / FEWEST_PAIRS)), math.ceil(pairs / MOST_PAIRS))
    even = round(math.sqrt(wanted * max(rows, 1) / (QUERY_COST * max(queries, 1))))
    parts = max(1, min(even, wanted), math.ceil(rows / PART_ROWS))
    return parts, max(1, math.ceil(queries / block), math.ceil(wanted / parts))


def _largest(rows: DataFrame, group: str | None) -> int:
    """The number of rows, or those of the largest group."""
    return (rows.groupBy(group).count().agg(F.max("count")).first()[0] or 0) if group else rows.count()


def similar(base: DataFrame, queries: DataFrame, k: int | None = None, least: float | None = None, block: int = BLOCK, group: str | None = None, per_group: bool = False) -> DataFrame:
    """base (id, vector), queries (query_id, vector) -> (query_id, id, similarity), dot products rounded to 9 places.

    With k, each query's best k (ties by id); with least, only those at or above it: without
    k, that is every such pair. A row is never its own neighbour: pairs with query_id = id are
    left out. Null vectors are skipped. With a group column on both sides, only rows of one group meet;
    per_group: a query that is in several groups has its best k in each (ids must then tell the groups apart).
    """
    within = [group] if group else []
    own = [F.col(c).alias(c) for c in within]  # columns of its own, as both sides may come from one table
    number = lambda c: F.col(c).cast("long").alias(c)
    single = all(side.schema["vector"].dataType.simpleString() == "array<float>" for side in (base, queries))
    vector = F.col("vector").cast("array<float>" if single else "array<double>").alias("vector")
    rows = base.where("vector is not null").select(*own, number("id"), vector)
    asked = queries.where("vector is not null").select(*own, number("query_id"), vector)
    spark = base.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts, blocks = _layout(n_rows := _largest(rows, group), n_asked := _largest(asked, group), tasks, block)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = None
    if least is not None and group is None:
        parts, blocks = max(tasks, math.ceil(n_rows / PART_ROWS)), max(1, math.ceil(n_asked / block))
        dealt = about_pivots(rows, parts)
    placed = dealt[0] if dealt else rows.withColumn("p", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    left = placed.withColumn("q", each(blocks))
    numbered = asked.withColumn("q", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    right = _reaching(numbered, dealt[1], least) if dealt else numbered.withColumn("p", each(parts))

    def run(some: pa.Table, block_rows: pa.Table) -> pa.Table:
        names = ("query_id", "id", "similarity")
        if not len(some) or not len(block_rows):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        found = _compare(some.column("id").to_numpy(), _matrix(some), block_rows.column("query_id").to_numpy(), _matrix(block_rows), k, least)
        return pa.table([pa.array(x) for x in found], names=names)

    cell = [*within, "p", "q"]
    if not dealt:
        # as many tasks as cells: cells are small in bytes and large in work, and would be put together by their bytes otherwise
        left, right = (side.repartition(max(tasks, parts * blocks), *cell) for side in (left, right))
    kept = [group] if group and per_group else []
    named = {c: left.schema[c].dataType.simpleString() for c in kept}

    def within_group(key: tuple, some: pa.Table, block_rows: pa.Table) -> pa.Table:
        found = run(some, block_rows)
        return found.append_column(group, pa.array([key[0].as_py()] * len(found), pa.string()))

    if kept:
        schema = f"query_id long, id long, similarity double, {group} {named[group]}"
        found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(within_group, schema)
        best = Window.partitionBy(group, "query_id").orderBy(F.desc("similarity"), "id")
        return found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).select("query_id", "id", "similarity")
    out = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(run, "query_id long, id long, similarity double")
    if k is None:
        return out
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return out.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).drop("n")


def nearest(base: DataFrame, queries: DataFrame, gate: float = 0.4, group: str | None = None) -> DataFrame:
    """Each query's single nearest row, if it is at least as similar as the gate."""
    return similar(base, queries, k=1, least=gate, group=group)


def near_duplicates(base: DataFrame, queries: DataFrame, least: float = 0.9, first: int = 5, group: str = "doc_path") -> DataFrame:
    """queries (doc_path, query_id, vector) -> (doc_path, place, query_id, id, similarity): the warning that an ingest gives.

    The first `first` rows at or above `least` for a document, by query_id and falling similarity, ties by id.
    """
    # of one query no more than `first` can be among the first of its document
    found = similar(base, queries, k=first, least=least).join(queries.select(group, "query_id"), "query_id")
    place = F.row_number().over(Window.partitionBy(group).orderBy("query_id", F.desc("similarity"), "id"))
    return found.withColumn("place", place).where(F.col("place") <= first).select(group, "place", "query_id", "id", "similarity")
