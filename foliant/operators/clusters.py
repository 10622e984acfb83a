"""Clusters of a document's chunks by average linkage on cosine distance, and their summaries."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as X

from foliant.sources.scratch import written

from . import curation, models, similarity

CUT, LEAST = 0.8, 3
#: Documents whose trees are cut at a time.
STEP_TREES = 256


def merges(vectors: np.ndarray, most: float = CUT) -> list[tuple[int, int, float]]:
    """The dendrogram up to a height: (first member of one cluster, first member of the other, mean distance), the smaller number first.

    Chains of nearest neighbours: on unit vectors the mean distance of two clusters follows from their sums, so
    memory is that of the vectors and time the square of their number. A cluster whose nearest one
    is beyond the height can never merge again, for mean distances do not fall below those they are made of.
    """
    n = len(vectors)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    sums = vectors / np.where(norms == 0, 1, norms)
    size, active, out = np.ones(n), np.ones(n, bool), []
    chain: list[int] = []
    while active.sum() > 1:
        if not chain:
            chain.append(int(np.flatnonzero(active)[0]))
        tip = chain[-1]
        distance = np.where(active, 1 - (sums @ sums[tip]) / (size * size[tip]), np.inf)
        distance[tip] = np.inf
        near = int(np.argmin(distance))
        if len(chain) > 1 and distance[chain[-2]] <= distance[near]:
            near = chain[-2]
        if len(chain) < 2 or near != chain[-2]:
            if distance[near] > most and len(chain) == 1:
                active[tip] = False
                chain.clear()
            else:
                chain.append(near)
            continue
        del chain[-2:]
        if distance[near] > most:
            active[[tip, near]] = False
            continue
        i, j = sorted((tip, near))
        out.append((i, j, float(distance[near])))
        sums[i] += sums[j]
        size[i] += size[j]
        active[j] = False
    return out


def cut_at(n: int, made: list[tuple[int, int, float]], cut: float) -> np.ndarray:
    """Cluster number of each of n members, numbered by first member, after the merges that are no higher than the cut."""
    up = np.arange(n)
    for i, j, height in made:
        if height <= cut:
            up[up == up[j]] = up[i]
    return np.unique(up, return_inverse=True)[1]


def average_linkage(vectors: np.ndarray, cut: float = CUT) -> np.ndarray:
    """Cluster number of each vector, numbered by first member."""
    return cut_at(len(vectors), merges(vectors, cut), cut)


def _trees(vectors: pa.Array, most: float) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
    """The number of vectors of each document and its merges, one document at a time."""
    for at in range(len(vectors)):
        rows = vectors.slice(at, 1).flatten()
        n = len(rows)
        yield n, merges(rows.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64), most)


def _grouped(rows: DataFrame, least: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_path, m): each document's chunks in order as one array, with chunk_index, vector and the carried columns; sessions and documents under `least` chunks are left out."""
    member = F.struct(F.col("chunk_index").cast("long").alias("chunk_index"), "vector", *carried)
    wanted = rows.where((F.col("source_type") != "session") & F.col("vector").isNotNull())
    return wanted.groupBy("doc_path").agg(F.sort_array(F.collect_list(member)).alias("m")).where(F.size("m") >= least)


def clusters(rows: DataFrame, cut: float = CUT, least: int = LEAST, carried: tuple[str, ...] = ()) -> DataFrame:
    """rows (doc_path, chunk_index, vector, source_type) -> (doc_path, chunk_index, cluster, and the carried columns).

    Sessions and documents under `least` chunks are left out, as are smaller clusters. A group
    is one document's chunks, which its length bounds; only their vectors are shown to Python.
    """

    @F.arrow_udf("array<long>")
    def place(vectors: pa.Array) -> pa.Array:
        out = []
        for n, made in _trees(vectors, cut):
            found = cut_at(n, made, cut)
            out.append(np.where(np.bincount(found)[found] >= least, found, -1))
        return pa.array(out, pa.list_(pa.int64()))

    placed = _grouped(rows, least, carried).withColumn("found", place("m.vector"))
    each = placed.select("doc_path", F.explode(F.arrays_zip("m", "found")).alias("x")).where("x.found >= 0")
    return each.select("doc_path", "x.m.chunk_index", *[f"x.m.{c}" for c in carried], F.col("x.found").alias("cluster"))


def summaries(rows: DataFrame, cut: float = CUT, least: int = LEAST, summarizer: Callable[[Column], Column] = models.extract_summary) -> DataFrame:
    """Tier-1 rows, one per cluster of three or more chunks: text, heading, parents, token count, of all its chunks. Rows are read once."""
    placed = clusters(rows, cut, least, ("chunk_id", "text", "heading", "source_type"))
    member = F.struct("chunk_index", "chunk_id", "text", "heading")
    gathered = placed.groupBy("doc_path", "source_type", "cluster").agg(F.array_sort(F.collect_list(member)).alias("m"), F.count("*").alias("n_chunks"))
    text = summarizer(F.col("m.text"))
    made = gathered.select(
        "doc_path",
        "source_type",
        F.substring(F.sha2(F.concat_ws("|", "doc_path", F.array_join("m.chunk_id", ",")), 256), 1, 12).alias("cluster_id"),
        F.col("m.chunk_id").alias("parent_id"),
        models.summary_heading(F.col("m.heading")).alias("heading"),
        text.alias("text"),
        "n_chunks",
    )
    return made.where(F.length("text") >= 20).select("*", F.lit(1).alias("tier"), F.lit(-1).alias("chunk_index"), F.size(X.words(F.col("text"))).alias("token_count"), F.lit("").alias("content_hash"))


def rebuilt(chunks: DataFrame, created_at: str, cut: float = CUT, least: int = LEAST, embedder: Callable[[Column], Column] = models.embed, summarizer: Callable[[Column], Column] = models.extract_summary) -> DataFrame:
    """The chunk table with its tier-1 rows made anew from its tier-0 rows: old ones dropped, new ones embedded and appended."""
    leaves = chunks.where("tier <> 1")
    made = summaries(leaves.where("tier = 0"), cut, least, summarizer)
    row = {
        "chunk_id": F.sha2(F.concat(F.lit("cluster|"), "cluster_id"), 256),
        "doc_id": X.document_key(F.col("doc_path")),
        "vector": embedder(F.col("text")),
        "char_start": F.lit(0),
        "char_end": F.lit(0),
        "retrieval_count": F.lit(0),
        "created_at": F.lit(created_at).cast("timestamp_ntz"),
        "authored_at": F.lit(None).cast("timestamp_ntz"),
        "pipeline_version": F.lit("1.0.0-clusters"),
    }
    return leaves.unionByName(made.withColumns(row).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in chunks.schema]))


def dendrograms(rows: DataFrame, most: float, least: int = LEAST) -> DataFrame:
    """rows as for clusters() -> (doc_path, places, merges), the whole tree of each document up to a height: one pass over the vectors, whatever is cut later.

    places: the chunks in order; merges: (one, other, height), by their place from 0. Sessions and documents under `least` chunks are left out.
    """

    node = pa.struct([("one", pa.int32()), ("other", pa.int32()), ("height", pa.float64())])

    @F.arrow_udf("array<struct<one: int, other: int, height: double>>")
    def grow(vectors: pa.Array) -> pa.Array:
        return pa.array([[{"one": i, "other": j, "height": h} for i, j, h in made] for _, made in _trees(vectors, most)], pa.list_(node))

    return _grouped(rows, least).select("doc_path", F.col("m.chunk_index").alias("places"), grow("m.vector").alias("merges"))


def cuts(trees: DataFrame, settings: list[tuple[float, int]]) -> DataFrame:
    """dendrograms() -> (cut, least, doc_path, chunk_index, cluster) of the chunks that each (cut, least) puts into a cluster of `least` or more."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in (whole.iloc[at : at + STEP_TREES] for whole in parts for at in range(0, len(whole), STEP_TREES)):
            out = []
            for row in part.itertuples(index=False):
                made = [(m["one"], m["other"], m["height"]) for m in row.merges]
                found = {cut: cut_at(len(row.places), made, cut) for cut in {cut for cut, _ in settings}}
                for cut, least in settings:
                    kept = np.bincount(found[cut])[found[cut]] >= least
                    out += [(cut, least, row.doc_path, place, int(c)) for place, c, k in zip(row.places, found[cut], kept, strict=True) if k]
            yield pd.DataFrame(out, columns=["cut", "least", "doc_path", "chunk_index", "cluster"])

    return trees.mapInPandas(run, "cut double, least int, doc_path string, chunk_index long, cluster long")


def sweep(rows: DataFrame, settings: list[tuple[float, int]]) -> DataFrame:
    """rows as for clusters() -> (cut, least, n_clusters, n_chunks, n_docs) for each (cut, least): what each setting would summarise, from one tree a document."""
    trees = dendrograms(rows, max(cut for cut, _ in settings), min(least for _, least in settings))
    own = cuts(trees, settings).groupBy("cut", "least", "doc_path", "cluster").agg(F.count("*").alias("n"))
    counted = own.groupBy("cut", "least", "doc_path").agg(F.count("*").alias("clusters"), F.sum("n").alias("chunks"))
    return _every(settings, rows).join(counted, ["cut", "least"], "left").groupBy("cut", "least").agg(F.coalesce(F.sum("clusters"), F.lit(0)).alias("n_clusters"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("n_chunks"), F.count("doc_path").alias("n_docs"))


def _every(settings: list[tuple[float, int]], rows: DataFrame) -> DataFrame:
    return F.broadcast(rows.sparkSession.createDataFrame(settings, "cut double, least int"))


def scored_sweep(rows: DataFrame, queries: DataFrame, settings: list[tuple[float, int]], k: int = 5, summarizer: Callable[[Column], Column] = models.extract_summary, embedder: Callable[[Column], Column] = models.embed) -> DataFrame:
    """rows (chunk_id, doc_path, chunk_index, source_type, text, vector), queries (query_id, vector, expected_file, expected_text) -> (cut, least, summaries, and the measures of evaluated()).

    Each setting's summaries are searched together with the leaves, by vectors, and its k best rows of each query are judged. A row with a null
    setting is the search of the leaves alone. Leaves are searched once, and every document's tree is built once, for all settings.
    """
    trees = dendrograms(rows, max(cut for cut, _ in settings), min(least for _, least in settings))
    texts = rows.select("doc_path", F.col("chunk_index").cast("long").alias("chunk_index"), "text")
    member = F.struct("chunk_index", "text")
    gathered = cuts(trees, settings).join(texts, ["doc_path", "chunk_index"]).groupBy("cut", "least", "doc_path", "cluster").agg(F.array_sort(F.collect_list(member)).alias("m"))
    made = gathered.select("cut", "least", "doc_path", summarizer(F.col("m.text")).alias("text"), F.xxhash64("cut", "least", "doc_path", "cluster").alias("id")).where(F.length("text") >= 20)
    made = written(made.withColumn("vector", embedder(F.col("text"))).withColumn("setting", F.concat_ws("|", "cut", "least")), "summaries")
    asked = queries.select("query_id", "vector")
    leaves = rows.where((F.col("source_type") != "session") & F.col("vector").isNotNull()).select(F.xxhash64("chunk_id").alias("id"), "doc_path", "text", "vector")
    every = rows.sparkSession.createDataFrame([(f"{cut}|{least}", cut, least) for cut, least in settings], "setting string, cut double, least int")
    names = [F.lit(f"{cut}|{least}") for cut, least in settings]
    near = similarity.similar(leaves, asked, k=k).select("query_id", "id", "similarity", F.explode(F.array(F.lit(None).cast("string"), *names)).alias("setting"), F.lit(True).alias("leaf"))
    high = similarity.similar(made, asked.withColumn("setting", F.explode(F.array(*names))), k=k, group="setting", per_group=True).join(made.select("id", "setting"), "id").select("query_id", "id", "similarity", "setting", F.lit(False).alias("leaf"))
    rank = F.row_number().over(Window.partitionBy("setting", "query_id").orderBy(F.desc("similarity"), "id"))
    # written, for it is read for its texts and for its settings, and holds all searches
    best = written(near.unionByName(high).withColumn("rank", rank).where(F.col("rank") <= k), "ranked")
    texts = (best.where(F.col("leaf") == leaf).join(of.select("id", "doc_path", "text"), "id") for leaf, of in ((True, leaves), (False, made)))
    ranked = functools.reduce(DataFrame.unionByName, texts)
    judged = curation.evaluated(ranked, queries, "setting")
    sizes = made.groupBy("setting").agg(F.count("*").alias("summaries"))
    named = judged.join(F.broadcast(every), "setting", "left").join(sizes, "setting", "left")
    return named.select("cut", "least", F.coalesce("summaries", F.lit(0)).alias("summaries"), *[c for c in judged.columns if c != "setting"])
