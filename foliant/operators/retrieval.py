"""Hybrid search: nearest vectors merged with full-text hits, boosts, recency, reranking, result shape."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as X

from . import fulltext, similarity

MAX_RESULTS, FETCH_MULTIPLIER, CANDIDATES = 10, 2, 20
Scorer = Callable[[Column, Column], Column]
#: (queries, k, ids to hold to) -> (query_id, id, score, rank), as TextIndex.search gives it.
Lexical = Callable[[DataFrame, int, DataFrame], DataFrame]


def clamp_k(k: int) -> int:
    return max(1, min(int(k), MAX_RESULTS))


def pool_size(k: int, candidates: int = CANDIDATES, multiplier: int = FETCH_MULTIPLIER) -> int:
    return max(candidates, clamp_k(k) * multiplier)


def lexical_score(query: Column, text: Column) -> Column:
    """Share of the query's distinct terms that the text holds: the default scorer."""
    asked = F.array_distinct(X.terms(query))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(asked, X.terms(text))), F.size(asked)), F.lit(0.0))


def searched(rows: DataFrame, exclude: str | None = None, tier: int | None = None) -> DataFrame:
    """Rows that a search may find: not of an excluded source type, and of one tier if it is given."""
    kept = rows if exclude is None else rows.where(F.col("source_type") != exclude)
    return kept if tier is None else kept.where(F.col("tier") == tier)


def hybrid(rows: DataFrame, queries: DataFrame, pool: int = CANDIDATES, exclude: str | None = "session", boosts: dict[str, float] | None = None, recency_weight: float = 0.0, half_life: float | None = 90.0, now: str | None = None, tier: int | None = None, lexical: Lexical | None = None) -> DataFrame:
    """rows (id, text, vector, source_type, authored_at), queries (query_id, text, vector) -> (query_id, id, boosted, position).

    Vector hits have their squared distance; full-text hits that are no vector hits get the
    query's greatest distance times 1.01, or 1.0 where there are no vector hits. Distances are
    boosted by source type and, with a weight, by recency at `now`. Excluded rows, and those of another
    tier than the given one, fill no pool. lexical: the search of a stored index over the texts of rows, instead of one that reads them all.
    """
    kept = searched(rows, exclude, tier)
    near = similarity.similar(kept, queries, k=pool).select("query_id", "id", (2 - 2 * F.col("similarity")).alias("distance"), F.lit(0).alias("from_text"), F.lit(0).alias("text_rank"))
    hits = lexical(queries, pool, kept.select("id")) if lexical else fulltext.search(rows.select("id", "text"), queries, pool, kept.select("id"))
    farthest = near.groupBy("query_id").agg(F.max("distance").alias("far"))
    more = hits.join(near, ["query_id", "id"], "left_anti").join(farthest, "query_id", "left")
    more = more.select("query_id", "id", F.coalesce(F.col("far") * 1.01, F.lit(1.0)).alias("distance"), F.lit(1).alias("from_text"), F.col("rank").alias("text_rank"))
    joined = near.unionByName(more).join(kept.select("id", "source_type", "authored_at"), "id")
    factor = F.lit(1.0)
    if recency_weight > 0:
        age = (F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("authored_at").cast("timestamp"))) / 86400.0
        factor = X.recency(age, recency_weight, half_life)
    boosted = joined.withColumn("boosted", F.round(F.col("distance") * X.boost(F.col("source_type"), boosts) * factor, 9))
    place = Window.partitionBy("query_id").orderBy("boosted", "from_text", "text_rank", "id")
    return boosted.withColumn("position", F.row_number().over(place)).where(F.col("position") <= pool).select("query_id", "id", "boosted", "position")


def reranked(candidates: DataFrame, rows: DataFrame, queries: DataFrame, k: int = 3, scorer: Scorer = lexical_score) -> DataFrame:
    """The best k of each query's candidates by the scorer, ties in the order of candidates, in result shape."""
    k = clamp_k(k)
    texts = queries.select("query_id", F.col("text").alias("query"))
    scored = candidates.join(rows, "id").join(texts, "query_id").withColumn("rerank_score", F.round(scorer(F.col("query"), F.col("text")), 9))
    place = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "position")
    best = scored.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "id", "source_type", F.substring("text", 1, 500).alias("preview"), (F.length("text") > 500).alias("truncated"), F.col("boosted").alias("score"), "rerank_score")


def search(rows: DataFrame, queries: DataFrame, k: int = 3, include_sessions: bool = False, scorer: Scorer = lexical_score, **options) -> DataFrame:
    """Hybrid candidates, reranked: the whole search for a batch of queries."""
    found = hybrid(rows, queries, pool_size(k), None if include_sessions else "session", **options)
    return reranked(found, rows, queries, k, scorer)


def confidence(results: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, confidence): none without results, low under a best score of 0.3, else high."""
    best = results.groupBy("query_id").agg(F.max("rerank_score").alias("best"))
    level = F.when(F.col("best").isNull(), "none").when(F.col("best") < 0.3, "low").otherwise("high")
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", level.alias("confidence"))


def line_spans(results: DataFrame, sources: DataFrame) -> DataFrame:
    """results (doc_path, char_start, char_end, text, content_hash) with line_start and line_end.

    Null where the source is missing, has changed since, or does not hold the text there.
    """
    whole = sources.select("doc_path", F.col("text").alias("source_text"))
    joined = results.join(whole, "doc_path", "left")
    here = F.rtrim(F.substring(F.col("source_text"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start")))
    right = (X.content_hash(F.col("source_text")) == F.col("source_hash")) & (here == F.rtrim("text"))
    span = F.when(right, X.line_span(F.col("source_text"), F.col("char_start"), F.col("char_end")))
    return joined.withColumn("span", span).select(*results.columns, "span.line_start", "span.line_end")
