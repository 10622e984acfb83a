"""BM25 full-text search for a query set over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as X

K1, B = 1.2, 0.75
#: (query, term) pairs that are broadcast at most; beyond, postings of a term are dealt into SALTS parts.
BROADCAST_PAIRS, SALTS = 500_000, 32


def search(docs: DataFrame, queries: DataFrame, k: int = 20, kept: DataFrame | None = None) -> DataFrame:
    """docs (id, text), queries (query_id, text) -> (query_id, id, score, rank), each query's best k, ties by id.

    Counts and lengths are those of all documents; only postings of query terms are shuffled,
    after a count per task. Scores are rounded to 9 places. kept: ids to which results are held.
    The query terms are broadcast if they are few enough, so the postings of a stop word, one for
    each document, are not brought together; otherwise each term's postings are dealt into parts.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(X.terms(F.col("text")))).alias("term"))
    listed = docs.select("id", X.terms(F.coalesce("text", F.lit(""))).alias("terms")).withColumn("length", F.size("terms"))
    size = listed.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    total, mean = size["n"], float(size["mean"] or 1.0) or 1.0
    tokens = listed.select("id", "length", F.explode("terms").alias("term"))
    few = asked.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS
    small = F.broadcast if few else (lambda side: side)
    postings = tokens.join(small(asked.select("term").distinct()), "term").groupBy("term", "id", "length").agg(F.count("*").alias("tf"))
    holders = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(float(total)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * F.lit(K1 + 1) / (F.col("tf") + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("length") / F.lit(mean)))
    found = postings if kept is None else postings.join(kept, "id", "left_semi")
    weighted = asked.join(small(holders), "term")
    if few:
        matched = found.join(F.broadcast(weighted), "term")
    else:
        salted = weighted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        matched = found.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["term", "salt"])
    scored = matched.groupBy("query_id", "id").agg(F.round(F.sum(part), 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)
