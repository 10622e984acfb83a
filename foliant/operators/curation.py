"""Deduplication at ingest, catalogue upkeep, session budgets, and retrieval measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as X

BUDGET = 80_000
BLOAT_FACTOR, BLOAT_FLOOR = 2, 2000


def with_donors(rows: DataFrame, donors: DataFrame | None = None) -> DataFrame:
    """rows (doc_path, seq, source_type, content_hash) with first_donor and kept.

    A row is dropped if another, earlier, non-session document holds its hash; rows of the
    same document do not count. donors: rows that were there before all of these.
    """
    order = rows.where("source_type <> 'session'").groupBy("content_hash").agg(F.min("seq").alias("first_donor"))
    if donors is not None:
        old = donors.where("source_type <> 'session'").select("content_hash").distinct().withColumn("first_donor", F.lit(-1).cast("long"))
        order = order.unionByName(old).groupBy("content_hash").agg(F.min("first_donor").alias("first_donor"))
    joined = rows.join(order, "content_hash", "left")
    return joined.withColumn("kept", F.col("first_donor").isNull() | (F.col("seq") <= F.col("first_donor")))


def hash_documents(rows: DataFrame) -> DataFrame:
    """How many documents hold each hash, and the first and last of them."""
    return rows.groupBy("content_hash").agg(F.countDistinct("doc_path").alias("n_docs"), F.min("doc_path").alias("first_path"), F.max("doc_path").alias("last_path"))


def diff(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """files (path, content_hash), manifest (path, content_hash) -> (path, status): new, modified, unchanged or deleted."""
    now = files.select(X.slashes(F.col("path")).alias("path"), F.col("content_hash").alias("now"))
    then = manifest.select(X.slashes(F.col("path")).alias("path"), F.col("content_hash").alias("then"))
    status = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("now") != F.col("then"), "modified").otherwise("unchanged")
    return now.join(then, "path", "full_outer").select("path", status.alias("status"))


def without_paths(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """Rows of documents that are not in paths (path)."""
    return rows.join(paths.select(F.col("path").alias("doc_path")).distinct(), "doc_path", "left_anti").select(*rows.columns)


def within_budget(reports: DataFrame, group: str, order: list[str], budget: int = BUDGET) -> DataFrame:
    """reports (…, length) with used and status: taken, clamped or pending, in order within a budget of characters."""
    before = F.coalesce(F.sum("length").over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = reports.withColumn("before", before)  # give lengths alone where texts are long: a group is one task's
    used = F.least(F.col("length"), F.greatest(F.lit(budget) - F.col("before"), F.lit(0)))
    status = F.when(F.col("before") >= budget, "pending").when(F.col("length") > F.lit(budget) - F.col("before"), "clamped").otherwise("taken")
    return marked.withColumn("used", used).withColumn("status", status).drop("before")


def first_rows(rows: DataFrame, group: str, order: list[str], n: int, name: str | None = None) -> DataFrame:
    """The first n rows of each group, with their place under a name if one is given."""
    place = name or "place_in_group"
    found = rows.withColumn(place, F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col(place) <= n)
    return found if name else found.drop(place)


def bloated(merged: Column, existing: Column, new: Column) -> Column:
    """A merged note is bloated beyond twice the old one (or 2000) and beyond both its inputs together."""
    return (merged > F.greatest(F.lit(BLOAT_FACTOR) * existing, F.lit(BLOAT_FLOOR))) & (merged > existing + new)


def _measures(ranked: DataFrame, text_match: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """(rank: null without a hit) per query -> by, n, hit_1, hit_3, hit_5, mrr, text_match_1, composite."""
    share = lambda test: F.coalesce(F.avg(F.when(test, 1.0).otherwise(0.0)), F.lit(0.0))
    hits = [share(F.col("rank") <= k).alias(f"hit_{k}") for k in (1, 3, 5)]
    mean = F.coalesce(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), F.lit(0.0))
    measured = (ranked.groupBy(*by) if by else ranked).agg(F.count("*").alias("n"), *hits, mean.alias("mrr"), share((F.col("rank") == 1) & text_match).alias("text_match_1"))
    composite = 0.4 * F.col("mrr") + 0.3 * F.col("hit_1") + 0.3 * F.col("text_match_1")
    return measured.select(*by, "n", *[F.round(c, 6).alias(c) for c in ("hit_1", "hit_3", "hit_5", "mrr", "text_match_1")], F.round(composite, 6).alias("composite"))


def ranked_metrics(results: DataFrame, expected: DataFrame, queries: DataFrame) -> DataFrame:
    """results (query_id, id, rank), expected (query_id, id) -> n, hit_1, hit_3, hit_5, mrr, text_match_1, composite.

    The first expected result counts. A query without one counts as a miss. No text is asked
    for, so a text matches where the best result is an expected one; see evaluated().
    """
    first = results.join(expected, ["query_id", "id"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    return _measures(queries.select("query_id").join(first, "query_id", "left"), F.lit(True))


def evaluated(results: DataFrame, queries: DataFrame, by: str | None = None) -> DataFrame:
    """results (query_id, rank, doc_path, text), queries (query_id, expected_file, expected_text) -> the measures of ranked_metrics().

    A result is a hit if its path holds expected_file, and the first one counts; its text matches if it
    is the best result and holds expected_text in any case. An empty expected text always matches.
    by: a column of results that tells several searches apart (null is one as well), each of which has a row.
    """
    asked = queries.select("query_id", "expected_file", F.lower(F.coalesce("expected_text", F.lit(""))).alias("expected_text"))
    hits = results.join(asked, "query_id").where(F.contains("doc_path", "expected_file"))
    if by is None:
        first = hits.groupBy("query_id").agg(F.min(F.struct("rank", F.contains(F.lower("text"), F.col("expected_text")).alias("matches"))).alias("first")).select("query_id", "first.*")
        return _measures(asked.select("query_id").join(first, "query_id", "left"), F.coalesce("matches", F.lit(False)))
    best = hits.groupBy(by, "query_id").agg(F.min(F.struct("rank", F.contains(F.lower("text"), F.col("expected_text")).alias("matches"))).alias("first")).select(F.col(by).alias("of"), F.col("query_id").alias("for"), "first.*")
    every = results.select(by).distinct().crossJoin(asked.select("query_id"))  # a few searches, each with all queries
    ranked = every.join(best, F.col(by).eqNullSafe(F.col("of")) & (F.col("query_id") == F.col("for")), "left")
    return _measures(ranked, F.coalesce("matches", F.lit(False)), (by,))


def holders(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs (id, text), items (query_id, text) -> (query_id, id): documents that hold an item word for word.

    Candidates hold the item's longest inner term as a term of their own, which a join finds; the text is
    then compared. Items without an inner term are few words long and are compared with every document.
    """
    inner = F.slice(X.terms(F.col("text")), 2, F.greatest(F.size(X.terms(F.col("text"))) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    asked = items.where("text is not null").select("query_id", F.col("text").alias("wanted"), longest.alias("term"))
    terms = docs.select("id", F.explode(F.array_distinct(X.terms(F.col("text")))).alias("term"))
    pairs = terms.join(asked.where("term is not null"), "term").select("query_id", "id", "wanted")
    found = pairs.join(docs, "id").where(F.contains("text", "wanted")).select("query_id", "id")
    short = asked.where("term is null")
    if short.isEmpty():
        return found
    return found.unionByName(docs.join(short, F.contains("text", "wanted")).select("query_id", "id"))
