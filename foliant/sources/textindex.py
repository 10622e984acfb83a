"""A stored full-text index: posting blocks by term, folded in at each sync, searched with block-max pruning.

Documents of a part are dealt into windows of about WINDOW by a hash of their id. A block holds the postings of one term in one window, with
its count, greatest frequency and least length, from which the most that the term can add to a score there
follows for any mean length. A task makes all blocks of its windows, so no posting moves, and writes them in folders by a hash of
their term and sorted by it: a search opens the folders of its terms only, and pages that may hold them. Each fold writes one part: the blocks
of what came, and the ids that went, which no longer count in parts before it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import text as X
from foliant.operators.fulltext import K1, B

from .pointer import Pointer
from .scratch import written

#: Documents of a window, on average; folders of a part; windows of a query that are scored before any is left out.
WINDOW, BUCKETS, SEEDS = 1024, 8, 4
#: Windows of a task at most, on average, and folders of indexes whose pointer does not name their number.
TASK_WINDOWS, OLD_BUCKETS = 4, 64
#: No text has this term. Its blocks have all documents of their windows.
EVERY = ""
#: Terms that are named in the filter of a scan at most, and parts that a fold leaves uncompacted.
LITERALS, MOST_PARTS = 5000, 16


def gain(idf: Column, tf: Column, length: Column, mean: float) -> Column:
    """What a term adds to a BM25 score."""
    return idf * tf * F.lit(K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * length / F.lit(mean)))


def placed(rows: DataFrame, windows: int) -> DataFrame:
    """rows (id, ...) with their window, each window in one task, and as many windows in each task, named by the column task."""
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = min(windows, max(width, math.ceil(windows / TASK_WINDOWS)))
    marked = rows.withColumn("window", F.pmod(F.xxhash64("id"), F.lit(windows)).cast("int")).withColumn("task", F.col("window") % tasks)
    return marked.repartitionById(tasks, "task")


def counted_terms(added: DataFrame, windows: int | None = None, each: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """added (id, text) -> (id, length), (term, id, length, tf), the latter with window and task if windows are to be dealt out.

    Texts are dealt by id, or by window, for a table's files may hold very many in one row group; terms are then counted where they are, and no
    token moves. Lengths alone are taken where texts lie, as that moves nothing. each: terms that all documents get besides, whatever their length.
    """
    terms = X.terms(F.coalesce("text", F.lit("")))
    dealt = added.select("id", "text").repartition("id") if windows is None else placed(added.select("id", "text"), windows)
    place = [c for c in dealt.columns if c not in ("id", "text")]
    listed = dealt.select("id", *place, terms.alias("terms"))
    tokens = listed.select("id", *place, F.size("terms").alias("length"), F.explode(F.concat("terms", F.array(*map(F.lit, each))) if each else F.col("terms")).alias("term"))
    lengths = added.select("id", F.size(terms).alias("length"))
    return lengths, tokens.groupBy("term", "id", "length", *place).agg(F.count("*").cast("int").alias("tf")).select("term", "id", "length", "tf", *place)


def blocks_of(counted: DataFrame) -> DataFrame:
    """counted (term, id, length, tf, window, task), as placed() deals it -> the blocks, made where their window is."""
    rows = F.sort_array(F.collect_list(F.struct("id", "tf", "length")))  # at most a window's documents
    return counted.groupBy("task", "term", "window").agg(rows.alias("x")).select(
        "term", "window", F.size("x").alias("n"), F.array_max("x.tf").alias("max_tf"), F.array_min("x.length").alias("min_length"), F.col("x.id").alias("ids"), F.col("x.tf").alias("tfs"), F.col("x.length").alias("lengths")
    )


class TextIndex:
    """fold() what came and went, search() as operators.fulltext.search would over the documents that are there."""

    def __init__(self, spark: SparkSession, path: str, window: int = WINDOW, buckets: int = BUCKETS) -> None:
        self.spark, self.window, self.buckets = spark, window, buckets
        self.pointer = Pointer(spark, path)
        self.path = self.pointer.path

    def state(self) -> dict:
        empty = {"version": 0, "parts": {}, "removed": [], "docs": 0, "tokens": 0, "folders": [], "buckets": self.buckets}
        return {"buckets": OLD_BUCKETS} | (self.pointer.read() or empty)

    def _table(self, kind: str, parts: list[int]) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/{kind}").parquet(*[f"{self.path}/{kind}/part={p}" for p in parts])

    def _bucket(self, state: dict, term: Column | str = "term") -> Column:
        return F.pmod(F.xxhash64(term), F.lit(state["buckets"])).cast("int").alias("bucket")

    def documents(self) -> DataFrame | None:
        """(id, length, part) of the documents that are there; none before the first fold."""
        state = self.state()
        if not state["parts"]:
            return None
        docs = self._table("docs", sorted(map(int, state["parts"])))
        if not state["removed"]:
            return docs
        gone = self._table("gone", state["removed"]).select(F.col("id").alias("gone"), F.col("part").alias("since"))
        return docs.join(gone, (F.col("id") == F.col("gone")) & (F.col("since") > F.col("part")), "left_anti")

    def fold(self, added: DataFrame, removed: DataFrame | None = None) -> int:
        """A new version: without the documents whose id is in removed (id), with those of added (id, text). Ids of added must not be there otherwise.

        A null text has no terms. An id may be in both: the old text goes, the new one comes.
        """
        state = self.state()
        version, before = state["version"] + 1, self.documents()
        lost = {"docs": 0, "tokens": 0}
        if removed is not None and before is not None:
            removed.select("id").distinct().write.mode("overwrite").parquet(f"{self.path}/gone/part={version}")
            gone = self.spark.read.parquet(f"{self.path}/gone/part={version}")
            row = before.join(gone, "id", "left_semi").agg(F.count("*").alias("docs"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens")).first()
            lost = row.asDict()
        windows = self._windows(added.count())
        size = self._write(state, version, windows, counted_terms(added, windows, (EVERY,))[1])
        removals = state["removed"] + ([version] if lost["docs"] else [])
        self._commit({
            "version": version, "parts": state["parts"] | {str(version): size["windows"]}, "removed": removals,
            "docs": state["docs"] + size["docs"] - lost["docs"], "tokens": state["tokens"] + size["tokens"] - lost["tokens"], "buckets": state["buckets"],
        })
        return self.compact() if len(state["parts"]) >= MOST_PARTS else version

    def _commit(self, state: dict) -> None:
        folders = [f"{kind}/part={p}" for p in state["parts"] for kind in ("docs", "postings")] + [f"gone/part={p}" for p in state["removed"]]
        self.pointer.commit(state | {"folders": folders})

    def _windows(self, docs: int) -> int:
        return max(1, math.ceil(docs / self.window))

    def _write(self, state: dict, version: int, windows: int, counted: DataFrame) -> dict[str, int]:
        """counted (term, id, length, tf, window, task), as placed() deals it and with EVERY, as a part: its blocks, and from those of EVERY its documents."""
        blocks = blocks_of(counted).select(self._bucket(state), "*")
        at = f"{self.path}/postings/part={version}"
        blocks.sortWithinPartitions("bucket", "term", "window").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(at)
        every = self.spark.read.schema(blocks.schema).parquet(at).where((F.col("term") == EVERY) & (F.col("bucket") == self._bucket(state, F.lit(EVERY))))
        docs = every.select(F.explode(F.arrays_zip("ids", "lengths", "tfs")).alias("x")).select(F.explode(F.array_repeat(F.struct(F.col("x.ids").alias("id"), F.col("x.lengths").alias("length")), F.col("x.tfs"))).alias("x")).select("x.*")  # repeated rows each
        docs.write.mode("overwrite").parquet(f"{self.path}/docs/part={version}")
        size = self.spark.read.schema(docs.schema).parquet(f"{self.path}/docs/part={version}").agg(F.count("*").alias("docs"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"))
        return size.first().asDict() | {"windows": windows}

    def compact(self) -> int:
        """A new version of the same documents in one part, without a trace of those that went."""
        state = self.state()
        blocks, version = self._blocks(state, None), state["version"] + 1
        if blocks is None:
            return state["version"]
        counted = blocks.select("term", F.explode(F.arrays_zip("ids", "tfs", "lengths")).alias("x")).select("term", F.col("x.ids").alias("id"), F.col("x.lengths").alias("length"), F.col("x.tfs").alias("tf"))
        every = self.documents().select(F.lit(EVERY).alias("term"), "id", "length", F.lit(1).alias("tf"))
        size = self._write(state, version, windows := self._windows(state["docs"]), placed(counted.where(F.col("term") != EVERY).unionByName(every), windows))
        self._commit({"version": version, "parts": {str(version): size["windows"]}, "removed": [], "docs": size["docs"], "tokens": size["tokens"], "buckets": state["buckets"]})
        return version

    def clean_up(self, older_than_seconds: float = 86_400.0) -> int:
        return self.pointer.clean_up(("docs", "postings", "gone"), older_than_seconds)

    def _blocks(self, state: dict, terms: DataFrame | None) -> DataFrame | None:
        """The blocks of terms (term), or of all, without postings of documents that went; none if nothing was folded in that has a term."""
        parts = sorted(map(int, state["parts"]))
        if not parts or not state["tokens"]:
            return None
        found = self._table("postings", parts)
        if terms is not None:
            names = [r["term"] for r in terms.distinct().limit(LITERALS + 1).collect()]
            if len(names) <= LITERALS:
                buckets = [r["bucket"] for r in self.spark.createDataFrame([(x,) for x in names] or [("",)], "term string").select(self._bucket(state)).distinct().collect()]
                found = found.where(F.col("bucket").isin(buckets) & F.col("term").isin(names))
            else:
                found = found.join(terms.distinct().select("term", self._bucket(state)), ["bucket", "term"], "left_semi")
        if not state["removed"]:
            return found
        # the windows that ids which went would lie in, for each part before they did
        sizes = self.spark.createDataFrame([(int(p), w) for p, w in state["parts"].items()], "part int, windows int")
        gone = self._table("gone", state["removed"]).select("id", F.col("part").alias("since"))
        hit = gone.join(F.broadcast(sizes), F.col("part") < F.col("since")).select("part", F.pmod(F.xxhash64("id"), F.col("windows")).cast("int").alias("window"), "id")
        dead = hit.groupBy("part", "window").agg(F.collect_set("id").alias("dead"))
        marked = found.join(dead, ["part", "window"], "left")
        left = F.filter(F.arrays_zip("ids", "tfs", "lengths"), lambda x: ~F.array_contains("dead", x["ids"]))
        live = marked.withColumn("x", F.when(F.col("dead").isNull(), F.arrays_zip("ids", "tfs", "lengths")).otherwise(left))
        return live.withColumns({"ids": F.col("x.ids"), "tfs": F.col("x.tfs"), "lengths": F.col("x.lengths"), "n": F.size("x")}).drop("x", "dead").where("n > 0")

    def _open(self, queries: DataFrame, k: int, kept: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame] | None:
        """Scored blocks (query_id, part, window, ids, tfs, lengths, idf), windows with their bounds, and those to be scored."""
        state = self.state()
        asked = queries.select("query_id", F.explode(F.array_distinct(X.terms(F.col("text")))).alias("term"))
        blocks = self._blocks(state, asked.select("term"))
        if blocks is None:
            return None
        mean = float(state["tokens"] / state["docs"]) or 1.0
        blocks = written(blocks, "blocks")
        holders = blocks.groupBy("term").agg(F.sum("n").alias("df"))
        idf = F.log(1 + (F.lit(float(state["docs"])) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weighted = asked.join(holders, "term").select("query_id", "term", idf.alias("idf"))
        hits = weighted.join(blocks, "term")
        most = gain(F.col("idf"), F.col("max_tf"), F.col("min_length"), mean)
        bounds = written(hits.groupBy("query_id", "part", "window").agg(F.sum(most).alias("most")), "bounds")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("most"), "part", "window"))
        seeds = bounds.withColumn("place", place).where(F.col("place") <= SEEDS)
        scored = self._scored(hits, seeds, mean, kept)
        least = scored.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("place") == k).select("query_id", F.col("score").alias("least"))
        # a bound is a sum in another order than a score, and scores are rounded: a margin for both
        chosen = bounds.join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("most") >= F.col("least") - 1e-6))
        return hits, bounds, chosen

    def _scored(self, hits: DataFrame, windows: DataFrame, mean: float, kept: DataFrame | None) -> DataFrame:
        near = hits.join(windows.select("query_id", "part", "window"), ["query_id", "part", "window"], "left_semi")
        rows = near.select("query_id", "idf", F.explode(F.arrays_zip("ids", "tfs", "lengths")).alias("x")).select("query_id", "idf", F.col("x.ids").alias("id"), F.col("x.tfs").alias("tf"), F.col("x.lengths").alias("length"))
        if kept is not None:
            rows = rows.join(kept, "id", "left_semi")
        return rows.groupBy("query_id", "id").agg(F.round(F.sum(gain(F.col("idf"), F.col("tf"), F.col("length"), mean)), 9).alias("score"))

    def search(self, queries: DataFrame, k: int = 20, kept: DataFrame | None = None) -> DataFrame:
        """queries (query_id, text) -> (query_id, id, score, rank), each query's best k, ties by id, as fulltext.search gives them.

        The windows of greatest bounds are scored first; of the others only those whose bound
        reaches the k-th best score so far are opened. kept: ids to which results are held.
        """
        opened = self._open(queries, k, kept)
        if opened is None:
            return self.spark.createDataFrame([], "query_id long, id long, score double, rank int")
        hits, _, chosen = opened
        state = self.state()
        scored = self._scored(hits, chosen, float(state["tokens"] / state["docs"]) or 1.0, kept)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        return scored.withColumn("rank", rank).where(F.col("rank") <= k)

    def pruned(self, queries: DataFrame, k: int = 20) -> DataFrame:
        """(query_id, windows, scored): windows that hold a term of a query, and those that search() scores."""
        hits, bounds, chosen = self._open(queries, k, None)
        return bounds.groupBy("query_id").agg(F.count("*").alias("windows")).join(chosen.groupBy("query_id").agg(F.count("*").alias("scored")), "query_id")
