"""Query sets, evaluation results and their history as JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


RESULT = "hit_at_1 double, hit_at_3 double, hit_at_5 double, mrr double, text_match_at_1 double, total_queries long, score double, params map<string,string>, models struct<embedder: string, reranker: string>, mode string, timestamp string"


def read_query_set(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of {query, expected_file, expected_text_contains} -> (query_id, text, expected_file, expected_text); an absent text is empty."""
    rows = spark.read.schema("query string, expected_file string, expected_text_contains string").option("multiLine", True).json(path)
    number = F.row_number().over(Window.orderBy(F.monotonically_increasing_id()))  # a query set is one small file
    return rows.where("query is not null").select(number.cast("long").alias("query_id"), F.col("query").alias("text"), "expected_file", F.coalesce("expected_text_contains", F.lit("")).alias("expected_text"))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Result files under path, one JSON object each, with their file name; files that are no JSON object are left out."""
    shape = f"{RESULT}, broken string"
    rows = spark.read.schema(shape).options(multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="broken", pathGlobFilter="*.json").json(path)
    return rows.withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)).where("broken is null and (score is not null or timestamp is not null)").drop("broken")


def write_result(measured: DataFrame, path: str, timestamp: str, models: dict[str, str], params: dict[str, str], mode: str = "live") -> None:
    """A one-row result of curation.evaluated() as one JSON file of the history, named by its time."""
    texts = lambda pairs: F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]) if pairs else F.create_map().cast("map<string,string>")
    row = measured.select(
        *[F.col(f"hit_{k}").alias(f"hit_at_{k}") for k in (1, 3, 5)], "mrr", F.col("text_match_1").alias("text_match_at_1"), F.col("n").alias("total_queries"), F.col("composite").alias("score"),
        texts(params).alias("params"), F.struct(*[F.lit(v).alias(k) for k, v in models.items()]).alias("models"), F.lit(mode).alias("mode"), F.lit(timestamp).alias("timestamp"),
    )
    name = timestamp[:19].replace("-", "").replace(":", "").replace("T", "-").replace(" ", "-")
    row.coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}/{name}")


def newest(history: DataFrame, model: str = "") -> DataFrame:
    """Runs from the newest, of models whose names hold `model` in any case."""
    return matching(history, model).orderBy(F.desc("file"))


def best(history: DataFrame, model: str = "", n: int = 10) -> DataFrame:
    return matching(history, model).orderBy(F.desc("score"), "file").limit(n)


def last(history: DataFrame, n: int, model: str = "") -> DataFrame:
    """The last n runs, oldest of them first."""
    return matching(history, model).orderBy(F.desc("file")).limit(n).orderBy("file")


def matching(history: DataFrame, model: str) -> DataFrame:
    return history.where(F.lower(F.to_json("models")).contains(model.lower())) if model else history


def best_of_models(history: DataFrame) -> DataFrame:
    """The best run of each pair of models, the earlier of equal ones, from the best."""
    pair = F.concat_ws(" + ", F.coalesce("models.embedder", F.lit("?")), F.coalesce("models.reranker", F.lit("?")))
    place = F.row_number().over(Window.partitionBy("pair").orderBy(F.desc("score"), "file"))
    return history.withColumn("pair", pair).withColumn("place", place).where("place = 1").drop("place").orderBy(F.desc("score"), "pair")


def regressed(measured: DataFrame, least: float) -> bool:
    """Whether an evaluation falls below the gate."""
    return measured.where(F.col("composite") < least).count() > 0
