"""Tables, the knowledge rows made from documents, and scans of repositories and transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions import text as X

CHUNK_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("chunk_id", "doc_id", "doc_path")]
    + [T.StructField("tier", T.IntegerType()), T.StructField("parent_id", T.ArrayType(T.StringType())), T.StructField("cluster_id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("heading", T.StringType())]
    + [T.StructField(n, T.IntegerType()) for n in ("chunk_index", "char_start", "char_end", "token_count")]
    + [T.StructField("content_hash", T.StringType()), T.StructField("source_type", T.StringType()), T.StructField("retrieval_count", T.IntegerType()), T.StructField("created_at", T.TimestampNTZType()), T.StructField("authored_at", T.TimestampNTZType()), T.StructField("pipeline_version", T.StringType())]
)
#: Repository scan rules (fixed values).
KNOWLEDGE_DIRS = ("research", "docs", "machines", "playbooks")
SKIP_DIRS = (".git", "node_modules", "__pycache__", ".venv", "extracted", "raw", ".lancedb", ".models", ".claude", "eval", "build", "dist")
SKIP_FILES = ("README.md", "CONTRIBUTING.md", "CHANGELOG.md", "LICENSE.md", "TODO.md", "NEWS.md", "SCORECARD.md")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_path(source: Column, doc_id: Column) -> Column:
    """A path for a document of the fixture tables, by the number of its source."""
    n = F.regexp_extract(source, "([0-9]+)$", 1).cast("int") % 7
    tail = F.concat(F.lit("doc"), doc_id.cast("string"), F.lit(".md"))
    lead = F.when(n == 0, F.concat(F.lit("repos/"), source, F.lit("/research/sessions/")))
    for k, pattern in ((1, "vault/archive/{}/"), (2, "vault/library/{}/"), (3, "repos/{}/research/"), (4, "repos/{}/docs/"), (5, "vault/library/sessions/{}/")):
        before, after = pattern.split("{}")
        lead = lead.when(n == k, F.concat(F.lit(before), source, F.lit(after)))
    return F.concat(lead.otherwise(F.concat(F.lit("repos/"), source, F.lit("/notes/"))), tail)


def knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as knowledge rows: doc_id, doc_path, source_type, text, authored_at."""
    docs = table(spark, sf_dir, "documents")
    path = document_path(F.col("source"), F.col("doc_id"))
    authored = F.timestamp_add("HOUR", F.col("doc_id") % 10000, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    return docs.select("doc_id", path.alias("doc_path"), X.source_type(path).alias("source_type"), "text", authored.alias("authored_at"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings paired with the knowledge row of the same number: vec_id, embedding, source_type, authored_at, doc_path."""
    rows = knowledge(spark, sf_dir).select(F.col("doc_id").alias("vec_id"), "doc_path", "source_type", "authored_at")
    return table(spark, sf_dir, "embeddings").join(rows, "vec_id")


def scan_repositories(spark: SparkSession, root: str, base: str = "vault") -> DataFrame:
    """Markdown files of knowledge folders and root context files under root/<project>/: path, project, source_type, text, modified."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    inside = F.split(F.regexp_replace(F.col("path"), "^.*?" + "/".join(["", *root.strip("/").split("/")]) + "/", ""), "/")
    rows = files.withColumn("parts", inside).withColumn("name", F.element_at("parts", -1)).withColumn("project", F.get("parts", F.lit(0)))
    folders = F.slice("parts", 2, F.greatest(F.size("parts") - 2, F.lit(0)))
    context = (F.size("parts") == 2) & F.col("name").isin(*X.CONTEXT_FILES)
    knowledge_file = ~F.col("name").isin(*SKIP_FILES) & F.arrays_overlap(folders, F.array(*map(F.lit, KNOWLEDGE_DIRS))) & ~F.arrays_overlap(folders, F.array(*map(F.lit, SKIP_DIRS)))
    kept = rows.where((F.size("parts") >= 2) & ~F.col("project").startswith(".") & (context | knowledge_file))
    return kept.select(F.array_join("parts", "/").alias("path"), "project", X.source_type(F.col("path"), base).alias("source_type"), F.decode("content", "UTF-8").alias("text"), F.col("modificationTime").alias("modified"))


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """.md and .txt files as (path, text)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.where(F.lower("path").rlike(r"\.(md|txt)$")).select("path", F.decode("content", "UTF-8").alias("text"))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """JSONL session logs: file, line (to order by), type, session, cwd, branch, sidechain, texts, captured.

    A line that is no JSON object is skipped. message.content is a string or a list of
    blocks, of which the text blocks count; captured marks a use of a capture tool.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", "^\\x{FEFF}", "").alias("value"))
    # the parts of a split file come in the order of their first byte, and a part's lines in the order they are read
    lines = lines.select("file", F.struct("block", "id").alias("line"), "value")
    shape = "type string, sessionId string, cwd string, gitBranch string, isSidechain boolean, message struct<content: string>"
    parsed = lines.withColumn("j", F.from_json("value", shape, {"mode": "PERMISSIVE"})).where("j.type is not null or j.sessionId is not null")
    blocks = F.from_json("content", "array<struct<type:string,text:string,name:string>>")
    content = parsed.select("file", "line", "j.*", F.col("j.message.content").alias("content")).drop("message").withColumn("blocks", F.when(F.col("content").startswith("["), blocks))
    texts = F.when(F.col("blocks").isNull(), F.array_compact(F.array("content"))).otherwise(F.transform(F.filter("blocks", lambda b: (b["type"] == "text") & (b["text"] != "")), lambda b: b["text"]))
    captured = F.coalesce(F.exists("blocks", lambda b: (b["type"] == "tool_use") & b["name"].contains("capture_memory")), F.lit(False)) & (F.col("type") == "assistant")
    return content.select("file", "line", "type", F.col("sessionId").alias("session"), "cwd", F.col("gitBranch").alias("branch"), F.coalesce("isSidechain", F.lit(False)).alias("sidechain"), texts.alias("texts"), captured.alias("captured"))


def known_files(spark: SparkSession, repositories: str, base: str, name: str = "vault") -> DataFrame:
    """All files that the index should hold: scan_repositories() and the sessions of the shared lane under base."""
    scanned = scan_repositories(spark, repositories, name)
    lane = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter="*.md").load(base)
    inside = F.regexp_extract("path", r"/library/sessions/([^/]+)$", 1)
    path = F.concat(F.lit(f"{name}/library/sessions/"), "inside")
    shared = lane.withColumn("inside", inside).where("inside <> ''").select(path.alias("path"), F.lit("library").alias("project"), X.source_type(path, name).alias("source_type"), F.decode("content", "UTF-8").alias("text"), F.col("modificationTime").alias("modified"))
    return scanned.unionByName(shared)
