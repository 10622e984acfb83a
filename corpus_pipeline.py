"""From raw documents to packed training sequences, in five stages.

Each stage takes the documents its predecessor kept, as a table with the columns of
documents, and returns them filtered or rewritten; the last returns the packed pieces. All take
nulls in any column, repeated rows and ids, empty tables and columns of any name; what becomes of
them is said at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm.common import discard, stage
from foliant.llm.decontaminate import clean_documents
from foliant.llm.packing import pack
from foliant.llm.queries import table, tokenizer_path
from foliant.llm.rules import kept_documents
from foliant.llm.simhash import without_near_duplicates
from foliant.llm.suffixes import without_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the rules' label model, or the base rules, reject: null and short texts among them. Repeated rows are judged alike."""
    return kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of SimHash near-duplicates, that of the least doc_id, null ids last; of equal rows one. Unlike texts of one id all stay."""
    return without_near_duplicates(docs, one_text_per_id=False)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of over 50 words that another document keeps. No row goes; null texts stay null, equal rows are cut alike."""
    return without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold passages of the benchmark. Null and empty texts are clean; without a benchmark all stay."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 4096 ids, repeated rows each; a null text is its end id."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL cannot express these stages; tests/llm hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next reads it, and deleted when the one after it is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "_"))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
