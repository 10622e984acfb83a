"""Model boundaries with deterministic defaults: embedder, contradiction detector, summariser.

Each is a function of columns; runner.Model makes one of a model that is loaded in tasks, and it takes the same place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as X

from .runner import Model

DIMENSION = 64
#: Words whose places a worker keeps at most.
MOST_WORDS = 200_000
#: Characters of a document that a context function is given.
MAX_CONTEXT = 150_000


def bag_vector(text: str | None, dimension: int = DIMENSION) -> list[float]:
    """Hashed bag of lower-cased words at unit length; no words give the first axis. embed() in plain form."""
    v = np.zeros(dimension)
    for word in (text or "").lower().split():
        v[int.from_bytes(hashlib.md5(word.encode()).digest(), "big") % dimension] += 1
    norm = np.linalg.norm(v)
    if norm == 0:
        v[0] = norm = 1.0
    return (v / norm).astype(np.float32).tolist()


def _bags() -> Callable[[list[tuple]], list[np.ndarray]]:
    places: dict[str, int] = {}

    def work(rows: list[tuple]) -> list[np.ndarray]:
        words = [text.split() for (text,) in rows]
        if len(places) > MOST_WORDS:
            places.clear()
        for word in {w for some in words for w in some} - places.keys():
            places[word] = hashlib.md5(word.encode()).digest()[-1] % DIMENSION
        flat = np.fromiter((places[w] for some in words for w in some), np.int64)
        owner = np.repeat(np.arange(len(rows)), [len(some) for some in words])
        counts = np.bincount(owner * DIMENSION + flat, minlength=len(rows) * DIMENSION).reshape(-1, DIMENSION).astype(np.float64)
        norm = np.sqrt((counts * counts).sum(axis=1))
        counts[norm == 0, 0] = 1.0
        return list((counts / np.where(norm == 0, 1.0, norm)[:, None]).astype(np.float32))

    return work


#: The default embedder: counts of words by the last bits of their md5, at unit length; each distinct word of a batch is hashed once.
BAGS = Model(_bags, "array<float>", batch=1024)


def embed(text: Column | str) -> Column:
    """Vectors of texts by the default embedder. Null counts as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return BAGS(F.lower(F.coalesce(text, F.lit(""))))


TRIGGERS = ("not", "no longer", "instead", "replaced", "never")


def contradiction(prior: Column, newer: Column) -> Column:
    """Confidence that two facts disagree: 0.95 if just one of them holds a word of reversal, else 0."""
    has = lambda c: F.lower(c).rlike(r"\b(?:" + "|".join(TRIGGERS) + r")\b")
    return F.when(has(prior) != has(newer), 0.95).otherwise(0.0)


def extract_summary(texts: Column, longest: int = 200) -> Column:
    """First sentence of each text, joined and clamped."""
    first = F.transform(texts, lambda t: F.regexp_extract(t, r"(?s)^.*?[.!?](?=\s|$)|^.*$", 0))
    return F.substring(F.array_join(first, " "), 1, longest)


def summary_heading(headings: Column) -> Column:
    """The first three distinct headings; blank ones and those that only say that there is none do not count."""
    said = F.filter(headings, lambda h: h.isNotNull() & (h != "") & (h != "(no heading)"))
    joined = F.array_join(F.slice(F.array_distinct(said), 1, 3), " / ")
    return F.when(joined == "", "(cluster summary)").otherwise(joined)


def contextualised(chunks: DataFrame, documents: DataFrame, context: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """chunks (doc_path, text, …), documents (doc_path, text) -> chunks with a scrubbed line of context above each text.

    Off without a context function. context(document, chunk) gives a column; null or blank leaves a chunk as it is, and so does an
    error, as long as the function reports it as null, like try_ functions or a UDF that catches. Documents are clamped.
    """
    if context is None:
        return chunks
    whole = documents.select("doc_path", F.substring("text", 1, MAX_CONTEXT).alias("whole_text"))
    said = X.stripped(X.scrubbed(context(F.col("whole_text"), F.col("text"))))
    text = F.when(F.coalesce(said, F.lit("")) != "", F.concat(said, F.lit("\n\n"), "text")).otherwise(F.col("text"))
    return chunks.join(whole, "doc_path", "left").withColumn("text", text).select(*chunks.columns)


#: Tokens that a prompt may hold, and what is kept free beside the answer.
CONTEXT_WINDOW, SPARE, LEAST_PROMPT = 32_768, 512, 1024


def prompt_budget(reports: Column, existing: Column, max_new: int, update_frame: int, add_frame: int) -> Column:
    """Tokens of the new reports and of the existing note that a consolidation prompt takes, from the tokens of both.

    New reports come first; the existing note has what is left, and is given up where the reports
    alone leave no room for it. The frames are the tokens of the prompt without both.
    """
    most = max(LEAST_PROMPT, CONTEXT_WINDOW - max_new - SPARE)
    both = (existing > 0) & (reports <= most - update_frame)
    kept = F.when(both, F.least(existing, F.lit(most - update_frame) - reports)).otherwise(0)
    update = both & (kept > 0)
    taken = F.when(both & (kept > 0), reports).otherwise(F.least(reports, F.greatest(F.lit(most - add_frame), F.lit(0))))
    return F.struct(taken.alias("reports"), kept.alias("existing"), update.alias("update"))
