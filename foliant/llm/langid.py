"""Language of web pages by fusing text, declared language, address suffix and host.

The text model counts byte trigrams of labelled documents. Over all pages, grouped sums of
the text posterior then say how often each declared language and each address suffix goes
with each language, and what a host's pages are in; a host with few pages leans on its
registered domain, and that on all pages. A page's own share is taken out of every sum. The
four log terms add up, and a softmax over the languages gives the posterior. Sums have one row a
key, so a host with a third of all pages is one row of them; its pages are joined to that row by
broadcast, or by a sort-merge join whose large partitions AQE splits.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

BUCKETS = 1 << 14
#: Labels under which most countries that do so register names at the third level, and those of single countries (fixed values).
REGISTRIES = "ac co com edu gov mil net org".split()
OF_COUNTRIES = {"ar": "gob int", "at": "gv or", "au": "asn id", "bo": "gob", "cl": "gob", "es": "gob nom", "fr": "asso gouv nom tm", "hu": "info", "id": "go or web", "il": "muni", "it": "gov", "jp": "ad ed go gr lg ne or", "ke": "go ne or", "kr": "go ne or re", "mx": "gob", "nz": "gen iwi school", "pe": "gob nom", "pl": "info", "ro": "info nom", "th": "go in mi or", "tr": "bel gen web", "tz": "go ne or", "uk": "ltd me nhs plc police sch", "ve": "gob web", "za": "law nom school web"}
_SKIP = re.compile(r"<(script|style|noscript|template)\b.*?(?:</\1[^>]*>|\Z)|<!--.*?(?:-->|\Z)|<[^>]*(?:>|\Z)", re.S | re.I)


def trigram_counts(text: str) -> np.ndarray:
    """Counts of hashed byte trigrams of the lower-cased text, runs of anything but letters as one space."""
    data = " " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " "
    b = np.frombuffer(data.encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(BUCKETS, np.int64)
    mixed = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
    return np.bincount(mixed >> np.uint32(18), minlength=BUCKETS)


def visible_text(source: str) -> str:
    return html.unescape(_SKIP.sub(" ", source))


@dataclass(frozen=True)
class TextModel:
    languages: list[str]
    log_chance: np.ndarray  # languages x buckets

    def evidence(self, text: str, trust: int) -> list[float]:
        """Log likelihood of each language, of at most `trust` trigrams' weight, as trigrams of a text depend on each other."""
        counts = trigram_counts(text)
        used = np.flatnonzero(counts)
        total = counts[used].sum()
        return (self.log_chance[:, used] @ counts[used] * min(1.0, trust / max(total, 1))).tolist()


def fit_text_model(docs: DataFrame, per_language: int = 1000, smoothing: float = 0.5) -> TextModel:
    """From at most per_language documents of each lang, those with the least hash of doc_id; whole texts of them are counted."""
    known = docs.where("lang is not null and text is not null and doc_id is not null").select("doc_id", F.lower("lang").alias("lang"), "text")
    # the first of each of 64 parts of a language, and of those the first: no task sorts all documents of one
    order = (F.xxhash64("doc_id"), "doc_id")
    parts = known.select("doc_id", "lang", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(64)).alias("part")).distinct()
    some = parts.withColumn("n", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("n") <= per_language)
    chosen = some.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("n") <= per_language).select("doc_id", "lang")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                total[lang] = total.get(lang, 0) + trigram_counts(text)
        for lang, counts in total.items():
            used = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": lang, "bucket": used, "n": counts[used]})

    sample = known.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").select("lang", "text")
    rows = sample.mapInPandas(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r["lang"] for r in rows})
    counts = np.full((len(languages), BUCKETS), smoothing)
    for r in rows:
        counts[languages.index(r["lang"]), r["bucket"]] += r["n"]
    return TextModel(languages, np.log(counts / counts.sum(axis=1, keepdims=True)))


def _softmax(column: Column) -> Column:
    top = F.array_max(column)
    raised = F.transform(column, lambda x: F.exp(x - top))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def _added(*columns: Column) -> Column:
    total = columns[0]
    for c in columns[1:]:
        total = F.zip_with(total, c, lambda a, b: a + b)
    return total


#: The name that someone registered: under a registry's label, or under the suffix.
_DOMAIN = rf"[^.]+\.(?:(?:{'|'.join(REGISTRIES)})\.[a-z]{{2}}" + "".join(rf"|(?:{'|'.join(names.split())})\.{country}" for country, names in OF_COUNTRIES.items()) + r")$|[^.]+\.[^.]+$|^[^.]+$"


def page_evidence(pages: DataFrame, model: TextModel, trust: int) -> DataFrame:
    """pages -> staged page_id, url, host, domain, suffix, declared, text (log likelihoods), soft (their softmax)."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [shared.value.evidence(visible_text(x), trust) if x else [0.0] * len(shared.value.languages) for x in batch["html"]]
            yield batch.drop(columns="html").assign(page_id=batch["page_id"].astype("Int64"), text=text)

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]+)", 1))
    host = F.regexp_replace(host, r"\.$", "")
    number = host.rlike(r"^\[|^[0-9.]+$")  # an address in numbers has no domain above it
    known = F.array(*[F.lit(x) for x in model.languages])
    said = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html(?=\s)[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})\b", 1))
    cut = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        host.alias("host"),
        F.when(number, host).otherwise(F.regexp_extract(host, _DOMAIN, 0)).alias("domain"),
        F.when(number, "").otherwise(F.regexp_extract(host, r"([^.]*)$", 1)).alias("suffix"),
        F.when(said == "", "").when(F.array_contains(known, said), said).otherwise("other").alias("declared"),
        "html",
    )
    fields = "page_id long, url string, host string, domain string, suffix string, declared string, text array<double>"
    return stage(cut.mapInPandas(run, fields).withColumn("soft", _softmax(F.col("text"))), "evidence")


def _sums(evidence: DataFrame, key: str, name: str, n: int) -> DataFrame:
    """key -> soft counts of each language."""
    return evidence.groupBy(key).agg(F.array(*[F.sum(F.get("soft", F.lit(i))) for i in range(n)]).alias(name))


def page_languages(pages: DataFrame, docs: DataFrame, per_language: int = 1000, lean: float = 5.0, smoothing: float = 1.0, trust: int = 300) -> DataFrame:
    """pages, labelled documents -> (page_id, url, lang, probability, text_lang, declared), one row per page row.

    lang: the language of greatest posterior probability, the first by name on a tie.
    text_lang: the same from the text alone. declared: the primary language of <html lang>,
    '' if absent, 'other' if unknown to the model. A page without html or text is judged by
    the rest; without a host, '' is its host. Repeated rows stay. Without labelled documents
    lang is null. Other columns are not looked at.

    per_language: labelled documents read for each language at most, so a rare one is not
    crowded out; all pages are read whole. lean: pages that a host's domain, and a domain's prior over
    all pages, count for. smoothing: pages added to each count. trust: trigrams a page's text
    counts for at most, beyond which its likelihood is scaled down.
    """
    model = fit_text_model(docs, per_language)
    n = len(model.languages)
    if not n:
        return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("text_lang"), F.lit("").alias("declared"))
    evidence = page_evidence(pages, model, trust)
    overall = evidence.agg(*[F.sum(F.get("soft", F.lit(i))).alias(f"n{i}") for i in range(n)]).first()
    total = [float(x or 0.0) for x in overall]
    share = F.array(*[F.lit((x + smoothing) / (sum(total) + n * smoothing)) for x in total])
    by_language = F.array(*[F.lit(x) for x in total])

    def less_own(counts: Column | str) -> Column:
        return F.zip_with(counts, "soft", lambda a, b: F.greatest(a - b, F.lit(0.0)))

    def leaning(counts: Column, base: Column) -> Column:
        held = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)
        return F.zip_with(counts, base, lambda c, p: (c + lean * p) / (held + lean))

    def log_chance(counts: Column, of: Column, values: int) -> Column:
        return F.zip_with(counts, of, lambda a, b: F.log((a + smoothing) / (b + smoothing * values)))

    joined, reliable = evidence, []
    for key in ("declared", "suffix"):  # log chance of the key's value in each language
        sums = _sums(evidence, key, f"{key}_n", n)
        values = max(sums.count(), 1)
        joined = joined.join(sums, key)
        reliable.append(log_chance(less_own(f"{key}_n"), less_own(by_language), values))
    for key in ("domain", "host"):
        joined = joined.join(_sums(evidence, key, f"{key}_n", n), key)
    priors = joined.withColumn("domain_p", leaning(less_own("domain_n"), share)).withColumn("host_p", leaning(less_own("host_n"), F.col("domain_p")))
    posterior = _softmax(_added(F.col("text"), *reliable, F.transform("host_p", lambda p: F.log(p))))
    names = F.array(*[F.lit(x) for x in model.languages])

    def best(column: str) -> Column:
        return F.get(names, (F.array_position(column, F.array_max(column)) - 1).cast("int"))

    return priors.withColumn("posterior", posterior).select("page_id", "url", best("posterior").alias("lang"), F.array_max("posterior").alias("probability"), best("soft").alias("text_lang"), "declared")
