"""Quality rules combined by weak supervision.

Each rule votes good, bad or abstains. Expectation-maximisation over the counts of vote
patterns, taken over all documents, estimates how often each rule votes each way on good
and on bad documents; the verdict is the posterior probability of good, not a conjunction.
Everything on the data's path is a column expression; the driver sees one row per vote
pattern, of which there are at most 3 ** rules.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined_rows, stage, text_hash

WHITE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
GOOD, BAD, ABSTAIN = 1, 0, -1


def _ratio(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double")), F.lit(0.0))


def rules() -> dict[str, Column]:
    """The production rules over the columns of features(): a vote for bad or good where the rule applies, else abstention.

    A rule whose fault is absent abstains, for other faults may be present.
    """
    bad, good = (lambda test: F.when(test, BAD)), (lambda test: F.when(test, GOOD))
    symbols, capitals = _ratio("n_symbols", "n_words"), _ratio("n_capitals", "word_chars")
    exclaims, stops, repeats = _ratio("n_exclaims", "n_words"), _ratio("n_stops", "n_words"), _ratio("n_repeat_words", "n_words")
    votes = {
        "symbols": bad(symbols >= 0.08),
        "capitals": bad(capitals >= 0.15),
        "exclaims": bad(exclaims >= 0.08),
        "repeats": bad(repeats >= 0.35),
        "stutter": bad(_ratio("n_stutters", "n_words") >= 0.08),
        "same_lines": bad(_ratio("n_dup_lines", "n_lines") > 0.5),
        "few_sentences": bad((F.col("n_words") >= 200) & (stops < 0.01)),
        "odd_words": bad((_ratio("word_chars", "n_words") < 2.5) | (_ratio("word_chars", "n_words") > 12)),
        "prose": good((stops >= 0.03) & (capitals < 0.1) & (symbols < 0.05) & (exclaims < 0.05)),
        "varied": good((F.col("n_words") >= 50) & (repeats < 0.25)),
    }
    return {name: F.coalesce(vote, F.lit(ABSTAIN)).cast("int") for name, vote in votes.items()}


def _count_of(characters: str) -> Column:
    return F.length("text") - F.length(F.translate("text", characters, ""))


def features(docs: DataFrame, carried: Column | None = None) -> DataFrame:
    """documents -> doc_id, carried (null unless given), and the counts the rules read (long). Null text counts as empty."""
    carried = (F.lit(None) if carried is None else carried).alias("carried")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), carried, F.coalesce(F.col("text"), F.lit("")).alias("text"))
    split = base.select(
        "doc_id",
        "carried",
        F.filter(F.split("text", WHITE), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).alias("word_chars"),
        _count_of(SYMBOLS).alias("n_symbols"),
        _count_of("!").alias("n_exclaims"),
        (F.length("text") - F.length(F.regexp_replace("text", r"\p{Lu}", ""))).alias("n_capitals"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[.?!](?=\s|$)", ""))).alias("n_stops"),
    )
    # a lambda names "words" several times, which keeps Catalyst from folding the split into it
    windows = split.select(
        "*",
        F.sort_array(F.transform(F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0))), lambda w, i: F.struct(F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("i")))).alias("windows"),
        F.size(F.filter("words", lambda w, i: w == F.get("words", i - 1))).alias("n_stutters"),
        F.size("words").alias("n_words"),
    ).drop("words")
    repeated = windows.withColumn(
        "starts",
        F.sort_array(F.transform(F.filter("windows", lambda x, k: (x["h"] == F.get("windows", k - 1)["h"]) | (x["h"] == F.get("windows", k + 1)["h"])), lambda x: x["i"])),
    ).drop("windows")
    covered = F.aggregate(F.transform("starts", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("starts", k + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    counts = {
        "n_words": F.col("n_words"),
        "word_chars": F.col("word_chars"),
        "n_symbols": F.col("n_symbols"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": covered,
        "n_lines": F.size("lines"),
        "n_exclaims": F.col("n_exclaims"),
        "n_capitals": F.col("n_capitals"),
        "n_stops": F.col("n_stops"),
        "n_stutters": F.col("n_stutters"),
    }
    return repeated.select("doc_id", "carried", *[c.cast("long").alias(name) for name, c in counts.items()])


@dataclass(frozen=True)
class LabelModel:
    """prior of good, and for each rule the chance of each vote given good and given bad."""

    prior: float
    chances: list[dict[int, tuple[float, float]]]

    def posterior(self, votes: list[Column]) -> Column:
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for vote, chance in zip(votes, self.chances, strict=True):
            step = F.lit(0.0)
            for v, (good, bad) in chance.items():
                step = F.when(vote == v, F.lit(math.log(good / bad))).otherwise(step)
            odds = odds + step
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60, smoothing: float = 1.0) -> LabelModel:
    """EM over (votes, documents) counts; it starts from the share of good among the votes cast."""
    if not patterns:
        return LabelModel(0.5, [])
    n_rules = len(patterns[0][0])
    belief = []
    for votes, _ in patterns:
        good, bad = votes.count(GOOD), votes.count(BAD)
        belief.append((good + 1) / (good + 3 * bad + 2))
    prior, chances = 0.5, []
    for _ in range(rounds):
        total = sum(n for _, n in patterns)
        good_total = sum(p * n for p, (_, n) in zip(belief, patterns, strict=True))
        prior = (good_total + smoothing) / (total + 2 * smoothing)
        chances = []
        for j in range(n_rules):
            chance = {}
            for v in (GOOD, BAD, ABSTAIN):
                good = sum(p * n for p, (votes, n) in zip(belief, patterns, strict=True) if votes[j] == v)
                every = sum(n for votes, n in patterns if votes[j] == v)
                chance[v] = ((good + smoothing) / (good_total + 3 * smoothing), (every - good + smoothing) / (total - good_total + 3 * smoothing))
            chances.append(chance)
        before, belief = belief, []
        for votes, _ in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(c[v][0] / c[v][1]) for c, v in zip(chances, votes, strict=True))
            belief.append(1 / (1 + math.exp(-max(-700.0, min(700.0, odds)))))
        if max(abs(a - b) for a, b in zip(before, belief, strict=True)) < 1e-9:
            break
    return LabelModel(prior, chances)


def voted(docs: DataFrame, carried: Column | None = None) -> tuple[DataFrame, list[str]]:
    """features() with a vote column for each rule, and the names of those."""
    votes = {f"vote_{name}": vote for name, vote in rules().items()}
    return features(docs, carried).withColumns(votes), list(votes)


def fit_votes(counted: DataFrame, names: list[str]) -> LabelModel:
    """The label model of all rows' votes; one row per pattern of votes comes to the driver."""
    rows = counted.groupBy(*names).agg(F.count("*").alias("n")).orderBy(*names).collect()
    return fit([(tuple(row[name] for name in names), row["n"]) for row in rows])


def verdicts(counted: DataFrame, names: list[str], model: LabelModel, keep_from: float) -> DataFrame:
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    good = model.posterior([F.col(name) for name in names]) if model.chances else F.lit(0.5)
    scored = counted.withColumns({"base_failed": base_failed, "good_probability": good})
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("good_probability") >= keep_from))


def judge(docs: DataFrame, keep_from: float = 0.5) -> DataFrame:
    """documents -> (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, good_probability).

    base_failed: under 50 words, or over half of the words in 3-word windows found twice or
    more. kept: not base_failed and posterior of good >= keep_from. One row per input row:
    repeated rows are each judged, ties do not arise. Null and empty texts have no words and
    fail. An empty table gives an empty result. Windows are compared by a 64-bit hash of
    their words. Other columns are not looked at.
    """
    counted, names = voted(docs)
    counted = stage(counted.drop("carried"), "votes")
    scored = verdicts(counted, names, fit_votes(counted, names), keep_from)
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "good_probability")


def kept_documents(docs: DataFrame, keep_from: float = 0.5) -> DataFrame:
    """documents -> the rows that judge() keeps, columns as they were.

    Counts and votes are taken once and staged, without texts; the rows that fail are then
    dropped by doc_id and a hash of text. Null and empty texts go, rows equal in both are judged
    alike, an empty table stays empty, and columns of any name may be there.
    """
    counted, names = voted(docs, text_hash())
    counted = stage(counted, "votes")
    failed = verdicts(counted, names, fit_votes(counted, names), keep_from).where("not kept")
    return joined_rows(docs, stage(failed.select("doc_id", F.col("carried").alias("text_hash")).distinct(), "failed"), "left_anti")
