"""Quality rules as weak supervision.

Each rule votes good (1), bad (-1) or abstains (0). Bad text is of several kinds, and a rule
that is sure of one kind says nothing of another, so votes depend on the kind. The label
model has a class for good text and one for each kind; expectation-maximisation over the
counts of vote patterns gives each rule's accuracy on each class and the classes' shares
without any label. The posterior probability of "good" replaces "passes every rule": rules
that speak of the same kind outvote one of them that errs, and a rule that is always right
needs no second.

Texts are read once. What is counted are vote patterns; only these are exchanged.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text_stats
from .common import TEXT_ROWS, table, with_batches, written


@dataclass(frozen=True)
class Rule:
    """``value`` is a SQL expression over the statistics; null abstains. ``kinds``: the kinds
    of bad text that it is meant to see."""

    name: str
    value: str
    good: str
    bad: str
    kinds: tuple[str, ...]


RULES = (
    Rule("symbols", "n_symbols / n_words", "v < 0.02", "v > 0.1", ("noise", "menus")),
    Rule("letters", "(n_upper + n_lower) / nullif(word_chars - n_digits, 0)", "v > 0.8", "v < 0.65", ("noise",)),
    Rule("letter_words", "n_letter_words / n_words", "v > 0.85", "v < 0.7", ("menus",)),
    Rule("repetition", "n_repeat_words / n_words", "v < 0.1", "v > 0.3", ("repetition",)),
    Rule("windows", "n_distinct_windows / nullif(n_words - 2, 0)", "v > 0.9", "v < 0.7", ("repetition",)),
    Rule("variety", "n_distinct_words / n_words", "v > 0.45", "v < 0.25", ("repetition",)),
    Rule("duplicate_lines", "n_dup_lines / n_lines", "v < 0.05 and n_lines > 2", "v > 0.3", ("repetition",)),
    Rule("capitals", "n_upper / nullif(n_upper + n_lower, 0)", "v < 0.1", "v > 0.3", ("shouting",)),
    Rule("exclamations", "n_exclaim / n_words", "v < 0.02", "v > 0.2", ("shouting",)),
    Rule("stops", "n_stops / n_words", "v between 0.02 and 0.2", "v < 0.005 or v > 0.4", ("shouting", "form")),
    Rule("line_ends", "n_stop_lines / n_lines", "v > 0.6", "v < 0.3", ("form",)),
    Rule("word_length", "word_chars / n_words", "v between 3.5 and 8", "v < 3 or v > 11", ("form",)),
    Rule("longest_word", "if(n_words > 0, longest_word, null)", "v < 40", "v > 100", ("form",)),
    Rule("digits", "n_digits / nullif(word_chars, 0)", "v < 0.05", "v > 0.25", ("form",)),
    Rule("line_length", "n_words / n_lines", "v > 8", "v < 3", ("form",)),
)
#: Votes that a prior counts for: (right, wrong) of a rule on good text, on a kind that it is
#: meant to see, and on another kind; and documents, good and bad. Data soon outweigh them.
ON_GOOD, ON_OWN, ON_OTHER, DOCUMENTS = (19.0, 1.0), (7.0, 3.0), (1.0, 9.0), (8.0, 2.0)


@dataclass(frozen=True)
class LabelModel:
    """Shares of good text and of each kind of bad text; each rule's accuracy, when it
    votes, on good text and on each kind."""

    shares: tuple[float, ...]
    on_good: tuple[float, ...]
    on_bad: tuple[tuple[float, ...], ...]

    def log_odds(self) -> list[tuple[float, list[tuple[float, float]]]]:
        """Of each kind against good text: by its share, and by a good and a bad vote of each rule."""
        return [
            (math.log(share / self.shares[0]), [(math.log((1 - b) / g), math.log(b / (1 - g))) for g, b in zip(self.on_good, bad, strict=True)])
            for share, bad in zip(self.shares[1:], self.on_bad, strict=True)
        ]


def votes(stats: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Adds ``votes``, an array of -1, 0 or 1, one for each rule. No words: all abstain."""
    def vote(r: Rule):
        value = f"({r.value.replace('n_words', 'nullif(n_words, 0)')})"
        good, bad = (f" {x}".replace(" v ", f" {value} ") for x in (r.good, r.bad))
        return F.expr(f"cast(case when n_words = 0 then 0 when {bad} then -1 when {good} then 1 else 0 end as tinyint)")

    return stats.withColumn("votes", F.array(*[vote(r) for r in rules]))


def kinds(rules: Sequence[Rule]) -> list[str]:
    return sorted({k for r in rules for k in r.kinds})


def fit(patterns: Mapping[tuple[int, ...], int], rules: Sequence[Rule] = RULES, rounds: int = 500) -> LabelModel:
    """Expectation-maximisation over counted vote patterns.

    It starts from the priors, which say what kinds a rule is meant to see and that most
    votes on good text are right; they count for a few votes each, so on a corpus of any
    size the accuracies are those of the data. Without patterns the priors are returned.
    """
    names = kinds(rules)
    own = np.array([[k in r.kinds for r in rules] for k in names])
    right, wrong = (np.where(own, ON_OWN[i], ON_OTHER[i]) for i in range(2))
    before = np.array([DOCUMENTS[0], *[DOCUMENTS[1] / len(names)] * len(names)])
    shares, good, bad = before / before.sum(), np.full(len(rules), ON_GOOD[0] / sum(ON_GOOD)), right / (right + wrong)
    if patterns:
        keys = sorted(patterns)
        v = np.array(keys, float).reshape(len(keys), len(rules))
        n = np.array([patterns[k] for k in keys], float)
        yes, no = (v > 0).astype(float), (v < 0).astype(float)
        last = -math.inf
        for _ in range(rounds):
            log = np.empty((len(v), len(names) + 1))
            log[:, 0] = math.log(shares[0]) + yes @ np.log(good) + no @ np.log(1 - good)
            log[:, 1:] = np.log(shares[1:]) + yes @ np.log(1 - bad).T + no @ np.log(bad).T
            top = log.max(1, keepdims=True)
            each = np.exp(log - top)
            total = each.sum(1, keepdims=True)
            likelihood = float(n @ (top + np.log(total)).ravel())
            w = each / total * n[:, None]
            shares = (w.sum(0) + before) / (n.sum() + before.sum())
            good = (w[:, 0] @ yes + ON_GOOD[0]) / (w[:, 0] @ (yes + no) + sum(ON_GOOD))
            bad = (w[:, 1:].T @ no + right) / (w[:, 1:].T @ (yes + no) + right + wrong)
            if abs(likelihood - last) <= 1e-10 * abs(likelihood):
                break
            last = likelihood
    plain = lambda x: tuple(float(round(a, 12)) for a in x)
    return LabelModel(plain(shares), plain(good), tuple(plain(x) for x in bad))


def estimate(voted: DataFrame, rules: Sequence[Rule] = RULES) -> LabelModel:
    """Fits the label model to all rows; what reaches the driver is one row per pattern, at
    most 3 ** rules and in practice some hundreds."""
    counts = voted.groupBy("votes").count().collect()
    return fit({tuple(int(x) for x in r["votes"]): r["count"] for r in counts}, rules)


def judge(voted: DataFrame, model: LabelModel, least_words: int = 50, threshold: float = 0.5) -> DataFrame:
    """Adds ``base_failed``, ``posterior`` and ``kept``.

    A document fails the base rules with fewer than ``least_words`` words, or if more than
    half of its words lie in repeated windows.
    """
    against = F.lit(0.0)
    for bias, weights in model.log_odds():
        odds = F.lit(bias)
        for i, (yes, no) in enumerate(weights):
            odds = odds + F.when(F.col("votes")[i] > 0, yes).when(F.col("votes")[i] < 0, no).otherwise(0.0)
        against = against + F.exp(odds)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = voted.withColumn("base_failed", failed).withColumn("posterior", 1 / (1 + against))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def score(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """Every column of ``docs`` with statistics, votes, posterior and ``kept``.

    Null or empty text: no words, so it fails. A repeated row is judged like its original.
    Columns of ``docs`` that share a name with a result are replaced. An empty table gives
    an empty table. Texts of any length count whole; a task holds one batch of them. The
    rows are written once with their statistics; model and result read that table.
    """
    voted = written(votes(with_batches(docs, text, text_stats.batch, text_stats.SCHEMA), rules), "votes", TEXT_ROWS)
    return judge(voted, estimate(voted, rules))


def filtered(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns alone; as ``score``."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    kept = score(docs.toDF(*names), text=names[docs.columns.index("text")]).where("kept").select(*names)
    return kept.toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: statistics are written once without texts; model and result read that table."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = with_batches(docs, "text", text_stats.batch, text_stats.SCHEMA).drop("text")
    voted = written(votes(stats), "votes", TEXT_ROWS)
    out = judge(voted, estimate(voted))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
