"""Quality rules that vote or abstain, with accuracies estimated by expectation-maximisation.

Each rule looks at a text's counts and votes good (1), bad (-1) or abstains (0). Texts are counted by vote pattern (at most
3 ** rules rows, whatever the corpus size); expectation-maximisation over the patterns estimates how often each rule
is right on good and on bad texts and how common good texts are, and a text's posterior probability of being good replaces all-must-pass filtering.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.frames import staged, without
from tapeloom.llm.textstats import STATS, with_text_stats

START_ACCURACY = 0.95
START_GOOD = 0.8
PSEUDO_COUNT = 4.0
ROUNDS = 60
TOLERANCE = 1e-9
KEEP_AT = 0.5

Votes = dict[str, Column]


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def rules() -> Votes:
    """The rules, by name; each sees only the columns of `textstats`."""
    bad, good, none = F.lit(-1), F.lit(1), F.lit(0)
    mean_length = _share("word_chars", "n_words")
    symbols, shouts, pipes = _share("n_symbols", "n_words"), _share("n_shouts", "n_words"), _share("n_pipes", "n_words")
    capitals, repeats, copies = _share("n_upper", "word_chars"), _share("n_repeat_words", "n_words"), _share("n_dup_lines", "n_lines")
    stops, distinct = _share("n_stops", "n_words"), _share("n_distinct_words", "n_words")
    return {
        "word_length": F.when((mean_length < 2.5) | (mean_length > 14), bad).when(mean_length.between(3.5, 9) & (symbols < 0.02) & (capitals < 0.15), good).otherwise(none),
        "symbols": F.when(symbols > 0.1, bad).otherwise(none),
        "shouting": F.when((shouts > 0.1) | (capitals > 0.4), bad).otherwise(none),
        "table_remains": F.when(pipes > 0.1, bad).otherwise(none),
        "repeated_lines": F.when((copies > 0.3) & (F.col("n_dup_lines") >= 3), bad).otherwise(none),
        "repeated_windows": F.when(repeats > 0.18, bad).otherwise(none),
        "sentences": F.when((stops == 0) & (F.col("n_words") >= 30), bad).when(stops.between(0.01, 0.5) & (shouts < 0.02) & (pipes < 0.02) & (symbols < 0.02), good).otherwise(none),
        "shape": F.when((symbols < 0.02) & (capitals.between(0.002, 0.15)) & (copies < 0.1), good).otherwise(none),
        "vocabulary": F.when((distinct < 0.6) & (F.col("n_words") <= 60) | (distinct < 0.2) & (F.col("n_words") <= 2000), bad).otherwise(none),
        "length": F.when(F.col("n_words") < 5, bad).otherwise(none),
    }


def start_posterior(votes) -> float:
    """Before any estimate: one objection outweighs all approval; silence says nothing."""
    return START_GOOD if not any(votes) else 1 - START_ACCURACY if min(votes) < 0 else START_ACCURACY


def estimate(patterns: list[tuple[tuple[int, ...], int]], n_rules: int) -> tuple[list[dict[int, float]], float]:
    """Weights of the votes, and log odds of a good text before any vote, from (votes, texts) pairs.

    Every rule has, for good and for bad texts, a rate of each of its votes (good, bad, abstain); the rates and the share of good
    texts are re-estimated from the posteriors until they settle. A vote's weight is the log ratio of its two rates, so what a
    rule's silence says is learned too. Pseudo-counts keep votes never seen at weight near 0; no patterns leave the start.
    """
    belief = [start_posterior(votes) for votes, _ in patterns]
    weights, odds = [{-1: 0.0, 0: 0.0, 1: 0.0} for _ in range(n_rules)], math.log(START_GOOD / (1 - START_GOOD))
    for _ in range(ROUNDS if patterns else 0):
        good = sum(p * count for p, (_, count) in zip(belief, patterns, strict=True))
        bad = sum((1 - p) * count for p, (_, count) in zip(belief, patterns, strict=True))
        odds = math.log((good + PSEUDO_COUNT * START_GOOD) / (bad + PSEUDO_COUNT * (1 - START_GOOD)))
        for j, rule in enumerate(weights):
            for vote in rule:
                in_good = sum(p * count for p, (votes, count) in zip(belief, patterns, strict=True) if votes[j] == vote)
                in_bad = sum((1 - p) * count for p, (votes, count) in zip(belief, patterns, strict=True) if votes[j] == vote)
                rule[vote] = math.log((in_good + 1) / (good + 3)) - math.log((in_bad + 1) / (bad + 3))
        new = [posterior(votes, weights, odds) for votes, _ in patterns]
        moved, belief = max(abs(a - b) for a, b in zip(new, belief, strict=True)), new
        if moved < TOLERANCE:
            break
    return weights, odds


def posterior(votes, weights: list[dict[int, float]], odds: float) -> float:
    """Probability that a text with these votes is good."""
    score = odds + sum(rule[vote] for rule, vote in zip(weights, votes, strict=True))
    return 1 / (1 + math.exp(-min(max(score, -500), 500)))


def judge_quality(docs: DataFrame, text: str = "text", votes: Votes | None = None, keep_at: float = KEEP_AT, with_text: bool = True) -> DataFrame:
    """Append the text counts, `base_failed`, `quality_probability` (double) and `kept` (boolean) to every row; the text goes if not wanted.

    Texts are judged whole, and counted once: the counted rows are staged between the estimate and the verdicts. base_failed: fewer than 10 words, or more than 20 % of the words in repeated windows. kept: not
    base_failed, and a posterior of at least `keep_at`. A null or empty text has no words and is not kept; equal rows get
    equal verdicts; an empty table gives an empty result; columns that already carry one of the names are replaced.
    """
    votes = votes or rules()
    columns = docs.columns if with_text else [c for c in docs.columns if c != text]
    counted = with_text_stats(docs, text)
    counted = staged(counted if with_text else counted.drop(text))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    names = [f"__vote_{name}" for name in votes]
    voted = counted.select("*", *[column.cast("int").alias(name) for name, column in zip(names, votes.values(), strict=True)], base.alias("__failed"))
    # Patterns of votes are few, so each map task sends few rows.
    seen = voted.groupBy(*names).count().collect()
    weights, odds = estimate(sorted((tuple(row[:-1]), row[-1]) for row in seen), len(names))
    score = F.lit(odds)
    for name, rule in zip(names, weights, strict=True):
        score = score + F.when(F.col(name) < 0, rule[-1]).when(F.col(name) > 0, rule[1]).otherwise(rule[0])
    probability = 1 / (1 + F.exp(-score))
    out = without(voted, ["base_failed", "quality_probability", "kept"])
    out = out.withColumns({"base_failed": F.col("__failed"), "quality_probability": probability})
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("quality_probability") >= keep_at))
    own = [*STATS, "base_failed", "quality_probability", "kept"]
    return out.select(*[F.col(f"`{c}`") for c in columns if c.lower() not in own], *own)
