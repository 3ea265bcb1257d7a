"""Quality by hierarchical empirical Bayes: a text classifier's evidence on top of what is known of its site.

A logistic regression over counts of the text gives each document log odds. Sites form a tree (all, host, path): each level's
share of good documents is a Beta posterior whose prior is the level above, with a strength that the spread between sites sets
(method of moments, from grouped aggregates). A site with few documents keeps close to the level above, a large one speaks for
itself. A document's probability replaces the classifier's overall prior odds by those of its site, damped by SITE_WEIGHT.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.frames import staged, without
from tapeloom.llm.textstats import with_text_stats

MOST_LABELLED = 50_000      # labelled rows that the classifier is fitted on, the smallest hashes of their keys
RIDGE = 1e-2
NEWTON_ROUNDS = 30
SITE_WEIGHT = 0.5
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1_000.0
KEEP_AT = 0.5
HASH_BITS = 52              # of a hash that its slice leaves out: 4,096 slices
SLICE_BITS = 33             # of monotonically_increasing_id that number the rows of a partition
MOST_SENT_SITES = 20_000    # more paths or hosts than this are joined by a shuffle
FEATURE_STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_shouts", "n_pipes", "n_stops", "n_commas", "n_distinct_words")


def features() -> list[Column]:
    """Bounded ratios of a text's counts; all 0 for a text without words."""
    words, chars, lines = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1)), F.greatest("n_lines", F.lit(1))

    def share(part: str, whole: Column, most: float = 1.0) -> Column:
        return F.least(F.col(part) / whole, F.lit(most))

    return [F.log(F.col("n_words") + 1.0) / 5, F.least(F.col("n_words"), F.lit(10)) / 10, share("word_chars", words, 12.0) / 5, F.sqrt(share("n_symbols", words)), share("n_dup_lines", lines),
            share("n_repeat_words", words), F.sqrt(share("n_repeat_words", words)), share("n_upper", chars), share("n_digits", chars), F.sqrt(share("n_shouts", words)),
            F.sqrt(share("n_pipes", words)), F.sqrt(share("n_stops", words)), F.sqrt(share("n_commas", words)), share("n_distinct_words", words)]


def _stop(df: DataFrame, number: str, bits: int, most: int) -> tuple[int, int] | None:
    """The slice of numbers, which agree in all but their last bits, that holds row `most` in their order, and how many of its rows that takes."""
    for part, n in sorted(tuple(row) for row in df.groupBy(F.shiftright(number, bits)).count().collect()):
        if n >= most:
            return part, most
        most -= n
    return None


def _first_rows(df: DataFrame, key: str, most: int) -> DataFrame:
    """The rows with the smallest hashes of their keys, `most` at most, with their place as __at.

    A limit after a sort would bring `most` rows of every task to the driver, which here gets counts only: of the hashes by their first
    bits, which leave little more than the rows wanted, and of those, sorted and numbered, by slice. Equal rows can lie in several slices.
    """
    near = staged(df.withColumn("__hash", F.xxhash64(key)))
    if stop := _stop(near, "__hash", HASH_BITS, most):
        near = near.filter(F.shiftright("__hash", HASH_BITS) <= stop[0])
    ordered = near.withColumn("__tie", F.monotonically_increasing_id()).orderBy("__hash", key, "__tie").drop("__hash", "__tie")
    numbered = staged(ordered.withColumn("__at", F.monotonically_increasing_id()))
    if stop := _stop(numbered, "__at", SLICE_BITS, most):
        numbered = numbered.filter(F.col("__at") < (stop[0] << SLICE_BITS) + stop[1])
    return numbered


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the intercept. Without rows all weights are 0."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    if not len(x):
        return w
    penalty = np.full(len(w), RIDGE * len(x) / 1000 + 1e-6)
    penalty[-1] = 1e-6
    for _ in range(NEWTON_ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), slope)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _strength(sites: DataFrame, good: str, n: str, above: str) -> float:
    """Prior documents of a level: how much the sites' shares spread beyond chance, by moments."""
    p = F.col(above)
    row = sites.agg(F.sum(F.pow(F.col(good) - F.col(n) * p, 2)).alias("seen"), F.sum(F.col(n) * p * (1 - p)).alias("chance"),
                    F.sum(F.col(n) * (F.col(n) - 1) * p * (1 - p)).alias("pairs")).first()
    if not row["pairs"] or row["seen"] is None:
        return MOST_STRENGTH
    spread = max((row["seen"] - row["chance"]) / row["pairs"], 0.0)
    return min(max(1 / spread - 1 if spread > 0 else MOST_STRENGTH, LEAST_STRENGTH), MOST_STRENGTH)


def _sent(sites: DataFrame) -> DataFrame:
    """A staged side of a join: sent to all tasks if it has few rows, else joined by a shuffle, however small Spark takes either side for."""
    return F.broadcast(sites) if sites.count() <= MOST_SENT_SITES else sites.hint("merge")


def site_posteriors(scored: DataFrame) -> DataFrame:
    """host, path, p (posterior share of good documents of the path), p_all (of all): from the columns host, path and p_text."""
    paths = staged(scored.groupBy("host", "path").agg(F.sum("p_text").alias("good"), F.count(F.lit(1)).alias("n")))
    hosts = staged(paths.groupBy("host").agg(F.sum("good").alias("host_good"), F.sum("n").alias("host_n")))
    whole = hosts.agg(F.sum("host_good").alias("good"), F.sum("host_n").alias("n")).first()
    p_all = min(max((whole["good"] or 0.0) / whole["n"], 1e-3), 1 - 1e-3) if whole["n"] else 0.5
    hosts = hosts.withColumn("p_all", F.lit(p_all))
    a = _strength(hosts, "host_good", "host_n", "p_all")
    hosts = hosts.withColumn("p_host", (F.col("host_good") + a * p_all) / (F.col("host_n") + a))
    joined = paths.join(_sent(hosts.withColumnRenamed("host", "__host")), F.col("host").eqNullSafe(F.col("__host")))
    b = _strength(joined, "good", "n", "p_host")
    return joined.select("host", "path", ((F.col("good") + b * F.col("p_host")) / (F.col("n") + b)).alias("p"), "p_all")


def classify_quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, key: str = "doc_id", text: str = "text", label: str = "quality",
                     most_labelled: int = MOST_LABELLED, keep_at: float = KEEP_AT, with_text: bool = True) -> DataFrame:
    """Append p_text (classifier alone), p_site (posterior of its path), quality (both) and kept (boolean) to every row; the text goes
    if not wanted. Texts are counted once: the counted rows are staged between fit, sites and verdicts.

    `host` and `path` are columns of `docs` that place a document in its site; null is a site of its own. A null text has no
    words, and is judged by that. Labels of unknown documents, null labels and null keys don't count; without labels the text
    says nothing. Repeated rows get equal values; an empty table gives an empty result; columns of these names are replaced.
    """
    names = ["p_text", "p_site", "quality", "kept"]
    base = without(docs, names)
    counted = with_text_stats(base.withColumns({"__host": host, "__path": path}), text, FEATURE_STATS)
    counted = staged(counted if with_text else counted.drop(text))
    columns = [F.col(f"`{c}`") for c in base.columns if c.lower() not in FEATURE_STATS and (with_text or c != text)]
    known = labels.filter(F.col(label).isNotNull()).select(F.col(key).alias("__id"), F.col(label).cast("double").alias("__y")).dropDuplicates(["__id"])
    # By their files' size Spark would take labels or counts for a side to broadcast, however many rows they have.
    sample = counted.select(F.col(key).alias("__id"), F.array(*features()).alias("__x")).join(known.hint("merge"), "__id")
    rows = _first_rows(sample, "__id", most_labelled).select("__x", "__y", "__at").toArrow().sort_by("__at")
    x = rows["__x"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    weights = fit(x.reshape(rows.num_rows, len(features())), rows["__y"].to_numpy())
    score = F.lit(float(weights[-1]))
    for w, x in zip(weights[:-1], features(), strict=True):
        score = score + x * float(w)
    bounded = F.greatest(F.least(score, F.lit(12.0)), F.lit(-12.0))
    scored = counted.select(*columns, "__host", "__path", bounded.alias("__score")).withColumn("p_text", 1 / (1 + F.exp(-F.col("__score"))))
    sites = staged(site_posteriors(scored.select(F.col("__host").alias("host"), F.col("__path").alias("path"), "p_text")))
    sites = sites.select(*[F.col(c).alias(f"__site_{c}") for c in sites.columns])
    joined = scored.join(_sent(sites), F.col("__host").eqNullSafe(F.col("__site_host")) & F.col("__path").eqNullSafe(F.col("__site_path")))
    site, whole = F.col("__site_p"), F.col("__site_p_all")
    moved = F.col("__score") + SITE_WEIGHT * (F.log(site / (1 - site)) - F.log(whole / (1 - whole)))
    out = joined.withColumn("quality", 1 / (1 + F.exp(-moved)))
    return out.select(*columns, "p_text", site.alias("p_site"), "quality", (F.col("quality") >= keep_at).alias("kept"))
