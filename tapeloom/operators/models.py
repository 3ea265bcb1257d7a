"""Walk-forward models: boosted trees of all folds, horizons and feature groups, fitted together.

Every variant (a target, a feature list, a fold table) times every fold is one model of `boosting.fit_models`. Rows are binned once
and meet the folds by a broadcast of the fold table.
"""
from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.operators import boosting
from tapeloom.operators.boosting import Settings
from tapeloom.operators.evaluation import sized_folds
from tapeloom.session import staged

META_FEATURES = ("atr_pct", "std_5", "std_10", "std_20", "std_60", "vma_20", "cmf_20d", "volume_surge_20d")
EVENT_FEATURES = ("surprise_pct", "prev_surprise_pct", "surprise_acceleration", "pre_ret_1m_vs_spy", "pre_ret_3m_vs_spy", "atr_pct",
                  "high_52w_proximity", "revenue_growth", "profit_margin", "roe", "fcf_yield", "piotroski_score")
# Trees, depth, rate, row and column samples and least child weight of each model.
RETURN = Settings(trees=400, depth=4, rate=0.04, rows=0.8, columns=0.8)
OUTCOME = Settings(trees=300, depth=4, rate=0.05, rows=0.8, columns=0.7, least_weight=30.0, logistic=True)
META = Settings(trees=400, depth=4, rate=0.04, rows=0.8, columns=0.8, logistic=True)
EVENT = Settings(trees=300, depth=4, rate=0.05, rows=0.8, columns=0.8, logistic=True)

FOLDS_APART = 100_000       # model number: variant * FOLDS_APART + fold


@dataclass(frozen=True)
class Variant:
    """A family of fold models: folds (fold, train_start, train_end, test_start, test_end), target column, features, how trees
    grow, and the fewest train and test rows of a fold."""
    folds: DataFrame
    target: str
    features: tuple[str, ...]
    settings: Settings
    least: tuple[int, int]


def binned(rows: DataFrame, features, name: list[str], keep: list[str]) -> DataFrame:
    """keep columns, the row's name as a long, and binned features; staged once, for all models."""
    rows = rows.select("*", F.xxhash64(*[F.col(c).cast("string") for c in name]).alias("row"))
    return staged(boosting.with_bins(rows, list(features), boosting.bin_edges(rows, list(features)), [*keep, "row"]))


def fold_plan(data: DataFrame, variants: list[Variant], date: str = "date") -> list:
    """The folds of every variant that hold enough rows with a target: one row per model."""
    plan = []
    for number, variant in enumerate(variants):
        known = data.filter(F.col(variant.target).isNotNull()).withColumn("date", F.col(date))
        for r in sized_folds(known, variant.folds, *variant.least).orderBy("fold").collect():       # one row per quarter
            plan.append((number * FOLDS_APART + r.fold, number, r.fold, r.train_start, r.train_end, r.test_start, r.test_end, r.n_train, r.n_test))
    return plan


def _weighted(training: DataFrame, settings: list[Settings]) -> DataFrame:
    """Rows of a 1 in a classifier weigh max(zeros / ones, 0.5), all others 1."""
    if not any(s.logistic for s in settings):
        return training.withColumn("w", F.lit(1.0))
    counts = training.groupBy("model", "variant").agg(F.count_if(F.col("y") == 0).alias("n"), F.count_if(F.col("y") == 1).alias("p"))
    logistic = F.element_at(F.array(*[F.lit(s.logistic) for s in settings]), F.col("variant") + 1)
    ratio = counts.select("model", F.when(logistic, F.greatest(F.col("n") / F.greatest(F.col("p"), F.lit(1)), F.lit(0.5))).otherwise(1.0).alias("ratio"))
    return training.join(F.broadcast(ratio), "model").withColumn("w", F.when(F.col("y") == 1, F.col("ratio")).otherwise(1.0))   # one row per model


def walk_forward(data: DataFrame, features, variants: list[Variant], keep: list[str], date: str = "date", held: int = boosting.HELD_ROWS) -> DataFrame:
    """variant, fold, keep, y and the margin of every test row, from the model of its fold.

    `data` comes from `binned` over `features`. Train rows are those dated in the fold's train span, test rows those in its test
    span; rows without the variant's target are neither.
    """
    spark = data.sparkSession
    plan = fold_plan(data, variants, date)
    columns = "model int, variant int, fold int, train_start date, train_end date, test_start date, test_end date, n_train long, n_test long"
    table = F.broadcast(spark.createDataFrame(plan, columns))       # one row per model
    target = F.coalesce(*[F.when(F.col("variant") == i, F.col(v.target).cast("double")) for i, v in enumerate(variants)])

    def part(start: str, end: str) -> DataFrame:
        return data.join(table, F.col(date).between(F.col(start), F.col(end))).withColumn("y", target).filter("y IS NOT NULL")
    training = _weighted(part("train_start", "train_end"), [v.settings for v in variants]).select("model", "row", "y", "w", "bins")
    place = {c: i for i, c in enumerate(features)}
    used = {m: [place[c] for c in variants[v].features] for m, v, *_ in plan}
    settings = {m: variants[v].settings for m, v, *_ in plan}
    models = boosting.fit_models(training, used, settings, held)
    tests = part("test_start", "test_end").select("model", "variant", "fold", *keep, "y", "bins")
    return boosting.predict(tests, models).drop("model")


def walk_forward_returns(rows: DataFrame, folds: DataFrame, features, trees: int = RETURN.trees, least: tuple[int, int] = (2000, 200), target: str = "fwd_return") -> DataFrame:
    """Out-of-sample predictions of every fold."""
    data = binned(rows.select("ticker", "date", "close", target, *features), features, ["ticker", "date"], ["ticker", "date", "close", target])
    variant = Variant(folds, target, tuple(features), replace(RETURN, trees=trees), least)
    out = walk_forward(data, features, [variant], ["ticker", "date", "close"])
    return out.select("fold", "ticker", "date", "close", F.col("y").alias(target), F.col("margin").alias("pred_return"))


def probability(margin: str = "margin"):
    return 1 / (1 + F.exp(-F.col(margin)))


def walk_forward_classes(rows: DataFrame, folds: DataFrame, features, label: str, settings: Settings = OUTCOME, least: tuple[int, int] = (200, 30), keep=()) -> DataFrame:
    """Out-of-sample class probabilities of every fold."""
    kept = ["ticker", "date", *keep]
    data = binned(rows.select(*kept, label, *features), features, ["ticker", "date"], [*kept, label])
    out = walk_forward(data, features, [Variant(folds, label, tuple(features), settings, least)], kept)
    return out.select("fold", "ticker", "date", F.col("y").cast("int").alias(label), *keep, probability().alias("prob"))


def walk_forward_events(events: DataFrame, years: DataFrame, trees: int = EVENT.trees, least: tuple[int, int] = (50, 10)) -> DataFrame:
    """Yearly folds: train on all earlier events, score the year's."""
    kept = ["ticker", "earnings_date", "label", "relative_ret_30d"]
    data = binned(events.select(*kept, "label_binary", *EVENT_FEATURES), EVENT_FEATURES, ["ticker", "earnings_date"], [*kept, "label_binary"])
    start = F.make_date("year", F.lit(1), F.lit(1))
    folds = years.select(F.col("year").alias("fold"), F.lit("0001-01-01").cast("date").alias("train_start"), F.date_sub(start, 1).alias("train_end"),
                         start.alias("test_start"), F.make_date("year", F.lit(12), F.lit(31)).alias("test_end"))
    out = walk_forward(data, EVENT_FEATURES, [Variant(folds, "label_binary", EVENT_FEATURES, replace(EVENT, trees=trees), least)], kept, "earnings_date")
    return out.select(F.col("fold").alias("year"), *kept, F.col("y").cast("int").alias("label_binary"), probability().alias("prob"))


def _fit_all(data: DataFrame, features, target: str, settings: Settings) -> DataFrame:
    training = data.filter(F.col(target).isNotNull()).select(F.lit(0).alias("model"), "row", F.col(target).cast("double").alias("y"), F.lit(1.0).alias("w"), "bins")
    return boosting.fit_models(training, {0: list(range(len(features)))}, {0: settings})


def fit_and_score(rows: DataFrame, features, target: str = "fwd_return", trees: int = RETURN.trees) -> DataFrame:
    """Fit on all rows that have a target and score the newest row of each ticker."""
    data = binned(rows.select("ticker", "date", target, *features), features, ["ticker", "date"], ["ticker", "date", target])
    models = _fit_all(data, features, target, replace(RETURN, trees=trees))
    latest = data.groupBy("ticker").agg(F.max_by(F.struct("date", "bins"), "date").alias("newest")).select(F.lit(0).alias("model"), "ticker", "newest.date", "newest.bins")
    return boosting.predict(latest, models, "pred_return").drop("model")


def feature_importance(rows: DataFrame, features, target: str = "fwd_return", trees: int = RETURN.trees, top: int | None = None) -> DataFrame:
    """Features by mean absolute Shapley value over all rows that have a target; `top` keeps the first."""
    data = binned(rows.select("ticker", "date", target, *features), features, ["ticker", "date"], ["ticker", "date", target])
    models = _fit_all(data, features, target, replace(RETURN, trees=trees))
    ranked = boosting.mean_attributions(data.filter(F.col(target).isNotNull()).withColumn("model", F.lit(0)), models, list(features))
    ordered = ranked.select("feature", "importance").orderBy(F.desc("importance"), "feature")
    return ordered.limit(top) if top else ordered
