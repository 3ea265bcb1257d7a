"""Histogram boosting against brute force; both ways of growing; attributions against subset enumeration."""
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import boosting as bo
from tapeloom.operators import evaluation as ev
from tapeloom.operators import models as md
from tapeloom.operators.boosting import Settings

RNG = np.random.default_rng(11)


def sample(n=240, features=5, levels=12):
    bins = RNG.integers(0, levels, (n, features)).astype(np.uint8)
    y = (bins[:, 0] > 5) * 2.0 + (bins[:, 1] > bins[:, 2]) * 1.0 + RNG.integers(-1, 2, n)
    return bins, y


def brute_split(bins, rows, g, h, columns, settings):
    best = (bo.LEAST_GAIN, None, None)
    for f in columns:
        for cut in range(256):
            left = rows & (bins[:, f] <= cut)
            right = rows & (bins[:, f] > cut)
            if h[left].sum() < settings.least_weight or h[right].sum() < settings.least_weight:
                continue
            def score(part):
                return g[part].sum() ** 2 / (h[part].sum() + settings.penalty)
            gain = score(left) + score(right) - score(rows)
            if gain > best[0] + 1e-9:
                best = (gain, f, cut)
    return best


@pytest.mark.parametrize("logistic", [False, True])
def test_every_split_equals_brute_force(logistic):
    bins, y = sample()
    y = (y > 1).astype(float) if logistic else y
    w = np.where(y == 1, 1.5, 1.0) if logistic else np.ones(len(y))
    settings = Settings(trees=3, depth=3, rate=0.3, rows=0.8, columns=0.8, least_weight=2.0, logistic=logistic)
    rows = np.arange(len(y)) * 7919 - 500
    model = bo.fit_held(bins, y, w, rows, np.arange(5), settings)
    margin = np.full(len(y), model.base)
    for t in range(3):
        g, h = bo._derivatives(margin, y, w, settings)
        drawn = bo._row_sample(rows, t, settings)
        assert 0.6 < drawn.mean() < 0.95
        columns = bo.column_sample(np.arange(5), t, settings)
        assert len(columns) == 4
        where = {0: drawn}
        for node in range(7):
            here = where[node]
            gain, f, cut = brute_split(bins, here, g, h, columns, settings) if here.any() else (0, None, None)
            assert model.features[t, node] == (-1 if f is None else f)
            if f is not None:
                assert model.bins[t, node] == cut
            right = np.zeros(len(y), dtype=bool) if f is None else bins[:, f] > cut
            where[2 * node + 1], where[2 * node + 2] = here & ~right, here & right
        for leaf in range(8):
            mine = where[7 + leaf]
            assert np.isclose(model.leaves[t, leaf], -settings.rate * g[mine].sum() / (h[mine].sum() + 1.0))
        margin = margin + bo.margins(bo.Ensemble(0.0, *(x[t:t + 1] for x in (model.features, model.bins, model.leaves, model.covers))), bins)
    assert np.allclose(margin, model.base + bo.margins(model, bins))


def test_both_ways_of_growing_fit_the_same_trees(spark, monkeypatch):
    monkeypatch.setattr(bo, "KEPT_TREES", 2)
    rows = []
    for m in (3, 8):
        bins, y = sample(120)
        rows += [(m, int(i) * 31 - 9, float(v > 1) if m == 8 else float(v), 1.0, bytes(b)) for i, (b, v) in enumerate(zip(bins, y))]
    training = spark.createDataFrame(rows, "model int, row long, y double, w double, bins binary").repartition(3)
    settings = {3: Settings(trees=3, depth=2, rate=0.5), 8: Settings(trees=3, depth=2, rate=0.5, logistic=True)}
    features = {3: [0, 1, 2, 3, 4], 8: [0, 2, 4]}
    held = bo.ensembles(bo.fit_models(training, features, settings))
    spread = bo.ensembles(bo.fit_models(training, features, settings, held=10))
    assert set(held) == set(spread) == {3, 8}
    for m in held:
        assert (held[m].features == spread[m].features).all() and (held[m].bins == spread[m].bins).all()
        assert np.allclose(held[m].leaves, spread[m].leaves) and np.allclose(held[m].covers, spread[m].covers)
    assert set(held[8].features.ravel().tolist()) <= {-1, 0, 2, 4}


def _expected(model, t, bins, known):
    """A tree's expectation when only some features are known."""
    def walk(node):
        if node >= model.features.shape[1]:
            return model.leaves[t, node - model.features.shape[1]]
        f = model.features[t, node]
        if f < 0:
            return walk(2 * node + 1)
        if f in known:
            return walk(2 * node + 2 if bins[f] > model.bins[t, node] else 2 * node + 1)
        whole = model.covers[t, node]
        return sum(model.covers[t, c] / whole * walk(c) for c in (2 * node + 1, 2 * node + 2))
    return walk(0)


def test_attributions_equal_subset_enumeration_and_add_up():
    bins, y = sample(200, 3, 6)
    model = bo.fit_held(bins, y, np.ones(len(y)), np.arange(200), np.arange(3), Settings(trees=6, depth=4, rate=0.3, columns=1.0))
    got, start = bo.attributions(model, bins, 3)
    assert np.allclose(start + got.sum(axis=1), model.base + bo.margins(model, bins))
    for row in range(0, 200, 25):
        for f in range(3):
            others = [x for x in range(3) if x != f]
            want = 0.0
            for k in range(3):
                for subset in combinations(others, k):
                    weight = factorial(k) * factorial(2 - k) / factorial(3)
                    want += weight * sum(_expected(model, t, bins[row], {*subset, f}) - _expected(model, t, bins[row], set(subset)) for t in range(6))
            assert np.isclose(got[row, f], want)


def _panel(spark, days=420, tickers=30):
    rows = spark.range(days).crossJoin(spark.range(tickers).withColumnRenamed("id", "k"))
    noise = F.pmod(F.xxhash64("id", "k"), F.lit(1000)) / 1000.0
    return rows.select(F.format_string("T%02d", "k").alias("ticker"), F.date_add(F.lit("2014-06-01").cast("date"), F.col("id").cast("int") * 3).alias("date"), F.lit(1.0).alias("close"),
                       noise.alias("ma_5"), F.when(F.col("k") % 5 == 0, None).otherwise(F.pmod(F.xxhash64("k", "id"), F.lit(100)) / 100.0).alias("roc_5"),
                       F.when(F.col("id") < days - 5, (noise - 0.5) * 0.1).alias("fwd_return"))


def test_walk_forward_predicts_only_ahead(spark):
    rows = _panel(spark).cache()
    folds = ev.quarterly_folds(rows, "2015-01-01", embargo=5)
    out = md.walk_forward_returns(rows, folds, ("ma_5", "roc_5"), trees=40, least=(2000, 200)).cache()
    known = rows.filter("fwd_return IS NOT NULL")
    sized = {r.fold: r for r in ev.sized_folds(known, folds, 2000, 200).collect()}
    got = {r.fold: r for r in out.groupBy("fold").agg(F.count("*").alias("n"), F.min("date").alias("lo"), F.max("date").alias("hi"), F.corr("pred_return", "fwd_return").alias("rho")).collect()}
    assert set(got) == set(sized) and len(got) >= 3
    for fold, r in got.items():
        assert r.n == sized[fold].n_test and sized[fold].test_start <= r.lo <= r.hi <= sized[fold].test_end and r.rho > 0.8
    # A target that is altered from a fold's embargo on changes none of its predictions.
    fold = sized[min(sized)]
    changed = rows.withColumn("fwd_return", F.when(F.col("date") > F.lit(fold.train_end), -F.col("fwd_return")).otherwise(F.col("fwd_return")))
    again = md.walk_forward_returns(changed, folds.filter(F.col("fold") == fold.fold), ("ma_5", "roc_5"), trees=40)
    both = out.filter(F.col("fold") == fold.fold).join(again.select("ticker", "date", F.col("pred_return").alias("again")), ["ticker", "date"])
    assert both.filter(F.abs(F.col("pred_return") - F.col("again")) > 1e-12).isEmpty() and both.count() == fold.n_test


def test_classifier_weighs_classes_and_ranks_features(spark):
    rows = _panel(spark).filter("fwd_return IS NOT NULL").withColumn("label", (F.col("ma_5") > 0.8).cast("int"))
    folds = ev.quarterly_folds(rows, "2015-01-01", embargo=5)
    out = md.walk_forward_classes(rows, folds, ("ma_5", "roc_5"), "label", md.Settings(trees=30, rate=0.3, logistic=True))
    metrics = ev.classification_metrics(out, "label", "prob").first()
    assert metrics.auc > 0.98 and metrics.accuracy > 0.95
    ranked = md.feature_importance(rows, ("roc_5", "ma_5"), trees=20).collect()
    assert [r.feature for r in ranked] == ["ma_5", "roc_5"] and ranked[0].importance > 5 * ranked[1].importance
    scored = md.fit_and_score(_panel(spark), ("ma_5", "roc_5"), trees=20)
    assert scored.count() == 30 and scored.select("date").distinct().count() == 1
