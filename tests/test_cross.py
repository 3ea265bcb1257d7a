"""Ranks, folds, gates, books, cards and scores on literal frames."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.functions.ranks import average_rank, exact_median
from tapeloom.operators import accounts as ac
from tapeloom.operators import alignment as al
from tapeloom.operators import book as bk
from tapeloom.operators import composite as cp
from tapeloom.operators import crosssection as xs
from tapeloom.operators import evaluation as ev
from tapeloom.operators import features as ft
from tapeloom.operators import scorecards as sc
from frames import days


def test_ranks_and_median_are_exact_with_a_hot_group_and_hot_value(spark):
    rng = np.random.default_rng(1)
    hot = [("hot", float(v)) for v in np.r_[np.zeros(3000), rng.normal(size=3000)]]
    cold = [(f"k{i % 7}", float(v)) for i, v in enumerate(rng.integers(0, 50, 500))]
    frame = pd.DataFrame(hot + cold, columns=["k", "v"])
    df = spark.createDataFrame(frame)
    got = average_rank(df, ["k"], "v", "r").groupBy("k", "v").agg(F.first("r").alias("r")).toPandas().set_index(["k", "v"])["r"]
    frame["r"] = frame.groupby("k")["v"].rank()
    assert np.allclose(got.sort_index(), frame.groupby(["k", "v"])["r"].first().sort_index())
    med = {r.k: r.median for r in exact_median(df, ["k"], "v").collect()}
    assert med == pytest.approx(frame.groupby("k")["v"].median().to_dict())


def test_peer_median_equals_brute_force(spark):
    pes = [("A", 10.0), ("B", 12.0), ("C", 12.0), ("D", -3.0), ("E", 20.0), ("F", None), ("G", 31.0)]
    info = spark.createDataFrame(pes, "ticker string, trailing_pe double")
    sectors = spark.createDataFrame([(t, "S") for t, _ in pes], "ticker string, sector string")
    for r in al.sector_valuation(info, sectors).collect():
        others = [p for t, p in pes if t != r.ticker and p and p > 0]
        assert r.peers_used == len(others) and r.sector_median_pe == pytest.approx(float(np.median(others)))


def test_asof_takes_last_known_and_same_day_counts(spark):
    left = spark.createDataFrame([("A", d) for d in days(5)], "ticker string, date date")
    right = spark.createDataFrame([("A", days(5)[1], 1.0), ("A", days(5)[3], 2.0)], "ticker string, filed date, v double")
    assert [r.v for r in al.asof_backward(left, right, "filed", ["v"]).orderBy("date").collect()] == [None, 1.0, 1.0, 2.0, 2.0]


def test_trailing_ratio_window_and_words(spark):
    bars = spark.createDataFrame([("A", days(200)[i]) for i in (0, 10, 99, 150)], "ticker string, date date")
    events = spark.createDataFrame([("A", days(200)[5], "Purchase"), ("A", days(200)[5], "Sale"), ("A", days(200)[9], "Open market Buy")], "ticker string, date date, text string")
    got = [r.insider_net_ratio for r in al.trailing_sentiment(bars, insider=events).orderBy("date").collect()]
    assert got == pytest.approx([0.0, 1 / 3, 1.0, 0.0])


def test_impute_cascade(spark):
    d = days(3)
    rows = spark.createDataFrame([("A", d[0], 1.0), ("B", d[0], 3.0), ("C", d[0], None), ("A", d[1], None), ("A", d[2], 9.0)], "ticker string, date date, x double").withColumn("y", F.lit(None).cast("double"))
    got = {(r.ticker, r.date): r.x for r in ft.impute(rows, ("x", "y")).collect()}
    assert got[("C", d[0])] == 2.0 and got[("A", d[1])] == 2.5
    assert ft.impute(rows, ("x", "y")).filter("y <> 0").count() == 0


def test_quintile_legs_and_single_name_date(spark):
    rows = spark.createDataFrame([(f"T{i}", days(1)[0], float(i), i / 100) for i in range(11)] + [("X", days(2)[1], 1.0, 0.0)], "ticker string, date date, pred_return double, fwd_return double")
    got = xs.legs(rows, "pred_return", 0.2)
    assert {(r.ticker, r.leg) for r in got.collect()} == {("T0", -1), ("T1", -1), ("T9", 1), ("T10", 1)}
    assert ev.long_short_spread(rows).first().avg_spread == pytest.approx(0.09)


def test_buckets_equal_qcut(spark):
    for n in (5, 7, 13, 20):
        rows = spark.createDataFrame([(f"T{i:02d}", days(1)[0], float(i)) for i in range(n)], "ticker string, date date, p double")
        got = [r.bucket for r in xs.quantile_buckets(rows, "p").orderBy("p").collect()]
        assert got == (pd.qcut(pd.Series(range(n)).rank(method="first"), 5, labels=False) + 1).tolist()


def test_folds_are_quarterly_expanding_with_embargo(spark):
    rows = spark.createDataFrame([(d.date(),) for d in pd.date_range("2015-01-01", "2021-12-31", freq="D")], "date date")
    folds = ev.quarterly_folds(rows, embargo=5).orderBy("fold").collect()
    assert str(folds[0].test_start) == "2016-01-01" and str(folds[0].test_end) == "2016-03-31"
    assert all((f.test_start - f.train_end).days == 6 for f in folds) and len({f.train_start for f in folds}) == 1


@pytest.mark.parametrize("values,passed", [((0.58, 0.60, 0.59, 0.61), True), ((0.48, 0.50, 0.51, 0.49), False), ((0.62, 0.61, 0.48, 0.47), False)])
def test_gate_cases(spark, values, passed):
    folds = spark.createDataFrame(list(enumerate(values)), "fold int, accuracy double")
    assert ev.validation_gate(folds, "accuracy", combined=0.55, half=0.5).first().passed is passed


def test_gate_without_folds(spark):
    got = ev.validation_gate(spark.createDataFrame([], "fold int, accuracy double"), "accuracy").first()
    assert got.passed is False and got.reason == "No fold results"


def test_student_tail():
    assert ev.two_sided_t(0.5, 20) == pytest.approx(0.024772, abs=1e-5) and ev.two_sided_t(0.0, 50) == pytest.approx(1.0)
    assert ev.two_sided_t(-0.0139, 151745) < 1e-6 and ev.two_sided_t(1.0, 9) == 0.0


def test_book_is_neutral_in_all_configurations(spark):
    rng = np.random.default_rng(0)
    rows, close = [], {f"T{i}": 100.0 for i in range(30)}
    for d in days(60):
        for t in close:
            close[t] *= 1 + rng.normal() * 0.01
            rows.append((t, d, close[t], float(rng.normal()), abs(float(rng.normal())) * 0.02 + 0.01))
    base = spark.createDataFrame(rows, "ticker string, date date, close double, pred_return double, std_20 double")
    ready = bk.next_day_return(base).withColumn("beta", F.lit(None).cast("double"))
    daily = bk.daily_book(bk.holdings(ready, bk.configs(spark, bk.ROUND_ONE)))
    for r in bk.summary(daily).collect():
        assert r.n_days > 0 and r.gross == pytest.approx(2.0) and r.max_abs_net < 1e-9


def test_hysteresis_keeps_names_between_the_bands(spark):
    n, rows = 20, []
    for day, place in zip(days(4), (19, 14, 12, 5)):       # rank of T0: enter, hold, hold, leave
        order = [f"T{i}" for i in range(1, n)]
        order.insert(place, "T0")
        rows += [(t, day, 100.0, float(k), 0.02) for k, t in enumerate(order)]
    base = spark.createDataFrame(rows, "ticker string, date date, close double, pred_return double, std_20 double")
    ready = bk.next_day_return(base).withColumn("beta", F.lit(None).cast("double"))
    held = bk.holdings(ready, bk.configs(spark, [("h", True, False, 0.1, None, 1, False)])).filter("ticker = 'T0' and leg = 1")
    assert [r.date for r in held.orderBy("date").collect()] == days(4)[:3]


def test_score_card_boundaries(spark):
    z = spark.createDataFrame([("a", 3.0, "safe", 5), ("b", 2.0, "grey", 5), ("c", 1.0, "distress", 4), ("d", None, "unknown", 0)], "ticker string, z_score double, zone string, n_terms int")
    got = {r.ticker: r for r in sc.altman_signal(z).collect()}
    assert [got[k].status for k in "abcd"] == ["good", "neutral", "warning", "neutral"] and "4/5" in got["c"].text
    p = spark.createDataFrame([("a", 7, 4, 2, 1), ("b", 3, 1, 1, 1), ("c", 5, 2, 2, 1)], "ticker string, score int, profitability int, leverage int, efficiency int")
    assert [r.status for r in sc.piotroski_signal(p).orderBy("ticker").collect()] == ["good", "warning", "neutral"]


def test_combined_score_of_one_signal(spark):
    rows = spark.createDataFrame([("A", "technical", "good"), ("A", "sentiment", "unknown")], "ticker string, family string, status string")
    got = cp.combined_score(rows).first()
    assert got.score == pytest.approx(0.4) and got.confidence == 1.0 and got.verdict == "BUY"


def test_pnl_status_and_missing_price(spark):
    pos = spark.createDataFrame([(1, "A", 10.0, 100.0), (1, "B", 10.0, 100.0), (1, "C", 10.0, 100.0), (1, "D", 1.0, 1.0)], "account int, ticker string, shares double, buy_price double")
    prices = spark.createDataFrame([("A", 120.0), ("B", 80.0), ("C", 100.0)], "ticker string, price double")
    valued = ac.pnl(pos, prices)
    assert {r.ticker: r.status for r in valued.collect()} == {"A": "profit", "B": "loss", "C": "breakeven"}
    assert ac.portfolio_summary(valued).first().total_pnl_dollars == pytest.approx(0.0)
