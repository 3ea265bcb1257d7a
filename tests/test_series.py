"""Indicators, features and labels on literal bars, against pandas or by hand."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.functions.rolling import Roll, rolled
from tapeloom.functions.smoothing import ewm_span
from tapeloom.operators import features as ft
from tapeloom.operators import indicators as ind
from tapeloom.operators import labels as lb
from tapeloom.operators import structure as so
from frames import bars, walk


def noisy(n=700, seed=3):
    rng = np.random.default_rng(seed)
    return [float(x) for x in 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))]


def ordered(df, *columns):
    return df.orderBy("date").select(*columns).toPandas()


def test_ewm_matches_recursion_beyond_one_block(spark):
    closes = noisy(1300)
    got = ordered(ewm_span(bars(spark, closes), "close", "e", 12), "e")["e"]
    want = pd.Series(closes).ewm(span=12, adjust=False).mean()
    assert np.allclose(got, want, rtol=1e-11)


def test_rolled_matches_pandas_for_odd_widths(spark):
    closes = noisy(400)
    out = rolled(bars(spark, closes), [Roll("sum", F.col("close"), {7: "s7", 63: "s63"}), Roll("max", F.col("close"), {252: "m252"}), Roll("min", F.col("close"), {14: "n14"})])
    got = ordered(out, "s7", "s63", "m252", "n14")
    s = pd.Series(closes)
    assert np.allclose(got["s63"][62:], s.rolling(63).sum()[62:]) and np.allclose(got["s7"], s.rolling(7, min_periods=1).sum())
    assert np.allclose(got["m252"], s.rolling(252, min_periods=1).max()) and np.allclose(got["n14"], s.rolling(14, min_periods=1).min())


def test_feature_names_are_the_contract():
    assert len(ft.FEATURES) == 57 == len(set(ft.FEATURES))


def test_line_has_full_fit_and_flat_has_none(spark):
    line = ordered(ft.price_features(bars(spark, [2.0 * i + 5 for i in range(40)])), "beta_10", "rsqr_10", "resi_10", "close").iloc[-1]
    assert line["beta_10"] == pytest.approx(2 / line["close"]) and line["rsqr_10"] == pytest.approx(1) and line["resi_10"] == pytest.approx(0, abs=1e-9)
    flat = ordered(ft.price_features(bars(spark, [7.0] * 40)), "beta_10", "rsqr_10", "corr_10", "std_20").iloc[-1]
    assert flat["beta_10"] == 0 and flat["rsqr_10"] == 0 and pd.isna(flat["corr_10"]) and flat["std_20"] == 0


def test_short_history_gives_null(spark):
    got = ordered(ft.price_features(bars(spark, noisy(30))), "high_52w_proximity", "ma_60", "ma_20")
    assert got["high_52w_proximity"].isna().all() and got["ma_60"].isna().all() and got["ma_20"].notna().sum() == 11


def test_price_features_match_pandas(spark):
    closes = noisy(320)
    got = ordered(ft.price_features(bars(spark, closes)), "std_60", "ma_60", "high_52w_proximity", "qtlu_10", "rank_10", "cntp_10")
    s = pd.Series(closes)
    assert np.allclose(got["std_60"][59:], (s.rolling(60).std() / s)[59:], atol=1e-10)
    assert np.allclose(got["qtlu_10"][9:], (s.rolling(10).quantile(0.8) / s)[9:], atol=1e-10)
    assert np.allclose(got["high_52w_proximity"][251:], (s / s.rolling(252).max())[251:], atol=1e-12)
    assert np.allclose(got["rank_10"][9:], s.rolling(10).apply(lambda x: (x.iloc[-1] > x).sum() / 10)[9:])


def test_zero_volume_money_flow_is_null(spark):
    assert ordered(ind.money_flow(bars(spark, noisy(40), volume=0.0)), "cmf_20d")["cmf_20d"].isna().all()


def test_rsi_of_rising_prices_is_100(spark):
    assert ordered(ind.rsi(bars(spark, [100.0 + i for i in range(40)])), "rsi")["rsi"].iloc[-1] == 100


def test_five_bar_return_of_linear_walk(spark):
    got = lb.add_target(walk(spark), 5)
    first = got.filter("ticker = 'AAA'").orderBy("date").first()
    assert first.fwd_return == pytest.approx(5 / 100) and got.groupBy("ticker").count().filter("count = 25").count() == 2


def test_return_is_clipped_and_stays_in_its_ticker(spark):
    jump = bars(spark, [100.0] * 4 + [1000.0] * 6)
    assert lb.add_target(jump, 5).agg(F.max("fwd_return")).first()[0] == 0.25
    last = lb.add_targets(walk(spark)).filter("ticker = 'AAA'").orderBy(F.desc("date")).first()
    assert last.fwd_1 is None


def barrier_frame(spark, highs, lows):
    n = len(highs)
    rows = [("T", d, h, low, 100.0, 0.02) for d, h, low in zip(pd.date_range("2020-01-01", periods=n).date, highs, lows)]
    return spark.createDataFrame(rows, "ticker string, date date, high double, low double, close double, atr_pct double")


@pytest.mark.parametrize("day,high,low,label", [(3, 107, 99, "WIN"), (3, 101, 96, "LOSS"), (3, 107, 96, "LOSS"), (25, 107, 99, "NEUTRAL")])
def test_first_barrier_wins_and_tie_is_loss(spark, day, high, low, label):
    highs, lows = [101.0] * 40, [99.0] * 40
    highs[day], lows[day] = float(high), float(low)
    got = lb.barrier_label(barrier_frame(spark, highs, lows)).orderBy("date").collect()
    assert got[0].label == label and all(r.label == "NEUTRAL" for r in got[-21:])


def test_pivots_come_from_second_last_bar(spark):
    got = so.pivot_points(bars(spark, [10.0, 20.0, 30.0])).first()
    assert got.PP == 20.0 and got.R1 == 21.0 and got.S1 == 19.0


def test_trade_levels_mirror_for_sell_and_skip_hold(spark):
    rows = spark.createDataFrame([("A", 100.0, 2.0, "BUY"), ("B", 100.0, 2.0, "SELL / AVOID"), ("C", 100.0, 2.0, "HOLD / WATCH")], "ticker string, close double, atr double, verdict string")
    got = {r.ticker: r for r in so.trade_levels(rows).collect()}
    assert (got["A"].stop_loss, got["A"].take_profit, got["A"].risk_reward_ratio) == (98.0, 106.0, 3.0)
    assert (got["B"].stop_loss, got["B"].take_profit) == (102.0, 94.0) and got["C"].entry is None


def test_at_most_three_levels_a_side(spark):
    got = so.swing_levels(bars(spark, noisy(200)), most=3, newest=5).first()
    assert 0 < len(got.resistance) <= 3 and 0 < len(got.support) <= 3
