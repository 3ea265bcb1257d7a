"""Fixed lists of the score cards, and rows that used to end a whole query."""
import numpy as np
from pyspark.sql import functions as F

from tapeloom.operators import accounts as ac
from tapeloom.operators import book as bk
from tapeloom.operators import crosssection as xs
from tapeloom.operators import evaluation as ev
from tapeloom.operators import features as ft
from tapeloom.operators import models as md
from tapeloom.operators import strategies as st
from tapeloom.plans import factors, models
from tapeloom.sources.selection import ticker_lists, universe


def test_pillars_have_their_members():
    assert {name: len(cols) for name, cols in xs.PILLARS_TRAINING.items()} == {"momentum": 30, "squeeze": 11, "catalyst": 2, "safety": 1}
    assert xs.PILLARS_TRAINING["catalyst"] == ("analyst_score", "insider_net_ratio") and xs.PILLARS_TRAINING["safety"] == ("altman_z",)
    assert xs.PILLARS_LIVE == {"momentum": ("coppock", "ridge_slope", "vol_ratio"), "squeeze": ("short_pct_float", "short_ratio"),
                               "catalyst": ("analyst_upside", "put_call_ratio"), "safety": ("altman_z",)}


def test_assembly_leaves_price_momentum_apart():
    assert "pmo_signal" not in factors.ASSEMBLED and len(factors.ASSEMBLED) + 1 + 5 == 18


def test_few_bars_leave_no_split_window(spark):
    days = spark.range(40).selectExpr("'LONG' AS ticker", "date_add(date'2020-01-01', cast(id AS int)) AS date", "100.0 + id AS close")
    short = days.limit(3).withColumn("ticker", F.lit("SHORT"))
    parts = st.split_windows(days.unionByName(short)).groupBy("ticker").agg(F.countDistinct("split").alias("n")).collect()
    assert [(r.ticker, r.n) for r in parts] == [("LONG", 5)]


def test_one_common_date_has_no_growth_rate(spark):
    key = {name: "x" for name in st.KEYS} | {"ticker": "ONE"}
    stats = spark.createDataFrame([tuple(key.values()) + (5.0, 1.0, -2.0)], ", ".join(f"{name} string" for name in key) + ", total_return_pct double, sharpe double, max_drawdown_pct double")
    bars = spark.sql("SELECT 'ONE' AS ticker, date'2020-01-01' AS date, 10.0D AS close")
    row = st.benchmark_comparison(stats, bars, bars.drop("ticker")).first()
    assert row.strategy_cagr is None and row.benchmark_cagr is None and row.strategy_sharpe == 1.0


def test_selections_are_uncapped_unless_asked(spark):
    listed = spark.range(700).selectExpr("concat('T', id) AS ticker", "id AS position")
    assert universe(listed).count() == 700 and universe(listed, 5).count() == 5
    texts = spark.createDataFrame([(1, ",".join(f"t{i}" for i in range(30)))], "k long, text string")
    assert ticker_lists(texts, ["k"], {"A": "B"}).count() == 30 and ticker_lists(texts, ["k"], {"A": "B"}, most=20).count() == 20


def test_ablation_groups_are_the_contract_groups():
    assert list(models.GROUPS) == ["Technical only", "Fundamental only", "Sentiment only", "Tech + Sentiment", "All features"]
    assert models.GROUPS["All features"] == ft.FEATURES and len(ft.FEATURES) == 57


def test_bootstrap_starts_are_spread_evenly_and_independent(spark):
    drawn = bk.mix31(bk.mix31(spark.range(2000).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(9)))), "id", F.lit(42)), "_mixed", F.col("b") + 1)
    rows = drawn.select("id", "b", (F.col("_mixed") % 10).alias("cell")).toPandas()
    counts = rows["cell"].value_counts()
    assert len(counts) == 10 and counts.min() > 1800 and counts.max() < 2200
    wide = rows.pivot(index="id", columns="b", values="cell")
    assert abs(wide.corr().to_numpy() - np.eye(10)).max() < 0.12
    assert abs(wide[0].iloc[:-1].reset_index(drop=True).corr(wide[0].iloc[1:].reset_index(drop=True))) < 0.12


def test_no_folds_give_an_empty_frame(spark):
    rows = spark.sql("SELECT 'A' AS ticker, date'2020-01-01' AS date, 1.0D AS close, 0.1D AS fwd_return, 0.5D AS ma_5")
    out = md.walk_forward_returns(rows, ev.quarterly_folds(rows), ("ma_5",), 2)
    assert out.count() == 0 and "pred_return" in out.columns


def test_thesis_points_fill_up_with_uncovered_facts(spark):
    kind = "array<struct<label:string,text:string,status:string>>"
    row = spark.range(1).selectExpr(
        "'T' AS ticker", "'BUY' AS verdict", f"CAST(array(named_struct('label','Piotroski F-Score','text','strong','status','good')) AS {kind}) AS good", f"CAST(array() AS {kind}) AS warning",
        "5 AS earnings_days", "'safe' AS altman_zone", "3.0D AS z_score", "30.0D AS ev_ebitda", "6.0D AS fcf_yield", "'Tech' AS sector", "'downtrend' AS sector_trend", "20.0D AS short_pct", "'up' AS momentum_trend",
        "CAST(NULL AS double) AS ret_1yr", "25.0D AS upside_pct", "110.0D AS target_mean", "0.1D AS earnings_growth", "0.1D AS profit_margin", "0.1D AS revenue_growth", "20.0D AS trailing_pe", "8 AS piotroski")
    got = ac.thesis(row, most=5, width=77).first()
    assert got.bull_points == ["✅ Piotroski F-Score: strong", "✅ Analyst Coverage: 25.0% upside target implies significant room",
                               "✅ Free Cash Flow: 6.0% yield provides downside cushion", "✅ Momentum: Price momentum accelerating"]
    assert got.bear_points == ["⚠️ Valuation: EV/EBITDA 30.0x well above historical average", "⚠️ Earnings Event: Earnings in 5 days adds near-term volatility",
                               "⚠️ Short Interest: High 20.0% indicates significant bearish positioning"]
