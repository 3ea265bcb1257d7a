"""Blocked correlations, keyed streaming state, own strategies, news picks, ranks and runs against plain computations."""
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.functions.exprs import rolling
from tapeloom.functions.ranks import average_rank
from tapeloom.operators import alignment as al
from tapeloom.operators import book as bk
from tapeloom.operators import crosssection as xs
from tapeloom.operators import plugins as pg
from tapeloom.operators import signals as sg
from tapeloom.operators import strategies as st
from tapeloom.sources.market import VIEW_SQL
from tapeloom.streaming import jobs


def _returns(spark, n=9, days=150):
    rng = np.random.default_rng(2)
    rows = [(f"T{k}", date(2020, 1, 1) + timedelta(days=d), float(rng.normal())) for k in range(n) for d in range(days) if rng.random() > 0.2]
    return rows, spark.createDataFrame(rows, "ticker string, date date, ret double").repartition(4)


@pytest.mark.parametrize("block", [2, 256])
def test_correlations_by_blocks_equal_pandas(spark, block):
    rows, frame = _returns(spark)
    wide = pd.DataFrame(rows, columns=["ticker", "date", "ret"]).pivot(index="date", columns="ticker", values="ret")
    got = {(r.ticker_a, r.ticker_b): r for r in xs.return_correlations(frame, block=block).collect()}
    assert len(got) == 36
    for (a, b), r in got.items():
        both = wide[[a, b]].dropna()
        assert a < b and r.n == len(both) and abs(r.correlation - both[a].corr(both[b])) < 1e-12


def test_alerts_fire_once_over_restarts_and_state_is_one_row_a_ticker(spark, tmp_path):
    source, fired, state = (str(tmp_path / name) for name in ("in", "fired", "state"))
    schema = "event_id long, ts timestamp, ticker string, price double, qty long"
    alerts = spark.createDataFrame([(1, "A", "above", 10.0), (2, "A", "below", 3.0), (3, "A", "above", 20.0), (4, "B", "above", 1.0), (5, "C", "below", 9.0)],
                                   "alert_id long, ticker string, direction string, threshold double")

    def batch(*prices):
        spark.createDataFrame([(i, None, t, p, 1) for i, (t, p) in enumerate(prices)], schema).coalesce(1).write.mode("append").parquet(source)
        jobs.one_shot_alerts(jobs.file_stream(spark, source, schema), alerts, fired, state).awaitTermination()
        return sorted((r.alert_id, r.price) for r in spark.read.schema("alert_id long, price double").parquet(fired).collect())
    assert batch(("A", 9.0), ("A", 4.0), ("B", None)) == []
    assert batch(("A", 12.0), ("A", 5.0)) == [(1, 12.0)]
    assert batch(("A", 11.0), ("A", 2.0), ("B", 1.0)) == [(1, 12.0), (2, 2.0), (4, 1.0)]
    jobs.one_shot_alerts(jobs.file_stream(spark, source, schema), alerts, fired, state).awaitTermination()      # nothing new
    assert batch(("A", 25.0), ("A", 1.0), ("C", 9.0)) == [(1, 12.0), (2, 2.0), (3, 25.0), (4, 1.0), (5, 9.0)]


def test_watchlist_publishes_only_what_moved(spark, tmp_path):
    source, out, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    schema = "event_id long, ts timestamp, ticker string, price double"
    watched = spark.createDataFrame([("A",), ("B",)], "ticker string")

    def batch(number, *prices):
        rows = [(number * 100 + i, datetime(2020, 1, number, 0, i), t, p) for i, (t, p) in enumerate(prices)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        jobs.watchlist_refresh(jobs.file_stream(spark, source, schema), watched, out, state).awaitTermination()
        return spark.read.schema("ticker string, price double, change_pct double, epoch long").parquet(out)
    assert batch(1, ("A", 10.0), ("B", 20.0), ("X", 1.0)).count() == 2
    published = batch(2, ("A", 15.0))
    assert published.count() == 3
    assert sorted(tuple(r) for r in jobs.watchlist_now(published).collect()) == [("A", 15.0, 50.0), ("B", 20.0, 0.0)]


def _walk(spark, tickers=4, days=260):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(tickers):
        prices = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, days)))
        rows += [(f"T{k}", date(2019, 1, 1) + timedelta(days=d), float(p), float(d)) for d, p in enumerate(prices)]
    return spark.createDataFrame(rows, "ticker string, date date, close double, extra double").repartition(3)


def test_a_coded_strategy_equals_the_planned_rule(spark):
    def cross(series):
        assert list(series.columns) == ["ticker", "split", "date", "close"]
        fast, slow = (series["close"].rolling(n).mean() for n in (5, 15))
        return (fast > slow) & (fast.shift() <= slow.shift()), (fast < slow) & (fast.shift() >= slow.shift())
    bars = _walk(spark, days=1500)
    planned = pg.planned_crossing("SAME", lambda: rolling(F.avg, F.col("close"), 5, "split"), lambda: rolling(F.avg, F.col("close"), 15, "split"))
    first = pg.walk_forward(bars, [planned])
    second = pg.walk_forward(bars, [pg.CodedStrategy("SAME", ("close",), cross)])
    def digest(df):
        return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    assert digest(first) == digest(second) and first.count() == 20 and first.agg(F.sum("n_trades")).first()[0] > 0
    assert pg.walk_forward_summary(pg.walk_forward(bars, [planned, pg.CodedStrategy("OTHER", ("extra",), lambda s: (s["extra"] % 7 == 0, [None] * len(s)))])).count() == 8


def test_strategies_that_break_their_contract(spark):
    bars = _walk(spark, 1, 60)
    with pytest.raises(ValueError, match="unknown columns: volume"):
        pg.walk_forward(bars, [pg.CodedStrategy("X", ("volume",), lambda s: ([], []))])
    with pytest.raises(Exception, match="an entry and an exit for each"):
        pg.walk_forward(bars, [pg.CodedStrategy("X", ("close",), lambda s: ([True], [False]))]).collect()


def test_statistics_of_one_scan_equal_trades_and_equity(spark):
    bars = _walk(spark, 2, 150)
    flags = bars.select("ticker", "date", "close", (F.pmod(F.col("extra"), F.lit(9)) == 2).alias("entry"), (F.pmod(F.col("extra"), F.lit(9)) == 6).alias("exit"), F.lit("BREAKDOWN").alias("strategy"))
    held = st.positions(flags)
    made, curve = st.trades(held).toPandas(), st.equity(held).toPandas()
    for r in st.statistics(flags).collect():
        mine, days = made[made.ticker == r.ticker], curve[curve.ticker == r.ticker].sort_values("date")
        assert r.n_trades == len(mine) == 17 and abs(r.avg_trade_days - mine["days"].mean()) < 1e-9
        assert abs(r.total_return_pct - (days["equity"].iloc[-1] * 100 - 100)) < 1e-9 and abs(r.max_drawdown_pct - days["drawdown"].max() * 100) < 1e-9
        gains = days["factor"] - 1
        assert abs(r.sharpe - gains.mean() / gains.std() * 252 ** 0.5) < 1e-9
        assert abs(r.avg_win - mine[mine.trade_return > 0].trade_return.mean()) < 1e-12


def test_bootstrap_by_running_sums_equals_resampling(spark):
    rng = np.random.default_rng(3)
    returns = rng.normal(0.001, 0.01, 107)
    daily = spark.createDataFrame([("c", date(2020, 1, 1) + timedelta(days=i), float(x)) for i, x in enumerate(returns)] + [("few", date(2020, 1, 1), 0.1)], "config string, date date, ret double")
    got = bk.block_bootstrap(daily, block=10, n_boot=40).collect()
    assert [r.config for r in got] == ["c"]

    def mix(value, salt):
        x = (value * 1000003 + salt * 7919) & bk.MASK
        for _ in range(3):
            x = ((x ^ (x >> 16)) * bk.MIXER) & bk.MASK
        return x ^ (x >> 16)
    ratios = []
    for path in range(40):
        drawn = np.concatenate([returns[s:s + 10] for s in (mix(mix(path, 42), b + 1) % 97 for b in range(11))])[:107]
        ratios.append(drawn.mean() * 252 / (drawn.std() * 252 ** 0.5))
    assert np.allclose([got[0].p5, got[0].p50, got[0].p95], np.percentile(ratios, [5, 50, 95]))


@pytest.mark.parametrize("most,least", [(None, 0), (2, 0), (None, 3), (2, 3), (5, 3)])
def test_news_picks(spark, most, least):
    rows = [(i, "AB"[i % 2], ("alpha corp " if i % 2 == 0 and i < 12 else "beta " if i in (3, 5) else "other ") + str(i)) for i in range(30)]
    news = spark.createDataFrame(rows, "doc_id long, ticker string, text string").repartition(5)
    companies = spark.createDataFrame([("A", "Alpha Corp"), ("B", "Beta Inc")], "ticker string, company string")
    got = sorted((r.ticker, r.doc_id) for r in sg.relevant_news(news, companies, most, least).collect())
    want = []
    for ticker, word in (("A", "alpha"), ("B", "beta")):
        mine = [(i, word in text or ticker.lower() in text) for i, t, text in rows if t == ticker]
        found = [i for i, hit in mine if hit]
        picked = found if len(found) >= least else [i for i, _ in mine]
        want += [(ticker, i) for i in sorted(picked)[:most]]
    assert got == want


def test_ranks_over_slices_equal_pandas(spark):
    rng = np.random.default_rng(4)
    rows = [("gh"[int(rng.random() < 0.1)], float(v)) for v in rng.integers(0, 40, 500)] + [("g", 7.0)] * 300 + [("g", None)]
    frame = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = average_rank(frame, ["k"], "v", "r").toPandas()
    want = got.groupby("k")["v"].rank()
    assert np.allclose(got["r"].fillna(-1), want.fillna(-1))


def test_growth_against_the_prior_year_without_a_growing_list(spark):
    facts = [("A", "Revenues", 100.0, "2018-01-01", "2018-12-31", "2019-02-15"), ("A", "Revenues", 130.0, "2019-01-01", "2019-12-31", "2020-02-15"),
             ("A", "Revenues", 50.0, "2019-10-01", "2019-12-31", "2020-02-15"), ("A", "Revenues", 110.0, "2018-01-01", "2018-12-31", "2020-03-01"),
             ("A", "Revenues", 260.0, "2021-01-01", "2021-12-31", "2022-02-15"), ("B", "Revenues", 0.0, "2018-01-01", "2018-12-31", "2019-02-15"), ("B", "Revenues", 5.0, "2019-01-01", "2019-12-31", "2020-02-15")]
    frame = spark.createDataFrame(facts, "ticker string, concept string, value double, start_date string, fiscal_period_end string, filed_date string")
    frame = frame.withColumns({c: F.col(c).cast("date") for c in ("start_date", "fiscal_period_end", "filed_date")})
    got = {(r.ticker, str(r.filed_date)): r.revenue_growth for r in al.point_in_time_ratios(frame).collect()}
    assert got[("A", "2019-02-15")] is None and abs(got[("A", "2020-02-15")] - 0.3) < 1e-12
    assert abs(got[("A", "2020-03-01")] - (130 - 110) / 110) < 1e-12 and got[("A", "2022-02-15")] is None and got[("B", "2020-02-15")] is None


def test_views_take_whole_tables():
    for view in ("v_grades", "v_options", "v_ticks", "v_alerts"):
        assert "WHERE" not in VIEW_SQL[view]
