"""Rule strategy queries (inventory family K, and the edge gate I-11)."""
from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.exprs import rolling, rounded
from tapeloom.operators import composite as cp
from tapeloom.operators import indicators as ind
from tapeloom.operators import plugins as pg
from tapeloom.operators import strategies as st
from tapeloom.plans.factors import composite_of, panel_of
from tapeloom.plans.registry import ORACLE_VIEWS, query
from tapeloom.plans.sqltext import W, roll
from tapeloom.session import cut_lineage

_p = "PARTITION BY ticker ORDER BY date"
ORACLE_VIEWS["v_kbase"] = f"""
SELECT i.*, c.composite, CASE WHEN count(*) OVER (PARTITION BY i.ticker ORDER BY i.date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) = 20 THEN max(close) OVER (PARTITION BY i.ticker ORDER BY i.date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS h20,
 CASE WHEN count(*) OVER (PARTITION BY i.ticker ORDER BY i.date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) = 10 THEN min(close) OVER (PARTITION BY i.ticker ORDER BY i.date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) END AS l10,
 CASE WHEN count(*) OVER (PARTITION BY i.ticker ORDER BY i.date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 20 THEN avg(volume) OVER (PARTITION BY i.ticker ORDER BY i.date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS v20,
 lag(close) OVER (PARTITION BY i.ticker ORDER BY i.date) AS c1, lag(rsi) OVER (PARTITION BY i.ticker ORDER BY i.date) AS r1, row_number() OVER (PARTITION BY i.ticker ORDER BY i.date) AS rn
FROM v_ind i LEFT JOIN v_comp c ON c.ticker = i.ticker AND c.date = i.date"""
KRULES = {
    "BREAKOUT": ("close > h20 AND volume > v20*1.3 AND rsi < 75", "close < l10 OR rsi > 75"),
    "PULLBACK": ("sma20 > sma50 AND close > c1 AND rsi > r1 AND rsi BETWEEN 35 AND 60 AND close > sma20*0.98 AND close < sma20*1.02", "rsi > 70 OR close < sma20*0.96"),
    "MEAN_REVERSION": ("rsi < 32 AND close < bb_lower", "rsi > 55 OR close > bb_mid"),
    "RANGE": ("close <= bb_lower*1.01 AND abs(sma20-sma50)/close < 0.03 AND rsi BETWEEN 30 AND 55", "close >= bb_mid OR close < bb_lower*0.97"),
    "BREAKDOWN": ("close < l10 AND sma20 < sma50 AND rsi < 45", "rsi < 25 OR close > sma20"),
    "VALIDATED": ("composite > 0.15", "composite < -0.05"), "BUY_AND_HOLD": ("rn = 1", "false")}
ORACLE_VIEWS["v_strat"] = " UNION ALL ".join(f"SELECT ticker, '{n}' AS strategy, date, close, coalesce({e}, false) AS entry, coalesce({x}, false) AS exit FROM v_kbase" for n, (e, x) in KRULES.items())


def held_sql(source, extra=""):
    k = "ticker, strategy" + extra
    return f"""
SELECT *, sum(CASE WHEN state = 1 AND before = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY {k} ORDER BY date) AS run, greatest(1 + coalesce(before*side*(close/price - 1), 0) - 0.001*abs(state-before), 1e-9) AS factor
FROM (SELECT *, coalesce(lag(state) OVER (PARTITION BY {k} ORDER BY date), 0) AS before, lag(close) OVER (PARTITION BY {k} ORDER BY date) AS price, CASE WHEN strategy = 'BREAKDOWN' THEN -1.0 ELSE 1.0 END AS side
      FROM (SELECT *, coalesce(last_value(CASE WHEN entry <> exit THEN entry::INT END IGNORE NULLS) OVER (PARTITION BY {k} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS state FROM {source}) a) b"""


def trades_sql(held, extra=""):
    k = "ticker, strategy" + extra
    return f"""
SELECT {k}, run, min(date) AS entry_date, max(date) AS exit_date, CASE WHEN any_value(side) > 0 THEN arg_max(close, date)/arg_min(close, date)*0.999/1.001 - 1 ELSE 1 - arg_max(close, date)/arg_min(close, date) - 0.001*(1 + arg_max(close, date)/arg_min(close, date)) END AS trade_return,
  arg_max(state, date) = 1 AS is_open, CAST(max(date) - min(date) AS INT) AS days FROM {held} WHERE state = 1 OR before = 1 GROUP BY {k}, run"""


def stats_sql(held, trades, extra=""):
    k = "ticker, strategy" + extra
    return f"""
SELECT *, CASE WHEN dd > 0 THEN (pow(1 + total_return_pct/100, 365.25/dd) - 1)*100 ELSE 0 END AS cagr_pct, CASE WHEN n_bars < 100 THEN printf('Need at least %d bars, got %d', 100, n_bars) END AS error FROM (
 SELECT {k}, count(*) AS n_bars, arg_max(eq, date)*100 - 100 AS total_return_pct, max(date) - min(date) AS dd, CASE WHEN stddev_samp(factor) > 1e-12 THEN avg(factor-1)/stddev_samp(factor)*sqrt(252) ELSE 0 END AS sharpe, max(draw)*100 AS max_drawdown_pct
 FROM (SELECT *, greatest(0, 1 - eq/greatest(1.0, max(eq) OVER (PARTITION BY {k} ORDER BY date))) AS draw FROM (SELECT *, exp(sum(ln(factor)) OVER (PARTITION BY {k} ORDER BY date)) AS eq FROM {held}) a) b GROUP BY {k}) c
LEFT JOIN (SELECT {k}, count(*) AS nt, avg((trade_return > 0)::INT)*100 AS wr, avg(days) AS ad, avg(trade_return) FILTER (WHERE trade_return > 0) AS aw, avg(trade_return) FILTER (WHERE trade_return < 0) AS al FROM {trades} GROUP BY {k}) t USING ({k})"""


ORACLE_VIEWS["v_held"] = held_sql("v_strat")
ORACLE_VIEWS["v_trades"] = trades_sql("v_held")
ORACLE_VIEWS["v_stats"] = stats_sql("v_held", "v_trades")
STAT_COLS = """n_bars, r6(ln(1 + total_return_pct/100)) AS log_growth, r4(cagr_pct) AS cagr_pct, r5(sharpe) AS sharpe, r4(max_drawdown_pct) AS max_drawdown_pct, r4(coalesce(wr, 0)) AS win_rate_pct, coalesce(nt, 0) AS n_trades,
 r4(coalesce(ad, 0)) AS avg_trade_days, r6(coalesce(aw, 0)) AS avg_win, r6(coalesce(al, 0)) AS avg_loss, error"""
DIGITS = {"total_return_pct": 4, "cagr_pct": 4, "sharpe": 5, "max_drawdown_pct": 4, "win_rate_pct": 4, "avg_trade_days": 4}


def signals_of(m):
    m.staged()
    return st.strategy_signals(ind.common_indicators(m.series), composite_of(m))


@query("sma_cross_signals", "K-01", f"""
SELECT ticker, date, entry, exit FROM (SELECT ticker, date, coalesce(sma20 > sma50 AND lag(sma20) OVER w <= lag(sma50) OVER w, false) AS entry, coalesce(sma20 < sma50 AND lag(sma20) OVER w >= lag(sma50) OVER w, false) AS exit FROM v_ind WINDOW w AS ({_p})) z""")
def _(m):
    return st.sma_cross(ind.common_indicators(m.series)).select("ticker", "date", "entry", "exit")


@query("rsi_cross_signals", "K-02", f"""
SELECT ticker, date, coalesce(rsi > 30 AND lag(rsi) OVER w <= 30, false) AS entry, coalesce(rsi < 70 AND lag(rsi) OVER w >= 70, false) AS exit FROM v_ind WINDOW w AS ({_p})""")
def _(m):
    return st.rsi_cross(ind.common_indicators(m.series)).select("ticker", "date", "entry", "exit")


@query("strategy_signals", "K-03", "SELECT ticker, strategy, date, entry, exit FROM v_strat")
def _(m):
    return signals_of(m).select("ticker", "strategy", "date", "entry", "exit")


@query("strategy_trades", "K-04", "SELECT ticker, strategy, CAST(run AS BIGINT) AS run, entry_date, exit_date, r6(trade_return) AS trade_return, is_open, days FROM v_trades")
def _(m):
    return rounded(st.trades(st.positions(signals_of(m))))


@query("strategy_statistics", "K-05, K-06, K-08", f"SELECT ticker, strategy, {STAT_COLS} FROM v_stats")
def _(m):
    # The in-sample rule compounds to astronomic levels; its growth is compared as a logarithm.
    out = st.statistics(signals_of(m)).withColumn("log_growth", F.log(1 + F.col("total_return_pct") / 100)).drop("total_return_pct")
    return rounded(out, **DIGITS)


ORACLE_VIEWS["v_half"] = """
SELECT *, CASE WHEN row_number() OVER (PARTITION BY ticker, strategy ORDER BY date) > count(*) OVER (PARTITION BY ticker, strategy) // 2 THEN 2 ELSE 1 END AS half FROM v_strat"""
ORACLE_VIEWS["v_half_held"] = held_sql("v_half", ", half")
ORACLE_VIEWS["v_half_trades"] = trades_sql("v_half_held", ", half")
ORACLE_VIEWS["v_half_stats"] = stats_sql("v_half_held", "v_half_trades", ", half")
ORACLE_VIEWS["v_stable"] = """
SELECT *, mt >= 3 AND ms > 0 AS stable, CASE WHEN mt < 3 THEN 'not enough trades in one half to check' WHEN ms <= 0 THEN 'edge did not hold in both halves' ELSE 'edge held in both halves independently' END AS reason
FROM (SELECT ticker, strategy, min(CASE WHEN error IS NULL THEN coalesce(nt, 0) ELSE 0 END) AS mt, min(CASE WHEN error IS NULL THEN sharpe ELSE 0 END) AS ms FROM v_half_stats GROUP BY ticker, strategy) z"""


@query("split_half_stability", "K-07", "SELECT ticker, strategy, mt AS min_trades, r5(ms) AS min_sharpe, stable, reason FROM v_stable")
def _(m):
    return rounded(st.stability(signals_of(m)), 5)


@query("edge_gate", "I-11", "SELECT ticker, strategy, s.error IS NULL AND coalesce(s.nt, 0) >= 5 AND b.stable AS has_edge FROM v_stats s JOIN v_stable b USING (ticker, strategy)")
def _(m):
    signals = cut_lineage(signals_of(m))     # read for the whole and for its halves
    return st.has_edge(st.statistics(signals), st.stability(signals)).select("ticker", "strategy", "has_edge")


ORACLE_VIEWS["v_split"] = """
SELECT ticker, 'SMA_CROSS' AS strategy, date, close, split FROM (
 SELECT *, (split-1)*sz AS st, CASE WHEN split = 5 THEN n - 4*sz ELSE sz END AS ln FROM (SELECT *, n // 5 AS sz, CAST(least(i // (n // 5), 4) + 1 AS INT) AS split FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n FROM v_bars) a) b) c WHERE i - st >= floor(ln*0.8)"""
_wk = "PARTITION BY ticker, split ORDER BY date"
ORACLE_VIEWS["v_split_sig"] = f"""
SELECT ticker, strategy, split, date, close, coalesce(a > b AND lag(a) OVER w <= lag(b) OVER w, false) AS entry, coalesce(a < b AND lag(a) OVER w >= lag(b) OVER w, false) AS exit
FROM (SELECT *, {roll('avg', 'close', 5, 'ticker, split')} AS a, {roll('avg', 'close', 15, 'ticker, split')} AS b FROM v_split) z WINDOW w AS ({_wk})"""
ORACLE_VIEWS["v_split_held"] = held_sql("v_split_sig", ", split")
ORACLE_VIEWS["v_split_trades"] = trades_sql("v_split_held", ", split")
ORACLE_VIEWS["v_split_stats"] = stats_sql("v_split_held", "v_split_trades", ", split")


def split_stats(m):
    parts = st.split_windows(m.bars.select("ticker", "date", "close"))
    # Indicators restart inside each test part: split joins the window key.
    fast, slow = rolling(F.avg, F.col("close"), 5, "split"), rolling(F.avg, F.col("close"), 15, "split")
    signals = st.crossings(parts, fast, slow, "split").withColumn("strategy", F.lit("SMA_CROSS"))
    return st.statistics(signals, "split", least=2)


@query("split_window_statistics", "K-09", "SELECT ticker, strategy, split, n_bars, r4(total_return_pct) AS total_return_pct, r5(sharpe) AS sharpe, r4(max_drawdown_pct) AS max_drawdown_pct FROM v_split_stats")
def _(m):
    return rounded(split_stats(m).select("ticker", "strategy", "split", "n_bars", "total_return_pct", "sharpe", "max_drawdown_pct"), 5, total_return_pct=4, max_drawdown_pct=4)


def coded_cross(series):
    """The same rule as a caller would write it."""
    fast, slow = (series["close"].rolling(n).mean() for n in (5, 15))
    return (fast > slow) & (fast.shift() <= slow.shift()), (fast < slow) & (fast.shift() >= slow.shift())


@query("walk_forward_own_strategies", "K-09", " UNION ALL ".join(f"""
SELECT ticker, '{name}' AS strategy, split, n_bars, coalesce(nt, 0) AS n_trades, r4(total_return_pct) AS total_return_pct, r5(sharpe) AS sharpe, r4(max_drawdown_pct) AS max_drawdown_pct FROM v_split_stats WHERE n_bars >= 2"""
    for name in ("PLANNED", "CODED")))
def _(m):
    planned = pg.planned_crossing("PLANNED", lambda: rolling(F.avg, F.col("close"), 5, "split"), lambda: rolling(F.avg, F.col("close"), 15, "split"))
    out = pg.walk_forward(m.staged().bars.select("ticker", "date", "close"), [planned, pg.CodedStrategy("CODED", ("close",), coded_cross)])
    return rounded(out.select("ticker", "strategy", "split", "n_bars", "n_trades", "total_return_pct", "sharpe", "max_drawdown_pct"), 5, total_return_pct=4, max_drawdown_pct=4)


@query("split_window_summary", "K-09", """
SELECT ticker, strategy, count(*) AS n_splits, r6(avg(total_return_pct/100)) AS avg_return, r6(median(total_return_pct/100)) AS median_return, r6(stddev_pop(total_return_pct/100)) AS std_return,
 r5(avg(sharpe)) AS avg_sharpe, r5(median(sharpe)) AS median_sharpe, r6(avg(max_drawdown_pct/100)) AS avg_max_drawdown FROM v_split_stats GROUP BY ticker, strategy""")
def _(m):
    return rounded(st.split_summary(split_stats(m)), avg_sharpe=5, median_sharpe=5)


@query("benchmark_comparison", "K-10", """
SELECT s.ticker, strategy, r4((pow(1+total_return_pct/100, 365.25/d) - 1)*100) AS strategy_cagr, r4((pow(b/a, 365.25/d) - 1)*100) AS benchmark_cagr, r5(sharpe) AS strategy_sharpe, r5(bs) AS benchmark_sharpe,
 r4(max_drawdown_pct) AS strategy_max_drawdown, r4(bd) AS benchmark_max_drawdown, r4((pow(1+total_return_pct/100, 365.25/d) - pow(b/a, 365.25/d))*100) AS outperformance_cagr
FROM v_stats s JOIN (SELECT ticker, arg_min(c, date) AS a, arg_max(c, date) AS b, max(date)-min(date) AS d, min(c/m - 1)*100 AS bd, avg(c/p - 1)/stddev_samp(c/p - 1)*sqrt(252) AS bs
  FROM (SELECT t.ticker, t.date, e.close AS c, lag(e.close) OVER (PARTITION BY t.ticker ORDER BY t.date) AS p, max(e.close) OVER (PARTITION BY t.ticker ORDER BY t.date) AS m FROM v_bars t JOIN v_bench e ON e.date = t.date) x GROUP BY ticker) y USING (ticker)""")
def _(m):
    signals = signals_of(m)
    out = st.benchmark_comparison(st.statistics(signals), m.bars, m.bench)
    return rounded(out, 4, strategy_sharpe=5, benchmark_sharpe=5)


def label_sql(source, signal, thresholds):
    return " UNION ALL ".join(f"""
SELECT CAST({t} AS DOUBLE) AS threshold, sum(n)::BIGINT AS n_trades, r6(sum(w)/sum(n)) AS win_rate, r6(sum(w)/sum(n)*sum(a)/sum(n)*3.0 - (1-sum(w)/sum(n))*sum(a)/sum(n)*1.5) AS avg_return, r5(12*(sum(w)/sum(n)*sum(a)/sum(n)*3.0 - (1-sum(w)/sum(n))*sum(a)/sum(n)*1.5)) AS annualized_return_est, r5(coalesce(avg(g)/(stddev_samp(g)+1e-8)*sqrt(12), 0)) AS sharpe
FROM (SELECT *, w/n*a/n*3.0 - l/n*a/n*1.5 AS g FROM (SELECT date_trunc('month', date) AS mo, count(*)::DOUBLE AS n, count(*) FILTER (WHERE label = 'WIN')::DOUBLE AS w, count(*) FILTER (WHERE label = 'LOSS')::DOUBLE AS l, sum(atr_pct) AS a
  FROM {source} WHERE {signal} >= {t} GROUP BY 1) p) q""" for t in thresholds)


@query("label_trade_statistics", "K-11", label_sql("v_rule", "rule_signal", ["0.6"]))
def _(m):
    scaled = cp.min_max(cp.rule_score(panel_of(m)), "rule_score", "rule_signal")
    return rounded(st.label_trades(scaled, "rule_signal", (0.6,)), sharpe=5, annualized_return_est=5)


@query("baseline_rule_score_table", "K-12", f"""
SELECT 'baseline' AS strategy, * FROM ({label_sql('v_rule', '1', ['0.0'])}) a UNION ALL SELECT 'rule', * FROM ({label_sql('v_rule', 'rule_signal', ['0.6'])}) b
UNION ALL SELECT 'model', * FROM ({label_sql('v_rule2', 'model_signal', ['0.55', '0.6', '0.65'])}) c""")
def _(m):
    # A scaled mean-reversion score in the model's place, which SQL can compute too; the model's own rows are in plans/chain.py.
    panel = panel_of(m)
    scored = cp.min_max(cp.min_max(cp.rule_score(panel), "rule_score", "rule_signal"), "ma_20", "model_signal").withColumn("one", F.lit(1.0))
    parts = [("baseline", "one", (0.0,)), ("rule", "rule_signal", (0.6,)), ("model", "model_signal", (0.55, 0.6, 0.65))]
    out = None
    for name, column, cuts in parts:
        part = st.label_trades(scored, column, cuts).select(F.lit(name).alias("strategy"), "*")
        out = part if out is None else out.unionByName(part)
    return rounded(out, sharpe=5, annualized_return_est=5)


ORACLE_VIEWS["v_rule2"] = "SELECT date, label, atr_pct, (ma_20 - min(ma_20) OVER ())/(max(ma_20) OVER () - min(ma_20) OVER () + 1e-8) AS model_signal FROM v_panel"


@query("indexed_equity", "K-13", """
SELECT ticker, strategy, date, r6(ln(eq/first_value(eq) OVER (PARTITION BY ticker, strategy ORDER BY date)*100)) AS log_equity FROM (SELECT *, exp(sum(ln(factor)) OVER (PARTITION BY ticker, strategy ORDER BY date)) AS eq FROM v_held) z""")
def _(m):
    curve = st.indexed_equity(st.equity(st.positions(signals_of(m))))
    return rounded(curve.select("ticker", "strategy", "date", F.log("equity_100").alias("log_equity")))
