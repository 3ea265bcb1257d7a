"""Indicator queries (inventory family B)."""
from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions import messages as M
from tapeloom.functions.exprs import newest, rolling, rounded
from tapeloom.functions.smoothing import ewm_span
from tapeloom.operators import indicators as ind
from tapeloom.operators import signals as sig
from tapeloom.plans.registry import ORACLE_VIEWS, query
from tapeloom.plans.sqltext import W, chg, ewm, lag, last, roll, text

A = {n: 2.0 / (n + 1.0) for n in (9, 12, 19, 26, 34)}

ORACLE_VIEWS["v_rsi"] = f"""
SELECT ticker, date, CASE WHEN dn > 0 THEN 100 - 100/(1+up/dn) WHEN up > 0 THEN 100.0 END AS rsi
FROM (SELECT ticker, date, {ewm('gain', 1/14, 500)} AS up, {ewm('loss', 1/14, 500)} AS dn
      FROM (SELECT ticker, date, CASE WHEN d IS NOT NULL THEN greatest(d, 0.0) END AS gain,
                   CASE WHEN d IS NOT NULL THEN greatest(-d, 0.0) END AS loss
            FROM (SELECT ticker, date, close - {lag('close', 1)} AS d FROM v_bars) a) b) c"""
ORACLE_VIEWS["v_macd"] = f"""
SELECT ticker, date, macd, {ewm('macd', A[9], 166)} AS macd_signal
FROM (SELECT ticker, date, {ewm('close', A[12], 222)} - {ewm('close', A[26], 480)} AS macd FROM v_bars) a"""
ORACLE_VIEWS["v_ind"] = f"""
SELECT b.*, {roll('avg', 'b.close', 20, 'b.ticker')} AS sma20, {roll('avg', 'b.close', 50, 'b.ticker')} AS sma50, r.rsi, m.macd, m.macd_signal,
       {roll('avg', 'b.close', 20, 'b.ticker')} + 2*{roll('stddev_samp', 'b.close', 20, 'b.ticker')} AS bb_upper,
       {roll('avg', 'b.close', 20, 'b.ticker')} - 2*{roll('stddev_samp', 'b.close', 20, 'b.ticker')} AS bb_lower,
       {roll('avg', 'b.close', 20, 'b.ticker')} AS bb_mid
FROM v_bars b JOIN v_rsi r ON b.ticker = r.ticker AND b.date = r.date JOIN v_macd m ON b.ticker = m.ticker AND b.date = m.date""".replace("ORDER BY date", "ORDER BY b.date")
ORACLE_VIEWS["v_tr"] = f"""
SELECT *, greatest(high-low, abs(high-pc), abs(low-pc)) AS tr FROM (SELECT *, {lag('close', 1)} AS pc FROM v_bars) a"""
ORACLE_VIEWS["v_atr"] = f"""
SELECT ticker, date, {roll('avg', 'tr', 14)} AS atr, clip(avg(tr) OVER {W(14)} / (close + 1e-8), 0, 0.2) AS atr_pct FROM v_tr"""


@query("sma_20_50", "B-01", f"SELECT ticker, date, r6({roll('avg', 'close', 20)}) AS sma20, r6({roll('avg', 'close', 50)}) AS sma50 FROM v_bars")
def _(m):
    return rounded(ind.sma(ind.sma(m.bars, 20), 50).select("ticker", "date", "sma20", "sma50"))


@query("relative_strength_index", "B-02, B-20", "SELECT ticker, date, r6(rsi) AS rsi FROM v_rsi")
def _(m):
    return rounded(ind.rsi(m.series).select("ticker", "date", "rsi"))


@query("macd", "B-03, B-20", "SELECT ticker, date, r6(macd) AS macd, r6(macd_signal) AS macd_signal FROM v_macd")
def _(m):
    return rounded(ind.macd(m.series).select("ticker", "date", "macd", "macd_signal"))


@query("exponential_mean", "B-20", f"SELECT ticker, date, r6({ewm('close', A[26], 480)}) AS ema26 FROM v_bars")
def _(m):
    return rounded(ewm_span(m.bars, "close", "ema26", 26).select("ticker", "date", "ema26"))


@query("bollinger_bands", "B-04", """
SELECT ticker, date, r6(bb_upper) AS bb_upper, r6(bb_mid) AS bb_mid, r6(bb_lower) AS bb_lower FROM v_ind""")
def _(m):
    return rounded(ind.bollinger(m.bars).select("ticker", "date", "bb_upper", "bb_mid", "bb_lower"))


ORACLE_VIEWS["v_volume"] = f"""
SELECT *, volume / nullif(vol_ma20, 0) AS vol_ratio FROM (
  SELECT ticker, date, close, volume, {roll('avg', 'volume', 20)} AS vol_ma20, {lag('close', 1)} AS pc FROM v_bars) a"""


@query("volume_average_ratio", "B-05", "SELECT ticker, date, r6(vol_ma20) AS vol_ma20, r6(vol_ratio) AS vol_ratio FROM v_volume")
def _(m):
    return rounded(ind.volume_indicators(m.bars).select("ticker", "date", "vol_ma20", "vol_ratio"))


@query("volume_price_confirm", "B-06", """
SELECT ticker, date, coalesce((close > pc AND volume > vol_ma20) OR (close < pc AND volume > vol_ma20), false) AS vol_price_confirm FROM v_volume""")
def _(m):
    return ind.volume_indicators(m.bars).select("ticker", "date", "vol_price_confirm")


@query("volume_signal", "B-07", f"""
SELECT ticker, 'Volume' AS label, CASE WHEN vol_ratio > 1.5 AND close > pc THEN 'good' WHEN vol_ratio > 1.5 AND close < pc THEN 'warning' ELSE 'neutral' END AS status,
  CASE WHEN vol_ratio > 1.5 AND close > pc THEN {text(M.VOLUME['up'])} WHEN vol_ratio > 1.5 AND close < pc THEN {text(M.VOLUME['down'])}
       WHEN vol_ratio < 0.7 THEN printf({text(M.VOLUME['low'])}, vol_ratio) ELSE printf({text(M.VOLUME['normal'])}, vol_ratio) END AS text
FROM {last('v_volume')} z""")
def _(m):
    return sig.volume_signal(m.bars)


@query("atr_share_partial_window", "B-08, C-06", "SELECT ticker, date, r6(atr_pct) AS atr_pct FROM v_atr")
def _(m):
    return rounded(ind.atr_partial(m.bars).select("ticker", "date", "atr_pct"))


@query("atr_full_window", "B-09", "SELECT ticker, date, r6(atr) AS atr FROM v_atr")
def _(m):
    return rounded(ind.atr_full(m.bars).select("ticker", "date", "atr"))


@query("chaikin_money_flow", "B-10, C-07", f"""
SELECT ticker, date, r6(clip({roll('sum', 'mf', 20)} / nullif({roll('sum', 'volume', 20)}, 0), -1, 1)) AS cmf_20d
FROM (SELECT ticker, date, volume, ((close-low)-(high-close))/(high-low+1e-8)*volume AS mf FROM v_bars) a""")
def _(m):
    return rounded(ind.money_flow(m.bars).select("ticker", "date", "cmf_20d"))


ORACLE_VIEWS["v_mom_raw"] = f"""
SELECT ticker, date, CASE WHEN n >= 22 THEN (close-a)/a*100 END AS ret_1mo, CASE WHEN n >= 64 THEN (close-b)/b*100 END AS ret_3mo,
       CASE WHEN n >= 127 THEN (close-c)/c*100 END AS ret_6mo, CASE WHEN n >= 253 THEN (close-d)/d*100 END AS ret_1yr
FROM (SELECT ticker, date, close, count(*) OVER (PARTITION BY ticker) AS n, {lag('close', 20)} AS a, {lag('close', 62)} AS b,
             {lag('close', 125)} AS c, {lag('close', 251)} AS d FROM v_bars) x"""
ORACLE_VIEWS["v_mom"] = f"""
SELECT *, CASE WHEN momentum_score > 0.5 THEN 'strong_up' WHEN momentum_score > 0.1 THEN 'up' WHEN momentum_score < -0.5 THEN 'strong_down'
               WHEN momentum_score < -0.1 THEN 'down' ELSE 'neutral' END AS trend
FROM (SELECT *, coalesce(list_avg(list_filter([clip(ret_1mo/5, -1, 1), clip(ret_3mo/15, -1, 1), clip(ret_6mo/25, -1, 1), clip(ret_1yr/40, -1, 1)],
                                  lambda v: v IS NOT NULL)), 0.0) AS momentum_score FROM {last('v_mom_raw')} z) y"""


@query("momentum_horizons", "B-11", "SELECT ticker, r6(ret_1mo) AS ret_1mo, r6(ret_3mo) AS ret_3mo, r6(ret_6mo) AS ret_6mo, r6(ret_1yr) AS ret_1yr FROM v_mom")
def _(m):
    return rounded(ind.momentum(m.bars).select("ticker", "ret_1mo", "ret_3mo", "ret_6mo", "ret_1yr"))


@query("momentum_score_trend", "B-12", "SELECT ticker, r6(momentum_score) AS momentum_score, trend FROM v_mom")
def _(m):
    return rounded(ind.momentum(m.bars).select("ticker", "momentum_score", "trend"))


COPPOCK = f"""
SELECT ticker, date, ({' + '.join(f'{k + 1}*' + lag('s', k) for k in range(10))})/55.0 AS coppock
FROM (SELECT ticker, date, ({chg('close', 14)} + {chg('close', 11)})*100 AS s FROM v_bars) a"""
ORACLE_VIEWS["v_coppock"] = COPPOCK


@query("coppock_curve", "B-13", "SELECT ticker, date, r6(coppock) AS coppock FROM v_coppock")
def _(m):
    return rounded(ind.coppock(m.bars).select("ticker", "date", "coppock"))


@query("coppock_signal", "B-14", f"""
SELECT ticker, r6(coalesce(coppock, 0.0)) AS value,
       r6(CASE WHEN coppock > 0 THEN clip(coppock/50, 0.3, 1) WHEN coppock < 0 THEN -clip(coppock/-50, 0.3, 1) ELSE 0 END) AS signal,
       CASE WHEN coppock > 0 THEN 'bullish' WHEN coppock < 0 THEN 'bearish' ELSE 'neutral' END AS trend FROM {last('v_coppock')} z""")
def _(m):
    return rounded(ind.coppock_signal(m.bars))


@query("normalised_trend_slope", "B-15", """
SELECT ticker, r6(slope) AS slope, r6(signal) AS signal, CASE WHEN signal > 0.05 THEN 'uptrend' WHEN signal < -0.05 THEN 'downtrend' ELSE 'neutral' END AS interpretation
FROM (SELECT ticker, slope, clip(slope/0.2, -1, 1) AS signal FROM (
  SELECT ticker, CASE WHEN count(*) = 20 AND stddev_pop(close) >= 1e-9 THEN regr_slope(close, -rd)/(stddev_pop(close)+1e-9) ELSE 0 END AS slope
  FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rd FROM v_bars) a WHERE rd <= 20 GROUP BY ticker) b) c""")
def _(m):
    return rounded(ind.trend_slope(m.bars))


ORACLE_VIEWS["v_pmo"] = f"""
SELECT ticker, date, pmo, {ewm('pmo', A[9], 166)} AS pmo_signal FROM (
 SELECT ticker, date, {ewm('s1', A[19], 351)} AS pmo FROM (
  SELECT ticker, date, 10*{ewm('roc', A[34], 627)} AS s1 FROM (
   SELECT ticker, date, {chg('close', 1)}*100 AS roc FROM (SELECT ticker, date, close FROM v_bars UNION ALL SELECT '-', date, close FROM v_bench) b0) a) b) c"""
ORACLE_VIEWS["v_pmo_rs"] = f"""
SELECT t.ticker, t.pmo, t.pmo_signal, s.pmo AS spy_pmo, s.pmo_signal AS spy_pmo_signal, t.pmo - s.pmo AS rs_score,
       clip((t.pmo - s.pmo)/5, -1, 1) AS rs_norm FROM {last('v_pmo')} t JOIN {last('v_pmo')} s ON s.ticker = '-' AND t.ticker <> '-'"""


@query("price_momentum_oscillator", "B-16", "SELECT ticker, date, r6(pmo) AS pmo FROM v_pmo WHERE ticker <> '-'")
def _(m):
    return rounded(ind.pmo(m.series).select("ticker", "date", "pmo"))


@query("pmo_relative_strength", "B-17", """
SELECT ticker, r6(pmo) AS pmo, r6(pmo_signal) AS pmo_signal, r6(spy_pmo) AS spy_pmo, r6(spy_pmo_signal) AS spy_pmo_signal, r6(rs_score) AS rs_score,
       r6(rs_norm) AS rs_norm, CASE WHEN rs_norm > 0.2 THEN 'leading' WHEN rs_norm < -0.2 THEN 'lagging' ELSE 'neutral' END AS trend FROM v_pmo_rs""")
def _(m):
    return rounded(ind.pmo_relative(m.bars, m.bench))


ORACLE_VIEWS["v_rv"] = f"SELECT ticker, date, {roll('stddev_samp', 'r', 30)}*sqrt(252) AS rv30 FROM (SELECT ticker, date, {chg('close', 1)} AS r FROM v_bars) a"


@query("realised_volatility", "B-18", "SELECT ticker, date, r6(rv30) AS rv30 FROM v_rv")
def _(m):
    return rounded(ind.realised_vol(m.bars).select("ticker", "date", "rv30"))


ORACLE_VIEWS["v_rank52"] = """
SELECT ticker, max(high) AS week52_high, min(low) AS week52_low, CASE WHEN max(high) > min(low) THEN clip((arg_max(close, date)-min(low))/(max(high)-min(low)), 0, 1) ELSE 0 END AS week52_rank
FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rd FROM v_bars) a WHERE rd <= 252 GROUP BY ticker"""


@query("range_rank_52_weeks", "B-19", "SELECT ticker, r6(week52_high) AS week52_high, r6(week52_low) AS week52_low, r6(week52_rank) AS week52_rank FROM v_rank52")
def _(m):
    return rounded(ind.range_rank(m.bars))


ORACLE_VIEWS["v_relperf"] = """
SELECT ticker, round(t, 1) AS ticker_return_pct, round(s, 1) AS spy_return_pct, round(t - s, 1) AS alpha_pct, t - s > 0 AS outperforming
FROM (SELECT ticker, (arg_max(close, date)-arg_min(close, date))/arg_min(close, date)*100 AS t FROM v_bars GROUP BY ticker) a,
     (SELECT (arg_max(close, date)-arg_min(close, date))/arg_min(close, date)*100 AS s FROM v_bench) b"""


@query("relative_performance", "B-21", "SELECT ticker, r1(ticker_return_pct) AS ticker_return_pct, r1(spy_return_pct) AS spy_return_pct, r1(alpha_pct) AS alpha_pct, outperforming FROM v_relperf")
def _(m):
    return ind.relative_performance(m.bars, m.bench)


@query("rebased_price_lines", "B-21, D-09", """
SELECT b.ticker, b.date, r6(b.close/first_value(b.close) OVER (PARTITION BY b.ticker ORDER BY b.date)*100) AS ticker_series,
       r6(s.close/first_value(s.close) OVER (PARTITION BY b.ticker ORDER BY b.date)*100) AS spy_series FROM v_bars b JOIN v_bench s ON b.date = s.date""")
def _(m):
    return rounded(ind.rebased_series(m.bars, m.bench))


ORACLE_VIEWS["v_summary"] = f"""
SELECT *, CASE WHEN rsi > 70 THEN -1 WHEN rsi < 30 THEN 1 ELSE 0 END + CASE WHEN sma20 > sma50 THEN 1 ELSE -1 END + CASE WHEN macd > macd_signal THEN 1 ELSE -1 END
         + CASE WHEN close > bb_upper THEN -1.0 WHEN close < bb_lower THEN 1.0 WHEN close > bb_mid THEN 0.5 ELSE 0.0 END AS score
FROM (SELECT * FROM v_ind WHERE sma20 IS NOT NULL AND sma50 IS NOT NULL AND rsi IS NOT NULL AND macd IS NOT NULL AND macd_signal IS NOT NULL AND bb_upper IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1) z"""


@query("indicator_summary", "B-22", """
SELECT ticker, date, CAST(score AS DOUBLE) AS score, CASE WHEN score >= 2 THEN 'BULLISH' WHEN score <= -2 THEN 'BEARISH' ELSE 'MIXED' END AS verdict FROM v_summary""")
def _(m):
    return sig.indicator_summary(ind.common_indicators(m.series)).select("ticker", "date", "score", "verdict")
