"""Structure, level and trade plan queries (inventory family O)."""
from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.exprs import newest, rounded
from tapeloom.operators import composite as cp
from tapeloom.operators import indicators as ind
from tapeloom.operators import scorecards as sc
from tapeloom.operators import signals as sg
from tapeloom.operators import structure as so
from tapeloom.operators.indicators import atr_full
from tapeloom.plans.registry import ORACLE_VIEWS, query
from tapeloom.plans.signals import asof
from tapeloom.plans.sqltext import ewm, last

V = ORACLE_VIEWS
V["v_swing"] = f"""
SELECT *, CASE WHEN turn AND g < 0 THEN max(high) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END AS sh, CASE WHEN turn AND g >= 0 THEN min(low) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END AS sl
FROM (SELECT *, g <> lag(g) OVER (PARTITION BY ticker ORDER BY date) AS turn FROM (SELECT *, coalesce(sign(s - lag(s) OVER (PARTITION BY ticker ORDER BY date)), 0) AS g FROM (SELECT *, {ewm('((high+low)/2)', 0.5, 60)} AS s FROM v_bars) a) b) c"""
V["v_carry"] = """
SELECT *, last_value(sh IGNORE NULLS) OVER w AS last_high, last_value(sl IGNORE NULLS) OVER w AS last_low, last_value(CASE WHEN turn THEN CASE WHEN g < 0 THEN -1 ELSE 1 END END IGNORE NULLS) OVER w AS trend FROM v_swing
WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
V["v_pair"] = """
SELECT ticker, max(sh) FILTER (WHERE kh = 1 AND sh IS NOT NULL) AS h1, max(sh) FILTER (WHERE kh = 2 AND sh IS NOT NULL) AS h2, max(sl) FILTER (WHERE kl = 1 AND sl IS NOT NULL) AS l1, max(sl) FILTER (WHERE kl = 2 AND sl IS NOT NULL) AS l2
FROM (SELECT *, row_number() OVER (PARTITION BY ticker, sh IS NULL ORDER BY date DESC) AS kh, row_number() OVER (PARTITION BY ticker, sl IS NULL ORDER BY date DESC) AS kl FROM v_swing) a GROUP BY ticker"""
V["v_snap"] = f"""
SELECT i.ticker, i.close, i.rsi, i.sma20, i.sma50, i.bb_lower, a.atr, p.h1 AS last_high, p.l1 AS last_low, l.*exclude(ticker),
 CASE WHEN h1 > h2 AND l1 > l2 THEN 'bullish' WHEN h1 < h2 AND l1 < l2 THEN 'bearish' WHEN h2 IS NOT NULL AND l2 IS NOT NULL THEN 'mixed' ELSE 'insufficient' END AS bias
FROM {last('v_ind')} i JOIN {last('v_atr')} a USING (ticker) JOIN v_pair p USING (ticker) JOIN (
 SELECT ticker, count(*) AS n, count(*) >= 20 AND avg(volume) FILTER (WHERE rd <= 5) > avg(volume)*1.3 AS vol_surge, coalesce(list_sort(list(sh) FILTER (WHERE sh IS NOT NULL)), []) AS highs, coalesce(list_reverse_sort(list(sl) FILTER (WHERE sl IS NOT NULL)), []) AS lows
 FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rd FROM v_swing) z WHERE rd <= 20 GROUP BY ticker) l USING (ticker)"""
V["v_setup"] = """
SELECT *, CASE WHEN n < 20 THEN 'RANGE' WHEN bias = 'bearish' AND close <= last_low*1.005 THEN 'BREAKDOWN' WHEN close >= last_high*0.995 AND (vol_surge OR bias = 'bullish') THEN 'BREAKOUT' WHEN rsi < 30 THEN 'MEAN_REVERSION'
 WHEN (close-sma50)/sma50 < -0.08 THEN 'MEAN_REVERSION' WHEN bias = 'bullish' AND close < last_high*0.97 THEN 'PULLBACK' ELSE 'RANGE' END AS setup_type FROM v_snap"""
V["v_ee1"] = """
SELECT *, highs[len(highs)] AS top, lows[1] AS bot, list_filter(lows, lambda x: x < close)[1] AS sup, list_filter(highs, lambda x: x > close)[1] AS res, coalesce(list_filter(lows, lambda x: x < close)[1], sma20, sma50) AS anchor FROM v_setup"""
V["v_ee2"] = """
SELECT *, CASE setup_type WHEN 'BREAKOUT' THEN round(top*1.001, 2) WHEN 'PULLBACK' THEN round(least(anchor*1.002, close*0.999), 2) WHEN 'MEAN_REVERSION' THEN round(CASE WHEN bb_lower < close*0.99 THEN bb_lower WHEN sma20 IS NOT NULL THEN sma20*0.97 ELSE close*0.97 END, 2)
 WHEN 'RANGE' THEN CASE WHEN sup IS NOT NULL THEN round(least(sup*1.002, close*0.999), 2) END END AS entry FROM v_ee1"""
V["v_ee3"] = """
SELECT *, CASE WHEN entry IS NULL THEN NULL ELSE CASE setup_type WHEN 'BREAKOUT' THEN round(coalesce(bot*0.997, entry-2*atr), 2) WHEN 'PULLBACK' THEN round(coalesce(list_filter(lows, lambda x: x < anchor*0.995)[1]*0.997, anchor*0.97), 2) WHEN 'MEAN_REVERSION' THEN round(entry*0.97, 2) WHEN 'RANGE' THEN round(sup*0.97, 2) END END AS stop_loss,
 CASE WHEN entry IS NULL THEN NULL ELSE CASE setup_type WHEN 'BREAKOUT' THEN round(entry+1.5*atr, 2) WHEN 'PULLBACK' THEN round(coalesce(list_filter(highs, lambda x: x > entry)[1], entry+2*atr), 2) WHEN 'MEAN_REVERSION' THEN round(coalesce(sma20, entry*1.04), 2) WHEN 'RANGE' THEN round(coalesce(res, entry+2*atr), 2) END END AS tp1 FROM v_ee2"""
V["v_ee"] = """
SELECT *, CASE WHEN entry IS NULL THEN NULL ELSE round(CASE setup_type WHEN 'BREAKOUT' THEN coalesce(list_filter(highs, lambda x: x > tp1*1.01)[1], entry+3*atr) WHEN 'PULLBACK' THEN coalesce(list_filter(highs, lambda x: x > entry)[2], entry+3*atr)
 WHEN 'MEAN_REVERSION' THEN coalesce(sma50, sma20*1.03, entry*1.08) WHEN 'RANGE' THEN tp1*1.02 END, 2) END AS tp2, CAST(floor(100/(close*(atr/close)*sqrt(252))) AS BIGINT) AS vol_adj_shares FROM v_ee3"""


@query("swing_points", "O-01", "SELECT ticker, date, sh AS swing_high, sl AS swing_low FROM v_swing")
def _(m):
    return so.swings(m.bars).select("ticker", "date", "swing_high", "swing_low")


@query("swing_carry_forward", "O-02", "SELECT ticker, date, last_high, last_low, CAST(trend AS INT) AS trend FROM v_carry")
def _(m):
    return so.carried(so.swings(m.bars)).select("ticker", "date", "last_high", "last_low", "trend")


@query("structure_bias", "O-03", "SELECT ticker, last_high, last_low, bias FROM v_snap")
def _(m):
    return so.snapshot(m.series).select("ticker", "last_high", "last_low", "bias")


@query("setup_class", "O-04", "SELECT ticker, setup_type FROM v_setup")
def _(m):
    return so.setup_type(so.snapshot(m.series)).select("ticker", "setup_type")


@query("structural_levels", "O-05", "SELECT ticker, array_to_string(list_transform(highs, lambda x: printf('%.4f', x)), ',') AS swing_highs, array_to_string(list_transform(lows, lambda x: printf('%.4f', x)), ',') AS swing_lows FROM v_snap")
def _(m):
    def shown(c):
        return F.array_join(F.transform(c, lambda x: F.format_string("%.4f", x)), ",").alias(c)
    return so.snapshot(m.series).select("ticker", shown("swing_highs"), shown("swing_lows"))


@query("setup_entry_exit", "O-06, O-07, O-08", "SELECT ticker, setup_type, bias, entry, stop_loss, tp1, tp2, vol_adj_shares FROM v_ee")
def _(m):
    return so.entry_exit(so.setup_type(so.snapshot(m.series))).select("ticker", "setup_type", "bias", "entry", "stop_loss", "tp1", "tp2", "vol_adj_shares")


V["v_pivot"] = """
SELECT ticker, (h+l+c)/3 AS p, h, l FROM (SELECT ticker, arg_min(high, date) AS h, arg_min(low, date) AS l, arg_min(close, date) AS c FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rd FROM v_bars) a WHERE rd <= 2 GROUP BY ticker) b"""


@query("pivot_points", "O-09", 'SELECT ticker, r2(p) AS "PP", r2(2*p-l) AS "R1", r2(p+(h-l)) AS "R2", r2(h+2*(p-l)) AS "R3", r2(2*p-h) AS "S1", r2(p-(h-l)) AS "S2", r2(l-2*(h-p)) AS "S3" FROM v_pivot')
def _(m):
    return so.pivot_points(m.bars)


_f = "(PARTITION BY ticker ORDER BY date ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)"
V["v_levels"] = f"""
SELECT ticker, list_reverse_sort(list_distinct(list(round(high, 2)) FILTER (WHERE hk <= 5)))[1:3] AS resistance, list_sort(list_distinct(list(round(low, 2)) FILTER (WHERE lk <= 5)))[1:3] AS support
FROM (SELECT *, CASE WHEN ish THEN row_number() OVER (PARTITION BY ticker, ish ORDER BY date DESC) END AS hk, CASE WHEN isl THEN row_number() OVER (PARTITION BY ticker, isl ORDER BY date DESC) END AS lk FROM (
 SELECT *, count(*) OVER {_f} >= 10 AND high = max(high) OVER {_f} AS ish, count(*) OVER {_f} >= 10 AND low = min(low) OVER {_f} AS isl FROM v_bars) a) b GROUP BY ticker"""


@query("centred_swing_levels", "O-10", "SELECT ticker, array_to_string(resistance, ',') AS resistance, array_to_string(support, ',') AS support FROM v_levels")
def _(m):
    return so.swing_levels(m.bars, most=3, newest=5).select("ticker", F.array_join("resistance", ",").alias("resistance"), F.array_join("support", ",").alias("support"))


def quick_scores(m):
    votes = cp.indicator_votes(ind.common_indicators(m.series)).select("ticker", F.lit("technical").alias("family"), "status")
    cards = sc.fundamental_signals(m.info).select("ticker", F.lit("fundamental").alias("family"), "status")
    return cp.combined_score(votes.unionByName(cards))


V["v_trade"] = f"""
SELECT *, round((entry-stop_loss)*side, 2) AS risk_per_share, round((take_profit-entry)*side, 2) AS reward_per_share FROM (
 SELECT s.ticker, s.verdict, side, CASE WHEN side IS NOT NULL THEN round(b.close, 2) END AS entry, round(b.close-side*a.atr, 2) AS stop_loss, round(b.close+side*3*a.atr, 2) AS take_profit
 FROM (SELECT *, CASE verdict WHEN 'BUY' THEN 1 WHEN 'SELL / AVOID' THEN -1 END AS side FROM v_score_quick) s JOIN {last('v_bars')} b ON b.ticker = s.ticker JOIN {last('v_atr')} a ON a.ticker = s.ticker) z"""


@query("atr_trade_levels", "O-11", "SELECT ticker, verdict, entry, stop_loss, take_profit, risk_per_share, reward_per_share, CASE WHEN risk_per_share > 0 THEN round(reward_per_share/risk_per_share, 2) END AS risk_reward_ratio FROM v_trade")
def _(m):
    m.staged()
    priced = newest(atr_full(m.bars), "close", "atr").join(quick_scores(m).select("ticker", "verdict"), "ticker")
    return so.trade_levels(priced).select("ticker", "verdict", "entry", "stop_loss", "take_profit", "risk_per_share", "reward_per_share", "risk_reward_ratio")


V["v_plan0"] = """
SELECT e.*, q.confidence, q.verdict, q.f AS fundamental, l.support, l.resistance, i.target_mean AS analyst_target, r.week52_rank, z.zone AS altman_zone, o.trend AS momentum_trend, i.short_pct_float*100 AS short_pct, d.days_away AS earnings_days,
 t.trend AS sector_trend, (SELECT arg_max(vix, date) FROM v_vix) AS vix, p.score AS piotroski, coalesce(q.confidence >= 0.65, false) AS hi
FROM v_ee e JOIN v_score_quick q USING (ticker) JOIN v_levels l USING (ticker) JOIN v_info i USING (ticker) JOIN v_rank52 r USING (ticker) JOIN v_altman z USING (ticker) JOIN v_mom o USING (ticker) JOIN v_due d USING (ticker)
JOIN v_sectors s USING (ticker) JOIN v_sector_trend t ON t.sector = s.sector JOIN v_pio p USING (ticker)"""
V["v_plan1"] = """
SELECT *, CASE WHEN valid THEN (close-entry)/close ELSE least(base + adj, CASE WHEN buy THEN 0.03 ELSE 0.05 END) END AS disc FROM (
 SELECT *, CASE WHEN buy THEN CASE WHEN conviction = 'high' AND strong THEN 0.003 WHEN conviction = 'high' THEN 0.007 WHEN conviction = 'medium' THEN 0.010 ELSE 0.015 END ELSE CASE conviction WHEN 'high' THEN 0.010 WHEN 'medium' THEN 0.018 ELSE 0.025 END END::DOUBLE AS base,
  (CASE WHEN near THEN 0.005 ELSE 0 END + CASE WHEN sector_trend = 'downtrend' THEN 0.003 ELSE 0 END + CASE WHEN altman_zone = 'distress' THEN 0.005 ELSE 0 END + CASE WHEN short_pct >= 20 THEN 0.003 ELSE 0 END + CASE WHEN NOT buy AND week52_rank > 0.9 THEN 0.008 ELSE 0 END)::DOUBLE AS adj
 FROM (SELECT *, CASE WHEN confidence >= 0.65 THEN 'high' WHEN confidence >= 0.45 THEN 'medium' ELSE 'low' END AS conviction, coalesce(earnings_days > 0 AND earnings_days <= 14, false) AS near, momentum_trend IN ('strong_up', 'up') AS strong, verdict = 'BUY' AS buy,
  coalesce(abs(entry-close)/close < 0.08 AND (setup_type = 'BREAKOUT' OR entry <= close*1.001), false) AS valid, list_reverse_sort(list_filter(support, lambda x: x < close)) AS sups FROM v_plan0) a) b"""
V["v_plan2"] = """
SELECT *, CASE WHEN valid THEN entry ELSE coalesce(list_filter(sups, lambda x: x >= close - close*(disc*1.5) AND abs(x - close*(1-disc))/close < 0.015)[1]*0.997, close*(1-disc)) END AS lim FROM v_plan1"""
V["v_plan3"] = """
SELECT *, CASE WHEN near AND s0 < lim*0.97 THEN lim*0.97 ELSE s0 END AS stp FROM (SELECT *, CASE WHEN stop_loss < lim AND stop_loss > lim*0.9 THEN stop_loss ELSE coalesce(list_filter(sups, lambda x: x < lim*0.995 AND x*0.995 > lim-1.5*atr)[1]*0.995, CASE WHEN lim-1.5*atr < lim*0.92 THEN lim*0.95 ELSE lim-1.5*atr END) END AS s0 FROM v_plan2) a"""
V["v_plan4"] = """
SELECT *, CASE WHEN tp1 >= min1 THEN tp1 WHEN analyst_target > close AND analyst_target*0.95 >= min1 THEN least(wall, analyst_target*0.95) ELSE wall END AS t1 FROM (
 SELECT *, coalesce(list_min(list_filter(walls, lambda x: x >= min1)), min1) AS wall FROM (SELECT *, lim + greatest(lim-stp, atr) AS min1, lim + greatest((lim-stp)*1.5, atr*2) AS min2, list_filter(resistance, lambda x: x > lim) AS walls FROM v_plan3) a) b"""
V["v_plan"] = """
SELECT *, CASE WHEN tp2 > t1*1.01 AND tp2 >= min2 THEN tp2 ELSE coalesce(list_min(list_filter(walls, lambda x: x > t1*1.01 AND x >= min2)), CASE WHEN analyst_target >= min2 THEN analyst_target END, greatest(min2, lim+3*atr)) END AS t2 FROM v_plan4"""


def plan_of(m):
    m.staged("v_bars", "v_info", "v_statements")
    setups = so.entry_exit(so.setup_type(so.snapshot(m.series)))
    years = sc.statement_years(m.statements)
    vix = m.vix.agg(F.max_by("vix", "date").alias("vix"))
    rows = (setups.join(quick_scores(m).select("ticker", "confidence", "verdict", "fundamental"), "ticker").join(so.swing_levels(m.bars, most=3, newest=5), "ticker")
            .join(m.info.select("ticker", F.col("target_mean").alias("analyst_target"), (F.col("short_pct_float") * 100).alias("short_pct")), "ticker")
            .join(ind.range_rank(m.bars).select("ticker", "week52_rank"), "ticker").join(sc.altman_market(years, m.info).select("ticker", F.col("zone").alias("altman_zone")), "ticker")
            .join(ind.momentum(m.bars).select("ticker", F.col("trend").alias("momentum_trend")), "ticker")
            .join(sg.next_earnings(m.earnings, asof()).select("ticker", F.col("days_away").alias("earnings_days")), "ticker")
            .join(m.sectors.join(sg.sector_trend(m.etf).select("sector", F.col("trend").alias("sector_trend")), "sector").select("ticker", "sector_trend"), "ticker")
            .join(sc.piotroski(years).select("ticker", F.col("score").alias("piotroski")), "ticker").crossJoin(F.broadcast(vix)))   # one row
    return so.trade_plan(rows)


@query("trade_plan", "O-12", """
SELECT ticker, conviction, r2(lim) AS limit_entry, r2(stp) AS stop_loss, r2(t1) AS take_profit_1, r2(t2) AS take_profit_2, r1(CASE WHEN lim > stp THEN (t1-lim)/(lim-stp) ELSE 0 END) AS risk_reward, r1(disc*100) AS discount_pct,
 CASE WHEN strong AND conviction = 'high' THEN '2–6 weeks (momentum trade)' WHEN conviction = 'high' AND fundamental > 0.4 THEN '2–4 months (fundamental + momentum)' WHEN conviction = 'medium' THEN '4–8 weeks (wait for catalyst)' ELSE '1–2 weeks (speculative; tight stops)' END AS time_horizon,
 CAST(round(CASE WHEN vix IS NULL OR vix <= 15 THEN 100.0 WHEN vix >= 25 THEN 0.0 ELSE 100 - (vix-15)/10*100 END/5)*5 AS INT) AS position_size_pct, setup_type FROM v_plan""")
def _(m):
    p = plan_of(m)
    return p.select("ticker", "conviction", F.round("limit_entry", 2).alias("limit_entry"), F.round("stop", 2).alias("stop_loss"), F.round("take_profit_1", 2).alias("take_profit_1"),
                    F.round("take_profit_2", 2).alias("take_profit_2"), F.round((F.col("take_profit_1") - F.col("limit_entry")) / (F.col("limit_entry") - F.col("stop")), 1).alias("risk_reward"),
                    F.round(F.col("_disc") * 100, 1).alias("discount_pct"), "time_horizon", "position_size_pct", "setup_type")


@query("exit_conditions", "O-13", """
SELECT ticker, concat_ws(chr(10), printf('Price drops below stop $%.2f — close position', stp),
 CASE WHEN fundamental > 0.3 THEN 'Fundamentals deteriorate (earnings miss >10%, guidance cut) — re-evaluate' END,
 CASE WHEN piotroski >= 6 THEN printf('Piotroski score drops below 5 (currently %d/9) — financial health weakening', piotroski) END,
 printf('Take 50%% off at TP1 ($%.2f), let rest run to TP2 ($%.2f)', t1, t2),
 CASE WHEN strong THEN 'MACD crosses below signal AND RSI drops below 45 — momentum broken, exit remaining' ELSE 'RSI drops below 35 and price closes below 50-day SMA — trend broken' END,
 CASE WHEN earnings_days <> 0 AND earnings_days <= 30 THEN printf('Earnings in %dd — consider taking profit before if up >5%%, re-enter after if thesis intact', earnings_days) END,
 CASE WHEN sector_trend = 'downtrend' THEN 'Sector still in downtrend — size smaller, exit faster on any weakness' END,
 'Re-evaluate thesis in 4–8 weeks if price hasn''t moved toward TP1') AS exit_conditions FROM v_plan""")
def _(m):
    return so.exit_conditions(plan_of(m)).select("ticker", F.concat_ws("\n", "exit_conditions").alias("exit_conditions"))
