"""Factor analysis and composite scoring queries (inventory families J and I)."""
from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.exprs import newest, rounded
from tapeloom.operators import composite as cp
from tapeloom.operators import factors as fa
from tapeloom.operators import features as ft
from tapeloom.operators import indicators as ind
from tapeloom.operators import labels as lb
from tapeloom.operators import scorecards as sc
from tapeloom.operators import signals as sg
from tapeloom.plans.labels import predictions
from tapeloom.plans.registry import ORACLE_VIEWS, query
from tapeloom.plans.signals import BUILT
from tapeloom.plans.sqltext import chg, last, roll

J1 = {
    "rsi_signal": "(50-rsi)/50", "macd_signal_val": "tanh((macd-macd_signal)/close*100)",
    "momentum_5d": f"clip({chg('close', 5)}, -0.2, 0.2)", "momentum_21d": f"clip({chg('close', 21)}, -0.3, 0.3)",
    "bb_position": "clip((close-bb_lower)/nullif(bb_upper-bb_lower,0)*2-1, -1, 1)",
    "volume_surge": f"clip(volume/nullif({roll('avg', 'volume', 20)},0)-1, -1, 2)",
    "price_vs_sma20": "clip((close-sma20)/sma20, -0.15, 0.15)", "price_vs_sma50": "clip((close-sma50)/sma50, -0.2, 0.2)",
    "trend_strength": f"clip({roll('regr_slope({x}, rn)', 'close', 10)}/close, -0.05, 0.05)",
    "volatility_regime": f"clip({roll('stddev_samp', 'r', 10)}/nullif({roll('stddev_samp', 'r', 60)},0)-1, -1, 1)"}
ORACLE_VIEWS["v_psig"] = "SELECT ticker, date, close, " + ", ".join(f"{s} AS {n}" for n, s in J1.items()) + f"""
FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date)::DOUBLE AS rn, {chg('close', 1)} AS r FROM v_ind) z"""


@query("price_signals", "J-01", "SELECT ticker, date, " + ", ".join(f"r6({n}) AS {n}" for n in J1) + " FROM v_psig")
def _(m):
    return rounded(fa.price_signals(m.series).select("ticker", "date", *fa.SIGNALS))


ORACLE_VIEWS["v_psig_long"] = " UNION ALL ".join(f"SELECT ticker, date, close, '{n}' AS signal, {n} AS value FROM v_psig" for n in J1)
ORACLE_VIEWS["v_pairs"] = " UNION ALL ".join(
    f"SELECT * FROM (SELECT s.ticker, s.signal, {h} AS horizon, value, f.fwd FROM v_psig_long s JOIN (SELECT ticker, date, lead(close, {h}) OVER (PARTITION BY ticker ORDER BY date)/close - 1 AS fwd FROM v_bars) f USING (ticker, date)) q WHERE value IS NOT NULL AND fwd IS NOT NULL" for h in fa.HORIZONS)
ORACLE_VIEWS["v_ic"] = """
SELECT *, ic*sqrt(n)/sqrt(greatest(1-ic*ic, 1e-10)) AS tstat FROM (
 SELECT ticker, signal, horizon, CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN corr(x, y) END AS ic, count(*) AS n FROM (
  SELECT ticker, signal, horizon, rank() OVER (PARTITION BY ticker, signal, horizon ORDER BY value) + (count(*) OVER (PARTITION BY ticker, signal, horizon, value) - 1)/2.0 AS x,
         rank() OVER (PARTITION BY ticker, signal, horizon ORDER BY fwd) + (count(*) OVER (PARTITION BY ticker, signal, horizon, fwd) - 1)/2.0 AS y FROM v_pairs) a GROUP BY ticker, signal, horizon HAVING count(*) >= 10) b"""
ORACLE_VIEWS["v_icsum"] = """
SELECT ticker, signal, avg(abs(ic)) AS mean_ic_abs, avg(ic) AS mean_ic, max(abs(tstat)) AS max_tstat, count(*) FILTER (WHERE ic > 0) >= 3 OR count(*) FILTER (WHERE ic < 0) >= 3 AS consistent FROM v_ic GROUP BY ticker, signal"""


def signals_of(m):
    return fa.price_signals(m.series)


@query("information_coefficient", "J-02", "SELECT ticker, signal, CAST(horizon AS INT) AS horizon, r6(ic) AS ic, n, r5(tstat) AS tstat FROM v_ic")
def _(m):
    return rounded(fa.time_series_ic(signals_of(m)), tstat=5)


@query("rolling_information_coefficient", "J-03", """
SELECT ticker, date, r6(ic) AS rolling_ic FROM (
 SELECT ticker, date, CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN corr(x, y) END AS ic, count(*) AS n, any_value(rn) AS rn FROM (
  SELECT ticker, date, rn, rank() OVER (PARTITION BY ticker, date ORDER BY value) + (count(*) OVER (PARTITION BY ticker, date, value) - 1)/2.0 AS x,
         rank() OVER (PARTITION BY ticker, date ORDER BY fwd) + (count(*) OVER (PARTITION BY ticker, date, fwd) - 1)/2.0 AS y
  FROM (SELECT a.ticker, a.date, a.rn, b.value, b.fwd FROM v_roll a JOIN v_roll b ON b.ticker = a.ticker AND b.rn BETWEEN a.rn - 62 AND a.rn WHERE b.value IS NOT NULL AND b.fwd IS NOT NULL) p) q
 GROUP BY ticker, date) r WHERE n >= 30 AND rn >= 63 AND ic IS NOT NULL""")
def _(m):
    return rounded(fa.rolling_ic(signals_of(m), "momentum_21d"))


ORACLE_VIEWS["v_roll"] = "SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn, momentum_21d AS value, lead(close, 5) OVER (PARTITION BY ticker ORDER BY date)/close - 1 AS fwd FROM v_psig"


@query("ic_summary", "J-04", "SELECT ticker, signal, r6(mean_ic_abs) AS mean_ic_abs, r6(mean_ic) AS mean_ic, r5(max_tstat) AS max_tstat, consistent FROM v_icsum")
def _(m):
    return rounded(fa.ic_summary(fa.time_series_ic(signals_of(m))), max_tstat=5)


@query("exploratory_signal_table", "J-05", f"""
SELECT s.ticker, s.signal, r6(mean_ic_abs) AS mean_ic_abs, r6(l.value) AS current_value, CASE WHEN mean_ic >= 0 THEN 'normal' ELSE 'contrarian' END AS direction
FROM v_icsum s JOIN (SELECT * FROM v_psig_long QUALIFY row_number() OVER (PARTITION BY ticker, signal ORDER BY date DESC) = 1) l USING (ticker, signal) WHERE mean_ic_abs >= 0.05 AND l.value IS NOT NULL""")
def _(m):
    m.staged()
    signals = signals_of(m)
    return rounded(fa.exploratory_table(fa.ic_summary(fa.time_series_ic(signals)), signals))


ORACLE_VIEWS["v_swept"] = f"""
SELECT ticker, date, {', '.join(ft.FEATURES)}, {', '.join(f'lead(close, {h}) OVER (PARTITION BY ticker ORDER BY date)/close - 1 AS f{h}' for h in fa.SWEEP)} FROM v_panel"""
ORACLE_VIEWS["v_swept_ok"] = "SELECT * FROM v_swept WHERE " + " AND ".join(f"f{h} IS NOT NULL" for h in fa.SWEEP)
ORACLE_VIEWS["v_swept_long"] = f"UNPIVOT v_swept_ok ON {', '.join(ft.FEATURES)} INTO NAME feature VALUE value"
ORACLE_VIEWS["v_sweep"] = "SELECT feature, " + ", ".join(f"avg(ic_{h}d) AS ic_{h}d" for h in fa.SWEEP) + " FROM (SELECT date, feature, " + ", ".join(
    f"CASE WHEN stddev_pop(x) > 1e-9 AND stddev_pop(y{h}) > 1e-9 THEN corr(x, y{h}) END AS ic_{h}d" for h in fa.SWEEP) + """
 FROM (SELECT date, feature, rank() OVER (PARTITION BY date, feature ORDER BY value) + (count(*) OVER (PARTITION BY date, feature, value) - 1)/2.0 AS x, """ + ", ".join(
    f"rank() OVER (PARTITION BY date, feature ORDER BY f{h}) + (count(*) OVER (PARTITION BY date, feature, f{h}) - 1)/2.0 AS y{h}" for h in fa.SWEEP) + " FROM v_swept_long) a GROUP BY date, feature) b GROUP BY feature"


def sweep_of(m):
    return fa.ic_sweep(ft.impute(lb.training_panel(ft.feature_frame(m.staged()), m.bench)), ft.FEATURES)


@query("ic_decay_sweep", "J-06", "SELECT feature, " + ", ".join(f"r5(ic_{h}d) AS ic_{h}d" for h in fa.SWEEP) + " FROM v_sweep")
def _(m):
    return rounded(sweep_of(m), 5)


_best = "CASE greatest(" + ", ".join(f"abs(ic_{h}d)" for h in fa.SWEEP) + ") " + " ".join(f"WHEN abs(ic_{h}d) THEN {h}" for h in fa.SWEEP) + " END"


@query("best_horizon_counts", "J-07", f"SELECT CAST({_best} AS INT) AS best_horizon, count(*) AS n_features FROM v_sweep GROUP BY 1")
def _(m):
    return fa.horizon_counts(sweep_of(m))


@query("pruning_candidates", "J-08", "SELECT feature FROM v_sweep WHERE greatest(" + ", ".join(f"abs(ic_{h}d)" for h in fa.SWEEP) + ") < 0.06")
def _(m):
    return fa.pruning_candidates(sweep_of(m), 0.06)


ORACLE_VIEWS["v_zs"] = "SELECT ticker, date, " + ", ".join(
    f"coalesce(CASE WHEN count({n}) OVER u >= 30 THEN clip(({n} - avg({n}) OVER u)/nullif(stddev_samp({n}) OVER u, 0), -3, 3)/3 END, 0) AS {n}" for n in J1) + """
FROM v_psig WINDOW u AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
ORACLE_VIEWS["v_zs_long"] = " UNION ALL ".join(f"SELECT ticker, date, '{n}' AS signal, {n} AS z FROM v_zs" for n in J1)
ORACLE_VIEWS["v_comp"] = """
SELECT z.ticker, z.date, CASE WHEN sum(i.mean_ic_abs) > 0 THEN sum(CASE WHEN i.mean_ic >= 0 THEN 1 ELSE -1 END * i.mean_ic_abs * z.z)/sum(i.mean_ic_abs) END AS composite
FROM v_zs_long z LEFT JOIN v_icsum i ON i.ticker = z.ticker AND i.signal = z.signal AND i.mean_ic_abs >= 0.05 GROUP BY z.ticker, z.date"""


def composite_of(m):
    signals = signals_of(m.staged())
    return fa.composite(signals, fa.ic_summary(fa.time_series_ic(signals)))


@query("ic_weighted_composite", "I-08", "SELECT ticker, date, r6(composite) AS composite FROM v_comp")
def _(m):
    return rounded(composite_of(m))


ORACLE_VIEWS["v_verdict"] = f"SELECT ticker, composite, CASE WHEN composite > 0.15 THEN 'BUY' WHEN composite < -0.15 THEN 'SELL' WHEN composite IS NOT NULL THEN 'HOLD' END AS verdict FROM {last('v_comp')} z"


@query("composite_verdict", "I-09", "SELECT ticker, r6(composite) AS composite, verdict FROM v_verdict")
def _(m):
    return rounded(fa.composite_verdict(composite_of(m)))


@query("verdict_prediction_agreement", "I-10", f"""
SELECT v.ticker, verdict, CASE WHEN b IS NULL OR s IS NULL THEN 'none' WHEN b = s THEN 'same' ELSE 'opposite' END AS agreement FROM (
 SELECT v.*, CASE verdict WHEN 'BUY' THEN 1 WHEN 'SELL' THEN -1 END AS b, CASE WHEN p.pred_return > 0 THEN 1 WHEN p.pred_return < 0 THEN -1 END AS s FROM v_verdict v JOIN {last('v_pred')} p ON p.ticker = v.ticker) v""")
def _(m):
    verdicts = fa.composite_verdict(composite_of(m))
    now = newest(predictions(m.bars), "pred_return").select("ticker", "pred_return")
    return cp.agreement(verdicts, now).select("ticker", "verdict", "agreement")


# Part of the assembly are all built signals but this one, which is shown apart.
APART = ("pmo_signal",)
ASSEMBLED = {name: built for name, built in BUILT.items() if name not in APART}
_SIGS = {"volume": "v_volsig", **{n: v for n, (_, v, _) in ASSEMBLED.items()}}
ORACLE_VIEWS["v_volsig"] = f"SELECT ticker, 'Volume' AS label, CASE WHEN vol_ratio > 1.5 AND close > pc THEN 'good' WHEN vol_ratio > 1.5 AND close < pc THEN 'warning' ELSE 'neutral' END AS status FROM {last('v_volume')} z"
ORACLE_VIEWS["v_indvotes"] = """
SELECT ticker, 'RSI' AS label, CASE WHEN rsi > 70 THEN 'warning' WHEN rsi < 30 THEN 'good' ELSE 'neutral' END AS status FROM v_summary
UNION ALL SELECT ticker, 'Trend', CASE WHEN sma20 > sma50 THEN 'good' ELSE 'warning' END FROM v_summary
UNION ALL SELECT ticker, 'Momentum', CASE WHEN macd > macd_signal THEN 'good' ELSE 'warning' END FROM v_summary
UNION ALL SELECT ticker, 'Volatility', CASE WHEN close > bb_upper THEN 'warning' WHEN close < bb_lower OR close > bb_mid THEN 'good' ELSE 'neutral' END FROM v_summary"""
ORACLE_VIEWS["v_cardsig"] = """
SELECT ticker, 'Balance Sheet' AS label, status FROM v_balsig
UNION ALL SELECT ticker, 'Piotroski F-Score', CASE WHEN score >= 7 THEN 'good' WHEN score <= 3 THEN 'warning' ELSE 'neutral' END FROM v_pio
UNION ALL SELECT ticker, 'Advanced Valuation', status FROM v_val
UNION ALL SELECT ticker, 'Share Count', CASE share_trend WHEN 'buyback' THEN 'good' WHEN 'diluting' THEN 'warning' ELSE 'neutral' END FROM v_shares
UNION ALL SELECT ticker, 'Altman Z-Score', CASE zone WHEN 'safe' THEN 'good' WHEN 'distress' THEN 'warning' ELSE 'neutral' END FROM v_altman"""
ORACLE_VIEWS["v_allsig"] = " UNION ALL ".join([f"SELECT ticker, 'technical' AS family, label, status FROM {v}" for v in (*_SIGS.values(), "v_indvotes", "v_cardsig")]
                                              + ["SELECT ticker, 'fundamental', label, status FROM v_fundsig", "SELECT ticker, 'sentiment', CAST(doc_id AS VARCHAR), sentiment FROM v_relnews"])


def technical_signals(m):
    """The eighteen tuples and the four indicator votes of every ticker."""
    years = sc.statement_years(m.statements)
    parts = [sg.volume_signal(m.bars), *[build(m) for _, _, build in ASSEMBLED.values()], cp.indicator_votes(ind.common_indicators(m.series)),
             sc.balance_signal(sc.balance_trends(m.statements)), sc.piotroski_signal(sc.piotroski(years)),
             sc.advanced_valuation(m.info).select("ticker", F.lit("Advanced Valuation").alias("label"), "status"),
             sc.share_signal(sc.share_count(years)), sc.altman_signal(sc.altman_market(years, m.info))]
    out = None
    for part in parts:
        row = part.select("ticker", F.lit("technical").alias("family"), "label", "status")
        out = row if out is None else out.unionByName(row)
    return out


def all_signals(m, news: bool = True):
    m.staged("v_bars", "v_info", "v_statements")
    out = technical_signals(m).unionByName(sc.fundamental_signals(m.info).select("ticker", F.lit("fundamental").alias("family"), "label", "status"))
    if news:
        companies = m.part.groupBy(F.col("p_brand").alias("ticker")).agg(F.min("p_name").alias("company"))
        found = sg.relevant_news(m.news, companies, most=10, least=3)
        out = out.unionByName(found.select("ticker", F.lit("sentiment").alias("family"), F.col("doc_id").cast("string").alias("label"), F.col("sentiment").alias("status")))
    return out


@query("signal_assembly", "I-05", "SELECT ticker, family, label, status FROM v_allsig")
def _(m):
    return all_signals(m)


VOTE = "CASE WHEN regexp_matches(lower(status), 'good|bullish|beat|positive') THEN 1.0 WHEN regexp_matches(lower(status), 'warning|bearish|miss|negative') THEN -1.0 ELSE 0.0 END"


@query("status_votes", "I-01", f"SELECT doc_id, ticker, CAST({VOTE.replace('status', 'text')} AS DOUBLE) AS vote FROM v_news")
def _(m):
    return m.news.select("doc_id", "ticker", cp.vote(F.col("text")).alias("vote"))


def scored(source):
    return f"""
SELECT *, CASE WHEN score >= 0.25 THEN 'BUY' WHEN score <= -0.25 THEN 'SELL / AVOID' ELSE 'HOLD / WATCH' END AS verdict, t*f < 0 AND abs(t) > 0.3 AND abs(f) > 0.3 AS conflicted,
  CASE WHEN n_signals > 1 THEN clip(1 - s, 0, 1) ELSE 1.0 END AS confidence
FROM (SELECT *, clip(0.40*t + 0.35*f + 0.25*n, -1, 1) AS score FROM (
  SELECT ticker, coalesce(avg(v) FILTER (WHERE family = 'technical'), 0) AS t, coalesce(avg(v) FILTER (WHERE family = 'fundamental'), 0) AS f, coalesce(avg(v) FILTER (WHERE family = 'sentiment'), 0) AS n,
         count(*) AS n_signals, stddev_samp(v) AS s FROM (SELECT ticker, family, ({VOTE})::DOUBLE AS v FROM {source} WHERE family <> 'sentiment' OR status <> 'unknown') a GROUP BY ticker) b) c"""


ORACLE_VIEWS["v_score"] = scored("v_allsig")
ORACLE_VIEWS["v_score_quick"] = scored("(SELECT ticker, 'technical' AS family, status FROM v_indvotes UNION ALL SELECT ticker, 'fundamental', status FROM v_fundsig)")


@query("weighted_verdict", "I-02, I-03, I-04", """
SELECT ticker, r6(t) AS technical, r6(f) AS fundamental, r6(n) AS sentiment, n_signals, r6(score) AS score, verdict, conflicted, r6(confidence) AS confidence FROM v_score""")
def _(m):
    return rounded(cp.combined_score(all_signals(m)))


@query("screener", "I-12", "SELECT ticker, r6(score) AS score, verdict, r6(confidence) AS confidence, CASE verdict WHEN 'BUY' THEN 3 WHEN 'HOLD / WATCH' THEN 2 ELSE 1 END AS verdict_rank FROM v_score")
def _(m):
    return rounded(cp.screener(cp.combined_score(all_signals(m))))


@query("watchlist_verdict", "I-13", f"""
SELECT w.ticker, b.close, r6((b.close-b.pc)/b.pc*100) AS change_pct, s.verdict, r6(s.confidence) AS confidence FROM v_watchlist w JOIN {last('v_volume')} b ON b.ticker = w.ticker JOIN v_score_quick s ON s.ticker = w.ticker""")
def _(m):
    m.staged()
    bars = m.bars.join(m.watchlist, "ticker", "left_semi")
    votes = cp.indicator_votes(ind.common_indicators(bars)).select("ticker", F.lit("technical").alias("family"), "status")
    cards = sc.fundamental_signals(m.info.join(m.watchlist, "ticker", "left_semi")).select("ticker", F.lit("fundamental").alias("family"), "status")
    quick = cp.combined_score(votes.unionByName(cards)).select("ticker", "verdict", "confidence")
    return cp.last_change(bars).join(quick, "ticker").select("ticker", "close", F.round("change_pct", 6).alias("change_pct"), "verdict", F.round("confidence", 6).alias("confidence"))


def _two(c, a, b):
    return f"CASE WHEN {c} > {a} THEN 1.0 WHEN {c} < {b} THEN -1.0 ELSE 0.0 END"


RULES = ["CASE WHEN rsi < 0.35 THEN 1.0 WHEN rsi > 0.7 THEN -1.0 ELSE 0.0 END", "CASE WHEN macd_above_signal > 0.5 THEN 1.0 ELSE -1.0 END", "CASE WHEN sma20_vs_sma50 > 0 THEN 1.0 ELSE -1.0 END",
         "CASE WHEN bb_position < 0.3 THEN 1.0 WHEN bb_position > 0.7 THEN -1.0 ELSE 0.0 END", _two("cmf_20d", 0.05, -0.05), "CASE WHEN volume_surge_20d > 0.2 THEN 1.0 ELSE 0.0 END", _two("alpha_21d", 0.01, -0.01),
         _two("high_52w_proximity", 0.85, 0.6), _two("revenue_growth", 0.05, 0), _two("profit_margin", 0.1, 0), _two("roe", 0.1, 0), _two("fcf_yield", 0.02, 0), _two("piotroski_score", 0.6, 0.3),
         _two("analyst_score", 0.3, -0.3), _two("insider_net_ratio", 0.1, -0.1)]
ORACLE_VIEWS["v_rule"] = f"SELECT ticker, date, label, atr_pct, rule_score, (rule_score - min(rule_score) OVER ())/(max(rule_score) OVER () - min(rule_score) OVER () + 1e-8) AS rule_signal FROM (SELECT *, CAST({' + '.join(RULES)} AS DOUBLE)/15 AS rule_score FROM v_panel) z"


def panel_of(m):
    return ft.impute(lb.training_panel(ft.feature_frame(m.staged()), m.bench))


@query("rule_score", "I-06, I-07", "SELECT ticker, date, r6(rule_score) AS rule_score, r6(rule_signal) AS rule_signal FROM v_rule")
def _(m):
    return rounded(cp.min_max(cp.rule_score(panel_of(m)), "rule_score", "rule_signal").select("ticker", "date", "rule_score", "rule_signal"))
