"""Label and cross-section queries (inventory families E and F)."""
from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.exprs import by_ticker, change, newest, rolling, rounded
from tapeloom.operators import crosssection as xs
from tapeloom.operators import features as ft
from tapeloom.operators import labels as lb
from tapeloom.operators import indicators as ind
from tapeloom.operators import scorecards as sc
from tapeloom.operators import signals as sg
from tapeloom.operators.indicators import atr_partial
from tapeloom.plans.registry import ORACLE_VIEWS, query
from tapeloom.plans.signals import asof
from tapeloom.plans.sqltext import W, chg, last, roll


@query("triple_barrier_label", "E-01", "SELECT ticker, date, label FROM v_label")
def _(m):
    return lb.barrier_label(atr_partial(m.bars)).select("ticker", "date", "label")


def barrier_sql(target, stop, days):
    return f"""
SELECT x.*, CASE WHEN n_after < {days} THEN 'NEUTRAL' WHEN k_sl IS NOT NULL AND k_sl <= coalesce(k_tp, 999) THEN 'LOSS' WHEN k_tp IS NOT NULL THEN 'WIN' ELSE 'NEUTRAL' END AS label
FROM (SELECT a.ticker, a.date, count(b.rn) AS n_after, min(CASE WHEN b.high >= a.close + {target}*a.w THEN b.rn - a.rn END) AS k_tp, min(CASE WHEN b.low <= a.close - {stop}*a.w THEN b.rn - a.rn END) AS k_sl
      FROM (SELECT v.*, t.atr_pct*v.close AS w FROM v_rn v JOIN v_atr t USING (ticker, date)) a
      LEFT JOIN v_rn b ON b.ticker = a.ticker AND b.rn > a.rn AND b.rn <= a.rn + {days} GROUP BY a.ticker, a.date, a.rn) x"""


ORACLE_VIEWS["v_meta"] = barrier_sql(2.0, 1.0, 10)
# A prediction the SQL side can compute too: mean reversion to the 20-bar mean.
ORACLE_VIEWS["v_pred"] = f"SELECT ticker, date, close, {roll('avg', 'close', 20)}/close - 1 AS pred_return, {roll('stddev_samp', 'close', 20)}/close AS std_20 FROM v_bars"
ORACLE_VIEWS["v_oos"] = """
SELECT * FROM (SELECT *, clip(lead(close, 5) OVER (PARTITION BY ticker ORDER BY date)/close - 1, -0.25, 0.25) AS fwd_return FROM v_pred) a
WHERE pred_return IS NOT NULL AND fwd_return IS NOT NULL"""


def predictions(bars):
    """pred_return, std_20 on full bars."""
    mean, sigma = rolling(F.avg, F.col("close"), 20), rolling(F.stddev_samp, F.col("close"), 20)
    return bars.select("ticker", "date", "close", (mean / F.col("close") - 1).alias("pred_return"), (sigma / F.col("close")).alias("std_20"))


def oos(m, days: int = 5):
    """Out-of-sample style rows: prediction and realised forward return."""
    return lb.add_target(predictions(m.bars), days).filter(F.col("pred_return").isNotNull())


@query("parameterised_barrier", "E-02", "SELECT ticker, date, label FROM v_meta")
def _(m):
    return lb.barrier_label(atr_partial(m.bars), target=2.0, stop=1.0, lookahead=10).select("ticker", "date", "label")


@query("long_call_filter", "E-03", "SELECT l.ticker, l.date, (l.label = 'WIN')::INT AS meta_label FROM v_label l JOIN v_pred p USING (ticker, date) WHERE p.pred_return > 0 AND l.label <> 'NEUTRAL'")
def _(m):
    labelled = lb.barrier_label(atr_partial(m.bars))
    called = labelled.withColumn("pred_return", rolling(F.avg, F.col("close"), 20) / F.col("close") - 1)
    return lb.long_calls(called).select("ticker", "date", "meta_label")


@query("forward_return_target", "E-04", "SELECT ticker, date, r6(clip(f, -0.25, 0.25)) AS fwd_return FROM (SELECT ticker, date, lead(close, 5) OVER (PARTITION BY ticker ORDER BY date)/close - 1 AS f FROM v_bars) a WHERE f IS NOT NULL")
def _(m):
    return rounded(lb.add_target(m.bars, 5).select("ticker", "date", "fwd_return"))


@query("multi_horizon_targets", "E-05", "SELECT ticker, date, " + ", ".join(f"r6(clip(lead(close, {n}) OVER (PARTITION BY ticker ORDER BY date)/close - 1, -0.25, 0.25)) AS fwd_{n}" for n in (1, 3, 5, 10, 21)) + " FROM v_bars")
def _(m):
    return rounded(lb.add_targets(m.bars).drop("open", "high", "low", "close", "volume"))


@query("market_regime", "E-06", "SELECT b.ticker, b.date, coalesce(g.market_regime, 'neutral') AS market_regime FROM v_bars b LEFT JOIN v_regime g USING (date)")
def _(m):
    return lb.with_regime(m.bars, m.bench).select("ticker", "date", "market_regime")


ORACLE_VIEWS["v_evbar"] = f"""
SELECT t.ticker, t.date, t.close, t.rn, s.close AS spy, avg(tr) OVER {W(14, 't.ticker')}/(t.close+1e-8) AS atr, CASE WHEN count(*) OVER {W(252, 't.ticker')} >= 50 THEN max(t.close) OVER {W(252, 't.ticker')} END AS h52
FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn FROM v_tr) t JOIN v_bench s ON s.date = t.date""".replace("ORDER BY date ROWS", "ORDER BY t.date ROWS")
ORACLE_VIEWS["v_events"] = """
SELECT *, CASE WHEN relative_ret_30d > 0.03 THEN 'WIN' ELSE 'LOSS' END AS label, (relative_ret_30d > 0.03)::INT AS label_binary FROM (
 SELECT e.ticker, e.earnings_date, n.date AS entry_date, clip(s, -0.5, 0.5) AS surprise_pct, clip(p, -0.5, 0.5) AS prev_surprise_pct, clip(s - p, -0.5, 0.5) AS surprise_acceleration,
  clip(n.close/a.close - 1 - (n.spy - a.spy)/(a.spy+1e-8), -0.5, 0.5) AS pre_ret_1m_vs_spy, clip(n.close/b.close - 1 - (n.spy - b.spy)/(b.spy+1e-8), -0.5, 0.5) AS pre_ret_3m_vs_spy,
  clip(coalesce(k.atr, 0.02), 0, 0.2) AS atr_pct, clip(n.close/(coalesce(k.h52, n.close)+1e-8), 0, 1) AS high_52w_proximity,
  (x.close - n.close)/(n.close+1e-8) - (x.spy - n.spy)/(n.spy+1e-8) AS relative_ret_30d
 FROM (SELECT ticker, earnings_date, surprise_pct/100 AS s, coalesce(lag(surprise_pct/100) OVER (PARTITION BY ticker ORDER BY earnings_date), 0) AS p, count(*) OVER (PARTITION BY ticker) AS n_rep
       FROM v_earnings WHERE surprise_pct IS NOT NULL) e
 ASOF JOIN v_evbar n ON n.ticker = e.ticker AND n.date >= e.earnings_date
 ASOF LEFT JOIN v_evbar k ON k.ticker = e.ticker AND k.date <= e.earnings_date
 JOIN v_evbar x ON x.ticker = n.ticker AND x.rn = n.rn + 30 JOIN v_evbar a ON a.ticker = n.ticker AND a.rn = n.rn - 21 JOIN v_evbar b ON b.ticker = n.ticker AND b.rn = n.rn - 63
 WHERE n_rep >= 4) z WHERE abs(relative_ret_30d) > 0.03"""
EV = ("surprise_pct", "prev_surprise_pct", "surprise_acceleration", "pre_ret_1m_vs_spy", "pre_ret_3m_vs_spy", "atr_pct", "high_52w_proximity", "relative_ret_30d")


@query("earnings_event_set", "E-07, E-08, E-09, E-10, E-11", "SELECT ticker, earnings_date, entry_date, " + ", ".join(f"r6({c}) AS {c}" for c in EV) + ", label, label_binary FROM v_events")
def _(m):
    m.staged()
    return rounded(lb.earnings_events(m.earnings, m.bars, m.bench))


@query("event_fundamentals_median_fill", "E-12", "SELECT e.ticker, e.earnings_date, " + ", ".join(
    f"r6(coalesce(f.{c}, (SELECT median(g.{c}) FROM v_events d LEFT JOIN v_fund g ON g.ticker = d.ticker))) AS {c}" for c in lb.EVENT_FUNDAMENTALS) + " FROM v_events e LEFT JOIN v_fund f ON f.ticker = e.ticker")
def _(m):
    m.staged()
    events = lb.earnings_events(m.earnings, m.bars, m.bench)
    filled = lb.with_event_fundamentals(events, ft.fundamental_features(m.info, m.statements))
    return rounded(filled.select("ticker", "earnings_date", *lb.EVENT_FUNDAMENTALS))


Z2 = ("pred_return", "std_20")


@query("zscore_by_date", "F-02", "SELECT ticker, date, " + ", ".join(
    f"r6(coalesce(({c} - avg({c}) OVER (PARTITION BY date))/CASE WHEN stddev_pop({c}) OVER (PARTITION BY date) < 1e-12 THEN 1 ELSE stddev_pop({c}) OVER (PARTITION BY date) END, 0)) AS z_{c}" for c in Z2) + " FROM v_pred")
def _(m):
    return rounded(xs.zscores(predictions(m.bars), list(Z2)).select("ticker", "date", "z_pred_return", "z_std_20"))


LIVE_Z = tuple(c for cols in xs.PILLARS_LIVE.values() for c in cols)
# What a ticker without a value counts as; an unknown safety score is left to the z-score.
ORACLE_VIEWS["v_coppock_live"] = f"SELECT ticker, CASE WHEN coppock > 0 THEN clip(coppock/50, 0.3, 1) WHEN coppock < 0 THEN -clip(coppock/-50, 0.3, 1) ELSE 0 END AS signal FROM {last('v_coppock')} z"
ORACLE_VIEWS["v_slope_live"] = """
SELECT ticker, clip(slope/0.2, -1, 1) AS signal FROM (
  SELECT ticker, CASE WHEN count(*) = 20 AND stddev_pop(close) >= 1e-9 THEN regr_slope(close, -rd)/(stddev_pop(close)+1e-9) ELSE 0 END AS slope
  FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rd FROM v_bars) a WHERE rd <= 20 GROUP BY ticker) b"""
ORACLE_VIEWS["v_live_inputs"] = f"""
SELECT i.ticker, coalesce(c.signal, 0.0) AS coppock, coalesce(r.signal, 0.0) AS ridge_slope, coalesce(v.vol_ratio, 1.0) AS vol_ratio, coalesce(i.short_pct_float, 0.0) AS short_pct_float,
  coalesce(i.short_ratio, 0.0) AS short_ratio, coalesce(a.upside_pct, 0.0) AS analyst_upside, coalesce(nullif(p.put_call_ratio, 0), 1.0) AS put_call_ratio, z.z_score AS altman_z
FROM v_info i LEFT JOIN v_coppock_live c ON c.ticker = i.ticker LEFT JOIN v_slope_live r ON r.ticker = i.ticker LEFT JOIN {last('v_volume')} v ON v.ticker = i.ticker
  LEFT JOIN v_analyst a ON a.ticker = i.ticker LEFT JOIN v_pcr p ON p.ticker = i.ticker LEFT JOIN v_altman z ON z.ticker = i.ticker"""


def live_inputs(m):
    """One row per ticker with the inputs of the live pillars."""
    m.staged("v_bars", "v_info", "v_statements")
    parts = [ind.coppock_signal(m.bars).select("ticker", F.col("signal").alias("coppock")), ind.trend_slope(m.bars).select("ticker", F.col("signal").alias("ridge_slope")),
             newest(ind.volume_indicators(m.bars), "vol_ratio").select("ticker", "vol_ratio"), sg.analyst_signal(m.info, m.bars).select("ticker", F.col("upside_pct").alias("analyst_upside")),
             sg.put_call(m.options, asof()).select("ticker", "put_call_ratio"),
             sc.altman_market(sc.statement_years(m.statements), m.info).select("ticker", F.col("z_score").alias("altman_z"))]
    joined = m.info.select("ticker", "short_pct_float", "short_ratio")
    for part in parts:
        joined = joined.join(part, "ticker", "left")
    filled = joined.fillna({"coppock": 0.0, "ridge_slope": 0.0, "vol_ratio": 1.0, "short_pct_float": 0.0, "short_ratio": 0.0, "analyst_upside": 0.0, "put_call_ratio": 1.0})
    return filled.withColumn("put_call_ratio", F.when(F.col("put_call_ratio") == 0, 1.0).otherwise(F.col("put_call_ratio")))


ORACLE_VIEWS["v_zlive"] = "SELECT ticker, " + ", ".join(f"coalesce(({c} - avg({c}) OVER ())/CASE WHEN stddev_pop({c}) OVER () > 1e-12 THEN stddev_pop({c}) OVER () END, 0) AS z_{c}" for c in LIVE_Z) + " FROM v_live_inputs"
ORACLE_VIEWS["v_pillars"] = "SELECT ticker, " + ", ".join(f"({' + '.join('z_' + c for c in cols)})/{len(cols)} AS pillar_{n}" for n, cols in xs.PILLARS_LIVE.items()) + " FROM v_zlive"


@query("zscore_over_batch", "F-03", "SELECT ticker, " + ", ".join(f"r6(z_{c}) AS z_{c}" for c in LIVE_Z) + " FROM v_zlive")
def _(m):
    return rounded(xs.batch_zscores(live_inputs(m), list(LIVE_Z)).select("ticker", *[f"z_{c}" for c in LIVE_Z]))


def live_pillars(m):
    return xs.pillar_means(xs.batch_zscores(live_inputs(m), list(LIVE_Z)), xs.PILLARS_LIVE)


@query("pillar_means_live", "F-04", "SELECT ticker, " + ", ".join(f"r6(pillar_{n}) AS pillar_{n}" for n in xs.PILLARS_LIVE) + " FROM v_pillars")
def _(m):
    return rounded(live_pillars(m).select("ticker", *[f"pillar_{n}" for n in xs.PILLARS_LIVE]))


_PZ = [c for cols in xs.PILLARS_TRAINING.values() for c in cols]
ORACLE_VIEWS["v_zfeat"] = "SELECT ticker, date, " + ", ".join(
    f"coalesce(({c} - avg({c}) OVER (PARTITION BY date))/CASE WHEN stddev_pop({c}) OVER (PARTITION BY date) < 1e-12 THEN 1 ELSE stddev_pop({c}) OVER (PARTITION BY date) END, 0) AS z_{c}" for c in _PZ) + " FROM v_feat"
ORACLE_VIEWS["v_pillar_train"] = "SELECT ticker, date, " + ", ".join(f"({' + '.join('z_' + c for c in cols)})/{len(cols)} AS pillar_{n}" for n, cols in xs.PILLARS_TRAINING.items()) + " FROM v_zfeat"


@query("pillar_means_training", "F-02, F-04", "SELECT ticker, date, " + ", ".join(f"r5(pillar_{n}) AS pillar_{n}" for n in xs.PILLARS_TRAINING) + " FROM v_pillar_train")
def _(m):
    scored = xs.pillar_means(xs.zscores(ft.feature_frame(m.staged()), _PZ), xs.PILLARS_TRAINING)
    return rounded(scored.select("ticker", "date", *[f"pillar_{n}" for n in xs.PILLARS_TRAINING]), 5)


@query("linear_pillar_score", "F-05", "SELECT ticker, r6(0.25*pillar_momentum + 0.25*pillar_squeeze + 0.25*pillar_catalyst + 0.25*pillar_safety) AS score FROM v_pillars")
def _(m):
    means = live_pillars(m)
    return rounded(xs.linear_score(means, {f"pillar_{n}": 0.25 for n in xs.PILLARS_LIVE}).select("ticker", "score").orderBy(F.desc("score"), "ticker"))


ORACLE_VIEWS["v_pct"] = """
SELECT *, (rank() OVER (PARTITION BY date ORDER BY pred_return) + (count(*) OVER (PARTITION BY date, pred_return) - 1)/2.0)/count(*) OVER (PARTITION BY date) AS pct FROM v_oos"""


@query("percentile_rank_average_ties", "F-06", "SELECT ticker, date, r6(pct) AS pct FROM v_pct")
def _(m):
    return rounded(xs.percentile_rank(oos(m), "pred_return").select("ticker", "date", "pct"))


def legs_sql(q, least, source="v_oos"):
    return f"""
SELECT *, 1 AS leg FROM (SELECT *, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY pred_return DESC, ticker DESC) AS k FROM {source}) a WHERE n >= {least} AND k <= {q}
UNION ALL SELECT *, -1 FROM (SELECT *, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY pred_return, ticker) AS k FROM {source}) a WHERE n >= {least} AND k <= {q}"""


ORACLE_VIEWS["v_leg5"] = legs_sql("greatest(1, n // 5)", 5)
ORACLE_VIEWS["v_leg10"] = legs_sql("greatest(1, floor(n*0.1))", 10)


@query("top_bottom_quintile", "F-07", "SELECT ticker, date, leg FROM v_leg5")
def _(m):
    return xs.legs(oos(m), "pred_return", 0.2, least=5).select("ticker", "date", "leg")


@query("quantile_bucket_returns", "F-08", """
SELECT bucket, r6(mean_return) AS mean_return, n, mean_return > lag(mean_return) OVER (ORDER BY bucket) AS rising FROM (
 SELECT bucket, avg(fwd_return) AS mean_return, count(*) AS n FROM (
  SELECT fwd_return, CAST(CASE WHEN n > 1 THEN greatest(1, ceil(5*(rn-1)/(n-1))) ELSE 1 END AS INT) AS bucket FROM (
   SELECT *, row_number() OVER (PARTITION BY date ORDER BY pred_return, ticker) AS rn, count(*) OVER (PARTITION BY date) AS n FROM v_oos) a) b GROUP BY bucket) c""")
def _(m):
    return rounded(xs.bucket_returns(xs.quantile_buckets(oos(m), "pred_return"), "fwd_return"))


@query("top_n_selection", "F-09", legs_sql("3", 10).join(["SELECT ticker, date, leg FROM (", ") z"]))
def _(m):
    return xs.legs(oos(m), "pred_return", count=3, least=10).select("ticker", "date", "leg")


@query("median_split_hit_rate", "F-10", """
SELECT count(*) AS n_days, count(*) FILTER (WHERE top > bottom) AS n_won, r6(avg((top > bottom)::INT)) AS hit_rate FROM (
 SELECT date, avg(fwd_return) FILTER (WHERE pred_return >= med) AS top, avg(fwd_return) FILTER (WHERE pred_return < med) AS bottom
 FROM (SELECT *, median(pred_return) OVER (PARTITION BY date) AS med, count(*) OVER (PARTITION BY date) AS n FROM v_oos) a WHERE n >= 10 GROUP BY date) b WHERE top IS NOT NULL AND bottom IS NOT NULL""")
def _(m):
    return rounded(xs.median_split_hits(oos(m), "pred_return", "fwd_return"))


@query("pairwise_return_correlation", "F-11", f"""
SELECT ticker_a, ticker_b, r6(c) AS correlation, n, CASE WHEN c > 0.75 THEN 'concentrated' WHEN c < 0.25 THEN 'diversifying' ELSE 'neutral' END AS flag FROM (
 SELECT a.ticker AS ticker_a, b.ticker AS ticker_b, corr(a.r, b.r) AS c, count(*) AS n FROM (SELECT ticker, date, {chg('close', 1)} AS r FROM v_bars) a
 JOIN (SELECT ticker, date, {chg('close', 1)} AS r FROM v_bars) b ON a.date = b.date AND a.ticker < b.ticker WHERE a.r IS NOT NULL AND b.r IS NOT NULL
   AND a.ticker IN (SELECT ticker FROM v_watchlist) AND b.ticker IN (SELECT ticker FROM v_watchlist) GROUP BY 1, 2) z""")
def _(m):
    held = m.bars.join(m.watchlist, "ticker", "left_semi")
    returns = held.select("ticker", "date", change("close", 1).alias("ret")).dropna()
    return rounded(xs.return_correlations(returns))
