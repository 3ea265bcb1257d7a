"""Feature panel queries (inventory family C)."""
from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.exprs import rounded
from tapeloom.operators import features as ft
from tapeloom.operators import labels as lb
from tapeloom.plans.registry import ORACLE_VIEWS, query
from tapeloom.plans.sqltext import W, chg, lag, last, roll

TECH_SQL = {
    "volume_surge_20d": f"clip(volume/(avg(volume) OVER {W(20)}+1e-8)-1, -1, 3)",
    "vma_20": f"clip({roll('avg', 'volume', 20)}/(close*1e4), 0, 10)",
    "kmid": "clip((close-open)/(open+1e-8), -0.5, 0.5)", "klen": "clip((high-low)/(open+1e-8), -0.5, 0.5)",
    "kup": "clip((high-greatest(open,close))/(open+1e-8), -0.5, 0.5)", "klow": "clip((least(open,close)-low)/(open+1e-8), -0.5, 0.5)",
    "ksft": "clip((close*2-high-low)/(open+1e-8), -0.5, 0.5)",
    "high_52w_proximity": f"clip(close/{roll('max', 'close', 252)}, 0, 1)",
    "max_20": f"clip({roll('max', 'high', 20)}/close, 0, 2)", "min_20": f"clip({roll('min', 'low', 20)}/close, 0, 1)",
    "qtlu_10": f"clip({roll('quantile_cont({x}, 0.8)', 'close', 10)}/close, 0, 2)",
    "qtld_10": f"clip({roll('quantile_cont({x}, 0.2)', 'close', 10)}/close, 0, 1)",
    "rank_10": f"CASE WHEN count(*) OVER {W(10)} = 10 THEN len(list_filter(list(close) OVER {W(10)}, lambda v: v < close))/10 END",
    "roc_21d": f"clip({chg('close', 21)}, -0.5, 0.5)", "roc_5": f"clip({chg('close', 5)}, -0.5, 0.5)",
    "roc_10": f"clip({chg('close', 10)}, -0.5, 0.5)", "roc_60": f"clip({chg('close', 60)}, -0.5, 0.5)",
}
for n in (5, 10, 20, 60):
    TECH_SQL[f"ma_{n}"] = f"clip({roll('avg', 'close', n)}/close, -0.5, 1.5)"
    TECH_SQL[f"std_{n}"] = f"clip({roll('stddev_samp', 'close', n)}/close, 0, 1)"
for n in (5, 10, 20):
    TECH_SQL[f"beta_{n}"] = f"clip(CASE WHEN count(*) OVER {W(n)} = {n} THEN regr_slope(close, rn) OVER {W(n)} END/close, -0.5, 0.5)"
for n in (10, 20):
    TECH_SQL[f"rsqr_{n}"] = f"CASE WHEN count(*) OVER {W(n)} = {n} THEN clip(regr_r2(close, rn) OVER {W(n)}, 0, 1) END"
    TECH_SQL[f"resi_{n}"] = (f"CASE WHEN count(*) OVER {W(n)} = {n} THEN clip(list_avg(list_transform(list({{'y': close, 't': rn}}) OVER {W(n)}, "
                             f"lambda s: abs(s.y - (regr_intercept(close, rn) OVER {W(n)} + (regr_slope(close, rn) OVER {W(n)})*s.t))))/(avg(close) OVER {W(n)}+1e-8), 0, 1) END")

ORACLE_VIEWS["v_rn"] = "SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date)::DOUBLE AS rn, count(*) OVER (PARTITION BY ticker) AS n_bars FROM v_bars"
ORACLE_VIEWS["v_rn100"] = "SELECT * FROM v_rn WHERE n_bars >= 100"


def _resi(n):
    return f"""SELECT ticker, date, CASE WHEN len(ys) = {n} THEN clip(list_avg(list_transform(ys, lambda s: abs(s.y - (a + b*s.t))))/(mean+1e-8), 0, 1) END AS resi_{n}
FROM (SELECT ticker, date, list({{'y': close, 't': rn}}) OVER {W(n)} AS ys, regr_intercept(close, rn) OVER {W(n)} AS a, regr_slope(close, rn) OVER {W(n)} AS b, avg(close) OVER {W(n)} AS mean FROM v_rn100) q"""


ORACLE_VIEWS["v_resi_10"], ORACLE_VIEWS["v_resi_20"] = _resi(10), _resi(20)
DIRECT = {k: v for k, v in TECH_SQL.items() if not k.startswith("resi") and k != "rank_10"}
ORACLE_VIEWS["v_steps"] = f"""
SELECT ticker, date, len(list_filter(cs, lambda v: v < close))/10 AS rank_w, corr_w, up, dn, n10 FROM (
  SELECT ticker, date, close, list(close) OVER {W(10)} AS cs, count(*) OVER {W(10)} AS n10,
         CASE WHEN count(dc) FILTER (WHERE dv IS NOT NULL) OVER {W(10)} = 10 THEN corr(dc, dv) OVER {W(10)} END AS corr_w,
         count(*) FILTER (WHERE dc > 0) OVER {W(9)} AS up, count(*) FILTER (WHERE dc < 0) OVER {W(9)} AS dn
  FROM (SELECT ticker, date, close, {chg('close', 1)} AS dc, {chg('volume', 1)} AS dv FROM v_rn100) a) b"""
ORACLE_VIEWS["v_tech0"] = "SELECT ticker, date, " + ", ".join(f"{sql} AS {name}" for name, sql in DIRECT.items()) + f", {chg('close', 21)} AS ret21 FROM v_rn100"
ORACLE_VIEWS["v_spy21"] = "SELECT date, close/lag(close, 21) OVER (ORDER BY date) - 1 AS s21 FROM v_bench"
ORACLE_VIEWS["v_etf21"] = "SELECT sector, date, close/lag(close, 21) OVER (PARTITION BY sector ORDER BY date) - 1 AS e21 FROM v_etf"
ORACLE_VIEWS["v_cmf"] = f"""
SELECT ticker, date, clip({roll('sum', 'mf', 20)} / nullif({roll('sum', 'volume', 20)}, 0), -1, 1) AS cmf_20d
FROM (SELECT ticker, date, volume, ((close-low)-(high-close))/(high-low+1e-8)*volume AS mf FROM v_bars) a"""
ORACLE_VIEWS["v_tech"] = """
SELECT t.*, clip(i.rsi, 0, 100)/100 AS rsi, CASE WHEN i.macd > i.macd_signal THEN 1.0::DOUBLE ELSE 0.0 END AS macd_above_signal,
  clip((i.close-i.bb_lower)/(i.bb_upper-i.bb_lower+1e-8), 0, 1) AS bb_position, clip(i.sma20/(i.sma50+1e-8)-1, -0.5, 0.5) AS sma20_vs_sma50,
  a.atr_pct, c.cmf_20d, clip(t.ret21 - s.s21, -0.5, 0.5) AS alpha_21d, clip(t.ret21 - e.e21, -0.5, 0.5) AS sector_alpha_21d,
  r1.resi_10, r2.resi_20, CASE WHEN p.n10 = 10 THEN p.rank_w END AS rank_10, clip(p.corr_w, -1, 1) AS corr_10,
  CASE WHEN p.n10 = 10 THEN p.up/10 END AS cntp_10, CASE WHEN p.n10 = 10 THEN p.dn/10 END AS cntn_10
FROM v_tech0 t JOIN v_ind i USING (ticker, date) JOIN v_atr a USING (ticker, date) JOIN v_cmf c USING (ticker, date)
LEFT JOIN v_spy21 s USING (date) LEFT JOIN v_sectors z USING (ticker) LEFT JOIN v_etf21 e ON e.sector = z.sector AND e.date = t.date
JOIN v_resi_10 r1 USING (ticker, date) JOIN v_resi_20 r2 USING (ticker, date) JOIN v_steps p USING (ticker, date)"""
ORACLE_VIEWS["v_fund"] = """
SELECT i.ticker, clip(trailing_pe, -100, 100) AS pe_ratio, clip(forward_pe, -100, 100) AS forward_pe, profit_margin, roe, clip(debt_to_equity, -50, 50) AS debt_to_equity,
  revenue_growth, earnings_growth, CASE WHEN free_cashflow <> 0 AND market_cap > 0 THEN clip(free_cashflow/market_cap, -0.5, 0.5) END AS fcf_yield,
  CASE WHEN y.ta0 > 0 THEN clip(gross_profit/y.ta0, -1, 2) END AS gross_profitability, p.score8/9 AS piotroski_score, clip(z.z_book, -5, 15) AS altman_z,
  short_pct_float AS short_interest_pct
FROM v_info i LEFT JOIN v_years y USING (ticker) LEFT JOIN v_pio8 p USING (ticker) LEFT JOIN v_altbook z USING (ticker)"""
OVERLAID = ("revenue_growth", "profit_margin", "roe", "debt_to_equity")
_COLS = ", ".join([f"t.{c}" for c in ft.TECHNICAL]
                  + [f"coalesce(p.{c}, f.{c}) AS {c}" if c in OVERLAID else f"f.{c}" for c in ft.FUNDAMENTAL]
                  + ["f.short_interest_pct", "n.insider_net_ratio", "a.analyst_score"])
ORACLE_VIEWS["v_feat"] = f"""
SELECT b.ticker, b.date, b.high, b.low, b.close, {_COLS} FROM v_bars b ASOF LEFT JOIN v_pit p ON b.ticker = p.ticker AND b.date >= p.filed_date
JOIN v_tech t ON t.ticker = b.ticker AND t.date = b.date LEFT JOIN v_fund f ON f.ticker = b.ticker
JOIN v_ins n ON n.ticker = b.ticker AND n.date = b.date JOIN v_ana a ON a.ticker = b.ticker AND a.date = b.date"""
_LIVE = _COLS
for _c in OVERLAID:
    _LIVE = _LIVE.replace(f"coalesce(p.{_c}, f.{_c}) AS {_c}", f"f.{_c}")
ORACLE_VIEWS["v_feat_live"] = f"""
SELECT b.ticker, b.date, {_LIVE} FROM v_bars b JOIN v_tech t ON t.ticker = b.ticker AND t.date = b.date LEFT JOIN v_fund f ON f.ticker = b.ticker
JOIN v_ins n ON n.ticker = b.ticker AND n.date = b.date JOIN v_ana a ON a.ticker = b.ticker AND a.date = b.date"""


def group(name, covers, columns, build):
    sql = "SELECT ticker, date, " + ", ".join(f"r6({c}) AS {c}" for c in columns) + " FROM v_tech"
    sql += " WHERE 1 = 1"

    @query(name, covers, sql)
    def _(m):
        return rounded(build(m).select("ticker", "date", *columns))


def priced(m):
    return ft.price_features(m.series)


group("oscillator_features", "C-01, C-02", ["rsi", "macd_above_signal"], lambda m: ft.oscillator_features(m.series))
group("band_features", "C-03, C-04", ["bb_position", "sma20_vs_sma50"], priced)
group("volume_features", "C-05, C-06, C-07, C-23", ["volume_surge_20d", "atr_pct", "cmf_20d", "vma_20"], priced)
group("return_features", "C-08, C-11", ["roc_21d", "roc_5", "roc_10", "roc_60", "high_52w_proximity"], priced)
group("relative_return_features", "C-09, C-10", ["alpha_21d", "sector_alpha_21d"], lambda m: ft.relative_features(priced(m.staged()), m.bench, m.sectors, m.etf))
group("candle_features", "C-12", ["kmid", "klen", "kup", "klow", "ksft"], priced)
group("level_features", "C-13, C-14, C-18", [f"{a}_{n}" for a in ("ma", "std") for n in (5, 10, 20, 60)] + ["max_20", "min_20"], priced)
group("regression_features", "C-15, C-16, C-17", ["beta_5", "beta_10", "beta_20", "rsqr_10", "rsqr_20", "resi_10", "resi_20"], priced)
group("order_features", "C-19, C-20, C-22", ["qtlu_10", "qtld_10", "rank_10", "cntp_10", "cntn_10"], priced)
group("correlation_features", "C-21", ["corr_10"], priced)


@query("fundamental_features", "C-24, C-25, C-26, C-27, C-28, C-29", "SELECT ticker, " + ", ".join(f"r6({c}) AS {c}" for c in (*ft.FUNDAMENTAL, "short_interest_pct")) + " FROM v_fund")
def _(m):
    return rounded(ft.fundamental_features(m.info, m.statements).select("ticker", *ft.FUNDAMENTAL, "short_interest_pct"))


@query("feature_contract", "C-32", "SELECT ticker, date, high, low, close, " + ", ".join(f"r6({c}) AS {c}" for c in ft.FEATURES) + " FROM v_feat")
def _(m):
    out = ft.feature_frame(m.staged())
    return out.select("ticker", "date", "high", "low", "close", *[F.round(c, 6).alias(c) for c in ft.FEATURES])


ORACLE_VIEWS["v_label"] = """
SELECT x.*, CASE WHEN n_after < 21 THEN 'NEUTRAL' WHEN k_sl IS NOT NULL AND k_sl <= coalesce(k_tp, 99) THEN 'LOSS' WHEN k_tp IS NOT NULL THEN 'WIN' ELSE 'NEUTRAL' END AS label
FROM (SELECT a.ticker, a.date, a.rn, count(b.rn) AS n_after, min(CASE WHEN b.high >= a.close + 3.0*a.w THEN b.rn - a.rn END) AS k_tp, min(CASE WHEN b.low <= a.close - 1.5*a.w THEN b.rn - a.rn END) AS k_sl
      FROM (SELECT v.*, t.atr_pct*v.close AS w FROM v_rn v JOIN v_atr t USING (ticker, date)) a
      LEFT JOIN v_rn b ON b.ticker = a.ticker AND b.rn > a.rn AND b.rn <= a.rn + 21 GROUP BY a.ticker, a.date, a.rn) x"""
ORACLE_VIEWS["v_regime"] = """
SELECT date, CASE WHEN r > 0.03 THEN 'bull' WHEN r < -0.03 THEN 'bear' ELSE 'neutral' END AS market_regime FROM (SELECT date, close/lag(close, 63) OVER (ORDER BY date) - 1 AS r FROM v_bench) a"""
ORACLE_VIEWS["v_panel_raw"] = """
SELECT * FROM (SELECT f.*, l.label, coalesce(g.market_regime, 'neutral') AS market_regime, (l.label = 'WIN')::INT AS label_binary, count(*) OVER (PARTITION BY f.ticker) AS n_kept
FROM v_feat f JOIN v_label l ON l.ticker = f.ticker AND l.date = f.date LEFT JOIN v_regime g ON g.date = f.date WHERE l.rn > 60 AND l.label <> 'NEUTRAL') q WHERE n_kept >= 30"""


def imputed(source, columns, keep):
    d = ", ".join(f"coalesce({c}, median({c}) OVER (PARTITION BY date)) AS {c}" for c in columns)
    g = ", ".join(f"coalesce({c}, (SELECT median({c}) FROM daily), 0.0) AS {c}" for c in columns)
    return f"WITH daily AS MATERIALIZED (SELECT {keep}, {d} FROM {source}) SELECT {keep}, {g} FROM daily"


ORACLE_VIEWS["v_panel"] = imputed("v_panel_raw", ft.FEATURES, "ticker, date, high, low, close, market_regime, label, label_binary")


@query("training_panel", "C-33, F-01", "SELECT ticker, date, high, low, close, market_regime, label, label_binary, " + ", ".join(f"r6({c}) AS {c}" for c in ft.FEATURES) + " FROM v_panel")
def _(m):
    out = ft.impute(lb.training_panel(ft.feature_frame(m.staged()), m.bench))
    return out.select("ticker", "date", "high", "low", "close", "market_regime", "label", "label_binary", *[F.round(c, 6).alias(c) for c in ft.FEATURES])


ORACLE_VIEWS["v_live"] = imputed(f"{last('v_feat_live')} z", ft.FEATURES, "ticker, date")


@query("live_snapshot", "C-34", "SELECT ticker, date, " + ", ".join(f"r6({c}) AS {c}" for c in ft.FEATURES) + " FROM v_live")
def _(m):
    out = ft.live_snapshot(ft.feature_frame(m.staged(), with_overlay=False))
    return out.select("ticker", "date", *[F.round(c, 6).alias(c) for c in ft.FEATURES])
