"""Market, sentiment and event signal queries (inventory family H)."""
from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions import messages as M
from tapeloom.functions.exprs import rounded
from tapeloom.operators import indicators as ind
from tapeloom.operators import signals as sg
from tapeloom.plans.registry import ORACLE_VIEWS, query
from tapeloom.plans.sqltext import last, roll
from tapeloom.plans.sqltext import text as T

ASOF = "1999-06-15"


def asof():
    return F.lit(ASOF).cast("date")


def case(key, mapping, default=None):
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in mapping.items()) + (f" ELSE {default}" if default else "") + " END"


def P(pattern, *args):
    return f"printf({T(pattern)}, {', '.join(args)})"


ORACLE_VIEWS["v_context"] = """
SELECT r.*, v.vix, CASE WHEN vix > 25 THEN 'high_fear' WHEN vix >= 15 OR vix IS NULL THEN 'neutral' ELSE 'complacency' END AS vix_regime FROM v_rank52 r, (SELECT arg_max(vix, date) AS vix FROM v_vix) v"""
ORACLE_VIEWS["v_sig_context"] = f"""
SELECT ticker, 'Market Context' AS label, {case('vix_regime', {'high_fear': "'good'", 'complacency': "'warning'"}, "'neutral'")} AS status,
 CASE WHEN vix IS NULL THEN {T(M.CONTEXT['missing'])} ELSE {case('vix_regime', {k: P(M.CONTEXT[k], 'vix') for k in ('high_fear', 'complacency', 'neutral')})} END || '. ' ||
 CASE WHEN week52_rank > 0.8 THEN {P(M.CONTEXT['high'], 'week52_rank*100')} WHEN week52_rank < 0.2 THEN {P(M.CONTEXT['low'], 'week52_rank*100')} ELSE {P(M.CONTEXT['mid'], 'week52_rank*100')} END AS text FROM v_context"""


@query("volatility_regime", "H-01", "SELECT date, r6(vix) AS vix, CASE WHEN vix > 25 THEN 'high_fear' WHEN vix >= 15 THEN 'neutral' ELSE 'complacency' END AS regime FROM v_vix")
def _(m):
    return rounded(m.vix.withColumn("regime", sg.fear_regime(F.col("vix"))))


ORACLE_VIEWS["v_sector_trend"] = f"""
SELECT sector, CASE WHEN n < 50 THEN 'unknown' WHEN s20 > s50 THEN 'uptrend' WHEN s20 < s50 THEN 'downtrend' ELSE 'neutral' END AS trend, CASE WHEN n >= 50 THEN (close-past)/past*100 END AS etf_1mo_return
FROM (SELECT sector, date, close, {roll('avg', 'close', 20, 'sector')} AS s20, {roll('avg', 'close', 50, 'sector')} AS s50, lag(close, 20) OVER (PARTITION BY sector ORDER BY date) AS past, count(*) OVER (PARTITION BY sector) AS n
      FROM v_etf QUALIFY row_number() OVER (PARTITION BY sector ORDER BY date DESC) = 1) z"""
ORACLE_VIEWS["v_sig_sector"] = f"""
SELECT s.ticker, 'Sector Trend' AS label, {case('t.trend', {'uptrend': "'good'", 'downtrend': "'warning'"}, "'neutral'")} AS status, {case('t.trend', {k: P(v, 's.sector') for k, v in M.SECTOR.items()})} AS text
FROM v_sectors s JOIN v_sector_trend t USING (sector)"""


@query("sector_trend", "H-03", "SELECT sector, trend, r6(etf_1mo_return) AS etf_1mo_return FROM v_sector_trend")
def _(m):
    return rounded(sg.sector_trend(m.etf))


def _rel(status):
    return P(M.RELATIVE[status], "ticker", "ticker_return_pct", "spy_return_pct", "'all'", "alpha_pct")


ORACLE_VIEWS["v_sig_relative"] = f"""
SELECT ticker, 'vs Market' AS label, CASE WHEN alpha_pct > 5 THEN 'good' WHEN alpha_pct < -5 THEN 'warning' ELSE 'neutral' END AS status,
 CASE WHEN alpha_pct > 5 THEN {_rel('good')} WHEN alpha_pct < -5 THEN {_rel('warning')} ELSE {_rel('neutral')} END AS text FROM v_relperf"""
_parts = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN {P(M.MOMENTUM['part'], c, T(c[4:]))} END" for _, c, _ in ind.MOMENTUM_HORIZONS)
ORACLE_VIEWS["v_sig_momentum"] = f"""
SELECT ticker, 'Momentum' AS label, {case('trend', {'strong_up': "'good'", 'up': "'good'", 'down': "'warning'", 'strong_down': "'warning'"}, "'neutral'")} AS status,
 CASE WHEN parts = '' THEN {T(M.MOMENTUM['none'])} ELSE {case('trend', {k: T(M.MOMENTUM[k]) for k in ('strong_up', 'up', 'strong_down', 'down', 'neutral')})} || parts || '.' END AS text
FROM (SELECT *, concat_ws(', ', {_parts}) AS parts FROM v_mom) z"""
ORACLE_VIEWS["v_sig_pmo"] = f"""
SELECT ticker, 'PMO Relative Strength' AS label, {case('trend', {'leading': "'good'", 'lagging': "'warning'"}, "'neutral'")} AS status, {case('trend', {k: P(v, 'rs_score') for k, v in M.PMO.items()})} AS text
FROM (SELECT *, CASE WHEN rs_norm > 0.2 THEN 'leading' WHEN rs_norm < -0.2 THEN 'lagging' ELSE 'neutral' END AS trend FROM v_pmo_rs) z"""
ORACLE_VIEWS["v_pcr"] = f"""
SELECT *, CASE WHEN put_call_ratio > 1.2 THEN 'bullish' WHEN put_call_ratio < 0.6 THEN 'bearish' ELSE 'neutral' END AS signal FROM (
 SELECT ticker, expiry, CAST(coalesce(sum(volume) FILTER (WHERE side = 'call'), 0) AS BIGINT) AS call_volume, CAST(coalesce(sum(volume) FILTER (WHERE side = 'put'), 0) AS BIGINT) AS put_volume,
        coalesce(sum(volume) FILTER (WHERE side = 'put'), 0)/nullif(sum(volume) FILTER (WHERE side = 'call'), 0) AS put_call_ratio
 FROM v_options o WHERE expiry = (SELECT min(expiry) FROM v_options i WHERE i.ticker = o.ticker AND i.expiry >= DATE '{ASOF}') GROUP BY ticker, expiry) z"""
_r = "printf('%.2f', put_call_ratio)"
ORACLE_VIEWS["v_sig_options"] = f"""
SELECT ticker, 'Options' AS label, CASE WHEN put_call_ratio IS NULL THEN 'neutral' ELSE {case('signal', {'bullish': "'good'", 'bearish': "'warning'"}, "'neutral'")} END AS status,
 CASE WHEN put_call_ratio IS NULL THEN {T(M.OPTIONS['none'])} ELSE {case('signal', {'bullish': P(M.OPTIONS['bullish'], _r, 'expiry::VARCHAR'), 'bearish': P(M.OPTIONS['bearish'], _r, 'expiry::VARCHAR'), 'neutral': P(M.OPTIONS['neutral'], _r, 'call_volume', 'put_volume', 'expiry::VARCHAR')})} END AS text FROM v_pcr"""


@query("put_call_ratio", "H-07", "SELECT ticker, expiry, call_volume, put_volume, r6(put_call_ratio) AS put_call_ratio, signal FROM v_pcr")
def _(m):
    return rounded(sg.put_call(m.options, asof()))


ORACLE_VIEWS["v_expiry"] = f"""
SELECT ticker, expiry FROM (SELECT DISTINCT ticker, expiry FROM v_options WHERE expiry >= DATE '{ASOF}') z
QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY (expiry - DATE '{ASOF}' < 14)::INT, abs(expiry - DATE '{ASOF}' - 30), expiry) = 1"""


@query("month_ahead_expiry", "H-08", "SELECT ticker, expiry FROM v_expiry")
def _(m):
    return sg.month_ahead_expiry(m.options, asof())


ORACLE_VIEWS["v_iv"] = f"""
SELECT r.ticker, top_share, CASE WHEN top_share <= 0.6 THEN iv END AS iv30, rv30, CASE WHEN top_share <= 0.6 AND rv30 > 0 THEN iv/rv30 END AS ratio
FROM {last('v_rv')} r
LEFT JOIN (SELECT ticker, max(k)/sum(k)::DOUBLE AS top_share FROM (SELECT ticker, round(iv, 9) AS x, count(*) AS k FROM v_options JOIN v_expiry USING (ticker, expiry) WHERE iv > 0.001 GROUP BY 1, 2) a GROUP BY ticker) s ON s.ticker = r.ticker
LEFT JOIN (SELECT o.ticker, avg(o.iv) AS iv FROM v_options o JOIN v_expiry USING (ticker, expiry) JOIN {last('v_bars')} b ON b.ticker = o.ticker WHERE o.strike BETWEEN b.close*0.95 AND b.close*1.05 AND o.iv > 0.05 GROUP BY o.ticker) v ON v.ticker = r.ticker"""
ORACLE_VIEWS["v_ivr"] = f"""
SELECT *, CASE WHEN top_share IS NULL THEN {T(M.VOL_RATIO['unpopulated'])} WHEN top_share > 0.6 THEN {T(M.VOL_RATIO['placeholder'])} WHEN iv30 IS NULL THEN {T(M.VOL_RATIO['no_atm'])} WHEN ratio > 1.3 THEN {T(M.VOL_RATIO['over'])}
  WHEN ratio < 0.8 THEN {T(M.VOL_RATIO['under'])} ELSE {T(M.VOL_RATIO['fair'])} END AS interpretation,
  CASE WHEN ratio > 1.3 THEN clip(1 - ratio, -1, 1) WHEN ratio < 0.8 THEN clip((0.8-ratio)/0.8, -1, 1) ELSE 0.0 END AS signal FROM v_iv"""
ORACLE_VIEWS["v_sig_vol"] = f"""
SELECT ticker, 'Vol Ratio' AS label, CASE WHEN ratio > 1.3 THEN 'warning' WHEN ratio < 0.8 THEN 'good' ELSE 'neutral' END AS status,
 CASE WHEN ratio IS NULL THEN interpretation ELSE {P(M.VOL_RATIO['text'], 'iv30*100', 'rv30*100', 'ratio', 'interpretation')} END AS text FROM v_ivr"""


@query("implied_to_realised_volatility", "H-09, H-10", "SELECT ticker, r6(top_share) AS top_share, r6(iv30) AS iv30, r6(rv30) AS rv30, r6(ratio) AS ratio, interpretation, r6(signal) AS signal FROM v_ivr")
def _(m):
    return rounded(sg.implied_vol(m.options, m.bars, asof()))


ORACLE_VIEWS["v_insact"] = """
SELECT *, CASE WHEN buy_count > sell_count AND buy_count >= 2 THEN 'bullish' WHEN sell_count > buy_count*2 THEN 'bearish' ELSE 'neutral' END AS net_sentiment FROM (
 SELECT ticker, count(*) FILTER (WHERE lower(text) SIMILAR TO '.*(purchase|buy|acquisition|acquired).*') AS buy_count,
        count(*) FILTER (WHERE NOT lower(text) SIMILAR TO '.*(purchase|buy|acquisition|acquired).*' AND lower(text) SIMILAR TO '.*(sale|sell|disposed|exercise).*') AS sell_count
 FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC, order_id, line_id, party_id, shares) AS k FROM v_insider) a WHERE k <= 10 GROUP BY ticker) z"""
ORACLE_VIEWS["v_sig_insider"] = f"""
SELECT ticker, 'Insider' AS label, CASE WHEN buy_count + sell_count = 0 THEN 'neutral' ELSE {case('net_sentiment', {'bullish': "'good'", 'bearish': "'warning'"}, "'neutral'")} END AS status,
 CASE WHEN buy_count + sell_count = 0 THEN {T(M.INSIDER['none'])} ELSE {case('net_sentiment', {'bullish': P(M.INSIDER['bullish'], 'buy_count', 'sell_count'), 'bearish': P(M.INSIDER['bearish'], 'sell_count', 'buy_count'), 'neutral': P(M.INSIDER['neutral'], 'buy_count', 'sell_count')})} END AS text FROM v_insact"""


@query("insider_activity", "H-11", "SELECT ticker, buy_count, sell_count, net_sentiment FROM v_insact")
def _(m):
    return sg.insider_activity(m.insider, most=10)


@query("top_holders", "H-12", "SELECT ticker, holder, shares, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY ticker ORDER BY shares DESC, holder) AS INT) AS place FROM v_holders) a WHERE place <= 5")
def _(m):
    return sg.top_holders(m.holders, most=5)


ORACLE_VIEWS["v_sig_ownership"] = f"""
SELECT ticker, 'Ownership' AS label, status, {P(M.OWNERSHIP['base'], 'institution_pct*100', 'insider_pct*100')} || {case('status', {k: T(M.OWNERSHIP[k]) for k in ('good', 'warning', 'neutral')})} AS text
FROM (SELECT *, CASE WHEN institution_pct*100 > 70 THEN 'good' WHEN institution_pct*100 < 20 THEN 'warning' ELSE 'neutral' END AS status FROM v_info) z"""
ORACLE_VIEWS["v_sig_short"] = f"""
SELECT ticker, 'Short Interest' AS label, CASE WHEN short_pct_float*100 >= 20 THEN 'warning' ELSE 'neutral' END AS status,
 CASE WHEN short_pct_float IS NULL THEN {T(M.SHORT_INTEREST['none'])} ELSE {P(M.SHORT_INTEREST['pct'], 'short_pct_float*100', "CASE WHEN short_ratio <> 0 THEN " + P(M.SHORT_INTEREST['days'], 'short_ratio') + " ELSE '' END")} ||
  CASE WHEN short_pct_float*100 >= 20 THEN {T(M.SHORT_INTEREST['high'])} WHEN short_pct_float*100 >= 10 THEN {T(M.SHORT_INTEREST['moderate'])} ELSE {T(M.SHORT_INTEREST['low'])} END END AS text FROM v_info"""
ORACLE_VIEWS["v_analyst"] = f"""
SELECT *, CASE WHEN n_analysts = 0 OR target_mean IS NULL THEN 'neutral' WHEN lower(consensus) LIKE '%strong buy%' OR upside_pct > 20 THEN 'good' WHEN lower(consensus) LIKE '%sell%' OR upside_pct < -10 THEN 'warning' ELSE 'neutral' END AS status
FROM (SELECT i.ticker, n_analysts, target_mean, (target_mean-close)/close*100 AS upside_pct,
       {case('recommendation', {k: T(v) for k, v in sg.CONSENSUS.items()}, "upper(recommendation[1]) || recommendation[2:]")} AS consensus FROM v_info i JOIN {last('v_bars')} b ON b.ticker = i.ticker) z"""
ORACLE_VIEWS["v_sig_analyst"] = f"""
SELECT ticker, 'Analyst' AS label, status, CASE WHEN n_analysts = 0 OR target_mean IS NULL THEN {T(M.ANALYST['none'])} ELSE {P(M.ANALYST['text'], 'n_analysts', 'consensus', 'target_mean', 'upside_pct')} END AS text FROM v_analyst"""


@query("analyst_target", "H-14", "SELECT ticker, r6(upside_pct) AS upside_pct, consensus, status FROM v_analyst")
def _(m):
    return rounded(sg.analyst_signal(m.info, m.bars).select("ticker", "upside_pct", "consensus", "status"))


ORACLE_VIEWS["v_earnhist"] = """
SELECT ticker, count(*) FILTER (WHERE eps_actual > eps_estimate) AS beat_count, count(*) FILTER (WHERE eps_actual <= eps_estimate) AS miss_count,
  avg(CASE WHEN surprise_pct IS NULL AND eps_estimate <> 0 THEN (eps_actual-eps_estimate)/abs(eps_estimate)*100 WHEN abs(surprise_pct) < 2 AND eps_estimate <> 0 THEN surprise_pct/abs(eps_estimate)*100 ELSE surprise_pct END) AS avg_surprise_pct
FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY earnings_date DESC) AS k FROM v_earnings) a WHERE k <= 4 GROUP BY ticker"""
_x = f"CASE WHEN avg_surprise_pct IS NULL OR avg_surprise_pct = 0 THEN '' ELSE {P(M.EARNINGS['surprise'], 'avg_surprise_pct')} END"
_n = "beat_count + miss_count"
ORACLE_VIEWS["v_sig_earnings"] = f"""
SELECT ticker, 'Earnings' AS label, CASE WHEN {_n} = 0 THEN 'neutral' WHEN beat_count >= 3 THEN 'good' WHEN miss_count >= 3 THEN 'warning' ELSE 'neutral' END AS status,
 CASE WHEN {_n} = 0 THEN {T(M.EARNINGS['none'])} WHEN beat_count >= 3 THEN {P(M.EARNINGS['good'], 'beat_count', _n, _x)} WHEN miss_count >= 3 THEN {P(M.EARNINGS['warning'], 'miss_count', _n, _x)}
  ELSE {P(M.EARNINGS['neutral'], 'beat_count', 'miss_count', _n, _x)} END AS text FROM v_earnhist"""


@query("earnings_history", "H-15", "SELECT ticker, beat_count, miss_count, r6(avg_surprise_pct) AS avg_surprise_pct FROM v_earnhist")
def _(m):
    return rounded(sg.earnings_history(m.earnings))


ORACLE_VIEWS["v_due"] = f"SELECT ticker, CAST(min(earnings_date) FILTER (WHERE earnings_date >= DATE '{ASOF}') - DATE '{ASOF}' AS INT) AS days_away FROM v_earnings GROUP BY ticker"
_N = {k: P(v, "days_away") for k, v in M.NEXT_EARNINGS.items() if k != "unknown"}


@query("next_earnings", "H-16", f"""
SELECT ticker, days_away, 'Earnings' AS label, CASE WHEN days_away IS NULL THEN 'neutral' WHEN days_away <= 14 THEN 'warning' ELSE 'good' END AS status,
 CASE WHEN days_away IS NULL THEN {T(M.NEXT_EARNINGS['unknown'])} WHEN days_away <= 3 THEN {_N['d3']} WHEN days_away <= 7 THEN {_N['d7']} WHEN days_away <= 14 THEN {_N['d14']} ELSE {_N['far']} END AS text FROM v_due""")
def _(m):
    return sg.next_earnings_signal(sg.next_earnings(m.earnings, asof()))


_X = {k: P(v, "days_away") for k, v in M.PROXIMITY.items() if k != "unknown"}
ORACLE_VIEWS["v_sig_proximity"] = f"""
SELECT ticker, 'Earnings Risk' AS label, CASE WHEN days_away <= 14 THEN 'warning' WHEN days_away <= 30 THEN 'neutral' ELSE 'good' END AS status,
 CASE WHEN days_away IS NULL THEN {T(M.PROXIMITY['unknown'])} WHEN days_away <= 14 THEN {_X['high']} WHEN days_away <= 30 THEN {_X['medium']} ELSE {_X['low']} END AS text FROM v_due"""

COMPANY = "concat(p.p_name, ' inc')"
ORACLE_VIEWS["v_company"] = "SELECT p_brand AS ticker, min(p_name) AS company FROM part GROUP BY p_brand"
ORACLE_VIEWS["v_relnews"] = """
SELECT * FROM (SELECT ticker, doc_id, relevant, sentiment, row_number() OVER (PARTITION BY ticker ORDER BY doc_id) AS k FROM (
  SELECT *, count(*) FILTER (WHERE relevant) OVER (PARTITION BY ticker) AS n FROM (
    SELECT w.*, contains(lower(text), lower(w.ticker)) OR coalesce(len(split_part(lower(company), ' ', 1)) > 3 AND contains(lower(text), split_part(lower(company), ' ', 1)), false) AS relevant
    FROM v_news w LEFT JOIN v_company c ON c.ticker = w.ticker) a) b WHERE relevant OR n < 3) c WHERE k <= 10"""


@query("news_relevance", "H-17", "SELECT ticker, doc_id, relevant FROM v_relnews")
def _(m):
    companies = m.part.groupBy(F.col("p_brand").alias("ticker")).agg(F.min("p_name").alias("company"))
    return sg.relevant_news(m.news, companies, most=10, least=3).select("ticker", "doc_id", "relevant")


@query("headline_mood", "H-18", f"""
SELECT ticker, p AS positive, n AS negative, u AS neutral, CASE WHEN p+n+u = 0 THEN 'No data' WHEN p > n AND p > u THEN {P(M.HEADLINES['positive'], 'p', 'p+n+u')}
  WHEN n > p AND n > u THEN {P(M.HEADLINES['negative'], 'n', 'p+n+u')} ELSE {P(M.HEADLINES['mixed'], 'u', 'p+n+u')} END AS overall
FROM (SELECT ticker, count(*) FILTER (WHERE sentiment = 'positive') AS p, count(*) FILTER (WHERE sentiment = 'negative') AS n, count(*) FILTER (WHERE sentiment = 'neutral') AS u FROM v_news GROUP BY ticker) z""")
def _(m):
    return sg.headline_mood(m.news)


BUILT = {
    "market_context_signal": ("H-02", "v_sig_context", lambda m: sg.market_context_signal(sg.market_context(m.bars, m.vix))),
    "sector_signal": ("H-03", "v_sig_sector", lambda m: sg.sector_signal(m.sectors, sg.sector_trend(m.etf))),
    "relative_signal": ("H-04", "v_sig_relative", lambda m: sg.relative_signal(ind.relative_performance(m.bars, m.bench), "all")),
    "momentum_signal": ("H-05", "v_sig_momentum", lambda m: sg.momentum_signal(ind.momentum(m.bars))),
    "pmo_signal": ("H-06", "v_sig_pmo", lambda m: sg.pmo_signal(ind.pmo_relative(m.bars, m.bench))),
    "options_signal": ("H-07", "v_sig_options", lambda m: sg.options_signal(sg.put_call(m.options, asof()))),
    "volatility_ratio_signal": ("H-10", "v_sig_vol", lambda m: sg.vol_signal(sg.implied_vol(m.options, m.bars, asof()))),
    "insider_signal": ("H-11", "v_sig_insider", lambda m: sg.insider_signal(sg.insider_activity(m.insider, most=10))),
    "ownership_signal": ("H-12", "v_sig_ownership", lambda m: sg.ownership_signal(m.info)),
    "short_interest_signal": ("H-13", "v_sig_short", lambda m: sg.short_signal(m.info)),
    "analyst_signal": ("H-14", "v_sig_analyst", lambda m: sg.analyst_signal(m.info, m.bars).select("ticker", "label", "status", "text")),
    "earnings_history_signal": ("H-15", "v_sig_earnings", lambda m: sg.earnings_signal(sg.earnings_history(m.earnings))),
    "earnings_proximity_signal": ("H-16", "v_sig_proximity", lambda m: sg.proximity_signal(sg.next_earnings(m.earnings, asof()))),
}
for _name, (_ids, _view, _build) in BUILT.items():
    query(_name, _ids, f"SELECT ticker, label, status, text FROM {_view}")(_build)
