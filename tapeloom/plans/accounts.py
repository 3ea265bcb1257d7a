"""Account, alert, telemetry, text and ledger queries (inventory families P and N)."""
from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.exprs import rounded
from tapeloom.functions import messages as M
from tapeloom.operators import accounts as ac
from tapeloom.operators import book as bk
from tapeloom.operators import crosssection as xs
from tapeloom.operators import indicators as ind
from tapeloom.operators import scorecards as sc
from tapeloom.operators import signals as sg
from tapeloom.operators import structure as so
from tapeloom.plans.labels import predictions
from tapeloom.plans.registry import ORACLE_VIEWS, query
from tapeloom.plans.signals import asof
from tapeloom.plans.structure import quick_scores
from tapeloom.plans.sqltext import last

V = ORACLE_VIEWS
V["v_pnl"] = f"""SELECT p.*, b.close AS price, shares*buy_price AS cost, shares*b.close AS val FROM v_positions p JOIN {last('v_bars')} b USING (ticker)"""


@query("position_pnl", "P-01", "SELECT account, ticker, r4(cost) AS cost_basis, r4(val) AS current_value, r4(val-cost) AS pnl_dollars, r4((val-cost)/cost*100) AS pnl_pct, CASE WHEN val-cost > 0.01 THEN 'profit' WHEN val-cost < -0.01 THEN 'loss' ELSE 'breakeven' END AS status FROM v_pnl")
def _(m):
    out = ac.pnl(m.positions, ac.last_prices(m.bars))
    return rounded(out.select("account", "ticker", "cost_basis", "current_value", "pnl_dollars", "pnl_pct", "status"), 4)


@query("portfolio_summary", "P-02", "SELECT account, r4(sum(cost)) AS total_cost, r4(sum(val)) AS total_value, count(*) AS n_positions, r4(sum(val)-sum(cost)) AS total_pnl_dollars, r4((sum(val)-sum(cost))/sum(cost)*100) AS total_pnl_pct FROM v_pnl GROUP BY account")
def _(m):
    return rounded(ac.portfolio_summary(ac.pnl(m.positions, ac.last_prices(m.bars))), 4)


@query("daily_value_change", "P-03", f"SELECT account, r4(sum((b.close-b.pc)*shares)) AS day_change FROM v_positions p JOIN {last('v_volume')} b USING (ticker) GROUP BY account")
def _(m):
    return rounded(ac.daily_change(m.positions, m.bars), 4)


@query("allocation_share", "P-04", "SELECT account, ticker, r6(val/sum(val) OVER (PARTITION BY account)) AS share FROM v_pnl")
def _(m):
    return rounded(ac.allocation(ac.pnl(m.positions, ac.last_prices(m.bars))))


@query("latest_position", "P-05", """
SELECT account, ticker, shares, buy_price, n_entries FROM (SELECT o_custkey AS account, p_brand AS ticker, l_quantity AS shares, l_extendedprice AS buy_price, count(*) OVER (PARTITION BY o_custkey, p_brand) AS n_entries,
 row_number() OVER (PARTITION BY o_custkey, p_brand ORDER BY o_orderdate DESC, l_orderkey*1000000 + l_linenumber*10000 + l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey) z WHERE k = 1""")
def _(m):
    lines = m.lineitem.join(m.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(m.part, F.col("l_partkey") == F.col("p_partkey"))
    entries = lines.select(F.col("o_custkey").alias("account"), F.col("p_brand").alias("ticker"), F.col("l_quantity").alias("shares"), F.col("l_extendedprice").alias("buy_price"), F.col("o_orderdate").alias("entered"),
                           F.struct((F.col("l_orderkey") * 1000000 + F.col("l_linenumber") * 10000 + F.col("l_suppkey")).alias("a"), F.col("l_quantity").alias("b"), F.col("l_extendedprice").alias("c")).alias("entry_id"))
    return ac.latest_position(entries)


@query("alert_evaluation", "P-06", f"SELECT alert_id, a.ticker, direction, CAST(threshold AS BIGINT) AS threshold, b.close AS price FROM v_alerts a JOIN {last('v_bars')} b USING (ticker) WHERE triggered = 0 AND ((direction = 'above' AND b.close >= threshold) OR (direction = 'below' AND b.close <= threshold))")
def _(m):
    return ac.fired_alerts(m.alerts, ac.last_prices(m.bars)).select("alert_id", "ticker", "direction", F.col("threshold").cast("bigint").alias("threshold"), "price")


def why(kind: str, price: str) -> str:
    before, after = M.ALERTS[kind].split("{}")
    return f"concat('{before}', CAST({price} AS VARCHAR), '{after}')"


V["v_sugg"] = f"""
SELECT ticker, direction, target_price, priority, reason, CAST(row_number() OVER (PARTITION BY ticker ORDER BY priority, abs(target_price-price), direction, target_price) AS INT) AS place FROM (
 SELECT ticker, price, direction, target_price, priority, reason FROM (
  SELECT ticker, price, unnest([{{'t': CASE WHEN target_mean > price*1.02 THEN target_mean END, 'd': 'above', 'p': 0, 'o': 1, 'r': {why('analyst mean', 'target_mean')}}}, {{'t': CASE WHEN target_high > price*1.05 THEN target_high END, 'd': 'above', 'p': 2, 'o': 2, 'r': {why('analyst high', 'target_high')}}},
   {{'t': CASE WHEN target_low < price*0.98 THEN target_low END, 'd': 'below', 'p': 1, 'o': 3, 'r': {why('analyst low', 'target_low')}}}, {{'t': CASE WHEN support[1] < price*0.99 THEN support[1] END, 'd': 'below', 'p': 0, 'o': 4, 'r': {why('support', 'support[1]')}}}, {{'t': CASE WHEN support[2] < price*0.99 THEN support[2] END, 'd': 'below', 'p': 1, 'o': 5, 'r': {why('support', 'support[2]')}}},
   {{'t': CASE WHEN resistance[1] > price*1.01 THEN resistance[1] END, 'd': 'above', 'p': 0, 'o': 6, 'r': {why('resistance', 'resistance[1]')}}}, {{'t': CASE WHEN resistance[2] > price*1.01 THEN resistance[2] END, 'd': 'above', 'p': 1, 'o': 7, 'r': {why('resistance', 'resistance[2]')}}},
   {{'t': CASE WHEN pp < price*0.98 OR pp > price*1.02 THEN pp END, 'd': CASE WHEN pp < price THEN 'below' ELSE 'above' END, 'p': 1, 'o': 8, 'r': CASE WHEN pp < price THEN {why('pivot below', 'pp')} ELSE {why('pivot above', 'pp')} END}}], recursive := true)
  FROM (SELECT i.ticker, b.close AS price, target_mean, target_high, target_low, l.support, l.resistance, round(v.p, 2) AS pp FROM v_info i JOIN {last('v_bars')} b USING (ticker) JOIN v_levels l USING (ticker) JOIN v_pivot v USING (ticker)) x) y(ticker, price, target_price, direction, priority, o, reason)
 WHERE target_price IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker, direction, target_price ORDER BY priority, o) = 1) z QUALIFY place <= 6"""


@query("alert_suggestions", "P-07", "SELECT ticker, direction, target_price, priority, reason, place FROM v_sugg")
def _(m):
    m.staged()
    rows = (m.info.select("ticker", "target_mean", "target_high", "target_low").join(ac.last_prices(m.bars), "ticker").join(so.swing_levels(m.bars, most=3, newest=5), "ticker").join(so.pivot_points(m.bars).select("ticker", "PP"), "ticker"))
    return ac.alert_suggestions(rows, most=6).select("ticker", "direction", "target_price", "priority", "reason", "place")


@query("model_call_rollup", "P-08", """
SELECT CASE WHEN grouping(source) = 1 AND grouping(day) = 1 THEN 'total' WHEN grouping(day) = 1 THEN 'source' ELSE 'day' END AS level, source, day, count(*) AS n, r5(sum(cost_usd)) AS cost, CAST(sum(in_tokens) AS BIGINT) AS in_tok, CAST(sum(out_tokens) AS BIGINT) AS out_tok
FROM (SELECT *, CAST(created_at AS DATE) AS day FROM v_llm_calls) a GROUP BY GROUPING SETS ((), (source), (day))""")
def _(m):
    return rounded(ac.usage_rollup(m.llm_calls), 5)


@query("recent_model_calls", "P-08", "SELECT id, ticker, source, in_tokens, out_tokens FROM v_llm_calls ORDER BY created_at DESC, id DESC LIMIT 50")
def _(m):
    return ac.recent_calls(m.llm_calls, most=50).select("id", "ticker", "source", "in_tokens", "out_tokens")


@query("token_and_cost_estimate", "P-09", """
SELECT doc_id, i AS in_tokens, o AS out_tokens, r9(i*1.0/1e6 + o*5.0/1e6) AS direct_cost, r9(i*0.5/1e6 + o*2.5/1e6) AS batch_cost FROM (SELECT doc_id, greatest(1, length(text)//4) AS i, greatest(1, length(source)//4) AS o FROM documents) z""")
def _(m):
    out = ac.token_costs(m.documents.select("doc_id", "text", "source"), "text", "source")
    return rounded(out.drop("text", "source"), 9)


@query("compact_signal_text", "P-10", """
SELECT ticker, concat_ws(chr(10), 'BULL: ' || nullif(array_to_string(list_transform(list_filter(s, lambda x: x.status = 'good')[1:6], lambda x: x.label || ':' || substr(x.text, 1, 60)), ' | '), ''),
 'BEAR: ' || nullif(array_to_string(list_transform(list_filter(s, lambda x: x.status = 'warning')[1:6], lambda x: x.label || ':' || substr(x.text, 1, 60)), ' | '), '')) AS compact
FROM (SELECT ticker, list({'label': label, 'text': text, 'status': status} ORDER BY label) AS s FROM v_fundsig GROUP BY ticker) z""")
def _(m):
    return ac.bucketed_text(sc.fundamental_signals(m.info), width=60, most=6)


@query("json_reply_extraction", "P-11", "SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events")
def _(m):
    replies = m.events.select("event_id", F.concat(F.lit("Here is the answer:\n"), "props", F.lit("\nDone.")).alias("reply"))
    return ac.reply_fields(replies, "reply", "k BIGINT").select("event_id", F.col("parsed.k").alias("k"))


V["v_thesis"] = f"""
SELECT s.ticker, s.verdict, g.label AS gl, g.text AS gt, w.label AS wl, w.text AS wt, d.days_away, z.zone, z.z_score, v.ev_ebitda, v.fcf_yield, t.trend AS st, c.sector, i.short_pct_float*100 AS sp, o.trend AS mt, o.ret_1yr, a.upside_pct, i.target_mean, i.earnings_growth, i.profit_margin, i.revenue_growth, i.trailing_pe, p.score AS piotroski, coalesce(gs.s, []) AS good, coalesce(ws.s, []) AS warning
FROM v_score_quick s JOIN v_info i USING (ticker) JOIN v_due d USING (ticker) JOIN v_altman z USING (ticker) JOIN v_val v USING (ticker) JOIN v_sectors c USING (ticker) JOIN v_sector_trend t ON t.sector = c.sector JOIN v_mom o USING (ticker) JOIN v_analyst a USING (ticker) JOIN v_pio p USING (ticker)
LEFT JOIN (SELECT ticker, list({{'label': label, 'text': text}} ORDER BY label) AS s FROM v_fundsig WHERE status = 'good' GROUP BY ticker) gs USING (ticker)
LEFT JOIN (SELECT ticker, list({{'label': label, 'text': text}} ORDER BY label) AS s FROM v_fundsig WHERE status = 'warning' GROUP BY ticker) ws USING (ticker)
LEFT JOIN (SELECT * FROM v_fundsig WHERE status = 'good' QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY label) = 1) g USING (ticker) LEFT JOIN (SELECT * FROM v_fundsig WHERE status = 'warning' QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY label) = 1) w USING (ticker)"""


def points_sql(side, mark, *more):
    """Signals of a side, then the facts whose topic no signal covers; at most five, one a line."""
    facts = ", ".join(f"CASE WHEN ({test}) AND len(list_filter({side}, lambda x: contains(lower(x.label), '{topic}'))) = 0 THEN '{mark} ' || {text} END" for topic, test, text in more)
    return f"""array_to_string(list_concat(list_transform({side}[1:5], lambda x: '{mark} ' || x.label || ': ' || substr(x.text, 1, 77)), list_filter([{facts}], lambda x: x IS NOT NULL))[1:5], chr(10))"""


BULL_SQL = points_sql("good", "✅", ("analyst", "upside_pct > 20", "printf('Analyst Coverage: %.1f%% upside target implies significant room', upside_pct)"),
                      ("piotroski", "piotroski >= 7", "printf('Piotroski F-Score: %d/9 shows strong financial health', piotroski)"),
                      ("fcf", "fcf_yield > 5", "printf('Free Cash Flow: %.1f%% yield provides downside cushion', fcf_yield)"),
                      ("momentum", "mt IN ('up', 'strong_up')", "'Momentum: Price momentum accelerating' || CASE WHEN coalesce(ret_1yr, 0) = 0 THEN '' ELSE printf(' (+%.1f%% 1yr)', ret_1yr) END"),
                      ("short", "sp < 3", "printf('Short Interest: Low %.1f%% reduces squeeze risk downside', sp)"))
BEAR_SQL = points_sql("warning", "⚠️", ("valuation", "ev_ebitda > 25", "printf('Valuation: EV/EBITDA %.1fx well above historical average', ev_ebitda)"),
                      ("earnings", "days_away > 0 AND days_away < 14", "printf('Earnings Event: Earnings in %d days adds near-term volatility', days_away)"),
                      ("sector", "st = 'down'", "printf('Sector Headwind: %s momentum negative', sector)"),
                      ("short", "sp > 15", "printf('Short Interest: High %.1f%% indicates significant bearish positioning', sp)"))


@query("thesis_text", "P-12", """
SELECT ticker, CASE WHEN verdict = 'BUY' THEN CASE WHEN regexp_matches(lower(gl), 'fundamental|valuation') THEN 'Strong fundamentals at reasonable valuation' WHEN regexp_matches(lower(gl), 'momentum|technical') THEN 'Momentum building with improving technicals' WHEN regexp_matches(lower(gl), 'growth|earnings') THEN 'Exceptional growth engine with strong execution' ELSE 'Compelling risk-reward setup' END
 WHEN verdict = 'HOLD / WATCH' THEN CASE WHEN lower(wl) LIKE '%valuation%' THEN 'Mixed picture — strength offset by premium valuation' WHEN lower(wl) LIKE '%technical%' THEN 'Mixed picture — fundamentals strong but technicals weakening' WHEN lower(wl) LIKE '%sector%' THEN 'Mixed picture — company strength offset by sector headwind' ELSE 'Mixed signals warrant cautious stance' END
 ELSE CASE WHEN regexp_matches(lower(wl), 'fundamental|earnings') THEN 'Deteriorating fundamentals with limited upside' WHEN lower(wl) LIKE '%valuation%' THEN 'Stretched valuation with deteriorating momentum' WHEN lower(wl) LIKE '%technical%' THEN 'Technical breakdown with bearish implications' ELSE 'Risk-reward heavily skewed to downside' END END AS headline,
 coalesce(CASE WHEN days_away > 0 AND days_away < 14 THEN printf('Earnings release in %d days introduces event risk; volatility spike likely', days_away) END, CASE WHEN zone = 'distress' THEN printf('Altman Z-Score %.2f signals financial distress; bankruptcy risk elevated', z_score) END,
  CASE WHEN ev_ebitda > 25 THEN printf('Valuation premium (EV/EBITDA %.1fx) leaves little room for disappointment', ev_ebitda) END, CASE WHEN st = 'downtrend' THEN printf('%s sector momentum turning negative; sector rotation risk', sector) END,
  CASE WHEN sp > 15 THEN printf('High short interest (%.1f%%) indicates bearish positioning and crowding', sp) END, wt, 'No material risks identified; upside risk moderate') AS key_risk,
 coalesce(CASE WHEN upside_pct > 30 THEN printf('Analyst consensus %.1f%% upside to $%.2f target reflects significant value', upside_pct, target_mean) END, CASE WHEN mt IN ('up', 'strong_up') THEN 'Strong price momentum' || coalesce(printf(' (%+.1f%% 1yr)', ret_1yr), '') || ' suggests trend continuation' END,
  CASE WHEN earnings_growth*100 > 20 THEN printf('Earnings growth of %.1f%% YoY with track record of beat-and-raise', earnings_growth*100) END, CASE WHEN fcf_yield > 5 THEN printf('Strong free cash flow yield (%.1f%%) supports buybacks and dividend growth', fcf_yield) END, gt, 'Lack of near-term catalysts; monitor for fundamental inflection') AS key_catalyst,
 printf('%s: %s. %s %s.', ticker, coalesce(nullif(concat_ws(', ', CASE WHEN profit_margin*100 > 20 THEN printf('%.0f%% margins', profit_margin*100) END, CASE WHEN revenue_growth > 0 THEN printf('%.0f%% revenue growth', revenue_growth*100) END, CASE WHEN trailing_pe > 30 THEN printf('%.0fx P/E (pricey)', trailing_pe) END, CASE WHEN st = 'downtrend' THEN printf('%s headwind', sector) END), ''), 'mixed fundamentals'),
  CASE WHEN upside_pct > 20 THEN printf('Analysts bullish (%+.1f%% target).', upside_pct) ELSE '' END, verdict) AS one_liner, """ + f"{BULL_SQL} AS bull_points, {BEAR_SQL} AS bear_points FROM v_thesis")
def _(m):
    m.staged("v_bars", "v_info", "v_statements")
    signals = sc.fundamental_signals(m.info).groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("label", "text", "status"))).alias("s"))   # at most seven
    sides = signals.select("ticker", F.filter("s", lambda x: x["status"] == "good").alias("good"), F.filter("s", lambda x: x["status"] == "warning").alias("warning"))
    years = sc.statement_years(m.statements)
    rows = (quick_scores(m).select("ticker", "verdict").join(sides, "ticker").join(m.info.drop("beta"), "ticker")
            .join(sg.next_earnings(m.earnings, asof()).select("ticker", F.col("days_away").alias("earnings_days")), "ticker")
            .join(sc.altman_market(years, m.info).select("ticker", F.col("zone").alias("altman_zone"), "z_score"), "ticker")
            .join(sc.advanced_valuation(m.info).select("ticker", "ev_ebitda", "fcf_yield"), "ticker")
            .join(m.sectors.join(sg.sector_trend(m.etf).select("sector", F.col("trend").alias("sector_trend")), "sector"), "ticker")
            .join(ind.momentum(m.bars).select("ticker", F.col("trend").alias("momentum_trend"), "ret_1yr"), "ticker")
            .join(sg.analyst_signal(m.info, m.bars).select("ticker", "upside_pct"), "ticker").join(sc.piotroski(years).select("ticker", F.col("score").alias("piotroski")), "ticker").withColumn("short_pct", F.col("short_pct_float") * 100))
    return ac.thesis(rows, most=5, width=77).select("ticker", "headline", "key_risk", "key_catalyst", "one_liner", F.concat_ws("\n", "bull_points").alias("bull_points"), F.concat_ws("\n", "bear_points").alias("bear_points"))


@query("freshness_flag", "P-13", """
SELECT key, CAST(epoch(TIMESTAMP '2024-02-01 00:00:00') - floor(epoch(t)) AS BIGINT) AS age_seconds, epoch(TIMESTAMP '2024-02-01 00:00:00') - floor(epoch(t)) > 86400 AS stale FROM (SELECT CAST(user_id AS VARCHAR) AS key, max(ts) AS t FROM events GROUP BY 1) z""")
def _(m):
    entries = m.events.select(F.col("user_id").cast("string").alias("key"), F.col("ts").alias("cached_at"))
    return ac.freshness(entries, F.lit("2024-02-01 00:00:00").cast("timestamp"), 86400)


@query("five_bar_change", "P-14", "SELECT ticker, r6((arg_max(close, date)-arg_min(close, date))/arg_min(close, date)*100) AS change_pct FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM v_bars) a WHERE k <= 5 GROUP BY ticker")
def _(m):
    return rounded(ac.window_change(m.bars))


V["v_ledger"] = "SELECT l.*, b.close AS price_at_prediction FROM (SELECT *, count(*) OVER (PARTITION BY date) AS n FROM v_livew) l JOIN v_bars b USING (ticker, date) WHERE n >= 10 AND b.close <> 0"


def ledger_of(m):
    rows = predictions(m.bars).filter(F.col("pred_return").isNotNull())
    weighted = bk.live_weights(rows).select("ticker", "date", "pred_return", "weight", "leg")
    return ac.ledger_rows(weighted, m.bars.select("ticker", "date", F.col("close").alias("price")), "v1")


@query("ledger_append", "N-01", "SELECT date, ticker, r6(pred_return) AS pred_return, r6(weight) AS weight, leg, 'v1' AS model_version, price_at_prediction FROM v_ledger")
def _(m):
    out = ledger_of(m)
    return out.select("date", "ticker", F.round("pred_return", 6).alias("pred_return"), F.round("weight", 6).alias("weight"), "leg", "model_version", "price_at_prediction")


V["v_outcome"] = f"""SELECT l.ticker, l.date, l.pred_return, b.close AS realized_price, (b.close-price_at_prediction)/price_at_prediction AS realized_return FROM v_ledger l JOIN {last('v_bars')} b ON b.ticker = l.ticker
WHERE DATE '2001-12-31' - l.date >= 7 AND l.date >= DATE '1997-01-01'"""
CHECKED = "2001-12-31"


def outcomes_of(m):
    ledger = ledger_of(m)
    earlier = ledger.filter(F.col("date") < F.lit("1997-01-01").cast("date"))
    return ac.resolved_outcomes(ledger, earlier, ac.last_prices(m.bars), F.lit(CHECKED).cast("date"))


@query("ledger_resolve", "N-02", "SELECT ticker, date, realized_price, r6(realized_return) AS realized_return FROM v_outcome")
def _(m):
    out = outcomes_of(m.staged())
    return out.select("ticker", "date", "realized_price", F.round("realized_return", 6).alias("realized_return"))


@query("half_split_hit_rate", "N-03", """
SELECT r6(avg(t)) AS avg_top, r6(avg(b)) AS avg_bottom, r6(avg(t-b)) AS avg_spread, r6(avg((t > b)::INT)) AS win_rate, count(*) AS n_days FROM (
 SELECT date, avg(realized_return) FILTER (WHERE k > n - n//2) AS t, avg(realized_return) FILTER (WHERE k <= n//2) AS b FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY pred_return, ticker) AS k, count(*) OVER (PARTITION BY date) AS n FROM v_outcome) a WHERE n >= 2 GROUP BY date) z""")
def _(m):
    return rounded(ac.half_split_hits(outcomes_of(m.staged())))


@query("ledger_status", "N-05", """
SELECT 'v1' AS model_version, count(*) FILTER (WHERE o.ticker IS NULL) AS pending, count(*) FILTER (WHERE o.ticker IS NOT NULL) AS checked, r6(avg(realized_return)) AS mean_realized, r6(avg((sign(l.pred_return) = sign(realized_return))::INT) FILTER (WHERE o.ticker IS NOT NULL)) AS direction_hits
FROM v_ledger l LEFT JOIN v_outcome o USING (ticker, date)""")
def _(m):
    m.staged()
    return rounded(ac.ledger_status(ledger_of(m), outcomes_of(m)))


@query("ledger_hit_rate", "N-05, F-10", """
SELECT count(*) AS n_days, count(*) FILTER (WHERE top > bottom) AS n_won, r6(avg((top > bottom)::INT)) AS hit_rate FROM (
 SELECT date, avg(realized_return) FILTER (WHERE pred_return >= med) AS top, avg(realized_return) FILTER (WHERE pred_return < med) AS bottom
 FROM (SELECT *, median(pred_return) OVER (PARTITION BY date) AS med, count(*) OVER (PARTITION BY date) AS n FROM v_outcome) a WHERE n >= 10 GROUP BY date) b WHERE top IS NOT NULL AND bottom IS NOT NULL""")
def _(m):
    return rounded(xs.median_split_hits(outcomes_of(m.staged()), "pred_return", "realized_return"))
