"""Score card queries (inventory family G)."""
from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions import messages as M
from tapeloom.functions.exprs import rounded
from tapeloom.operators import scorecards as sc
from tapeloom.plans.registry import ORACLE_VIEWS, query
from tapeloom.plans.sqltext import text as T

ITEMS = {"ni": "Net Income", "ta": "Total Assets", "ocf": "Operating Cash Flow", "ltd": "Long Term Debt", "ca": "Current Assets",
         "cl": "Current Liabilities", "gp": "Gross Profit", "rev": "Total Revenue", "re": "Retained Earnings", "ebit": "EBIT",
         "tl": "Total Liabilities Net Minority Interest", "eq": "Stockholders Equity", "sh": "Shares Outstanding",
         "osn": "Ordinary Shares Number", "debt": "Total Debt", "cash": "Cash And Cash Equivalents"}
ORACLE_VIEWS["v_years"] = "SELECT ticker, " + ", ".join(
    f"max(value) FILTER (WHERE item = '{item}' AND age = {k}) AS {field}{k}" for field, item in ITEMS.items() for k in (0, 1)) + """
FROM (SELECT *, dense_rank() OVER (PARTITION BY ticker ORDER BY period_end DESC) - 1 AS age FROM v_statements) a GROUP BY ticker"""
FLAGS = {"roa_positive": "ni0/nullif(ta0,0) > 0", "ocf_positive": "ocf0 > 0", "roa_increasing": "ni0/nullif(ta0,0) > ni1/nullif(ta1,0)",
         "accruals_quality": "ocf0/nullif(ta0,0) > ni0/nullif(ta0,0)", "lt_debt_ratio_decreased": "ltd0/nullif(ta0,0) < ltd1/nullif(ta1,0)",
         "current_ratio_improved": "ca0/nullif(cl0,0) > ca1/nullif(cl1,0)", "no_new_shares": "sh0 <= sh1",
         "gross_margin_improved": "gp0/nullif(rev0,0) > gp1/nullif(rev1,0)", "asset_turnover_improved": "rev0/nullif(ta0,0) > rev1/nullif(ta1,0)"}
NAMES = list(FLAGS)
ORACLE_VIEWS["v_pio"] = f"""
SELECT *, profitability + leverage + efficiency AS score FROM (
  SELECT *, {' + '.join(f'{n}::INT' for n in NAMES[:4])} AS profitability, {' + '.join(f'{n}::INT' for n in NAMES[4:7])} AS leverage,
         {' + '.join(f'{n}::INT' for n in NAMES[7:])} AS efficiency
  FROM (SELECT ticker, {', '.join(f'coalesce({c}, false) AS {n}' for n, c in FLAGS.items())} FROM v_years) a) b"""


@query("line_item_lookup", "G-05", "SELECT ticker, CASE item " + " ".join(
    f"WHEN '{item}' THEN '{field}'" for field, item in ITEMS.items()) + """ END AS field, item, period_end, value FROM v_statements
UNION ALL SELECT ticker, 'debt', item, period_end, value FROM v_statements WHERE 1 = 0""")
def _(m):
    return sc.line_items(m.statements)


@query("piotroski_nine_tests", "G-01", f"""
SELECT ticker, {', '.join(NAMES)}, profitability, leverage, efficiency, score,
       CASE WHEN score >= 7 THEN 'strong' WHEN score <= 3 THEN 'weak' ELSE 'neutral' END AS interpretation FROM v_pio""")
def _(m):
    return sc.piotroski(sc.statement_years(m.statements)).drop("components")


@query("piotroski_signal", "G-01", f"""
SELECT ticker, 'Piotroski F-Score' AS label, CASE WHEN score >= 7 THEN 'good' WHEN score <= 3 THEN 'warning' ELSE 'neutral' END AS status,
 printf({T(M.PIOTROSKI)}, score, CASE WHEN score >= 7 THEN {T(M.HEALTH['good'])} WHEN score <= 3 THEN {T(M.HEALTH['warning'])} ELSE {T(M.HEALTH['neutral'])} END,
        profitability, leverage, efficiency) AS text FROM v_pio""")
def _(m):
    return sc.piotroski_signal(sc.piotroski(sc.statement_years(m.statements)))


ORACLE_VIEWS["v_pio8"] = f"""
SELECT ticker, CASE WHEN ta0 <> 0 THEN {' + '.join(f'coalesce({c}, false)::INT' for n, c in FLAGS.items() if n != 'no_new_shares')} ELSE 0 END AS score8 FROM v_years"""


@query("piotroski_eight_tests", "G-02, C-27", "SELECT ticker, score8, r6(score8/9) AS piotroski_score FROM v_pio8")
def _(m):
    return rounded(sc.piotroski_eight(sc.statement_years(m.statements)).withColumn("piotroski_score", F.col("score8") / 9))


ORACLE_VIEWS["v_altman"] = f"""
SELECT *, CASE WHEN z_score IS NULL THEN 'unknown' WHEN z_score > 2.99 THEN 'safe' WHEN z_score >= 1.81 THEN 'grey' ELSE 'distress' END AS zone
FROM (SELECT *, (x1 IS NOT NULL)::INT + (x2 IS NOT NULL)::INT + (x3 IS NOT NULL)::INT + (x4 IS NOT NULL)::INT + (x5 IS NOT NULL)::INT AS n_terms,
             CASE WHEN coalesce(x1,x2,x3,x4,x5) IS NOT NULL THEN coalesce(1.2*x1,0)+coalesce(1.4*x2,0)+coalesce(3.3*x3,0)+coalesce(0.6*x4,0)+coalesce(x5,0) END AS z_score
      FROM (SELECT ticker, (ca0-cl0)/nullif(ta0,0) AS x1, re0/nullif(ta0,0) AS x2, ebit0/nullif(ta0,0) AS x3, market_cap/nullif(tl0,0) AS x4, rev0/nullif(ta0,0) AS x5
            FROM v_years LEFT JOIN v_info USING (ticker)) a) b"""


@query("altman_market_value", "G-03", "SELECT ticker, r6(x1) AS x1, r6(x2) AS x2, r6(x3) AS x3, r6(x4) AS x4, r6(x5) AS x5, n_terms, r6(z_score) AS z_score, zone FROM v_altman")
def _(m):
    return rounded(sc.altman_market(sc.statement_years(m.statements), m.info))


@query("altman_signal", "G-03", f"""
SELECT ticker, 'Altman Z-Score' AS label, CASE zone WHEN 'safe' THEN 'good' WHEN 'distress' THEN 'warning' ELSE 'neutral' END AS status,
  CASE WHEN zone = 'unknown' THEN {T(M.ALTMAN['none'])} ELSE CASE zone WHEN 'safe' THEN printf({T(M.ALTMAN['safe'])}, z_score) WHEN 'grey' THEN printf({T(M.ALTMAN['grey'])}, z_score)
    ELSE printf({T(M.ALTMAN['distress'])}, z_score) END || CASE WHEN n_terms < 5 THEN printf({T(M.ALTMAN['partial'])}, n_terms) ELSE '' END END AS text FROM v_altman""")
def _(m):
    return sc.altman_signal(sc.altman_market(sc.statement_years(m.statements), m.info))


ORACLE_VIEWS["v_altbook"] = """
SELECT ticker, CASE WHEN ta0 <> 0 THEN 1.2*(coalesce(ca0,0)-coalesce(cl0,0))/ta0 + 1.4*coalesce(re0,0)/ta0 + 3.3*coalesce(ebit0,0)/ta0
  + 0.6*coalesce(eq0,0)/coalesce(nullif(tl0,0), ta0) + coalesce(rev0,0)/ta0 END AS z_book FROM v_years"""


@query("altman_book_value", "G-04, C-28", "SELECT ticker, r6(z_book) AS z_book FROM v_altbook")
def _(m):
    return rounded(sc.altman_book(sc.statement_years(m.statements)))


@query("snapshot_ratios", "G-06", "SELECT ticker, r6(ca0/nullif(cl0,0)) AS current_ratio, r6(debt0/nullif(eq0,0)) AS debt_to_equity, r6(ni0/nullif(rev0,0)) AS profit_margin FROM v_years")
def _(m):
    return rounded(sc.snapshot_ratios(sc.statement_years(m.statements)))


def _band(label, present, cases, shown, texts):
    status = " ".join(f"WHEN {c} THEN '{s}'" if c else f"ELSE '{s}'" for c, s, _ in cases)
    words = " ".join((f"WHEN {c} THEN" if c else "ELSE") + f" printf({T(texts[k])}, {shown}{', ' + shown if texts[k].count('%') == 2 and '%%' not in texts[k] else ''})" for c, _, k in cases)
    return f"SELECT ticker, '{label}' AS label, CASE {status} END AS status, CASE {words} END AS text FROM v_info WHERE {present}"


ORACLE_VIEWS["v_fundsig"] = " UNION ALL ".join([
    _band("P/E Ratio", "trailing_pe <> 0", [("trailing_pe < 0", "warning", "negative"), ("trailing_pe < 15", "good", "cheap"), ("trailing_pe < 30", "neutral", "fair"), (None, "warning", "expensive")], "trailing_pe", M.PE),
    _band("Revenue Growth", "revenue_growth IS NOT NULL", [("revenue_growth*100 > 15", "good", "good"), ("revenue_growth > 0", "neutral", "neutral"), (None, "warning", "warning")], "revenue_growth*100", M.GROWTH),
    _band("Profit Margin", "profit_margin IS NOT NULL", [("profit_margin*100 > 15", "good", "good"), ("profit_margin*100 > 5", "neutral", "neutral"), (None, "warning", "warning")], "profit_margin*100", M.MARGIN),
    _band("Debt", "debt_to_equity IS NOT NULL", [("debt_to_equity/100 < 0.5", "good", "good"), ("debt_to_equity/100 < 1.5", "neutral", "neutral"), (None, "warning", "warning")], "debt_to_equity/100", M.DEBT),
    _band("Liquidity", "current_ratio IS NOT NULL", [("current_ratio > 1.5", "good", "good"), ("current_ratio > 1", "neutral", "neutral"), (None, "warning", "warning")], "current_ratio", M.LIQUIDITY),
    _band("Volatility (Beta)", "beta IS NOT NULL", [("beta > 1.5", "warning", "warning"), ("beta > 0.8", "neutral", "neutral"), (None, "good", "good")], "beta", M.BETA),
    _band("Short Interest", "short_ratio IS NOT NULL", [("short_ratio > 10", "warning", "warning"), ("short_ratio > 5", "neutral", "neutral"), (None, "good", "good")], "short_ratio", M.SHORT_RATIO)])


@query("fundamental_signals", "G-07", "SELECT * FROM v_fundsig")
def _(m):
    return sc.fundamental_signals(m.info)


ORACLE_VIEWS["v_val"] = f"""
SELECT *, CASE WHEN a = 'unknown' AND b = 'unknown' THEN 'unknown' WHEN a = 'cheap' AND b = 'cheap' THEN 'good' WHEN a = 'expensive' AND b = 'expensive' THEN 'warning' ELSE 'neutral' END AS status
FROM (SELECT *, CASE WHEN fcf_yield IS NULL THEN 'unknown' WHEN fcf_yield > 5 THEN 'cheap' WHEN fcf_yield >= 2 THEN 'fair' ELSE 'expensive' END AS a,
             CASE WHEN ev_ebitda IS NULL THEN 'unknown' WHEN ev_ebitda < 10 THEN 'cheap' WHEN ev_ebitda <= 20 THEN 'fair' ELSE 'expensive' END AS b
      FROM (SELECT ticker, nullif(free_cashflow,0)/nullif(market_cap,0)*100 AS fcf_yield, nullif(enterprise_value,0)/nullif(ebitda,0) AS ev_ebitda,
                   nullif(free_cashflow,0)/nullif(shares_outstanding,0) AS fcf_per_share FROM v_info) x) y"""


@query("cash_flow_yield_and_multiple", "G-08", f"""
SELECT ticker, r6(fcf_yield) AS fcf_yield, r6(ev_ebitda) AS ev_ebitda, r6(fcf_per_share) AS fcf_per_share, a AS fcf_interpretation, b AS ev_ebitda_interpretation, status,
 CASE status WHEN 'unknown' THEN {T(M.VALUATION['unknown'])} WHEN 'good' THEN printf({T(M.VALUATION['cheap'])}, fcf_yield, ev_ebitda)
   WHEN 'warning' THEN printf({T(M.VALUATION['expensive'])}, fcf_yield, ev_ebitda)
   ELSE printf({T(M.VALUATION['mixed'])}, CASE WHEN fcf_yield IS NULL THEN {T(M.VALUATION['no_fcf'])} ELSE printf({T(M.VALUATION['fcf'])}, fcf_yield, a) END,
               CASE WHEN ev_ebitda IS NULL THEN {T(M.VALUATION['no_ev'])} ELSE printf({T(M.VALUATION['ev'])}, ev_ebitda, b) END) END AS text FROM v_val""")
def _(m):
    return rounded(sc.advanced_valuation(m.info))


ORACLE_VIEWS["v_bal"] = """
SELECT ticker, net_debt_now,
 CASE WHEN nd < 2 THEN 'unknown' WHEN (d_new-d_old)/nullif(abs(d_old), 0)*100 > 10 THEN 'increasing' WHEN (d_new-d_old)/nullif(abs(d_old), 0)*100 < -10 THEN 'decreasing' ELSE 'stable' END AS debt_trend,
 CASE WHEN nr < 2 THEN 'unknown' WHEN (r_new-r_old)/nullif(abs(r_old), 0)*100 > 10 THEN 'growing' WHEN (r_new-r_old)/nullif(abs(r_old), 0)*100 < -10 THEN 'shrinking' ELSE 'stable' END AS revenue_trend
FROM (SELECT ticker, count(debt) AS nd, count(rev) AS nr, arg_min(debt, age) AS d_new, arg_max(debt, age) AS d_old, arg_min(rev, age) AS r_new, arg_max(rev, age) AS r_old,
             arg_min(round(debt - cash, 2), age) AS net_debt_now
      FROM (SELECT ticker, age, round(max(value) FILTER (WHERE item = 'Total Debt')/1e9, 2) AS debt, round(max(value) FILTER (WHERE item = 'Total Revenue')/1e9, 2) AS rev,
                   round(max(value) FILTER (WHERE item = 'Cash And Cash Equivalents')/1e9, 2) AS cash
            FROM (SELECT *, dense_rank() OVER (PARTITION BY ticker ORDER BY period_end DESC) - 1 AS age FROM v_statements) a WHERE age < 4 GROUP BY ticker, age) b GROUP BY ticker) c"""


@query("balance_sheet_trends", "G-09", "SELECT ticker, r6(net_debt_now) AS net_debt_now, debt_trend, revenue_trend FROM v_bal")
def _(m):
    return rounded(sc.balance_trends(m.statements).drop("history"))


ORACLE_VIEWS["v_balsig"] = f"""
SELECT ticker, 'Balance Sheet' AS label, CASE WHEN debt_trend = 'unknown' AND revenue_trend = 'unknown' THEN 'neutral' WHEN revenue_trend = 'shrinking' THEN 'warning' WHEN debt_trend = 'decreasing' THEN 'good'
   WHEN debt_trend = 'increasing' THEN 'warning' WHEN revenue_trend = 'growing' THEN 'good' ELSE 'neutral' END AS status,
 CASE WHEN debt_trend = 'unknown' AND revenue_trend = 'unknown' THEN {T(M.BALANCE['none'])} ELSE
   concat_ws(' ', CASE debt_trend WHEN 'decreasing' THEN {T(M.BALANCE['decreasing'])} WHEN 'increasing' THEN {T(M.BALANCE['increasing'])} WHEN 'stable' THEN {T(M.BALANCE['stable'])} END,
     CASE revenue_trend WHEN 'growing' THEN {T(M.BALANCE['growing'])} WHEN 'shrinking' THEN {T(M.BALANCE['shrinking'])} END,
     printf({T(M.BALANCE['net'])}, abs(net_debt_now), CASE WHEN net_debt_now > 0 THEN 'debt' ELSE 'cash' END)) END AS text FROM v_bal"""


@query("balance_sheet_signal", "G-10", "SELECT * FROM v_balsig")
def _(m):
    return sc.balance_signal(sc.balance_trends(m.statements))


ORACLE_VIEWS["v_shares"] = """
SELECT *, CASE WHEN pct IS NULL THEN 'unknown' WHEN pct < -1 THEN 'buyback' WHEN pct > 2 THEN 'diluting' ELSE 'stable' END AS share_trend
FROM (SELECT ticker, osn0, osn1, CASE WHEN osn0 > 0 AND osn1 > 0 THEN (osn0-osn1)/osn1*100 END AS pct FROM v_years) a"""


@query("share_count_change", "G-11", f"""
SELECT ticker, osn0 AS shares_current, osn1 AS shares_prior, r6(pct) AS share_change_pct, share_trend,
 CASE share_trend WHEN 'buyback' THEN 'good' WHEN 'diluting' THEN 'warning' ELSE 'neutral' END AS status,
 CASE share_trend WHEN 'unknown' THEN {T(M.DILUTION['unknown'])} WHEN 'buyback' THEN printf({T(M.DILUTION['buyback'])}, abs(round(pct,2)))
   WHEN 'diluting' THEN printf({T(M.DILUTION['diluting'])}, round(pct,2)) ELSE printf({T(M.DILUTION['stable'])}, abs(round(pct,2))) END AS text FROM v_shares""")
def _(m):
    counts = sc.share_count(sc.statement_years(m.statements))
    return rounded(counts.join(sc.share_signal(counts).drop("label"), "ticker"))
