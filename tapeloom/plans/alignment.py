"""Alignment, source and sink queries (inventory families A and D)."""
from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.exprs import rounded
from tapeloom.operators import alignment as al
from tapeloom.operators.features import overlay, snapshot_features
from tapeloom.plans.registry import ORACLE_VIEWS, query
from tapeloom.sources import facts as fx
from tapeloom.sources.selection import ticker_lists, trailing_period, universe

ORACLE_VIEWS["v_pit_raw"] = """
SELECT d.ticker, d.filed_date,
  (SELECT arg_max(value, (f.filed_date, f.fiscal_period_end)) FROM v_facts f WHERE f.ticker = d.ticker AND f.filed_date <= d.filed_date AND concept = 'Revenues' AND date_diff('day', start_date, fiscal_period_end) BETWEEN 350 AND 380) AS rev,
  (SELECT arg_max(value, (f.filed_date, f.fiscal_period_end)) FROM v_facts f WHERE f.ticker = d.ticker AND f.filed_date <= d.filed_date AND concept = 'NetIncomeLoss' AND date_diff('day', start_date, fiscal_period_end) BETWEEN 350 AND 380) AS ni,
  (SELECT arg_max(value, (f.filed_date, f.fiscal_period_end)) FROM v_facts f WHERE f.ticker = d.ticker AND f.filed_date <= d.filed_date AND concept = 'Liabilities') AS tl,
  (SELECT arg_max(value, (f.filed_date, f.fiscal_period_end)) FROM v_facts f WHERE f.ticker = d.ticker AND f.filed_date <= d.filed_date AND concept = 'StockholdersEquity') AS eq,
  (SELECT max(fiscal_period_end) FROM v_facts f WHERE f.ticker = d.ticker AND f.filed_date <= d.filed_date AND concept = 'Revenues' AND date_diff('day', start_date, fiscal_period_end) BETWEEN 350 AND 380) AS e_now
FROM (SELECT DISTINCT ticker, filed_date FROM v_facts) d"""
ORACLE_VIEWS["v_pit"] = """
SELECT d.ticker, d.filed_date, (n.value - p.value)/abs(p.value) AS revenue_growth, ni/nullif(rev,0) AS profit_margin, ni/nullif(eq,0) AS roe, tl/nullif(eq,0) AS debt_to_equity
FROM v_pit_raw d
LEFT JOIN v_facts n ON n.ticker = d.ticker AND n.concept = 'Revenues' AND n.fiscal_period_end = d.e_now
LEFT JOIN v_facts p ON p.ticker = d.ticker AND p.concept = 'Revenues' AND p.filed_date <= d.filed_date AND p.fiscal_period_end <= d.e_now - 365 AND p.fiscal_period_end > d.e_now - 465"""
RATIO_COLS = "r6({p}revenue_growth) AS revenue_growth, r6({p}profit_margin) AS profit_margin, r6({p}roe) AS roe, r6({p}debt_to_equity) AS debt_to_equity"


@query("bars", "A-01", "SELECT * FROM v_bars")
def _(m):
    return m.bars


@query("trailing_period", "A-02", "SELECT b.* FROM v_bars b WHERE date >= (SELECT max(date) - INTERVAL 3 MONTH FROM v_bars)")
def _(m):
    return trailing_period(m.bars, 3)


@query("benchmark_close", "A-03", "SELECT date, r6(close) AS close FROM v_bench")
def _(m):
    return rounded(m.bench)


@query("sector_close", "A-03", "SELECT sector, date, r6(close) AS close FROM v_etf")
def _(m):
    return rounded(m.etf)


def documents(m):
    """Facts documents derived from the tables; every third ticker also has newer tags."""
    facts = m.facts.select("ticker", F.col("concept").alias("tag"), "value", "start_date", "fiscal_period_end", "filed_date")
    newer = facts.filter((F.col("tag") == "Revenues") & (F.year("fiscal_period_end") >= 1998)
                         & (F.regexp_extract("ticker", r"(\d+)", 1).cast("int") % 3 == 0)).withColumn(
        "tag", F.lit("RevenueFromContractWithCustomer")).withColumn("value", F.col("value") * 2)
    tiny = facts.filter(F.col("tag") == "Liabilities").withColumn("value", F.lit(0.5))
    fact = F.struct(F.col("value").alias("val"), F.col("fiscal_period_end").cast("string").alias("end"),
                    F.col("filed_date").cast("string").alias("filed"), F.col("start_date").cast("string").alias("start"))
    unit = F.when(F.col("tag") == "StockholdersEquity", "pure").otherwise("USD")
    # A company's filings are a few dozen rows by nature.
    tags = facts.unionByName(newer).unionByName(tiny).groupBy("ticker", "tag", unit.alias("unit")).agg(F.collect_list(fact).alias("facts"))
    body = tags.groupBy("ticker").agg(F.map_from_entries(F.collect_list(F.struct(
        "tag", F.struct(F.create_map("unit", "facts").alias("units"))))).alias("g"))
    return body.select("ticker", F.to_json(F.struct(F.struct(F.col("g").alias("us-gaap")).alias("facts"))).alias("body"))


ORACLE_VIEWS["v_tagged"] = """
SELECT ticker, concept AS tag, concept, value, start_date, fiscal_period_end, filed_date FROM v_facts
UNION ALL SELECT ticker, 'RevenueFromContractWithCustomer', concept, value*2, start_date, fiscal_period_end, filed_date FROM v_facts
WHERE concept = 'Revenues' AND year(fiscal_period_end) >= 1998 AND CAST(replace(ticker, 'Brand#', '') AS INT) % 3 = 0"""


@query("company_facts", "A-04", "SELECT ticker, tag, value, start_date, fiscal_period_end, filed_date FROM v_tagged")
def _(m):
    return fx.flatten_company_facts(documents(m))


@query("preferred_tags", "A-05", """
SELECT ticker, concept, value, start_date, fiscal_period_end, filed_date FROM v_tagged t
WHERE tag <> 'Revenues' OR ticker NOT IN (SELECT ticker FROM v_tagged WHERE tag = 'RevenueFromContractWithCustomer')""")
def _(m):
    return fx.preferred_tags(fx.flatten_company_facts(documents(m)))


@query("universe_selection", "A-06", """
SELECT c_name AS ticker, c_custkey AS position FROM (SELECT *, row_number() OVER (PARTITION BY c_name ORDER BY c_custkey) AS rn FROM customer) a
WHERE rn = 1 AND NOT regexp_matches(c_name, '[.-]')""")
def _(m):
    return universe(m.customer.select(F.col("c_name").alias("ticker"), F.col("c_custkey").alias("position")))


@query("ticker_list_normalise", "A-07", """
SELECT conv_id, turn, ticker, pos FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY p0) AS pos FROM (
    SELECT conv_id, turn, min(p) AS p0, ticker FROM (
      SELECT conv_id, turn, p, CASE upper(replace(trim(item), 'ß', 'ss')) WHEN 'BERKSHIRE' THEN 'BRK-B' ELSE upper(replace(trim(item), 'ß', 'ss')) END AS ticker
      FROM (SELECT conv_id, turn, unnest(string_split_regex(text, '[,\\n]+')) AS item, generate_subscripts(string_split_regex(text, '[,\\n]+'), 1) AS p
            FROM conversations) a) b WHERE ticker <> '' GROUP BY conv_id, turn, ticker) c) d""")
def _(m):
    texts = m.conversations.select("conv_id", "turn", "text")
    return ticker_lists(texts, ["conv_id", "turn"], {"BERKSHIRE": "BRK-B"})


@query("asof_join_backward", "D-01", f"SELECT b.ticker, b.date, p.filed_date, {RATIO_COLS.format(p='p.')} FROM v_bars b ASOF LEFT JOIN v_pit p ON b.ticker = p.ticker AND b.date >= p.filed_date")
def _(m):
    pit = al.point_in_time_ratios(m.facts)
    return rounded(al.asof_backward(m.bars.select("ticker", "date"), pit, "filed_date", ["filed_date", *al.RATIOS]))


@query("asof_overlay_fallback", "D-02", """
SELECT b.ticker, b.date, r6(coalesce(p.revenue_growth, i.revenue_growth)) AS revenue_growth, r6(coalesce(p.profit_margin, i.profit_margin)) AS profit_margin,
       r6(coalesce(p.roe, i.roe)) AS roe, r6(coalesce(p.debt_to_equity, clip(i.debt_to_equity, -50, 50))) AS debt_to_equity
FROM v_bars b ASOF LEFT JOIN v_pit p ON b.ticker = p.ticker AND b.date >= p.filed_date LEFT JOIN v_info i ON b.ticker = i.ticker""")
def _(m):
    aligned = al.trailing_sentiment(m.bars.select("ticker", "date"), filings=al.point_in_time_ratios(m.facts), filing_columns=al.RATIOS)
    return rounded(overlay(aligned.join(snapshot_features(m.info).select("ticker", *al.RATIOS), "ticker", "left")).select("ticker", "date", *al.RATIOS))


ORACLE_VIEWS["v_ins"] = """
SELECT b.ticker, b.date, CASE WHEN coalesce(sum(e.buys), 0) + coalesce(sum(e.sells), 0) > 0 THEN (sum(e.buys) - sum(e.sells)) / (sum(e.buys) + sum(e.sells)) ELSE 0.0 END AS insider_net_ratio
FROM v_bars b LEFT JOIN (SELECT ticker, date, count(*) FILTER (WHERE text ILIKE '%purchase%' OR text ILIKE '%buy%')::DOUBLE AS buys,
                                count(*) FILTER (WHERE text ILIKE '%sale%' OR text ILIKE '%sell%')::DOUBLE AS sells FROM v_insider GROUP BY ticker, date) e
  ON e.ticker = b.ticker AND e.date BETWEEN b.date - 90 AND b.date GROUP BY b.ticker, b.date"""
ORACLE_VIEWS["v_ana"] = """
SELECT b.ticker, b.date, coalesce(sum(e.s)/sum(e.n), 0.0) AS analyst_score
FROM v_bars b LEFT JOIN (SELECT ticker, date, sum(g)::DOUBLE AS s, count(g) AS n FROM (
    SELECT ticker, date, CASE lower(to_grade) WHEN 'strong buy' THEN 2 WHEN 'buy' THEN 1 WHEN 'hold' THEN 0 WHEN 'sell' THEN -1 END AS g FROM v_grades) x WHERE g IS NOT NULL GROUP BY ticker, date) e
  ON e.ticker = b.ticker AND e.date BETWEEN b.date - 180 AND b.date GROUP BY b.ticker, b.date"""


@query("insider_ratio_trailing_90d", "D-03, C-30", "SELECT ticker, date, r6(insider_net_ratio) AS insider_net_ratio FROM v_ins")
def _(m):
    return rounded(al.trailing_sentiment(m.bars.select("ticker", "date"), insider=m.insider))


@query("analyst_mean_trailing_180d", "D-04, C-31", "SELECT ticker, date, r6(analyst_score) AS analyst_score FROM v_ana")
def _(m):
    return rounded(al.trailing_sentiment(m.bars.select("ticker", "date"), grades=m.grades))


@query("asof_close_at_event", "D-05", "SELECT e.ticker, e.earnings_date, b.close, b.date AS bar_date FROM v_earnings e ASOF LEFT JOIN v_bars b ON e.ticker = b.ticker AND e.earnings_date >= b.date")
def _(m):
    events = m.earnings.select("ticker", F.col("earnings_date").alias("date"))
    bars = m.bars.select("ticker", F.col("date").alias("bar_date"), "close")
    hit = al.asof_backward(events, bars, "bar_date", ["bar_date", "close"])
    return hit.select("ticker", F.col("date").alias("earnings_date"), "close", "bar_date")


@query("entry_bar_forward_asof", "D-06", "SELECT e.ticker, e.earnings_date, b.date AS entry_date, b.close AS entry_price FROM v_earnings e ASOF LEFT JOIN v_bars b ON e.ticker = b.ticker AND e.earnings_date <= b.date")
def _(m):
    events = m.earnings.select("ticker", F.col("earnings_date").alias("date"))
    bars = m.bars.select("ticker", F.col("date").alias("entry_date"), F.col("close").alias("entry_price"))
    hit = al.asof_forward(events, bars, "entry_date", ["entry_date", "entry_price"])
    return hit.withColumnRenamed("date", "earnings_date")


@query("bar_offset", "D-07", """
SELECT b.ticker, b.date, x.close AS close_after_30, y.close AS close_before_21 FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn FROM v_bars) b
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn FROM v_bars) x ON x.ticker = b.ticker AND x.rn = b.rn + 30
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn FROM v_bars) y ON y.ticker = b.ticker AND y.rn = b.rn - 21""")
def _(m):
    bars = m.bars.select("ticker", "date", "close")
    events = al.numbered(bars).select("ticker", "date", "rn")
    events = al.bar_offset(events, bars, 30, {"close": "close_after_30"})
    return al.bar_offset(events, bars, -21, {"close": "close_before_21"}).drop("rn")


@query("benchmark_reindex", "D-08", "SELECT b.ticker, b.date, r6(s.close) AS benchmark FROM v_bars b LEFT JOIN v_etf s ON s.date = b.date AND s.sector = 'S1'")
def _(m):
    # A sector's close, which is lacking on the dates without a trade in the sector.
    sector = m.staged().etf.filter(F.col("sector") == "S1")
    return rounded(al.reindexed(m.bars.select("ticker", "date"), sector, "close", "benchmark"))


@query("dates_with_enough_tickers", "D-10", """
SELECT ticker, date, close FROM v_bars WHERE date IN (
  SELECT date FROM v_bars GROUP BY date HAVING count(DISTINCT ticker) >= 0.8 * (SELECT count(DISTINCT ticker) FROM v_bars))""")
def _(m):
    return al.on_all_tickers(m.bars.select("ticker", "date", "close"), share=0.8).select("ticker", "date", "close")


@query("ratios_known_at_date", "D-11", f"""
SELECT ticker, {RATIO_COLS.format(p='')} FROM v_pit QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY CASE WHEN filed_date <= DATE '1998-06-30' THEN filed_date END DESC NULLS LAST) = 1 AND filed_date <= DATE '1998-06-30'""")
def _(m):
    known = al.point_in_time_ratios(m.facts).filter(F.col("filed_date") <= F.lit("1998-06-30").cast("date"))
    last = known.groupBy("ticker").agg(F.max_by(F.struct(*al.RATIOS), "filed_date").alias("r"))
    return rounded(last.select("ticker", "r.*"))


@query("revenue_growth_with_tolerance", "D-12", "SELECT ticker, filed_date, r6(revenue_growth) AS revenue_growth FROM v_pit WHERE revenue_growth IS NOT NULL")
def _(m):
    return rounded(al.point_in_time_ratios(m.facts).select("ticker", "filed_date", "revenue_growth").dropna())


@query("point_in_time_series", "D-13", f"SELECT ticker, filed_date, {RATIO_COLS.format(p='')} FROM v_pit")
def _(m):
    return rounded(al.point_in_time_ratios(m.facts))


ORACLE_VIEWS["v_peer"] = """
SELECT s.ticker, s.sector, any_value(CASE WHEN i.trailing_pe > 0 THEN i.trailing_pe END) AS ticker_pe, count(j.trailing_pe) AS peers, median(j.trailing_pe) AS med
FROM v_sectors s LEFT JOIN v_info i ON i.ticker = s.ticker LEFT JOIN v_sectors t ON t.sector = s.sector AND t.ticker <> s.ticker
LEFT JOIN v_info j ON j.ticker = t.ticker AND j.trailing_pe > 0 GROUP BY s.ticker, s.sector"""


@query("sector_peer_valuation", "D-14", """
SELECT ticker, sector, r6(ticker_pe) AS ticker_pe, CASE WHEN peers >= 3 THEN peers END AS peers_used, r6(CASE WHEN peers >= 3 THEN med END) AS sector_median_pe,
  CASE WHEN peers >= 3 AND ticker_pe IS NOT NULL THEN CASE WHEN ticker_pe/med < 0.85 THEN 'cheap' WHEN ticker_pe/med > 1.15 THEN 'expensive' ELSE 'fair' END END AS pe_vs_sector FROM v_peer""")
def _(m):
    return rounded(al.sector_valuation(m.info, m.sectors))
