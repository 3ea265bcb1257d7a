"""Market-shaped views over the star schema.

The tables hold trades (`lineitem` joined with `part`), not prices; the views
give every operator a deterministic input. `bars` carries the heavy reduction
from trades to one row per (ticker, date). It is a pure partial aggregate:
min_by/max_by replace first/last window ranking, so a ticker holding a third
of all trades is reduced inside each map task before anything is shuffled, and
what remains per ticker is bounded by the number of calendar days.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions.exprs import spread
from tapeloom.session import cut_lineage, lookup
from tapeloom.sources.tables import BASE_TABLES, names_in, run_sql, table

BRAND_NUMBER = "CAST(replace(p.p_brand, 'Brand#', '') AS INT)"

VIEW_SQL = {
    "v_sectors": """
SELECT DISTINCT p_brand AS ticker,
       concat('S', CAST(CAST(replace(p_brand, 'Brand#', '') AS INT) % 5 AS STRING)) AS sector FROM part""",
    "v_bench": "SELECT date, avg(close) AS close FROM v_bars GROUP BY date",
    "v_etf": """
SELECT s.sector, b.date, avg(b.close) AS close FROM v_bars b JOIN v_sectors s ON b.ticker = s.ticker
GROUP BY s.sector, b.date""",
    "v_facts": """
SELECT ticker, concept,
       CASE concept WHEN 'Revenues' THEN rev WHEN 'NetIncomeLoss' THEN ni WHEN 'Liabilities' THEN liab ELSE eq END AS value,
       CASE WHEN concept IN ('Revenues', 'NetIncomeLoss') THEN make_date(y, 1, 1) END AS start_date,
       make_date(y, 12, 31) AS fiscal_period_end, make_date(y + 1, 2, 15) AS filed_date
FROM (SELECT p.p_brand AS ticker, CAST(year(l.l_shipdate) AS INT) AS y, round(sum(l.l_extendedprice), 2) AS rev,
             round(sum(l.l_extendedprice*(l.l_discount-l.l_tax/2)), 2) AS ni,
             round(sum(l.l_extendedprice*l.l_tax), 2) AS liab, sum(l.l_quantity*100) AS eq
      FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY p.p_brand, CAST(year(l.l_shipdate) AS INT)) z
CROSS JOIN (VALUES ('Revenues'), ('NetIncomeLoss'), ('Liabilities'), ('StockholdersEquity')) AS c(concept)""",
    "v_insider": """
SELECT p.p_brand AS ticker, CAST(o.o_orderdate AS DATE) AS date,
       CASE o.o_orderstatus WHEN 'F' THEN 'Purchase at market' WHEN 'O' THEN 'Sale' ELSE 'Stock Gift' END AS text,
       l.l_quantity AS shares, l.l_orderkey AS order_id, l.l_linenumber AS line_id, l.l_suppkey AS party_id
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey""",
    "v_grades": """
SELECT p.p_brand AS ticker, CAST(o.o_orderdate AS DATE) AS date,
       CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Strong Buy' WHEN '2-HIGH' THEN 'Buy' WHEN '3-MEDIUM' THEN 'Hold'
            WHEN '5-LOW' THEN 'Sell' ELSE 'Not Rated' END AS to_grade
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey""",
    "v_earnings": """
SELECT ticker, qd AS earnings_date, eps_actual, eps_estimate,
       CASE WHEN eps_estimate <> 0 THEN round((eps_actual-eps_estimate)/abs(eps_estimate)*100, 4) END AS surprise_pct
FROM (SELECT p.p_brand AS ticker, CAST(date_trunc('quarter', l.l_shipdate) AS DATE) AS qd,
             round(avg(l.l_discount)*20, 4) AS eps_actual, round(avg(l.l_tax)*25, 4) AS eps_estimate
      FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
      GROUP BY p.p_brand, CAST(date_trunc('quarter', l.l_shipdate) AS DATE)) q""",
    "v_options": """
SELECT p.p_brand AS ticker, CAST(date_trunc('month', l.l_shipdate) AS DATE) AS expiry,
       CASE WHEN l.l_returnflag = 'A' OR (l.l_returnflag = 'N' AND l.l_linenumber % 2 = 0) THEN 'call' ELSE 'put' END AS side,
       CAST(90 + l.l_linenumber*3 AS DOUBLE) AS strike, 0.1 + l.l_discount*4 AS iv, l.l_quantity AS volume
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey""",
    "v_positions": """
SELECT o.o_custkey AS account, p.p_brand AS ticker, sum(l.l_quantity) AS shares,
       round(sum(l.l_quantity*100*(1-l.l_discount))/sum(l.l_quantity), 4) AS buy_price
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
GROUP BY o.o_custkey, p.p_brand""",
    "v_news": """
SELECT d.doc_id, concat('Brand#', CAST(d.doc_id % 25 + 1 AS STRING)) AS ticker, d.text, d.lang, d.source,
       CASE WHEN l.doc_id IS NULL THEN 'unknown' WHEN l.toxic = 1 THEN 'negative'
            WHEN l.quality = 1 THEN 'positive' ELSE 'neutral' END AS sentiment
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "v_ticks": """
SELECT event_id, ts, concat('U', CAST(user_id % 25 AS STRING)) AS ticker, 50 + value AS price, CAST(1 AS BIGINT) AS qty
FROM events""",
    "v_llm_calls": """
SELECT event_id AS id, concat('U', CAST(user_id % 25 AS STRING)) AS ticker, event_type AS source,
       CAST(floor(value*10) AS BIGINT) AS in_tokens, CAST(floor(value) AS BIGINT) AS out_tokens,
       value/1000 AS cost_usd, ts AS created_at, props FROM events""",
    "v_info": f"""
SELECT ticker, n,
       CASE WHEN n % 7 <> 0 THEN round((n-5)*2 + q/10, 8) END AS trailing_pe,
       CASE WHEN n % 5 <> 0 THEN round((n-4)*1.5 + q/10, 8) END AS forward_pe,
       CASE WHEN n % 11 <> 0 THEN round(d*(n-8)/5, 8) END AS profit_margin,
       CASE WHEN n % 13 <> 0 THEN round(t*(n-5), 8) END AS roe,
       CASE WHEN n % 9 <> 0 THEN round(q*n/3, 8) END AS debt_to_equity,
       CASE WHEN n % 8 <> 0 THEN round((d-0.05)*10 + (n-12)*0.02, 8) END AS revenue_growth,
       CASE WHEN n % 6 <> 0 THEN round((t-0.04)*10 + (n-15)*0.025, 8) END AS earnings_growth,
       CASE WHEN n % 10 <> 0 THEN round(rev*(n-6)*0.004, 2) END AS free_cashflow,
       CASE WHEN n % 12 <> 0 THEN round(rev*0.8, 2) END AS market_cap,
       round(rev*0.3*(n%4), 2) AS gross_profit,
       CASE WHEN n % 14 <> 0 THEN round(q/(10+n), 8) END AS current_ratio,
       CASE WHEN n % 15 <> 0 THEN round(n*0.08 + d, 8) END AS beta,
       CASE WHEN n % 16 <> 0 THEN round(n*0.5 + d, 8) END AS short_ratio,
       CASE WHEN n % 17 <> 0 THEN round(n*0.012 + d/10, 8) END AS short_pct_float,
       round(n*0.035 + t/10, 8) AS insider_pct, round(0.95 - n*0.035 + d*0, 8) AS institution_pct,
       round(rev*0.05*(n-3), 2) AS ebitda, round(rev*(0.4 + n*0.02), 2) AS enterprise_value,
       round(qty*10, 2) AS shares_outstanding,
       round(95 + n*1.3 + d, 8) AS target_mean, round(80 + n + d, 8) AS target_low, round(120 + n + d, 8) AS target_high,
       CASE n % 6 WHEN 0 THEN 'strong_buy' WHEN 1 THEN 'buy' WHEN 2 THEN 'hold' WHEN 3 THEN 'sell'
            WHEN 4 THEN 'strong_sell' ELSE 'none' END AS recommendation, n % 20 AS n_analysts
FROM (SELECT p.p_brand AS ticker, {BRAND_NUMBER} AS n, avg(l.l_quantity) AS q, avg(l.l_discount) AS d,
             avg(l.l_tax) AS t, sum(l.l_extendedprice) AS rev, sum(l.l_quantity) AS qty
      FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY p.p_brand, {BRAND_NUMBER}) g""",
    "v_statements": f"""
SELECT z.ticker, i.stmt, i.item, make_date(z.y, 12, 31) AS period_end,
       CASE i.k WHEN 1 THEN z.ni WHEN 2 THEN z.rev*2 WHEN 3 THEN z.ni*1.2 - z.liab*0.3
                WHEN 4 THEN z.liab*0.5 WHEN 5 THEN z.rev*0.4 + z.ni WHEN 6 THEN z.rev*0.3 - z.ni
                WHEN 7 THEN z.rev*0.35 + z.ni*0.2 WHEN 8 THEN z.rev WHEN 9 THEN z.ni*1.5
                WHEN 10 THEN z.ni*1.1 WHEN 11 THEN z.liab*4 WHEN 12 THEN z.rev - z.liab
                WHEN 13 THEN z.qty*100 WHEN 14 THEN z.rev*0.05 + z.ni WHEN 15 THEN z.liab*1.5 WHEN 16 THEN z.qty*90 END AS value
FROM (SELECT p.p_brand AS ticker, {BRAND_NUMBER} AS n, CAST(year(l.l_shipdate) AS INT) AS y, round(sum(l.l_extendedprice), 2) AS rev,
             round(sum(l.l_extendedprice*(l.l_discount-l.l_tax*1.2)), 2) AS ni,
             round(sum(l.l_extendedprice*l.l_tax), 2) AS liab, sum(l.l_quantity) AS qty
      FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
      GROUP BY p.p_brand, {BRAND_NUMBER}, CAST(year(l.l_shipdate) AS INT)) z
CROSS JOIN (VALUES ('income', 'Net Income', 1), ('balance', 'Total Assets', 2), ('cash', 'Operating Cash Flow', 3),
            ('balance', 'Long Term Debt', 4), ('balance', 'Current Assets', 5), ('balance', 'Current Liabilities', 6),
            ('income', 'Gross Profit', 7), ('income', 'Total Revenue', 8), ('balance', 'Retained Earnings', 9),
            ('income', 'EBIT', 10), ('balance', 'Total Liabilities Net Minority Interest', 11),
            ('balance', 'Stockholders Equity', 12), ('balance', 'Ordinary Shares Number', 13),
            ('balance', 'Cash And Cash Equivalents', 14), ('balance', 'Total Debt', 15), ('balance', 'Shares Outstanding', 16)) AS i(stmt, item, k)
WHERE NOT (i.k = 4 AND z.n % 6 = 0) AND NOT (i.k = 7 AND z.n % 8 = 0) AND NOT (i.k = 11 AND z.n % 9 = 0)""",
    "v_vix": """
SELECT date, sd * 16 * 100 AS vix FROM (
  SELECT date, stddev_samp(r) OVER (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS sd,
         count(r) OVER (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS n
  FROM (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS r FROM v_bench) a) b WHERE n >= 20""",
    "v_holders": """
SELECT p.p_brand AS ticker, concat('Fund ', CAST(l.l_suppkey AS STRING)) AS holder, sum(l.l_quantity) AS shares
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY p.p_brand, concat('Fund ', CAST(l.l_suppkey AS STRING))""",
    "v_watchlist": """
SELECT DISTINCT p.p_brand AS ticker FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
JOIN (SELECT max_by(c_custkey, c_acctbal) AS owner FROM customer) w ON o.o_custkey = w.owner""",
    "v_alerts": """
SELECT o.o_orderkey * 100 + l.l_linenumber AS alert_id, p.p_brand AS ticker,
       CASE WHEN (o.o_orderkey + l.l_linenumber) % 2 = 0 THEN 'above' ELSE 'below' END AS direction,
       96 + (o.o_orderkey + l.l_linenumber) % 13 AS threshold, CASE WHEN (o.o_orderkey + l.l_linenumber) % 9 = 0 THEN 1 ELSE 0 END AS triggered
FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
GROUP BY o.o_orderkey, l.l_linenumber, p.p_brand""",
}

BARS_ORACLE = """
SELECT ticker, date, max(CASE WHEN ra = 1 THEN px END) AS open, max(px) AS high, min(px) AS low,
       max(CASE WHEN rd = 1 THEN px END) AS close, sum(qty) AS volume
FROM (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY l_orderkey, l_linenumber, l_suppkey, px) AS ra,
             row_number() OVER (PARTITION BY ticker, date ORDER BY l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, px DESC) AS rd
      FROM (SELECT p.p_brand AS ticker, CAST(l.l_shipdate AS DATE) AS date,
                   100*(1-l.l_discount)*(1+l.l_tax) + l.l_extendedprice/100003 AS px,
                   l.l_quantity AS qty, l.l_orderkey, l.l_linenumber, l.l_suppkey
            FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey) x) y
GROUP BY ticker, date"""


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    price = 100 * (1 - F.col("l_discount")) * (1 + F.col("l_tax")) + F.col("l_extendedprice") / 100003
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        F.col("p_brand").alias("ticker"), F.to_date("l_shipdate").alias("date"), price.alias("px"),
        F.col("l_quantity").alias("qty"), "l_orderkey", "l_linenumber", "l_suppkey")


ROWS_A_TASK = 1_000_000     # trades that one task of a join by order takes
BY_ORDER = {"orders": "o_orderkey", "lineitem": "l_orderkey", "part": "p_partkey"}
_rows: dict[tuple[str, str], int] = {}


def tasks(spark: SparkSession, sf_dir: str) -> int:
    """The session's shuffle partitions, or more if the folder's trades ask for them (counted once, from the files' footers)."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _rows:
        _rows[at] = table(spark, sf_dir, "lineitem").count()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-_rows[at] // ROWS_A_TASK))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily open/high/low/close/volume, unique by (ticker, date)."""
    order = F.struct("l_orderkey", "l_linenumber", "l_suppkey", "px")
    return trades(spark, sf_dir).groupBy("ticker", "date").agg(
        F.min_by("px", order).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"),
        F.max_by("px", order).alias("close"), F.sum("qty").alias("volume"))


def bars_of_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same bars without sorting the trades: sums and the first and last order of a day by hash, then open and close among
    the trades of these two orders. A missing order key comes first, as in a struct."""
    rows = trades(spark, sf_dir)
    days = lookup(rows.groupBy("ticker", "date").agg(
        F.max("px").alias("high"), F.min("px").alias("low"), F.sum("qty").alias("volume"), F.max("l_orderkey").alias("_last"),
        F.min("l_orderkey").alias("_least"), F.max(F.col("l_orderkey").isNull()).alias("_unknown")))     # one row per ticker and day
    day = days.select(*[F.col(c).alias(f"_{c}") for c in ("ticker", "date")], "high", "low", "volume", F.when(~F.col("_unknown"), F.col("_least")).alias("_first"), "_last")
    at = F.col("l_orderkey")
    same = F.col("ticker").eqNullSafe(F.col("_ticker")) & F.col("date").eqNullSafe(F.col("_date"))
    ends = rows.join(day, same & (at.eqNullSafe(F.col("_first")) | at.eqNullSafe(F.col("_last"))))
    order = F.struct("l_orderkey", "l_linenumber", "l_suppkey", "px")
    return ends.groupBy("ticker", "date").agg(
        F.min_by("px", order).alias("open"), F.first("high").alias("high"), F.first("low").alias("low"),
        F.max_by("px", order).alias("close"), F.first("volume").alias("volume"))


class Market:
    """The inputs of one folder by view name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._kept: dict[str, DataFrame] = {}
        self._built: DataFrame | None = None

    def staged(self, *names: str) -> "Market":
        """Derive views once for a query that reads them several times.

        Each is a reliable checkpoint in the shared folder, so the trades are
        scanned once and a lost executor re-reads files.
        """
        for name in names or ("v_bars",):
            if name not in self._kept:
                self._kept[name] = cut_lineage(self[name])
        return self

    @property
    def series(self) -> DataFrame:
        """Bars laid out for per-ticker windows."""
        return spread(self["v_bars"])

    def __getitem__(self, name: str) -> DataFrame:
        if name in self._kept:
            return self._kept[name]
        if name in BASE_TABLES:
            return table(self.spark, self.sf_dir, name)
        if name == "v_bars":
            return self._bars()
        known = (*BASE_TABLES, "v_bars", *VIEW_SQL)
        by_order = {"orders", "lineitem"} <= set(names_in(VIEW_SQL[name], known))
        return run_sql(self.spark, VIEW_SQL[name], self._dealt if by_order else self.__getitem__, known)

    def _many(self) -> int:
        """Tasks for the folder's trades if they are more than the session's shuffle partitions, else 0."""
        n = tasks(self.spark, self.sf_dir)
        return n if n > int(self.spark.conf.get("spark.sql.shuffle.partitions")) else 0

    def _bars(self) -> DataFrame:
        if self._built is None:
            self._built = (bars_of_many if self._many() else bars)(self.spark, self.sf_dir)
        return self._built

    def _dealt(self, name: str) -> DataFrame:
        """A side of a join by order: many trades are dealt over more tasks, so that a task sorts no more of them as they grow."""
        n = self._many()
        return self[name].repartition(n, BY_ORDER[name]) if n and name in BY_ORDER else self[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        view = f"v_{name}"
        return self[view if view == "v_bars" or view in VIEW_SQL else name]
