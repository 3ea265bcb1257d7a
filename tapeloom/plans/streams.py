"""Streaming queries (inventory family S), run to completion on the stored files."""
from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.plans.accounts import ledger_of
from tapeloom.plans.registry import ORACLE_VIEWS, query
from tapeloom.session import scratch_folder
from tapeloom.streaming import jobs


def ticks(m):
    """The events file as a stream of ticks."""
    events = jobs.file_stream(m.spark, m.sf_dir, m.events.schema, only="events.parquet")
    return events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("U"), (F.col("user_id") % 25).cast("string")).alias("ticker"),
                         (50 + F.col("value")).alias("price"), F.lit(1).cast("bigint").alias("qty"))


@query("streaming_tick_bars", "S-01", """
SELECT ticker, CAST(CAST(ts AS DATE) AS VARCHAR) AS start, arg_min(price, (ts, event_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, event_id)) AS close, CAST(sum(qty) AS BIGINT) AS volume FROM v_ticks
GROUP BY ticker, CAST(ts AS DATE) HAVING CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM v_ticks)""")
def _(m):
    out, state = scratch_folder(m.spark), scratch_folder(m.spark)
    jobs.append_to_table(jobs.tick_bars(ticks(m)), out, state).awaitTermination()
    rows = m.spark.read.schema("ticker string, start timestamp, open double, high double, low double, close double, volume bigint").parquet(out)
    return rows.withColumn("start", F.date_format("start", "yyyy-MM-dd"))


ORACLE_VIEWS["v_tick_alerts"] = "SELECT c_custkey AS alert_id, concat('U', CAST(c_custkey % 25 AS VARCHAR)) AS ticker, CASE WHEN c_custkey % 2 = 0 THEN 'above' ELSE 'below' END AS direction, CASE WHEN c_custkey % 2 = 0 THEN 60 + c_custkey % 211 ELSE 50.0 + (c_custkey % 97)/100 END AS threshold FROM customer"


@query("streaming_one_shot_alerts", "S-02", """
SELECT a.alert_id, a.ticker, a.direction, CASE WHEN a.direction = 'above' THEN hi ELSE lo END AS price FROM v_tick_alerts a JOIN (SELECT ticker, max(price) AS hi, min(price) AS lo FROM v_ticks GROUP BY ticker) t USING (ticker)
WHERE (a.direction = 'above' AND hi >= threshold) OR (a.direction = 'below' AND lo <= threshold)""")
def _(m):
    fired, state = scratch_folder(m.spark), scratch_folder(m.spark)
    key = F.col("c_custkey")
    alerts = m.customer.select(key.alias("alert_id"), F.concat(F.lit("U"), (key % 25).cast("string")).alias("ticker"), F.when(key % 2 == 0, "above").otherwise("below").alias("direction"),
                               F.when(key % 2 == 0, (60 + key % 211).cast("double")).otherwise(50 + (key % 97) / 100).alias("threshold"))
    jobs.one_shot_alerts(ticks(m), alerts, fired, state).awaitTermination()
    rows = m.spark.read.schema("alert_id bigint, ticker string, direction string, threshold double, price double").parquet(fired)
    return rows.select("alert_id", "ticker", "direction", "price")


@query("streaming_watchlist", "S-03", """
SELECT ticker, arg_max(price, (ts, event_id)) AS price, r6((arg_max(price, (ts, event_id)) - arg_min(price, (ts, event_id)))/arg_min(price, (ts, event_id))*100) AS change_pct FROM v_ticks
WHERE ticker IN (SELECT concat('U', CAST(n_nationkey AS VARCHAR)) FROM nation WHERE n_regionkey = 1) GROUP BY ticker""")
def _(m):
    out, state = scratch_folder(m.spark), scratch_folder(m.spark)
    watched = m.nation.filter(F.col("n_regionkey") == 1).select(F.concat(F.lit("U"), F.col("n_nationkey").cast("string")).alias("ticker"))
    jobs.watchlist_refresh(ticks(m), watched, out, state).awaitTermination()
    rows = m.spark.read.schema("ticker string, price double, change_pct double, epoch bigint").parquet(out)
    return jobs.watchlist_now(rows).select("ticker", "price", F.round("change_pct", 6).alias("change_pct"))


@query("streaming_ledger_outcomes", "S-04", """
SELECT l.ticker, l.date, b.date AS checked_date, b.close AS realized_price, r6((b.close-price_at_prediction)/price_at_prediction) AS realized_return FROM v_ledger l JOIN v_bars b ON b.ticker = l.ticker AND b.date >= l.date + 7 AND b.date < l.date + 10""")
def _(m):
    m.staged()
    ledger_dir, bars_dir, out, state = (scratch_folder(m.spark) for _ in range(4))
    ledger = ledger_of(m).select("ticker", "date", "price_at_prediction")
    ledger.write.mode("overwrite").parquet(ledger_dir)
    m.bars.select("ticker", "date", "close").write.mode("overwrite").parquet(bars_dir)
    joined = jobs.ledger_outcomes(jobs.file_stream(m.spark, ledger_dir, "ticker string, date date, price_at_prediction double"),
                                  jobs.file_stream(m.spark, bars_dir, "ticker string, date date, close double"))
    jobs.append_to_table(joined, out, state).awaitTermination()
    rows = m.spark.read.schema("ticker string, date date, checked_date date, realized_price double, realized_return double").parquet(out)
    return rows.withColumn("realized_return", F.round("realized_return", 6))
