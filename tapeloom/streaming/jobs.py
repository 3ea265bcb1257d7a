"""Streaming bars, one-shot alerts, watchlist refresh and ledger outcomes.

Each function takes streaming DataFrames and returns a streaming DataFrame or a
started query; state lives in the query's checkpoint, so a restart continues.
"""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def file_stream(spark, path: str, schema, only: str = "*.parquet") -> DataFrame:
    """The parquet files of a folder that match `only`, as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", only).parquet(path)


def tick_bars(ticks: DataFrame, width: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """Tumbling bars per ticker; ticks older than the watermark are dropped.

    min_by/max_by merge map-side, so a ticker with a third of all ticks is
    reduced before the state store sees it.
    """
    order = F.struct("ts", "event_id")
    marked = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    bars = marked.groupBy(F.window("ts", width), "ticker").agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", order).alias("close"), F.sum("qty").alias("volume"))
    return bars.select("ticker", F.col("window.start").alias("start"), "open", "high", "low", "close", "volume")


def append_to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (stream.writeStream.format("parquet").outputMode("append").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def price_extremes(ticks: DataFrame) -> DataFrame:
    """A row for every ticker whose highest or lowest price a batch has moved: both, and what they were before.

    The state is one row per ticker; a batch's prices of a ticker are looked at in chunks.
    """
    def track(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        was = state.get if state.exists else (None, None)
        high, low = was
        for frame in frames:
            prices = frame["price"].dropna()
            if len(prices):
                high, low = (float(end if known is None else pick(known, end)) for known, end, pick in ((high, prices.max(), max), (low, prices.min(), min)))
        if high is not None and (high, low) != was:
            state.update((high, low))
            yield pd.DataFrame({"ticker": [key[0]], "high": [high], "low": [low], "was_high": [was[0]], "was_low": [was[1]]}).astype({"was_high": "float64", "was_low": "float64"})
    return ticks.select("ticker", F.col("price").cast("double").alias("price")).groupBy("ticker").applyInPandasWithState(
        track, "ticker string, high double, low double, was_high double, was_low double", "high double, low double", "append", GroupStateTimeout.NoTimeout)


def one_shot_alerts(ticks: DataFrame, alerts: DataFrame, fired_path: str, checkpoint: str) -> StreamingQuery:
    """Fire each alert once, at the first batch whose prices cross it.

    A ticker's running extremes are the only state: an alert fires in the batch that moves them over its threshold, so nothing that
    was fired is ever read again, and a restart goes on from the state. Alerts are those known when the query starts.
    """
    moved, threshold = price_extremes(ticks), F.col("threshold").cast("double")
    above = (F.col("direction") == "above") & (F.col("high") >= threshold) & (F.nanvl(F.col("was_high"), F.lit(None).cast("double")).isNull() | (F.col("was_high") < threshold))
    below = (F.col("direction") == "below") & (F.col("low") <= threshold) & (F.nanvl(F.col("was_low"), F.lit(None).cast("double")).isNull() | (F.col("was_low") > threshold))
    price = F.when(F.col("direction") == "above", F.col("high")).otherwise(F.col("low"))
    fired = moved.join(alerts, "ticker").filter(above | below).select(F.col("alert_id").cast("bigint").alias("alert_id"), "ticker", "direction", threshold.alias("threshold"), price.alias("price"))
    return append_to_table(fired, fired_path, checkpoint)


def watchlist_refresh(ticks: DataFrame, watchlist: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Latest price and change since the first tick of every watched ticker; a batch publishes the tickers it has moved."""
    order = F.struct("ts", "event_id")
    state = ticks.join(watchlist, "ticker", "left_semi").groupBy("ticker").agg(F.max_by("price", order).alias("price"), F.min_by("price", order).alias("_first"))
    view = state.select("ticker", "price", ((F.col("price") - F.col("_first")) / F.col("_first") * 100).alias("change_pct"))

    def publish(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
    return view.writeStream.outputMode("update").foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watchlist_now(published: DataFrame) -> DataFrame:
    """Every ticker as the newest batch that moved it has published it."""
    newest = published.groupBy("ticker").agg(F.max_by(F.struct("price", "change_pct"), "epoch").alias("now"))
    return newest.select("ticker", "now.price", "now.change_pct")


def ledger_outcomes(ledger: DataFrame, bars: DataFrame, days: int = 7, slack: int = 3, late: str = "30 days") -> DataFrame:
    """Join predictions with the bars that arrive `days` to days+slack later.

    The interval and both watermarks bound the join state.
    """
    left = ledger.withColumn("pred_at", F.col("date").cast("timestamp")).drop("date").withWatermark("pred_at", late)
    right = bars.select(F.col("ticker").alias("_t"), F.col("date").cast("timestamp").alias("bar_at"), F.col("close").alias("realized_price")).withWatermark("bar_at", late)
    joined = left.join(right, (F.col("ticker") == F.col("_t")) & (F.col("bar_at") >= F.col("pred_at") + F.expr(f"INTERVAL {days} DAYS"))
                       & (F.col("bar_at") < F.col("pred_at") + F.expr(f"INTERVAL {days + slack} DAYS")))
    gain = (F.col("realized_price") - F.col("price_at_prediction")) / F.col("price_at_prediction")
    return joined.select("ticker", F.to_date("pred_at").alias("date"), F.to_date("bar_at").alias("checked_date"), "realized_price", gain.alias("realized_return"))
