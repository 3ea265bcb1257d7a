"""Universe, period and ticker-list selection."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trailing_period(bars: DataFrame, months: int) -> DataFrame:
    """The last months of history, counted from the newest date present."""
    newest = bars.agg(F.max("date").alias("_max"))
    return (bars.crossJoin(F.broadcast(newest))   # one row
            .filter(F.col("date") >= F.add_months("_max", -months)).drop("_max"))


def universe(listed: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct plain tickers in listing order; only the first `limit` where one is given."""
    plain = listed.filter(~F.col("ticker").rlike("[.-]"))
    found = plain.groupBy("ticker").agg(F.min("position").alias("position")).orderBy("position")
    return found if limit is None else found.limit(limit)


def ticker_lists(texts: DataFrame, keys: list[str], aliases: dict[str, str], most: int | None = None) -> DataFrame:
    """Split free text on commas and newlines into ordered, distinct tickers.

    `most` bounds the length of one list, as the screener's input box does.
    """
    items = texts.select(*keys, F.posexplode(F.split("text", r"[,\n]+")).alias("_p", "_item"))
    clean = F.upper(F.trim("_item"))
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    named = items.select(*keys, "_p", F.coalesce(table[clean], clean).alias("ticker")).filter(F.col("ticker") != "")
    once = named.groupBy(*keys, "ticker").agg(F.min("_p").alias("_p"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_p")).cast("bigint")
    placed = once.select(*keys, "ticker", place.alias("pos"))
    return placed if most is None else placed.filter(F.col("pos") <= most)
