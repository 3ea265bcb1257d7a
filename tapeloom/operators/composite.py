"""Weighted verdicts from signal rows, rule scores and the screener."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions import messages as M
from tapeloom.functions.exprs import clip, newest, total
from tapeloom.operators.signals import INDICATOR_COLUMNS

# Words of the votes, family weights and verdict limits.
UP_WORDS, DOWN_WORDS = "good|bullish|beat|positive", "warning|bearish|miss|negative"
WEIGHTS = {"technical": 0.40, "fundamental": 0.35, "sentiment": 0.25}
BULLISH, BEARISH = 0.25, -0.25


def vote(status: Column) -> Column:
    lower = F.lower(F.trim(status))
    return F.when(lower.rlike(UP_WORDS), 1.0).when(lower.rlike(DOWN_WORDS), -1.0).otherwise(0.0)


def combined_score(signals: DataFrame) -> DataFrame:
    """(ticker, family, status) -> weighted score, verdict, conflict, confidence.

    One aggregation whatever the number of signals; unknown news is dropped.
    """
    known = signals.filter((F.col("family") != "sentiment") | (F.col("status") != "unknown"))
    voted = known.withColumn("_v", vote(F.col("status")))
    means = [F.coalesce(F.avg(F.when(F.col("family") == f, F.col("_v"))), F.lit(0.0)).alias(f) for f in WEIGHTS]
    scored = voted.groupBy("ticker").agg(*means, F.count("*").alias("n_signals"), F.stddev_samp("_v").alias("_s"))
    score = clip(total([F.col(f) * w for f, w in WEIGHTS.items()]), -1, 1)
    t, f = F.col("technical"), F.col("fundamental")
    scored = scored.withColumn("score", score)
    s = F.col("score")
    return scored.select(
        "ticker", *WEIGHTS, "n_signals", "score", F.when(s >= BULLISH, "BUY").when(s <= BEARISH, "SELL / AVOID").otherwise("HOLD / WATCH").alias("verdict"),
        ((t * f < 0) & (F.abs(t) > 0.3) & (F.abs(f) > 0.3)).alias("conflicted"),
        F.when(F.col("n_signals") > 1, clip(1 - F.col("_s"), 0, 1)).otherwise(1.0).alias("confidence"))


def indicator_votes(indicators: DataFrame) -> DataFrame:
    """The four indicator signals of the newest complete bar."""
    last = newest(indicators.dropna(subset=list(INDICATOR_COLUMNS)), "close", *INDICATOR_COLUMNS)
    c, up, low, mid = (F.col(x) for x in ("close", "bb_upper", "bb_lower", "bb_mid"))
    rows = {
        "RSI": F.when(F.col("rsi") > 70, "warning").when(F.col("rsi") < 30, "good").otherwise("neutral"),
        "Trend": F.when(F.col("sma20") > F.col("sma50"), "good").otherwise("warning"),
        "Momentum": F.when(F.col("macd") > F.col("macd_signal"), "good").otherwise("warning"),
        "Volatility": F.when(c > up, "warning").when(c < low, "good").when(c > mid, "good").otherwise("neutral"),
    }
    made = F.array(*[F.struct(F.lit(k).alias("label"), v.alias("status")) for k, v in rows.items()])
    return last.select("ticker", F.inline(made))


def rule_score(df: DataFrame) -> DataFrame:
    """Mean of fifteen rule votes on the feature columns."""
    def two(c: str, high: float, low: float) -> Column:
        return F.when(F.col(c) > high, 1.0).when(F.col(c) < low, -1.0).otherwise(0.0)
    votes = [
        F.when(F.col("rsi") < 0.35, 1.0).when(F.col("rsi") > 0.7, -1.0).otherwise(0.0),
        F.when(F.col("macd_above_signal") > 0.5, 1.0).otherwise(-1.0), F.when(F.col("sma20_vs_sma50") > 0, 1.0).otherwise(-1.0),
        F.when(F.col("bb_position") < 0.3, 1.0).when(F.col("bb_position") > 0.7, -1.0).otherwise(0.0),
        two("cmf_20d", 0.05, -0.05), F.when(F.col("volume_surge_20d") > 0.2, 1.0).otherwise(0.0), two("alpha_21d", 0.01, -0.01),
        two("high_52w_proximity", 0.85, 0.6), two("revenue_growth", 0.05, 0.0), two("profit_margin", 0.1, 0.0), two("roe", 0.1, 0.0),
        two("fcf_yield", 0.02, 0.0), two("piotroski_score", 0.6, 0.3), two("analyst_score", 0.3, -0.3), two("insider_net_ratio", 0.1, -0.1)]
    return df.withColumn("rule_score", total(votes) / len(votes))


def min_max(df: DataFrame, column: str, out: str) -> DataFrame:
    ends = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    scaled = df.crossJoin(F.broadcast(ends))   # one row
    return scaled.withColumn(out, (F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-8)).drop("_lo", "_hi")


def agreement(verdicts: DataFrame, predictions: DataFrame) -> DataFrame:
    """Does the composite verdict point the same way as the prediction?"""
    joined = verdicts.join(predictions, "ticker")
    banner = F.when(F.col("verdict") == "BUY", 1).when(F.col("verdict") == "SELL", -1)
    model = F.when(F.col("pred_return") > 0, 1).when(F.col("pred_return") < 0, -1)
    return joined.withColumn("agreement", F.when(banner == model, "same").when(banner != model, "opposite").otherwise("none"))


VERDICT_ORDER = {"BUY": 3, "HOLD / WATCH": 2, "SELL / AVOID": 1}


def screener(scores: DataFrame) -> DataFrame:
    """All tickers ranked by verdict, then score."""
    rank = F.create_map(*[F.lit(x) for pair in VERDICT_ORDER.items() for x in pair])[F.col("verdict")]
    return scores.select("ticker", "score", "verdict", "confidence", rank.alias("verdict_rank")).orderBy(F.desc("verdict_rank"), F.desc("score"), "ticker")


def last_change(bars: DataFrame) -> DataFrame:
    """Last close and per cent change against the bar before."""
    prior = F.lag("close").over(Window.partitionBy("ticker").orderBy("date"))
    last = newest(bars.select("ticker", "date", "close", prior.alias("prev_close")), "close", "prev_close")
    return last.withColumn("change_pct", (F.col("close") - F.col("prev_close")) / F.col("prev_close") * 100)
