"""Indicators on daily bars: bars(ticker, date, open, high, low, close, volume).

All functions keep one row per bar and use the (ticker, date) window, so a
chain of them shuffles once on ticker. Bars are unique by (ticker, date): a
ticker's group never exceeds the number of trading days.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.exprs import (by_ticker, change, clip, frame, full, lagged, last_rows, mean_of, newest, rolling,
                                      total, upto)
from tapeloom.functions.smoothing import ewm_many, ewm_span, span_alpha

TRADING_DAYS = 252


def sma(df: DataFrame, n: int, value: str = "close", out: str | None = None) -> DataFrame:
    return df.withColumn(out or f"sma{n}", rolling(F.avg, F.col(value), n))


def _steps(*extra: str) -> list:
    step = F.col("close") - lagged("close", 1, *extra)
    return [F.when(step.isNotNull(), F.greatest(step, F.lit(0.0))).alias("_gain"),
            F.when(step.isNotNull(), F.greatest(-step, F.lit(0.0))).alias("_loss")]


def _strength():
    return F.when(F.col("_down") > 0, 100 - 100 / (1 + F.col("_up") / F.col("_down"))).when(F.col("_up") > 0, F.lit(100.0))


def rsi(df: DataFrame, n: int = 14, *extra: str) -> DataFrame:
    """Relative strength with Wilder smoothing of gains and losses."""
    staged = ewm_many(df.select("*", *_steps(*extra)), [("_gain", "_up", 1.0 / n), ("_loss", "_down", 1.0 / n)], *extra)
    return staged.select(*df.columns, _strength().alias("rsi"))


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    staged = ewm_many(df, [("close", "_fast", span_alpha(fast)), ("close", "_slow", span_alpha(slow))])
    staged = staged.select(*df.columns, (F.col("_fast") - F.col("_slow")).alias("macd"))
    return ewm_span(staged, "macd", "macd_signal", signal)


def oscillators(df: DataFrame, n: int = 14, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """RSI and MACD together: their four first-level means share one pass."""
    staged = ewm_many(df.select("*", *_steps()), [
        ("_gain", "_up", 1.0 / n), ("_loss", "_down", 1.0 / n),
        ("close", "_fast", span_alpha(fast)), ("close", "_slow", span_alpha(slow))])
    staged = staged.select(*df.columns, _strength().alias("rsi"), (F.col("_fast") - F.col("_slow")).alias("macd"))
    return ewm_span(staged, "macd", "macd_signal", signal)


def bollinger(df: DataFrame, n: int = 20, width: float = 2.0) -> DataFrame:
    close = F.col("close")
    mid, spread = rolling(F.avg, close, n), rolling(F.stddev_samp, close, n)
    return df.select("*", (mid + width * spread).alias("bb_upper"), mid.alias("bb_mid"),
                     (mid - width * spread).alias("bb_lower"))


def common_indicators(df: DataFrame) -> DataFrame:
    """SMA20/50, RSI, MACD and Bollinger columns on every bar."""
    close = F.col("close")
    means = [rolling(F.avg, close, n).alias(f"sma{n}") for n in (20, 50)]
    return bollinger(oscillators(df)).select("*", *means)


def volume_indicators(df: DataFrame, n: int = 20) -> DataFrame:
    staged = df.withColumn("vol_ma20", rolling(F.avg, F.col("volume"), n)).withColumn("_pc", lagged("close", 1))
    moved = F.coalesce(F.col("close") != F.col("_pc"), F.lit(False))
    above = F.coalesce(F.col("volume") > F.col("vol_ma20"), F.lit(False))
    return staged.select(*df.columns, "vol_ma20",
                         F.when(F.col("vol_ma20") != 0, F.col("volume") / F.col("vol_ma20")).alias("vol_ratio"),
                         (moved & above).alias("vol_price_confirm"), F.col("_pc").alias("prev_close"))


def true_range(*extra: str):
    prior = lagged("close", 1, *extra)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prior), F.abs(F.col("low") - prior))


def atr_partial(df: DataFrame, n: int = 14) -> DataFrame:
    """Mean true range of up to n bars over the close, bounded 0..0.2."""
    staged = df.withColumn("_tr", true_range())
    share = F.avg("_tr").over(frame(n)) / (F.col("close") + 1e-8)
    return staged.withColumn("atr_pct", clip(share, 0, 0.2)).drop("_tr")


def atr_full(df: DataFrame, n: int = 14) -> DataFrame:
    """Mean true range in price units, NULL before n bars."""
    staged = df.withColumn("_tr", true_range())
    return staged.withColumn("atr", rolling(F.avg, F.col("_tr"), n)).drop("_tr")


def money_flow(df: DataFrame, n: int = 20) -> DataFrame:
    spread = F.col("high") - F.col("low") + 1e-8
    flow = ((F.col("close") - F.col("low")) - (F.col("high") - F.col("close"))) / spread * F.col("volume")
    staged = df.withColumn("_mf", flow)
    volume = rolling(F.sum, F.col("volume"), n)
    value = F.when(volume != 0, rolling(F.sum, F.col("_mf"), n) / volume)
    return staged.withColumn("cmf_20d", clip(value, -1, 1)).drop("_mf")


# Horizon in bars, output column, per cent move that saturates the vote.
MOMENTUM_HORIZONS = ((21, "ret_1mo", 5.0), (63, "ret_3mo", 15.0), (126, "ret_6mo", 25.0), (252, "ret_1yr", 40.0))


def momentum(df: DataFrame) -> DataFrame:
    """Last-bar returns over four horizons, their mean vote and the trend."""
    w = by_ticker()
    columns = [F.count("close").over(upto()).alias("n"), "close"]
    columns += [F.lag("close", bars - 1).over(w).alias(f"_{name}") for bars, name, _ in MOMENTUM_HORIZONS]
    staged = newest(df.select("ticker", "date", *columns), "n", "close", *[f"_{h[1]}" for h in MOMENTUM_HORIZONS])
    for bars, name, _ in MOMENTUM_HORIZONS:
        staged = staged.withColumn(name, F.when(F.col("n") >= bars + 1,
                                                (F.col("close") - F.col(f"_{name}")) / F.col(f"_{name}") * 100))
    votes = [clip(F.col(name) / cap, -1, 1) for _, name, cap in MOMENTUM_HORIZONS]
    staged = staged.withColumn("momentum_score", F.coalesce(mean_of(*votes), F.lit(0.0)))
    score = F.col("momentum_score")
    trend = (F.when(score > 0.5, "strong_up").when(score > 0.1, "up").when(score < -0.5, "strong_down")
             .when(score < -0.1, "down").otherwise("neutral"))
    return staged.select("ticker", "date", *[h[1] for h in MOMENTUM_HORIZONS], "momentum_score", trend.alias("trend"))


def coppock(df: DataFrame, long: int = 14, short: int = 11, n: int = 10) -> DataFrame:
    """Weighted mean of two rates of change; the oldest bar weighs most."""
    staged = df.withColumn("_roc", (change("close", long) + change("close", short)) * 100)
    weighted = total([lagged("_roc", k) * float(k + 1) for k in range(n)]) / (n * (n + 1) / 2)
    return staged.withColumn("coppock", weighted).drop("_roc")


def coppock_signal(df: DataFrame) -> DataFrame:
    last = newest(coppock(df), "coppock")
    value = F.coalesce(F.col("coppock"), F.lit(0.0))
    size = clip(F.abs(value) / 50, 0.3, 1)
    return last.select("ticker", value.alias("value"),
                       F.when(value > 0, size).when(value < 0, -size).otherwise(0.0).alias("signal"),
                       F.when(value > 0, "bullish").when(value < 0, "bearish").otherwise("neutral").alias("trend"))


def trend_slope(df: DataFrame, n: int = 20) -> DataFrame:
    """Least-squares slope of the last n closes after scaling by their sigma."""
    rows = last_rows(df.select("ticker", "date", "close"), n)
    position = F.datediff("date", F.lit("1970-01-01").cast("date"))
    ranked = rows.withColumn("_x", F.row_number().over(by_ticker()).cast("double"))
    fit = ranked.groupBy("ticker").agg(F.count("*").alias("n"), F.regr_slope("close", "_x").alias("b"),
                                       F.stddev_pop("close").alias("s"), F.max(position).alias("_d"))
    usable = (F.col("n") >= n) & (F.col("s") >= 1e-9)
    slope = F.when(usable, F.col("b") / (F.col("s") + 1e-9)).otherwise(0.0)
    staged = fit.select("ticker", slope.alias("slope")).withColumn("signal", clip(F.col("slope") / 0.2, -1, 1))
    return staged.withColumn("interpretation", F.when(F.col("signal") > 0.05, "uptrend")
                             .when(F.col("signal") < -0.05, "downtrend").otherwise("neutral"))


def pmo(df: DataFrame, first: int = 34, second: int = 19) -> DataFrame:
    """Price momentum oscillator: a rate of change smoothed twice."""
    staged = df.withColumn("_roc", change("close", 1) * 100)
    staged = ewm_span(staged, "_roc", "_s", first).withColumn("_s", F.col("_s") * 10)
    return ewm_span(staged, "_s", "pmo", second).drop("_roc", "_s")


def pmo_relative(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Last PMO of each ticker against the benchmark's last PMO."""
    own = newest(ewm_span(pmo(df.select("ticker", "date", "close")), "pmo", "pmo_signal", 9), "pmo", "pmo_signal")
    market = benchmark.select(F.lit("-").alias("ticker"), "date", "close")
    market = newest(ewm_span(pmo(market), "pmo", "pmo_signal", 9), "pmo", "pmo_signal")
    market = market.select(F.col("pmo").alias("spy_pmo"), F.col("pmo_signal").alias("spy_pmo_signal"))
    joined = own.drop("date").crossJoin(F.broadcast(market))   # one row
    joined = joined.withColumn("rs_score", F.col("pmo") - F.col("spy_pmo"))
    joined = joined.withColumn("rs_norm", clip(F.col("rs_score") / 5, -1, 1))
    trend = F.when(F.col("rs_norm") > 0.2, "leading").when(F.col("rs_norm") < -0.2, "lagging").otherwise("neutral")
    return joined.withColumn("trend", trend)


def realised_vol(df: DataFrame, n: int = 30) -> DataFrame:
    staged = df.withColumn("_r", change("close", 1))
    return staged.withColumn("rv30", rolling(F.stddev_samp, F.col("_r"), n) * TRADING_DAYS ** 0.5).drop("_r")


def range_rank(df: DataFrame, n: int = TRADING_DAYS) -> DataFrame:
    """Where the last close stands between the lows and highs of n bars."""
    high, low = F.max("high").over(frame(n)), F.min("low").over(frame(n))
    last = newest(df.select("ticker", "date", "close", high.alias("week52_high"), low.alias("week52_low")),
                  "close", "week52_high", "week52_low")
    span = F.col("week52_high") - F.col("week52_low")
    rank = F.when(span > 0, clip((F.col("close") - F.col("week52_low")) / span, 0, 1)).otherwise(0.0)
    return last.select("ticker", "week52_high", "week52_low", rank.alias("week52_rank"))


def relative_performance(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """First-to-last return of each ticker and of the benchmark, per cent."""
    def ends(frame_, *keys):
        return frame_.groupBy(*keys).agg(F.min_by("close", "date").alias("a"), F.max_by("close", "date").alias("b"))
    market = ends(benchmark).select(((F.col("b") - F.col("a")) / F.col("a") * 100).alias("_m"))
    joined = ends(df, "ticker").crossJoin(F.broadcast(market))   # one row
    own = (F.col("b") - F.col("a")) / F.col("a") * 100
    return joined.select("ticker", F.round(own, 1).alias("ticker_return_pct"), F.round("_m", 1).alias("spy_return_pct"),
                         F.round(own - F.col("_m"), 1).alias("alpha_pct"), (own - F.col("_m") > 0).alias("outperforming"))


def rebased_series(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Both lines on their common dates, each starting at 100."""
    market = benchmark.select("date", F.col("close").alias("_m"))
    common = df.select("ticker", "date", "close").join(market, "date")
    first = upto()
    return common.select("ticker", "date",
                         (F.col("close") / F.first("close").over(first) * 100).alias("ticker_series"),
                         (F.col("_m") / F.first("_m").over(first) * 100).alias("spy_series"))
