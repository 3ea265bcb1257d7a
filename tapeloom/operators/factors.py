"""Price signals and their information coefficients (rank correlations)."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.exprs import by_ticker, clip, newest, total
from tapeloom.functions.rolling import Roll, rolled
from tapeloom.operators.indicators import common_indicators

SIGNALS = ("rsi_signal", "macd_signal_val", "momentum_5d", "momentum_21d", "bb_position", "volume_surge",
           "price_vs_sma20", "price_vs_sma50", "trend_strength", "volatility_regime")
HORIZONS = (1, 5, 10, 21)


def price_signals(bars: DataFrame) -> DataFrame:
    """Ten clipped signals per bar; `bars` may already carry the indicators."""
    df = bars if "macd_signal" in bars.columns else common_indicators(bars)
    w = by_ticker()
    close = F.col("close")
    lags = [F.lag("close", k).over(w).alias(f"_c{k}") for k in (*range(1, 10), 21)]
    staged = df.select("*", close.alias("_c0"), F.row_number().over(w).alias("_rn"), *lags)
    staged = staged.withColumn("_r", F.when(F.col("_c1") != 0, close / F.col("_c1") - 1))
    r = F.col("_r")
    staged = rolled(staged, [Roll("sum", F.col("volume"), {20: "_v20"}), Roll("sum", r, {10: "_r10", 60: "_r60"}),
                             Roll("sum", r * r, {10: "_q10", 60: "_q60"})])

    def sigma(n: int) -> Column:
        var = (F.col(f"_q{n}") - F.col(f"_r{n}") * F.col(f"_r{n}") / n) / (n - 1)
        return F.when(F.col("_rn") >= n + 1, F.sqrt(F.greatest(var, F.lit(0.0))))
    slope = total([F.col(f"_c{k}") * (4.5 - k) for k in range(10)]) / 82.5
    band = F.col("bb_upper") - F.col("bb_lower")
    vol_mean = F.when((F.col("_rn") >= 20) & (F.col("_v20") != 0), F.col("_v20") / 20)
    s60 = sigma(60)
    out = {
        "rsi_signal": (50 - F.col("rsi")) / 50,
        "macd_signal_val": F.tanh((F.col("macd") - F.col("macd_signal")) / close * 100),
        "momentum_5d": clip(close / F.col("_c5") - 1, -0.2, 0.2),
        "momentum_21d": clip(close / F.col("_c21") - 1, -0.3, 0.3),
        "bb_position": clip(F.when(band != 0, (close - F.col("bb_lower")) / band) * 2 - 1, -1, 1),
        "volume_surge": clip(F.col("volume") / vol_mean - 1, -1, 2),
        "price_vs_sma20": clip(F.when(F.col("sma20") != 0, (close - F.col("sma20")) / F.col("sma20")), -0.15, 0.15),
        "price_vs_sma50": clip(F.when(F.col("sma50") != 0, (close - F.col("sma50")) / F.col("sma50")), -0.2, 0.2),
        "trend_strength": clip(F.when(close != 0, slope / close), -0.05, 0.05),
        "volatility_regime": clip(F.when(s60 > 0, sigma(10) / s60) - 1, -1, 1),
    }
    return staged.select(*bars.columns, *[v.alias(n) for n, v in out.items()])


def tied_rank(keys: list[str], value: str) -> Column:
    """Rank with ties averaged, inside groups of one ticker's or one date's rows."""
    return (F.rank().over(Window.partitionBy(*keys).orderBy(value))
            + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2)


def rank_correlation(x: str, y: str) -> Column:
    """Pearson correlation of two rank columns as a mergeable aggregate."""
    n, sx, sy = F.count("*"), F.sum(x), F.sum(y)
    cov = F.sum(F.col(x) * F.col(y)) - sx * sy / n
    vx, vy = F.sum(F.col(x) * F.col(x)) - sx * sx / n, F.sum(F.col(y) * F.col(y)) - sy * sy / n
    return F.when((vx > 1e-9) & (vy > 1e-9), cov / F.sqrt(vx * vy))


def long_signals(signals: DataFrame, names=SIGNALS) -> DataFrame:
    return signals.unpivot(["ticker", "date", "close"], list(names), "signal", "value")


def time_series_ic(signals: DataFrame, horizons=HORIZONS, least: int = 10) -> DataFrame:
    """Spearman of each signal with the forward return, per ticker and horizon.

    Signals and horizons are extra keys of one plan. Everything after the first
    shuffle on ticker stays in place, and a group is one ticker's days.
    """
    ahead = signals.select("ticker", "date", "close", *SIGNALS, F.array(*[
        F.struct(F.lit(h).alias("horizon"), (F.lead("close", h).over(by_ticker()) / F.col("close") - 1).alias("fwd")) for h in horizons]).alias("_ahead"))
    long = ahead.unpivot(["ticker", "date", "_ahead"], list(SIGNALS), "signal", "value").filter(F.col("value").isNotNull())
    pairs = long.select("ticker", "signal", "value", F.inline("_ahead")).filter(F.col("fwd").isNotNull())
    keys = ["ticker", "signal", "horizon"]
    ranked = pairs.select(*keys, tied_rank(keys, "value").alias("_x"), tied_rank(keys, "fwd").alias("_y"))
    ic = ranked.groupBy(*keys).agg(rank_correlation("_x", "_y").alias("ic"), F.count("*").alias("n")).filter(F.col("n") >= least)
    t = F.col("ic") * F.sqrt("n") / F.sqrt(F.greatest(1 - F.col("ic") * F.col("ic"), F.lit(1e-10)))
    return ic.withColumn("tstat", t)


def ic_summary(ic: DataFrame) -> DataFrame:
    out = ic.groupBy("ticker", "signal").agg(
        F.avg(F.abs("ic")).alias("mean_ic_abs"), F.avg("ic").alias("mean_ic"), F.max(F.abs("tstat")).alias("max_tstat"),
        F.count_if(F.col("ic") > 0).alias("_p"), F.count_if(F.col("ic") < 0).alias("_n"))
    return out.select("ticker", "signal", "mean_ic_abs", "mean_ic", "max_tstat", ((F.col("_p") >= 3) | (F.col("_n") >= 3)).alias("consistent"))


def exploratory_table(summary: DataFrame, signals: DataFrame, least: float = 0.05) -> DataFrame:
    """Signals with enough measured power, their current value and direction."""
    now = long_signals(newest(signals, "close", *SIGNALS)).filter(F.col("value").isNotNull()).select("ticker", "signal", F.col("value").alias("current_value"))
    kept = summary.filter(F.col("mean_ic_abs") >= least).join(now, ["ticker", "signal"])
    return kept.select("ticker", "signal", "mean_ic_abs", "current_value", F.when(F.col("mean_ic") >= 0, "normal").otherwise("contrarian").alias("direction"))


def composite(signals: DataFrame, summary: DataFrame, least: float = 0.05, warm: int = 30) -> DataFrame:
    """In-sample IC-weighted mean of expanding z-scores, per bar.

    The weights use the whole sample's IC, so the result is in-sample by
    construction. The expanding moments are running sums, O(1) per bar.
    """
    w = by_ticker().rowsBetween(Window.unboundedPreceding, 0)

    def z(name: str) -> Column:
        s = F.stddev_samp(name).over(w)
        return F.when((F.count(name).over(w) >= warm) & (s > 0), clip((F.col(name) - F.avg(name).over(w)) / s, -3, 3) / 3)
    scored = signals.select("ticker", "date", *[F.coalesce(z(n), F.lit(0.0)).alias(n) for n in SIGNALS])
    used = summary.filter(F.col("mean_ic_abs") >= least)
    weight = F.when(F.col("mean_ic") >= 0, F.col("mean_ic_abs")).otherwise(-F.col("mean_ic_abs"))
    weights = used.groupBy("ticker").agg(*[F.sum(F.when(F.col("signal") == n, weight)).alias(f"_w_{n}") for n in SIGNALS],
                                         F.sum("mean_ic_abs").alias("_total"))
    joined = scored.join(weights, "ticker", "left")
    value = total([F.coalesce(F.col(f"_w_{n}"), F.lit(0.0)) * F.col(n) for n in SIGNALS])
    return joined.select("ticker", "date", F.when(F.col("_total") > 0, value / F.col("_total")).alias("composite"))


def composite_verdict(composites: DataFrame) -> DataFrame:
    last = newest(composites, "composite")
    c = F.col("composite")
    return last.select("ticker", "composite", F.when(c > 0.15, "BUY").when(c < -0.15, "SELL").when(c.isNotNull(), "HOLD").alias("verdict"))


def _average_ranks(windows: np.ndarray) -> np.ndarray:
    below = (windows[:, None, :] < windows[:, :, None]).sum(axis=2)
    same = (windows[:, None, :] == windows[:, :, None]).sum(axis=2)
    return below + (same + 1) / 2.0


def rolling_ic(signals: DataFrame, signal: str, horizon: int = 5, window: int = 63, least: int = 30) -> DataFrame:
    """Spearman inside every window of bars.

    Ranks change with each window, which no built-in frame expresses; the
    windows of one ticker (its days, a bounded group) are ranked as arrays.
    """
    ahead = F.lead("close", horizon).over(by_ticker()) / F.col("close") - 1
    pairs = signals.select("ticker", "date", F.col(signal).alias("x"), ahead.alias("y"))

    def ranked(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("date")
        ok = (g["x"].notna() & g["y"].notna()).to_numpy()
        x, y = g["x"].to_numpy(float), g["y"].to_numpy(float)
        out = np.full(len(g), np.nan)
        for end in range(window, len(g) + 1, 64):          # blocks of windows
            ends = np.arange(end, min(end + 64, len(g) + 1))
            rows = ends[:, None] - window + np.arange(window)[None, :]
            full = ok[rows].all(axis=1)
            if full.any():
                rx, ry = _average_ranks(x[rows[full]]), _average_ranks(y[rows[full]])
                rx, ry = rx - rx.mean(axis=1, keepdims=True), ry - ry.mean(axis=1, keepdims=True)
                scale = np.sqrt((rx ** 2).sum(axis=1) * (ry ** 2).sum(axis=1))
                with np.errstate(invalid="ignore", divide="ignore"):
                    out[ends[full] - 1] = np.where(scale > 0, (rx * ry).sum(axis=1) / scale, np.nan)
            for i in np.flatnonzero(~full & (ok[rows].sum(axis=1) >= least)):
                keep = rows[i][ok[rows[i]]]
                rx, ry = _average_ranks(x[keep][None, :])[0], _average_ranks(y[keep][None, :])[0]
                if rx.std() > 0 and ry.std() > 0:
                    out[ends[i] - 1] = np.corrcoef(rx, ry)[0, 1]
        return pd.DataFrame({"ticker": g["ticker"], "date": g["date"], "rolling_ic": out})
    made = pairs.groupBy("ticker").applyInPandas(ranked, "ticker string, date date, rolling_ic double")
    return made.withColumn("rolling_ic", F.nanvl("rolling_ic", F.lit(None).cast("double"))).filter(F.col("rolling_ic").isNotNull())


SWEEP = (1, 5, 21, 63, 126)


def ic_sweep(panel: DataFrame, features: tuple[str, ...], horizons=SWEEP) -> DataFrame:
    """Mean over dates of the per-date Spearman, for every feature and horizon.

    Wide rows are shuffled once on date; the unpivot and all ranks follow in
    place. Returns are ranked once per date, before the unpivot, and the five
    correlations of a feature come from one aggregation.
    """
    w = by_ticker()
    ahead = [(F.lead("close", h).over(w) / F.col("close") - 1).alias(f"_f{h}") for h in horizons]
    rows = panel.select("ticker", "date", *features, *ahead).dropna(subset=[f"_f{h}" for h in horizons])
    ranked = rows.select("date", *features, *[tied_rank(["date"], f"_f{h}").alias(f"_y{h}") for h in horizons])
    long = ranked.unpivot(["date", *[f"_y{h}" for h in horizons]], list(features), "feature", "value").filter(F.col("value").isNotNull())
    placed = long.withColumn("_x", tied_rank(["date", "feature"], "value"))
    daily = placed.groupBy("date", "feature").agg(*[rank_correlation("_x", f"_y{h}").alias(f"ic_{h}d") for h in horizons])
    return daily.groupBy("feature").agg(*[F.avg(f"ic_{h}d").alias(f"ic_{h}d") for h in horizons])


def best_horizon(sweep: DataFrame, horizons=SWEEP) -> DataFrame:
    pairs = F.array(*[F.struct(F.abs(f"ic_{h}d").alias("size"), F.lit(-h).alias("h")) for h in horizons])
    return sweep.select("feature", (-F.array_max(pairs)["h"]).alias("best_horizon"), F.array_max(pairs)["size"].alias("abs_ic"))


def horizon_counts(sweep: DataFrame) -> DataFrame:
    return best_horizon(sweep).groupBy("best_horizon").agg(F.count("*").alias("n_features"))


def pruning_candidates(sweep: DataFrame, limit: float = 0.01, horizons=SWEEP) -> DataFrame:
    weak = F.greatest(*[F.abs(f"ic_{h}d") for h in horizons]) < limit
    return sweep.filter(weak).select("feature")
