"""Statistics over the tickers of one date.

(ticker, date) is unique, so a date's group is the number of listed tickers and
all dates are about equally large; windows on date therefore spread evenly.
Groups without such a bound (a whole sample) go through functions.ranks.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.exprs import by_date, total


def zscores(df: DataFrame, columns: list[str]) -> DataFrame:
    """Population z-score per date; zero sigma counts as one, unknown as zero."""
    w = by_date()

    def z(c: str) -> Column:
        sigma = F.stddev_pop(c).over(w)
        safe = F.when(sigma < 1e-12, 1.0).otherwise(sigma)
        return F.coalesce((F.col(c) - F.avg(c).over(w)) / safe, F.lit(0.0)).alias(f"z_{c}")
    return df.select("*", *[z(c) for c in columns])


def batch_zscores(df: DataFrame, columns: list[str]) -> DataFrame:
    """Population z-score over the whole batch from one row of moments."""
    moments = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    joined = df.crossJoin(F.broadcast(moments))   # one row
    return joined.select(*df.columns, *[F.coalesce(F.when(F.col(f"_s_{c}") > 1e-12, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")),
                                                   F.lit(0.0)).alias(f"z_{c}") for c in columns])


# Features of the four pillars in training.
PILLARS_TRAINING = {
    "momentum": ("rsi", "macd_above_signal", "bb_position", "sma20_vs_sma50", "volume_surge_20d", "roc_21d", "alpha_21d", "sector_alpha_21d",
                 "high_52w_proximity", "cmf_20d", "kmid", "klen", "kup", "klow", "ksft", "roc_5", "roc_10", "roc_60", "ma_5", "ma_10", "ma_20", "ma_60",
                 "beta_5", "beta_10", "beta_20", "max_20", "min_20", "rank_10", "cntp_10", "cntn_10"),
    "squeeze": ("short_interest_pct", "std_5", "std_10", "std_20", "std_60", "rsqr_10", "rsqr_20", "corr_10", "vma_20", "qtlu_10", "qtld_10"),
    "catalyst": ("analyst_score", "insider_net_ratio"),
    "safety": ("altman_z",),
}
# Features of the four pillars in live use.
PILLARS_LIVE = {"momentum": ("coppock", "ridge_slope", "vol_ratio"), "squeeze": ("short_pct_float", "short_ratio"), "catalyst": ("analyst_upside", "put_call_ratio"), "safety": ("altman_z",)}


def pillar_means(df: DataFrame, pillars: dict[str, tuple[str, ...]]) -> DataFrame:
    """Mean z-score of each pillar's features (columns z_<feature>)."""
    return df.select("*", *[(total([F.col(f"z_{c}") for c in cols]) / len(cols)).alias(f"pillar_{name}") for name, cols in pillars.items()])


def linear_score(df: DataFrame, weights: dict[str, float], intercept: float = 0.0, out: str = "score") -> DataFrame:
    """Intercept plus weighted columns; equal weights come from the caller."""
    return df.withColumn(out, F.lit(float(intercept)) + total([F.col(c) * float(w) for c, w in weights.items()]))


def percentile_rank(df: DataFrame, value: str, out: str = "pct") -> DataFrame:
    """Average rank over n within the date, as a share in (0, 1]."""
    ordered = Window.partitionBy("date").orderBy(value)
    ties = F.count(value).over(Window.partitionBy("date", value))
    share = (F.rank().over(ordered) + (ties - 1) / 2) / F.count(value).over(by_date())
    known = df.filter(F.col(value).isNotNull())
    return known.withColumn(out, share)


def legs(df: DataFrame, value: str, fraction: float | None = None, count: int | None = None, least: int = 5) -> DataFrame:
    """Top (+1) and bottom (-1) names per date; ties break on ticker."""
    up = Window.partitionBy("date").orderBy(F.col(value), F.col("ticker"))
    down = Window.partitionBy("date").orderBy(F.col(value).desc(), F.col("ticker").desc())
    n = F.count("*").over(by_date())
    q = F.lit(count) if count else F.greatest(F.lit(1), F.floor(n * fraction)).cast("int")
    ranked = df.filter(F.col(value).isNotNull()).select("*", n.alias("_n"), q.alias("_q"), F.row_number().over(up).alias("_lo"), F.row_number().over(down).alias("_hi"))
    kept = ranked.filter((F.col("_n") >= least) & ((F.col("_lo") <= F.col("_q")) | (F.col("_hi") <= F.col("_q"))))
    sides = F.array_compact(F.array(F.when(F.col("_hi") <= F.col("_q"), 1), F.when(F.col("_lo") <= F.col("_q"), -1)))
    return kept.withColumn("leg", F.explode(sides)).drop("_lo", "_hi")


def quantile_buckets(df: DataFrame, value: str, buckets: int = 5, out: str = "bucket") -> DataFrame:
    """Equal-width buckets of the first-come rank per date."""
    order = Window.partitionBy("date").orderBy(F.col(value), F.col("ticker"))
    n = F.count("*").over(by_date())
    rn = F.row_number().over(order)
    bucket = F.when(n > 1, F.greatest(F.lit(1), F.ceil(buckets * (rn - 1) / (n - 1)))).otherwise(1)
    return df.withColumn(out, bucket.cast("int"))


def bucket_returns(df: DataFrame, target: str, bucket: str = "bucket") -> DataFrame:
    """Mean return per bucket, and whether it rises from the bucket below."""
    means = df.groupBy(bucket).agg(F.avg(target).alias("mean_return"), F.count("*").alias("n"))
    below = F.lag("mean_return").over(Window.partitionBy(F.lit(1)).orderBy(bucket))   # a handful of buckets
    return means.select("*", (F.col("mean_return") > below).alias("rising"))


def median_split_hits(df: DataFrame, score: str, outcome: str, least: int = 10) -> DataFrame:
    """Per date: do names at or above the median score beat the rest?"""
    split = df.select("date", score, outcome, F.median(score).over(by_date()).alias("_m"), F.count("*").over(by_date()).alias("_n"))
    daily = split.filter(F.col("_n") >= least).groupBy("date").agg(
        F.avg(F.when(F.col(score) >= F.col("_m"), F.col(outcome))).alias("top"),
        F.avg(F.when(F.col(score) < F.col("_m"), F.col(outcome))).alias("bottom"))
    return daily.dropna().agg(F.count("*").alias("n_days"), F.count_if(F.col("top") > F.col("bottom")).alias("n_won"),
                              F.avg((F.col("top") > F.col("bottom")).cast("double")).alias("hit_rate"))


TICKER_BLOCK, DATE_BLOCK = 256, 64


def _moments():
    """Sums over the common dates of every pair of a block pair: matrix products of (dates x tickers) frames."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        first, second = key[0], key[1]
        days, day = np.unique(rows["date"].to_numpy(), return_inverse=True)

        def frame(block: int):
            mine = (rows["_own"] == block).to_numpy()
            names, column = np.unique(rows["ticker"].to_numpy(str)[mine], return_inverse=True)
            values, known = np.zeros((len(days), len(names))), np.zeros((len(days), len(names)))
            values[day[mine], column], known[day[mine], column] = rows["ret"].to_numpy()[mine], 1.0
            return names, values, known
        (na, x, kx), (nb, y, ky) = frame(first), frame(second)
        sums = {"n": kx.T @ ky, "sx": x.T @ ky, "sy": kx.T @ y, "sxx": (x * x).T @ ky, "syy": kx.T @ (y * y), "sxy": x.T @ y}
        i, j = np.nonzero(sums["n"])
        i, j = (k[na[i] < nb[j]] for k in (i, j)) if first == second else (i, j)
        low = na[i] < nb[j]
        out = {"ticker_a": np.where(low, na[i], nb[j]), "ticker_b": np.where(low, nb[j], na[i]), "n": sums["n"][i, j].astype("int64"), "sxy": sums["sxy"][i, j]}
        for a, b in (("sx", "sy"), ("sxx", "syy")):
            out[a], out[b] = np.where(low, sums[a][i, j], sums[b][i, j]), np.where(low, sums[b][i, j], sums[a][i, j])
        return pd.DataFrame(out)
    return run


def return_correlations(bars: DataFrame, high: float = 0.75, low: float = 0.25, block: int = TICKER_BLOCK) -> DataFrame:
    """Pearson correlation of daily returns for all pairs of tickers with common dates.

    A blocked Gram matrix: tickers are dealt to blocks, dates to spans, and each pair of blocks and span is a few matrix products
    in one task. A row is sent once per block of tickers, not once per ticker; the moments of a pair are added up over the spans.
    """
    own = bars.select("ticker", "date", F.col("ret").cast("double").alias("ret")).filter(F.col("ret").isNotNull())
    n = own.select("ticker").distinct().count()
    blocks = max(-(-n // block), 1)
    dealt = own.withColumn("_own", F.pmod(F.xxhash64("ticker"), F.lit(blocks)).cast("int")).withColumn("_span", F.floor(F.unix_date("date") / DATE_BLOCK))
    met = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = met.withColumns({"_a": F.least("_own", "_other"), "_b": F.greatest("_own", "_other")}).drop("_other")
    parts = met.groupBy("_a", "_b", "_span").applyInPandas(_moments(), "ticker_a string, ticker_b string, n long, sxy double, sx double, sy double, sxx double, syy double")
    sums = parts.groupBy("ticker_a", "ticker_b").agg(*[F.sum(c).alias(c) for c in ("n", "sxy", "sx", "sy", "sxx", "syy")])

    def spread(squares: str, total: str) -> Column:
        return F.col(squares) - F.col(total) * F.col(total) / F.col("n")
    both = spread("sxx", "sx") * spread("syy", "sy")
    result = sums.select("ticker_a", "ticker_b", F.when(both > 0, (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(both)).alias("correlation"), "n")
    flag = F.when(F.col("correlation") > high, "concentrated").when(F.col("correlation") < low, "diversifying").otherwise("neutral")
    return result.withColumn("flag", flag)
